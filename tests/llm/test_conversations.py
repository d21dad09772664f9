"""Repair of conversations: the search against all edits, awkward rows, long conversations."""

from __future__ import annotations

import random

import pytest

from usagelens.llm import conversations, repair_search
from usagelens.llm.conversations import damaged, repair_conversations, undamaged

from . import brute
from .test_operators import clash

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
ROLES = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}


def as_rows(letters):
    """Rows with the roles and faults of a text for the search."""
    return [
        (ROLES.get(c.lower(), "user"), "t", "blank" if c == "x" else "truncated" if c.isupper() else "") for c in letters
    ]


@pytest.mark.parametrize("block", [3, 128])
def test_search_against_all_edits(monkeypatch, block):
    monkeypatch.setattr(repair_search, "ROWS", block)
    r = random.Random(block)
    for n in range(1500):
        letters = "".join(r.choice("suaSUAxo" if n % 2 else "uauauauUAx") for _ in range(r.randint(0, 14)))
        expected = brute.cheapest_repair(as_rows(letters))[:2]
        assert repair_search.repair(letters) == expected, letters
        table = repair_search.segment_table(letters)
        assert repair_search.ended({b: v for (a, b), v in table.items() if a == repair_search.START}) == expected


def test_bounds_never_exceed_the_cost():
    r = random.Random(9)
    for _ in range(300):
        letters = "".join(r.choice("suaSUAxo") for _ in range(r.randint(0, 9)))
        assert repair_search.suffix_bounds(letters, None)[0][0] <= repair_search.repair(letters)[0]


@pytest.mark.parametrize("letters", ["s" * 400, "ua" * 200, "o" * 400, "SsUu" * 100, "x" * 400])
def test_long_conversations_are_searched_in_blocks(letters):
    assert repair_search.repair(letters) == brute.cheapest_repair(as_rows(letters))[:2]


def random_rows(seed, convs, most):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Well", " \n", "", "Why?", "So it is, he said. ", None, "a" * 50]
    rows = []
    for conv in convs:
        for turn in range(r.randint(1, most)):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            rows.append((conv, r.choice([turn, turn, turn, None, turn * 3]), role, r.choice(texts)))
    return rows


def results(df):
    return {r[0]: tuple(r[1:]) for r in df.select("conv", *COLUMNS).collect()}


def test_awkward_rows(spark, table):
    rows = random_rows(1, [None, *range(60)], 12)
    rows += rows[:40]  # repeated rows
    found = results(repair_conversations(damaged(clash(table(rows, SCHEMA), "conv", "digest", "copies"))))
    assert found == brute.repaired_conversations(rows)
    assert repair_conversations(damaged(table([], SCHEMA))).count() == 0


def test_a_conversation_over_all_tasks(spark, table, monkeypatch):
    """A conversation with most of the rows, spread over tasks, with one message in most of its turns."""
    r = random.Random(4)
    rows = [(7, i, r.choice(["user", "assistant"]), r.choice(["Same.", "Same.", f"Own {i}."])) for i in range(900)]
    rows += random_rows(5, range(100, 140), 5)
    found = results(repair_conversations(damaged(table(rows, SCHEMA, 5))))
    assert found == brute.repaired_conversations(rows)


def test_too_long_for_a_task(spark, table, monkeypatch):
    monkeypatch.setattr(conversations, "WHOLE_ROWS", 3)
    rows = random_rows(6, range(30), 9)
    assert results(repair_conversations(damaged(table(rows, SCHEMA)))) == brute.repaired_conversations(rows)


def test_texts_as_names_and_rows_as_they_are(spark, table):
    rows = [("a", 0, "user", "Hi."), ("a", 1, "assistant", "Yes."), ("b", 0, "assistant", "So.")]
    df = undamaged(table(rows, "conv_id string, turn int, role string, text string"))
    found = results(repair_conversations(df))
    assert (found["a"][5], found["a"][6]) == (0, "KK") and (found["b"][5], found["b"][6]) == (2, "D")
    with pytest.raises(ValueError):
        repair_conversations(undamaged(table([(1.5, 0, "user", "Hi.")], "conv_id double, turn int, role string, text string")))
