"""Adaptive context-mixing range coder for token ids, many blocks in step.

A block is coded on its own, with a model that starts anew.  Three predictors speak for an id: what
followed the two ids before it last time (order 2), what followed the one before it (order 1), and the
ids seen so far (order 0: a small table of ids that came back, a larger one of all, and every id at
all).  Their predictions are mixed with weights that adapt in a context of how often the predictors of
order 2 and 1 have been right, and the id is coded, in one interval, by the first predictor that has it.

Blocks share nothing, so the arrays below hold one element per block, and one step of the loop codes an
id of every block.  Only whole numbers take part; a decoder on any machine retraces the encoder.
"""

from __future__ import annotations

import numpy as np

#: Ids per block; the last block of a group may be shorter.
BLOCK = 1 << 11
#: Blocks coded in step; bounds the memory of a task.
LANES = 1 << 12
#: Largest id that can be coded.
LARGEST_ID = (1 << 16) - 2

ORDER2_BITS, ORDER1_BITS, SEEN_BITS, BACK_BITS = 11, 10, 11, 6
#: Predictors: order 2, order 1, an id that came back, one that was seen, any id.
PREDICTORS, CONTEXTS = 5, 16
#: By predictor: bits of an id's 16-bit hash that its prediction leaves open, as a power of the share each
#: of its ids gets.
OPEN_BITS = np.array([16, 16, 16 - BACK_BITS, 16 - SEEN_BITS, 0], np.uint64)
#: Spreads the ids over the tables; odd, so every hash belongs to one id.
SPREAD = 40503
GATHER = pow(SPREAD, -1, 1 << 16)
#: Spreads the hashes of the ids before over the tables of order 2 and 1.
CONTEXT_SPREAD = 0x9E3779B1
#: Steps for which the encoder finds the places in the tables at once.
AHEAD = 32

#: The weights of a context lie in one number: running sums, 11 bits each, from 0 to their total.
FIELD = 11
STEP, LIMIT = 8, 496
ADDED = np.array([sum(STEP << FIELD * j for j in range(k + 1, PREDICTORS + 1)) for k in range(PREDICTORS)], np.uint64)
FIELD_OF = np.array([FIELD * k for k in range(PREDICTORS)], np.uint64)
#: The predictor, by which ones have the id, the first one's bit the highest.
FIRST = np.array([PREDICTORS - 1 - f.bit_length() for f in range(1 << PREDICTORS - 1)])
#: How often an id was right, by how often before, or 4 where it was wrong.
RIGHT = np.array([1, 2, 3, 3, 1], np.int32)
ONES = np.uint64(sum(1 << FIELD * j for j in range(1, PREDICTORS)))
GUARDS = np.uint64(sum(1 << FIELD * j + FIELD - 1 for j in range(1, PREDICTORS)))
INNER = np.uint64((1 << FIELD * PREDICTORS) - 1)
LOWEST = np.uint64(sum(1 << FIELD * j for j in range(PREDICTORS - 1)))
EVERY = np.uint64(sum(1 << FIELD * j for j in range(PREDICTORS)))
HALVES = np.uint64(sum((1 << FIELD - 1) - 1 << FIELD * j for j in range(PREDICTORS)))

WORD, LOW_WORD, FULL = np.uint64(1 << 32), np.uint64((1 << 32) - 1), np.uint64((1 << 64) - 1)
U1, U3, U16, U32 = np.uint64(1), np.uint64(7), np.uint64(16), np.uint64(32)
U_FIELD, U_SUM = np.uint64(FIELD), np.uint64((1 << FIELD) - 1)
FULL_TOTAL = np.uint64(LIMIT + 1 << FIELD * PREDICTORS)
U_TOTAL, U_GUARD, U_LAST = np.uint64(FIELD * PREDICTORS), np.uint64(2 * FIELD - 1), np.uint64(FIELD * (PREDICTORS - 2))


def _packed(weights: tuple[int, ...]) -> int:
    return sum(sum(weights[: j + 1]) << FIELD * (j + 1) for j in range(PREDICTORS))


def _first_weights() -> np.ndarray:
    """Weights per context at the start: predictors that were right more often weigh more."""
    rows = [(1 + 16 * right2, 1 + 8 * right1, 8, 24, 24) for right2 in range(4) for right1 in range(4)]
    return np.array([_packed(r) for r in rows], np.uint64)


def _halved(packed: np.ndarray) -> np.ndarray:
    """The weights halved, rounded up, so that none vanishes; all of a context at once."""
    weights = (packed >> U_FIELD) - (packed & INNER)
    return ((weights + EVERY >> U1 & HALVES) * EVERY & INNER) << U_FIELD


class _Model:
    """The predictors of ``n`` blocks, and the state of their coder."""

    def __init__(self, n: int) -> None:
        # A table holds a slot of all blocks, then the next slot: frequent ids keep to few cache lines.
        self.n, self.lanes = n, np.arange(n, dtype=np.int64)
        self.order2 = np.zeros(n << ORDER2_BITS, np.int32)  # id and how often it was right, up to 3
        self.order1 = np.zeros(n << ORDER1_BITS, np.int32)
        self.seen = np.zeros(n << SEEN_BITS, np.uint16)  # id + 1
        self.back = np.zeros(n << BACK_BITS, np.uint16)
        self.weights = np.tile(_first_weights(), n)
        self.at_weights = self.lanes * CONTEXTS
        self.low, self.span = np.zeros(n, np.uint64), np.full(n, FULL)

    def places(self, slots: np.ndarray) -> np.ndarray:
        """Where a table has the slots of the first blocks."""
        return slots * self.n + self.lanes[: slots.shape[-1]]

    def predict(self, m: int, place2: np.ndarray, place1: np.ndarray) -> None:
        """What the predictors of the first ``m`` blocks say about the next id, at its places of order 2 and 1."""
        self.place2, self.place1 = place2, place1
        self.said2, self.said1 = self.order2.take(place2), self.order1.take(place1)
        self.row = ((self.said2 & 3) << 2 | self.said1 & 3) + self.at_weights[:m]
        self.sums = self.weights.take(self.row)
        self.unit = self.span[:m] // (self.sums >> U_TOTAL << U16)

    def parts(self, predictor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a predictor's interval starts, the width of a place in it, and the bits that it leaves open."""
        open_ = OPEN_BITS.take(predictor)
        there = self.sums >> FIELD_OF.take(predictor)
        start = there & U_SUM
        return start << U16, ((there >> U_FIELD & U_SUM) - start) << open_, open_

    def narrow(self, m: int, place: np.ndarray, start: np.ndarray, width: np.ndarray):
        """Narrow the interval to a place of a predictor; gives the blocks whose leading word is settled, and it."""
        base = self.low[:m] + self.unit * (start + place * width)
        size = self.unit * width
        settled = size < WORD
        # What would reach over the end of the leading word is given up.
        kept = np.minimum(size, (~base & LOW_WORD) + U1)
        self.low[:m] = np.where(settled, base << U32, base)
        self.span[:m] = np.where(settled, kept << U32, size)
        return settled.nonzero()[0], base

    def learn(self, ids: np.ndarray, marked: np.ndarray, predictor: np.ndarray, seen: np.ndarray, again: np.ndarray,
              back: np.ndarray, wrong2: np.ndarray, wrong1: np.ndarray) -> None:
        """Take in the ids (times 4); ``seen`` and ``back`` are their places in the two tables, ``again`` tells
        which were in the first, and ``wrong2`` and ``wrong1`` how often the predictors were right, or over 3."""
        self.order2[self.place2] = ids | RIGHT.take(np.minimum(wrong2, 4))
        self.order1[self.place1] = ids | RIGHT.take(np.minimum(wrong1, 4))
        returned = again.nonzero()[0]
        self.back[back.take(returned)] = marked.take(returned)
        self.seen[seen] = marked
        added = self.sums + ADDED.take(predictor)
        full = (added >= FULL_TOTAL).nonzero()[0]
        if len(full):
            added[full] = _halved(added[full])
        self.weights[self.row] = added


def _active(lengths: np.ndarray, steps: int) -> list[int]:
    return np.searchsorted(-lengths, -np.arange(steps), side="left").tolist()


def _slot1(last: np.ndarray) -> np.ndarray:
    return last >> 15 & (1 << ORDER1_BITS) - 1


def _slot2(last: np.ndarray, before_shifted: np.ndarray) -> np.ndarray:
    return (last ^ before_shifted) >> 12 & (1 << ORDER2_BITS) - 1


def encode(blocks: list[np.ndarray]) -> list[np.ndarray]:
    """The words (32 bits) of every block of ids; all blocks have ids, longest first."""
    n, lengths = len(blocks), np.array([len(b) for b in blocks], np.int64)
    steps = int(lengths.max(initial=0))
    ids = np.zeros((steps, n), np.uint16)
    for lane, block in enumerate(blocks):
        if block.max() > LARGEST_ID:
            raise ValueError(f"ids over {LARGEST_ID} cannot be coded")
        ids[: len(block), lane] = block
    model, active = _Model(n), _active(lengths, steps)
    words, filled = np.zeros((n, steps + 2), np.uint32), np.arange(n) * (steps + 2)
    flat = words.reshape(-1)
    contexts = np.zeros((2, n), np.int64)
    for first in range(0, steps, AHEAD):
        some = ids[first : first + AHEAD]
        some_marked, some_ids = some + np.uint16(1), some.astype(np.int32) << 2
        spread = (some * np.uint16(SPREAD)).astype(np.int64)
        contexts = np.concatenate([contexts[-2:], spread * CONTEXT_SPREAD])
        some_places1 = model.places(_slot1(contexts[1:-1]))
        some_places2 = model.places(_slot2(contexts[1:-1], contexts[:-2] >> 7))
        some_seen, some_back = model.places(spread >> 16 - SEEN_BITS), model.places(spread >> 16 - BACK_BITS)
        for t in range(len(some)):
            m = active[first + t]
            now, marked, seen, back = some_ids[t, :m], some_marked[t, :m], some_seen[t, :m], some_back[t, :m]
            model.predict(m, some_places2[t, :m], some_places1[t, :m])
            wrong2, wrong1 = model.said2 ^ now, model.said1 ^ now
            again = model.seen.take(seen) == marked
            having = (wrong2 < 4).view(np.uint8) << 3 | (wrong1 < 4).view(np.uint8) << 2
            having |= (model.back.take(back) == marked).view(np.uint8) << 1 | again.view(np.uint8)
            predictor = FIRST.take(having)
            start, width, open_ = model.parts(predictor)
            at, base = model.narrow(m, spread[t, :m].view(np.uint64) >> open_, start, width)
            here = filled.take(at)
            flat[here] = base.take(at) >> U32
            filled[at] = here + 1
            model.learn(now, marked, predictor, seen, again, back, wrong2, wrong1)
    flat[filled], flat[filled + 1] = model.low >> U32, model.low & LOW_WORD
    counts = filled + 2 - np.arange(n) * (steps + 2)
    return [words[lane, : counts[lane]] for lane in range(n)]


def decode(payloads: list[np.ndarray], lengths: np.ndarray) -> list[np.ndarray]:
    """The ids of every block from its words; ``lengths`` are the blocks' numbers of ids, longest first."""
    n, lengths = len(payloads), np.asarray(lengths, np.int64)
    steps, most = int(lengths.max(initial=0)), max((len(p) for p in payloads), default=0) + 2
    words = np.zeros((n, most), np.uint32)
    for lane, payload in enumerate(payloads):
        words[lane, : len(payload)] = payload
    flat, last_word = words.reshape(-1), np.arange(1, n + 1) * most - 1
    ids = np.zeros((steps, n), np.uint16)
    model = _Model(n)
    code, read = words[:, 0].astype(np.uint64) << U32 | words[:, 1], np.arange(n) * most + 2
    last, before_shifted = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for t, m in enumerate(_active(lengths, steps)):
        last, before_shifted = last[:m], before_shifted[:m]
        model.predict(m, model.places(_slot2(last, before_shifted)), model.places(_slot1(last)))
        value = (code[:m] - model.low[:m]) // model.unit
        # All comparisons with the running sums at once: a guard bit stays where the value reaches the sum.
        reached = ((value >> U16) * ONES | GUARDS) - (model.sums & INNER) >> U_GUARD & LOWEST
        predictor = (reached * LOWEST >> U_LAST & U3).view(np.int64)
        start, width, _ = model.parts(predictor)
        # Both are below 2**26, so the quotient of doubles has the right whole part.
        place = ((value - start).astype(np.float64) / width).astype(np.int64)
        now = np.where(predictor == 0, model.said2, model.said1) >> 2
        for kind, table, bits in ((2, model.back, BACK_BITS), (3, model.seen, SEEN_BITS)):
            told = (predictor == kind).nonzero()[0]
            # Damaged words may point anywhere; their checksum will tell.
            slot = place.take(told) & (1 << bits) - 1
            now[told] = table.take(slot * n + told).astype(np.int32) - 1
        told = (predictor == 4).nonzero()[0]
        now[told] = place.take(told) * GATHER & 0xFFFF
        at, base = model.narrow(m, place.view(np.uint64), start, width)
        here = read.take(at)
        code[at] = code.take(at) << U32 | flat.take(here)
        read[at] = np.minimum(here + 1, last_word.take(at))
        ids[t, :m] = now
        row = ids[t, :m]
        marked, spread = row + np.uint16(1), (row * np.uint16(SPREAD)).astype(np.int64)
        now = row.astype(np.int32) << 2
        seen, back = model.places(spread >> 16 - SEEN_BITS), model.places(spread >> 16 - BACK_BITS)
        again = model.seen.take(seen) == marked
        model.learn(now, marked, predictor, seen, again, back, model.said2 ^ now, model.said1 ^ now)
        before_shifted, last = last >> 7, spread * CONTEXT_SPREAD
    return [ids[: lengths[lane], lane] for lane in range(n)]
