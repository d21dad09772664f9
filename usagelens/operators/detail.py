"""Ranked query lists, whole, cut at a limit, or page by page."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of a list asked for by pages, the column that says where the next page begins.
CURSOR = "cursor"


@dataclass(frozen=True)
class Page:
    """``size`` rows of a list after the row whose ``cursor`` is ``after``; the first ones without it.

    A cursor holds the row's ordering figures and its query id.  It names a place in the order, not a
    number of rows, so it stays good when rows come in or go, also the row it was taken from.
    """

    size: int
    after: str | None = None

    def __post_init__(self) -> None:
        if self.size < 1:
            raise ValueError("a page holds at least one row")


@dataclass(frozen=True)
class RawBound:
    """A stored column that the first ordering figure is made of, and its largest value for a figure."""

    column: str
    largest: Callable[[int], int] = lambda figure: figure


def next_page(listed: DataFrame, page: Page) -> Page | None:
    """The page after ``listed``, which was made for ``page``; None after the last one.

    Only cursors come to the driver, at most one per row of the page.
    """
    cursors = [row[CURSOR] for row in listed.select(CURSOR).collect()]
    return Page(page.size, cursors[-1]) if len(cursors) == page.size else None


def _after(order: Sequence[str], cursor: str, raw: RawBound | None) -> Column:
    """Rows behind the cursor: a range of the first figure, and of its ties those that come later."""
    *figures, query_id = json.loads(cursor)
    if len(figures) != len(order):
        raise ValueError(f"the cursor {cursor} belongs to another list")
    # Ids that are NULL come first.
    behind = F.col("query_id").isNotNull() if query_id is None else F.col("query_id") > F.lit(query_id)
    for key, figure in reversed(list(zip(order, figures))):
        value = F.expr(key)
        behind = (value < F.lit(figure)) | ((value == F.lit(figure)) & behind)
    return behind if raw is None else (F.col(raw.column) <= F.lit(raw.largest(figures[0]))) & behind


def ranked(
    rows: DataFrame,
    columns: Sequence[str],
    order: Sequence[str],
    limit: int | None = None,
    page: Page | None = None,
    raw: RawBound | None = None,
) -> DataFrame:
    """Sort descending by ``order``, ties by ``query_id``, and project ``columns`` (all SQL expressions).

    The unique last key also keeps the sort balanced: a range partitioner can split a run of equal
    figures, so one value held by a third of all rows does not land in one task.  Figures and texts
    are made after the sort, so that neither the sampling of the sort nor its shuffle carries them.
    Lists are complete unless the caller asks for the first ``limit`` rows, which then needs no
    global sort, or for a ``page``.  A page is a top-k of the rows behind its cursor: no page sorts the
    pages before it, and where ``raw`` names the stored column behind the first figure, the scan skips
    what lies before the cursor.  Pages carry the column ``cursor`` as well.  ``order`` holds whole numbers
    that are not NULL; of rows that agree in all figures and in the query id, a page's end may cut off some.
    """
    if page is not None and limit is not None:
        raise ValueError("ask for a limit or for a page")
    if page is not None:
        if page.after is not None:
            rows = rows.where(_after(order, page.after, raw))
        # Figures are whole numbers, so they are JSON as they are; the id needs its quotes.
        figures = ", ".join(f"CAST({key} AS STRING)" for key in order)
        quoted = "regexp_extract(to_json(array(query_id)), '(?s)^.(.*).$', 1)"
        columns, limit = (*columns, f"concat('[', concat_ws(',', {figures}, {quoted}), ']') AS {CURSOR}"), page.size
    listed = rows.orderBy(*[F.expr(key).desc() for key in order], "query_id").selectExpr(*columns)
    return listed if limit is None else listed.limit(limit)
