"""Cheapest repair of a conversation's structure, by depth-first branch-and-bound.

A conversation is a text with one letter per row: the initial of its role (``s``, ``u``, ``a``, or ``o`` for any
other), in upper case if the row is truncated, or ``x`` if it has to go (blank or duplicate).  A repair is
an audit with one letter per edit, in order: ``D`` delete, ``I`` insert, ``K`` keep, ``R`` give another role.
What is kept must have the initials ``(s?(ua)+)?``, so the role that ``I`` and ``R`` give follows from what lies
before.  The best audit is the cheapest and, of these, the first in ASCII order.
"""

from __future__ import annotations

# The costs of edits.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5

#: What lies before: nothing, a system row, a user row, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: Rows searched at once.  Longer conversations are searched block by block, from every state to every state.
ROWS = 128


def _kept(row: str, state: int) -> int | None:
    """State after keeping a row, or None if its role does not fit."""
    initial = row.lower()
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    if initial == "a":
        return ASSISTANT if state == USER else None
    return None


def _given(state: int) -> int:
    """State after a row that is inserted or given the role that fits."""
    return ASSISTANT if state == USER else USER


def suffix_bounds(rows: str, end: int | None) -> tuple[list[int], list[int]]:
    """Lower bounds of what the rows from each place on cost, if a user row, or an assistant row, is due.

    The rules are relaxed: a system row may be kept wherever a user row is due.  ``end`` is the state to
    reach, None for one in which a conversation may end.
    """
    due_user = [INSERT if end == USER else 0]
    due_assistant = [0 if end == USER else INSERT]
    for row in reversed(rows):
        user, assistant = due_user[-1], due_assistant[-1]
        now_user, now_assistant = DELETE + user, DELETE + assistant
        if row != "x":
            extra = TRUNCATED if row.isupper() else 0
            initial = row.lower()
            now_user = min(now_user, extra + assistant + (0 if initial == "u" else REROLE))
            now_assistant = min(now_assistant, extra + user + (0 if initial == "a" else REROLE))
            if initial == "s":
                now_user = min(now_user, extra + user)
        due_user.append(min(now_user, INSERT + now_assistant))
        due_assistant.append(min(now_assistant, INSERT + now_user))
    return due_user[::-1], due_assistant[::-1]


def _children(rows: str, at: int, state: int, may_insert: bool) -> list[tuple[str, int, int, int]]:
    """Edits possible here, in ASCII order: letter, rows taken, state after, cost."""
    found = []
    if at < len(rows):
        found.append(("D", 1, state, DELETE))
    if may_insert:
        found.append(("I", 0, _given(state), INSERT))
    if at < len(rows) and rows[at] != "x":
        extra = TRUNCATED if rows[at].isupper() else 0
        kept = _kept(rows[at], state)
        if kept is not None:
            found.append(("K", 1, kept, extra))
        if kept != _given(state):
            found.append(("R", 1, _given(state), extra + REROLE))
    return found


def _first_limit(rows: str, state: int, end: int | None, bounds) -> int | None:
    """Cost of some repair: at every place the edit that the bounds like best.  None if it misses the end."""
    cost, at = 0, 0
    while at < len(rows):
        _, taken, state, edge = min(
            _children(rows, at, state, True), key=lambda c: (c[3] + bounds[c[2] == USER][at + c[1]], -c[1])
        )
        at += taken
        cost += edge
    if end is not None:
        return cost if state == end else None
    return cost + {START: 0, ASSISTANT: 0, USER: INSERT, SYSTEM: 2 * INSERT}[state]


def search(rows: str, begin: int = START, end: int | None = None) -> tuple[int, str] | None:
    """The best (cost, audit) from state ``begin`` to ``end``, None if there is none.

    Nodes are places with a state.  The stack yields prefixes in ASCII order, so of two prefixes to the
    same node the later one is worse unless it is cheaper: the table of the cheapest cost per node drops
    it.  A prefix is dropped too if its cost and the bound of its suffix reach the incumbent's cost, or a
    limit that is raised until there is an incumbent.  The search ends when nothing is left, which proves
    the incumbent.  With ``end`` given, nothing is inserted
    after the last row: whatever follows does that.
    """
    bounds = suffix_bounds(rows, end)
    known = _first_limit(rows, begin, end, bounds)
    # Deleting all rows and inserting what an end needs is never dearer.
    most = DELETE * len(rows) + 2 * INSERT + REROLE + TRUNCATED + 1 if known is None else known + 1
    slack = 4
    while True:
        limit = min(bounds[begin == USER][0] + slack, most)
        found = _search_below(rows, begin, end, bounds, limit)
        if found is not None or limit == most:
            return found
        slack *= 2


def _search_below(rows: str, begin: int, end: int | None, bounds, limit: int) -> tuple[int, str] | None:
    """The best repair that costs less than ``limit``, None if there is none."""
    n = len(rows)
    incumbent: tuple[int, str] | None = None
    cheapest: dict[int, int] = {}
    path: list[str] = []
    stack = [(0, "", 0, begin, 0)]
    while stack:
        depth, letter, at, state, cost = stack.pop()
        del path[depth:]
        if letter:
            path.append(letter)
        if cost + bounds[state == USER][at] >= limit or end in (START, SYSTEM) and state > end:
            continue  # nothing leads back to the start or to a system row
        node = 4 * at + state
        if cheapest.get(node, limit) <= cost:
            continue
        cheapest[node] = cost
        if at == n and (state == end if end is not None else state in (START, ASSISTANT)):
            incumbent, limit = (cost, "".join(path)), cost
            continue
        below = len(path)
        for letter, taken, after, edge in reversed(_children(rows, at, state, end is None or at < n)):
            stack.append((below, letter, at + taken, after, cost + edge))
    return incumbent


Table = dict[tuple[int, int], tuple[int, str]]


def block_table(rows: str) -> Table:
    """The best repair of a block from every state to every state that can be reached."""
    found = {(a, b): search(rows, a, b) for a in STATES for b in STATES}
    return {k: v for k, v in found.items() if v is not None}


class Stitched:
    """Best repairs of the blocks so far, from one state to each, without copying audits.

    No audit is a prefix of another one of the same rows, as each ends with an edit of the last row.  So two
    are in the order of their places at the block before, or, from the same state there, of their ends.
    """

    def __init__(self, begin: int) -> None:
        self._best: dict[int, tuple[int, int, tuple | None]] = {begin: (0, 0, None)}

    def add(self, table: Table) -> None:
        chosen = {}
        for end in STATES:
            ways = [
                (cost + table[mid, end][0], place, table[mid, end][1], chain)
                for mid, (cost, place, chain) in self._best.items()
                if (mid, end) in table
            ]
            if ways:
                chosen[end] = min(ways, key=lambda w: w[:3])
        order = sorted(chosen, key=lambda end: chosen[end][1:3])
        self._best = {
            end: (cost, order.index(end), (chain, piece)) for end, (cost, _, piece, chain) in chosen.items()
        }

    def best(self) -> dict[int, tuple[int, str]]:
        """Cost and audit by state."""
        result = {}
        for state, (cost, _, chain) in self._best.items():
            pieces = []
            while chain is not None:
                chain, piece = chain
                pieces.append(piece)
            result[state] = (cost, "".join(reversed(pieces)))
        return result


def _blocks(rows: str) -> list[str]:
    return [rows[at : at + ROWS] for at in range(0, len(rows), ROWS)]


def segment_table(rows: str) -> Table:
    """As ``block_table``, for any number of rows."""
    stitched = {state: Stitched(state) for state in STATES}
    for block in _blocks(rows):
        table = block_table(block)
        for s in stitched.values():
            s.add(table)
    return {(a, b): found for a, s in stitched.items() for b, found in s.best().items()}


def ended(best: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """The best whole repair from those of all rows by state: what is missing at the end is inserted."""
    missing = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}
    return min((cost + INSERT * missing[s], audit + "I" * missing[s]) for s, (cost, audit) in best.items())


def repair(rows: str) -> tuple[int, str]:
    """Cost and audit of the best repair of a whole conversation."""
    if len(rows) <= ROWS:
        found = search(rows)
        assert found is not None
        return found
    stitched = Stitched(START)
    for block in _blocks(rows):
        stitched.add(block_table(block))
    return ended(stitched.best())
