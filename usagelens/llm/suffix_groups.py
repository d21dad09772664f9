"""Suffix arrays by linear grouping, for many short strings at once.

The algorithm is Baier's.  Phase one groups suffixes by their Lyndon prefix: groups are taken in
descending order, every member points to the last position before it that lies in a lower group, and
positions that are pointed to leave their group for a new one right after it, those pointed to more
often further up.  Phase two runs through the array in ascending order and puts, for each suffix, the
suffixes that the pointers reach from the position before it at the next free place of their groups.
No suffix is renamed or compared.

Both phases are sequential within a string, so they advance in step over all strings of a batch: each
numpy operation does one step for every string.
"""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)


def suffix_arrays(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The suffix arrays of the strings ``symbols[offsets[b]:offsets[b + 1]]``, in the same places.

    Every string has to end in a symbol that is smaller than all its others.  Entries are positions in
    ``symbols``.
    """
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    begin, end = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    group, pointer = _group(symbols, begin, end)
    return _order(group, pointer, begin, end)


def _group(symbols: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase one: the first slot of every position's group, and its pointer (-1 if there is none)."""
    n = len(symbols)
    own = np.repeat(np.arange(len(begin)), end - begin)
    slots = np.lexsort((symbols, own))  # positions by group; a group holds consecutive slots
    place = np.empty(n, np.int64)
    place[slots] = np.arange(n)
    ordered = symbols[slots]
    first = np.ones(n, bool)
    first[1:] = (ordered[1:] != ordered[:-1]) | (own[slots][1:] != own[slots][:-1])
    heads = np.flatnonzero(first)
    size = np.zeros(n, np.int64)
    size[heads] = np.diff(np.append(heads, n))
    group = np.empty(n, np.int64)
    group[slots] = np.repeat(heads, size[heads])

    pointer = np.full(n, -1, np.int64)
    low = begin.copy()
    upto = end.copy()  # slots from here on are done
    while len(low):
        heads = group[slots[upto - 1]]
        sizes = upto - heads
        members = slots[_ranges(heads, sizes)]
        floor = np.repeat(heads, sizes)
        least = np.repeat(low, sizes)
        p = members - 1
        pointer[members] = np.where(p >= least, p, -1)
        # Past positions of this group and of higher ones, along their own pointers.
        todo = np.flatnonzero(p >= least)
        while len(todo):
            p = pointer[members[todo]]
            todo, p = todo[p >= 0], p[p >= 0]
            high = group[p] >= floor[todo]
            todo, p = todo[high], p[high]
            pointer[members[todo]] = pointer[p]
        p = pointer[members]
        p = p[p >= 0]
        if len(p):
            p.sort()
            new = np.ones(len(p), bool)
            new[1:] = p[1:] != p[:-1]
            at = np.flatnonzero(new)
            _split(p[at], np.diff(np.append(at, len(p))), group, slots, place, size)
        upto = heads
        if (left := upto > low).sum() < len(low):
            low, upto = low[left], upto[left]
    return group, pointer


def _split(chosen: np.ndarray, times: np.ndarray, group: np.ndarray, slots: np.ndarray, place: np.ndarray,
           size: np.ndarray) -> None:
    """Move the chosen positions to the ends of their groups, as new groups by ``times``, ascending."""
    order = np.lexsort((times, group[chosen]))
    chosen, times = chosen[order], times[order]
    old = group[chosen]
    new = np.ones(len(old), bool)
    new[1:] = old[1:] != old[:-1]
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(old)))
    olds = old[heads]
    tail_starts = olds + size[olds] - counts
    tail = _ranges(tail_starts, counts)
    # Others in the tail change places with chosen ones outside of it, group by group.
    outside = place[chosen] < np.repeat(tail_starts, counts)
    vacated = place[chosen[outside]]
    inside = np.zeros(len(tail), bool)
    kept = ~outside
    inside[place[chosen[kept]] - np.repeat(tail_starts, counts)[kept] + np.repeat(heads, counts)[kept]] = True
    displaced = slots[tail[~inside]]
    slots[vacated] = displaced
    place[displaced] = vacated
    slots[tail] = chosen
    place[chosen] = tail
    runs = new.copy()
    runs[1:] |= times[1:] != times[:-1]
    starts = np.flatnonzero(runs)
    lengths = np.diff(np.append(starts, len(chosen)))
    size[olds] -= counts
    size[tail[starts]] = lengths
    group[chosen] = np.repeat(tail[starts], lengths)


def _order(group: np.ndarray, pointer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Phase two: the suffix arrays."""
    n = len(group)
    result = np.full(n, -1, np.int64)
    free = np.arange(n)  # next free slot of the group that starts here
    placed = np.zeros(n, bool)
    low, stop = begin.copy(), end.copy()
    at = begin.copy()
    result[at] = stop - 1
    placed[stop - 1] = True
    free[at] += 1
    current = np.where(stop - 2 >= low, stop - 2, -1)
    while len(at):
        ready = current >= 0
        ready[ready] = ~placed[current[ready]]
        s = current[ready]
        head = group[s]
        slot = free[head]
        result[slot] = s
        free[head] = slot + 1
        placed[s] = True
        current[ready] = pointer[s]
        rest = np.flatnonzero(~ready)
        if len(rest):
            at[rest] += 1
            going = at[rest] < stop[rest]
            move = rest[going]
            s = result[at[move]] - 1
            current[move] = np.where(s >= low[move], s, -1)
            if not going.all():
                keep = at < stop
                at, stop, low, current = at[keep], stop[keep], low[keep], current[keep]
    return result
