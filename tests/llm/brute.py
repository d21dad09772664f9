"""The operators' results worked out the plain way, in memory, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def quality_measures(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {x for x, n in Counter(windows).items() if n > 1}
    covered = {j for i, x in enumerate(windows) if x in often for j in range(i, i + 3)}
    n, repeated = len(w), len(covered)
    return (
        n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated,
        n < 50 or 100 * repeated > 50 * n,
    )


def shingle_set(text, k):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(lower)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def near_groups(rows, k, percent=80):
    """rows: (id, text) with distinct ids -> id: (set size, component)."""
    sets = {i: shingle_set(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = Counter()
    for ids in holders.values():
        for n, a in enumerate(ids):
            for b in ids[:n]:
                shared[(a, b)] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def secret_spans(text):
    """Counts per base kind and the base spans as text."""
    text = text or ""
    spans = []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for rank, (kind, pattern, group, least) in enumerate(
        (("assign", f"(?ia:{assign})", 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32))
    ):
        for m in re.finditer(pattern, text):
            if len(m[group]) >= least:
                spans.append((m.start(), rank, kind, m.end()))
    spans.sort()
    counts = Counter(s[2] for s in spans)
    written = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
    return counts["assign"], counts["access"], counts["hex"], hashlib.sha256(written.encode()).hexdigest(), written


def byte_repeats(rows, length=100):
    """rows: (id, text) -> id: (bytes, removed, spans, hash of what is kept)."""
    seen, result = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        covered = bytearray(len(data))
        for s in range(len(data) - length + 1):
            x = data[s : s + length]
            if x in seen:
                covered[s : s + length] = b"\1" * length
            seen.add(x)
        kept = bytes(b for b, c in zip(data, covered) if not c)
        spans = sum(c and not (p and covered[p - 1]) for p, c in enumerate(covered))
        result[i] = (len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return result


def pieces(text, tokenizer, capacity, end_id):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
    for n, start in enumerate(range(0, len(ids), capacity)):
        part = ids[start : start + capacity]
        yield n, start, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))


def whitened(vectors, components):
    """Number of distinct vectors, deviations, whitened rows and explained shares, by the whole covariance."""
    import numpy as np

    x = np.floor(256 * np.array(vectors, np.float64)).astype(np.int64)
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = (n * distinct - sums) / n
    values, turned = np.linalg.eigh(centred.T @ centred / n)
    values, turned = values[::-1], turned[:, ::-1][:, :components]
    deviation = [sum(int(y) ** 2 for y in row) for row in n * x - sums]
    return n, deviation, ((n * x - sums) / n) @ turned / np.sqrt(values[:components]), values[:components] / values.sum()


def cheapest_repair(rows):
    """Cost, audit and the rows to write, by trying every edit of (role, text, fault) row by row."""
    following = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    best = {"": (0, "", ())}

    def offer(found, state, way):
        if state not in found or way[:2] < found[state][:2]:
            found[state] = way

    def inserted():
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                role = following[state]
                offer(best, role[0], (cost + 5, audit + "I", (*lines, (role, ""))))

    for role, text, fault in rows:
        inserted()
        after = {}
        for state, (cost, audit, lines) in best.items():
            offer(after, state, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            if (state, role[:1]) in (("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                offer(after, role[0], (cost + more, audit + "K", (*lines, (role, text))))
            given = following[state]
            offer(after, given[0], (cost + more + 1, audit + "R", (*lines, (given, text))))
        best = after
    inserted()
    return min((best[s] for s in ("", "a") if s in best), key=lambda b: b[:2])


def repaired_conversations(rows):
    """rows: (conv, turn, role, text) -> conv: result of the repair after the damage."""
    shown = lambda x: " " if x is None else str(x)
    alive = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if code == 1:
            text = ""
        elif code == 2:
            text = re.sub("[.!?]", "", text)
        elif code == 4:
            role = "user"
        alive[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(code, 1)
    result = {}
    for conv, kept in alive.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, marked = set(), []
        for turn, role, text in kept:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [r[0] for r in kept if r[0] is not None]
        cost, audit, lines = cheapest_repair(marked)
        faults = Counter(f for *_, f in marked)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        written = "\n".join(f"{r}:{t}" for r, t in lines)
        result[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"],
            faults["truncated"], illegal, cost, audit, hashlib.sha256(written.encode()).hexdigest(),
        )
    return result
