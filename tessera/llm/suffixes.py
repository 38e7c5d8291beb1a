"""Two-stage suffix sorting in numpy, for many short texts at once."""

from __future__ import annotations

import numpy as np

#: Symbols in a key: 9 bits each.
_STEP = 7


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, first place of each text): bytes plus 1, and 0 after each text."""
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=first[1:])
    symbols = raw.astype(np.int16) + 1
    symbols[first[1:] - 1] = 0
    return symbols, first


def _keys(symbols: np.ndarray) -> np.ndarray:
    """The next _STEP symbols at each place as one number."""
    n = len(symbols)
    wide = np.zeros(n + _STEP, np.uint64)
    wide[:n] = symbols.astype(np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(_STEP):
        out = (out << np.uint64(9)) | wide[j : j + n]
    return out


def _smaller_than_next(symbols: np.ndarray) -> np.ndarray:
    """Suffixes smaller than their successors: at equal symbols, as the successor. The last counts as smaller."""
    n = len(symbols)
    turn = np.ones(n, bool)
    turn[:-1] = symbols[:-1] != symbols[1:]
    at = np.where(turn, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where the symbols differ
    out = np.ones(n, bool)
    inner = at < n - 1
    out[inner] = symbols[at[inner]] < symbols[at[inner] + 1]
    return out


def _sorted_directly(places: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first `depth` symbols at least; equal ones by place."""
    order = places[np.argsort(keys[places], kind="stable")]
    k = keys[order]
    at = np.arange(len(order))  # rows that still tie with a neighbour
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    group = np.cumsum(~same[:-1])
    for done in range(_STEP, depth, _STEP):
        tied = same[:-1] | same[1:]
        if not tied.any():
            break
        at, group = at[tied], group[tied]
        rows = order[at]
        # A suffix that has met a separator has nothing more to compare.
        k = keys[np.minimum(rows + done, len(keys) - 1)]
        # Most groups agree in the next symbols too; only those that do not are sorted.
        apart = group[1:][(k[1:] != k[:-1]) & (group[1:] == group[:-1])]
        if len(apart):
            mixed = np.zeros(int(group[-1]) + 1, bool)
            mixed[apart] = True
            some = np.flatnonzero(mixed[group])
            new = some[np.lexsort((k[some], group[some]))]
            rows[some], k[some] = rows[new], k[new]
            order[at[some]] = rows[some]
        same = np.zeros(len(at) + 1, bool)
        same[1:-1] = (k[1:] == k[:-1]) & (group[1:] == group[:-1])
        group = np.cumsum(~same[:-1])
    return order


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes by their first `depth` symbols at least.

    Suffixes smaller than their successors are sorted directly. One scan over the buckets of first symbols, in
    ascending order, induces the others: a suffix that is larger than its successor goes behind those of its bucket
    that have come before, when the scan meets its successor. A bucket is scanned as a whole; runs of one symbol
    need a step for each place in the run.
    """
    small = _smaller_than_next(symbols)
    direct = _sorted_directly(np.flatnonzero(small), _keys(symbols), depth)
    edges = np.searchsorted(symbols[direct], np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    for c in range(257):
        induced = waiting[c]
        front = np.concatenate(induced) if induced else direct[:0]
        parts = [front]
        while len(front):
            before = front[front > 0] - 1
            front = before[(symbols[before] == c) & ~small[before]]
            parts.append(front)
        bucket = np.concatenate([*parts, direct[edges[c] : edges[c + 1]]])
        waiting[c] = []
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~small[before] & (symbols[before] > c)]
        if len(before):
            first = symbols[before]
            by = np.argsort(first, kind="stable")
            first, before = first[by], before[by]
            cuts = np.flatnonzero(np.diff(first)) + 1
            for piece, name in zip(np.split(before, cuts), first[np.append(0, cuts)].tolist()):
                waiting[name].append(piece)
    return np.concatenate(out) if out else direct


def neighbours_share(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix has a common prefix of `length` with the next in order; none may hold a separator."""
    keys = _keys(symbols)
    rows = np.arange(len(order) - 1)
    for done in [*range(0, length - _STEP, _STEP), length - _STEP]:
        a, b = order[rows] + done, order[rows + 1] + done
        ok = (a < len(keys)) & (b < len(keys))
        rows, a, b = rows[ok], a[ok], b[ok]
        rows = rows[keys[a] == keys[b]]
        if not len(rows):
            break
    out = np.zeros(len(order), bool)
    out[rows] = True
    return out


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, whether the string of `length` at each of its starts also starts elsewhere in the texts."""
    symbols, first = joined(texts)
    order = suffix_order(symbols, length)
    left = np.repeat(first[1:] - 1, np.diff(first)) - np.arange(len(symbols))  # symbols before the separator
    shared = neighbours_share(symbols, order, length)
    whole = left[order] >= length
    shared[:-1] &= whole[:-1] & whole[1:]
    shared[-1:] = False
    found = np.zeros(len(symbols), bool)
    found[order[shared]] = True
    found[order[1:][shared[:-1]]] = True
    return [found[a : max(a, b - length)] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
