"""Tiles of all pairs of two blocks of texts at once.

Equal windows of the blocks meet once, by hash and then by their tokens. Of a common run of two texts only its first and
its last window are made, so long shared passages cost no more than short ones, and windows that all go on alike are left
out before any pair of them is made. Pairs whose runs do not overlap have them as tiles; the others go through the greedy
choice one by one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from affinis.operators.tiling import Tile

#: First and last windows of runs that are made at once; runs of a pair up to which tiles are held against each other.
_AT_ONCE, _FEW = 1_000_000, 16
_WEIGHT = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Tiles:
    """Tiles of pairs, pair after pair (of a pair in the order of their choice): places of the texts, starts, length."""

    x: np.ndarray
    y: np.ndarray
    i: np.ndarray
    j: np.ndarray
    n: np.ndarray


def _equal_windows(t: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """A number for each window at ``at``, the same for the same tokens."""
    h = np.zeros(len(at), np.uint64)
    for k, w in enumerate(np.arange(1, least + 1, dtype=np.uint64) * _WEIGHT | np.uint64(1)):
        h += t[at + k].astype(np.uint64) * w
    order = np.argsort(h, kind="stable")
    new = np.diff(h[order], prepend=h[order[:1]] + np.uint64(1)) != 0 if len(at) else np.zeros(0, bool)
    which = np.cumsum(new) - 1
    first, here, differs = at[order[np.flatnonzero(new)[which]]], at[order], np.zeros(len(at), bool)
    for k in range(least):
        differs |= t[here + k] != t[first + k]
    if differs.any():  # one hash of different windows
        mixed = np.isin(which, which[differs])
        windows = np.stack([t[here[mixed] + k] for k in range(least)], axis=1)
        which[mixed] = len(at) + np.unique(windows, axis=0, return_inverse=True)[1].reshape(-1)
        which = np.unique(which, return_inverse=True)[1].reshape(-1)
    out = np.empty(len(at), np.int64)
    out[order] = which
    return out


def runs(x: list[np.ndarray], y: list[np.ndarray] | None, least: int) -> Iterator[Tiles]:
    """Every maximal common run of ``least`` tokens and more of a text of x and one of y, by pair; without y, of two texts
    of x, the earlier one first. Tokens below 0 match nothing."""
    every = [np.asarray(a, np.int64) for a in [*x, *(y or [])]]
    lengths = np.array([len(a) for a in every], np.int64)
    starts = 1 + np.cumsum(lengths + 1) - lengths - 1
    t = np.full(1 + int((lengths + 1).sum()), -1, np.int64)
    own = np.repeat(np.arange(len(every)), lengths)
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    t[starts[own] + place] = np.concatenate(every) if every else t[:0]
    holes = np.concatenate([[0], np.cumsum(t < 0)])
    usable = holes[starts[own] + np.minimum(place + least, len(t) - starts[own])] == holes[starts[own] + place]
    usable &= place + least <= lengths[own]
    own, place = own[usable], place[usable]
    at = starts[own] + place
    which = _equal_windows(t, at, least)
    groups = int(which.max()) + 1 if len(which) else 0
    side = own >= len(x) if y is not None else np.zeros(len(own), bool)
    if y is None:
        met = np.bincount(which, minlength=groups) > 1
    else:
        met = (np.bincount(which[side], minlength=groups) > 0) & (np.bincount(which[~side], minlength=groups) > 0)
    parts = []
    for near in (t[at - 1], t[at + least]):
        low, high = np.full(groups, np.iinfo(np.int64).max), np.full(groups, np.iinfo(np.int64).min)
        np.minimum.at(low, which, near)
        np.maximum.at(high, which, near)
        keep = (met & ((low != high) | (low < 0)))[which]
        mine = np.flatnonzero(keep & ~side)
        theirs = mine if y is None else np.flatnonzero(keep & side)
        mine = mine[np.argsort(own[mine], kind="stable")]
        key = which[theirs] * len(every) + own[theirs]
        order = np.argsort(key, kind="stable")
        theirs, key = theirs[order], key[order]
        begin = np.searchsorted(key, which[mine] * len(every) + (own[mine] + 1 if y is None else 0))
        parts.append((near, mine, theirs, begin, np.searchsorted(key, (which[mine] + 1) * len(every)) - begin))
    work = sum(np.bincount(own[mine], weights=count, minlength=len(x)) for _, mine, _, _, count in parts)
    done = np.concatenate([[0], np.cumsum(work)])
    base = 0 if y is None else len(x)
    others = len(every) - base
    bits = int(lengths.max(initial=1)).bit_length()
    most = max(1, (1 << max(0, 62 - 2 * bits - 1)) // max(1, others))
    s = 0
    while s < len(x):
        e = min(max(s + 1, int(np.searchsorted(done, done[s] + _AT_ONCE, "right")) - 1), s + most, len(x))
        if done[e] > done[s]:
            keys = []
            for near, mine, theirs, begin, count in parts:
                cut = slice(*np.searchsorted(own[mine], [s, e]))
                n = count[cut]
                a = np.repeat(mine[cut], n)
                b = theirs[np.arange(int(n.sum())) + np.repeat(begin[cut] - np.cumsum(n) + n, n)]
                ends = (near[a] != near[b]) | (near[a] < 0)
                a, b = a[ends], b[ends]
                key = ((own[a] - s) * others + own[b] - base) << (2 * bits + 1) | (place[a] - place[b] + (1 << bits)) << bits | place[a]
                key.sort()
                keys.append(key)
            first, last = keys  # of a pair and a diagonal they take turns
            pair, i = first >> (2 * bits + 1), first & ((1 << bits) - 1)
            j = i - ((first >> bits & ((2 << bits) - 1)) - (1 << bits))
            yield Tiles(s + pair // others, pair % others, i, j, last - first + least)
        s = e


def _greedy(found: list[tuple[int, int, int]], least: int) -> list[Tile]:
    """Of runs (-length, start, start), the longest first; what is left free of one that lost tokens falls in later."""
    few = len(found) <= _FEW
    heapq.heapify(found)
    out: list[Tile] = []
    while few and found:
        n, i, j = heapq.heappop(found)
        parts = [(0, -n)]
        for at_a, at_b, k, _ in out:
            for low in (at_a - i, at_b - j):
                if low < -n and low + k > 0:
                    parts = [p for s, e in parts for p in ((s, min(e, low)), (max(s, low + k), e)) if p[0] < p[1]]
        if parts == [(0, -n)]:
            out.append((i, j, -n, -n))
            continue
        for s, e in parts:
            if e - s >= least:
                heapq.heappush(found, (s - e, i + s, j + s))
    if few:
        return out
    size = max(max(i, j) - n for n, i, j in found)
    free_a, free_b = np.ones(size, bool), np.ones(size, bool)
    while found:
        n, i, j = heapq.heappop(found)
        free = free_a[i : i - n] & free_b[j : j - n]
        if free.all():
            out.append((i, j, -n, -n))
            free_a[i : i - n] = free_b[j : j - n] = False
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - s >= least:
                heapq.heappush(found, (s - e, i + s, j + s))
    return out


def tiled(x: list[np.ndarray], y: list[np.ndarray] | None, least: int, swapped) -> Iterator[Tiles]:
    """Greedy tiles of at least ``least`` tokens of all pairs, as compare.tiles has them for one pair; swapped(x, y) tells
    of which pairs the text of y is the first (then i is its start, and j that of the text of x)."""
    others = len(x if y is None else y)
    for r in runs(x, y, least):
        swap = swapped(r.x, r.y)
        pair, i, j, n = r.x * others + r.y, np.where(swap, r.j, r.i), np.where(swap, r.i, r.j), r.n
        order = np.lexsort((j, i, -n, pair))
        pair, i, j, n = pair[order], i[order], j[order], n[order]
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pair))))
        bad, several = np.zeros(len(first), bool), np.flatnonzero((np.diff(np.append(first, len(pair))) > 1)[row])
        for start in (i, j):
            by = several[np.lexsort((start[several], row[several]))]
            over = (row[by[1:]] == row[by[:-1]]) & (start[by[:-1]] + n[by[:-1]] > start[by[1:]])
            bad[row[by[1:][over]]] = True
        if bad.any():
            good = ~bad[row]
            last = np.append(first[1:], len(pair))
            chosen = [(pair[first[k]], _greedy(list(zip((-n[first[k] : last[k]]).tolist(), i[first[k] : last[k]].tolist(), j[first[k] : last[k]].tolist(), strict=True)), least)) for k in np.flatnonzero(bad)]
            more = np.array([t for _, c in chosen for t in c], np.int64).reshape(-1, 4)
            pair = np.concatenate([pair[good], np.repeat([p for p, _ in chosen], [len(c) for _, c in chosen])])
            i, j, n = (np.concatenate([v[good], more[:, k]]) for k, v in enumerate((i, j, n)))
            order = np.argsort(pair, kind="stable")
            pair, i, j, n = pair[order], i[order], j[order], n[order]
        yield Tiles(pair // others, pair % others, i, j, n)
