"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

A suffix is S if it is smaller than the one that begins behind it, else L; a
leftmost S suffix (LMS) follows an L.  The substrings between LMS places are
sorted by inducing, named, and sorted recursively as a shorter sequence; from
the sorted LMS suffixes the L suffixes are induced, and from these the S ones.

Inducing reads an array once, in order: entry j puts j - 1 at the next free
place of its symbol.  Whatever stands before the first free place is final, so
it is processed as one block; that place is filled then.  On text a pass takes
about sqrt(n) blocks, and the work is linear but for the stable grouping of
each block by symbol.  A run of r equal symbols feeds itself one place at a
time and costs r blocks, so sequences should hold no very long runs.
"""

from __future__ import annotations

import numpy as np

_LOOK = 1 << 12


def _types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is S (the empty suffix behind the end is
    smaller than all others, so the last one is L)."""
    out = np.zeros(len(s), bool)
    differs = np.flatnonzero(s[1:] != s[:-1])
    if len(differs):  # a symbol equal to the next is as the next that differs
        rises = s[differs] < s[differs + 1]
        out[:differs[-1] + 1] = np.repeat(rises, np.diff(differs, prepend=-1))
    return out


def _induce(order: np.ndarray, s: np.ndarray, target: np.ndarray, free: np.ndarray) -> None:
    """Fill the free places (-1) of ``order``: every entry j, read once and in
    order, puts j - 1, if ``target`` holds for it, at the next free place of
    its symbol."""
    n, p = len(order), 0
    while p < n:
        end = p
        while end < n:
            part = order[end:end + _LOOK] < 0
            k = int(part.argmax())
            if part[k]:
                end += k
                break
            end += len(part)
        if end == p:
            raise ValueError("a place is free that no entry before it fills")
        j = order[p:end] - 1
        j = j[j >= 0]
        j = j[target[j]]
        p = end
        if not len(j):
            continue
        c = s[j]
        group = np.argsort(c, kind="stable")
        c = c[group]
        head = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        size = np.diff(np.append(head, len(c)))
        symbol = c[head]
        order[np.arange(len(c)) + np.repeat(free[symbol] - head, size)] = j[group]
        free[symbol] += size


def _sort_from(lms: np.ndarray, s: np.ndarray, small: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes, induced from the LMS ones in the order given."""
    n = len(s)
    n_l = np.bincount(s[~small], minlength=symbols)
    n_s = np.bincount(s[small], minlength=symbols)
    seeds = lms[np.argsort(s[lms], kind="stable")]
    n_m = np.bincount(s[lms], minlength=symbols)
    # ascending: of every symbol the L suffixes, then the LMS ones
    base = np.cumsum(n_l + n_m) - n_l - n_m
    order = np.full(len(lms) + int(n_l.sum()) + 1, -1, np.int32)
    is_l = np.zeros(len(order), bool)
    order[0] = n  # the empty suffix
    place = np.arange(len(seeds)) + np.repeat(base + n_l - (np.cumsum(n_m) - n_m), n_m) + 1
    order[place] = seeds
    is_l[1:] = True
    is_l[place] = False
    _induce(order, s, ~small, base + 1)
    large = order[is_l]
    # descending: of every symbol the S suffixes, then the L ones
    both = (n_l + n_s)[::-1]
    base = (np.cumsum(both) - both)[::-1]
    order = np.full(n, -1, np.int32)
    down = large[::-1]
    n_d = n_l[::-1]
    order[np.arange(len(down)) + np.repeat((base + n_s)[::-1] - (np.cumsum(n_d) - n_d), n_d)] = down
    _induce(order, s, small, base.copy())
    return order[::-1]


def _names(lms: np.ndarray, order: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Ranks of the LMS substrings that begin at ``order`` (sorted): equal
    ones share a rank."""
    n = len(s)
    until = np.full(n, n, np.int32)
    until[lms[:-1]] = lms[1:]
    a, b = order[:-1], order[1:]
    size = until[b] - b
    same = (until[a] - a == size) & (until[a] < n) & (until[b] < n)
    at = np.flatnonzero(same)
    d = 0
    while len(at):
        equal = s[a[at] + d] == s[b[at] + d]
        same[at[~equal]] = False
        at = at[equal & (size[at] > d)]
        d += 1
    return np.concatenate(([0], np.cumsum(~same))).astype(np.int32)


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Starts of the suffixes of s (symbols from 0), in ascending order."""
    n = len(s)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    if not len(lms):
        return _sort_from(lms, s, small, symbols)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = _sort_from(lms, s, small, symbols)
    order = order[is_lms[order]]
    name = _names(lms, order, s)
    if name[-1] + 1 < len(lms):
        rank = np.zeros(n, np.int32)
        rank[order] = name
        short = rank[lms]
        if name[-1] < 1 << 16:
            short = short.astype(np.uint16)
        order = lms[suffix_array(short, int(name[-1]) + 1)]
    return _sort_from(order, s, small, symbols)


def common_prefixes(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """With every place of a byte sequence, the length that its suffix shares
    with the one before it in ``order`` (permuted: by place, not by rank).

    Where the bytes before both are equal the length is one less than at the
    place before; only the other places are compared, eight bytes a step."""
    n = len(s)
    previous = np.full(n, n, np.int64)
    previous[order[1:]] = order[:-1]
    before = np.zeros(n, bool)  # the length follows from the place before
    inner = (previous > 0) & (previous < n)
    inner[0] = False
    at = np.flatnonzero(inner)
    before[at] = s[at - 1] == s[previous[at] - 1]
    padded = np.concatenate([s, np.zeros(16, np.uint8)])
    words = np.ndarray((n + 8,), "<u8", padded.tobytes(), strides=(1,))
    i = np.flatnonzero(~before & (previous < n))
    j = previous[i]
    shared = np.zeros(n, np.int64)
    room = n - np.maximum(i, j)
    live, d = np.arange(len(i)), 0
    length = np.zeros(len(i), np.int64)
    while len(live):
        differ = words[i[live] + d] ^ words[j[live] + d]
        full = differ == 0
        done = live[~full]
        low = differ[~full]
        low &= ~low + np.uint64(1)  # lowest bit that differs
        length[done] = d + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        live = live[full]
        d += 8
        ended = room[live] <= d
        length[live[ended]] = room[live[ended]]
        live = live[~ended]
    shared[i] = np.minimum(length, room)
    place = np.arange(n)
    origin = np.maximum.accumulate(np.where(before, 0, place))
    return np.maximum(shared[origin] - (place - origin), 0)
