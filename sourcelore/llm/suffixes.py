"""Suffix arrays by induced sorting, and permuted common prefixes, over numpy arrays.

Induced sorting (Nong, Zhang, Chan: "Linear suffix array construction by almost pure induced-sorting", 2009): suffixes are
classed as smaller (S) or larger (L) than the next one; the leftmost S of each run (LMS) cut the text into substrings that
are sorted and named, recursively where names repeat; the order of the LMS suffixes induces that of all. The scans
here take a bucket at a time, as far as its entries are known. Permuted common prefixes (Karkkainen, Manzini, Puglisi:
"Permuted longest-common-prefix array", 2009): only irreducible ones are compared; each other is its neighbour's less one.
"""

from __future__ import annotations

import numpy as np


def s_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. The last is larger than the empty suffix after it."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1])
    step[-1] = -1
    known = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(known[::-1])[::-1]] > 0


def _induce(t: np.ndarray, is_s: np.ndarray, ends: np.ndarray, lms: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """All suffixes in order, from LMS positions in order (of their suffixes, or of their first letters only)."""
    n = len(t)
    starts = np.concatenate(([0], ends[:-1]))
    sa = np.full(n, -1, np.int32)
    # LMS positions stand at their buckets' ends
    letter = t[lms]
    count = np.bincount(letter, minlength=len(ends))
    order = np.argsort(letter, kind="stable")
    within = np.arange(len(lms)) - np.repeat(np.cumsum(count) - count, count)
    sa[np.repeat(ends - count, count) + within] = lms[order]
    s_from = ends - count
    head = starts.copy()

    def put_large(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~is_s[before]]
        if not len(before):
            return
        letter = t[before]
        if len(before) > 1:
            order = np.argsort(letter, kind="stable")
            before, letter = before[order], letter[order]
            cut = np.flatnonzero(np.concatenate(([True], letter[1:] != letter[:-1])))
            size = np.diff(np.append(cut, len(letter)))
            which = letter[cut]
            sa[np.repeat(head[which] - cut, size) + np.arange(len(letter))] = before
            head[which] += size
        else:
            sa[head[letter[0]]] = before[0]
            head[letter[0]] += 1

    put_large(np.array([n]))  # the empty suffix is the first of all
    for c in buckets:
        at = starts[c]
        while at < head[c]:
            done, at = at, head[c]
            put_large(sa[done:at])
        if s_from[c] < ends[c]:
            put_large(sa[s_from[c] : ends[c]])
    tail = ends.copy()

    def put_small(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[is_s[before]]
        if not len(before):
            return
        letter = t[before]
        if len(before) > 1:
            order = np.argsort(letter, kind="stable")
            before, letter = before[order], letter[order]
            cut = np.flatnonzero(np.concatenate(([True], letter[1:] != letter[:-1])))
            size = np.diff(np.append(cut, len(letter)))
            which = letter[cut]
            sa[np.repeat(tail[which] - 1 + cut, size) - np.arange(len(letter))] = before
            tail[which] -= size
        else:
            tail[letter[0]] -= 1
            sa[tail[letter[0]]] = before[0]

    for c in buckets[::-1]:
        at = ends[c]
        while at > tail[c]:
            done, at = at, tail[c]
            put_small(sa[at:done][::-1])
        if starts[c] < head[c]:
            put_small(sa[starts[c] : head[c]][::-1])
    return sa


def _scalar_induce(t: list[int], is_s: list[bool], ends: list[int], lms: list[int]) -> list[int]:
    """The same, entry by entry: for many small buckets."""
    n = len(t)
    sa = [-1] * n
    tail = ends[:]
    for p in reversed(lms):
        tail[t[p]] -= 1
        sa[tail[t[p]]] = p
    head = [0, *ends[:-1]]
    if not is_s[n - 1]:
        sa[head[t[n - 1]]] = n - 1
        head[t[n - 1]] += 1
    for i in range(n):
        p = sa[i] - 1
        if p >= 0 and not is_s[p]:
            c = t[p]
            sa[head[c]] = p
            head[c] += 1
    tail = ends[:]
    for i in range(n - 1, -1, -1):
        p = sa[i] - 1
        if p >= 0 and is_s[p]:
            c = t[p]
            tail[c] -= 1
            sa[tail[c]] = p
    return sa


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``t`` (small integers from 0) in their order."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    t = t.astype(np.int32)
    is_s = s_types(t)
    ends = np.cumsum(np.bincount(t))
    buckets = np.flatnonzero(np.diff(ends, prepend=0))
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]).astype(np.int32) + 1
    if len(buckets) * 256 > n:
        lists = t.tolist(), is_s.tolist(), ends.tolist()
        induce = lambda order: np.array(_scalar_induce(*lists, order.tolist()), np.int32)
    else:
        induce = lambda order: _induce(t, is_s, ends, order, buckets)
    if len(lms) > 1:
        rank = np.zeros(n, bool)
        rank[lms] = True
        sa = induce(lms)
        order = sa[rank[sa]]  # LMS positions by their LMS substrings
        at = np.full(n, -1, np.int32)
        at[lms] = np.arange(len(lms))
        size = np.append(np.diff(lms), n)  # to the next LMS position; the last has no equal
        length = size[at[order]]
        same = length[1:] == length[:-1]
        a, b, pair, d = order[:-1][same], order[1:][same], np.flatnonzero(same), 0
        while len(a):
            more = (a + d < n) & (b + d < n)
            more[more] = t[a[more] + d] == t[b[more] + d]
            same[pair[~more]] = False
            more &= d < length[pair]
            a, b, pair, d = a[more], b[more], pair[more], d + 1
        name = np.concatenate(([0], np.cumsum(~same)))
        if name[-1] + 1 < len(lms):
            reduced = np.empty(len(lms), np.int32)
            reduced[at[order]] = name
            order = lms[suffix_array(reduced)]
        lms = order
    return induce(lms)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the length of the common prefix with the suffix before it in order, and that suffix (-1: none)."""
    n = len(t)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    i = np.arange(n)
    irreducible = (i == 0) | (before <= 0)
    inner = np.flatnonzero(~irreducible)
    irreducible[inner] = t[inner - 1] != t[before[inner] - 1]
    buffer = np.concatenate((t.astype(np.uint8), np.zeros(16, np.uint8)))
    word = np.ndarray(shape=(n + 8,), dtype="<u8", buffer=buffer, strides=(1,))
    length = np.zeros(n, np.int64)
    at = np.flatnonzero(irreducible & (before >= 0))
    a, b = at.copy(), before[at]
    while len(at):
        differ = word[a] ^ word[b]
        first = np.bitwise_count((differ & -differ) - np.uint64(1)).astype(np.int64) // 8
        step = np.where(differ == 0, 8, first)
        step = np.minimum(step, n - np.maximum(a, b))
        length[at] += step
        more = (step == 8) & (np.maximum(a, b) + 8 < n)
        at, a, b = at[more], a[more] + 8, b[more] + 8
    last = np.maximum.accumulate(np.where(irreducible, i, 0))
    return length[last] - (i - last), before
