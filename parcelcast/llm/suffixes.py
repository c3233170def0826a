"""Suffix arrays by induced sorting, and permuted common prefixes.

What a text reduces to has many symbols, most of them once or twice: there suffixes are sorted by doubling, in which only
those take part that are still equal.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced bucket by bucket with array operations.
SMALL_ALPHABET = 512
#: Bits of a symbol, and symbols that are compared at once, in one 64-bit number.
SYMBOL_BITS = 9
PACKED = 7


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last symbol is the unique smallest."""
    n = len(s)
    edges = np.append(np.flatnonzero(s[1:] != s[:-1]), n - 1)  # ends of runs of equal symbols
    rising = np.ones(len(edges), bool)
    rising[:-1] = s[edges[:-1]] < s[edges[:-1] + 1]
    return np.repeat(rising, np.diff(edges, prepend=-1))


def _induce(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, heads: np.ndarray) -> np.ndarray:
    k = len(heads) - 1
    sa = np.full(len(s), -1, np.int64)
    first = np.searchsorted(s[seeds], np.arange(k + 1, dtype=s.dtype))

    def place(items: np.ndarray, at: np.ndarray, forward: bool) -> None:
        if not len(items):
            return
        keys = s[items]
        order = np.argsort(keys, kind="stable")
        keys, items = keys[order], items[order]
        cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        n = np.diff(cuts, append=len(keys))
        used = keys[cuts]
        if forward:
            sa[np.arange(len(keys)) + np.repeat(at[used] - cuts, n)] = items
            at[used] += n
        else:
            sa[np.repeat(at[used] + cuts, n) - np.arange(len(keys))] = items
            at[used] -= n

    head = heads[:-1].copy()
    for c in range(k):  # larger-type suffixes, from their successors on the left
        done = heads[c]
        while True:
            stop = head[c]
            part = sa[done:stop]
            if done == stop:
                break
            done = stop
            before = part[part > 0] - 1
            before = before[~small[before]]
            place(before[s[before] >= c], head, True)
        part = seeds[first[c]:first[c + 1]]
        before = part[part > 0] - 1
        before = before[~small[before]]
        place(before, head, True)
    tail = heads[1:] - 1
    for c in range(k - 1, -1, -1):  # smaller-type suffixes, from the right
        done = heads[c + 1] - 1
        while True:
            stop = tail[c]
            if done == stop:
                break
            part = sa[stop + 1:done + 1][::-1]
            done = stop
            before = part[part > 0] - 1
            place(before[small[before]], tail, False)
        part = sa[heads[c]:head[c]][::-1]
        before = part[part > 0] - 1
        place(before[small[before]], tail, False)
    return sa


def _doubled(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``s`` in order, by ranks of 1, 2, 4, ... symbols; the last symbol is the only smallest."""
    order = np.argsort(s, kind="stable")
    head = np.concatenate(([True], s[order[1:]] != s[order[:-1]]))
    rank = np.empty(len(s), np.int64)
    at = np.flatnonzero(head)      # a suffix's rank is the place of the first one that equals it so far
    rank[order] = np.repeat(at, np.diff(at, append=len(s)))
    size = np.diff(at, append=len(s))
    open_ = np.flatnonzero(np.repeat(size > 1, size))      # places whose suffixes are not told apart
    step = 1
    while len(open_):
        own = order[open_]
        group, next_ = rank[own], rank[own + step]      # (equal ones are longer than ``step``)
        by = np.argsort(group * len(s) + next_)
        own, group, next_ = own[by], group[by], next_[by]
        order[open_] = own
        head = np.concatenate(([True], (group[1:] != group[:-1]) | (next_[1:] != next_[:-1])))
        at = np.flatnonzero(head)
        size = np.diff(at, append=len(own))
        rank[own] = np.repeat(open_[at], size)
        open_ = open_[np.repeat(size > 1, size)]
        step *= 2
    return order


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """Starts of the suffixes of ``s`` in order; symbols are below ``k`` and the last one is 0 and the only 0."""
    n = len(s)
    if n <= 2:
        return np.arange(n - 1, -1, -1)
    if k > SMALL_ALPHABET:
        return _doubled(s)
    s = s.astype(np.uint16)      # numbers of 16 bits are sorted by counting
    small = _types(s)
    heads = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=k))))
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1

    def run(seeds: np.ndarray) -> np.ndarray:
        sa = _induce(s, small, seeds, heads)
        sa[0] = n - 1
        return sa

    sa = run(lms[np.argsort(s[lms], kind="stable")])
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    length = np.zeros(n, np.int64)
    length[lms] = np.diff(lms, append=n - 1) + 1
    a, b = ordered[:-1], ordered[1:]
    active = np.flatnonzero(length[a] == length[b])
    same = np.zeros(len(a), bool)
    step = 0
    while len(active):  # compare neighbours symbol by symbol, as long as any is undecided
        over = length[a[active]] <= step
        same[active[over]] = True
        active = active[~over]
        active = active[s[a[active] + step] == s[b[active] + step]]
        step += 1
    names = np.zeros(n, np.int64)
    names[ordered] = np.concatenate(([0], np.cumsum(~same)))
    reduced = names[lms]
    m = int(reduced.max()) + 1
    order = np.argsort(reduced) if m == len(lms) else suffix_array(reduced, m)
    return run(lms[order])


def permuted_lcp(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each position, how many symbols it shares with the suffix before it in order, ``most`` at most. Symbols are
    below 511."""
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    ahead = np.concatenate((s.astype(np.uint64) + np.uint64(1), np.zeros(PACKED, np.uint64)))
    words = np.zeros(n, np.uint64)      # the symbols from each position on, the first in the highest bits
    for k in range(PACKED):
        words = words << np.uint64(SYMBOL_BITS) | ahead[k:k + n]
    plcp = np.zeros(n, np.int64)
    active = np.flatnonzero(phi >= 0)
    other = phi[active]
    for step in range(0, most, PACKED):      # (the last symbol is alone, so equal words end before it)
        differ = words[active + step] ^ words[other + step]
        same = differ == 0
        differ = differ[~same]
        plcp[active[~same]] = step + sum((differ >> np.uint64(SYMBOL_BITS * k)) == 0 for k in range(1, PACKED))
        active, other = active[same], other[same]
    plcp[active] = most
    return np.minimum(plcp, most)
