"""Suffix arrays by induced sorting, and the common prefixes of neighbours in them.

Suffixes are classified as smaller (S) or larger (L) than the next one. The leftmost S suffixes
(an S after an L) are put in order by sorting the substrings between them, recursively where equal
substrings leave the order open; all others follow from them in two linear scans over the buckets
of first symbols. With few symbols (texts) a scan handles a bucket as a whole, and what a bucket puts
into itself at once; with many (the names of substrings, further down) it handles all buckets
together, by the place of the suffix that each one is induced from.
"""

from __future__ import annotations

import numpy as np

from airlock.llm.flat import prefix, ranges, span_hash

#: Up to so many different symbols, scans go bucket by bucket. Both ways give the same order.
BUCKET_SYMBOLS = 1024


def _is_smaller(t: np.ndarray) -> np.ndarray:
    """S suffixes of t, whose last symbol is its unique least."""
    turn = np.sign(np.diff(t.astype(np.int64)))
    at = np.where(turn != 0, np.arange(turn.size), turn.size)
    following = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(turn[np.minimum(following, turn.size - 1)] > 0, True) if turn.size else np.ones(1, bool)


def _put(into: np.ndarray, items: np.ndarray, symbols: np.ndarray, pointer: np.ndarray, step: int) -> None:
    """Places items at their symbols' pointers, in their order, forward (step 1) or backward (-1)."""
    if not items.size:
        return
    by = np.argsort(symbols, kind="stable")
    s = symbols[by]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    count = np.diff(np.append(first, s.size))
    rank = np.arange(s.size) - np.repeat(first, count)
    into[np.repeat(pointer[s[first]], count) + step * rank] = items[by]
    pointer[s[first]] += step * count


def _with_own(items: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Suffixes of a bucket with those that they put into the bucket themselves: the ones one, two,
    ... places before, as far as the symbol stays the same; nearer ones first."""
    more = same[items]
    if not more.any():
        return items
    back = ranges(np.zeros(items.size, np.int64), more + 1)
    by = np.argsort(back, kind="stable")
    return (np.repeat(items, more + 1) - back)[by]


def _induce_buckets(t: np.ndarray, leftmost: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    sa = np.zeros(t.size, np.int32)
    # How many places before each one hold the same symbol as it.
    change = np.where(np.concatenate([[True], t[1:] != t[:-1]]), np.arange(t.size), 0)
    same = np.arange(t.size) - np.maximum.accumulate(change)
    of = t[leftmost]
    by = np.argsort(of, kind="stable")
    seeds, edges = leftmost[by], np.searchsorted(of[by], np.arange(heads.size + 1))
    present = np.flatnonzero(tails > heads).tolist()
    front = heads.copy()
    for c in present:
        items = _with_own(sa[heads[c] : front[c]], same)
        front[c] = heads[c] + items.size
        sa[heads[c] : front[c]] = items
        before = np.concatenate([items[items > 0], seeds[edges[c] : edges[c + 1]]]) - 1
        before = before[t[before] > c]
        _put(sa, before, t[before], front, 1)
    back = tails - 1
    for c in reversed(present):
        items = _with_own(sa[back[c] + 1 : tails[c]][::-1], same)
        back[c] = tails[c] - items.size - 1
        sa[back[c] + 1 : tails[c]] = items[::-1]
        before = np.concatenate([items, sa[heads[c] : front[c]][::-1]])
        before = before[before > 0] - 1
        before = before[t[before] < c]
        _put(sa, before, t[before], back, -1)
    sa[0] = t.size - 1
    return sa


def _chained(codes: np.ndarray, mine: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places `mine` in the order of codes[i], codes[i + 1], ... as far as the next of `ends`, whose
    codes occur only once. Only places that are still tied are looked at again, each time with the
    ranks of those twice as far on."""
    every = np.concatenate([mine, ends])
    every = every[np.argsort(codes[every], kind="stable")]
    new = np.concatenate([[True], codes[every][1:] != codes[every][:-1]])
    rank = np.zeros(codes.size, np.int64)
    rank[every] = np.maximum.accumulate(np.where(new, np.arange(every.size), 0))
    alone = new & np.append(new[1:], True)
    tied, far = every[~alone], 1
    while tied.size:
        by = np.argsort(rank[tied] * every.size + rank[tied + far], kind="stable")
        tied = tied[by]
        old, next_rank, at = rank[tied], rank[tied + far], np.arange(tied.size)
        group = np.concatenate([[True], old[1:] != old[:-1]])
        new = group | np.concatenate([[True], next_rank[1:] != next_rank[:-1]])
        rank[tied] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        tied, far = tied[~(new & np.append(new[1:], True))], far * 2
    return mine[np.argsort(rank[mine], kind="stable")]


def _induce_names(t: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """L suffixes follow from the leftmost S suffixes, and S suffixes from all L suffixes, by their own
    symbol and the place of the suffix after them; in a bucket L stands before S."""
    sa = np.zeros(t.size, np.int32)
    codes = t.astype(np.int64) * (t.size + 1)
    of_ends = codes.copy()
    of_ends[leftmost] += np.arange(leftmost.size) + 1
    larger = _chained(of_ends, np.flatnonzero(~smaller), leftmost)
    of_ends = codes + t.size
    of_ends[larger] = codes[larger] + np.arange(larger.size)
    small = _chained(of_ends, np.flatnonzero(smaller), larger)
    for items, edge in ((larger, heads), (small, tails - np.bincount(t[small], minlength=heads.size))):
        symbols = t[items]
        first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]])) if items.size else items
        sa[edge[symbols] + np.arange(items.size) - np.repeat(first, np.diff(np.append(first, items.size)))] = items
    return sa


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffixes of t in order. t ends with 0, and holds no other 0."""
    if t.size == 1:
        return np.zeros(1, np.int32)
    t = t.astype(np.int32, copy=False)
    smaller = _is_smaller(t)
    sizes = np.bincount(t)
    tails = np.cumsum(sizes)
    heads = tails - sizes

    def induce(leftmost: np.ndarray) -> np.ndarray:
        """All suffixes in order, if `leftmost` are the leftmost S suffixes in order."""
        if sizes.size <= BUCKET_SYMBOLS:
            return _induce_buckets(t, leftmost, heads, tails)
        return _induce_names(t, smaller, leftmost, heads, tails)

    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + 1
    if leftmost.size > 1:
        order = induce(leftmost)
        is_leftmost = np.zeros(t.size, bool)
        is_leftmost[leftmost] = True
        found = order[is_leftmost[order]]
        ends = np.append(leftmost[1:], t.size - 1) + 1
        place = np.empty(t.size, np.int32)
        place[leftmost] = np.arange(leftmost.size)
        sums = prefix(t.astype(np.uint64) + np.uint64(0x7F4A))
        name = span_hash(sums, leftmost.astype(np.int64), ends)[place[found]] + (ends - leftmost)[place[found]].astype(np.uint64)
        ranks = np.concatenate([[0], np.cumsum(name[1:] != name[:-1])])
        if ranks[-1] + 1 < leftmost.size:
            reduced = np.empty(leftmost.size, np.int32)
            reduced[place[found]] = ranks
            found = leftmost[suffix_array(reduced)]
        leftmost = found
    return induce(leftmost)


def permuted_prefixes(t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each suffix, in the order of the text: how long a prefix it shares with the one before it
    in `order`, `most` at most. The first in order shares nothing. Symbols themselves are compared,
    as many at once as a word holds."""
    bits = max(1, int(t.max()).bit_length())
    at_once = 64 // bits
    shared = np.zeros(t.size, np.int64)
    before = np.full(t.size, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([t, np.zeros(at_once, t.dtype)]).astype(np.uint64)
    words = np.zeros(t.size, np.uint64)
    for k in range(at_once):
        words = words << np.uint64(bits) | padded[k : k + t.size]
    here = np.flatnonzero(before >= 0)
    there = before[here]
    for values, step in ((words, at_once), (t, 1)):
        a, b, done = here, there, shared[here]
        while a.size and done.min() + step <= most:
            equal = (np.maximum(a, b) + done + step <= t.size) & (done + step <= most)
            equal[equal] = values[(a + done)[equal]] == values[(b + done)[equal]]
            a, b, done = a[equal], b[equal], done[equal] + step
            shared[a] = done
    return shared
