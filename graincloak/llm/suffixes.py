"""Suffix order of a bounded block of symbols by prefix doubling, in numpy, for use inside Spark tasks."""

from collections.abc import Iterator

import numpy as np


def sorted_by(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The order that sorts by (high, low), both non-negative and below 2**31; equal pairs stay in place order."""
    n, top = max(len(high), 1), int(max(high.max(initial=0), low.max(initial=0))) + 1
    a, b = n.bit_length(), top.bit_length()
    if a + 2 * b <= 63:
        packed = (high.astype(np.int64) << (a + b)) | (low.astype(np.int64) << a) | np.arange(len(high))
        packed.sort()
        return packed & ((1 << a) - 1)
    return np.argsort((high.astype(np.int64) << 31) | low.astype(np.int64), kind="stable")


def first_ranks(symbols: np.ndarray) -> np.ndarray:
    """The rank of each symbol: the number of smaller ones."""
    order = np.argsort(symbols, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = symbols[order[1:]] != symbols[order[:-1]]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return ranks


def deeper(ranks: np.ndarray, step: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the ranks at some depth, those at that depth plus ``step`` (``step`` at most the depth). A rank is a place in
    suffix order, shared by suffixes that are equal so far; ``live`` are those that share one, before and after."""
    if not len(live):
        return ranks, live
    next_at = live + step
    low = np.zeros(len(live), np.int64)
    inside = next_at < len(ranks)
    low[inside] = ranks[next_at[inside]] + 1
    order = sorted_by(ranks[live], low)
    live, high, low = live[order], ranks[live][order], low[order]
    place = np.arange(len(live))
    other = np.ones(len(live), bool)
    other[1:] = high[1:] != high[:-1]
    new = other.copy()
    new[1:] |= low[1:] != low[:-1]
    begins = np.maximum.accumulate(np.where(new, place, 0))
    out = ranks.copy()
    out[live] = high + begins - np.maximum.accumulate(np.where(other, place, 0))
    single = new.copy()
    single[:-1] &= new[1:]
    return out, live[~single]


def shared(ranks: np.ndarray) -> np.ndarray:
    """Places whose rank stands elsewhere too."""
    return np.flatnonzero(np.bincount(ranks, minlength=len(ranks))[ranks] > 1)


def levels(ranks: np.ndarray, most: int | None = None) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """Ranks at depths 1, 2, 4, ... until all differ or the depth reaches ``most``; the places that still share a rank."""
    out, depth, live = [(1, ranks)], 1, shared(ranks)
    while len(live) and (most is None or 2 * depth <= most):
        ranks, live = deeper(ranks, depth, live)
        depth *= 2
        out.append((depth, ranks))
    return out, live


def deepening(ranks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """As ``levels``, one at a time: the caller holds those that it needs."""
    depth, live = 1, shared(ranks)
    yield depth, ranks
    while len(live):
        ranks, live = deeper(ranks, depth, live)
        depth *= 2
        yield depth, ranks


def common(found: list[tuple[int, np.ndarray]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common prefixes of suffixes ``i`` and ``j``, up to twice the deepest level."""
    n, length = len(found[0][1]), np.zeros(len(i), np.int64)
    for depth, ranks in reversed(found):
        a, b = i + length, j + length
        ok = np.flatnonzero((np.maximum(a, b) < n))
        same = ok[ranks[a[ok]] == ranks[b[ok]]]
        length[same] += depth
    return length


def toward_start(sa: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each suffix of ``sa`` (positions, in suffix order; ``lcp`` with the one before, 0 where a class of suffixes that
    have something in common begins), its common prefix with the nearest one before that has a smaller position, or 0."""
    n, at = len(sa), np.arange(len(sa))
    begin = np.maximum.accumulate(np.where(lcp == 0, at, 0))
    sizes = np.diff(np.append(np.flatnonzero(lcp == 0), n))
    least, low = [sa], [lcp]  # over 1, 2, 4, ... entries that end at each place
    while 2 << len(least) <= 2 * int(sizes.max(initial=1)):
        step = 1 << (len(least) - 1)
        for table in (least, low):
            longer = table[-1].copy()
            longer[step:] = np.minimum(longer[step:], table[-1][:-step])
            table.append(longer)
    reach, shortest = at.copy(), np.full(n, np.iinfo(lcp.dtype).max, lcp.dtype)
    for k in reversed(range(len(least))):
        far = reach - (1 << k)
        go = np.flatnonzero(far >= begin)
        go = go[least[k][reach[go] - 1] > sa[go]]
        shortest[go] = np.minimum(shortest[go], low[k][reach[go]])
        reach[go] = far[go]
    return np.where(reach > begin, np.minimum(shortest, lcp[reach]), 0)


def previous_factors(sa: np.ndarray, lcp: np.ndarray, chunk: int = 1 << 18) -> np.ndarray:
    """The longest previous factor of each suffix of ``sa``: its longest match with a suffix at a smaller position, which is
    with the nearest one that has a smaller position before or after it in suffix order. Classes (``lcp`` 0 at their first
    suffix) are worked on some at a time, so that the tables stay small."""
    sa, lcp = sa.astype(np.int32), lcp.astype(np.int32)
    out, begins = np.zeros(len(sa), np.int32), np.flatnonzero(lcp == 0)
    at = 0
    while at < len(sa):
        far = int(np.searchsorted(begins, at + chunk, side="right"))
        to = int(begins[far - 1]) if far < len(begins) and begins[far - 1] > at else int(begins[far]) if far < len(begins) else len(sa)
        part, near = sa[at:to], lcp[at:to]
        back = np.append(near[1:], 0)[::-1]
        out[at:to] = np.maximum(toward_start(part, near), toward_start(part[::-1], np.append(0, back[1:]))[::-1])
        at = to
    return out
