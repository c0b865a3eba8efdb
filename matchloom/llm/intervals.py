"""Repeated strings of one length, from a Burrows-Wheeler transform and breadth-first backward extension."""

from __future__ import annotations

import numpy as np

#: Rows of an interval above which its symbols are counted by search instead of being looked through.
WIDE = 256


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Places by the ``depth`` codes from there on (at least); beyond the end the sequence counts as smallest.

    Ranks by a few codes are refined by the ranks of the places one and two such widths further, of those places alone
    that still have equals."""
    n, bits = len(codes), max(1, int(codes.max(initial=0)).bit_length())
    width = 62 // bits
    padded = np.concatenate([codes.astype(np.int64), np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        key |= padded[k:k + n]
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.zeros(n + 1, np.int64)  # of a group of equals: the place of its first
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    last = np.append(new[1:], True)
    open_ = np.flatnonzero(~(new & last))
    each = 2 if n < 1 << 20 else 1  # ranks further on that fit into a key
    while width < depth and len(open_):
        at = order[open_]
        key = rank[at]
        for k in range(1, each + 1):
            key = key << (60 // (each + 1)) | rank[np.minimum(at + k * width, n)]
        by = np.argsort(key)
        key, at = key[by], at[by]
        order[open_] = at
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0)) + 1
        last = np.append(new[1:], True)
        open_ = open_[~(new & last)]
        width *= each + 1
    return order


class Transform:
    """The transform of a sequence whose last code is 0, the mark that strings do not cross."""

    def __init__(self, codes: np.ndarray, depth: int):
        self.n, self.sigma = len(codes), int(codes.max(initial=0)) + 1
        self.order = suffix_order(codes, depth)
        self.bwt = codes[self.order - 1]
        by = np.argsort(self.bwt, kind="stable")
        self.back = np.empty(self.n, np.int64)  # row of the suffix that begins one place earlier
        self.back[by] = np.arange(self.n)
        symbols = self.bwt[by].astype(np.int64)
        self.occurrences = symbols * self.n + by
        self.next = np.empty(self.n, np.int64)  # next row with the same symbol before it
        self.next[by] = np.where(np.append(symbols[1:] == symbols[:-1], False), np.append(by[1:], 0), self.n)
        ends = np.append(np.flatnonzero(self.bwt[1:] != self.bwt[:-1]) + 1, self.n)
        self.run_end = np.repeat(ends, np.diff(ends, prepend=0))

    def extended(self, low: np.ndarray, high: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of all strings one symbol longer to the left whose end is not known yet. Ends are exclusive."""
        alike = self.run_end[low] >= high
        some = alike & (self.bwt[low] != 0)
        lows, highs = [self.back[low[some]]], [self.back[low[some]] + (high - low)[some]]
        low, high = low[~alike], high[~alike]
        wide = high - low > WIDE
        if wide.any():
            symbol = np.arange(1, self.sigma, dtype=np.int64) * self.n
            a, b = (np.searchsorted(self.occurrences, (symbol + x[wide][:, None]).ravel()) for x in (low, high))
            lows.append(a[a < b])
            highs.append(b[a < b])
            low, high = low[~wide], high[~wide]
        if len(low):
            size = high - low
            of = np.repeat(np.arange(len(low)), size)
            row = np.arange(len(of)) - np.repeat(np.cumsum(size) - size - low, size)
            final = (self.next[row] >= high[of]) & (self.bwt[row] != 0)  # the last row of its symbol
            row, of = row[final], of[final]
            end = self.back[row] + 1
            fresh = ~known[end]
            row, of = row[fresh], of[fresh]
            highs.append(end[fresh])
            lows.append(np.searchsorted(self.occurrences, self.bwt[row].astype(np.int64) * self.n + low[of]))
        low, high = np.concatenate(lows), np.concatenate(highs)
        fresh = ~known[high]
        return low[fresh], high[fresh]


def repeated(codes: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` codes from each place on, none of them 0, also start elsewhere. The last code must be 0.

    All strings of no symbol, one symbol, two symbols and so on are extended to the left at once. Where the interval of
    one of them ends and no shorter one's did, neighbouring suffixes share just that many symbols less one. After
    ``length`` rounds the ends still unknown lie between suffixes that share ``length`` symbols or more. An interval
    is followed only while its end is new, so all rounds together follow no more intervals than there are places.
    """
    t = Transform(codes, length)
    known = np.zeros(t.n + 1, bool)
    known[[0, t.n]] = True
    low, high = np.zeros(1, np.int64), np.full(1, t.n)
    for _ in range(length):
        low, high = t.extended(low, high, known)
        if not len(low):
            break
        known[high] = True
    marks = np.flatnonzero(codes == 0)
    room = marks[np.searchsorted(marks, np.arange(t.n))] - np.arange(t.n) >= length
    whole = room[t.order]
    with_previous = ~known[:t.n] & whole
    with_previous[1:] &= whole[:-1]
    out = np.zeros(t.n, bool)
    out[t.order] = with_previous | np.append(with_previous[1:], False)
    return out
