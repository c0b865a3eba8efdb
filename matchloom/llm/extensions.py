"""Longest common extensions in a sequence of integers, by a difference cover."""

from __future__ import annotations

import numpy as np

#: A perfect difference set, so that any two places are at most PERIOD - 1 steps before sampled ones.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)


def _shifts() -> np.ndarray:
    """Steps from two places, by their residues, to where both are sampled."""
    member = np.zeros(PERIOD, bool)
    member[list(COVER)] = True
    at = (np.arange(PERIOD)[:, None] + np.arange(PERIOD)) % PERIOD  # residue, step
    return np.argmax(member[at][:, None, :] & member[at][None, :, :], axis=2)


SHIFTS = _shifts()


class Extensions:
    """Answers how far the sequence repeats from two places on, many pairs at a time.

    Only suffixes at places of the cover are sorted: by their first ``PERIOD`` values, then by doubling. Neighbours'
    common prefixes, found on the way back down the doublings, are kept in a sparse table of minima. A pair of places
    is compared value by value until both are sampled, which takes fewer than ``PERIOD`` steps, and from there on the
    table answers. The sequence must end with a value that occurs once.
    """

    def __init__(self, values: np.ndarray):
        n = len(values)
        fresh = values.max(initial=0) + 1
        self.values = np.concatenate([values, fresh + np.arange(2 * PERIOD)])
        # places of one residue lie together, so the suffix PERIOD further is the next one
        self.places = np.concatenate([np.arange(r, n + PERIOD, PERIOD) for r in COVER])
        self.index = np.full(n + PERIOD, -1, np.int64)
        self.index[self.places] = np.arange(len(self.places))
        self._rank()
        self._table(self._neighbours())

    def _ahead(self, ranks: np.ndarray, steps: int) -> np.ndarray:
        """Rank of the suffix ``steps`` further in the same residue, -1 beyond the end."""
        out = np.full(len(ranks), -1, np.int64)
        out[:-steps] = ranks[steps:]
        out[self.places + steps * PERIOD >= len(self.index)] = -1
        return out

    def _rank(self) -> None:
        bits = max(1, int(self.values.max()).bit_length())
        each = 62 // bits
        keys = []
        for at in range(0, PERIOD, each):
            key = np.zeros(len(self.places), np.int64)
            for k in range(at, min(at + each, PERIOD)):
                key = key << bits | self.values[self.places + k]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), bool)
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        ranks = np.empty(len(order), np.int64)
        ranks[order] = np.cumsum(new)
        self.levels, steps = [ranks], 1
        while ranks.max(initial=0) + 1 < len(ranks):
            key = ranks * (len(ranks) + 1) + self._ahead(ranks, steps) + 1
            order = np.argsort(key, kind="stable")
            key = key[order]
            ranks = np.empty(len(order), np.int64)
            ranks[order] = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
            self.levels.append(ranks)
            steps *= 2
        self.ranks, self.order = ranks, np.argsort(ranks, kind="stable")

    def _neighbours(self) -> np.ndarray:
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        common = np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 2, -1, -1):
            ranks = self.levels[level]
            same = np.flatnonzero(ranks[a] == ranks[b])
            common[same] += PERIOD << level
            a[same] += 1 << level
            b[same] += 1 << level
        more, _ = self._walk(self.places[a], self.places[b], np.full(len(a), PERIOD))
        return common + more

    def _table(self, common: np.ndarray) -> None:
        self.minima = [common.astype(np.int32)]
        width = 1
        while 2 * width <= len(common):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def _walk(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal values from each pair of places on, at most ``most``, and whether all of those are equal."""
        out = most.copy()
        alive, step = np.flatnonzero(most > 0), 0
        while len(alive):
            same = self.values[a[alive] + step] == self.values[b[alive] + step]
            out[alive[~same]] = step
            step += 1
            alive = alive[same]
            alive = alive[most[alive] > step]
        return out, out == most

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of each pair of different places."""
        shift = SHIFTS[a % PERIOD, b % PERIOD]
        out, open_ = self._walk(a, b, shift)
        at = np.flatnonzero(open_)
        if len(at):
            x, y = (self.ranks[self.index[p[at] + shift[at]]] for p in (a, b))
            low, high = np.minimum(x, y), np.maximum(x, y)
            level = np.frexp((high - low).astype(float))[1] - 1
            for k in np.unique(level).tolist():
                here = level == k
                table = self.minima[k]
                out[at[here]] += np.minimum(table[low[here]], table[high[here] - (1 << k)])
        return out
