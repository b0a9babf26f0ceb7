"""Two-stage suffix sorting of many short texts, in NumPy.

Suffixes smaller than their successor are sorted directly, eight bytes at a
time; all others are induced by scanning the buckets of first bytes in order.
Comparisons go to ``DEPTH`` bytes, which is all that a repeat of that length
needs. A block holds a few million bytes.
"""

from __future__ import annotations

import numpy as np

DEPTH = 100


class SuffixArray:
    """Sorted suffixes of ``texts``; bytes must be below 255, as in UTF-8."""

    def __init__(self, texts: list[bytes], depth: int = DEPTH):
        self.depth = depth
        joined = b"\xff".join(texts) + b"\xff"
        # One is added to every byte, so the separator wraps to 0 and sorts first.
        self.t = t = np.frombuffer(joined, dtype=np.uint8) + np.uint8(1)
        n = len(t)
        ends = np.flatnonzero(t == 0)
        self.starts = np.concatenate(([0], ends[:-1] + 1))
        lengths = ends - self.starts
        #: Bytes from each position to the end of its text.
        self.rest = np.repeat(ends, lengths + 1) - np.arange(n)
        self.chunk = self._chunks()
        self.order = self._induce(self._sort_smaller(self._smaller()))

    def _chunks(self) -> np.ndarray:
        """Eight bytes from each position as one number, zero beyond the text's end."""
        padded = np.concatenate((self.t, np.zeros(8, dtype=np.uint8)))
        out = np.zeros(len(self.t), dtype=np.uint64)
        for k in range(8):
            out = (out << np.uint64(8)) | padded[k : k + len(self.t)]
        cut = np.minimum(self.rest, 8).astype(np.uint64)
        keep = np.where(cut == 0, np.uint64(0), ~np.uint64(0) << (np.uint64(8) * (np.uint64(8) - np.maximum(cut, np.uint64(1)))))
        return out & keep

    def _smaller(self) -> np.ndarray:
        """Whether a suffix is smaller than its successor: decided where a run of equal bytes ends."""
        n = len(self.t)
        nxt = np.concatenate((self.t[1:], np.zeros(1, dtype=np.uint8)))
        index = np.where(self.t != nxt, np.arange(n), n)
        index[-1] = n - 1
        index = np.minimum.accumulate(index[::-1])[::-1]
        return (self.t[index] < nxt[index]) & (self.t > 0)

    def _at(self, pos: np.ndarray, ahead: int) -> np.ndarray:
        inside = self.rest[pos] > ahead
        return np.where(inside, self.chunk[np.where(inside, pos + ahead, 0)], np.uint64(0))

    def _sort_smaller(self, smaller: np.ndarray) -> np.ndarray:
        self.larger = ~smaller & (self.t > 0)
        pos = np.flatnonzero(smaller)
        if not len(pos):
            return pos
        pos = pos[np.argsort(self.chunk[pos], kind="stable")]
        key = self.chunk[pos]
        group = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        ahead = 8
        open_ = np.arange(len(pos))  # places in the order that may still be tied
        while ahead < self.depth:
            sizes = np.bincount(group[open_])
            open_ = open_[sizes[group[open_]] > 1]
            if not len(open_):
                break
            key = self._at(pos[open_], ahead)
            own = group[open_]
            by = np.lexsort((key, own))
            pos[open_], key = pos[open_][by], key[by]
            fresh = np.concatenate(([True], (own[1:] != own[:-1]) | (key[1:] != key[:-1])))
            group[open_] = np.maximum.accumulate(np.where(fresh, open_, 0))
            ahead += 8
        return pos

    def _induce(self, sorted_smaller: np.ndarray) -> np.ndarray:
        t, larger = self.t, self.larger
        bounds = np.searchsorted(t[sorted_smaller], np.arange(257))
        waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
        out = []
        for c in range(256):
            if c == 0:
                bucket = np.flatnonzero(t == 0)
            else:
                front = [x for x in waiting[c] if len(x)]
                level = np.concatenate(front) if front else np.zeros(0, dtype=np.int64)
                parts = []
                while len(level):  # a larger suffix before one of the same byte follows it in the bucket
                    parts.append(level)
                    before = level[level > 0] - 1
                    level = before[(t[before] == c) & larger[before]]
                bucket = np.concatenate([*parts, sorted_smaller[bounds[c] : bounds[c + 1]]])
            out.append(bucket)
            before = bucket[bucket > 0] - 1
            before = before[larger[before] & (t[before] > c)]
            if len(before):
                by = np.argsort(t[before], kind="stable")
                before = before[by]
                edges = np.searchsorted(t[before], np.arange(c + 1, 257))
                for d in np.unique(t[before]).tolist():
                    waiting[d].append(before[edges[d - c - 1] : edges[d - c]])
        return np.concatenate(out)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffix pairs, up to the depth."""
        length = np.zeros(len(a), dtype=np.int64)
        live = np.arange(len(a))
        for ahead in range(0, self.depth, 8):
            if not len(live):
                break
            x, y = self._at(a[live], ahead), self._at(b[live], ahead)
            same = x == y
            differ = x ^ y
            top = np.zeros(len(live), dtype=np.int64)
            for k in range(8):  # whole equal bytes from the left
                top += (differ >> np.uint64(56 - 8 * k) == 0)
            length[live] += np.where(same, 8, top)
            live = live[same]
        return np.minimum(length, np.minimum(self.depth, np.minimum(self.rest[a], self.rest[b])))

    def later_copies(self, starts: np.ndarray) -> np.ndarray:
        """Of these positions, those whose next ``depth`` bytes also start at an earlier one of them."""
        wanted = np.zeros(len(self.t), dtype=bool)
        wanted[starts] = self.rest[starts] >= self.depth
        sorted_ = self.order[wanted[self.order]]
        if len(sorted_) < 2:
            return np.zeros(0, dtype=np.int64)
        fresh = np.concatenate(([True], self.common(sorted_[:-1], sorted_[1:]) < self.depth))
        heads = np.flatnonzero(fresh)
        first = np.minimum.reduceat(sorted_, heads)
        return np.sort(sorted_[sorted_ != np.repeat(first, np.diff(np.append(heads, len(sorted_))))])
