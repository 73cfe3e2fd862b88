"""Suffix arrays by induced sorting, and permuted common prefixes, over numpy arrays.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour; those of S whose left neighbour is L are
leftmost-smaller (LMS). Substrings from one LMS place to the next are sorted by inducing, named, and where names repeat their order is
found recursively; the order of all suffixes is then induced from it, in linear time. An inducing scan takes a bucket at a
time: all that a bucket holds induces its left neighbours at once, in order, and what falls into the same bucket takes another turn.
"""

from __future__ import annotations

import numpy as np

#: Names beyond this are written as two digits for the recursion, so that it has few buckets.
MOST_NAMES = 1 << 11


def classify(s: np.ndarray) -> np.ndarray:
    """Which suffixes are of type S. s ends with its only smallest value."""
    n = len(s)
    step = np.ones(n, np.int8)
    step[:-1] = (s[1:] > s[:-1]).astype(np.int8) - (s[1:] < s[:-1])
    at = np.where(step != 0, np.arange(n, dtype=np.int32), np.int32(n))
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return step[nearest] > 0


class Inducer:
    """The inducing scans over one string."""

    def __init__(self, s: np.ndarray, is_s: np.ndarray, sizes: np.ndarray):
        self.s, self.n, self.k = s, len(s), len(sizes)
        self.ends = np.cumsum(sizes).astype(np.int32)
        self.heads = (self.ends - sizes).astype(np.int32)
        self.used = np.flatnonzero(sizes)
        self.count = np.arange(self.n, dtype=np.int32)
        # What stands to the left of each place: its character, with a mark if it is of type S. Place 0 has none.
        self.left = np.empty(self.n, np.uint16 if self.k < 1 << 14 else np.uint32)
        self.left[0] = 1
        self.left[1:] = s[:-1]
        self.left[1:] <<= 1
        self.left[1:] |= is_s[:-1]

    def _place(self, sa: np.ndarray, j: np.ndarray, c: np.ndarray, at: np.ndarray, step: int) -> None:
        """Put places j with characters c into their buckets, from at on in direction step."""
        if self.k <= 256:
            c = c.astype(np.uint8)
        order = np.argsort(c, kind="stable")
        j, c = j[order], c[order]
        lead = np.concatenate(([0], np.flatnonzero(c[1:] != c[:-1]) + 1))
        size = np.diff(np.append(lead, len(c))).astype(np.int32)
        lead = lead.astype(np.int32)
        b = c[lead]
        where = np.repeat(at[b] - step * lead, size)
        where += self.count[: len(c)] if step > 0 else -self.count[: len(c)]
        sa[where] = j
        at[b] += step * size

    def __call__(self, lms: np.ndarray) -> np.ndarray:
        """The suffix array that follows from LMS suffixes in the given order."""
        sa = np.full(self.n, -1, np.int32)
        c = self.s[lms]
        first = np.concatenate(([0], np.cumsum(np.bincount(c, minlength=self.k)))).tolist()
        seeds = lms[np.argsort(c, kind="stable")]
        heads, ends, left = self.heads, self.ends, self.left
        nxt = heads.copy()
        for b in self.used.tolist():
            done = int(heads[b])
            while done < nxt[b]:
                upto = int(nxt[b])
                self._spread(sa, sa[done:upto], left, 0, nxt, 1)
                done = upto
            if first[b] < first[b + 1]:
                self._spread(sa, seeds[first[b] : first[b + 1]], left, 0, nxt, 1)
        last = ends - 1
        end = int(self.s[-1])  # the end itself is the only suffix of its bucket and no suffix induces it
        sa[heads[end]] = self.n - 1
        last[end] = heads[end] - 1
        for b in self.used[::-1].tolist():
            done = int(ends[b])
            while done > last[b] + 1:
                upto = int(last[b]) + 1
                self._spread(sa, sa[upto:done][::-1], left, 1, last, -1)
                done = upto
            if heads[b] < nxt[b]:
                self._spread(sa, sa[heads[b] : nxt[b]][::-1], left, 1, last, -1)
        return sa

    def _spread(self, sa: np.ndarray, batch: np.ndarray, left: np.ndarray, kind: int, at: np.ndarray, step: int) -> None:
        """Induce the left neighbours of a batch that are of type S (kind 1) or L (kind 0)."""
        before = left[batch]
        mine = (before & 1) == kind
        if kind:
            mine &= batch > 0
        j = batch[mine]
        if len(j):
            self._place(sa, j - 1, before[mine] >> 1, at, step)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The order of the suffixes of s: values from 0 to some thousands, the last one smaller than all others."""
    n = len(s)
    if n < 3:
        return np.arange(n, dtype=np.int32)[::-1].copy()
    is_s = classify(s)
    induce = Inducer(s, is_s, np.bincount(s))
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]).astype(np.int32) + 1
    order = induce(lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ranked = order[is_lms[order]]
    if len(ranked) < 2:
        return order
    # Names: neighbours in this order are one name if their substrings, both ends included, are equal.
    length = np.zeros(n, np.int32)
    length[lms[:-1]] = np.diff(lms)
    a, b = ranked[:-1], ranked[1:]
    equal = (length[a] == length[b]) & (length[a] > 0)
    alive, at = np.flatnonzero(equal), 0
    while len(alive):
        same = s[a[alive] + at] == s[b[alive] + at]
        equal[alive[~same]] = False
        alive = alive[same]
        at += 1
        alive = alive[length[a[alive]] >= at]
    names = np.zeros(n, np.int32)
    names[ranked] = np.concatenate(([0], np.cumsum(~equal)))
    reduced = names[lms]
    top = int(reduced.max()) + 1
    if top == len(lms):
        return induce(ranked)
    if top <= MOST_NAMES:
        places = suffix_array(reduced)
    else:
        # The end's name is 0 and its two digits would be equal: digits count from 1, and one 0 ends them all.
        base = int(np.ceil(np.sqrt(top)))
        digits = np.empty(2 * len(reduced) + 1, np.int32)
        digits[:-1:2], digits[1::2], digits[-1] = reduced // base + 1, reduced % base + 1, 0
        places = suffix_array(digits)
        places = places[(places % 2 == 0) & (places < 2 * len(reduced))] // 2
    return induce(lms[places])


def common_prefixes(s: np.ndarray, sa: np.ndarray, room: np.ndarray) -> np.ndarray:
    """For each place of s, how much its suffix has in common with the one before it in sa, up to room.

    room: bytes from each place to the end of its window, falling by one along a window. Only irreducible places, whose left
    neighbours differ, are compared; along the places after such a one the common prefix falls by one each (permuted order).
    """
    n = len(s)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n, dtype=np.int32)
    irreducible = (before <= 0) | (at == 0)
    inner = np.flatnonzero(~irreducible).astype(np.int32)
    p, q = inner, before[inner]
    irreducible[inner] = (s[p - 1] != s[q - 1]) | (room[p - 1] != room[p] + 1) | (room[q - 1] != room[q] + 1)
    starts = np.flatnonzero(irreducible).astype(np.int32)
    plcp = np.zeros(n, np.int32)
    alive = starts[before[starts] >= 0]
    most = np.minimum(room[alive], room[before[alive]])
    done = 0
    while len(alive):
        keep = most > done
        alive, most = alive[keep], most[keep]
        keep = s[alive + done] == s[before[alive] + done]
        plcp[alive[keep]] = done + 1
        alive, most = alive[keep], most[keep]
        done += 1
    lead = np.maximum.accumulate(np.where(irreducible, at, np.int32(0)))
    return np.maximum(0, np.minimum(plcp[lead] - (at - lead), room))
