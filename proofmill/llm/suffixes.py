"""Suffix arrays by two-stage sorting, in memory, and binary searches in them.

Texts are bytes in which 0 separates; what follows a separator does not count, so the order of
suffixes that are equal up to one is open. Suffixes are compared by their first ``depth`` bytes, eight
at a time as one big-endian number.
"""

from __future__ import annotations

import numpy as np

from .common import U64


def windows(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number, zeros beyond the end."""
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), U64)
    for k in range(8):
        out = (out << U64(8)) | wide[k : k + len(text)]
    return out


def at(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.where(places < len(keys), keys[np.minimum(places, len(keys) - 1)], U64(0))


def _ends(keys: np.ndarray) -> np.ndarray:
    """Does a number hold a byte 0?"""
    return ((keys - U64(0x0101010101010101)) & ~keys & U64(0x8080808080808080)) != 0


def _sorted(keys: np.ndarray, chosen: np.ndarray, depth: int) -> np.ndarray:
    """chosen in the order of its suffixes; eight bytes more at a time of those that still tie."""
    if not len(chosen):
        return chosen
    first = keys[chosen]
    by = np.argsort(first)
    order, first = chosen[by], first[by]
    tied, group = np.arange(len(order)), np.append(0, np.cumsum(first[1:] != first[:-1]))
    now = first
    for d in range(8, depth, 8):
        many = np.bincount(group, minlength=group[-1] + 1)[group] > 1
        many &= ~_ends(now)
        tied, group = tied[many], group[many]
        if not len(tied):
            break
        part = order[tied]
        now = at(keys, part + d)
        by = np.lexsort((now, group))
        order[tied] = part[by]
        now, group = now[by], group[by]
        group = np.append(0, np.cumsum((group[1:] != group[:-1]) | (now[1:] != now[:-1])))
    return order


def suffix_array(text: np.ndarray, depth: int, keys: np.ndarray | None = None) -> np.ndarray:
    """Suffixes in the order of their first depth bytes; no byte is 0 but separators and the last one.

    Suffixes that are smaller than their successors are sorted directly; the others are induced by one
    scan over the buckets of first bytes.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    keys = windows(text) if keys is None else keys
    after = np.append(text[1:], np.uint8(0)).astype(np.int16)
    step = np.sign(after - text)
    step[-1] = -1
    # a run of equal bytes is smaller than its successor if its last byte is
    decided = np.flatnonzero(step)
    small = step[decided[np.searchsorted(decided, np.arange(n))]] > 0
    order = _sorted(keys, np.flatnonzero(small), depth)
    begin = np.searchsorted(text[order], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        if c == 0:  # separators in text order; the last suffix is the smallest
            induced[0] = [np.flatnonzero((text == 0) & ~small)[::-1]]
        level = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        front = [level]
        while c and len(level):
            before = level[level > 0] - 1
            level = before[(text[before] == c) & ~small[before]]
            front.append(level)
        bucket = np.concatenate([*front, order[begin[c] : begin[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(text[before] > c) & ~small[before]]
        if len(before):
            byte = text[before]
            by = np.argsort(byte, kind="stable")
            cut = np.flatnonzero(np.diff(byte[by])) + 1
            for part in np.split(before[by], cut):
                induced[text[part[0]]].append(part)
    return np.concatenate(out)


def bisect(column: np.ndarray, want: np.ndarray, low: np.ndarray, high: np.ndarray, right: bool) -> np.ndarray:
    """Insertion places of want between low and high, where column is sorted."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        seen = column[np.minimum(middle, len(column) - 1)]
        up = open_ & ((seen <= want) if right else (seen < want))
        low = np.where(up, middle + 1, low)
        high = np.where(open_ & ~up, middle, high)
    return low


class Patterns:
    """Byte strings without 0 and 255, as numbers of eight bytes, to be searched in suffix arrays."""

    def __init__(self, codes: list[bytes]):
        self.lengths = np.array([len(c) for c in codes], np.int64)
        self.depth = int(self.lengths.max(initial=0))
        self.levels = -(-self.depth // 8)
        fill = lambda byte: np.frombuffer(b"".join(c.ljust(8 * self.levels, byte) for c in codes), ">u8").reshape(len(codes), -1).astype(U64)
        self.low, self.high = fill(b"\0"), fill(b"\xff")

    def find(self, keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place (excluded) in the suffix array of the suffixes that begin with each."""
        column = keys[order]
        low = np.searchsorted(column, self.low[:, 0])
        high = np.searchsorted(column, self.high[:, 0], "right")
        for d in range(1, self.levels):
            more = np.flatnonzero((self.lengths > 8 * d) & (low < high))
            if not len(more):
                break
            column = at(keys, order + 8 * d)
            a = bisect(column, self.low[more, d], low[more], high[more], False)
            high[more] = bisect(column, self.high[more, d], a, high[more], True)
            low[more] = a
        return low, np.maximum(low, high)
