"""CRC32C of many byte strings at once: the table is looked up for one byte position of all of them at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Fixed value: the Castagnoli polynomial, bits reversed.
CASTAGNOLI = 0x82F63B78


def _table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(CASTAGNOLI), x >> 1).astype(np.uint32)
    return x


_TABLE = _table()


def crc32c_spans(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The checksum of data[start:stop] for each pair; the longest spans come first, so finished ones drop off the end."""
    length = stops - starts
    order = np.argsort(-length, kind="stable")
    begin, size = starts[order], length[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    alive = len(order)
    for k in range(int(size[0]) if len(size) else 0):
        alive = int(np.searchsorted(-size, -k, "left"))  # those longer than k
        c = crc[:alive]
        crc[:alive] = _TABLE[(c ^ data[begin[:alive] + k]) & 0xFF] ^ (c >> 8)
    out = np.empty(len(order), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def crc32c_array(column: pa.Array) -> pa.Array:
    """The checksum of each value of a binary array; null stays null."""
    raw = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = raw.buffers()
    ends = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return pa.array(crc32c_spans(bytes_, ends[:-1], ends[1:]).astype(np.int64), mask=np.asarray(column.is_null()))


_WORDS = _TABLE.tolist()


def crc32c(data: bytes | None) -> int | None:
    """The checksum of one byte string; for many of them the functions above."""
    if data is None:
        return None
    c = 0xFFFFFFFF
    for b in data:
        c = _WORDS[(c ^ b) & 0xFF] ^ (c >> 8)
    return c ^ 0xFFFFFFFF
