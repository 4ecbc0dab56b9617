"""Vectorised hashing over Arrow batches of word-hash lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists as unsigned 64-bit integers, and the lengths of the lists."""
    lists = lists.cast(pa.large_list(pa.int64())) if not pa.types.is_large_list(lists.type) else lists
    off = np.asarray(lists.offsets)
    return np.asarray(lists.values)[off[0] : off[-1]].view(U), np.diff(off)


def scrambled(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` values (shorter by size - 1), by doubling; runs that cross documents are the caller's to drop."""
    if len(h) < size:
        return np.empty(0, U)
    out, have, part, length = None, 0, h, 1
    rest = size
    while rest:
        if rest & 1:
            if out is None:
                out = part
            else:
                n = min(len(out), len(part) - have)
                out = scrambled(out[:n] * U(0x9E3779B97F4A7C15) + part[have : have + n])
            have += length
        rest >>= 1
        if rest:
            n = len(part) - length
            part = scrambled(part[:n] * U(0xC2B2AE3D27D4EB4F) + part[length : length + n] + U(length))
            length *= 2
    return out[: len(h) - size + 1]


def least(h: np.ndarray, size: int) -> np.ndarray:
    """The least of each run of ``size`` values."""
    if len(h) < size:
        return np.empty(0, h.dtype)
    part, length = h, 1
    while length * 2 <= size:
        part = np.minimum(part[: len(part) - length], part[length:])
        length *= 2
    n = len(h) - size + 1
    return np.minimum(part[:n], part[size - length : size - length + n])


def inner(lengths: np.ndarray, size: int) -> np.ndarray:
    """Positions, among all values, at which a run of ``size`` fits in its document."""
    ends = np.cumsum(lengths)
    n = np.maximum(lengths - size + 1, 0)
    return np.repeat(ends - lengths, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))


def byte_offsets(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each text begins and ends in the data, and the texts with 64-bit offsets."""
    data = texts.cast(pa.large_binary())
    if not len(data):
        return np.zeros(1, np.int64), data
    return np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1], data


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated words of all texts, and the number of words of each; null texts have none.

    A word is read eight bytes at a time; its bytes, its length and nothing else make its hash.
    """
    off, data = byte_offsets(texts)
    if off[-1] == off[0]:
        return np.empty(0, U), np.zeros(len(texts), np.int64)
    a = np.frombuffer(data.buffers()[2], np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    inside = ~((a == 32) | (a - np.uint8(9) < 5))
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = np.unique(off[(off > 0) & (off < len(a))])  # a word ends where its text does
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = end - begin
    eight = np.lib.stride_tricks.as_strided(np.concatenate([a, np.zeros(8, np.uint8)]), (len(a) + 1, 8), (1, 1))
    h = size.astype(U) * U(0x9E3779B97F4A7C15)
    which = np.arange(len(begin))
    at, left = begin, size
    while len(which):
        part = np.ascontiguousarray(eight[at]).view(U)[:, 0]
        short = left < 8
        part[short] &= (U(1) << (left[short].astype(U) * U(8))) - U(1)
        h[which] = scrambled(h[which] + part * U(0xC2B2AE3D27D4EB4F))
        more = left > 8
        which, at, left = which[more], at[more] + 8, left[more] - 8
    return h, np.diff(np.searchsorted(begin, off))
