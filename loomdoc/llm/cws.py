"""Weighted sets of shingles and improved consistent weighted sampling, vectorised over the texts of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .hashing import U, byte_offsets, inner, runs, scrambled, word_hashes

SHINGLE = 5
#: Texts in work at once: their number is the high byte of a sort key; and the bytes of text in work at once (one text may be longer).
ROWS_AT_ONCE, BYTES_AT_ONCE = 256, 1 << 20
#: A count sketch of DEPTH rows with 2 ** WIDTH_BITS counters each.
DEPTH, WIDTH_BITS = 2, 19
GOLDEN = U(0x9E3779B97F4A7C15)


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(begin, end) of the rows to be worked on at once."""
    off, at = byte_offsets(texts)[0], 0
    while at < len(texts):
        to = min(at + ROWS_AT_ONCE, max(at + 1, int(np.searchsorted(off, off[at] + BYTES_AT_ONCE, "right")) - 1), len(texts))
        yield at, to
        at = to


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, times), by row and shingle, of at most ROWS_AT_ONCE texts; texts without words have none.

    A shingle is a hash of 56 bits. A text of fewer than SHINGLE words is one shingle, padded by zeros that stand for no word.
    """
    h, lengths = word_hashes(texts)
    if (short := (lengths > 0) & (lengths < SHINGLE)).any():
        pad = np.where(short, SHINGLE - lengths, 0)
        h = np.insert(h, np.repeat(np.cumsum(lengths), pad), U(0))
        lengths = lengths + pad
    where = inner(lengths, SHINGLE)
    if not len(where):
        return np.empty(0, np.int64), np.empty(0, U), np.empty(0, np.int64)
    row = np.repeat(np.arange(len(lengths), dtype=U), np.maximum(lengths - SHINGLE + 1, 0))
    key = row << U(56) | runs(h, SHINGLE)[where] >> U(8)
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> U(56)).astype(np.int64), key & U((1 << 56) - 1), times


def slots(s: np.ndarray, row: int) -> np.ndarray:
    """The counter of each shingle in one row of the sketch."""
    return (scrambled(s * U(2 * row + 3) + GOLDEN) >> U(64 - WIDTH_BITS)).astype(np.int64)


def weights(s: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """tf * idf; idf: (DEPTH, width). The least of a shingle's counters has the largest idf."""
    out = idf[0][slots(s, 0)]
    for d in range(1, DEPTH):
        np.maximum(out, idf[d][slots(s, d)], out=out)
    return out * times.astype(np.float32)


class Sampler:
    """k consistent samples, 32 bits each, of weighted sets. The work arrays are kept, as allocating them takes as long as the work.

    For shingle s with weight w and sample k: r, c of Gamma(2, 1), beta of Uniform(0, 1), all from a hash of (s, k);
    t = floor(ln w / r + beta); the shingle with the least ln c - r * (t - beta + 1) is the sample, with its t.
    """

    SIZE = 1024

    def __init__(self, k: int):
        self.names = np.arange(1, k + 1, dtype=U) * GOLDEN
        shape = (self.SIZE, k)
        self.wide = [np.empty(shape, U) for _ in range(3)]
        self.narrow = np.empty(shape, np.uint32)
        self.real = [np.empty(shape, np.float32) for _ in range(4)]
        self.whole = np.empty(shape, np.int32)

    def _ranks(self, s: np.ndarray, ln_w: np.ndarray) -> np.ndarray:
        """Integers whose order is that of the sampled values, with the samples' names in their low halves."""
        n = len(s)
        z, v, y = (x[:n] for x in self.wide)
        i, m = self.narrow[:n], self.whole[:n]
        r, c, b, t = (x[:n] for x in self.real)

        def uniform(x: np.ndarray, by: int, out: np.ndarray) -> None:
            """Numbers of 24 bits, plus a half, from 32 bits of x."""
            np.right_shift(x, U(by), out=y)
            i[...] = y
            np.right_shift(i, np.uint32(8), out=i)
            out[...] = i.view(np.int32)
            out += np.float32(0.5)

        def mixed(x: np.ndarray, by: int) -> None:
            np.right_shift(x, U(by), out=y)
            np.bitwise_xor(x, y, out=x)

        np.add(s[:, None], self.names, out=z)
        mixed(z, 32)
        z *= U(0xD6E8FEB86659FD93)
        mixed(z, 29)
        np.multiply(z, U(0xC2B2AE3D27D4EB4F), out=v)
        mixed(v, 32)
        for x, out in ((z, r), (v, c)):  # ln of a product of two uniform numbers: minus a number of Gamma(2, 1)
            uniform(x, 32, out)
            uniform(x, 0, b)
            out *= b
            out *= np.float32(2**-48)
            np.log(out, out=out)
        np.negative(c, out=c)
        np.log(c, out=c)
        v *= GOLDEN
        v += z
        uniform(v, 32, b)
        b *= np.float32(2**-24)
        np.divide(ln_w[:, None], r, out=t)
        np.subtract(b, t, out=t)
        np.floor(t, out=t)
        m[...] = t
        t -= b
        t += np.float32(1)
        t *= r
        c += t
        bits, q, rank = c.view(np.int32), i.view(np.int32), y.view(np.int64)
        np.right_shift(bits, np.int32(31), out=q)
        q &= np.int32(0x7FFFFFFF)
        q ^= bits
        rank[...] = q
        rank <<= np.int64(32)
        v[...] = m
        v *= GOLDEN
        z += v
        z >>= U(32)
        rank |= z.view(np.int64)
        return rank

    def __call__(self, s: np.ndarray, w: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """begin: where the sets start; none is empty."""
        ln_w = np.log(w)
        out = np.full((len(begin), len(self.names)), np.iinfo(np.int64).max)
        for at in range(0, len(s), self.SIZE):
            to = min(at + self.SIZE, len(s))
            rank = self._ranks(s[at:to], ln_w[at:to])
            lo, hi = int(np.searchsorted(begin, at, "right")) - 1, int(np.searchsorted(begin, to, "left"))
            least = np.minimum.reduceat(rank, np.maximum(begin[lo:hi] - at, 0), axis=0)
            np.minimum(out[lo:hi], least, out=out[lo:hi])
        return out.view(U) & U(0xFFFFFFFF)
