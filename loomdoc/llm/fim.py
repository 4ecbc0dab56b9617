"""Fill-in-middle transformation over seekable compressed frames (operator 13).

A text is stored as independent zstandard frames of about ``FRAME_BYTES`` bytes, cut at line ends where a line isn't longer than that,
with the bytes, characters and units (lines) before each frame (``store``). Two hashes of the document's id choose two line
ends. Only the frames that hold these are decompressed to find them (``_place``); all else is done on ranges of bytes,
which are streamed frame by frame, in order (``_stream``). The transformed text is stored in the same way (``transform``), and is
taken apart again by its own marks alone (``restored``); digests take one frame at a time, so that no text is whole in memory
beside its compressed form.

Defined cases: null text is empty, hence plain; a null id is the empty string to the hash; repeated ids and repeated rows are
each given; a text that holds one of the marks is plain, since its marks couldn't be told apart; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 7
#: Of a hundred texts, so many are transformed, and so many of these put the suffix first.
RATE, SPM = 100, 50
FRAME_BYTES = 1 << 16
LEVEL = 3
FRAMES = "frames array<binary>, bytes array<bigint>, chars array<bigint>, units array<bigint>"
FRAME_TYPES = [pa.field("frames", pa.list_(pa.binary())), *(pa.field(c, pa.list_(pa.int64())) for c in ("bytes", "chars", "units"))]


class Frames:
    """A text in frames, with the bytes, characters and line ends before each, and in all as the last entry."""

    def __init__(self, frames: list[bytes], bytes: list[int], chars: list[int], units: list[int]):
        self.frames, self.bytes, self.chars, self.units = frames, bytes, chars, units

    def frame(self, i: int) -> bytes:
        return _unpack.decompress(self.frames[i])


class Writer:
    """Takes bytes in order and makes frames of them."""

    def __init__(self):
        self.held, self.out = bytearray(), Frames([], [0], [0], [0])

    def write(self, data: bytes) -> None:
        if len(self.held) + len(data) <= FRAME_BYTES:
            self.held += data
            return
        for at in range(0, len(data), FRAME_BYTES):
            self.held += data[at : at + FRAME_BYTES]
            while len(self.held) > FRAME_BYTES:
                end = self.held.rfind(b"\n", 0, FRAME_BYTES) + 1 or FRAME_BYTES
                self._frame(bytes(self.held[:end]))
                del self.held[:end]

    def _frame(self, part: bytes) -> None:
        o = self.out
        o.frames.append(_pack.compress(part))
        o.bytes.append(o.bytes[-1] + len(part))
        o.chars.append(o.chars[-1] + _characters(part))
        o.units.append(o.units[-1] + part.count(b"\n"))

    def close(self) -> Frames:
        if self.held:
            self._frame(bytes(self.held))
        return self.out


_pack, _unpack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True), zstandard.ZstdDecompressor()
_CONTINUED = bytes(range(0x80, 0xC0))


def _characters(part: bytes) -> int:
    """Characters that begin in a part of a UTF-8 text."""
    return len(part) if part.isascii() else len(part.translate(None, _CONTINUED))


def _stream(f: Frames, begin: int, end: int) -> Iterator[bytes]:
    """The bytes from begin to end, frame by frame."""
    for i in range(len(f.frames)):
        if f.bytes[i] < end and f.bytes[i + 1] > begin:
            yield f.frame(i)[max(begin - f.bytes[i], 0) : end - f.bytes[i]]


def _place(f: Frames, k: int, n: int) -> tuple[int, int]:
    """(bytes, characters) before the end of the k-th of n lines; one frame is decompressed."""
    if k == 0 or k == n:
        return (0, 0) if k == 0 else (f.bytes[-1], f.chars[-1])
    i = next(i for i in range(len(f.frames)) if f.units[i + 1] >= k)
    part, at = f.frame(i), 0
    for _ in range(k - f.units[i]):
        at = part.index(b"\n", at) + 1
    return f.bytes[i] + at, f.chars[i] + _characters(part[:at])


def _marked(f: Frames) -> bool:
    """Whether one of the marks stands in the text, across frames as well."""
    tail = b""
    for i in range(len(f.frames)):
        part = tail + f.frame(i)
        if any(m in part for m in (PREFIX, SUFFIX, MIDDLE)):
            return True
        tail = part[-2:]
    return False


def _lines(f: Frames) -> int:
    """Lines of a text; the last one need not end."""
    return f.units[-1] + (bool(f.frames) and not f.frame(len(f.frames) - 1).endswith(b"\n"))


def _draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4]) for i in range(4)]


def _transformed(doc_id: int | None, f: Frames, seed: int) -> tuple[int, str, int | None, int | None, Frames]:
    """(lines, form, characters of prefix and middle, the output)."""
    n, (h1, h2, h3, h4) = _lines(f), _draws(doc_id, seed)
    if not f.frames or h3 % 100 >= RATE or _marked(f):
        return n, "plain", None, None, f
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    (p, pc), (m, mc) = _place(f, a, n), _place(f, b, n)
    end = f.bytes[-1]
    form = "spm" if h4 % 100 < SPM else "psm"
    prefix, middle, suffix = (PREFIX, 0, p), (MIDDLE, p, m), (SUFFIX, m, end)
    w = Writer()
    for mark, begin, to in (suffix, prefix, middle) if form == "spm" else (prefix, suffix, middle):
        w.write(mark)
        for part in _stream(f, begin, to):
            w.write(part)
    return n, form, pc, mc - pc, w.close()


def _marks(f: Frames, marks: Iterable[bytes]) -> list[int]:
    """Where the marks stand, each the first one after the one before."""
    marks, found = list(marks), []
    tail = b""
    for i in range(len(f.frames)):
        part, at = tail + f.frame(i), 0
        begin = f.bytes[i] - len(tail)
        while len(found) < len(marks) and (x := part.find(marks[len(found)], max(at, found[-1] + 3 - begin if found else 0))) >= 0:
            found.append(begin + x)
            at = x + 3
        tail = part[-2:]
    if len(found) < len(marks):
        raise ValueError("the text lacks the marks of its form")
    return found


def restored(f: Frames, form: str) -> Iterator[bytes]:
    """The first text of a transformed one, in order, from the output and its form alone."""
    end = f.bytes[-1]
    if form == "plain":
        yield from _stream(f, 0, end)
    elif form == "psm":
        p, s, m = _marks(f, (PREFIX, SUFFIX, MIDDLE))
        for begin, to in ((p + 3, s), (m + 3, end), (s + 3, m)):
            yield from _stream(f, begin, to)
    else:
        s, p, m = _marks(f, (SUFFIX, PREFIX, MIDDLE))
        for begin, to in ((p + 3, m), (m + 3, end), (s + 3, p)):
            yield from _stream(f, begin, to)


def _sha(parts: Iterable[bytes]) -> str:
    h = hashlib.sha256()
    for part in parts:
        h.update(part)
    return h.hexdigest()


def _frames(batch: pa.RecordBatch, first: int) -> Iterator[Frames]:
    for i in range(batch.num_rows):
        yield Frames(*(batch.column(first + k)[i].as_py() for k in range(4)))


def _columns(frames: list[Frames]) -> list[pa.Array]:
    return [pa.array([getattr(f, t.name) for f in frames], t.type) for t in FRAME_TYPES]


def store(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, frames, bytes, chars, units) of each row: the text in compressed frames that can be sought by units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1):
                w = Writer()
                if t.is_valid:
                    w.write(memoryview(t.as_buffer()).tobytes())
                out.append(w.close())
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(out)], names=["doc_id", "frames", "bytes", "chars", "units"])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"doc_id bigint, {FRAMES}")


def transform(stored: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, frames, bytes, chars, units): the transformed texts, in frames as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_transformed(i, f, seed) for i, f in zip(batch.column(0).to_pylist(), _frames(batch, 1), strict=True)]
            n, form, prefix, middle, out = zip(*rows, strict=True) if rows else ((),) * 5
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), *_columns(list(out))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", *(t.name for t in FRAME_TYPES)])

    d = stored.select("doc_id", "frames", "bytes", "chars", "units")
    return d.mapInArrow(run, f"doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, {FRAMES}")


def texts(transformed: DataFrame, restore: bool = False) -> DataFrame:
    """(doc_id, text): the transformed texts, or the first ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [b"".join(restored(f, form if restore else "plain")).decode() for form, f in zip(batch.column(1).to_pylist(), _frames(batch, 2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return transformed.select("doc_id", "form", "frames", "bytes", "chars", "units").mapInArrow(run, "doc_id bigint, text string")


def digest(stored: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of each stored text: one worker transforms it, streams the output's frames and takes it apart again."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, f in zip(batch.column(0).to_pylist(), _frames(batch, 1), strict=True):
                n, form, prefix, middle, out = _transformed(i, f, seed)
                rows.append((i, n, form, prefix, middle, sha := _sha(_stream(out, 0, out.bytes[-1])), sha if form == "plain" else _sha(restored(out, form))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=names)

    d = stored.select("doc_id", "frames", "bytes", "chars", "units")
    return d.mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string")
