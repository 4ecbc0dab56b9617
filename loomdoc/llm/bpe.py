"""Byte-pair encoding and decoding as streaming transducers (operator 11).

Encoding: a run of text that the tokenizer's rules hold together (a word, a digit, a run of signs) is read symbol by symbol, and a
token is given out as soon as nothing that follows can change it. How far that is follows from the merge list alone
(``MergeList.lookahead``). Text further to the right changes what is to its left only through a chain of merges: the first takes
the last token b1 of what is held into what follows, the next one (rule b2, c2) takes the token b2 before it, where c2 begins
with b1, and so on. A merge can't come before the merges that made its parts, so ranks rise along a chain, and the longest
chain's symbols bound the reach. What ends further to the left than that is stable. A transducer holds at most twice that many
symbols, whatever the length of the run.

Texts are cut at spaces, which the tokenizer drops and nothing joins across; pieces that were met before are looked up (the first
``tokens.CACHE`` of them are remembered), and so are words within them (``WORDS``). Pieces longer than ``LONG`` characters go through in
parts of ``PART`` characters, cut where the run on both sides goes on (``_cut``), so that the transducer is carried over.

Decoding: token bytes go through an incremental byte-to-text machine, ``IDS_AT_ONCE`` ids at a time; an incomplete character waits for
its remaining bytes, and bytes that make none become U+FFFD. A tokenizer without a decoder puts a space between tokens.

Defined cases: null text is empty and gives no tokens; special tokens written out in a text are their ids, as in the library; rows
that repeat, and null ids, are each given; an empty table gives an empty result; further columns are ignored.
A merge list in which a token has two rules, or a rule comes before one of its parts', is refused.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Encoder, _slices

LONG, PART = 1 << 10, 1 << 16
#: Words that a worker remembers.
WORDS = 500_000
IDS_AT_ONCE = 1 << 16
NONE = 1 << 62
#: How a word's ASCII characters stand in a vocabulary of bytes, and the splits of ASCII text.
SHIFTED = {b: chr(256 + i) for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0D\x20a-z0-9]+")
SPLIT_SOURCE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Where a long piece may be cut: within letters or between digits, beside nothing that composes or that an apostrophe may claim.
WITHIN = re.compile(r"[A-Za-z]{4}(?=[A-Za-z])|[0-9](?=[0-9])")


def byte_of(c: str) -> int:
    """The byte that a character of a vocabulary of bytes stands for."""
    return _BYTES[c]


_BYTES = {SHIFTED.get(b, chr(b)): b for b in range(256)}


class MergeList:
    """The merges of a vocabulary, by rank."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(merges):
            if a + b in made or any(len(x.removesuffix(suffix) if suffix else x) > 1 and x not in made for x in (a, b)):
                raise ValueError(f"the merge list is not proper at {a} {b}")
            made[a + b] = rank
        self.vocab, self.suffix = vocab, suffix
        self.rule = {vocab[a] << 24 | vocab[b]: rank << 24 | vocab[a + b] for rank, (a, b) in enumerate(merges)}
        self.size = {i: len(t.removesuffix(suffix) if suffix else t) for t, i in vocab.items()}
        self.lookahead = self._reach(merges)

    @staticmethod
    def _reach(merges: list[tuple[str, str]]) -> int:
        """The most symbols by which a chain of merges can reach to the left: from the last rule to the first, each rule (b, c) adds its b to the longest later chain whose next c begins with b."""
        best: dict[str, int] = {}  # by token: the longest chain of the rules met so far whose right part begins with it
        most = 0
        for a, b in reversed(merges):
            reach = len(a) + best.get(a, 0)
            most = max(most, reach)
            for n in range(1, len(b) + 1):
                if best.get(b[:n], 0) < reach:
                    best[b[:n]] = reach
        return most

    def symbols(self, word: str, last: bool) -> list[int]:
        if not word:
            return []
        if not (last and self.suffix):
            return [self.vocab[c] for c in word]
        return [*(self.vocab[c] for c in word[:-1]), self.vocab[word[-1] + self.suffix]]

    def merged(self, s: list[int]) -> list[int]:
        """The tokens of a list of symbols: the merge of least rank first, the leftmost of equal ones."""
        if len(s) > 200:
            return self._merged_long(s)
        get, s = self.rule.get, list(s)
        r = [get(a << 24 | b, NONE) for a, b in zip(s, s[1:])]  # noqa: B905
        while r and (m := min(r)) != NONE:
            i = r.index(m)
            new = m & 0xFFFFFF
            s[i : i + 2] = [new]
            del r[i]
            if i:
                r[i - 1] = get(s[i - 1] << 24 | new, NONE)
            if i < len(r):
                r[i] = get(new << 24 | s[i + 1], NONE)
        return s

    def _merged_long(self, s: list[int]) -> list[int]:
        """The same with a heap over linked tokens, for lists that are not short."""
        get, s, n = self.rule.get, list(s), len(s)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m, i) for i in range(n - 1) if (m := get(s[i] << 24 | s[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i]
            if s[i] < 0 or j < 0 or get(s[i] << 24 | s[j], NONE) != m:
                continue
            s[i], s[j] = m & 0xFFFFFF, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (x := get(s[i] << 24 | s[k], NONE)) != NONE:
                    heapq.heappush(heap, (x, i))
            if (h := before[i]) >= 0 and (x := get(s[h] << 24 | s[i], NONE)) != NONE:
                heapq.heappush(heap, (x, h))
        return [x for x in s if x >= 0]


class Transducer:
    """Symbols of one run in, stable tokens out."""

    def __init__(self, merges: MergeList):
        self.merges, self.held = merges, []
        self.most = max(2 * merges.lookahead, 64)

    def push(self, symbols: list[int]) -> Iterator[int]:
        """Takes symbols that others follow, and gives the tokens that these can't change any more."""
        for at in range(0, len(symbols), self.most):
            self.held += symbols[at : at + self.most]
            if len(self.held) < self.most:
                continue
            end, least = 0, len(self.held) - self.merges.lookahead
            for t in self.merges.merged(self.held):
                if end + self.merges.size[t] > least:
                    break
                end += self.merges.size[t]
                yield t
            self.held = self.held[end:]

    def finish(self, symbols: list[int]) -> Iterator[int]:
        """Takes the last symbols of a run, and gives all that is left."""
        yield from self.push(symbols[:-1])
        rest, self.held = self.held + symbols[-1:], []
        yield from self.merges.merged(rest)


class StreamingEncoder(Encoder):
    """Ids of whole texts, as the library gives them; the library normalises and splits, the merges are the transducer's."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.merges = MergeList(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], suffix)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [p.get("pattern", {}).get("Regex") for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"] or splits[:1] != [SPLIT_SOURCE]:
            raise ValueError("this encoder is for tokenizers that lower-case, drop white space and mark the ends of words")
        self.words: dict[str, list[int]] = {}

    def _split(self, t: str) -> list[str]:
        """The words of a text without special tokens, in the vocabulary's characters."""
        if t.isascii():
            return [w.translate(SHIFTED) for w in ASCII_SPLIT.findall(t.lower())]
        return [w for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(t))]

    def _word(self, w: str) -> list[int]:
        got = self.words.get(w)
        if got is None:
            got = self.merges.merged(self.merges.symbols(w, True)) if len(w) < self.merges.lookahead else list(Transducer(self.merges).finish(self.merges.symbols(w, True)))
            if len(self.words) < WORDS and len(w) <= 40:
                self.words[w] = got
        return got

    def stream(self, parts: Iterable[str]) -> Iterator[int]:
        """Ids of a text without special tokens, given in parts that follow on one another inside a run or between two."""
        open_run, transducer = "", Transducer(self.merges)
        for part, goes_on in parts:
            words = self._split(part)
            if open_run and words:
                if len(words) > 1 or not goes_on:
                    yield from transducer.finish(self.merges.symbols(words[0], True))
                    open_run = ""
                else:
                    yield from transducer.push(self.merges.symbols(words[0], False))
                words = words[1:]
            last = words.pop() if goes_on and words else None
            for w in words:
                yield from self._word(w)
            if last:
                open_run = last
                yield from transducer.push(self.merges.symbols(last, False))

    def piece(self, t: str) -> list[int]:
        out: list[int] = []
        for p in self.parts.split(t) if self.parts and "<" in t else [t]:
            if (i := self.special.get(p)) is not None:
                out.append(i)
            elif len(p) > LONG:
                out += self.stream(_cut(p))
            else:
                for w in self._split(p):
                    out += self._word(w)
        return out

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [self.piece(p) for p in pieces]
        at = np.zeros(len(got) + 1, np.int64)
        np.cumsum([len(x) for x in got], out=at[1:])
        return np.fromiter((i for x in got for i in x), np.uint32, int(at[-1])), at


def _cut(t: str) -> Iterator[tuple[str, bool]]:
    """(part, whether a run of letters goes on in the next) of a long text, cut after PART characters or more, where letters or digits stand on both sides."""
    at = 0
    while len(t) - at > PART:
        m = WITHIN.search(t, at + PART)
        if not m:
            break
        yield t[at : m.end()], not m[0].isdigit()
        at = m.end()
    yield t[at:], False


class Decoder:
    """Text of ids: each id's bytes through a machine that holds back incomplete characters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        named = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        special = {t["id"] for t in spec["added_tokens"]}
        kind = (spec["decoder"] or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"no byte machine for the decoder {kind}")
        self.between = b" " if kind is None else b""
        raw = (lambda i, t: t.encode()) if kind is None else (lambda i, t: t.encode() if i in special or any(c not in _BYTES for c in t) else bytes(map(byte_of, t)))
        self.bytes = [raw(i, named[i]) if i in named else None for i in range(max(named) + 1)]

    def __call__(self, ids: np.ndarray) -> Iterator[str]:
        """The text of ids in parts, each as soon as its characters are complete; unknown ids give nothing."""
        machine, lead = codecs.getincrementaldecoder("utf-8")("replace"), b""
        for at in range(0, len(ids), IDS_AT_ONCE):
            known = [b for i in ids[at : at + IDS_AT_ONCE].tolist() if i < len(self.bytes) and (b := self.bytes[i]) is not None]
            if known:
                yield machine.decode(lead + self.between.join(known))
                lead = self.between
        yield machine.decode(b"", True)


_MADE: dict[tuple[str, str], object] = {}


def _once(kind, path: str):
    """The worker's encoder or decoder of a vocabulary file."""
    if (kind.__name__, path) not in _MADE:
        _MADE[kind.__name__, path] = kind(path)
    return _MADE[kind.__name__, path]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _once(StreamingEncoder, tokenizer)
        for part, ids, at in _encoded(batches, enc):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int64)))], schema=schema)

    return _texts(docs, id_col, text).mapInArrow(run, "doc_id bigint, ids array<bigint>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = _once(Decoder, tokenizer)
        for batch in batches:
            texts = ["".join(dec(np.array(x or [], np.int64))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: ids as little-endian unsigned 32-bit integers, the decoded text in UTF-8."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = _once(StreamingEncoder, tokenizer), _once(Decoder, tokenizer)
        for part, ids, at in _encoded(batches, enc):
            sha, text_sha = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                sha.append(hashlib.sha256(ids[a:b].astype("<u4").tobytes()).hexdigest())
                h = hashlib.sha256()
                for t in dec(ids[a:b]):
                    h.update(t.encode())
                text_sha.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(sha, pa.string()), pa.array(text_sha, pa.string())], schema=schema)

    return _texts(docs, id_col, text).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text).cast("string").alias("t"))


def _encoded(batches: Iterable[pa.RecordBatch], enc: Encoder) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i, j in _slices(batch.column(1)):
            part = batch.slice(i, j - i)
            yield part, *enc(part.column(1))
