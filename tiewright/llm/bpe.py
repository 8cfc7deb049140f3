"""BPE encoding and decoding with a contiguous rank array per word.

A word's parts lie in two parallel arrays: the part ids and the ranks of adjacent pairs. The smallest rank is found by a
scan, its boundary is deleted, and the ranks on both sides are refreshed. Words longer than ``SCAN_LIMIT`` symbols go
through a heap that makes the same merges in the same order, so that no input takes quadratic time.

Texts are whole: a null text counts as empty, an empty text has no ids, a very long text is encoded in segments that are
cut only where no token can span the cut. Words already met by a worker are kept in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
import weakref
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCAN_LIMIT = 192
#: Words kept by a worker before its table is emptied, and the characters of the longest one that is kept at all.
MEMO_WORDS, MEMO_CHARS = 250_000, 64
#: Characters that are split into words at once.
SEGMENT_CHARS = 1 << 20
_NO_RANK = sys.maxsize
#: Unicode White_Space, and the characters that Python's ``\s`` has besides.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: In ASCII texts, what has white space next to a space.
_BESIDE_SPACE = ("  ", " \n", "\n ", "\t", "\r", "\x0b", "\x0c")


def default_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def category_class(initial: str) -> str:
    """The inside of a character class for the general categories that start with ``initial``."""
    ranges, start, last = [], None, None
    for code in range(sys.maxunicode + 2):
        inside = code <= sys.maxunicode and unicodedata.category(chr(code))[0] == initial
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            last = code - 1
            ranges.append(re.escape(chr(start)) + (f"-{re.escape(chr(last))}" if last > start else ""))
            start = None
    return "".join(ranges)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Merges:
    """Vocabulary and merge ranks of a tokenizer file, and the encoding of one word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model = stored["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"] if t["special"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pairs: dict[int, int] = {}  # both ids in one number
        self.made: list[int] = []
        for left, right in model["merges"]:
            pair = self.vocab[left] << 32 | self.vocab[right]
            if pair not in self.pairs:
                self.pairs[pair] = len(self.made)
                self.made.append(self.vocab[left + right])
        symbols = byte_symbols()
        self.first = [self.vocab[s] for s in symbols]
        self.final = [self.vocab[s + self.suffix] for s in symbols]
        self.size = max([*self.vocab.values(), *self.special.values()]) + 1
        back = {s: b for b, s in enumerate(symbols)}
        self.token_bytes: list[bytes] = [b""] * self.size
        for token, number in self.vocab.items():
            self.token_bytes[number] = bytes(back[c] for c in token if c in back) if not self.suffix else token.encode()
        for token, number in self.special.items():
            self.token_bytes[number] = token.encode()

    def word(self, data: bytes) -> list[int]:
        """Ids of one word given as UTF-8."""
        ids = [self.first[b] for b in data]
        if ids and self.suffix:
            ids[-1] = self.final[data[-1]]
        return self._scan(ids) if len(ids) <= SCAN_LIMIT else self._heap(ids)

    def _scan(self, ids: list[int]) -> list[int]:
        rank = self.pairs.get
        ranks = [rank(a << 32 | b, _NO_RANK) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == _NO_RANK:
                break
            at = ranks.index(least)
            ids[at] = self.made[least]
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank(ids[at] << 32 | ids[at + 1], _NO_RANK)
            if at:
                ranks[at - 1] = rank(ids[at - 1] << 32 | ids[at], _NO_RANK)
        return ids

    def _heap(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        rank = self.pairs.get
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1], _NO_RANK)) != _NO_RANK]
        heapq.heapify(heap)
        while heap:
            least, at = heapq.heappop(heap)
            if not alive[at] or (right := after[at]) >= n or rank(ids[at] << 32 | ids[right], _NO_RANK) != least:
                continue
            ids[at], alive[right], after[at] = self.made[least], False, after[right]
            if after[at] < n:
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] < n and (r := rank(ids[left] << 32 | ids[after[left]], _NO_RANK)) != _NO_RANK:
                    heapq.heappush(heap, (r, left))
        return [x for x, kept in zip(ids, alive) if kept]


class _Memo(dict):
    """A table of at most MEMO_WORDS results of ``make`` for keys of at most MEMO_CHARS; others are made anew each time.

    Keys that ``keep`` refuses are not kept either.

    A worker serves one stage after the other: ``alone`` empties the tables of the others.
    """

    living: weakref.WeakValueDictionary = weakref.WeakValueDictionary()

    def __new__(cls, *_, **__):
        made = super().__new__(cls)
        cls.living[id(made)] = made
        return made

    def alone(self, *others: _Memo) -> None:
        for memo in list(self.living.values()):
            if memo is not self and not any(memo is x for x in others):
                memo.clear()

    def __init__(self, make, keep=None):
        super().__init__()
        self.make, self.keep = make, keep

    def __missing__(self, key):
        made = self.make(key)
        if len(key) <= MEMO_CHARS and (self.keep is None or self.keep(key)):
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[key] = made
        return made


class ByteLevelBpe:
    """Encoder and decoder for a byte-level BPE file, equal to the library's without special tokens added."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.dtype = np.dtype("<u2") if self.merges.size <= 1 << 16 else np.dtype("<u4")
        letters, numbers = category_class("L"), category_class("N")
        self.words = re.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{WHITE_SPACE}{letters}{numbers}]+"
            rf"|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+"
        )
        # Python's own classes are faster and equal but for these characters.
        odd = [c for c in map(chr, range(sys.maxunicode + 1)) if (unicodedata.category(c)[0] == "L") != (c.isalnum() and not c.isdecimal()) or (unicodedata.category(c)[0] == "N") != c.isdecimal()]
        self.odd = re.compile("[" + "".join(map(re.escape, odd)) + _SEPARATORS + "]")
        self.plain_words = re.compile(r" ?[^\W\d_]+| ?\d+|'s|'t|'re|'ve|'m|'ll|'d| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
        self.cut = re.compile(rf"(?<=[^{WHITE_SPACE}]) (?=[^{WHITE_SPACE}])")
        self.spaced = re.compile(rf" [{WHITE_SPACE}]|[{WHITE_SPACE}] ")
        self.memo = _Memo(self._encode_word)
        self.units = _Memo(self._encode_unit, lambda unit: "\n" not in unit)
        self.decimal = [f"{i}," for i in range(self.merges.size)]

    def _encode_word(self, word: str) -> bytes:
        return np.array(self.merges.word(word.encode()), self.dtype).tobytes()

    def _encode_unit(self, unit: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.split(f" {unit}")))

    def segments(self, text: str) -> Iterator[str]:
        """Pieces of about SEGMENT_CHARS, cut before a single space between two other characters: no token spans that."""
        start = 0
        while len(text) - start > SEGMENT_CHARS:
            found = self.cut.search(text, start + SEGMENT_CHARS)
            if not found:
                break
            yield text[start : found.start()]
            start = found.start()
        yield text[start:] if start else text

    def split(self, segment: str) -> list[str]:
        if (segment.isascii() and not any(c in segment for c in _SEPARATORS)) or not self.odd.search(segment):
            return self.plain_words.findall(segment)
        return self.words.findall(segment)

    def pieces(self, text: str) -> Iterator[bytes]:
        """The ids of consecutive parts of ``text``, as bytes."""
        parts = self.merges.special_split.split(text) if self.merges.special_split and "<|" in text else [text]
        for i, part in enumerate(parts):
            if i % 2:
                yield np.array([self.merges.special[part]], self.dtype).tobytes()
                continue
            for segment in self.segments(part):
                yield self.segment_ids(segment)

    def segment_ids(self, segment: str) -> bytes:
        """A single space between other characters always begins a token: what follows it is looked up as one unit."""
        if any(c in segment for c in _BESIDE_SPACE) if segment.isascii() else self.spaced.search(segment):
            return b"".join(map(self.memo.__getitem__, self.split(segment)))
        first, *rest = segment.split(" ")
        return b"".join([*map(self.memo.__getitem__, self.split(first)), *map(self.units.__getitem__, rest)])

    def encode_bytes(self, text: str) -> bytes:
        return b"".join(self.pieces(text))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), self.dtype)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.merges.token_bytes.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded text.

        The text is decoded from its ids. A valid text decodes to valid UTF-8; where bytes are not valid, the
        replacement character stands for them, as in the library.
        """
        ids_hash, decoded, raw, n, comma, invalid = hashlib.sha256(), hashlib.sha256(), [], 0, "", False
        for data in filter(None, self.pieces(text)):
            ids = np.frombuffer(data, self.dtype).tolist()
            ids_hash.update((comma + "".join(map(self.decimal.__getitem__, ids))[:-1]).encode())
            comma = ","
            n += len(ids)
            piece = b"".join(map(self.merges.token_bytes.__getitem__, ids))
            raw.append(piece)
            decoded.update(piece)
            try:
                piece.decode()
            except UnicodeDecodeError:
                invalid = True
        if invalid:
            decoded = hashlib.sha256(b"".join(raw).decode("utf-8", "replace").encode())
        return n, ids_hash.hexdigest(), decoded.hexdigest()


@lru_cache(maxsize=2)
def byte_level(path: str) -> ByteLevelBpe:
    """One encoder per worker and file."""
    return ByteLevelBpe(path)


def whole_text(text: str | Column = "text") -> Column:
    """A text column with nulls as empty texts."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column.cast("string"), F.lit(""))


def bpe_digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: the key, n_tokens, ids_sha256 and decoded_sha256 of its text.

    Null text: as empty. Repeated rows give repeated results; an empty table gives none; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("doc_id"), whole_text(text).alias("body"))

    def run(batches):
        coder = byte_level(path)
        coder.memo.alone(coder.units)
        for batch in batches:
            found = [coder.digest(t) for t in batch.column(1).to_pylist()]
            n, ids, decoded = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with a column ``out`` (array<int>) of the ids of ``text``; a column of that name is replaced.

    Null text: an empty array. All other columns are kept as they are.
    """
    kept = [c for c in docs.columns if c not in (out, text)]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], whole_text(text).alias(text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text) + f", `{out}` array<int>"

    def run(batches):
        coder = byte_level(path)
        coder.memo.alone(coder.units)
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            ids = [coder.encode(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            ends = [0, *accumulate(map(len, ids))]
            values = np.concatenate(ids).astype(np.int32) if ids else np.array([], np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*kept, out])

    return rows.mapInArrow(run, schema.removeprefix(", "))


def bpe_decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``encoded`` with its ids decoded to text in ``out``; null ids decode to an empty text."""
    kept = [c for c in encoded.columns if c not in (out, ids)]
    rows = encoded.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias(ids))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != ids) + f", `{out}` string"

    def run(batches):
        coder = byte_level(path)
        for batch in batches:
            texts = [coder.decode(np.array(x, np.int64)) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*kept, out])

    return rows.mapInArrow(run, schema.removeprefix(", "))


def op3_bpe_roundtrip(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_digests(docs, default_tokenizer("byte_bpe_50k.json"))
