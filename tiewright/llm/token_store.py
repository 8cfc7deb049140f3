"""Token ids in binary segments with Elias-Fano encoded document boundaries.

A store is a Parquet folder. Documents lie in ascending order of their id; a row is a segment of whole documents: their ids
one after the other as little-endian unsigned integers of 2 or 4 bytes, and the offsets at which documents begin and the
last one ends, as an Elias-Fano sequence: the low bits of each offset packed, the high bits as a unary bit vector with the
position of every 64th set bit as a 32-bit sample. That is about 2 + log2(ids / documents) bits for a document.
"""

from __future__ import annotations

import os
import uuid
import zlib
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiewright.llm.bpe import SEGMENT_CHARS, default_tokenizer, whole_text
from tiewright.sources.tables import shared_dir

END = 2
#: A segment is closed when it has as many bytes of ids or as many documents.
SEGMENT_BYTES, SEGMENT_DOCS = 4 << 20, 8192
SAMPLE = 64


class EliasFano:
    """A non-decreasing sequence of ``n`` offsets up to ``top``."""

    def __init__(self, n: int, top: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.top, self.low, self.high, self.samples = n, top, low, high, samples
        self.width = self.low_bits(n, top)

    @staticmethod
    def low_bits(n: int, top: int) -> int:
        return max(0, (top // max(n, 1)).bit_length() - 1)

    @classmethod
    def encode(cls, offsets) -> EliasFano:
        values = np.asarray(offsets, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = cls.low_bits(n, top)
        low = ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8).ravel()
        ones = (values >> width) + np.arange(n)
        high = np.zeros((top >> width) + n + 1, np.uint8)
        high[ones] = 1
        pack = lambda bits: np.packbits(bits, bitorder="little").tobytes()
        return cls(n, top, pack(low), pack(high), ones[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The offset number ``i``: from its sample, bytes of the high bits are counted until its set bit is met."""
        left, at = i % SAMPLE, int(np.frombuffer(self.samples, "<u4")[i // SAMPLE])
        byte = at >> 3
        word = self.high[byte] >> (at & 7) << (at & 7)
        while left >= (ones := word.bit_count()):
            left, byte = left - ones, byte + 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        place = 8 * byte + (word & -word).bit_length() - 1
        begin, value = i * self.width, place - i
        low = int.from_bytes(self.low[begin >> 3 : (begin + self.width + 7) >> 3], "little") >> (begin & 7) & ((1 << self.width) - 1)
        return value << self.width | low

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little", count=self.n * self.width).reshape(self.n, self.width).astype(np.int64)
        return ((ones - np.arange(self.n)) << self.width) | (low << np.arange(self.width)).sum(1, dtype=np.int64)


#: What makes a text more than the sum of its units, but for white space at its ends.
_ODD = ("  ", " \n", "\n ", "\n\n\n", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))


class LibraryEncoder:
    """The tokenizers library's ids as bytes, for byte-level files, with a table of the units already encoded.

    A single space or line break between other characters begins a token, so a text is the sum of its units: what follows a
    space, or a line break with it. New units go through the library together, on a line each: no token spans a line's end,
    and the line break is a token of its own. Texts with other white space, runs of it, or special tokens in them go through
    the library whole.
    """

    #: Units of a generation, of which two are kept (what is met again passes from the old one to the new one), and units
    #: encoded at once.
    MOST, AT_ONCE = 600_000, 4000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.contents = [t.content for t in self.library.get_added_tokens_decoder().values()]
        line_break = self.library.encode("\n", add_special_tokens=False).ids
        self.mark = line_break[0] if len(line_break) == 1 else None
        self.line_break = np.array(line_break, self.dtype).tobytes()
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def plain(self, text: str) -> bool:
        """Whether the text is the sum of its units."""
        if self.mark is None or any(c in text for c in self.contents):
            return False
        return text[:1] not in (" ", "\n") and text[-1:] not in (" ", "\n") and not any(c in text for c in _ODD)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()

    def join(self, several: list[list[str]]) -> list[bytes]:
        """The ids of several lists of units."""
        if len(self.known) > self.MOST:
            self.old, self.known = self.known, {}
        found, open_, new = [], [], {}
        for units in several:
            ids = list(map(self.known.get, units))
            found.append(ids)
            if None in ids:
                at = [i for i, x in enumerate(ids) if x is None]
                lacking = [units[i] for i in at]
                for unit in lacking:
                    if (known := self.old.get(unit)) is None:
                        new[unit] = None
                    else:
                        self.known[unit] = known
                open_.append((ids, at, lacking))
        self.learn(list(new))
        for ids, at, lacking in open_:
            for i, ids[i] in zip(at, map(self.known.__getitem__, lacking)):
                pass
        return [b"".join(ids) for ids in found]

    def learn(self, new: list[str]) -> None:
        if "\n" in new:
            new.remove("\n")  # an empty line
        self.known["\n"] = self.line_break
        width = self.dtype.itemsize
        for at in range(0, len(new), self.AT_ONCE):
            some = new[at : at + self.AT_ONCE]
            joined = "\n".join([u[1:] if u[0] in "\n\r" else f" {u}" for u in some]) + "\n"
            ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.dtype)
            ends = (np.flatnonzero(ids == self.mark) * width).tolist()
            data, start = ids.tobytes(), 0
            for unit, end in zip(some, ends):
                self.known[unit] = self.line_break + data[start:end] if unit[0] == "\n" else data[start:end]
                start = end + width

    @staticmethod
    def units(text: str, first: str = "\r") -> list[str]:
        found: list[str] = []
        for line in text.split("\n"):
            words = line.split(" ")
            words[0] = first + words[0]
            found += words
            first = "\n"
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; texts are taken together up to SEGMENT_CHARS characters."""
        out: list[bytes] = []
        held: list[list[str] | bytes] = []
        size = 0

        def flush():
            joined = iter(self.join([x for x in held if not isinstance(x, bytes)]))
            out.extend(x if isinstance(x, bytes) else next(joined) for x in held)
            held.clear()

        for text in texts:
            if len(text) > SEGMENT_CHARS and self.plain(text):
                flush()
                size, parts, first = 0, [], "\r"
                while text:
                    cut = text.find(" ", SEGMENT_CHARS)
                    piece, text = (text, "") if cut < 0 else (text[:cut], text[cut + 1 :])
                    parts += self.join([self.units(piece, first)])
                    first = ""
                out.append(b"".join(parts))
                continue
            held.append(self.units(text) if text and self.plain(text) else self.whole(text) if text else b"")
            size += len(text)
            if size > SEGMENT_CHARS:
                flush()
                size = 0
        flush()
        return out


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _store_schema(id_type: str) -> str:
    return f"shard int, segment int, shard_start long, n_docs int, n_ids long, id_bytes int, doc_ids array<{id_type}>, ids binary, ends_low binary, ends_high binary, ends_samples binary"


def write_store(docs: DataFrame, path: str, folder: str, end: int = END, text: str = "text", key: str = "doc_id") -> None:
    """Encode the texts of ``docs`` in ascending order of the key, each followed by ``end``, and write them to ``folder``.

    Null texts count as empty: one id, the end. Rows with a null key come first; rows with equal keys follow each other in
    the order of their texts. Texts are dealt out by ranges of the key and encoded where they are written; a very long one is
    encoded in pieces. Repeated rows are written each; an empty table gives a store without rows; other columns are not read.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("doc_id"), whole_text(text).alias("body")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "body")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        coder, shard = library_encoder(path), TaskContext.get().partitionId()
        stop = np.array([end], coder.dtype).tobytes()
        unit, segment, begin = coder.dtype.itemsize, 0, 0
        keys, parts, size = [], [], 0

        def close():
            sizes = [len(p) // unit for p in parts]
            ends = EliasFano.encode([0, *accumulate(sizes)])
            key_array = pa.concat_arrays(keys)
            lists = pa.ListArray.from_arrays(pa.array([0, len(key_array)], pa.int32()), key_array)
            one = lambda v, t: pa.array([v], t)
            return pa.RecordBatch.from_arrays([one(shard, pa.int32()), one(segment, pa.int32()), one(begin, pa.int64()), one(len(parts), pa.int32()), one(sum(sizes), pa.int64()), one(unit, pa.int32()), lists, one(b"".join(parts), pa.binary()), one(ends.low, pa.binary()), one(ends.high, pa.binary()), one(ends.samples, pa.binary())], names=[x.split()[0] for x in _store_schema("x").split(", ")])

        for batch in batches:
            for i, ids in enumerate(coder.encode(batch.column(1).to_pylist())):
                keys.append(batch.column(0).slice(i, 1))
                parts.append(ids + stop)
                size += len(parts[-1])
                if size >= SEGMENT_BYTES or len(parts) >= SEGMENT_DOCS:
                    yield close()
                    segment, begin = segment + 1, begin + size // unit
                    keys, parts, size = [], [], 0
        if parts:
            yield close()

    rows.mapInArrow(run, _store_schema(id_type)).write.parquet(folder)


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for each document of a store, start counting the ids of all before it.

    Documents are located by select. Only the sizes of shards, one row for each, pass through the driver. A store without
    rows gives none.
    """
    stored = spark.read.parquet(folder)
    sizes = stored.groupBy("shard").agg(F.sum("n_ids")).orderBy("shard").collect()
    firsts = dict(zip([s for s, _ in sizes], accumulate([0, *(n for _, n in sizes)])))
    id_type = stored.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for i, row in enumerate(batch.drop_columns(["doc_ids"]).to_pylist()):
                bounds = EliasFano(row["n_docs"] + 1, row["n_ids"], row["ends_low"], row["ends_high"], row["ends_samples"])
                ends = np.array([bounds.select(k) for k in range(row["n_docs"] + 1)], np.int64)
                ids = np.frombuffer(row["ids"], f"<u{row['id_bytes']}")
                sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                keys = batch.column("doc_ids").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([keys, pa.array(ends[:-1] + firsts[row["shard"]] + row["shard_start"]), pa.array(np.diff(ends)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return stored.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def document_ids(stored_row, i: int) -> np.ndarray:
    """The ids of document number ``i`` of a segment, located by two selects."""
    ends = EliasFano(stored_row.n_docs + 1, stored_row.n_ids, bytes(stored_row.ends_low), bytes(stored_row.ends_high), bytes(stored_row.ends_samples))
    return np.frombuffer(bytes(stored_row.ids), f"<u{stored_row.id_bytes}")[ends.select(i) : ends.select(i + 1)]


def op8_token_store(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer("byte_bpe_50k.json"), folder)
    return read_store(spark, folder)
