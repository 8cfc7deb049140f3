"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text longer than ``CHUNK_CHARS`` is encoded in overlapping chunks. Each chunk gives the start offsets of its units (runs
between white space) and their token counts. Two neighbouring chunks are spliced at a start offset that both have, that lies
in their overlap, and that follows white space in the text. There the cut is proven: normalisation never composes over
white space, the word pattern never crosses it, and merges stay inside words. Where the overlap holds no such offset, it is
widened, doubling until one is found or the text ends.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiewright.llm.bpe import _SEPARATORS, WHITE_SPACE, Merges, _Memo, category_class, default_tokenizer, whole_text

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 256


def lower_each(text: str) -> str:
    """Lower case character by character: the sigma at a word's end has no form of its own."""
    return text.lower() if "Σ" not in text else "".join(map(str.lower, text))


class WordCounter:
    """Token counts for a file with NFC, white space and lower-case normalisers and words that end in a suffix."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        letters, numbers = category_class("L"), category_class("N")
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{WHITE_SPACE}{letters}{numbers}]+")
        self.units = re.compile(rf"[^{WHITE_SPACE}]+")
        self.word_memo = _Memo(lambda word: len(self.merges.word(word.encode())))
        self.memo = _Memo(self._count_unit)

    def _count_unit(self, unit: str) -> int:
        split = self.merges.special_split
        if split is None or "<|" not in unit:
            return self._count_words(unit)
        return sum(1 if i % 2 else self._count_words(part) for i, part in enumerate(split.split(unit)))

    def _count_words(self, unit: str) -> int:
        if not unit.isascii():
            unit = unicodedata.normalize("NFC", unit)
        return sum(map(self.word_memo.__getitem__, self.words.findall(lower_each(unit))))

    def count_plain(self, text: str) -> int:
        units = self.units.findall(text) if any(c in text for c in _SEPARATORS) else text.split()
        return sum(map(self.memo.__getitem__, units))

    def encode(self, text: str, begin: int, end: int) -> tuple[list[int], list[int]]:
        """Start offsets in ``text`` and token counts of the units of a chunk, as one who sees only the chunk finds them."""
        found = list(self.units.finditer(text, begin, end))
        return [m.start() for m in found], [self.memo[m.group()] for m in found]

    def count(self, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
        if len(text) <= chunk:
            return self.count_plain(text)
        total = begin = counted = 0  # units that start before ``counted`` are in ``total``
        while (following := begin + chunk) < len(text):
            width, cut = overlap, None
            while True:
                stop = min(len(text), following + width)
                starts, counts = self.encode(text, begin, stop)
                ahead = set(self.encode(text, following, stop)[0])
                cut = next((s for s in starts if s >= following and s in ahead and not self.units.match(text, s - 1)), None)
                if cut is not None or stop == len(text):
                    break
                width *= 2
            total += sum(c for s, c in zip(starts, counts) if counted <= s and (cut is None or s < cut))
            if cut is None:  # one unit reaches from before the next chunk to the text's end
                return total
            begin, counted = following, cut
        starts, counts = self.encode(text, begin, len(text))
        return total + sum(c for s, c in zip(starts, counts) if s >= counted)


@lru_cache(maxsize=2)
def word_counter(path: str) -> WordCounter:
    return WordCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: the key, n_bytes (UTF-8), n_tokens, and over_limit (n_tokens > limit).

    Null and empty texts have 0 tokens. Repeated rows give repeated results; an empty table gives none.
    """
    rows = docs.select(F.col(key).alias("doc_id"), whole_text(text).alias("body"))

    def run(batches):
        counter = word_counter(path)
        counter.memo.alone(counter.word_memo)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([counter.count(t) for t in texts], pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer("word_bpe_49k.json"))
