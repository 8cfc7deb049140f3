"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A document contains an item if at least ``threshold`` of the item's distinct word shingles occur in it. Items are partitioned
by size, partition p holding those of 2^p to 2^(p+1)-1 shingles. An item's sketch is its smallest hash values, as many as its
partition needs: an item with containment t misses at most (1-t) of its shingles, so floor((1-t) * largest size) + 1 values
always include one that the document has. A document's hashes are looked up in the sketches whatever the document's length;
every candidate is then verified by comparing the shingles themselves. So no passage is lost, however long the document.

Items are taken in blocks of about ``BLOCK_BYTES`` of text, the only data that is broadcast. A larger benchmark takes more
passes over the documents, one after the other: what a pass finds or keeps is written, and its index is given back, before the
next block is read, so that one block is in memory at any time.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiewright.llm.bpe import _Memo, whole_text
from tiewright.sources.tables import materialize

WIDTH, THRESHOLD = 5, 0.8
BLOCK_BYTES = 16 << 20
WORD = re.compile(r"[^\W_]+")
_FACTORS = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_FILTER_BITS = 20


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingle_set(words: list[str], width: int) -> set[tuple[str, ...]]:
    return set(zip(*(words[i:] for i in range(width)))) if len(words) >= width else set()


_word_hash = _Memo(lambda word: xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of consecutive shingles from the hashes of the words."""
    n = len(words) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total += words[i : i + n] * _FACTORS[i]
    total ^= total >> np.uint64(29)
    total *= _FACTORS[0]
    return total ^ (total >> np.uint64(32))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_word_hash.__getitem__, words), np.uint64, len(words))


class ContainmentIndex:
    """Sketches and shingles of a block of items. Items without words match nothing; shorter ones are one shingle."""

    def __init__(self, items: list[tuple], threshold: float = THRESHOLD, width: int = WIDTH):
        self.threshold = threshold
        self.items: list[tuple] = []  # (item_id, width, distinct shingles)
        sketches: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            words = words_of(text or "")
            if not words:
                continue
            k = min(width, len(words))
            shingles = shingle_set(words, k)
            hashes = np.unique(shingle_hashes(word_hashes(words), k))
            largest = (1 << len(shingles).bit_length()) - 1  # of the item's size partition
            for h in hashes[: int((1 - threshold) * largest + 1e-9) + 1].tolist():
                sketches[k][h].append(len(self.items))
            self.items.append((item_id, k, shingles))
        self.widths = {}
        for k, sketch in sketches.items():
            keys = np.array(sorted(sketch), np.uint64)
            marks = np.zeros(1 << _FILTER_BITS, bool)
            marks[keys >> np.uint64(64 - _FILTER_BITS)] = True
            self.widths[k] = (keys, marks, [sketch[h] for h in keys.tolist()])

    def hits(self, text: str) -> list[tuple]:
        """(item_id, n_shingles, n_shared) of the items that ``text`` contains."""
        words = words_of(text)
        codes, candidates = word_hashes(words), set()
        for k, (keys, marks, owners) in self.widths.items():
            hashes = shingle_hashes(codes, k)
            hashes = hashes[marks[hashes >> np.uint64(64 - _FILTER_BITS)]]
            if len(hashes):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                for i in np.unique(at[keys[at] == hashes]).tolist():
                    candidates.update(owners[i])
        found, have = [], {}
        for i in sorted(candidates):
            item_id, k, shingles = self.items[i]
            if k not in have:
                have[k] = shingle_set(words, k)
            shared = len(shingles & have[k])
            if shared >= self.threshold * len(shingles):
                found.append((item_id, len(shingles), shared))
        return found


def _blocks(items: DataFrame, threshold: float, width: int, key: str, text: str):
    """(broadcast index, whether it is the last) for each block of items, the blocks being dealt by a hash of the item."""
    rows = items.select(F.col(key).alias("item_id"), whole_text(text).alias("body"))
    size = rows.agg(F.sum(F.octet_length("body") + 32)).first()[0] or 0
    count = -(-size // BLOCK_BYTES)
    for i in range(count):
        block = rows.where(F.pmod(F.xxhash64("item_id", "body"), F.lit(count)) == i).collect() if count > 1 else rows.collect()
        yield rows.sparkSession.sparkContext.broadcast(ContainmentIndex([tuple(r) for r in block], threshold, width)), i + 1 == count


def containments(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) for every document row and item it contains.

    Null and empty texts contain nothing, and contain no item; a document is searched whole, however long. Repeated documents
    or items give repeated rows; without documents or items there are none. Other columns are not read.
    """
    rows = docs.select(F.col(key).alias("doc_id"), whole_text(text).alias("body"))
    doc_type, item_type = rows.schema["doc_id"].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"doc_id {doc_type}, item_id {item_type}, n_shingles long, n_shared long"
    out = rows.sparkSession.createDataFrame([], schema)
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_item = to_arrow_type(items.schema[item_key].dataType)
    for index, last in _blocks(items, threshold, width, item_key, item_text):

        def run(batches, index=index):
            _word_hash.alone()
            for batch in batches:
                ids = batch.column(0)
                found = [(i, *hit) for i, t in enumerate(batch.column(1).to_pylist()) for hit in index.value.hits(t)]
                at, item, size, shared = zip(*found) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(item, arrow_item), pa.array(size, pa.int64()), pa.array(shared, pa.int64())], names=["doc_id", "item_id", "n_shingles", "n_shared"])

        found = rows.mapInArrow(run, schema)
        if not last:
            found = materialize(found, "hits")
            index.destroy()
        out = out.unionByName(found)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def without_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns, whatever their names.

    Rows with null or empty texts stay, repeated rows stay repeated, and without items all rows stay. A document is searched
    whole, however long.
    """
    for index, last in _blocks(items, threshold, width, item_key, item_text):

        @F.pandas_udf("boolean")
        def clean(texts, index=index):
            _word_hash.alone()
            return texts.map(lambda t: not index.value.hits(t))

        docs = docs.where(clean(whole_text(text)))
        if not last:
            docs = materialize(docs, "kept")
            index.destroy()
    return docs


def op4_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return containments(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Items of fewer than five words are left to the tests: the benchmark has none.
SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM benchmark
), bs AS (
  SELECT DISTINCT item_id, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4] AS s
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM b WHERE len(ws) >= 5)
), n AS (
  SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id
), ds AS (
  SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4] AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
)
SELECT ds.doc_id, bs.item_id, n.n_shingles, count(*) AS n_shared, count(*)::DOUBLE / n.n_shingles AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY ds.doc_id, bs.item_id, n.n_shingles
HAVING count(*) >= 0.8 * n.n_shingles
"""
