"""Canonical exact digests of documents, as DataFrame expressions only.

The canonical form of a text is its Unicode composition (NFC), its full case folding, that composed again, with every run of
white space as one space and none at the ends. Its fingerprint is 128 bits of xxhash: two 64-bit values over the bytes and,
apart from these, over the bytes behind a prefix. Texts are grouped by fingerprint; inside a bucket the canonical bytes
themselves are compared. Texts are taken whole, however long; null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiewright.llm.bpe import whole_text
from tiewright.llm.skew import join_counted
from tiewright.sources.tables import materialize


def canonical(text: Column) -> Column:
    """The canonical form; composition and folding are the ICU library's, which comes with Spark."""

    def composed(c: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))

    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(text), F.lit(True))
    form = F.when(text.rlike(r"[^\x00-\x7F]"), composed(folded)).otherwise(F.lower(text))
    return F.btrim(F.regexp_replace(form, r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "))


def digest(canon: Column) -> Column:
    """32 hexadecimal digits: two xxhash values of the canonical text."""
    word = lambda c: F.lpad(F.hex(c), 16, "0")
    return F.lower(F.concat(word(F.xxhash64(canon)), word(F.xxhash64(F.lit("second"), canon))))


def fingerprint(text: Column) -> Column:
    return digest(canonical(text))


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(fingerprint, canon_sha256, group_id, n_copies) for each canonical text: group_id is the smallest key that has it.

    Rows are dealt by fingerprint, and grouping by the text besides makes Spark compare the bytes within equal fingerprints.
    Copies are folded before the shuffle. Texts that differ and agree in fingerprint and SHA-256 stop the query rather than
    share a group. Null texts count as empty; repeated rows count as copies; an empty table gives an empty result.
    """
    rows = docs.select(F.col(key).alias("doc_id"), canonical(whole_text(text)).alias("canon")).withColumn("fingerprint", digest(F.col("canon")))
    texts = rows.groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n_copies"))
    buckets = texts.groupBy("fingerprint", F.sha2("canon", 256).alias("canon_sha256")).agg(F.min("group_id").alias("group_id"), F.sum("n_copies").alias("n_copies"), F.count("*").alias("n_texts"))
    one = F.when(F.col("n_texts") == 1, F.col("n_copies")).otherwise(F.raise_error(F.lit("different texts share a fingerprint and a SHA-256")).cast("long"))
    return buckets.select("fingerprint", "canon_sha256", "group_id", one.alias("n_copies"))


#: Splits of the key's ranges in one block; a row's range is found among the blocks' ends, then inside one block.
BLOCK = 128


def _range_of(key: Column, splits: list) -> Column:
    """How many of the ascending ``splits`` do not exceed the key; 0 for a null key."""
    if not splits:
        return F.lit(0)
    blocks = [splits[i : i + BLOCK] for i in range(0, len(splits), BLOCK)]
    below = lambda values: F.size(F.filter(values, lambda s: s <= key))
    array = lambda values: F.array(*map(F.lit, values)) if values else F.filter(F.array(F.lit(splits[0])), lambda s: F.lit(False))
    block = below(array([b[-1] for b in blocks]))
    inside = below(F.element_at(F.array(*map(array, [*blocks, []])), block + 1)) if len(blocks) > 1 else below(array(splits))
    return F.coalesce(F.when(key.isNotNull(), F.least(block * BLOCK + inside, F.lit(len(splits))) if len(blocks) > 1 else inside), F.lit(0))


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, body, next_body): each text with that of the next row in ascending order of the key, the last with the first.

    Keys may be of any type that has an order. Rows with a null key come first, and rows with equal keys follow each other by
    text. Spark's own range partitioner bounds the ranges, as many as shuffle partitions; only the least key of each range
    comes to the driver. A range is one partition and one window, and the rows of its least key are also sent to the end of
    the range before it. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(key).alias("doc_id"), whole_text(text).alias("body"))
    keys = rows.select("doc_id").where("doc_id IS NOT NULL").repartitionByRange(parts, "doc_id")
    least = sorted(r[1] for r in keys.groupBy(F.spark_partition_id()).agg(F.min("doc_id")).collect())
    placed = rows.withColumn("range", _range_of(F.col("doc_id"), least[1:]))
    heads, target = [], {}
    if least:
        heads.append(F.col("doc_id").isin(least))
        target = {i: (i - 1) % len(least) for i in range(len(least))}
    # rows with a null key are the head of the first range, if there are any
    without_key = bool(rows.where("doc_id IS NULL").limit(1).count())
    if without_key:
        heads = [F.col("doc_id").isNull(), *[h & (F.col("range") > 0) for h in heads]]
        target = target or {0: 0}
    if not heads:
        return rows.withColumn("next_body", F.col("body"))
    before = F.when(F.col("range") > 0, F.col("range") - 1).otherwise(len(target) - 1)
    first = placed.where(heads[0] if len(heads) == 1 else heads[0] | heads[1]).withColumn("range", before)
    both = placed.withColumn("tail", F.lit(False)).unionByName(first.withColumn("tail", F.lit(True))).repartitionByRange(parts, "range")
    window = Window.partitionBy("range").orderBy("tail", F.col("doc_id").asc_nulls_first(), "body")
    return both.withColumn("next_body", F.lead("body").over(window)).where(~F.col("tail")).select("doc_id", "body", "next_body")


def edited(body: Column, following: Column) -> Column:
    """The text with its last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    n = F.char_length(body)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(body, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def likeness(fp_a: Column, canon_a: Column, fp_b: Column, canon_b: Column) -> Column:
    """1 for equal fingerprints over equal bytes, else 0: an exact digest knows no degrees."""
    return F.when((fp_a == fp_b) & (canon_a == canon_b), F.lit(1.0)).otherwise(F.lit(0.0))


def edit_report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are to each other and to the next text's.

    One row for each row of ``docs``, repeated ones too; other columns are not read.
    """
    rows = with_next(docs, text, key).withColumn("edited", edited(F.col("body"), F.col("next_body")))
    rows = rows.select("doc_id", F.char_length("body").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *[canonical(F.col(c)).alias(c) for c in ("body", "edited", "next_body")])
    rows = rows.withColumns({"fingerprint": digest(F.col("body")), "edited_fingerprint": digest(F.col("edited")), "next_fingerprint": digest(F.col("next_body"))})
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("body"), F.col("edited_fingerprint"), F.col("edited")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("body"), F.col("next_fingerprint"), F.col("next_body")).alias("near_next"),
        F.sha2("body", 256).alias("canon_sha256"),
    )


def with_groups(report: DataFrame, groups: DataFrame) -> DataFrame:
    """The report's rows with group_id and n_copies; texts that very many rows share are met by a bounded broadcast."""
    both = lambda df: df.withColumn("canon_key", F.concat("fingerprint", "canon_sha256"))
    side = both(groups).select("canon_key", "group_id", "n_copies", F.col("n_copies").alias("n"))
    return join_counted(materialize(both(report), "report"), side, "canon_key").drop("canon_key", "canon_sha256")


def op9_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """The edit report, each row with the group of equal canonical texts and its size."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return with_groups(edit_report(docs), materialize(exact_groups(docs), "groups"))
