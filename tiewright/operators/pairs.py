"""Pairs of rows that share a key, with no task for a whole large key (JN15, AGG13, GR20)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key up to which its pairs are made in one piece.
BLOCK = 1000


def self_pairs(rows: DataFrame, key: str, item: str, block: int | None = None) -> DataFrame:
    """(key, a, b): for every key all ordered pairs of two different items of it; ``rows`` has each (key, item) once.

    Keys of more than ``block`` items are dealt out as squares of blocks: an item stands in one block of its key and meets
    every other block in a square of its own, so a square has about ``block`` items on a side, however large the key. Other
    keys are one square, and their rows are not repeated. Null keys and items are in no pair.
    """
    block = BLOCK if block is None else block
    held = rows.select(F.col(key).alias("__k"), F.col(item).alias("__i")).dropna()
    sizes = held.groupBy("__k").agg(F.ceil(F.count("*") / block).cast("int").alias("__parts"))
    dealt = held.join(sizes, "__k").withColumn("__own", F.pmod(F.xxhash64("__i"), F.col("__parts")).cast("int")).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    left = dealt.select("__k", F.col("__own").alias("__x"), F.col("__other").alias("__y"), F.col("__i").alias("a"))
    right = dealt.select("__k", F.col("__other").alias("__x"), F.col("__own").alias("__y"), F.col("__i").alias("b"))
    return left.join(right, ["__k", "__x", "__y"]).where("a <> b").select(F.col("__k").alias(key), "a", "b")
