"""Joins whose hot keys are not left to one task, and column names that clash with no other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than one in so many of the rows; there can be no more hot keys than that.
HOT_SHARE = 1000


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hot_keys(counts: DataFrame, key: str) -> DataFrame:
    """The keys of ``counts`` (each once, with ``n`` rows) that have more than 1/HOT_SHARE of all rows: HOT_SHARE at most."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return counts.where(F.col("n") * HOT_SHARE > F.lit(total)).select(key)


def join_spread(rows: DataFrame, side: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """Join (inner or left) of ``rows`` with ``side``, which has each key at most once, on the column ``key``.

    Rows whose key is in ``hot``, at most HOT_SHARE keys, meet the few rows of ``side`` by a broadcast; all others are
    joined by a shuffle.
    """
    hot = F.broadcast(hot)
    met = rows.join(hot, key, "left_semi").join(F.broadcast(side.join(hot, key, "left_semi")), key, how)
    return met.unionByName(rows.join(hot, key, "left_anti").join(side, key, how))


def join_counted(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` with ``side``, which has each key once and ``n``, how many rows have it; n is not in the result."""
    return join_spread(rows, side.drop("n"), key, hot_keys(side, key))
