"""Ranks over whole tables and values at fixed places, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiewright.operators.scan import Scan, in_ranges, scanned
from tiewright.sources.tables import materialize


def global_rank(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """``df`` with ``out``, each row's place from 1 in a total order (FIL9, WIN11).

    Rows are dealt by ranges of the order and numbered within each; the numbers of rows of the ranges before are added. Only
    one number a range meets in one place. The ranges are written first, so that they are the same for both readings.
    """
    names = [f"__o{i}" for i in range(len(order))]
    dealt = df.withColumns({n: c for n, c in zip(names, [F.col(c) if isinstance(c, str) else c for c in order])})
    dealt = materialize(dealt.repartitionByRange(*names).withColumn("__part", F.spark_partition_id()), "ranges")
    local = dealt.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*names)))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__size"))
    before = sizes.withColumn("__before", F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).drop("__size")
    return local.join(F.broadcast(before), "__part").withColumn(out, F.col("__n") + F.col("__before")).drop("__part", "__n", "__before", *names)


def values_at(df: DataFrame, value: str, by: list[str], places: dict[str, float | Callable[[Column], Column]]) -> DataFrame:
    """(by, n, name...): in each group the value at place floor(f * n), from 0, of the sorted values, for each name and f.

    Instead of a number f, a place may be a function of the column n. Equal values are counted before anything is sorted; the
    counts are dealt by ranges of group and value, and running sums over the ranges find the places: neither a row nor a task
    holds a whole group, however few groups there are. Null values are left out, null groups are groups.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    ranged = in_ranges(counts, [*by, "__v"])
    running = scanned(ranged, __run=Scan("sum", F.col("__c"), True, tuple(by)))
    groups = [F.col(c).alias(f"__g{i}") for i, c in enumerate(by)]
    totals = counts.groupBy(*groups).agg(F.sum("__c").alias("__n"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(by)], F.lit(True))
    at = {name: f(F.col("__n")) if callable(f) else F.floor(F.col("__n") * f) for name, f in places.items()}
    found = [F.min(F.when(F.col("__run") > place, F.col("__v"))).alias(name) for name, place in at.items()]
    return running.join(totals, same).groupBy(*by).agg(F.max("__n").alias("n"), *found)
