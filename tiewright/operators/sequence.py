"""Order-dependent operators (WIN1 to WIN16, SRT2, FIL8, FIL9)."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def frame(by: list[str], order: list) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def median_of(values: Column) -> Column:
    """Interpolated median of an array; null if it is empty."""
    v, n = F.array_sort(values), F.size(values)
    low, high = F.element_at(v, F.floor((n + 1) / 2).cast("int")), F.element_at(v, F.floor(n / 2).cast("int") + 1)
    return F.when(n > 0, (low + high) / 2)


def moving_median(value: str, by: list[str], order: list, reach: int = 4) -> Column:
    """Median of the ``reach`` rows on either side, the row itself left out; null where there are none (WIN1)."""
    w = frame(by, order)
    around = F.concat(F.collect_list(value).over(w.rowsBetween(-reach, -1)), F.collect_list(value).over(w.rowsBetween(1, reach)))
    return median_of(around)


def islands(starts: Column, by: list[str], order: list) -> Column:
    """Number of the group a row is in: one more at every row where ``starts`` holds; the first row always starts (WIN2, WIN3)."""
    w = frame(by, order)
    first = F.row_number().over(w) == 1
    return F.sum((F.coalesce(starts, F.lit(False)) | first).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))


def next_value(value: Column, when: Column, by: list[str], order: list, otherwise: str | None = None) -> Column:
    """``value`` of the nearest following row where ``when`` holds, the row itself left out (WIN4)."""
    found = F.first(F.when(when, value), ignorenulls=True).over(frame(by, order).rowsBetween(1, Window.unboundedFollowing))
    return found if otherwise is None else F.coalesce(found, F.lit(otherwise))


def alphabetical_window(df: DataFrame, key: str, anchor: str, plausible: str, by: list[str], order: list, wide: int = 6, narrow: int = 4) -> DataFrame:
    """``df`` with accepted and reason: rows whose key fits between the last accepted key and the next anchor (WIN5).

    The bound below depends on accepted rows only; a row refused for it lies below it and cannot raise it, so the running
    maximum over all rows that are anchors or pass the other conditions is the same bound.
    """
    short = lambda n: F.substring(F.regexp_replace(key, " ", ""), 1, n)
    w = frame(by, order)
    ahead = next_value(short(narrow), F.col(anchor), by, order, "￿")
    fits_above = F.col(anchor) | (F.col(plausible) & (short(narrow) <= ahead))
    last = F.max(F.when(F.col("__fits"), short(wide))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__fits", fits_above)
    reason = (
        F.when(F.col(anchor), "anchor").when(~F.col(plausible), "implausible")
        .when(F.col("__fits") & (F.coalesce(F.col("__last"), F.lit("")) <= short(wide)), "window").otherwise("outside")
    )
    out = df.withColumn("__last", last).withColumn("reason", reason)
    return out.withColumn("accepted", F.col("reason").isin("anchor", "window")).drop("__fits", "__last")


def nondecreasing_places(keys: list) -> list[int]:
    """Places (from 0) of a longest non-decreasing subsequence: the tails of each length, with links back (WIN6)."""
    tails: list = []
    ends: list[int] = []
    back: list[int] = []
    for i, k in enumerate(keys):
        at = bisect_right(tails, k)
        back.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(k)
            ends.append(i)
        else:
            tails[at], ends[at] = k, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def longest_nondecreasing(keys: Column) -> Column:
    """An array column's places (from 0) in a longest non-decreasing subsequence."""

    @F.pandas_udf("array<int>")
    def places(arrays):
        return arrays.map(lambda a: nondecreasing_places([] if a is None else list(a)))

    return places(keys)


def largest_gap(df: DataFrame, value: str, by: str, least: float = 0.0) -> DataFrame:
    """(by, gap, middle): the widest step between neighbouring values, the first of equal ones, if at least ``least`` (WIN8)."""
    w = frame([by], [value])
    steps = df.select(by, F.col(value).alias("hi"), F.lag(value).over(w).alias("lo")).where("lo IS NOT NULL")
    steps = steps.withColumn("gap", F.col("hi") - F.col("lo"))
    best = steps.groupBy(by).agg(F.max_by(F.struct("gap", ((F.col("hi") + F.col("lo")) / 2).alias("middle")), F.struct("gap", -F.col("lo"))).alias("x"))
    return best.select(by, "x.gap", "x.middle").where(F.col("gap") >= least)


def transitions(df: DataFrame, state: str, by: list[str], order: list) -> DataFrame:
    """(source, target, n): steps from a state to the next one of the same sequence; stays are left out (WIN9)."""
    step = df.select(F.col(state).alias("source"), F.lead(state).over(frame(by, order)).alias("target"))
    return step.where("source <> target").groupBy("source", "target").agg(F.count("*").alias("n"))


def mobility(df: DataFrame, state: str, by: str, order: list[str]) -> DataFrame:
    """(by, first, last, n_states, mobility): never left, returned, or ended elsewhere (WIN10)."""
    at = F.struct(*order)
    out = df.groupBy(by).agg(F.min_by(state, at).alias("first"), F.max_by(state, at).alias("last"), F.countDistinct(state).alias("n_states"))
    return out.withColumn("mobility", F.when(F.col("n_states") == 1, "never left").when(F.col("first") == F.col("last"), "returned").otherwise("ended elsewhere"))


def ranked(df: DataFrame, score: str, key: str, n: int | None = None) -> DataFrame:
    """Rows by falling score and then by key: a total order, so that a cut at n is the same every time (SRT2)."""
    out = df.orderBy(F.desc(score), F.asc(key))
    return out if n is None else out.limit(n)


def before_first(df: DataFrame, stop: Column, by: list[str], order: str) -> DataFrame:
    """Rows before the first one where ``stop`` holds (FIL8)."""
    cut = df.where(stop).groupBy(*by).agg(F.min(order).alias("__cut"))
    return df.join(cut, by, "left").where(F.col("__cut").isNull() | (F.col(order) < F.col("__cut"))).drop("__cut")
