"""Aggregations that profile a table (AGG5, AGG9, AGG13, AGG20 to AGG26, ST18, ST20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiewright.operators.pairs import self_pairs
from tiewright.operators.ranking import values_at


def filled(column: Column) -> Column:
    """Whether a text column has something: null, empty and blank count as missing."""
    return F.nullif(F.trim(column.cast("string")), F.lit("")).isNotNull()


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_filled, n_rows, share) for each column, in one pass (AGG5)."""
    sums = df.agg(F.count("*").alias("n_rows"), *[F.count_if(filled(F.col(c))).alias(f"__{c}") for c in columns])
    pairs = ", ".join(f"'{c}', `__{c}`" for c in columns)
    return sums.selectExpr("n_rows", f"stack({len(columns)}, {pairs}) AS (column, n_filled)").select("column", "n_filled", "n_rows", (F.col("n_filled") / F.col("n_rows")).alias("share"))


def z_scores(df: DataFrame, values: dict[str, str], by: str | None = None) -> DataFrame:
    """``df`` with a column for each of ``values`` (its name: the value's): distances from the mean in population standard
    deviations, a deviation of 0 counting as 1, within groups of ``by`` or over all rows (AGG9).

    Means and deviations come from one aggregate, joined back: a row for all, or one for each group. Null groups are groups.
    """
    shown = list(values.items())
    moments = [f(v).alias(f"__{m}{i}") for i, (_, v) in enumerate(shown) for m, f in (("m", F.avg), ("s", F.stddev_pop))]
    if by:
        sums = df.groupBy(F.col(by).alias("__by")).agg(*moments)
        joined = df.join(sums, df[by].eqNullSafe(sums["__by"])).drop("__by")
    else:
        joined = df.crossJoin(F.broadcast(df.agg(*moments)))
    scores = {out: (F.col(v) - F.col(f"__m{i}")) / F.coalesce(F.nullif(F.col(f"__s{i}"), F.lit(0.0)), F.lit(1.0)) for i, (out, v) in enumerate(shown)}
    return joined.withColumns(scores).drop(*[f"__{m}{i}" for i in range(len(shown)) for m in "ms"])


def upper_medians(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, upper_median): the value at position n div 2 of the sorted values of a group, not interpolated (AGG25)."""
    return values_at(df, value, by, {"upper_median": 0.5})


def equal_count_quartiles(df: DataFrame, order: list[Column], by: list[str]) -> DataFrame:
    """``df`` with quartile 0 to 3: blocks of n div 4 rows, the remainder in the last (AGG22)."""
    n = F.count("*").over(Window.partitionBy(*by))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn("quartile", F.least(F.lit(3), F.floor(place / F.greatest(F.floor(n / 4), F.lit(1)))).cast("int"))


def index_cut_quartiles(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``df`` with stratum 0 to 3: the number of the cuts v[int(f * n)], f in 1/4, 1/2, 3/4, that the value exceeds (AGG23)."""
    cuts = values_at(df, value, by, {"__c0": 0.25, "__c1": 0.5, "__c2": 0.75}).drop("n")
    joined = df.join(cuts, by)
    return joined.withColumn("stratum", sum((F.col(value) > F.col(f"__c{i}")).cast("int") for i in range(3))).drop("__c0", "__c1", "__c2")


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Interpolated quartiles, and the farthest values within 1.5 quartile distances of them (AGG24); null groups are left out.

    The quartiles lie between the values at two places of the sorted group, which running counts over ranges find.
    """
    ends = {f"__{q}{side}": lambda n, p=p, f=f: f((n - 1) * p) for q, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)) for side, f in (("lo", F.floor), ("hi", F.ceil))}
    found = values_at(df.where(F.col(by).isNotNull()), value, [by], ends)
    between = lambda q, p: F.col(f"__{q}lo") + ((F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)) * (F.col(f"__{q}hi") - F.col(f"__{q}lo"))
    q = found.select(by, *[between(name, p).alias(name) for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.join(q, by).where(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach))
    return inside.groupBy(by).agg(*[F.first(c).alias(c) for c in ("q1", "median", "q3")], F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n_inside"))


def conditional_matrix(held: DataFrame, holder: str, item: str) -> DataFrame:
    """(row_item, col_item, n, share): holders of the row's item who also hold the column's; no diagonal (AGG13)."""
    distinct = held.select(holder, item).distinct()
    totals = distinct.groupBy(item).agg(F.count("*").alias("total"))
    both = self_pairs(distinct, holder, item).groupBy(F.col("a").alias("row_item"), F.col("b").alias("col_item")).agg(F.count("*").alias("n"))
    return both.join(totals, both.row_item == totals[item]).select("row_item", "col_item", "n", (F.col("n") / F.col("total")).alias("share"))


def vote(votes: DataFrame, entity: str, category: str, weight: str) -> DataFrame:
    """(entity, winner, total, runner_up, tied): weights summed by category; ties go to the first name (AGG17).

    A tie with the runner-up is marked, so that callers can lower their confidence.
    """
    sums = votes.groupBy(entity, category).agg(F.sum(weight).alias("total"))
    ranked = sums.withColumn("__r", F.row_number().over(Window.partitionBy(entity).orderBy(F.desc("total"), category)))
    top = lambda r, c: F.max(F.when(F.col("__r") == r, F.col(c)))
    out = ranked.where("__r <= 2").groupBy(entity).agg(top(1, category).alias("winner"), top(1, "total").alias("total"), top(2, category).alias("runner_up"), top(2, "total").alias("__second"))
    return out.withColumn("tied", F.coalesce(F.col("total") == F.col("__second"), F.lit(False))).drop("__second")
