"""Prefix scans over one long sequence, in two levels (WIN2 to WIN5, WIN13, WIN16).

Rows are dealt by ranges of a total order. Every range scans its own rows; of each range only what it hands on (a sum, a
greatest or last value) goes through one place, one row a range and segment; what the ranges before hand on is then combined
with the scan inside. No task sees more rows than a range has, however long the sequence or one of its segments is.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiewright.sources.tables import materialize

PART, PLACE = "__part", "__place"


@dataclass(frozen=True)
class Scan:
    """One column of a scan: ``sum``, ``max``, ``last`` or ``next`` of a column's values that are not null.

    ``sum``, ``max`` and ``last`` cover the rows before (and with ``inclusive`` the row itself), ``next`` the rows behind it.
    Without any value a sum is 0 and the others are null. Segments are runs of rows that agree in ``by``; a scan starts anew
    in each. A segment must be one run of the order: ``by`` may not come back later.
    """

    kind: str
    column: Column
    inclusive: bool = False
    by: tuple[str, ...] = field(default=())

    def _frame(self, inside: bool) -> Window:
        order = Window.partitionBy(PART, *self.by) if inside else Window.partitionBy(*self.by)
        order = order.orderBy(PLACE) if inside else order.orderBy(PART)
        if self.kind == "next":
            return order.rowsBetween(0 if self.inclusive and inside else 1, Window.unboundedFollowing)
        return order.rowsBetween(Window.unboundedPreceding, 0 if self.inclusive and inside else -1)

    def _over(self, column: Column, window) -> Column:
        fold = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True), "next": lambda c: F.first(c, ignorenulls=True)}[self.kind]
        return fold(column).over(window)

    def _whole(self, column: Column) -> Column:
        """What a range hands on: of its rows in the segment."""
        at = F.struct(F.col(PLACE), column.alias("v"))
        if self.kind in ("last", "next"):
            return (F.max if self.kind == "last" else F.min)(F.when(column.isNotNull(), at))["v"]
        return (F.sum if self.kind == "sum" else F.max)(column)

    def _joined(self, inside: Column, carried: Column) -> Column:
        if self.kind == "sum":
            return F.coalesce(inside, F.lit(0)) + F.coalesce(carried, F.lit(0))
        if self.kind == "max":
            return F.greatest(inside, carried)
        return F.coalesce(inside, carried)


def in_ranges(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """``df`` written in ranges of ``order``, which must be total, with the range and the place within it."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    names = [f"__k{i}" for i in range(len(order))]
    dealt = df.withColumns(dict(zip(names, columns))).repartitionByRange(*names).withColumn(PART, F.spark_partition_id())
    dealt = materialize(dealt, "ranges").repartition(PART)
    return dealt.withColumn(PLACE, F.row_number().over(Window.partitionBy(PART).orderBy(*names))).drop(*names)


def scanned(ranged: DataFrame, **scans: Scan) -> DataFrame:
    """``ranged`` (from ``in_ranges``) with one column for each scan, side by side; null keys of segments are keys."""
    out = ranged
    for by in dict.fromkeys(s.by for s in scans.values()):
        here = {name: s for name, s in scans.items() if s.by == by}
        inside = {f"__in_{n}": s._over(s.column, s._frame(True)) for n, s in here.items()}
        out = out.withColumns(inside)
        parts = ranged.groupBy(PART, *by).agg(*[s._whole(s.column).alias(n) for n, s in here.items()])
        if by:  # only segments that begin in one range and go on in another hand anything on
            ranges = Window.partitionBy(*by)
            parts = parts.withColumn("__ranges", F.count("*").over(ranges)).where("__ranges > 1").drop("__ranges")
        keys = [F.col(c).alias(f"__by{i}") for i, c in enumerate(by)]
        carried = parts.select(F.col(PART).alias("__p"), *keys, *[s._over(F.col(n), s._frame(False)).alias(f"__from_{n}") for n, s in here.items()])
        same = F.col(PART) == F.col("__p")
        for i, c in enumerate(by):
            same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
        out = out.join(F.broadcast(carried), same, "left")  # two rows a range at most
        out = out.withColumns({n: s._joined(F.col(f"__in_{n}"), F.col(f"__from_{n}")) for n, s in here.items()})
        out = out.drop("__p", *[f"__by{i}" for i in range(len(by))], *[f"__{x}_{n}" for n in here for x in ("in", "from")])
    return out


def unranged(df: DataFrame) -> DataFrame:
    return df.drop(PART, PLACE)


def window_over_ranges(ranged: DataFrame, key: str, anchor: str, plausible: str, by: tuple[str, ...] = (), wide: int = 6, narrow: int = 4) -> DataFrame:
    """``ranged`` with accepted and reason, as ``sequence.alphabetical_window`` gives them, over one long sequence (WIN5).

    The bound above is a scan for the next anchor, the bound below a running maximum over the rows that fit under it.
    """
    short = lambda n: F.substring(F.regexp_replace(key, " ", ""), 1, n)
    ahead = scanned(ranged, __ahead=Scan("next", F.when(F.col(anchor), short(narrow)), by=by))
    fits = ahead.withColumn("__fits", F.col(anchor) | (F.col(plausible) & (short(narrow) <= F.coalesce("__ahead", F.lit("￿")))))
    last = scanned(fits, __last=Scan("max", F.when(F.col("__fits"), short(wide)), by=by))
    reason = (
        F.when(F.col(anchor), "anchor").when(~F.col(plausible), "implausible")
        .when(F.col("__fits") & (F.coalesce(F.col("__last"), F.lit("")) <= short(wide)), "window").otherwise("outside")
    )
    out = last.withColumn("reason", reason)
    return out.withColumn("accepted", F.col("reason").isin("anchor", "window")).drop("__fits", "__last", "__ahead")
