"""Reading order on scanned pages (WIN1, WIN7, WIN8, JN14, TF8, FN21, SNK5).

Blocks and lines are rows with page, hpos, vpos, width, height. Windows are bounded by a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiewright.operators.sequence import moving_median


def gutters(blocks: DataFrame, least: float = 150, full: float = 0.8) -> DataFrame:
    """(page, gutter): the middle of the widest step between left edges of full-measure blocks, if it is wide enough (WIN8)."""
    page = Window.partitionBy("page")
    wide = blocks.withColumn("widest", F.max("width").over(page)).where(F.col("width") >= full * F.col("widest"))
    before = F.lag("hpos").over(page.orderBy("hpos"))
    steps = wide.select("page", (F.col("hpos") - before).alias("gap"), F.floor((F.col("hpos") + before) / 2).alias("middle"), before.alias("lo")).where("gap IS NOT NULL")
    best = steps.groupBy("page").agg(F.max_by(F.struct("gap", "middle"), F.struct("gap", -F.col("lo"))).alias("x"))
    return best.where(F.col("x.gap") >= least).select("page", F.col("x.middle").alias("gutter"))


def assign_columns(blocks: DataFrame, narrow: float = 0.6) -> DataFrame:
    """``blocks`` with column 0 or 1; narrow insets join the column that they overlap more, if they overlap one (JN14)."""
    page = Window.partitionBy("page")
    placed = blocks.join(gutters(blocks), "page", "left").withColumn("column", F.when(F.col("gutter").isNull() | (F.col("hpos") < F.col("gutter")), 0).otherwise(1))
    placed = placed.withColumn("narrow", F.col("width") < narrow * F.max("width").over(page))
    edge = lambda f, c, x: f(F.when((F.col("column") == c) & ~F.col("narrow"), x)).over(page)
    right = F.col("hpos") + F.col("width")
    for c in (0, 1):
        placed = placed.withColumn(f"lo{c}", edge(F.min, c, F.col("hpos"))).withColumn(f"hi{c}", edge(F.max, c, right))
    over = [F.greatest(F.lit(0), F.least(right, F.col(f"hi{c}")) - F.greatest(F.col("hpos"), F.col(f"lo{c}"))) for c in (0, 1)]
    both = F.col("lo0").isNotNull() & F.col("lo1").isNotNull()
    column = F.when(F.col("narrow") & both & (F.greatest(*over) > 0), F.when(over[1] > over[0], 1).otherwise(0)).otherwise(F.col("column"))
    return placed.withColumn("column", column).drop("gutter", "lo0", "lo1", "hi0", "hi1")


def reading_order(blocks: DataFrame, share: float = 0.4) -> DataFrame:
    """``blocks`` (with column) and their place in reading order within page and column (WIN7).

    Blocks go from top to bottom; those that overlap the ones before by more than ``share`` of the shortest height stand side
    by side and are read from the left. Blocks of one corner go by their other columns. A page's column is one small group,
    folded in one array.
    """
    first = ["vpos", "hpos"]
    others = [c for c in blocks.columns if c not in ("page", "column", *first)]
    rows = blocks.groupBy("page", "column").agg(F.array_sort(F.collect_list(F.struct(*first, *others))).alias("b"))
    top, number = lambda b: b["vpos"].cast("double"), lambda x, kind="double": F.lit(x).cast(kind)
    start = F.struct(F.array().cast("array<struct<cluster:int,hpos:double,i:int>>").alias("done"), number(None).alias("bottom"), number(None).alias("shortest"), number(-1, "int").alias("n"))

    def step(state, b):
        height = b["height"].cast("double")
        joined = F.coalesce(state["bottom"] - top(b) > share * F.least(state["shortest"], height), F.lit(False))
        n = F.when(joined, state["n"]).otherwise(state["n"] + 1)
        placed = F.struct(n.alias("cluster"), b["hpos"].cast("double").alias("hpos"), F.size(state["done"]).alias("i"))
        end = top(b) + height
        return F.struct(F.array_append(state["done"], placed).alias("done"), F.when(joined, F.least(state["bottom"], end)).otherwise(end).alias("bottom"), F.when(joined, F.least(state["shortest"], height)).otherwise(height).alias("shortest"), n.alias("n"))

    order = F.transform(F.array_sort(F.aggregate("b", start, step)["done"]), lambda x: x["i"])
    placed = rows.select("page", "column", "b", F.posexplode(order).alias("place", "i"))
    at = F.get("b", F.col("i"))
    return placed.select(*[F.col(f"`{c}`") if c in ("page", "column") else at[c].alias(c) for c in blocks.columns], F.col("place").cast("long").alias("place"))


def indents(lines: DataFrame, reach: int = 4) -> DataFrame:
    """``lines`` (page, column, measure, place, hpos) with indent: hpos less the median of the neighbours', 0 if alone (WIN1)."""
    around = moving_median("hpos", ["page", "column", "measure"], ["place"], reach)
    return lines.withColumn("indent", F.col("hpos") - F.coalesce(around, F.col("hpos")))


def line_texts(lines: DataFrame, words: str = "words") -> DataFrame:
    """``lines`` with text and confidence from an array of (content, subs_type, subs_content, wc) (FN21).

    The first half of a hyphenated word gives the whole word, the second half gives nothing.
    """
    kept = F.filter(words, lambda w: F.coalesce(w["subs_type"], F.lit("")) != "HypPart2")
    pick = F.transform(kept, lambda w: F.when(w["subs_type"] == "HypPart1", w["subs_content"]).otherwise(w["content"]))
    sure = F.filter(F.transform(F.filter(kept, lambda w: F.coalesce(F.when(w["subs_type"] == "HypPart1", w["subs_content"]).otherwise(w["content"]), F.lit("")) != ""), lambda w: w["wc"]), lambda x: x.isNotNull())
    mean = F.when(F.size(sure) > 0, F.aggregate(sure, F.lit(0.0), lambda a, x: a + x) / F.size(sure))
    return lines.withColumn("text", F.array_join(F.filter(pick, lambda x: x.isNotNull() & (x != "")), " ")).withColumn("confidence", mean)


def page_dump(lines: DataFrame) -> DataFrame:
    """(place, value): texts in order with a header line at each change of page or column (SNK5, WIN16)."""
    w = Window.partitionBy("page").orderBy("column", "place")
    changed = ~F.lag("column").over(w).eqNullSafe(F.col("column"))
    header = F.format_string("=== page %s column %s", F.col("page").cast("string"), F.col("column").cast("string"))
    rows = lines.withColumn("__changed", changed)
    return rows.select("page", "column", "place", F.explode(F.when(F.col("__changed"), F.array(header, F.col("text"))).otherwise(F.array("text"))).alias("value"))
