"""Entries of a printed volume: lines to paragraphs, paragraphs to entries by their filing order (WIN2 to WIN6, FN22 to FN26).

A chain of window steps. Headings restart the filing order; between two of them, the longest non-decreasing run of headwords in
capitals is the scaffold, and other plausible headwords are accepted where they fit between the last accepted key and the next
one of the scaffold. What is not accepted joins the entry above.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiewright.functions import text as T
from tiewright.operators import sequence as S

SHORT = 6


def paragraphs(lines: DataFrame, starts: str, by: list[str], order: str, text: str = "text") -> DataFrame:
    """(by, paragraph, text): lines joined from one where the boolean ``starts`` holds to before the next (WIN2, FN26).

    A volume's first line always starts a paragraph; null in ``starts`` counts as false, and null texts as empty.
    """
    numbered = lines.withColumn("paragraph", S.islands(F.col(starts), by, [order]))
    return T.join_lines(numbered.withColumn(text, F.coalesce(text, F.lit(""))), [*by, "paragraph"], order, text, "text")


def scaffold(candidates: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, order) of the rows in a longest non-decreasing run of ``key``, for each group of ``by`` (WIN6).

    Only keys and places of one group are held together, cut to ``SHORT`` letters.
    """
    keys = candidates.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, T.cmp_key(F.col("key"), SHORT).alias("k")))).alias("rows"))
    kept = keys.withColumn("place", F.explode(S.longest_nondecreasing(F.transform("rows", lambda r: r["k"]))))
    return kept.select(*by, F.get("rows", F.col("place"))[order].alias(order))


def judged(paras: DataFrame, by: list[str], order: str = "paragraph") -> DataFrame:
    """``paras`` with head, key, sequence, reason and accepted: what each paragraph is in its volume's filing order.

    Reasons: sequence_heading, anchor, implausible, window, outside. ``sequence`` counts the headings so far; the heading
    itself is in none (null), takes no part in the order, and belongs to the entry above. Null texts count as empty.
    """
    rows = paras.withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("head", T.split_headword(F.col("text"))).withColumn("key", T.sort_key(F.col("head")))
    rows = rows.withColumn("heading", T.is_sequence_heading(F.col("head"), F.col("text")))
    so_far = S.frame(by, [order]).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sequence", F.sum(F.col("heading").cast("int")).over(so_far))
    inside, runs = rows.where(~F.col("heading")).drop("heading"), [*by, "sequence"]
    anchors = scaffold(inside.where(T.is_caps_surname(F.col("head"))), runs, order).withColumn("__anchor", F.lit(True))
    inside = inside.join(anchors, [*runs, order], "left")
    opener = F.element_at(F.split("key", " "), 1)
    inside = inside.withColumns({"__anchor": F.coalesce("__anchor", F.lit(False)), "__plausible": T.is_headword(F.col("head")) & ~opener.isin(T.RUBRICS)})
    placed = S.alphabetical_window(inside, "key", "__anchor", "__plausible", runs, [order]).drop("__anchor", "__plausible")
    headings = rows.where("heading").drop("heading").withColumns({"sequence": F.lit(None).cast("long"), "reason": F.lit("sequence_heading"), "accepted": F.lit(False)})
    return placed.unionByName(headings.select(*placed.columns))


def entries(paras: DataFrame, by: list[str], order: str = "paragraph") -> DataFrame:
    """(by, entry, head, key, reason, n_paragraphs, text): entries numbered from 1 in each volume, their paragraphs joined.

    A volume's first paragraph always starts an entry, with the reason first_paragraph if it is not accepted. A volume
    without paragraphs has no entries.
    """
    rows = judged(paras, by, order)
    w = S.frame(by, [order])
    first = F.row_number().over(w) == 1
    rows = rows.withColumn("reason", F.when(first & ~F.col("accepted"), "first_paragraph").otherwise(F.col("reason"))).withColumn("__starts", F.col("accepted") | first)
    rows = rows.withColumn("entry", F.sum(F.col("__starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    opening = F.min_by(F.struct("head", "key", "reason"), F.col(order)).alias("o")
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"])
    whole = rows.groupBy(*by, "entry").agg(opening, F.count("*").alias("n_paragraphs"), F.trim(F.array_join(texts, " ")).alias("text"))
    return whole.select(*by, "entry", "o.head", "o.key", "o.reason", "n_paragraphs", "text")
