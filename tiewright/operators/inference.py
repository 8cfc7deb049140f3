"""Homophily, exact and permutation inference, and regression (ST1 to ST17).

Edges are (src, dst), canonical; labels are (node, label), one row for a node.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiewright.operators.graph import capped_bodies, symmetric
from tiewright.sources.tables import materialize, spread


def labelled_ends(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, other, a, b): both directions of the edges whose ends both have labels."""
    a = labels.select("node", F.col("label").alias("a"))
    b = labels.select(F.col("node").alias("other"), F.col("label").alias("b"))
    return symmetric(edges).join(a, "node").join(b, "other")


def nominal_assortativity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(r, n_edges): Newman's coefficient; null without edges or where one label has all ends (ST6)."""
    ends = labelled_ends(edges, labels)
    cells = ends.groupBy("a", "b").agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("m"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("sq"))
    m, same, sq = F.col("m"), F.col("same") / F.col("m"), F.col("sq") / (F.col("m") * F.col("m"))
    return total.crossJoin(rows).select(F.when((m > 0) & (sq < 1), (same - sq) / (1 - sq)).alias("r"), F.coalesce(m / 2, F.lit(0)).cast("long").alias("n_edges"))


def external_internal(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(n_internal, n_external, ei): ties between labels less those within, over all (ST7)."""
    ends = labelled_ends(edges, labels).where("node < other")
    sums = ends.agg(F.count_if(F.col("a") == F.col("b")).alias("n_internal"), F.count_if(F.col("a") != F.col("b")).alias("n_external"))
    return sums.withColumn("ei", (F.col("n_external") - F.col("n_internal")) / F.nullif(F.col("n_external") + F.col("n_internal"), F.lit(0)))


def coleman(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, size, share, coleman): same-label share of tie ends against (size - 1) / (n - 1), among nodes with a tie (ST8)."""
    ends = labelled_ends(edges, labels)
    by = ends.groupBy(F.col("a").alias("label")).agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("share"), F.countDistinct("node").alias("size"))
    n = F.sum("size").over(Window.partitionBy())
    expected = (F.col("size") - 1) / (n - 1)
    return by.withColumn("expected", expected).select("label", "size", "share", F.when(F.col("expected") < 1, (F.col("share") - F.col("expected")) / (1 - F.col("expected"))).alias("coleman"))


def body_purity(ties: DataFrame, labels: DataFrame) -> DataFrame:
    """(purity, n_bodies): the mean over bodies of the share of their labelled pairs that have one label (ST9).

    Pairs are counted from label counts, not made: a body of k people costs k rows.
    """
    named = ties.select("person", "body").distinct().join(labels.select(F.col("node").alias("person"), "label"), "person")
    counts = named.groupBy("body", "label").agg(F.count("*").alias("k"))
    pairs = lambda c: c * (c - 1) / 2
    bodies = counts.groupBy("body").agg(F.sum(pairs(F.col("k"))).alias("same"), F.sum("k").alias("all")).where("all >= 2")
    return bodies.agg(F.avg(F.col("same") / pairs(F.col("all"))).alias("purity"), F.count("*").alias("n_bodies"))


def mixing(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, n, share, by_size, by_ends) for unordered label pairs a <= b: observed, and expected from people or ends (ST14, ST15)."""
    ends = labelled_ends(edges, labels)
    observed = ends.where("node < other").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))
    one = Window.partitionBy()
    observed = observed.withColumn("share", F.col("n") / F.sum("n").over(one))
    groups = ends.groupBy("a").agg(F.countDistinct("node").alias("people"), F.count("*").alias("ends"))
    groups = groups.select("a", (F.col("people") / F.sum("people").over(one)).alias("p"), (F.col("ends") / F.sum("ends").over(one)).alias("q"))
    left, right = groups, groups.select(F.col("a").alias("b"), F.col("p").alias("p2"), F.col("q").alias("q2"))
    double = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    return observed.join(left, "a").join(right, "b").select("a", "b", "n", "share", (double * F.col("p") * F.col("p2")).alias("by_size"), (double * F.col("q") * F.col("q2")).alias("by_ends"))


def leave_one_out(ties: DataFrame, labels: DataFrame, least: int = 30, cap: int = 60) -> DataFrame:
    """(body, r, swing): assortativity without each body in turn, in one pass (ST12).

    Without a body, the edges go that no other body makes. Sums over all edges are corrected by the sums over those: what a
    body does not touch is never listed for it. Bodies of more than ``cap`` people make no edges, as in the projection;
    bodies that leave fewer than ``least`` edges are left out.
    """
    named = capped_bodies(ties, cap).join(labels.select(F.col("node").alias("person"), "label"), "person")
    x = named.select("body", F.col("person").alias("src"), F.col("label").alias("a"))
    y = named.select("body", F.col("person").alias("dst"), F.col("label").alias("b"))
    edges = x.join(y, "body").where("src < dst").groupBy("src", "dst", "a", "b").agg(F.count("*").alias("k"), F.min("body").alias("body"))
    ends = edges.select("k", "body", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("k", "body", "e.x", "e.y")
    total = ends.groupBy("x").agg(F.count("*").alias("ends"), F.count_if(F.col("x") == F.col("y")).alias("same"))
    gone = ends.where("k = 1").groupBy("body", "x").agg(F.count("*").alias("g_ends"), F.count_if(F.col("x") == F.col("y")).alias("g_same"))
    # (ends - g)^2 summed over all labels is the sum of ends^2, less 2 * ends * g - g^2 over the labels that the body touches
    less = F.sum(2 * F.col("ends") * F.col("g_ends") - F.col("g_ends") * F.col("g_ends"))
    sums = gone.join(total.select("x", "ends"), "x").groupBy("body").agg(F.sum("g_ends").alias("dm"), F.sum("g_same").alias("ds"), less.alias("dsq"))
    r = lambda m, s, sq: (s / m - sq / (m * m)) / (1 - sq / (m * m))
    whole = total.agg(F.sum("ends").alias("m0"), F.sum("same").alias("s0"), F.sum(F.col("ends") * F.col("ends")).alias("sq0"))
    c = F.col
    sums = sums.crossJoin(F.broadcast(whole)).select("body", "m0", "s0", "sq0", (c("m0") - c("dm")).alias("m"), (c("s0") - c("ds")).alias("s"), (c("sq0") - c("dsq")).alias("sq"))
    out = sums.where(F.col("m") >= 2 * least).withColumn("r", r(c("m"), c("s"), c("sq")))
    return out.select("body", "r", (c("r") - r(c("m0"), c("s0"), c("sq0"))).alias("swing"))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided: the tables with the same margins that are no likelier than this one, a relative 1e-9 allowed (ST1)."""
    row, other, col = a + b, c + d, a + c
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    chance = lambda x: math.exp(log(row, x) + log(other, col - x) - log(row + other, col))
    seen = chance(a)
    return min(1.0, sum(p for x in range(max(0, col - other), min(row, col) + 1) if (p := chance(x)) <= seen * (1 + 1e-9)))


def fisher(cells: DataFrame, by: str) -> DataFrame:
    """``cells`` (by, a, b, c, d) with p: one test for each row, on the executors."""

    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([fisher_exact(*map(int, x)) for x in zip(a, b, c, d)], dtype="float64")

    return cells.withColumn("p", p("a", "b", "c", "d"))


def least_squares(df: DataFrame, y: str, xs: list[str]) -> list[tuple[str, float, float, float]]:
    """(term, coefficient, standard error, t) of a regression with an intercept (ST16).

    One aggregation gives means and centred co-moments, which Spark merges pair by pair, so large means do not swallow small
    spreads; (k + 2)^2 numbers are solved on the driver, each column in units of its own deviation. Rows with a missing value
    are left out; a singular system, or as many terms as rows, gives NaN.
    """
    terms = ["(intercept)", *xs]
    kept = df.select(*[F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(xs)], F.col(y).cast("double").alias(f"x{len(xs)}")).dropna()
    k, names = len(xs), [f"x{i}" for i in range(len(xs) + 1)]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    got = kept.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)], *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    nan, n = [(t, math.nan, math.nan, math.nan) for t in terms], got["n"]
    if n <= k + 1:
        return nan
    means, moments = np.array([got[f"m{i}"] for i in range(k + 1)]), np.zeros((k + 1, k + 1))
    for i, j in pairs:
        moments[i, j] = moments[j, i] = got[f"c{i}_{j}"]
    scale = np.sqrt(np.diag(moments))[:k]
    if not scale.all() or np.linalg.matrix_rank(correlation := moments[:k, :k] / np.outer(scale, scale)) < k:
        return nan
    inverse = np.linalg.inv(correlation) / np.outer(scale, scale)
    beta = inverse @ moments[:k, k]
    variance = max(0.0, (moments[k, k] - beta @ moments[:k, k]) * n / (n - k - 1))
    values = [means[k] - beta @ means[:k], *beta]
    errors = np.sqrt(variance / n * np.r_[1 + means[:k] @ inverse @ means[:k], np.diag(inverse)])
    return [(t, float(b), float(s), float(b / s) if s else math.nan) for t, b, s in zip(terms, values, errors)]


#: Draws whose labels a task holds at once, and entries of a table of counts that may go to the tasks.
DRAWS, MAX_COUNTS = 500, 100_000
#: Draws of sets at once, and rows of which a draw picks some by the number of a subset.
SETS, BITS = 4096, 16
#: Members of a body above which it is dealt out in parts; places up to which draws are tables.
HEAVY, SORTED = 50_000, 2048
#: Numbers that are mixed at once, so that they stay in a core's cache, and rows whose draws are.
STEP, ROWS = 1 << 15, 1024


def _mix(x: np.ndarray, spare: np.ndarray) -> None:
    """Mixes ``x`` where it stands."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, None)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if factor:
            np.multiply(x, np.uint32(factor), out=x)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    _mix(x, np.empty_like(x))
    return x


def _rounds(x: np.ndarray, keys: list[np.ndarray], half: np.uint32, mask: np.uint32) -> np.ndarray:
    """Feistel rounds over the two halves of ``x``, a key for each round and column of ``x``."""
    left, right, now, spare = x >> half, x & mask, np.empty_like(x), np.empty_like(x)
    for key in keys:
        np.bitwise_xor(right, key, out=now)
        _mix(now, spare)
        np.bitwise_and(now, mask, out=now)
        np.bitwise_xor(now, left, out=now)
        left, right, now = right, now, left
    np.left_shift(left, half, out=left)
    return np.bitwise_or(left, right, out=left)


@lru_cache(maxsize=64)
def _sorted_places(n: int, first: int, last: int, seed: int) -> np.ndarray:
    """For each draw from first to last the ranks of n seeded random numbers."""
    out = np.empty((n, last - first), np.uint32)
    for draw in range(first, last):
        out[np.random.Generator(np.random.PCG64([seed, draw])).permutation(n), draw - first] = np.arange(n, dtype=np.uint32)
    return out


def shuffled_places(places: np.ndarray, n: int, draws: np.ndarray, seed: int) -> np.ndarray:
    """Where each of consecutive draws puts the places 0 to n - 1: a row for each place, a column for each draw, a permutation in each.

    Up to SORTED places are shuffled as a table. Beyond, a keyed bijection (eight Feistel rounds over the least square of a power
    of two that holds n, walked until it is below n) gives a place's new place without sorting and without the others; over
    few places its rounds would not be even enough. n is to be below 2^32.
    """
    if n <= SORTED:
        return _sorted_places(n, int(draws[0]), int(draws[-1]) + 1, seed)[places]
    half = np.uint32(((n - 1).bit_length() + 1) // 2)
    mask = np.uint32((1 << int(half)) - 1)
    with np.errstate(over="ignore"):
        keys = [_mixed(_mixed(draws.astype(np.uint32)) + np.uint32((seed * 8 + r + 1) * 0x9E3779B1 & 0xFFFFFFFF)) for r in range(8)]
    out = np.empty((len(places), len(draws)), np.uint32)
    rows = max(1, STEP // len(draws))
    for at in range(0, len(places), rows):
        some = out[at : at + rows]
        some[:] = places[at : at + rows].astype(np.uint32)[:, None]
        some[:] = _rounds(some, keys, half, mask)
    flat = out.reshape(-1)
    beyond = np.flatnonzero(flat >= n)
    while len(beyond):  # all that walk on go together, a step at a time
        left = []
        for at in range(0, len(beyond), STEP):
            here = beyond[at : at + STEP]
            column = here % len(draws)
            found = _rounds(flat[here], [key[column] for key in keys], half, mask)
            flat[here] = found
            left.append(here[found >= n])
        beyond = np.concatenate(left)
    return out


@lru_cache(maxsize=None)
def _subsets(m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The subsets of m things as bits, by their sizes; where each size begins, and how many it has."""
    size = np.bitwise_count(np.arange(1 << m, dtype=np.uint32))
    many = np.bincount(size)
    return np.argsort(size, kind="stable"), np.cumsum(many) - many, many


def subset_sums(values: np.ndarray, counts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """For each draw the sum of as many of the values as ``counts`` says, every set of so many being as likely.

    Of every 16 values in turn a draw takes a hypergeometric number, and then one of the subsets of that size.
    """
    out, left, rest = np.zeros(len(counts)), counts, len(values)
    for at in range(0, len(values), BITS):
        some = values[at : at + BITS]
        rest -= len(some)
        taken = rng.hypergeometric(len(some), rest, left)
        left = left - taken
        subsets, begin, many = _subsets(len(some))
        picked = subsets[begin[taken] + (rng.random(len(taken)) * many[taken]).astype(np.int64)]
        for half in (some[: BITS // 2], some[BITS // 2 :]):
            sums = np.zeros(1)
            for value in half:
                sums = np.concatenate([sums, sums + value])
            out += sums[picked & (len(sums) - 1)]
            picked = picked >> BITS // 2
    return out


class Deck:
    """The labels of each stratum, by their numbers: what a draw deals to a place."""

    def __init__(self, placed: DataFrame, seed: int):
        """``placed``: node, label, stratum, place. Labels and strata are few (MAX_COUNTS pairs); more stop the query."""
        counts = placed.groupBy("stratum", "label").agg(F.count("*").alias("n")).limit(MAX_COUNTS + 1).collect()
        if len(counts) > MAX_COUNTS:
            raise ValueError(f"more than {MAX_COUNTS} pairs of stratum and label")
        self.labels = sorted({r.label for r in counts}, key=str)
        code, self.seed, self.below = {label: i for i, label in enumerate(self.labels)}, seed, {}
        for stratum in {r.stratum for r in counts}:
            sizes = np.zeros(len(self.labels), np.int64)
            for r in counts:
                if r.stratum == stratum:
                    sizes[code[r.label]] = r.n
            self.below[stratum] = np.cumsum(sizes)

    def dealt(self, strata: np.ndarray, places: np.ndarray, draws: np.ndarray) -> np.ndarray:
        """Numbers of the labels that the draws deal to places (from 1) of strata."""
        out = np.zeros((len(places), len(draws)), np.int32)
        for stratum in np.unique(strata):
            below, here = self.below[stratum.item()], np.flatnonzero(strata == stratum)
            seed = self.seed + 7919 * list(self.below).index(stratum.item())
            for at in range(0, len(here), ROWS):
                some = here[at : at + ROWS]
                to = shuffled_places(places[some] - 1, int(below[-1]), draws, seed)
                if len(below) > 16:
                    out[some] = np.searchsorted(below, to, side="right")
                else:
                    out[some] = sum((to >= b for b in below[:-1].astype(np.uint32)), np.zeros(to.shape, np.int32))
        return out


def _summed(rows: DataFrame, draws: int, width: int, add) -> DataFrame:
    """(draw, code, n): what ``add(batch, draws, sums)`` adds to the columns of ``sums``, over all rows; one row a task and pair.

    Rows are a few numbers each and their work is in the draws, so they are dealt out to all cores, however few they are.
    """
    rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)

    def run(batches):
        sums = np.zeros((draws, width))
        for batch in batches:
            for at in range(0, draws, DRAWS):
                add(batch, np.arange(at, min(draws, at + DRAWS)), sums[at : at + DRAWS])
        where = np.indices(sums.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(where[0], pa.int64()), pa.array(where[1], pa.int32()), pa.array(sums.ravel())], names=["draw", "code", "n"])

    return rows.mapInArrow(run, "draw long, code int, n double").groupBy("draw", "code").agg(F.sum("n").alias("n"))


def _numpy(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _add_pairs(deck: Deck):
    """For edges as (stratum, place) of both ends: how many get one label at both."""

    def add(batch, draws, sums):
        strata, places, other_strata, others = _numpy(batch)
        nodes, back = np.unique(np.stack([np.r_[strata, other_strata], np.r_[places, others]]), axis=1, return_inverse=True)
        labels = deck.dealt(nodes[0], nodes[1], draws)
        back = back.reshape(-1)
        sums[:, 0] += (labels[back[: len(places)]] == labels[back[len(places) :]]).sum(0)

    return add


def _add_ends(deck: Deck):
    """For nodes as (stratum, place, degree): how many ends of edges each label gets."""

    def add(batch, draws, sums):
        strata, places, degrees = _numpy(batch)
        labels = deck.dealt(strata, places, draws)
        for code in range(len(deck.labels)):
            sums[:, code] += ((labels == code) * degrees[:, None]).sum(0)

    return add


def _places(rows: DataFrame, by: list[str], key: str, seed: int) -> DataFrame:
    """``rows`` with place, from 1 in an order of seeded hashes of by and key within each group of ``by``.

    A group is cut into 1024 classes by the first bits of the hash: rows are numbered within a class, and the sizes of the
    classes before are added, so that no task ever sees a whole group.
    """
    mixed = rows.withColumn("__h", F.xxhash64(F.lit(seed), *by, key)).withColumn("__class", F.shiftrightunsigned("__h", 54))
    sizes = mixed.groupBy(*by, "__class").agg(F.count("*").alias("__size"))
    before = sizes.withColumn("__before", F.sum("__size").over(Window.partitionBy(*by).orderBy("__class")) - F.col("__size")).drop("__size")
    inside = mixed.withColumn("__n", F.row_number().over(Window.partitionBy(*by, "__class").orderBy("__h", key)))
    return inside.join(before, [*by, "__class"]).withColumn("place", F.col("__n") + F.col("__before")).drop("__h", "__class", "__n", "__before")


def placed_ends(edges: DataFrame, labels: DataFrame, strata: DataFrame | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """(node, label, stratum, degree, place) of the labelled nodes with ties, and the edges as places of both ends; written."""
    ends = labelled_ends(edges, labels)
    tied = ends.groupBy("node").agg(F.first("a").alias("label"), F.count("*").alias("degree"))
    tied = tied.join(strata.select("node", "stratum"), "node") if strata is not None else tied.withColumn("stratum", F.lit(0))
    placed = materialize(_places(tied, ["stratum"], "node", seed), "placed")
    two = placed.select(F.col("node").alias("other"), F.col("stratum").alias("other_stratum"), F.col("place").alias("other_place"))
    pairs = ends.where("node < other").select("node", "other").join(placed.select("node", "stratum", "place"), "node").join(two, "other")
    return placed, materialize(pairs.select("stratum", "place", "other_stratum", "other_place"), "pairs")


def label_permutation(edges: DataFrame, labels: DataFrame, draws: int, seed: int = 17, strata: DataFrame | None = None, least: int = 0) -> DataFrame:
    """(observed, mean, sd, p, draws, same, same_mean): assortativity against labels shuffled over the labelled nodes with ties (ST4).

    A draw deals the same labels anew, within strata (node, stratum; integers) if given. Every edge is read once for all
    draws: its ends know their places, a keyed bijection says where a draw puts them, and each task adds up all draws.
    One-sided, add-one. ``same`` is the share of edges within labels, ``same_mean`` its mean over the draws. With fewer than
    ``least`` labelled nodes, or without labelled edges, nothing is drawn, and p is null (ST19).
    """
    placed, pairs = placed_ends(edges, labels, strata, seed + 1)
    ends = labelled_ends(edges, labels)
    share = ends.agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("same"))
    observed = nominal_assortativity(edges, labels).select(F.col("r").alias("observed")).crossJoin(F.broadcast(share))
    if least and placed.count() < least:
        nil = F.lit(None).cast("double")
        return observed.select("observed", nil.alias("mean"), nil.alias("sd"), nil.alias("p"), F.lit(0).cast("long").alias("draws"), "same", nil.alias("same_mean"))
    deck = Deck(placed, seed)
    same = _summed(pairs, draws, 1, _add_pairs(deck)).select("draw", F.col("n").alias("same_n"))
    rows = _summed(placed.select("stratum", "place", "degree"), draws, len(deck.labels), _add_ends(deck)).groupBy("draw").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    e = F.col("sq") / (F.col("m") * F.col("m"))
    null = same.join(rows, "draw").select((2 * F.col("same_n") / F.col("m")).alias("s"), ((2 * F.col("same_n") / F.col("m") - e) / (1 - e)).alias("r"))
    n = F.count("s")  # without edges no draw has a share, and one row of nulls is left
    return observed.join(F.broadcast(null), F.lit(True), "left").groupBy("observed", "same").agg(
        F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"), F.when(n > 0, (F.count_if(F.col("r") >= F.col("observed") - 1e-12) + 1) / (n + 1)).alias("p"), n.alias("draws"), F.avg("s").alias("same_mean"),
    ).select("observed", "mean", "sd", "p", "draws", "same", "same_mean")


def expected_same(edges: DataFrame, labels: DataFrame, strata: DataFrame | None = None) -> DataFrame:
    """(same, expected): the share of edges within labels, and its exact mean over all ways to deal the labels within strata (ST13).

    An edge between strata s and t has one label at both ends with probability sum of p_s p_t over labels; within a stratum
    of n nodes with sum of n_k (n_k - 1) / (n (n - 1)). Edges are counted by pairs of strata first.
    """
    ends = labelled_ends(edges, labels)
    of = strata.select("node", "stratum") if strata is not None else ends.select("node").distinct().withColumn("stratum", F.lit(0))
    ends = ends.join(of, "node").join(of.select(F.col("node").alias("other"), F.col("stratum").alias("t")), "other")
    counts = ends.select("node", "stratum", "a").distinct().groupBy("stratum", "a").agg(F.count("*").alias("k")).withColumn("n", F.sum("k").over(Window.partitionBy("stratum")))
    two = counts.select(F.col("stratum").alias("t"), "a", F.col("k").alias("k2"), F.col("n").alias("n2"))
    chance = F.when(F.col("stratum") == F.col("t"), F.col("k") * (F.col("k") - 1) / (F.col("n") * F.nullif(F.col("n") - 1, F.lit(0)))).otherwise(F.col("k") * F.col("k2") / (F.col("n") * F.col("n2")))
    chances = counts.join(two, "a").groupBy("stratum", "t").agg(F.sum(chance).alias("chance"))
    met = ends.groupBy("stratum", "t").agg(F.count("*").alias("m"), F.count_if(F.col("a") == F.col("b")).alias("same"))
    sums = met.join(chances, ["stratum", "t"], "left").agg(F.sum("m").alias("m"), F.sum("same").alias("same"), F.sum(F.col("m") * F.coalesce("chance", F.lit(0.0))).alias("e"))
    return sums.select((F.col("same") / F.col("m")).alias("same"), (F.col("e") / F.col("m")).alias("expected"))


def mean_difference_permutation(df: DataFrame, value: str, group: str, draws: int, seed: int = 42, add_one: bool = True) -> DataFrame:
    """(observed, p, draws): difference of two groups' means, first less second by name, two-sided (ST2, ST3).

    A draw gives the first group's number of rows to the first side, every set of so many rows being as likely. How many of
    them fall into each class of rows (by a hash, whole in a task) is drawn first, then which ones (``subset_sums``), so every
    row is read once for all draws. n is to be below 10^9. ``add_one``: (hits + 1) / (draws + 1), else hits / draws.
    """
    rows = df.select(F.col(value).cast("double").alias("v"), F.col(group).alias("g")).where("v IS NOT NULL AND g IS NOT NULL")
    rows = materialize(rows.withColumn("id", F.monotonically_increasing_id()), "numbered")
    sizes = rows.groupBy("g").agg(F.count("*").alias("k"), F.avg("v").alias("mean"), F.sum("v").alias("sum")).orderBy("g").limit(3).collect()
    if len(sizes) != 2:
        raise ValueError(f"two groups are needed, not {len(sizes)}")
    first, n, total = sizes[0]["k"], sizes[0]["k"] + sizes[1]["k"], sizes[0]["sum"] + sizes[1]["sum"]
    observed = sizes[0]["mean"] - sizes[1]["mean"]

    classes = max(1, min(1024, n // 1024))
    classed = rows.select(F.xxhash64(F.lit(seed), "id").alias("hash"), "id", "v").withColumn("class", F.pmod("hash", F.lit(classes)))
    many = dict(classed.groupBy("class").count().collect())
    many = [many.get(i, 0) for i in range(classes)]

    def run(batches):
        sums, parts = np.zeros(draws), {}
        for batch in batches:
            kinds, values = _numpy(batch)
            starts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]])
            for kind, some in zip(kinds[starts], np.split(values, starts[1:])):
                parts.setdefault(int(kind), []).append(some)
        for at in range(0, draws, SETS):
            width, left, rest = min(draws - at, SETS), first, n
            rng = np.random.Generator(np.random.PCG64([seed, at]))
            for kind, size in enumerate(many):
                rest -= size
                here = rng.hypergeometric(size, rest, left, None if np.ndim(left) else width)
                left = left - here
                if kind in parts:
                    sums[at : at + width] += subset_sums(np.concatenate(parts[kind]), here, np.random.Generator(np.random.PCG64([seed, at, kind])))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), pa.array(sums)], names=["draw", "n"])

    dealt = spread(classed, "class").sortWithinPartitions("class", "hash", "id").select("class", "v")
    diff = F.col("n") / first - (F.lit(total) - F.col("n")) / (n - first)
    sums = dealt.mapInArrow(run, "draw long, n double").groupBy("draw").agg(F.sum("n").alias("n"))
    hits = F.count_if(F.abs(diff) >= abs(observed) - 1e-9 * (1 + abs(observed)))
    p = (hits + 1) / (F.count("*") + 1) if add_one else hits / F.count("*")
    return sums.agg(F.lit(observed).alias("observed"), p.alias("p"), F.count("*").alias("draws"))


def body_mixing_permutation(ties: DataFrame, labels: DataFrame, draws: int, seed: int = 11) -> DataFrame:
    """(observed, mean, p, draws): share of mixed pairs, counted in each body, against shuffled labels; one-sided, low (ST5).

    A body's pairs come from its counts of labels. Members of a body stand together in a task, which reads them once for all
    draws; bodies of more than HEAVY members are dealt out in parts, whose counts are added before pairs are.
    """
    named = materialize(ties.select("person", "body").distinct().join(labels.select(F.col("node").alias("person"), "label"), "person"), "named")
    people = named.select("person", "label").distinct().withColumn("stratum", F.lit(0))
    placed = materialize(_places(people, ["stratum"], "person", seed + 1).withColumnRenamed("person", "node"), "placed")
    deck = Deck(placed, seed)
    width = len(deck.labels)
    sizes = named.groupBy("body").agg(F.ceil(F.count("*") / HEAVY).alias("parts"))
    members = named.select(F.col("person").alias("node"), "body").join(placed.select("node", "place"), "node").join(sizes, "body")
    members = members.select(F.col("body").cast("string").alias("body"), F.expr("pmod(xxhash64(node), parts)").alias("part"), "parts", "place")
    ordered = members.repartition("body", "part").sortWithinPartitions("body", "part")

    def pairs(counts: np.ndarray) -> np.ndarray:
        return (counts * (counts - 1) / 2).sum(1)

    def run(batches):
        """Pairs within labels of whole bodies, added up in row null; counts of parts of bodies each."""
        within, key, held, whole = np.zeros(draws), None, None, True

        def close():
            if key is not None and whole:
                within[:] += pairs(held)
            elif key is not None:
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([held.tobytes()], pa.binary())], names=["body", "counts"])

        rows = max(1, min(ROWS, (1 << 23) // (draws * width)))
        for batch in (batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows)):
            bodies, part, parts = (batch.column(i).to_pylist() for i in range(3))
            places = batch.column(3).to_numpy(zero_copy_only=False)
            names = list(zip(bodies, part))
            starts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
            counts = np.empty((len(starts), draws, width))
            for begin in range(0, draws, DRAWS):
                some = np.arange(begin, min(draws, begin + DRAWS))
                dealt = deck.dealt(np.zeros(len(places), np.int64), places, some)
                for code in range(width):
                    counts[:, some, code] = np.add.reduceat(dealt == code, starts, axis=0, dtype=np.int32)
            for i, at in enumerate(starts):
                if key != names[at]:
                    yield from close()
                    key, held, whole = names[at], np.zeros((draws, width)), parts[at] == 1
                held += counts[i]
        yield from close()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([within.tobytes()], pa.binary())], names=["body", "counts"])

    def merged(batches):
        """The sums of all tasks, and the pairs of bodies whose parts are added here."""
        within, parts = np.zeros(draws), {}
        for batch in batches:
            for body, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if body is None:
                    within += np.frombuffer(counts)
                else:
                    parts[body] = parts.get(body, 0) + np.frombuffer(counts).reshape(draws, width)
        for counts in parts.values():
            within += pairs(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws), pa.int64()), pa.array(within)], names=["draw", "same"])

    parts = ordered.mapInArrow(run, "body string, counts binary").withColumn("key", F.coalesce("body", F.spark_partition_id().cast("string")))
    sums = parts.repartition("key").drop("key").mapInArrow(merged, "draw long, same double").groupBy("draw").agg(F.sum("same").alias("same"))
    counts = named.groupBy("body", "label").agg(F.count("*").alias("k"))
    totals = counts.groupBy("body").agg(F.sum("k").alias("k"), F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("same")).agg(F.sum("same").alias("same0"), F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("all"))
    null = sums.crossJoin(F.broadcast(totals)).select((1 - F.col("same") / F.col("all")).alias("mixed"), (1 - F.col("same0") / F.col("all")).alias("observed"))
    return null.groupBy("observed").agg(F.avg("mixed").alias("mean"), ((F.count_if(F.col("mixed") <= F.col("observed") + 1e-12) + 1) / (F.count("*") + 1)).alias("p"), F.count("*").alias("draws"))


def report_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table of results that were solved on the driver."""
    return spark.createDataFrame(rows, names)


def battery(edges: DataFrame, attributes: dict[str, DataFrame], least: int = 30) -> DataFrame:
    """(attribute, n_groups, n_edges, r, ei) for each attribute with enough labelled ties and two groups or more (ST11)."""
    parts = []
    for name, labels in attributes.items():
        ends = labelled_ends(edges, labels)
        rows = ends.groupBy("a").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"))
        sums = rows.agg(F.count("*").alias("n_groups"), F.sum("n").alias("m"), F.sum("same").alias("s"), F.sum(F.col("n") * F.col("n")).alias("sq"))
        parts.append(sums.withColumn("attribute", F.lit(name)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    m, s, e = F.col("m"), F.col("s"), F.col("sq") / (F.col("m") * F.col("m"))
    kept = out.where((F.col("n_groups") >= 2) & (m >= 2 * least))
    return kept.select("attribute", "n_groups", (m / 2).cast("long").alias("n_edges"), ((s / m - e) / (1 - e)).alias("r"), ((m - 2 * s) / m).alias("ei"))


def matched_means(values: DataFrame, members: DataFrame, labels: DataFrame, value: str, basis: str | None = None) -> DataFrame:
    """(label, n, mean) of a node measure among ``members`` (node) that have labels: like is compared with like (ST17, GR22).

    With a ``basis``, only labels that rest on this one (a column ``basis`` of ``labels``) are compared.
    """
    if basis is not None:
        labels = labels.where(F.col("basis") == basis)
    kept = values.join(members.select("node").distinct(), "node", "left_semi").join(labels.select("node", "label"), "node")
    return kept.groupBy("label").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
