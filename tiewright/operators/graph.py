"""Two-mode and one-mode network operators as DataFrame plans (GR1, GR4, GR5, GR8 to GR16, GR20, GR21, GR23, JN15, JN16, JN19).

A graph is a table of canonical pairs (src < dst), unweighted and without repeats; ``symmetric`` gives both directions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiewright.operators import walks
from tiewright.operators.pairs import self_pairs
from tiewright.operators.ranking import global_rank
from tiewright.sources.tables import drop, materialize


def canonical_edges(pairs: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Simple undirected graph: self-loops and rows with a null end go, repeats and reversals fold (GR1)."""
    kept = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    return kept.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    """(node, other) in both directions; one pass over the edges."""
    both = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"))))
    return edges.select(both.alias("x")).select("x.node", "x.other")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): distinct neighbours (GR4)."""
    return symmetric(edges).groupBy("node").agg(F.count("*").alias("degree"))


def capped_bodies(ties: DataFrame, cap: int, body: str = "body", person: str = "person") -> DataFrame:
    """Distinct ties of bodies with 2 to ``cap`` people; groups go before any pair is made (JN16)."""
    distinct = ties.select(person, body).distinct()
    sizes = distinct.groupBy(body).agg(F.count("*").alias("__n")).where(F.col("__n").between(2, cap)).drop("__n")
    return distinct.join(sizes, body, "left_semi")


def project(ties: DataFrame, cap: int = 60, body: str = "body", person: str = "person", shared: bool = True) -> DataFrame:
    """One-mode projection: (src, dst, weight[, shared]) for people of a common body; shared lists the bodies in order (GR14).

    The cap bounds what one body can give: cap * (cap - 1) / 2 pairs.
    """
    kept = capped_bodies(ties, cap, body, person)
    left, right = kept.select(F.col(body), F.col(person).alias("src")), kept.select(F.col(body), F.col(person).alias("dst"))
    pairs = left.join(right, body).where("src < dst")
    found = [F.count("*").alias("weight")]
    if shared:
        found.append(F.array_join(F.array_sort(F.transform(F.collect_list(body), lambda x: x.cast("string"))), ";").alias("shared"))
    return pairs.groupBy("src", "dst").agg(*found)


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), b < c, for each triangle once: a is its corner of the least degree (of equal degrees, the smaller node).

    Edges point from the lower to the higher degree, so that no node has more than the square root of twice the edges ahead
    of it, however many neighbours it has; pairs of nodes ahead are closed by a third edge.
    """
    d = degrees(edges)
    ends = edges.select("src", "dst").join(d.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("dd")), "dst")
    forward = F.struct("ds", "src") < F.struct("dd", "dst")
    ahead = ends.select(F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("b"))
    wedges = ahead.join(ahead.withColumnRenamed("b", "c"), "a").where("b < c")
    return wedges.join(edges.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"]).select("a", "b", "c")


def clustering(edges: DataFrame) -> DataFrame:
    """(node, degree, clustering): links among neighbours over possible ones; 0 below degree 2 (GR8)."""
    corner = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    k = F.col("degree")
    value = F.when(k < 2, F.lit(0.0)).otherwise(2.0 * F.coalesce("n", F.lit(0)) / (k * (k - 1)))
    return degrees(edges).join(corner, "node", "left").select("node", "degree", value.alias("clustering"))


def degree_assortativity(edges: DataFrame) -> DataFrame:
    """One row: the correlation of degrees over edge ends, both directions (GR12)."""
    d = degrees(edges)
    ends = symmetric(edges).join(d, "node").withColumnRenamed("degree", "x").join(d.select(F.col("node").alias("other"), F.col("degree").alias("y")), "other")
    return ends.agg(F.corr("x", "y").alias("r"), F.count("*").alias("n_ends"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (column node) (GR23)."""
    kept = nodes.select("node").distinct()
    return edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def constraint(edges: DataFrame, max_degree: int | None = 40) -> DataFrame:
    """(node, degree, constraint): Burt's constraint within the nodes of at most ``max_degree`` neighbours (GR13).

    The sum over j of (p_ij + sum over q of p_iq p_qj) squared, p being one over the degree.
    """
    if max_degree is not None:
        edges = induced(edges, degrees(edges).where(F.col("degree") <= max_degree))
    d = degrees(edges)
    p = symmetric(edges).join(d, "node").select("node", "other", (1.0 / F.col("degree")).alias("p"))
    via = p.select("node", F.col("other").alias("mid"), F.col("p").alias("p1")).join(p.select(F.col("node").alias("mid"), "other", F.col("p").alias("p2")), "mid")
    indirect = via.where("node <> other").groupBy("node", "other").agg(F.sum(F.col("p1") * F.col("p2")).alias("q"))
    total = p.join(indirect, ["node", "other"], "left").groupBy("node").agg(F.sum(F.pow(F.col("p") + F.coalesce("q", F.lit(0.0)), F.lit(2))).alias("constraint"))
    return total.join(d, "node").select("node", "degree", "constraint")


def core_numbers(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, core): each round a node takes the h-index of its neighbours' values; the fixed point is the core number (GR11).

    After the first round only the neighbours of nodes that changed are looked at again.
    """
    both = materialize(symmetric(edges), "both")
    values = materialize(both.groupBy("node").agg(F.count("*").alias("core")), "core")
    written, moved = values, None
    for _ in range(max_rounds):
        near = both if moved is None else both.join(both.join(moved.select(F.col("node").alias("other")), "other").select("node").distinct(), "node", "left_semi")
        seen = near.join(values.select(F.col("node").alias("other"), F.col("core").alias("v")), "other").groupBy("node", "v").agg(F.count("*").alias("n"))
        # h-index: the largest h with at least h neighbours of value h or more
        from pyspark.sql import Window

        above = F.sum("n").over(Window.partitionBy("node").orderBy(F.desc("v")))
        h = seen.withColumn("h", F.least(F.col("v"), above)).groupBy("node").agg(F.max("h").alias("h"))
        following = materialize(values.join(h, "node", "left").select("node", F.least("core", "h").alias("core"), F.coalesce(F.col("h") < F.col("core"), F.lit(False)).alias("changed")), "core")
        drop(written)
        written, values, moved = following, following.select("node", "core"), following.where("changed")
        if moved.isEmpty():
            drop(both)
            return values
    raise RuntimeError(f"core numbers did not settle in {max_rounds} rounds")


def _levels(both: DataFrame, start: DataFrame, max_depth: int) -> list[DataFrame]:
    """The tables (source, node, dist, paths) of the levels from the nodes of ``start``; ``both`` are edges in both directions.

    A neighbour of a level lies in it, in the one before, or in the next: only the last two are looked at.
    """
    start = start.select("node").distinct().join(both.select("node").distinct(), "node", "left_semi")
    levels = [materialize(start.select(F.col("node").alias("source"), "node", F.lit(0).alias("dist"), F.lit(1.0).alias("paths")), "level")]
    for depth in range(1, max_depth + 1):
        ahead = levels[-1].join(both, "node").groupBy("source", F.col("other").alias("node")).agg(F.sum("paths").alias("paths"))
        for last in levels[-2:]:
            ahead = ahead.join(last.select("source", "node"), ["source", "node"], "left_anti")
        level = materialize(ahead.select("source", "node", F.lit(depth).alias("dist"), "paths"), "level")
        if level.isEmpty():
            drop(level)
            return levels
        levels.append(level)
    raise RuntimeError(f"some shortest path is longer than {max_depth}")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def shortest_paths(edges: DataFrame, sources: DataFrame | None = None, max_depth: int = 60) -> DataFrame:
    """(source, node, dist, paths): breadth-first search from all sources at once, level by level (GR10).

    ``paths`` counts the shortest paths. A level is one join and one aggregation over the frontier only, written to the shared
    folder; sources are all nodes unless a table with a column node is given.
    """
    both = materialize(symmetric(edges), "both")
    return _union(_levels(both, sources if sources is not None else both, max_depth))


def length_counts(edges: DataFrame, sources: DataFrame | None = None, size: int | None = None, max_depth: int = 60) -> DataFrame:
    """(dist, n_pairs): how many pairs of a source and another node lie so far apart; only counts are kept (GR10).

    Sources are all nodes unless a table with a column node is given. Without a ``size``, graphs of up to ``walks.MAX_EDGES``
    edges are walked in blocks, larger ones level by level for about ``size`` sources at a time.
    """
    if size is None and (held := walks.adjacency(edges)):
        return walks.length_counts(held, sources)

    def sums(both, levels):
        return _union(levels).where("dist > 0").groupBy("dist").agg(F.count("*").alias("n"))

    return _by_batches(edges, sums, size, max_depth, sources).groupBy("dist").agg(F.sum("n").alias("n_pairs"))


#: Sources whose paths are on disk at one time, in closeness and betweenness.
SOURCES = 4096


def _by_batches(edges: DataFrame, sums, size: int | None, max_depth: int, sources: DataFrame | None = None) -> DataFrame:
    """What ``sums(both, levels)`` gives for each batch of about ``size`` sources, the paths of a batch being deleted after it."""
    both = materialize(symmetric(edges), "both")
    nodes = both.select("node").distinct()
    nodes = materialize(nodes if sources is None else nodes.join(sources, "node", "left_semi"), "nodes")
    count = max(1, -(-nodes.count() // (size or SOURCES)))
    parts = []
    for i in range(count):
        levels = _levels(both, nodes.where(F.pmod(F.xxhash64("node"), F.lit(count)) == i), max_depth)
        parts.append(materialize(sums(both, levels), "sums"))
        drop(*levels)
    return _union(parts)


def closeness(edges: DataFrame, size: int | None = None, max_depth: int = 60) -> DataFrame:
    """(node, closeness): (r / total) * (r / (n - 1)) over the r nodes reached, n being all nodes (GR7).

    Without a ``size``, graphs of up to ``walks.MAX_EDGES`` edges are walked in blocks, larger ones level by level.
    """
    if size is None and (held := walks.adjacency(edges)):
        return walks.closeness(held)

    def sums(both, levels):
        return _union(levels).where("dist > 0").groupBy(F.col("source").alias("node")).agg(F.count("*").alias("r"), F.sum("dist").alias("total"))

    n = F.broadcast(symmetric(edges).agg(F.countDistinct("node").alias("n")))
    return _by_batches(edges, sums, size, max_depth).crossJoin(n).select("node", (F.col("r") / F.col("total") * F.col("r") / (F.col("n") - 1)).alias("closeness"))


def betweenness(edges: DataFrame, size: int | None = None, max_depth: int = 60) -> DataFrame:
    """(node, betweenness), scaled by 1 / ((n - 1)(n - 2)) with n the component's size; 0 for n of 2 or less (GR6).

    Dependencies are summed back from the farthest level: a node passes (1 + its dependency) times the share of its shortest
    paths to each predecessor. A level is one join and one aggregation. Sources are taken in batches of about ``size``; of a
    batch only the sums by node are kept. Without a ``size``, graphs of up to ``walks.MAX_EDGES`` edges are walked in blocks of
    sources over the neighbours' arrays instead.
    """
    if size is None and (held := walks.adjacency(edges)):
        return walks.betweenness(held)

    def sums(both, levels):
        below, kept = None, []
        for level, before in zip(levels[:0:-1], levels[-2::-1]):
            own = F.lit(0.0) if below is None else F.coalesce("dep", F.lit(0.0))
            level = level if below is None else level.join(below, ["source", "node"], "left")
            share = level.select("source", F.col("node").alias("w"), ((1 + own) / F.col("paths")).alias("share"))
            to = before.select("source", F.col("node").alias("v"), F.col("paths").alias("pv"))
            passed = share.join(both.select(F.col("node").alias("w"), F.col("other").alias("v")), "w").join(to, ["source", "v"])
            below = materialize(passed.groupBy("source", F.col("v").alias("node")).agg(F.sum(F.col("pv") * F.col("share")).alias("dep")), "dependency")
            kept.append(below)
        sizes = _union(levels).groupBy(F.col("source").alias("node")).agg(F.count("*").alias("n")).withColumn("dep", F.lit(0.0))
        if not kept:
            return sizes
        deps = _union(kept).where("source <> node").groupBy("node").agg(F.sum("dep").alias("dep"))
        return sizes.unionByName(deps.select("node", F.lit(0).cast("long").alias("n"), "dep"))

    total = _by_batches(edges, sums, size, max_depth).groupBy("node").agg(F.sum("n").alias("n"), F.sum("dep").alias("dep"))
    n = F.col("n")
    scaled = F.when(n <= 2, F.lit(0.0)).otherwise(F.col("dep") / ((n - 1) * (n - 2)))
    return total.select("node", scaled.alias("betweenness"))


def areas(value: str, top: float, floor: float = 7.0, ceiling: float = 520.0):
    """A node's area as a column, linear in its value from ``floor`` to ``ceiling`` at ``top``, the largest value or 1 (GR25)."""
    return floor + (ceiling - floor) * F.col(value) / F.lit(float(top or 1.0))


def ego_redundancy(ties: DataFrame, brokers: DataFrame) -> DataFrame:
    """(person, n_bodies, n_pairs, n_redundant): a broker's pairs of bodies, and those that share another member (GR20, JN19).

    Two bodies of a broker share another member if two people or more are in both: pairs of bodies are counted over all
    people once, and a broker's pairs look their counts up; members of bodies are never paired with pairs.
    """
    distinct = ties.select("person", "body").distinct()
    own = distinct.join(brokers.select("person").distinct(), "person")
    named = lambda rows: self_pairs(rows, "person", "body").where("a < b").select("person", F.col("a").alias("b1"), F.col("b").alias("b2"))
    pairs = named(own)
    shared = named(distinct).groupBy("b1", "b2").agg(F.count("*").alias("n")).where("n > 1").select("b1", "b2")
    linked = pairs.join(shared, ["b1", "b2"])
    n_pairs = pairs.groupBy("person").agg(F.count("*").alias("n_pairs"))
    return (
        own.groupBy("person").agg(F.count("*").alias("n_bodies"))
        .join(n_pairs, "person", "left").join(linked.groupBy("person").agg(F.count("*").alias("n_redundant")), "person", "left")
        .select("person", "n_bodies", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), F.coalesce("n_redundant", F.lit(0)).alias("n_redundant"))
    )


def attack_tolerance(edges: DataFrame, steps: list[int], seed: int = 42) -> DataFrame:
    """(strategy, removed, giant): the largest component left after removing the first nodes by degree or at random (GR19).

    All steps are one graph: a node's key carries the strategy and the step, and the components are found once.
    """
    from tiewright.operators.components import components

    ranked = global_rank(degrees(edges), [-F.col("degree"), F.col("node")], "targeted")
    order = global_rank(ranked, [F.md5(F.concat(F.lit(f"{seed}:"), F.col("node").cast("string"))), F.col("node")], "random").select("node", F.col("targeted").cast("int"), F.col("random").cast("int"))
    ranks = order.select("node", F.explode(F.create_map(F.lit("targeted"), F.col("targeted"), F.lit("random"), F.col("random"))).alias("strategy", "rank"))
    left = ranks.withColumn("removed", F.explode(F.array(*map(F.lit, steps)))).where("rank > removed").select("node", "strategy", "removed")
    left = materialize(left, "left")
    key = lambda n: F.struct("strategy", "removed", F.col(n).alias("node"))
    kept = edges.join(left.withColumnRenamed("node", "src"), "src").join(left.withColumnRenamed("node", "dst"), ["dst", "strategy", "removed"])
    found = components(kept.select(key("src").alias("src"), key("dst").alias("dst")))
    sizes = found.groupBy(F.col("component.strategy").alias("strategy"), F.col("component.removed").alias("removed"), "component").agg(F.count("*").alias("size"))
    giants = sizes.groupBy("strategy", "removed").agg(F.max("size").alias("giant"))
    alone = left.groupBy("strategy", "removed").agg(F.lit(1).alias("one"))
    return alone.join(giants, ["strategy", "removed"], "left").select("strategy", "removed", F.coalesce("giant", "one").cast("long").alias("giant"))
