"""Connected components over an edge table (GR2, GR3, GR17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiewright.sources.tables import drop, materialize


def _tally(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Alternates two contractions until the edges no longer change: each node passes its least neighbour to the larger
    neighbours, then to the smaller ones. Both are one aggregation and one join, and the number of rounds grows with the
    logarithm of the longest path. Edges are written to the shared folder after each round, so that a lost executor
    costs one round. Self-loops, repeated edges and edges with a null end are allowed; the latter are left out.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = materialize(e.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "nodes")
    current = materialize(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _tally(current)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that a hub's rows may be split in the join: below an aggregate they could not
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        previous, current = current, materialize(small, "edges")
        drop(previous, least)  # their readers have been written
        after = _tally(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.join(roots, nodes.node == roots.u, "left").select("node", F.coalesce("root", "node").alias("component"))


def component_sizes(labelled: DataFrame) -> DataFrame:
    """(component, size, rank): rank 1 is the giant component, by size and then by smallest member."""
    from tiewright.operators.ranking import global_rank

    sizes = labelled.groupBy("component").agg(F.count("*").alias("size"))
    return global_rank(sizes, [-F.col("size"), F.col("component")])


def giant(labelled: DataFrame) -> DataFrame:
    """The nodes of the largest component; of equally large ones, that with the smallest member."""
    top = labelled.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), F.asc("component")).limit(1)
    return labelled.join(F.broadcast(top), "component", "left_semi")


def size_distribution(labelled: DataFrame) -> DataFrame:
    """(size, n_components, n_nodes)."""
    sizes = labelled.groupBy("component").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n_components"), F.sum("size").alias("n_nodes"))
