"""Breadth-first walks from many sources over adjacency in blocks (GR6, GR7, GR10), for graphs of a checked size.

Edges are counted first. Up to MAX_EDGES, the neighbours of all nodes are two arrays of numbers, sent to the executors once;
Spark deals the sources out, and a task walks from a block of them together: a column for each source, a row for each node,
one gather and one sum by rows for each level. No pair of source and node leaves a task. Larger graphs give None, and callers
take the level-by-level joins of ``graph`` instead.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges whose arrays may be sent (8 bytes each, 40 MB), and cells of a block: ends of edges times sources.
MAX_EDGES, CELLS = 5_000_000, 6_000_000


@dataclass
class Adjacency:
    """``tails[starts[i]:starts[i + 1]]`` are the neighbours of node i; ``nodes``: (i, node)."""

    starts: np.ndarray
    tails: np.ndarray
    nodes: DataFrame
    shared: Broadcast

    @property
    def size(self) -> int:
        return len(self.starts) - 1


def adjacency(edges: DataFrame, most: int | None = None) -> Adjacency | None:
    """The arrays of canonical edges (src, dst; each pair once), or None if there are more than ``most`` or none."""
    most = MAX_EDGES if most is None else most
    spark, kind = edges.sparkSession, edges.schema["src"].dataType
    if kind.simpleString() not in ("tinyint", "smallint", "int", "bigint", "string"):
        return None
    found = edges.select("src", "dst").limit(most + 1).toArrow()
    if not 0 < found.num_rows <= most:
        return None
    ends = [found.column(i).to_numpy() for i in range(2)]
    ids, place = np.unique(np.concatenate(ends), return_inverse=True)
    one, two = np.split(place.astype(np.int32), 2)
    heads, tails = np.concatenate([one, two]), np.concatenate([two, one])
    order = np.argsort(heads, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(heads, minlength=len(ids)))]).astype(np.int64)
    nodes = spark.createDataFrame(pa.table({"i": pa.array(np.arange(len(ids)), pa.int64()), "node": pa.array(ids)})).withColumn("node", F.col("node").cast(kind))
    tails = tails[order]
    return Adjacency(starts, tails, nodes, spark.sparkContext.broadcast((starts, tails)))


def levels(starts: np.ndarray, tails: np.ndarray, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, number of shortest paths) of every node from every source, a column each; -1 and 0 where there is no path."""
    n, m = len(starts) - 1, len(sources)
    dist, paths, at = np.full((n, m), -1, np.int32), np.zeros((n, m)), np.arange(m)
    dist[sources, at], paths[sources, at] = 0, 1
    front, depth = paths.copy(), 0
    while front.any():
        depth += 1
        front = np.add.reduceat(front[tails], starts[:-1], axis=0) * (dist < 0)
        fresh = front > 0
        dist[fresh] = depth
        paths += front
    return dist, paths


def dependencies(starts: np.ndarray, tails: np.ndarray, dist: np.ndarray, paths: np.ndarray) -> np.ndarray:
    """For each node and source: the sum over other nodes of the share of the source's shortest paths that lead through the node."""
    passed = np.zeros(dist.shape)
    for depth in range(int(dist.max()), 1, -1):
        share = np.where(dist == depth, (1 + passed) / np.maximum(paths, 1), 0)
        passed += np.add.reduceat(share[tails], starts[:-1], axis=0) * paths * (dist == depth - 1)
    return passed


def _walked(graph: Adjacency, sources: DataFrame | None, schema: str, row) -> DataFrame:
    """Rows of ``row(starts, tails, block of sources)``, a record batch for each block of the sources' numbers ``i``."""
    spark, shared, block = graph.nodes.sparkSession, graph.shared, max(1, CELLS // max(1, len(graph.tails)))
    if sources is None:
        blocks = -(-graph.size // block)
        rows = spark.range(0, graph.size, 1, min(blocks, 4 * spark.sparkContext.defaultParallelism)).withColumnRenamed("id", "i")
    else:
        rows = graph.nodes.join(sources.select("node").distinct(), "node", "left_semi").select("i")

    def run(batches):
        starts, tails = shared.value
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for at in range(0, len(numbers), block):
                yield row(starts, tails, numbers[at : at + block])

    return rows.mapInArrow(run, schema)


def betweenness(graph: Adjacency) -> DataFrame:
    """(node, betweenness), as ``graph.betweenness`` gives it."""

    def row(starts, tails, sources):
        dist, paths = levels(starts, tails, sources)
        passed = dependencies(starts, tails, dist, paths).sum(1)
        size = np.zeros(len(passed), np.int64)
        size[sources] = (dist >= 0).sum(0)
        kept = np.flatnonzero((passed != 0) | (size != 0))
        return pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(size[kept]), pa.array(passed[kept])], names=["i", "n", "dep"])

    sums = _walked(graph, None, "i long, n long, dep double", row).groupBy("i").agg(F.sum("n").alias("n"), F.sum("dep").alias("dep"))
    n = F.col("n")
    scaled = F.when(n <= 2, F.lit(0.0)).otherwise(F.col("dep") / ((n - 1) * (n - 2)))
    return sums.join(graph.nodes, "i").select("node", scaled.alias("betweenness"))


def closeness(graph: Adjacency) -> DataFrame:
    """(node, closeness), as ``graph.closeness`` gives it."""

    def row(starts, tails, sources):
        dist, _ = levels(starts, tails, sources)
        return pa.RecordBatch.from_arrays([pa.array(sources, pa.int64()), pa.array((dist > 0).sum(0), pa.int64()), pa.array(np.where(dist > 0, dist, 0).sum(0, dtype=np.int64))], names=["i", "r", "total"])

    r = F.col("r")
    found = _walked(graph, None, "i long, r long, total long", row)
    return found.join(graph.nodes, "i").select("node", (r / F.col("total") * r / F.lit(graph.size - 1)).alias("closeness"))


def length_counts(graph: Adjacency, sources: DataFrame | None = None) -> DataFrame:
    """(dist, n_pairs) of the pairs of a source and another node that it reaches."""

    def row(starts, tails, some):
        counts = np.bincount((d := levels(starts, tails, some)[0])[d > 0])
        kept = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(counts[kept], pa.int64())], names=["dist", "n"])

    return _walked(graph, sources, "dist int, n long", row).groupBy("dist").agg(F.sum("n").alias("n_pairs"))
