"""Hard negatives for anchors among all rows, through k-means inverted lists.

Centroids are fitted on a bounded sample; every row goes to the list of its nearest centroid, and each list stores its radius,
the largest distance of a row from the centroid. By Cauchy-Schwarz no row of a list has an inner product with the anchor above
``<anchor, centroid> + |anchor| * radius``, nor one below ``<anchor, centroid> - |anchor| * radius``. An anchor visits lists in
the order of their upper bounds, in a few rounds; it skips lists that lie outside its window, and stops where the bound falls
strictly below the score of its last place. So what is found is exact: no list that could hold a row of the result is left out.

Lists are cut into blocks of bounded size by a hash of the id. A round sends each visit to its block, where the blocks and the
visits to them are read as one sorted stream: a task holds one block, however many anchors visit it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiewright.sources.tables import drop, materialize

SCALE, KEEP = 256, 5
#: Rows (those of the smallest hashes) that centroids are fitted on, rows of a list aimed at, most lists, rows of a block.
SAMPLE, LIST_ROWS, MAX_LISTS, BLOCK_ROWS = 20_000, 1024, 1024, 2048
#: Lists visited in each round, counted in the order of their bounds; the last round visits all that are still to be seen.
ROUNDS = (1, 6, MAX_LISTS)
#: Beyond what rounding can do to a bound, as a share of the numbers it is made from.
SLACK = 1e-9

WANTS = "array<struct<id:long,top:long,least:long>>"
FOUND = "anchor_id long, positive_id long, positive_score long, id long, score long"


def packed(numbers: np.ndarray) -> bytes:
    """Integers in as few bytes each as all of them need."""
    most = int(np.abs(numbers).max(initial=0))
    return numbers.astype("<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8").tobytes()


def unpacked(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // count}") if count else np.zeros(0, np.int64)


def scaled(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a list column as rows of floor(SCALE * x), shorter ones filled up with zeros."""
    out = np.zeros((len(column), dims))
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out[np.arange(dims) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(out * SCALE)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def taking_part(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """id, label, vector of the rows that have an id, a label and a vector of finite components."""
    named = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)


def bounds(vector: np.ndarray, centroids: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For one anchor: no score in a list is above the first or below the second."""
    middle, length = centroids @ vector, float(np.sqrt(vector @ vector))
    spread = length * radii + SLACK * (1 + length * (np.sqrt((centroids**2).sum(1)) + radii))
    return middle + spread, middle - spread


def asked(want: dict, upper: float, lower: float) -> bool:
    """Whether a list between these bounds may hold a score that the want asks for."""
    return (want["least"] is None or upper >= want["least"]) and (want["top"] is None or lower <= want["top"])


class Lists:
    """Inverted lists of all rows: centroids, radii and the numbers of blocks on the driver (MAX_LISTS at most), rows in a table."""

    def __init__(self, rows: DataFrame):
        """``rows``: id, label, vector. Identical rows are kept once; rows that share an id and differ are kept each."""
        size = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
        self.rows, self.dims = size[0], max(1, size[1] or 0)
        self.centroids = self._fitted(rows)
        assigned = materialize(self._assigned(rows), "assigned")
        known = {r.cluster: r for r in assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}
        self.radii = np.array([known[c].radius if c in known else 0.0 for c in range(len(self.centroids))])
        self.blocks = np.array([-(-known[c].n // BLOCK_ROWS) if c in known else 0 for c in range(len(self.centroids))], dtype=np.int64)
        self.assigned, self.table = assigned, materialize(self._in_blocks(assigned), "lists")

    def _fitted(self, rows: DataFrame) -> np.ndarray:
        if not self.rows:
            return np.zeros((0, self.dims))
        filled = F.transform(F.sequence(F.lit(1), F.lit(self.dims)), lambda i: F.floor(F.coalesce(F.try_element_at("vector", i), F.lit(0.0)) * SCALE).cast("double"))
        sample = materialize(rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(array_to_vector(filled).alias("features")), "sample")
        lists = int(min(MAX_LISTS, max(1, self.rows // LIST_ROWS)))
        model = KMeans(k=max(2, lists), seed=1, maxIter=10).fit(sample)
        centroids = np.array(model.clusterCenters()).reshape(-1, self.dims)
        drop(sample)
        return centroids

    def _assigned(self, rows: DataFrame) -> DataFrame:
        centroids, dims = self.centroids, self.dims
        norms = (centroids**2).sum(1)

        def run(batches):
            for batch in batches:
                vectors = scaled(batch.column(2), dims)
                nearest = np.concatenate([np.zeros(0, np.int64), *((norms - 2 * (vectors[i : i + 2048] @ centroids.T)).argmin(1) for i in range(0, len(vectors), 2048))])
                far = np.sqrt(((vectors - centroids[nearest]) ** 2).sum(1))
                whole = vectors.astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nearest, pa.int32()), pa.array(far), pa.array([packed(v) for v in whole], pa.binary())], names=["id", "label", "cluster", "far", "vector"])

        return rows.mapInArrow(run, "id long, label long, cluster int, far double, vector binary")

    def _in_blocks(self, assigned: DataFrame) -> DataFrame:
        dims, spark = self.dims, assigned.sparkSession
        sizes = spark.createDataFrame([(c, int(n)) for c, n in enumerate(self.blocks)], "cluster int, blocks long")
        placed = assigned.join(F.broadcast(sizes), "cluster").select("cluster", F.expr("cast(pmod(xxhash64(id), blocks) as int)").alias("block"), "id", "label", "vector")

        def block(key, rows: dict) -> dict:
            order = sorted(rows)
            vectors = np.array([unpacked(v, dims).astype(np.int64) for _, _, v in order])
            return {"cluster": key[0], "block": key[1], "ids": packed(np.array([r[0] for r in order])), "labels": packed(np.array([r[1] for r in order])), "vectors": packed(vectors), "n": len(order)}

        def run(batches):
            key, held = None, {}
            for batch in batches:
                out = []
                for c, b, *row in zip(*(x.to_pylist() for x in batch.columns)):
                    if key != (c, b):
                        if held:
                            out.append(block(key, held))
                        key, held = (c, b), {}
                    held[tuple(row)] = True
                yield pa.RecordBatch.from_pylist(out, schema)
            if held:
                yield pa.RecordBatch.from_pylist([block(key, held)], schema)

        schema = pa.schema([("cluster", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("n", pa.int32())])
        dealt = placed.repartition("cluster", "block").sortWithinPartitions("cluster", "block")
        return dealt.mapInArrow(run, "cluster int, block int, ids binary, labels binary, vectors binary, n int")

    def visits(self, anchors: DataFrame, first: int, last: int) -> DataFrame:
        """Visits of ``anchors`` (anchor_id, label, vector, wants) to the lists at the places ``first`` to ``last`` of their bounds.

        Each of ``wants`` asks for scores between ``least`` and ``top``; a list is visited if one of them may be in it.
        """
        dims, blocks, centroids, radii = self.dims, self.blocks, self.centroids, self.radii

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    upper, lower = bounds(unpacked(row["vector"], dims).astype(np.float64), centroids, radii)
                    out = []
                    for c in np.argsort(-upper, kind="stable")[first:last]:
                        if wants := [w for w in row["wants"] if asked(w, upper[c], lower[c])]:
                            out.append((int(c), int(blocks[c]), row["anchor_id"], row["label"], row["vector"], wants))
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema)

        want = pa.list_(pa.struct([(c, pa.int64()) for c in ("id", "top", "least")]))
        schema = pa.schema([("cluster", pa.int32()), ("blocks", pa.int64()), ("anchor_id", pa.int64()), ("label", pa.int64()), ("vectors", pa.binary()), ("wants", want)])
        made = anchors.mapInArrow(run, f"cluster int, blocks long, anchor_id long, label long, vectors binary, wants {WANTS}").where("blocks > 0")
        empty = F.lit(None).cast("binary")
        return made.select("cluster", F.explode(F.expr("sequence(0, cast(blocks - 1 as int))")).alias("block"), F.lit(1).alias("kind"), empty.alias("ids"), empty.alias("labels"), "vectors", "anchor_id", "label", "wants")

    def scores(self, visits: DataFrame, same: bool) -> DataFrame:
        """For every want of a visit the first KEEP rows of the block, of the anchor's label (``same``; not itself) or of others."""
        dims = self.dims
        held = self.table.select("cluster", "block", F.lit(0).alias("kind"), "ids", "labels", "vectors", F.col("n").cast("long").alias("anchor_id"), F.lit(None).cast("long").alias("label"), F.lit(None).cast(WANTS).alias("wants"))
        stream = held.unionByName(visits).repartition("cluster", "block").sortWithinPartitions("cluster", "block", "kind")
        schema = pa.schema([(c, pa.int64()) for c in ("anchor_id", "positive_id", "positive_score", "id", "score")])

        def run(batches: Iterator[pa.RecordBatch]):
            ids = labels = vectors = None
            for batch in batches:
                out: list[tuple] = []
                for row in batch.to_pylist():
                    if row["kind"] == 0:
                        n = row["anchor_id"]
                        ids, labels, vectors = unpacked(row["ids"], n), unpacked(row["labels"], n), unpacked(row["vectors"], n * dims).reshape(n, dims)
                        continue
                    score = products(unpacked(row["vectors"], dims)[None], vectors)[0]
                    fit = (labels == row["label"]) & (ids != row["anchor_id"]) if same else labels != row["label"]
                    for want in row["wants"]:
                        out += [(row["anchor_id"], want["id"], want["top"], i, s) for s, i in first_places(score, ids, fit, want["top"], want["least"])]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)] or [pa.array([], pa.int64())] * 5, schema=schema)

        return stream.mapInArrow(run, FOUND)

    def search(self, anchors: DataFrame, same: bool) -> DataFrame:
        """For each want of ``anchors`` (anchor_id, label, vector, wants) its first KEEP rows, found in rounds; written."""
        spark = anchors.sparkSession
        found = spark.createDataFrame([], FOUND)
        first = 0
        for i, width in enumerate(ROUNDS):
            if first and first >= len(self.centroids):
                break
            asking = anchors if not i else self._still_asking(anchors, found)
            fresh = self.scores(self.visits(asking, first, first + width), same)
            order = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("score"), "id")
            better = materialize(found.unionByName(fresh).withColumn("place", F.row_number().over(order)).where(f"place <= {KEEP}").drop("place"), "found")
            if i:
                drop(found)
            found, first = better, first + width
        return found

    @staticmethod
    def _still_asking(anchors: DataFrame, found: DataFrame) -> DataFrame:
        """``anchors`` whose wants know the score of their last place, where all places are filled."""
        last = found.groupBy("anchor_id", "positive_id", "positive_score").agg(F.count("*").alias("n"), F.min("score").alias("worst")).where(f"n >= {KEEP}")
        last = last.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score", "worst")).alias("places"))
        worst = "get(filter(places, x -> x.positive_id <=> w.id and x.positive_score <=> w.top), 0).worst"
        known = F.expr(f"transform(wants, w -> named_struct('id', w.id, 'top', w.top, 'least', greatest(w.least, {worst})))")
        return anchors.join(last, "anchor_id", "left").select("anchor_id", "label", "vector", F.when(F.col("places").isNull(), F.col("wants")).otherwise(known).alias("wants"))


def first_places(score: np.ndarray, ids: np.ndarray, fit: np.ndarray, top: int | None, least: int | None) -> list[tuple[int, int]]:
    """(score, id) of the first KEEP that fit, highest scores first, ties by smaller id."""
    if top is not None:
        fit = fit & (score <= top)
    if least is not None:
        fit = fit & (score >= least)
    at = np.flatnonzero(fit)
    if len(at) > KEEP:
        at = at[score[at] >= np.partition(score[at], -KEEP)[-KEEP]]
    at = at[np.lexsort((ids[at], -score[at]))][:KEEP]
    return [(int(score[i]), int(ids[i])) for i in at]


def hard_negatives(embeddings: DataFrame, every: int = 100, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors are the rows of ids divisible by ``every``.

    A positive without negatives gives no row (one of a score below 0 has an empty window), and neither does an anchor without
    positives. Rows without an id, label or vector or with a component that is null or not finite take no part; empty and
    shorter vectors count as filled up with zeros. Identical rows count once; rows that share an id but differ count each, the
    anchor being the one of smallest label and bytes, and no row of its id being its positive. Equal scores go by the smaller
    id. An empty table gives no rows; other columns are not read. Scores are to fit a long.
    """
    lists = Lists(taking_part(embeddings, key, vector, label))
    chosen = lists.assigned.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("own"))
    anchors = materialize(chosen.select(F.col("id").alias("anchor_id"), "own.label", "own.vector"), "anchors")
    nothing = "cast(null as bigint)"
    positives = lists.search(anchors.withColumn("wants", F.expr(f"array(named_struct('id', {nothing}, 'top', {nothing}, 'least', {nothing}))")), same=True)
    # 80 * positive <= 100 * negative holds from the integer ceil(4/5 * positive) on
    windows = positives.where("score >= 0").groupBy("anchor_id").agg(F.collect_list(F.expr("named_struct('id', id, 'top', score, 'least', (4 * score + 4) div 5)")).alias("wants"))
    negatives = lists.search(anchors.join(windows, "anchor_id"), same=False)
    drop(lists.assigned, lists.table, anchors, positives)
    order = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("score"), "id")
    return negatives.select("anchor_id", "positive_id", F.row_number().over(order).alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    shifted = F.expr("case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else label end")
    return hard_negatives(rows.withColumn("label", shifted))


SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
negatives AS (
  SELECT p.anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS place
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, place::INT AS rank, negative_id, positive_score, negative_score FROM negatives WHERE place <= 5
"""
