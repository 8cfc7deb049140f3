"""Groups of texts whose sets of shingles have a Jaccard similarity of at least a threshold. No link is lost.

Sets of sizes a <= b with that similarity (j) have a >= j b and differ in at most d = (1 - j) / (1 + j) * (a + b) shingles.
Sizes fall into classes, and a set meets the larger ones in their class, so it takes part in its own class and in those up to
the class of its size / j. A class deals the shingles, by their hashes, to m parts, m greater than d of any two of its sets.
A shingle that only one of two sets has makes one part differ, so they agree in at least m - d parts; and of two lists of m
items that have m - d in common, the first d + 1 items, in any order that both share, have one in common. The order takes the
largest parts first, which other texts seldom share. So an equal join on these parts finds every pair; what it finds besides,
an exact comparison of the sets drops. A part is shared by chance far more seldom than a single shingle is.

Pairs are not made of whole groups: within a part each text meets the first one only, and what is linked by that is one group.
Texts of one part that are in different groups then meet each other as well, so no pair that a group does not already join is
left out. They meet where the part's members stand, by sketches that bound from below in how many shingles two sets differ: a
part's pairs are looked at, and only those that may be alike become rows.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiewright.llm.bpe import whole_text
from tiewright.llm.simhash import _groups, likeness, remixed, shingle_set
from tiewright.llm.skew import join_counted
from tiewright.operators.components import components
from tiewright.sources.tables import materialize

#: The largest size of each class of sizes: each half as large again as the one before.
TOPS = [4]
while TOPS[-1] < 1 << 40:
    TOPS.append(TOPS[-1] * 3 // 2)
#: Members of a part that meet in one piece.
BLOCK = 1000
_EDGE, _MEMBER = 0, 1


def part_keys(shingles: np.ndarray, similarity: float) -> np.ndarray:
    """Keys of the parts by which a set of hashes (in order, each once) meets those that are ``similarity`` alike."""
    j = Fraction(str(similarity))
    if not 0 < j <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    n, d = len(shingles), (1 - j) / (1 + j)
    largest, keys = int(n / j), []
    for c in range(*np.searchsorted(TOPS, [n, largest]) + [0, 1]):
        most = int(d * 2 * TOPS[c])
        m = most + most // 8 + 2
        part = ((shingles >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)  # rises with the hash
        sizes, sums = np.bincount(part, minlength=m), np.zeros(m, np.uint64)
        if n:
            sums[sizes > 0] = np.add.reduceat(remixed(shingles, 1), np.flatnonzero(np.diff(part, prepend=-1)))
        names = remixed(sums + np.arange(m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), c + 1)
        keys.append(names[np.lexsort((names, -sizes))[: int(d * (n + min(largest, TOPS[c]))) + 1]])
    return np.concatenate(keys)


def parts(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(part, node) of the texts ``body`` of ``texts``."""

    def run(batches):
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for at in range(0, len(nodes), 256):
                found = [part_keys(shingle_set(t, width), similarity) for t in batch.column(1).slice(at, 256).to_pylist()]
                many = np.repeat(nodes[at : at + 256], [len(k) for k in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(many)], names=["part", "node"])

    return texts.select("node", "body").mapInArrow(run, "part long, node long")


def _shared(batches):
    """Of sorted (part, node): edges from the first node of a part to its others, and the members of parts of three or more."""
    for key, node in _groups(batches, 1):
        key, node = key.view(np.int64), node.ravel().view(np.int64)
        once = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])  # a repeated row of documents
        key, node = key[once], node[once]
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(begins, len(key)))
        rest = np.ones(len(key), bool)
        rest[begins] = False
        edges = np.unique(np.stack([np.repeat(node[begins], sizes)[rest], node[rest]]), axis=1)
        many = np.repeat(sizes > 2, sizes)
        for kind, a, b in ((_EDGE, edges[0], edges[1]), (_MEMBER, key[many], node[many])):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])


def compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (src, dst) of ``pairs`` whose sets have a Jaccard similarity of ``similarity`` or more. ``sets``: node, shingles.

    Texts with many pairs meet them by a bounded broadcast.
    """
    met = pairs
    for end in ("src", "dst"):
        degrees = pairs.groupBy(F.col(end).alias("node")).agg(F.count("*").alias("n"))
        met = join_counted(met, sets.select("node", "shingles").join(degrees, "node").select(F.col("node").alias(end), F.col("shingles").alias(f"{end}_set"), "n"), end)

    def alike(batches):
        for batch in batches:
            one, two = ([np.frombuffer(x, np.uint64) for x in batch.column(i).to_pylist()] for i in (2, 3))
            keep = pa.array([likeness(a, b) >= similarity for a, b in zip(one, two)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["src", "dst"])

    return materialize(met.select("src", "dst", "src_set", "dst_set").mapInArrow(alike, "src long, dst long"), "verified")


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles by their hashes' last bits, in at least four bits for each shingle.

    Two sets' sketches differ in no more bits than the sets in shingles, and so they do when they are folded to half the length.
    """
    bits = 64 << max(0, (len(shingles) - 1) >> 4).bit_length()
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(found: np.ndarray, words: int) -> np.ndarray:
    """A sketch at a smaller length."""
    while len(found) > words:
        found = found[: len(found) // 2] ^ found[len(found) // 2 :]
    return found


def _near(unit: pa.Table, j: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one unit's rows (side, group, node, size, sketch) of different groups whose sketches do not rule them out."""
    side, group, node, size = (unit.column(c).to_numpy() for c in ("side", "group", "node", "size"))
    own = [np.frombuffer(x, np.uint64) for x in unit.column("sketch").to_pylist()]
    least = min(map(len, own))
    own = np.stack([folded(x, least) for x in own])
    ends = []
    for i in range(len(node) - 1):
        rest = i + 1 + np.flatnonzero((group[i + 1 :] != group[i]) & ((side[i] == 2) | (side[i + 1 :] != side[i])))
        if len(rest):
            differ = np.bitwise_count(own[rest] ^ own[i]).sum(axis=1, dtype=np.int64)
            rest = rest[differ * (j.denominator + j.numerator) <= (size[rest] + size[i]) * (j.denominator - j.numerator)]
            ends.append(np.stack([np.full(len(rest), node[i]), node[rest]]))
    both = np.concatenate(ends, axis=1) if ends else np.empty((2, 0), np.int64)
    return both.min(axis=0), both.max(axis=0)


def across_groups(members: DataFrame, links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(src, dst), each once: pairs of nodes that share a part, are in different components of ``links`` and may be alike.

    Whether they may be is told by their sketches where the members of a part stand together, so no other pair becomes a row.
    A part of more than ``BLOCK`` members is dealt out as squares of blocks.
    """
    labels, j = materialize(components(links), "labels"), Fraction(str(similarity))
    placed = materialize(members.join(labels, "node", "left").select("part", "node", F.coalesce("component", "node").alias("group")), "members")
    blocks = F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")
    mixed = placed.groupBy("part").agg(F.min("group").alias("low"), F.max("group").alias("high"), blocks).where("low < high").select("part", "blocks")
    own, other = F.col("own"), F.col("other")
    dealt = placed.join(mixed, "part").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(own == other, 2).when(own < other, 0).otherwise(1).alias("side")
    dealt = dealt.select(F.xxhash64("part", F.least(own, other), F.greatest(own, other)).alias("unit"), side, "group", "node")
    rows = dealt.join(sets.select("node", "size", "sketch"), "node").select("unit", "side", "group", "node", "size", "sketch")

    def run(batches):
        held: list[pa.Table] = []
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            unit = whole.column("unit").to_numpy()
            bounds = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
            for at, end in zip(bounds, bounds[1:]):
                if held and at == 0 and len(unit) and held[0].column("unit")[0].as_py() != unit[0]:
                    yield solved(held)
                    held = []
                if end > at:
                    held.append(whole.slice(at, end - at))
                if end < len(unit):
                    yield solved(held)
                    held = []
        if held:
            yield solved(held)

    def solved(held: list[pa.Table]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _near(pa.concat_tables(held), j)], names=["src", "dst"])

    return rows.repartition("unit").sortWithinPartitions("unit", "side", "node").mapInArrow(run, "src long, dst long").distinct()


def alike_groups(docs: DataFrame, width: int, similarity: float, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: the key as doc_id, mark (a hash of the whole text), component (a mark) and component_id.

    Texts whose sets of ``width``-word shingles have a Jaccard similarity of ``similarity`` or more are linked, all of them;
    component_id is the smallest key that links lead to. Texts without words are alike. Null texts count as empty. Rows with
    a null key get a result and lend no id; an empty table gives an empty result. Texts that differ and have the same hash
    stop the query. Other columns are not read, so their names cannot clash.
    """
    own = docs.select(F.col(key).alias("doc_id"), whole_text(text).alias("body")).withColumn("mark", F.xxhash64("body"))
    rows = materialize(own.select("doc_id", "mark", F.xxhash64(F.lit(1), "body").alias("other")), "marks")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("one")
    distinct = materialize(rows.groupBy("mark").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), one, F.min("other").alias("low"), F.max("other").alias("high")), "distinct")
    if not distinct.where("low < high").isEmpty():
        raise ValueError("two different texts have the same 64-bit hash")

    def texts(nodes: DataFrame) -> DataFrame:
        picked = nodes.select(F.col("mark").alias("node"), F.col("one.id").alias("id"))
        return own.join(picked, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("node"))).select("node", "body")

    dealt = parts(texts(distinct), width, similarity).repartition("part").sortWithinPartitions("part", "node")
    found = materialize(dealt.mapInArrow(_shared, "kind int, a long, b long"), "shared")
    edges = materialize(found.where(F.col("kind") == _EDGE).select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "edges")
    members = found.where(F.col("kind") == _MEMBER).select(F.col("a").alias("part"), F.col("b").alias("node"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("mark")).distinct()

    def made(batches):
        for batch in batches:
            found = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            columns = pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([sketch(x).tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["node", "size", "shingles", "sketch"])

    sets = materialize(texts(distinct.join(ends, "mark", "left_semi")).mapInArrow(made, "node long, size long, shingles binary, sketch binary").dropDuplicates(["node"]), "sets")
    links = compared(edges, sets, similarity)
    more = materialize(across_groups(members, links, sets, similarity).join(edges, ["src", "dst"], "left_anti"), "edges")
    if not more.isEmpty():
        links = links.unionByName(compared(more, sets, similarity))
    labels = materialize(components(links).withColumnRenamed("node", "mark").join(distinct.select("mark", "first_id"), "mark"), "linked")
    ids = labels.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    labels = join_counted(labels.select("mark", "component"), ids, "component")
    labelled = distinct.join(labels, "mark", "left").select("mark", "n", F.coalesce("component", "mark").alias("component"), F.coalesce("component_id", "first_id").alias("component_id"))
    return join_counted(rows.select("doc_id", "mark"), materialize(labelled, "labels"), "mark").select("doc_id", "mark", "component", "component_id")
