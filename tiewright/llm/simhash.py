"""SimHash fingerprints and their links, by a segment-popcount embedding.

A fingerprint's bits are cut into segments of 2 bits. The vector of the segments' bit counts (0, 1 or 2) is its embedding: the
Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints. A grid keeps some axes of the
embedding (an axis is one or more neighbouring segments); fingerprints that agree on them share a cell of that grid. A range
join is thus an equal join on (grid, cell). Inside a cell the Manhattan distance is checked first, then the Hamming distance.

``exact_scheme``: one 64-bit word, 8 axes of 4 segments, all grids that keep 8 - bits axes. Embeddings within Manhattan
distance ``bits`` differ on at most that many axes, so every link has a cell of its own in some grid: no link is lost.

``wide_scheme``: several words from as many sets of hashes of the same shingles, for links far beyond a few bits. The share of
differing bits then estimates the similarity, and grids of a few segments are dealt out from shuffled segments: a pair whose
bits differ with probability p shares the cell of a grid of k segments with probability q = (1 - 2p + 1.5 p^2)^k, and misses
all G grids with (1 - q)^G. This search is not exact as that of the exact scheme is: the tests measure its recall. Where all
texts of a similarity are to be linked, ``alike`` finds them.

Pairs are not emitted. From every cell, whatever its size, leave only the edges of a spanning forest over its links, and of
these only edges whose ends share no cell of an earlier grid: such ends are connected already by what the earlier grids
emit (by induction over the grids). The edges have the components of all links. A cell of more than ``BLOCK`` fingerprints is
dealt out as pairs of blocks to many tasks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiewright.llm.bpe import whole_text
from tiewright.llm.skew import join_counted, unused
from tiewright.operators.components import components
from tiewright.sources.tables import materialize

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED = 42
#: Cells of up to SMALL members are compared in one vector operation for all; larger ones one by one. Both give a forest.
SMALL, BLOCK = 64, 8192
#: Shingles hashed at once.
STRIDE = 1 << 16
_M1 = np.uint64(0x5555555555555555)
#: A byte's bits as the eight bytes of a number, so that 255 of them can be added without carry.
_LANES = np.array([sum((b >> i & 1) << 8 * i for i in range(8)) for b in range(256)], np.uint64)


@dataclass(frozen=True)
class Scheme:
    """Fingerprints of ``words`` 64-bit words that link at ``bits`` differing bits or fewer; ``grids`` of axes of ``axis`` segments."""

    words: int
    bits: int
    axis: int
    grids: tuple[tuple[int, ...], ...]

    @property
    def kind(self) -> str:
        return "long" if self.words == 1 else "binary"


def exact_scheme(bits: int = 4) -> Scheme:
    """One word; every pair within ``bits`` (0 to 7) shares a cell. For 4 bits: 70 grids."""
    if not 0 <= bits <= 7:
        raise ValueError("bits must be 0 to 7")
    return Scheme(1, bits, 4, tuple(combinations(range(8), 8 - bits)))


def wide_scheme(words: int = 8, bits: int = 86, segments: int = 9, grids: int = 56) -> Scheme:
    """For links by similarity: 512 bits, of which 86 may differ, and 56 grids of 9 segments dealt from shuffled segments.

    Two sets of shingles of similarity j differ in a bit with probability acos(2j / (1 + j)) / pi: 0.15 at 0.8, where the
    mean of the differing bits is 78 and their deviation 8. The number of pairs compared by chance is
    grids * n^2 / 2 / 2^(1.5 * segments); for corpora of far more than 10^8 different texts take more segments and more grids.
    """
    dealt, rng = [], np.random.default_rng(SEED)
    while len(dealt) < grids:
        order = rng.permutation(32 * words)
        dealt += [tuple(order[i : i + segments].tolist()) for i in range(0, len(order) - segments + 1, segments)]
    return Scheme(words, bits, 1, tuple(dealt[:grids]))


EXACT, WIDE = exact_scheme(), wide_scheme()


def remixed(hashes: np.ndarray, table: int) -> np.ndarray:
    """Other hashes of the same shingles, one set for each word; word 0 has the hashes themselves."""
    if not table:
        return hashes
    x = hashes + np.uint64(table * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, width: int):
    """Hashes of the ``width``-word shingles of a text (of all its words, if it has fewer), repeats included, STRIDE at a time."""
    found = WORD.findall(text.encode("utf-8", "surrogatepass").translate(LOWER))
    n = len(found)
    if not n:
        return
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    k, digest = min(width, n), xxhash.xxh64_intdigest
    starts, stops = (ends - lengths)[: n - k + 1].tolist(), ends[k - 1 :].tolist()
    for at in range(0, len(starts), STRIDE):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + STRIDE], stops[at : at + STRIDE])], np.uint64)


def simhash(text: str, width: int = 4) -> int:
    """Fingerprint of the ``width``-word shingles of a text, repeats included; 0 for a text without words."""
    return int(simhashes(text, width, 1)[0])


def simhashes(text: str, width: int, words: int) -> np.ndarray:
    """The words of a text's fingerprint, from as many sets of hashes of its shingles."""
    total, m = np.zeros(64 * words, np.int64), 0
    for hashes in shingle_hashes(text, width):
        m += len(hashes)
        rows = np.stack([remixed(hashes, i) for i in range(words)], axis=1).view(np.uint8)
        for low in range(0, len(rows), 255):
            total += _LANES[rows[low : low + 255]].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * total > m, bitorder="little").view(np.uint64)


def shingle_set(text: str, width: int) -> np.ndarray:
    """The different hashes of a text's shingles, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, width)]))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes; 1 if both are empty."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 1.0


def _column(fp: np.ndarray) -> pa.Array:
    """Fingerprints (n, words) as a column: longs, or bytes if they have several words."""
    n, words = fp.shape
    fp = np.ascontiguousarray(fp)
    if words == 1:
        return pa.array(fp.ravel().view(np.int64))
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 8 * words * n + 1, 8 * words, dtype=np.int32)), pa.py_buffer(fp.tobytes())])


def _prints(column: pa.Array, words: int) -> np.ndarray:
    if words == 1:
        return column.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, words)


def fingerprints(docs: DataFrame, width: int = 4, text: str = "text", key: str = "doc_id", words: int = 1) -> DataFrame:
    """(doc_id, mark, fp): a hash of each whole text, and its fingerprint. Null texts count as empty, with all bits 0."""
    rows = docs.select(F.col(key).alias("doc_id"), whole_text(text).alias("body")).withColumn("mark", F.xxhash64("body"))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = np.array([simhashes(t, width, words) for t in texts], np.uint64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), _column(found)], names=["doc_id", "mark", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, mark long, fp {'long' if words == 1 else 'binary'}")


def popcounts(fp: np.ndarray) -> np.ndarray:
    """The embedding of unsigned fingerprints, packed: counts of 2 bits each, segment 0 of a word lowest."""
    return (fp & _M1) + ((fp >> np.uint64(1)) & _M1)


def cells(fp: np.ndarray, scheme: Scheme) -> np.ndarray:
    """(fingerprints, grids): each fingerprint's cell in each grid, the grid's number in the high bits."""
    packed, size = popcounts(fp), 2 * scheme.axis
    mask, a_word = np.uint64((1 << size) - 1), 64 // size
    axes = {a: (packed[:, a // a_word] >> np.uint64(size * (a % a_word))) & mask for a in {a for grid in scheme.grids for a in grid}}
    out = np.empty((len(fp), len(scheme.grids)), np.uint64)
    for g, grid in enumerate(scheme.grids):
        value = np.full(len(fp), g, np.uint64)
        for a in grid:
            value = (value << np.uint64(size)) | axes[a]
        out[:, g] = value
    return out


def grid_of(cell: np.ndarray, scheme: Scheme) -> np.ndarray:
    return (cell >> np.uint64(2 * scheme.axis * len(scheme.grids[0]))).astype(np.int64)


def first_grids(x: np.ndarray, y: np.ndarray, scheme: Scheme) -> np.ndarray:
    """The first grid in which each pair shares a cell; 0 also for pairs that share none."""
    out = [np.argmax(cells(x[at : at + 8192], scheme) == cells(y[at : at + 8192], scheme), axis=1) for at in range(0, len(x), 8192)]
    return np.concatenate(out) if out else np.empty(0, np.int64)


def within(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """Whether fingerprints lie within ``bits``: first by the Manhattan distance of their embeddings, then exactly."""
    differ = popcounts(x) ^ popcounts(y)
    odd = differ & _M1  # counts of unequal parity differ by one, others by nothing or two
    hit = np.bitwise_count(odd).sum(-1, dtype=np.int64) + 2 * np.bitwise_count((differ >> np.uint64(1)) & ~differ & _M1).sum(-1, dtype=np.int64) <= bits
    at = np.flatnonzero(hit)
    hit[at] = np.bitwise_count((x if x.ndim == 1 else x[at]) ^ y[at]).sum(-1, dtype=np.int64) <= bits
    return hit


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labels after the pairs (a, b) are joined, numbers of pairs that suffice for that): a label is its set's least place."""
    chosen = []
    while len(live := np.flatnonzero(label[a] != label[b])):
        high, low = np.maximum(label[a[live]], label[b[live]]), np.minimum(label[a[live]], label[b[live]])
        tops, first = np.unique(high, return_index=True)
        chosen.append(live[first])
        up = np.arange(len(label))
        up[tops] = low[first]
        while not np.array_equal(up, higher := up[up]):
            up = higher
        label = up[label]
    return label, np.concatenate(chosen) if chosen else np.empty(0, np.int64)


def forest(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of breadth-first trees over the links within one cell, as places of their ends."""
    ends, rest = [], np.arange(len(fp))
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            hit = within(fp[x], fp[rest], bits)
            if hit.any():
                found = rest[hit]
                ends.append(np.stack([np.full(len(found), x), found]))
                frontier += found.tolist()
                rest = rest[~hit]
    both = np.concatenate(ends, axis=1) if ends else np.empty((2, 0), np.int64)
    return both[0], both[1]


def across(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of breadth-first trees over the links between two blocks of a cell, as fingerprints."""
    ends, sides = [np.empty((2, 0, left.shape[1]), np.uint64)], [left, right]
    while len(sides[0]) and len(sides[1]):
        frontier, sides[0] = [(0, sides[0][0])], sides[0][1:]
        while frontier:
            side, x = frontier.pop()
            other = sides[1 - side]
            hit = within(x, other, bits)
            if hit.any():
                found = other[hit]
                ends.append(np.stack([np.broadcast_to(x, found.shape), found]))
                frontier += [(1 - side, y) for y in found]
                sides[1 - side] = other[~hit]
    both = np.concatenate(ends, axis=1)
    return both[0], both[1]


def _groups(batches, words: int):
    """(cells, fingerprints) of consecutive whole cells, from batches sorted by cell."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        now = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), _prints(batch.column(1), words)
        if not len(now[0]):
            continue
        last = int(np.flatnonzero(now[0] == now[0][-1])[0])
        if last == 0 and (not held or held[-1][0][-1] == now[0][0]):
            held.append(now)  # one cell begins or goes on
            continue
        yield tuple(np.concatenate([*(h[i] for h in held), now[i][:last]]) for i in range(2))
        held = [tuple(c[last:] for c in now)]
    if held:
        yield tuple(np.concatenate([h[i] for h in held]) for i in range(2))


_EDGE, _WORK = 0, 1


def _rows(kind: int, a: pa.Array, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(b), kind, np.int32)), a, _column(b)], names=["kind", "a", "b"])


def _small_cells(key: np.ndarray, fp: np.ndarray, small: np.ndarray, most: int, scheme: Scheme):
    """Edges (places) over all small cells at once; ends that share an earlier cell are joined first, and give none."""
    ends = []
    for step in range(1, most):
        at = np.flatnonzero(small[:-step] & (key[step:] == key[:-step]))
        if not len(at):
            break
        at = at[within(fp[at], fp[at + step], scheme.bits)]
        ends.append(np.stack([at, at + step]))
    both = np.concatenate(ends, axis=1) if ends else np.empty((2, 0), np.int64)
    if not both.shape[1]:
        return both
    if scheme.words > 1:  # the nearest first
        both = both[:, np.argsort(np.bitwise_count(fp[both[0]] ^ fp[both[1]]).sum(-1), kind="stable")]
    members, place = np.unique(both, return_inverse=True)
    place = place.reshape(both.shape)
    placed, own = cells(fp[members], scheme), grid_of(key[members], scheme)
    old = np.concatenate([np.argmax(placed[p[0]] == placed[p[1]], axis=1) < own[p[0]] for p in (place[:, at : at + 8192] for at in range(0, place.shape[1], 8192))])
    label, _ = joined(np.arange(len(members)), *place[:, old])
    fresh = np.flatnonzero(~old)
    _, chosen = joined(label, *place[:, fresh])
    return both[:, fresh[chosen]]


def _search(batches, scheme: Scheme, block: int):
    """Edges found in whole cells, and for cells of more than ``block`` members rows of work: (unit, fingerprint)."""
    for key, fp in _groups(batches, scheme.words):
        bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        sizes = np.diff(bounds)
        small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
        a, b = _small_cells(key, fp, small, min(SMALL, int(sizes.max(initial=0))) if small.any() else 1, scheme)
        if len(a):
            yield _rows(_EDGE, _column(fp[a]), fp[b])
        for i in np.flatnonzero(sizes > SMALL):
            members, grid = fp[bounds[i] : bounds[i + 1]], int(grid_of(key[bounds[i] : bounds[i] + 1], scheme)[0])
            if len(members) <= block:
                a, b = (members[x] for x in forest(members, scheme.bits))
                fresh = first_grids(a, b, scheme) == grid
                if fresh.any():
                    yield _rows(_EDGE, _column(a[fresh]), b[fresh])
                continue
            blocks = np.array_split(members, -(-len(members) // block))
            for j, left in enumerate(blocks):
                for k in range(j, len(blocks)):
                    unit = xxhash.xxh64_digest(f"{key[bounds[i]]} {j} {k}", SEED)
                    for side in {j, k}:
                        many = len(blocks[side])
                        name = pa.array(np.full(many, np.frombuffer(unit, np.int64)[0])) if scheme.words == 1 else pa.array([unit] * many, pa.binary())
                        yield _rows(_WORK + 2 * grid + (side != j), name, blocks[side])


def _search_units(batches, scheme: Scheme):
    """Edges of the units of work; a unit's rows come as (kind, unit, fingerprint), sorted by unit and kind."""
    held: list[pa.Table] = []

    def solve(rows: pa.Table):
        kind, fp = rows.column(0).to_numpy(), _prints(rows.column(2).combine_chunks(), scheme.words)
        grid, right = (int(kind[0]) - _WORK) // 2, (kind - _WORK) % 2 == 1
        a, b = across(fp[~right], fp[right], scheme.bits) if right.any() else (fp[x] for x in forest(fp, scheme.bits))
        fresh = first_grids(a, b, scheme) == grid
        return pa.RecordBatch.from_arrays([_column(a[fresh]), _column(b[fresh])], names=["src", "dst"])

    for batch in batches:
        while batch.num_rows:
            unit = batch.column(1)[0]
            if held and held[0].column(1)[0] != unit:
                yield solve(pa.concat_tables(held))
                held = []
            import pyarrow.compute as pc

            many = pc.sum(pc.equal(batch.column(1), unit)).as_py()
            held.append(pa.Table.from_batches([batch.slice(0, many)]))
            batch = batch.slice(many)
    if held:
        yield solve(pa.concat_tables(held))


def links(distinct: DataFrame, scheme: Scheme = EXACT, block: int = BLOCK) -> DataFrame:
    """(src, dst) over the fingerprints ``fp`` of ``distinct``, each once: links that have the components of all links found."""

    def expand(batches):
        for batch in batches:
            fp = _prints(batch.column(0), scheme.words)
            for at in range(0, len(fp), 2048):
                some = fp[at : at + 2048]
                yield pa.RecordBatch.from_arrays([pa.array(cells(some, scheme).ravel().view(np.int64)), _column(np.repeat(some, len(scheme.grids), axis=0))], names=["cell", "fp"])

    placed = distinct.select("fp").mapInArrow(expand, f"cell long, fp {scheme.kind}").repartition("cell").sortWithinPartitions("cell", "fp")
    found = materialize(placed.mapInArrow(lambda it: _search(it, scheme, block), f"kind int, a {scheme.kind}, b {scheme.kind}"), "links")
    edges = found.where(F.col("kind") == _EDGE).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    work = found.where(F.col("kind") >= _WORK)
    if not work.isEmpty():
        units = work.repartition("a").sortWithinPartitions("a", "kind", "b")
        edges = edges.unionByName(units.mapInArrow(lambda it: _search_units(it, scheme), f"src {scheme.kind}, dst {scheme.kind}"))
    return edges


def near_groups(docs: DataFrame, scheme: Scheme = EXACT, width: int = 4, text: str = "text", key: str = "doc_id", similarity: float | None = None) -> DataFrame:
    """Per row of ``docs``: the key as doc_id, mark, fp, component (a fingerprint) and component_id, the smallest key links lead to.

    With a ``similarity``, links are those of ``alike_groups``: all pairs of texts whose shingles have it. Fingerprints are then
    neither made nor returned, and ``component`` is a mark; ``scheme`` counts without one only.
    Texts without words have a fingerprint of zeros and link like others. Null texts count as empty; very long ones are
    hashed in strides. Repeated rows and repeated keys give one result each; rows with a null key get a result and lend no
    id; an empty table gives an empty result. Other columns are not read, so their names cannot clash.
    """
    if similarity is not None:
        from tiewright.llm.alike import alike_groups

        return alike_groups(docs, width, similarity, text, key)
    rows = materialize(fingerprints(docs, width, text, key, scheme.words), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct")
    labels = components(links(distinct, scheme)).withColumnRenamed("node", "fp")
    linked = materialize(labels.join(distinct.select("fp", "first_id"), "fp"), "linked")
    ids = linked.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    linked = join_counted(linked.select("fp", "component"), ids, "component")
    labelled = distinct.join(linked, "fp", "left").select("fp", "n", F.coalesce("component", "fp").alias("component"), F.coalesce("component_id", "first_id").alias("component_id"))
    return join_counted(rows, materialize(labelled, "labels"), "fp").select("doc_id", "mark", "fp", "component", "component_id")


def keep_one(docs: DataFrame, scheme: Scheme = WIDE, width: int = 5, text: str = "text", key: str = "doc_id", similarity: float | None = 0.8) -> DataFrame:
    """One row of ``docs`` for each near group, with all its columns: that with the smallest key (nulls last).

    A row goes only if its group has a text whose shingles are ``similarity`` alike, and of two such texts one goes (``alike_groups``).
    Of rows that share the smallest key, that whose text has the smaller hash stays; of rows that share key and text any one.
    Null texts count as empty, and one row of all empty texts stays. An empty table stays empty. Columns of ``docs`` may have any names.
    """
    groups = materialize(near_groups(docs, scheme, width, text, key, similarity), "groups")
    keep = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("mark").alias("mark"))).alias("x"))
    mark, own_id, own_mark = unused(docs, "mark"), unused(docs, "kept_id"), unused(docs, "kept_mark")
    keep = keep.select(F.col("x.id").alias(own_id), F.col("x.mark").alias(own_mark))
    own = docs.withColumn(mark, F.xxhash64(whole_text(text)))
    kept = own.join(keep, F.col(f"`{key}`").eqNullSafe(F.col(own_id)) & (F.col(mark) == F.col(own_mark)), "left_semi")
    repeated = groups.groupBy("doc_id", "mark").count().where("count > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates([key, mark])
    return kept.drop(mark)


def op10_simhash_components(spark, sf_dir: str) -> DataFrame:
    found = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
