"""Every link of the near-dedup stage against all pairs of texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_pipeline import SF, alike, plain_shingles
from tests.llm.test_simhash import plain_sets
from tiewright.llm import alike as A
from tiewright.llm import simhash as H


def plain_groups(rows, similarity=0.8):
    """Smallest key of each text's group, by all pairs."""
    sets = [plain_shingles(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j]) >= similarity]
    up = plain_sets(len(rows), *zip(*pairs)) if pairs else list(range(len(rows)))
    least = {}
    for (d, _), r in zip(rows, up):
        least[r] = min(least.get(r, d), d)
    return {d: least[r] for (d, _), r in zip(rows, up)}


def groups(spark, rows, similarity=0.8):
    return {r.doc_id: r.component_id for r in A.alike_groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, similarity).collect()}


def edited(rng, words, target):
    """Words changed until a further change would bring the similarity under the target."""
    own, other = plain_shingles(" ".join(words)), list(words)
    for _ in range(2000):
        trial = list(other)
        at = rng.randrange(len(trial))
        trial[at : at + 1] = rng.choice([[], [f"n{rng.randrange(10**6)}"], [trial[at], f"n{rng.randrange(10**6)}"]])
        if alike(own, plain_shingles(" ".join(trial))) < target:
            break
        other = trial
    return other


def test_no_pair_is_lost_just_above_the_threshold(spark):
    rng, rows = random.Random(31), []
    for i in range(400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([8, 9, 14, 30, 60, 120, 300]))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited(rng, words, 0.8)))]
    got = {r.doc_id: r.component_id for r in H.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), H.WIDE, 5, similarity=0.8).collect()}
    assert [i for i in range(400) if got[2 * i + 1] != 2 * i] == []


def test_equal_fingerprints_of_unlike_texts_are_no_link(spark):
    """One shingle repeated over and over decides every bit, whatever else a text holds."""
    rows = [(i, "x " * 3000 + " ".join(f"{i}w{k}" for k in range(300))) for i in range(3)]
    assert len({tuple(H.simhashes(t, 5, 8).tolist()) for _, t in rows}) == 1
    assert groups(spark, rows) == {0: 0, 1: 1, 2: 2}
    assert H.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() == 3


def test_sketches_differ_by_no_more_than_the_sets():
    rng = np.random.default_rng(9)
    for _ in range(500):
        a, b = (np.unique(rng.integers(0, 2**64, int(rng.choice([0, 1, 16, 17, 90, 700])), dtype=np.uint64)) for _ in range(2))
        b = np.union1d(b[: len(b) // 4], a[: int(rng.integers(0, len(a) + 1))])
        one, two = A.sketch(a), A.sketch(b)
        words = min(len(one), len(two))
        assert 64 * len(one) >= 4 * len(a)
        for w in (words, 1):
            assert np.bitwise_count(A.folded(one, w) ^ A.folded(two, w)).sum() <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("block", [A.BLOCK, 3])
def test_chains_and_templates_against_all_pairs(spark, monkeypatch, block):
    """Chains of edits of one text, and texts around a shared passage, so that parts hold several groups."""
    monkeypatch.setattr(A, "BLOCK", block)
    rng, rows = random.Random(5), []
    shared = [f"s{k}" for k in range(70)]
    for i in range(25):
        words = shared + [f"{i}t{k}" for k in range(rng.randrange(5, 60))]
        for _ in range(rng.randrange(1, 8)):
            rows.append((1000 - len(rows), " ".join(words)))
            words = edited(rng, words, rng.choice([0.75, 0.8, 0.85, 0.9]))
    want = plain_groups(rows)
    assert groups(spark, rows) == want and 10 < len(set(want.values())) < len(rows)


def test_whole_table_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert groups(spark, rows) == plain_groups(rows)


@pytest.mark.parametrize("similarity", [0.5, 0.75, 0.8, 0.9, 1.0])
def test_a_shared_part_for_every_alike_pair(similarity):
    rng, held = np.random.default_rng(3), 0
    for _ in range(1500):
        a = np.unique(rng.integers(0, 2**64, int(rng.choice([0, 1, 3, 4, 5, 8, 9, 10, 27, 28, 64, 300])), dtype=np.uint64))
        gone = a[rng.random(len(a)) >= rng.uniform(0, 1 - similarity + 0.05)]
        b = np.union1d(gone, rng.integers(0, 2**64, int(rng.integers(0, len(a) // 5 + 2)), dtype=np.uint64))
        if H.likeness(a, b) >= similarity:
            held += 1
            assert len(np.intersect1d(A.part_keys(a, similarity), A.part_keys(b, similarity)))
    assert held > 100


def test_nulls_repeats_short_texts_and_clashing_columns(spark):
    rows = [(5, "a b c d e f", "x"), (3, "A  B C D E F", "x"), (9, None, "y"), (2, "", "y"), (9, None, "y"), (8, " \t", "y"), (None, "q r s t", None), (7, "q r s t", None), (6, "q", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string").withColumn("mark", F.lit("c"))
    got = sorted((r.doc_id is None, r.doc_id, r.component_id) for r in A.alike_groups(docs, 5, 0.8).collect())
    assert [(d, c) for _, d, c in got] == [(2, 2), (3, 3), (5, 3), (6, 6), (7, 7), (8, 2), (9, 2), (9, 2), (None, 7)]
    assert A.alike_groups(docs.limit(0), 5, 0.8).count() == 0
    with pytest.raises(ValueError):
        A.part_keys(np.zeros(0, np.uint64), 0)


def test_a_large_group_meets_its_first_text_only(spark):
    """Six hundred near copies of one text: as many comparisons as texts, not as pairs."""
    rng = random.Random(13)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(600):
        own = list(words)
        own[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(own)))
    assert set(groups(spark, rows).values()) == {0}
    texts = spark.createDataFrame(rows, "node long, body string")
    found = A.parts(texts, 5, 0.8).repartition("part").sortWithinPartitions("part", "node").mapInArrow(A._shared, "kind int, a long, b long").where("kind = 0").select("a", "b").distinct()
    assert found.count() < 12 * 600


def test_unlike_groups_of_a_part_do_not_become_pairs(spark):
    """Three hundred texts that share seven tenths of their words: all are in the same parts, and no pair of them is a row."""
    shared = [f"s{k}" for k in range(140)]
    rows = [(i, " ".join(shared + [f"{i}t{k}" for k in range(60)])) for i in range(300)]
    found = spark.createDataFrame([(p, i) for p in range(5) for i, _ in rows], "part long, node long")
    data = [(i, len(x), x.tobytes(), A.sketch(x).tobytes()) for i, x in ((i, H.shingle_set(t, 5)) for i, t in rows)]
    sets = spark.createDataFrame([(i, n, bytearray(x), bytearray(y)) for i, n, x, y in data], "node long, size long, shingles binary, sketch binary")
    links = spark.createDataFrame([(0, 1), (2, 3)], "src long, dst long")
    assert A.across_groups(found, links, sets, 0.8).count() == 0
    assert A.across_groups(found, links, sets, 0.4).count() == 300 * 299 / 2 - 2
    assert set(groups(spark, rows).items()) == {(i, i) for i in range(300)}


def test_parts_are_whole_however_rows_are_batched():
    """Batches that begin with one part only, as in a task of few rows or of one large part."""
    part, node = [1, 1, 1, 2, 3, 3, 3, 3, 9], [4, 5, 6, 4, 4, 5, 5, 7, 6]
    want = [(0, 4, 5), (0, 4, 6), (0, 4, 7), (1, 1, 4), (1, 1, 5), (1, 1, 6), (1, 3, 4), (1, 3, 5), (1, 3, 7)]
    for size in (1, 2, 3, 4, 9):
        batches = [pa.RecordBatch.from_arrays([pa.array(part[i : i + size], pa.int64()), pa.array(node[i : i + size], pa.int64())], names=["part", "node"]) for i in range(0, 9, size)]
        assert sorted({tuple(r.values()) for b in A._shared(batches) for r in b.to_pylist()}) == want


@pytest.mark.parametrize("rows", [[(1, "a b c d e f g")], [(1, None)], [(3, "a b c"), (2, "a b c"), (2, "a b c")]])
def test_tables_of_one_text(spark, rows):
    kept = H.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [(r.doc_id, r.text) for r in kept.collect()] == [min(rows)]
