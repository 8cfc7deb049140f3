import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tiewright.llm import simhash as S


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), seed=42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, bits=4):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                up[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        r = root(i)
        least[r] = min(least.get(r, d), d)
    return [least[root(i)] for i in range(len(fps))]


def chained(rng, n):
    out = []
    for _ in range(n):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 60])):
            out.append(base)
            for _ in range(rng.randrange(6)):
                base ^= 1 << rng.randrange(64)
    return out


@pytest.mark.parametrize("text", ["", " \t\n", "One", "one two", "a b c d", "A b C d e F g", "x " * 500, "é É ß\x0b\x1c y z w"])
def test_fingerprint_is_the_plain_one(text):
    assert S.simhash(text) == plain_fingerprint(text)


def test_fingerprint_of_random_texts_in_strides(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(S, "STRIDE", 7)
    for _ in range(50):
        text = " ".join(rng.choice("the a of Über x1 YES".split()) for _ in range(rng.randrange(60)))
        assert S.simhash(text) == plain_fingerprint(text)


def test_a_shared_cell_for_every_close_pair():
    rng = random.Random(5)
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for _ in range(4):
            b ^= 1 << rng.randrange(64)
        x, y = np.array([[a]], np.uint64), np.array([[b]], np.uint64)
        assert (S.cells(x, S.EXACT) == S.cells(y, S.EXACT)).any()
        assert S.within(x, y, 4)[0]


def test_lower_bound_never_exceeds_hamming():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**64, (2, 5000, 1), dtype=np.uint64)
    near = a ^ (np.uint64(1) << rng.integers(0, 64, (5000, 1), dtype=np.uint64))
    for y in (b, near):
        assert (S.within(a, y, 4) == (np.bitwise_count(a ^ y) <= 4)[:, 0]).all()


def test_pairs_that_suffice():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(2, 40))
        a, b = rng.integers(0, n, (2, int(rng.integers(1, 80))))
        label, chosen = S.joined(np.arange(n), a, b)
        want = plain_sets(n, a, b)
        assert label.tolist() == want and plain_sets(n, a[chosen], b[chosen]) == want
        assert len(chosen) == n - len(set(want))


def plain_sets(n, a, b):
    up = list(range(n))
    for _ in range(n):
        for x, y in zip(a, b):
            up[x] = up[y] = min(up[x], up[y])
    return up


def table_of(spark, fps):
    return spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in set(fps)], "fp long")


@pytest.mark.parametrize("block", [S.BLOCK, 80])
def test_components_against_brute_force(spark, block):
    rng = random.Random(7)
    fps = chained(rng, 60)
    edges = S.links(table_of(spark, fps), S.EXACT, block)
    from tiewright.operators.components import components

    got = {r.node: r.component for r in components(edges).collect()}
    signed = [int(np.uint64(f).view(np.int64)) for f in sorted(set(fps))]
    want = plain_components(signed, sorted(set(fps)))
    for node, component in zip(signed, want):
        assert got.get(node, node) == component


@pytest.mark.parametrize("size", [16, 32, 33, 64, 65, 200, 5000])
def test_a_near_group_leaves_as_few_edges(spark, size):
    """Far fewer rows than the group has pairs or the grids have cells; and every one is a link."""
    rng = random.Random(size)
    base, fps = rng.getrandbits(64), set()
    while len(fps) < size:
        fps.add(base ^ sum(1 << b for b in rng.sample(range(64), 2 if size < 300 else 3)))
    edges = [(np.uint64(np.int64(r.src)), np.uint64(np.int64(r.dst))) for r in S.links(table_of(spark, fps)).collect()]
    assert size - 1 <= len(edges) < 12 * size
    assert all(int(a ^ b).bit_count() <= 4 for a, b in edges)


def test_wide_links_find_similar_texts(spark):
    """Pairs planted at similarities of 0.8 to 0.95: at least nine tenths are linked; those under 0.6 are not."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, planted = [], []
    for i in range(400):
        words = [word() for _ in range(rng.randrange(100, 600))]
        other = list(words)
        target = rng.choice([0.4, 0.55, 0.82, 0.85, 0.9, 0.95])
        a = shingles(words)
        while True:
            trial = list(other)
            trial[rng.randrange(len(trial))] = word()
            b = shingles(trial)
            if len(a & b) / len(a | b) < target:
                break
            other = trial
        b = shingles(other)
        planted.append((len(a & b) / len(a | b), 2 * i, 2 * i + 1))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in S.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), S.WIDE, 5).collect()}
    near = [got[b] == a for s, a, b in planted if s >= 0.8]
    assert len(near) > 200 and sum(near) / len(near) >= 0.95
    assert not any(got[b] == a for s, a, b in planted if s < 0.6)
    assert all(got[2 * i] == 2 * i for i in range(400))


def shingles(words, k=5):
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


@pytest.mark.parametrize("block", [S.BLOCK, 80])
def test_a_hot_wide_group_is_one_component(spark, block):
    """A thousand near copies of a text, exact copies among them, in cells that are dealt out as blocks."""
    rng = random.Random(13)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(1000):
        own = list(words)
        own[rng.randrange(300)] = f"x{i % 400}"
        rows.append((i, " ".join(own)))
    fps = S.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), 5, words=8).select("fp").distinct()
    edges = S.links(fps, S.WIDE, block)
    from tiewright.operators.components import components

    found = components(edges)
    assert found.select("component").distinct().count() == 1 and found.count() == fps.count()
    assert edges.count() < (12 if block == S.BLOCK else 20) * found.count()


def test_documents_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(5, "a b c d e f", "x"), (3, "A B C D E F", "x"), (9, None, "y"), (2, "", "y"), (9, None, "y"), (None, "q r s t", None), (7, "q r s t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("component_id", F.lit("c"))
    got = sorted((r.doc_id is None, r.doc_id, r.component_id) for r in S.near_groups(docs).collect())
    assert [(d, c) for _, d, c in got] == [(2, 2), (3, 3), (5, 3), (7, 7), (9, 2), (9, 2), (None, 7)]
    assert S.near_groups(docs.limit(0)).count() == 0


def test_query_on_whole_table(spark):
    from collections import Counter

    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    fps = [plain_fingerprint(t) for _, t in docs]
    want = Counter((d, f"{f:016x}", c) for (d, _), f, c in zip(docs, fps, plain_components([d for d, _ in docs], fps)))
    got = S.op10_simhash_components(spark, "/root/testdata/sf0.001")
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()) == want
