"""The permutation kernel: real permutations, statistics as from shuffled tables, means as the closed form says."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from tiewright.operators import graph as G
from tiewright.operators import inference as I


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 2049, 5000])
def test_every_draw_is_a_permutation(n):
    out = I.shuffled_places(np.arange(n), n, np.arange(40), 3)
    assert (np.sort(out, axis=0) == np.arange(n)[:, None]).all()
    part = I.shuffled_places(np.arange(n)[::2], n, np.arange(5, 9), 3)
    assert (part == out[::2, 5:9]).all()


def test_places_are_even():
    out = I.shuffled_places(np.arange(6), 6, np.arange(30_000), 1)
    first = Counter(out[0].tolist())
    assert all(abs(c - 5000) < 350 for c in first.values())
    pairs = Counter(zip(out[0].tolist(), out[1].tolist()))
    assert len(pairs) == 30 and all(abs(c - 1000) < 180 for c in pairs.values())


def test_places_of_a_keyed_bijection_are_even():
    n = 4000
    out = I.shuffled_places(np.arange(n), n, np.arange(400), 1).astype(np.int64)
    cells = Counter((out[0::2] * 20 // n * 20 + out[1::2] * 20 // n).ravel().tolist())
    want = out.size / 2 / 400
    chi = sum((c - want) ** 2 / want for c in cells.values())
    assert len(cells) == 400 and 280 < chi < 530  # 399 degrees of freedom
    ahead = (out[:-1] < out[1:]).mean()
    assert abs(ahead - 0.5) < 0.002


def graph(spark, seed=1, n=80, m=240):
    rng = random.Random(seed)
    label = {i: "abc"[i * 3 // n] for i in range(n)}
    pairs = set()
    while len(pairs) < m:
        a, b = rng.randrange(n), rng.randrange(n)
        if a < b and (label[a] == label[b] or rng.random() < 0.5):
            pairs.add((a, b))
    edges = G.canonical_edges(spark.createDataFrame(sorted(pairs), "src int, dst int"))
    labels = spark.createDataFrame([(i, x) for i, x in label.items() if i % 11], "node int, label string")
    strata = spark.createDataFrame([(i, int(label[i] == "a" and i % 7 > 0)) for i in range(n)], "node int, stratum int")
    return edges, labels, strata


def test_means_as_the_closed_form_and_strata_matter(spark):
    edges, labels, strata = graph(spark)
    free, held = (I.label_permutation(edges, labels, 1500, strata=s).first() for s in (None, strata))
    wanted = [I.expected_same(edges, labels, s).first() for s in (None, strata)]
    for got, want in zip((free, held), wanted):
        assert got.draws == 1500 and abs(got.same - want.same) < 1e-12
        assert abs(got.same_mean - want.expected) < 0.004
    assert free.observed == held.observed and wanted[1].expected - wanted[0].expected > 0.02
    assert free["mean"] < held["mean"] and free.sd > 0 and free.p < 0.01


def test_draws_against_labels_dealt_by_hand(spark):
    edges, labels, _ = graph(spark, 2, 30, 60)
    placed, pairs = I.placed_ends(edges, labels, None, 18)
    deck = I.Deck(placed, 17)
    nodes = {r.node: (r.place, r.degree) for r in placed.collect()}
    got = {r.draw: r.n for r in I._summed(pairs, 3, 1, I._add_pairs(deck)).collect()}
    known = sorted(r.label for r in placed.collect())
    for draw in range(3):
        to = I.shuffled_places(np.arange(len(nodes)), len(nodes), np.array([draw]), 17)[:, 0]
        dealt = {node: known[to[place - 1]] for node, (place, _) in nodes.items()}
        assert Counter(dealt.values()) == Counter(known)
        same = sum(dealt[r.src] == dealt[r.dst] for r in edges.collect() if r.src in dealt and r.dst in dealt)
        assert got[draw] == same


def test_batches_of_draws_add_up(spark, monkeypatch):
    edges, labels, strata = graph(spark)
    whole = I.label_permutation(edges, labels, 90, strata=strata).first()
    monkeypatch.setattr(I, "DRAWS", 7)
    parts = I.label_permutation(edges, labels, 90, strata=strata).first()
    assert all(abs(x - y) < 1e-12 for x, y in zip(whole, parts))


def test_mixed_pairs_with_heavy_bodies(spark, monkeypatch):
    rng = random.Random(4)
    ties = {(rng.randrange(60), body) for body in range(12) for _ in range(4)} | {(i, 99) for i in range(40)}
    frame = spark.createDataFrame(sorted(ties), "person int, body int")
    labels = spark.createDataFrame([(i, "xy"[i % 2]) for i in range(60)], "node int, label string")
    whole = I.body_mixing_permutation(frame, labels, 200).first()
    monkeypatch.setattr(I, "HEAVY", 9)
    parts = I.body_mixing_permutation(frame, labels, 200).first()
    assert all(abs(x - y) < 1e-12 for x, y in zip(whole, parts))
    members = {}
    for person, body in ties:
        members.setdefault(body, []).append(person % 2)
    mixed = sum(sum(m) * (len(m) - sum(m)) for m in members.values())
    pairs = sum(len(m) * (len(m) - 1) / 2 for m in members.values())
    assert abs(whole.observed - mixed / pairs) < 1e-12 and abs(whole["mean"] - 0.5) < 0.03


def test_too_many_strata_stop_the_query(spark, monkeypatch):
    edges, labels, strata = graph(spark, 3, 30, 60)
    monkeypatch.setattr(I, "MAX_COUNTS", 2)
    with pytest.raises(ValueError, match="more than 2"):
        I.label_permutation(edges, labels, 5, strata=strata)


def test_regression_with_large_means(spark):
    rng = random.Random(5)
    rows = [(x := rng.gauss(0, 1), z := rng.gauss(0, 1), 3 * x - 2 * z + rng.gauss(0, 0.5)) for _ in range(400)]
    frame = spark.createDataFrame(rows, "x double, z double, y double")
    near = I.least_squares(frame, "y", ["x", "z"])
    far = I.least_squares(frame.selectExpr("x + 1e9 AS x", "z", "y"), "y", ["x", "z"])
    for (_, b, s, _), (_, bb, ss, _) in list(zip(near, far))[1:]:
        assert abs(b - bb) < 1e-5 and abs(s - ss) < 1e-5
    assert all(math.isnan(t[1]) for t in I.least_squares(frame.selectExpr("x", "2 * x AS z", "y"), "y", ["x", "z"]))
    assert all(math.isnan(t[1]) for t in I.least_squares(frame.selectExpr("x", "1 AS z", "y"), "y", ["x", "z"]))


def test_no_edges_leave_one_row_of_nulls(spark):
    edges = spark.createDataFrame([], "src long, dst long")
    labels = spark.createDataFrame([(1, "a"), (2, "b")], "node long, label string")
    rows = I.label_permutation(edges, labels, draws=3).collect()
    assert [tuple(r) for r in rows] == [(None, None, None, None, 0, None, None)]


def test_sets_of_values_are_even():
    """Of 20 values (a block and a part of one) each pair is drawn as often as any other, and a count of all gives their sum."""
    values = 2.0 ** np.arange(20)
    out = I.subset_sums(values, np.full(38_000, 2), np.random.default_rng(3))
    pairs = Counter(out.tolist())
    assert len(pairs) == 190 and 110 < sum((c - 200) ** 2 / 200 for c in pairs.values()) < 285  # 189 degrees of freedom
    assert I.subset_sums(values, np.array([0, 20]), np.random.default_rng(3)).tolist() == [0.0, 2.0**20 - 1]


def test_mean_difference_over_many_classes_has_the_spread_of_all_deals(spark):
    rng = np.random.default_rng(5)
    rows = [(float(v), "ab"[i % 2]) for i, v in enumerate(rng.exponential(size=5000))]
    a, b = (np.array([v for v, g in rows if g == x]) for x in "ab")
    every = np.r_[a, b]
    z = abs(a.mean() - b.mean()) / math.sqrt(every.var(ddof=1) * (1 / len(a) + 1 / len(b)))
    got = I.mean_difference_permutation(spark.createDataFrame(rows, "v double, g string"), "v", "g", draws=6000).first()
    assert got.observed == pytest.approx(a.mean() - b.mean()) and abs(got.p - math.erfc(z / math.sqrt(2))) < 0.03 and got.draws == 6000


def test_draws_take_little_more_room_than_their_places():
    tracemalloc.start()
    out = I.shuffled_places(np.arange(4000), 5000, np.arange(500), 42)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * out.nbytes
