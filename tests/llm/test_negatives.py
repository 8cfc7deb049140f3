import math
import random

import numpy as np
import pytest

from tests.oracle import differences
from tiewright.llm import negatives as N

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, block int"


def plain(rows, every=100):
    """The same result from all pairs."""
    usable, dims = set(), 0
    for key, vector, label, *_ in rows:
        if key is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        usable.add((key, label, tuple(math.floor(256 * float(np.float32(x))) for x in vector)))
        dims = max(dims, len(vector))
    usable = {(k, c, v + (0,) * (dims - len(v))) for k, c, v in usable}
    product = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for key, label, vector in usable:
        if key % every:
            continue
        scored = sorted((-product(vector, v), k, c) for k, c, v in usable)
        for minus, positive, _ in [s for s in scored if s[2] == label and s[1] != key][:5]:
            best = -minus
            fit = [(k, -s) for s, k, c in scored if c != label and 80 * best <= 100 * -s <= 100 * best]
            out += [(key, positive, i, k, best, s) for i, (k, s) in enumerate(fit[:5], 1)]
    return sorted(out)


def made(spark, rows, every=100):
    got = N.hard_negatives(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA), every)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def clustered(seed, n, dims=6, groups=7):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(groups)]
    return [(i, [m + rng.gauss(0, 0.1) for m in rng.choice(middles)], rng.randrange(3)) for i in range(n)]


def test_small_table_as_sql(spark):
    assert differences(spark, SF, N.op13_hard_negatives, N.SQL) is None


def test_all_rounds_and_many_lists_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(N, "LIST_ROWS", 20)
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    rows = clustered(1, 600)
    assert made(spark, rows, 10) == plain(rows, 10) != []


def test_a_third_of_the_rows_alike_and_ties(spark, monkeypatch):
    monkeypatch.setattr(N, "LIST_ROWS", 30)
    monkeypatch.setattr(N, "BLOCK_ROWS", 8)
    rows = clustered(2, 200, 4) + [(i, [0.5, 0.5, 0.5, 0.5], i % 2) for i in range(200, 300)]
    assert made(spark, rows, 25) == plain(rows, 25) != []


def test_nulls_infinities_short_vectors_and_repeats(spark):
    rows = clustered(3, 90, 3) + [
        (100, None, 1), (200, [1.0, 2.0, 3.0], None), (None, [1.0, 2.0, 3.0], 1), (300, [1.0, float("nan"), 0.0], 1), (400, [1.0, float("inf"), 0.0], 1), (500, [1.0, None, 0.0], 1),
        (600, [], 1), (700, [1.0], 1), (800, [-3.0, 0.25], 2), (800, [-3.0, 0.25], 2), (900, [1.5, 1.5, 1.5], 0), (901, [1.5, 1.5, 1.5], 1), (-100, [1.0, 1.0, 1.0], 2),
    ]
    assert made(spark, rows) == plain(rows) != []


@pytest.mark.parametrize("rows", [[], [(100, [1.0], 1)], [(100, [1.0], 1), (101, [1.0], 1)]])
def test_too_few_rows_give_nothing(spark, rows):
    assert made(spark, rows) == []


def test_bounds_hold_and_leave_lists_out():
    rng = np.random.default_rng(0)
    middles = rng.normal(0, 900, (12, 8))
    members = [np.floor(m + rng.normal(0, 40, (50, 8))) for m in middles]
    radii = np.array([np.sqrt(((x - m) ** 2).sum(1)).max() for x, m in zip(members, middles)])
    left_out = 0
    for _ in range(50):
        anchor = np.floor(rng.normal(0, 900, 8))
        upper, lower = N.bounds(anchor, middles, radii)
        scores = [x @ anchor for x in members]
        assert all(lower[c] <= s.min() and s.max() <= upper[c] for c, s in enumerate(scores))
        kth = np.sort(np.concatenate(scores))[-5]
        left_out += sum(not N.asked({"least": kth, "top": None}, u, d) for u, d in zip(upper, lower))
    assert left_out > 300


def test_numbers_in_few_bytes_and_exact_products():
    for most in (5, 40_000, 2**40):
        numbers = np.array([[-most, most], [1, 0]])
        assert N.unpacked(N.packed(numbers), 4).tolist() == [-most, most, 1, 0]
    a = np.array([[2**30, 1]])
    assert N.products(a, a).tolist() == [[2**60 + 1]]
