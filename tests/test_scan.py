"""Scans over ranges against plain loops, with segments that begin and end anywhere."""

import random

import pytest
from pyspark.sql import functions as F

from tiewright.operators import scan as P
from tiewright.operators import sequence as S


@pytest.fixture(autouse=True)
def small_ranges_stay_apart(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain(rows, kind, inclusive, segment):
    out = []
    for i, (_, s, v) in enumerate(rows):
        span = range(i if inclusive else i + 1, len(rows)) if kind == "next" else range(0, i + (1 if inclusive else 0))
        values = [rows[j][2] for j in span if rows[j][2] is not None and (not segment or rows[j][1] == s)]
        out.append(sum(values) if kind == "sum" else None if not values else max(values) if kind == "max" else values[-1] if kind == "last" else values[0])
    return out


def sequence(seed, n):
    rng = random.Random(seed)
    rows, segment = [], 0
    for i in range(n):
        segment += rng.random() < (0.5 if n // 3 < i < n // 2 else 0.01)
        rows.append((i, segment if segment % 7 else None if segment == 7 else segment, rng.choice([None, rng.randrange(-9, 9)])))
    return rows


@pytest.mark.parametrize("seed, n", [(1, 300), (2, 37), (3, 1), (4, 0)])
@pytest.mark.parametrize("segment", [False, True])
def test_scans_against_loops(spark, seed, n, segment):
    rows = sequence(seed, n)
    frame = spark.createDataFrame(rows, "i int, s int, v int").repartition(5)
    kinds = [(kind, inclusive) for kind in ("sum", "max", "last", "next") for inclusive in (False, True)]
    scans = {f"{k}{int(inc)}": P.Scan(k, F.col("v"), inc, ("s",) if segment else ()) for k, inc in kinds}
    got = {r.i: r for r in P.unranged(P.scanned(P.in_ranges(frame, ["i"]), **scans)).collect()}
    assert len(got) == n
    for kind, inclusive in kinds:
        assert [got[i][f"{kind}{int(inclusive)}"] for i in range(n)] == plain(rows, kind, inclusive, segment), (kind, inclusive)


def test_no_task_holds_the_sequence(spark):
    ranged = P.in_ranges(spark.range(8000).withColumn("v", F.lit(1)), ["id"])
    sizes = [r.n for r in ranged.groupBy(P.PART).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 4 and max(sizes) < 3000
    assert ranged.groupBy(P.PART).agg(F.count_distinct(P.PLACE).alias('n')).agg(F.sum('n')).first()[0] == 8000
    out = P.scanned(ranged, total=P.Scan("sum", F.col("v"), True))
    assert out.where("total <> id + 1").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") == 1  # the ranges' sums only


def test_window_as_over_one_partition(spark):
    rng = random.Random(6)
    rows = [(i, i // 150, "".join(rng.choice("ABCD") for _ in range(5)), rng.random() < 0.1, rng.random() < 0.8) for i in range(400)]
    frame = spark.createDataFrame(rows, "i int, s int, key string, anchor boolean, plausible boolean")
    for by in ((), ("s",)):
        want = S.alphabetical_window(frame, "key", "anchor", "plausible", list(by), ["i"]).select("i", "reason", "accepted")
        got = P.window_over_ranges(P.in_ranges(frame, ["i"]), "key", "anchor", "plausible", by).select("i", "reason", "accepted")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
