"""Queries for the profile and aggregation operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tiewright.operators import profile as P
from tiewright.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


@query("""SELECT 'lang' AS "column", count(nullif(trim(lang), '')) AS n_filled, count(*) AS n_rows, round(count(nullif(trim(lang), ''))::DOUBLE / count(*), 6) AS share FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL SELECT 'quality', count(quality), count(*), round(count(quality)::DOUBLE / count(*), 6) FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL SELECT 'toxic', count(toxic), count(*), round(count(toxic)::DOUBLE / count(*), 6) FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def coverage_profile(spark, d):
    """How many documents have each field, joined with their labels."""
    joined = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return P.coverage(joined, ["lang", "quality", "toxic"]).withColumn("share", r6("share"))


@query("""SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / coalesce(nullif(stddev_pop(c_acctbal) OVER w, 0), 1), 6) AS z FROM customer WINDOW w AS (PARTITION BY c_mktsegment)""")
def zscore(spark, d):
    c = table(spark, d, "customer")
    return P.z_scores(c, {"z": "c_acctbal"}, "c_mktsegment").select("c_custkey", r6("z").alias("z"))


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(avg(CAST(l_discount = 0 AS INT)), 6) AS zero_share FROM lineitem GROUP BY l_returnflag")
def correlation_and_hurdle_share(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r6(F.corr("l_quantity", "l_extendedprice")).alias("r"), r6(F.avg((F.col("l_discount") == 0).cast("int"))).alias("zero_share"))


STATUS = ("F", "O", "P")


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p, round(count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*), 6) AS share_f FROM orders GROUP BY o_orderpriority""")
def crosstab(spark, d):
    found = table(spark, d, "orders").groupBy("o_orderpriority").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(f"n_{s.lower()}") for s in STATUS])
    return found.withColumn("share_f", r6(F.col("n_f") / (F.col("n_f") + F.col("n_o") + F.col("n_p"))))


@query("""WITH u AS (SELECT user_id, max(CAST(event_type = 'purchase' AS INT)) AS a, max(CAST(event_type = 'signup' AS INT)) AS b, max(CAST(event_type = 'error' AS INT)) AS c FROM events GROUP BY user_id)
  SELECT concat_ws('+', CASE WHEN a = 1 THEN 'purchase' END, CASE WHEN b = 1 THEN 'signup' END, CASE WHEN c = 1 THEN 'error' END) AS combination, count(*) AS n_users FROM u GROUP BY 1""")
def flag_combinations(spark, d):
    """Users by the exact set of kinds of events they had (AGG12)."""
    kinds = ("purchase", "signup", "error")
    flags = table(spark, d, "events").groupBy("user_id").agg(*[F.max(F.col("event_type") == k).alias(k) for k in kinds])
    return flags.groupBy(F.concat_ws("+", *[F.when(F.col(k), F.lit(k)) for k in kinds]).alias("combination")).agg(F.count("*").alias("n_users"))


@query("""WITH h AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_partkey < 40), t AS (SELECT l_partkey, count(*) AS total FROM h GROUP BY l_partkey)
  SELECT a.l_partkey AS row_item, b.l_partkey AS col_item, count(*) AS n, round(count(*)::DOUBLE / any_value(total), 6) AS share FROM h a JOIN h b ON a.l_suppkey = b.l_suppkey AND a.l_partkey <> b.l_partkey JOIN t ON t.l_partkey = a.l_partkey GROUP BY 1, 2""")
def conditional_matrix(spark, d):
    held = table(spark, d, "lineitem").where("l_partkey < 40")
    return P.conditional_matrix(held, "l_suppkey", "l_partkey").withColumn("share", r6("share"))


@query("""SELECT CAST(floor(p_retailprice / 10) * 10 AS BIGINT) AS decade, count(*) AS n FROM part GROUP BY 1""")
def bins_decade(spark, d):
    return table(spark, d, "part").groupBy((F.floor(F.col("p_retailprice") / 10) * 10).cast("long").alias("decade")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN p_size < 10 THEN 'under 10' WHEN p_size < 25 THEN '10 to 24' ELSE '25 and over' END AS band, CAST(least(greatest(p_size, 5), 45) // 5 * 5 AS INT) AS clamped, count(*) AS n FROM part GROUP BY 1, 2""")
def bins_clamped(spark, d):
    band = F.when(F.col("p_size") < 10, "under 10").when(F.col("p_size") < 25, "10 to 24").otherwise("25 and over")
    clamped = F.floor(F.least(F.greatest("p_size", F.lit(5)), F.lit(45)) / 5) * 5
    return table(spark, d, "part").groupBy(band.alias("band"), clamped.cast("int").alias("clamped")).agg(F.count("*").alias("n"))


@query("SELECT CAST(floor(l_quantity / 2) * 2 AS INT) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 40 GROUP BY 1")
def histogram_width_two(spark, d):
    lines = table(spark, d, "lineitem").where(F.col("l_quantity").between(0, 40))
    return lines.groupBy((F.floor(F.col("l_quantity") / 2) * 2).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
  SELECT p_brand, CAST(least(3, i // greatest(n // 4, 1)) AS INT) AS quartile, count(*) AS n, round(avg(p_retailprice), 6) AS mean_price FROM x GROUP BY 1, 2""")
def quartile_equal_count(spark, d):
    placed = P.equal_count_quartiles(table(spark, d, "part"), [F.col("p_retailprice"), F.col("p_partkey")], ["p_brand"])
    return placed.groupBy("p_brand", "quartile").agg(F.count("*").alias("n"), r6(F.avg("p_retailprice")).alias("mean_price"))


@query("""WITH v AS (SELECT c_mktsegment, list_sort(list(c_acctbal)) AS v FROM customer GROUP BY 1), x AS (SELECT c.c_mktsegment, CAST(c_acctbal > v[CAST(floor(len(v) * 0.25) AS INT) + 1] AS INT) + CAST(c_acctbal > v[CAST(floor(len(v) * 0.5) AS INT) + 1] AS INT) + CAST(c_acctbal > v[CAST(floor(len(v) * 0.75) AS INT) + 1] AS INT) AS stratum FROM customer c JOIN v ON c.c_mktsegment = v.c_mktsegment)
  SELECT c_mktsegment, stratum, count(*) AS n FROM x GROUP BY 1, 2""")
def quartile_index_cut(spark, d):
    return P.index_cut_quartiles(table(spark, d, "customer"), "c_acctbal", ["c_mktsegment"]).groupBy("c_mktsegment", "stratum").agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS median, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer GROUP BY 1)
  SELECT q.c_mktsegment, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, min(c_acctbal) AS low, max(c_acctbal) AS high, count(*) AS n_inside FROM customer c JOIN q ON c.c_mktsegment = q.c_mktsegment WHERE c_acctbal BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1""")
def box_stats(spark, d):
    return P.box_stats(table(spark, d, "customer"), "c_acctbal", "c_mktsegment").withColumns({c: r6(c) for c in ("q1", "median", "q3")})


@query("SELECT o_orderpriority, list_sort(list(o_totalprice))[count(*) // 2 + 1] AS upper_median FROM orders GROUP BY 1")
def upper_median(spark, d):
    return P.upper_medians(table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"]).drop("n")


@query("SELECT p_brand, p_type, count(*) AS n, round(avg(p_retailprice), 6) AS mean_price FROM part GROUP BY 1, 2 HAVING count(*) >= 3")
def having_min_group(spark, d):
    return table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), r6(F.avg("p_retailprice")).alias("mean_price")).where("n >= 3")


@query("SELECT coalesce(nullif(trim(o_orderstatus), ''), '(not stated)') AS status, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def share_of_total(spark, d):
    found = table(spark, d, "orders").groupBy(F.coalesce(F.nullif(F.trim("o_orderstatus"), F.lit("")), F.lit("(not stated)")).alias("status")).agg(F.count("*").alias("n"))
    return found.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy())))


@query("""WITH k AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
  SELECT user_id, event_type AS top_kind, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM k) WHERE r = 1""")
def argmax_tiebreak(spark, d):
    """Each user's most frequent kind of event; ties to the first name (AGG16)."""
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("top_kind"), F.max("n").alias("n"))


@query("""WITH v AS (SELECT user_id, event_type, sum(CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END) AS total FROM events GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, event_type) AS r FROM v)
  SELECT a.user_id, a.event_type AS winner, CAST(a.total AS BIGINT) AS total, b.event_type AS runner_up, coalesce(a.total = b.total, false) AS tied FROM r a LEFT JOIN r b ON a.user_id = b.user_id AND b.r = 2 WHERE a.r = 1""")
def vote_tally(spark, d):
    weight = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).otherwise(1)
    return P.vote(table(spark, d, "events").select("user_id", "event_type", weight.alias("weight")), "user_id", "event_type", "weight")


@query("""SELECT t.table_name, stated, n, round(n::DOUBLE / stated, 6) AS recovery FROM (VALUES ('region', 5), ('nation', 25), ('supplier', 120)) t(table_name, stated) JOIN (SELECT 'region' AS table_name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier) c ON c.table_name = t.table_name""")
def external_benchmark(spark, d):
    """Counts against what an outside source states (ST20)."""
    stated = {"region": 5, "nation": 25, "supplier": 120}
    counts = [table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), F.lit(s).alias("stated"), "n") for t, s in stated.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).withColumn("recovery", r6(F.col("n") / F.col("stated")))


@query("""WITH g AS (SELECT c_nationkey % 2 AS side, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2), s AS (SELECT side, c_mktsegment, n::DOUBLE / sum(n) OVER (PARTITION BY side) AS share FROM g)
  SELECT coalesce(a.c_mktsegment, b.c_mktsegment) AS segment, round(coalesce(a.share, 0), 6) AS share_even, round(coalesce(b.share, 0), 6) AS share_odd, round(coalesce(a.share, 0) - coalesce(b.share, 0), 6) AS gap FROM (SELECT * FROM s WHERE side = 0) a FULL JOIN (SELECT * FROM s WHERE side = 1) b ON a.c_mktsegment = b.c_mktsegment""")
def group_divergence(spark, d):
    """Shares in two groups and their gap (SRT7)."""
    n = table(spark, d, "customer").groupBy((F.col("c_nationkey") % 2).alias("side"), "c_mktsegment").agg(F.count("*").alias("n"))
    s = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("side")))
    a, b = (s.where(F.col("side") == k).select(F.col("c_mktsegment").alias("segment"), F.col("share").alias(name)) for k, name in ((0, "a"), (1, "b")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return a.join(b, "segment", "full").select("segment", r6(zero("a")).alias("share_even"), r6(zero("b")).alias("share_odd"), r6(zero("a") - zero("b")).alias("gap"))
