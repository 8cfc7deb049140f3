"""Queries for the order-dependent operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tiewright.operators import sequence as S
from tiewright.operators.ranking import global_rank
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


def lines(spark, d):
    """(doc_id, i, line): the lines of documents, numbered from 0."""
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return docs


LINES = "l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents)"
#: A key of a line: its first letters A to Z, in upper case.
KEY_SQL = "upper(substr(regexp_replace(line, '[^A-Za-z]', '', 'g'), 1, 8))"


def keyed(spark, d):
    key = F.upper(F.substring(F.regexp_replace("line", "[^A-Za-z]", ""), 1, 8))
    return lines(spark, d).withColumn("key", key).where("key <> ''")


@query("""SELECT event_id, round(value - coalesce(median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING EXCLUDE CURRENT ROW), value), 6) AS indent FROM events""")
def moving_median_excl_self(spark, d):
    e = table(spark, d, "events")
    around = S.moving_median("value", ["user_id"], ["ts", "event_id"])
    return e.select("event_id", F.round(F.col("value") - F.coalesce(around, F.col("value")), 6).alias("indent"))


@query(f"""WITH {LINES}, f AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR (regexp_matches(lag(line) OVER w, '[.!]$') AND regexp_matches(line, '^[A-Z]')) THEN 1 ELSE 0 END AS s FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  g AS (SELECT doc_id, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM f), z AS (SELECT doc_id, grp, count(*) AS n FROM g GROUP BY 1, 2)
  SELECT doc_id, count(*) AS n_groups, max(n) AS longest FROM z GROUP BY doc_id""")
def gaps_islands(spark, d):
    """Lines grouped into paragraphs: a new one after a sentence's end before a capital (WIN2)."""
    before = F.lag("line").over(S.frame(["doc_id"], ["i"]))
    rows = lines(spark, d).withColumn("starts", before.rlike(r"[.!]\z") & F.col("line").rlike("^[A-Z]"))
    groups = rows.select("doc_id", S.islands(F.col("starts"), ["doc_id"], ["i"]).alias("grp")).groupBy("doc_id", "grp").agg(F.count("*").alias("n"))
    return groups.groupBy("doc_id").agg(F.count("*").alias("n_groups"), F.max("n").alias("longest"))


@query("""WITH b AS (SELECT user_id, event_type, event_id, sum(CAST(event_type = 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS part FROM events)
  SELECT user_id, CAST(part AS BIGINT) AS part, count(*) AS n FROM b WHERE event_type <> 'error' GROUP BY 1, 2""")
def boundary_partition(spark, d):
    """Events between errors; the boundary itself belongs to no part (WIN3)."""
    w = S.frame(["user_id"], ["ts", "event_id"]).rowsBetween(Window.unboundedPreceding, 0)
    parts = table(spark, d, "events").withColumn("part", F.sum((F.col("event_type") == "error").cast("int")).over(w))
    return parts.where("event_type <> 'error'").groupBy("user_id", "part").agg(F.count("*").alias("n"))


@query("""SELECT event_id, coalesce(min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)::VARCHAR, '-') AS next_purchase FROM events""")
def next_anchor(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", S.next_value(F.col("event_id").cast("string"), F.col("event_type") == "purchase", ["user_id"], ["event_id"], "-").alias("next_purchase"))


@query(f"""WITH {LINES}, k AS (SELECT doc_id, i, {KEY_SQL} AS key, length(line) >= 120 AS anchor, length(line) >= 20 AS plausible FROM l WHERE {KEY_SQL} <> ''),
  a AS (SELECT *, coalesce(first_value(CASE WHEN anchor THEN substr(key, 1, 4) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '￿') AS ahead FROM k),
  f AS (SELECT *, anchor OR (plausible AND substr(key, 1, 4) <= ahead) AS fits FROM a),
  m AS (SELECT *, max(CASE WHEN fits THEN substr(key, 1, 6) END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM f),
  r AS (SELECT CASE WHEN anchor THEN 'anchor' WHEN NOT plausible THEN 'implausible' WHEN fits AND coalesce(last, '') <= substr(key, 1, 6) THEN 'window' ELSE 'outside' END AS reason FROM m)
  SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def window_scan(spark, d):
    """Lines accepted in alphabetical windows between long ones (WIN5)."""
    rows = keyed(spark, d).withColumn("anchor", F.length("line") >= 120).withColumn("plausible", F.length("line") >= 20)
    return S.alphabetical_window(rows, "key", "anchor", "plausible", ["doc_id"], ["i"]).groupBy("reason").agg(F.count("*").alias("n"))


#: For each length, the least key that ends a run of that length, replaced step by step: the fold is the patience method.
LNDS = """list_reduce(list_prepend([]::VARCHAR[], list_transform(keys, lambda k: [k])), lambda a, k: CASE WHEN len(list_filter(a, lambda x: x <= k[1])) = len(a) THEN list_append(a, k[1])
  ELSE list_concat(list_append(a[1:len(list_filter(a, lambda x: x <= k[1]))], k[1]), a[len(list_filter(a, lambda x: x <= k[1])) + 2:]) END)"""


@query(f"""WITH {LINES}, k AS (SELECT doc_id, list({KEY_SQL} ORDER BY i) AS keys FROM l WHERE {KEY_SQL} <> '' GROUP BY doc_id) SELECT doc_id, CAST(len({LNDS}) AS INT) AS longest FROM k""")
def lnds_length(spark, d):
    """Length of a longest non-decreasing run of each document's line keys (WIN6)."""
    keys = keyed(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "key"))).alias("x"))
    return keys.select("doc_id", F.size(S.longest_nondecreasing(F.transform("x", lambda x: x["key"]))).alias("longest"))


@query("""WITH s AS (SELECT s_nationkey, s_acctbal AS hi, lag(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS lo FROM supplier), g AS (SELECT *, hi - lo AS gap FROM s WHERE lo IS NOT NULL)
  SELECT s_nationkey, round(gap, 6) AS gap, round((hi + lo) / 2, 6) AS middle FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY gap DESC, lo) AS r FROM g) WHERE r = 1 AND gap >= 150""")
def largest_gap(spark, d):
    return S.largest_gap(table(spark, d, "supplier"), "s_acctbal", "s_nationkey", 150).select("s_nationkey", F.round("gap", 6).alias("gap"), F.round("middle", 6).alias("middle"))


@query("""WITH t AS (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events) SELECT source, target, count(*) AS n FROM t WHERE source <> target GROUP BY 1, 2""")
def transitions(spark, d):
    return S.transitions(table(spark, d, "events"), "event_type", ["user_id"], ["ts", "event_id"])


@query("""WITH u AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS f, arg_max(event_type, (ts, event_id)) AS l, count(DISTINCT event_type) AS n FROM events GROUP BY user_id)
  SELECT CASE WHEN n = 1 THEN 'never left' WHEN f = l THEN 'returned' ELSE 'ended elsewhere' END AS mobility, count(*) AS n_users FROM u GROUP BY 1""")
def mobility_classes(spark, d):
    return S.mobility(table(spark, d, "events"), "event_type", "user_id", ["ts", "event_id"]).groupBy("mobility").agg(F.count("*").alias("n_users"))


@query("WITH c AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) SELECT s_nationkey, n, row_number() OVER (ORDER BY n DESC, s_nationkey) AS rank FROM c")
def rank_size(spark, d):
    n = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "s_nationkey")).cast("long"))


@query("WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1) SELECT p_size, CAST(sum(n) OVER (ORDER BY p_size) AS BIGINT) AS running, round(sum(n) OVER (ORDER BY p_size DESC)::DOUBLE / sum(n) OVER (), 6) AS surviving FROM c")
def cumulative_share(spark, d):
    n = table(spark, d, "part").groupBy("p_size").agg(F.count("*").alias("n"))
    return n.select("p_size", F.sum("n").over(Window.orderBy("p_size")).alias("running"), F.round(F.sum("n").over(Window.orderBy(F.desc("p_size"))) / F.sum("n").over(Window.partitionBy()), 6).alias("surviving"))


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 7")
def top_k_total_order(spark, d):
    return S.ranked(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey", 7)


@query(f"WITH {LINES}, c AS (SELECT doc_id, min(i) AS cut FROM l WHERE line LIKE '%the%' GROUP BY doc_id) SELECT l.doc_id, count(*) AS n FROM l LEFT JOIN c ON l.doc_id = c.doc_id WHERE cut IS NULL OR i < cut GROUP BY 1")
def truncate_at_first_match(spark, d):
    return S.before_first(lines(spark, d), F.col("line").contains("the"), ["doc_id"], "i").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"WITH {LINES}, h AS (SELECT doc_id, i, line, lag(substr(line, 1, 1)) OVER (PARTITION BY doc_id ORDER BY i) IS DISTINCT FROM substr(line, 1, 1) AS changed FROM l) SELECT doc_id, count(*) FILTER (changed) AS n_headers FROM h GROUP BY doc_id")
def change_headers(spark, d):
    """How often the first letter changes from line to line (WIN16)."""
    first = F.substring("line", 1, 1)
    before = F.lag(first).over(S.frame(["doc_id"], ["i"]))
    return lines(spark, d).select("doc_id", (~before.eqNullSafe(first)).alias("changed")).groupBy("doc_id").agg(F.count_if("changed").alias("n_headers"))


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) WHERE r % 97 = 0")
def systematic_sample(spark, d):
    """Every 97th order by key (FIL9)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return global_rank(o, ["o_orderkey"], "r").where("r % 97 = 0").drop("r")
