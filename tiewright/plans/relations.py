"""Queries for the joins that resolve, canonicalise and merge, and for set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiewright.operators import graph as G
from tiewright.operators import resolve as R
from tiewright.plans.network import edges_sql, ties, ties_sql
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


NODES = """n AS (SELECT c_nationkey AS nation, c_name AS name, 1 AS src, c_custkey AS k FROM customer UNION ALL SELECT s_nationkey, s_name, 2, s_suppkey FROM supplier)"""


def nodes(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), F.lit(1).alias("src"), F.col("c_custkey").alias("k"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.lit(2).alias("src"), F.col("s_suppkey").alias("k"))
    return c.unionByName(s)


@query(f"WITH {NODES} SELECT nation, name, src FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY src, k) AS r FROM n) WHERE r = 1")
def union_first_wins(spark, d):
    return R.first_wins(nodes(spark, d), ["nation"], ["src", "k"]).select("nation", "name", "src")


@query(f"WITH {NODES} SELECT nation, name, src FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY src DESC, k DESC) AS r FROM n) WHERE r = 1")
def last_wins_lookup(spark, d):
    return R.last_wins(nodes(spark, d), ["nation"], ["src", "k"]).select("nation", "name", "src")


@query("""WITH u AS (SELECT user_id, max(CAST(event_type = 'purchase' AS INT)) AS a, max(CAST(event_type = 'signup' AS INT)) AS b FROM events GROUP BY 1)
  SELECT CASE WHEN a = 1 AND b = 1 THEN 'purchase+signup' WHEN a = 1 THEN 'purchase' WHEN b = 1 THEN 'signup' ELSE 'none' END AS combination, count(*) AS n FROM u GROUP BY 1""")
def set_partition(spark, d):
    kind = F.col("event_type")
    return R.partition_sets(table(spark, d, "events"), "user_id", {"purchase": kind == "purchase", "signup": kind == "signup"})


@query("""WITH t AS (SELECT concat('C', c_custkey) AS node, 'customer' AS kind, c_name AS label, 1 AS o FROM customer UNION ALL SELECT concat('S', s_suppkey), 'supplier', s_name, 2 FROM supplier UNION ALL SELECT concat('P', p_partkey), 'part', p_name, 3 FROM part
  UNION ALL SELECT DISTINCT concat('C', o_custkey), 'buyer', NULL, 4 FROM orders)
  SELECT node, kind, label FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY o) AS r FROM t) WHERE r = 1""")
def node_table(spark, d):
    """Typed nodes, isolates among them; the first source of a node wins (SET2)."""
    make = lambda t, p, k, kind, name, o: table(spark, d, t).select(F.concat(F.lit(p), k).alias("node"), F.lit(kind).alias("kind"), (F.col(name) if name else F.lit(None).cast("string")).alias("label"), F.lit(o).alias("o"))
    found = make("customer", "C", "c_custkey", "customer", "c_name", 1)
    for part in (make("supplier", "S", "s_suppkey", "supplier", "s_name", 2), make("part", "P", "p_partkey", "part", "p_name", 3), make("orders", "C", "o_custkey", "buyer", None, 4).distinct()):
        found = found.unionByName(part)
    return R.first_wins(found, ["node"], ["o"]).select("node", "kind", "label")


@query("SELECT s_suppkey, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def required_lookup(spark, d):
    """Suppliers with their nation, which each must have (JN1)."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"))
    return R.join_required(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), nations, "s_nationkey", "nation").select("s_suppkey", "nation")


@query("""WITH k AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_custkey % 3 = 0), e AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key FROM events)
  SELECT e.key, coalesce(CAST(c_custkey AS VARCHAR), 'NAME:' || e.key) AS node FROM e LEFT JOIN k ON e.key = k.key""")
def synthetic_key_fallback(spark, d):
    index = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_custkey").alias("node"))
    return R.keyed_or_synthetic(table(spark, d, "events").select(F.col("user_id").cast("string").alias("key")).distinct(), index, "key", "node", "NAME:")


#: Entities and their keys: words of benchmark items 0 to 24, keyed by a word; mentions: pairs of words of the other items.
WORDS_SQL = r"""w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,9}')) AS word FROM benchmark),
  ix AS (SELECT DISTINCT item_id AS entity, word AS key FROM w WHERE item_id < 25),
  m AS (SELECT DISTINCT item_id * 1000 + length(word) AS mention, max(word) AS name_key FROM w WHERE item_id >= 25 GROUP BY 1)"""


def vocabulary(spark, d):
    words = table(spark, d, "benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,9}"), 0)).alias("word"))
    index = words.where("item_id < 25").select(F.col("item_id").alias("entity"), F.col("word").alias("key")).distinct()
    mentions = words.where("item_id >= 25").groupBy((F.col("item_id") * 1000 + F.char_length("word")).alias("mention")).agg(F.max("word").alias("name_key"))
    return index, mentions


@query(f"""WITH {WORDS_SQL},
  ex AS (SELECT mention, count(DISTINCT entity) AS n, min(entity) AS e FROM m JOIN ix ON name_key = key GROUP BY mention),
  fz AS (SELECT mention, count(DISTINCT entity) AS n, min(entity) AS e FROM m JOIN ix ON length(key) >= 5 AND length(name_key) >= 5 AND levenshtein(name_key, key) <= 1 WHERE mention NOT IN (SELECT mention FROM ex) GROUP BY mention)
  SELECT m.mention, CASE WHEN ex.n = 1 THEN ex.e WHEN fz.n = 1 THEN fz.e END AS entity,
    CASE WHEN ex.n = 1 THEN 'resolved' WHEN ex.n > 1 THEN 'ambiguous' WHEN fz.n = 1 THEN 'resolved_fuzzy' WHEN fz.n > 1 THEN 'ambiguous_fuzzy' ELSE 'unmatched' END AS resolution, coalesce(ex.n, fz.n, 0) AS n_candidates
  FROM m LEFT JOIN ex ON m.mention = ex.mention LEFT JOIN fz ON m.mention = fz.mention""")
def resolve_exact_fuzzy(spark, d):
    index, mentions = vocabulary(spark, d)
    return R.resolve(mentions, index)


@query("""WITH t AS (SELECT DISTINCT concat_ws(' ', p_name, lower(p_type), lower(p_brand)) AS name FROM part UNION SELECT DISTINCT concat_ws(' ', p_name, lower(p_type)) FROM part UNION SELECT DISTINCT p_name FROM part),
  k AS (SELECT name, list_distinct(list_filter(string_split(name, ' '), lambda x: x NOT IN ('small', 'economy') AND x <> '')) AS ws FROM t), q AS (SELECT name, ws, len(ws) AS n, length(name) AS l FROM k),
  p AS (SELECT a.name, b.name AS into_name, row_number() OVER (PARTITION BY a.name ORDER BY b.n DESC, b.l DESC, b.name) AS r FROM q a JOIN q b ON (-b.n, -b.l, b.name) < (-a.n, -a.l, a.name) AND len(list_intersect(a.ws, b.ws)) = a.n WHERE a.n >= 2 AND b.n >= 2)
  SELECT q.name, coalesce(p.into_name, q.name) AS canonical FROM q LEFT JOIN p ON q.name = p.name AND p.r = 1""")
def canonicalise_subset(spark, d):
    p = table(spark, d, "part")
    names = p.select(F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower("p_brand")).alias("name")).union(p.select(F.concat_ws(" ", "p_name", F.lower("p_type")))).union(p.select("p_name"))
    return R.canonical_names(names, ["small", "economy"])


@query(f"""WITH m AS ({ORACLES['canonicalise_subset']}), t AS (SELECT l_suppkey, CASE l_linenumber % 3 WHEN 0 THEN p_name WHEN 1 THEN concat_ws(' ', p_name, lower(p_type)) ELSE concat_ws(' ', p_name, lower(p_type), lower(p_brand)) END AS name FROM lineitem JOIN part ON p_partkey = l_partkey),
  r AS (SELECT DISTINCT l_suppkey AS supplier, coalesce(canonical, t.name) AS body FROM t LEFT JOIN m ON m.name = t.name) SELECT body, count(*) AS n_suppliers FROM r GROUP BY body""")
def rewritten_ties(spark, d):
    """Ties of suppliers to goods under printed names, rewritten to the canonical ones; ties that become alike are one (PRJ5)."""
    p = table(spark, d, "part").withColumns({"two": F.concat_ws(" ", "p_name", F.lower("p_type")), "three": F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower("p_brand"))})
    canonical = R.canonical_names(p.select(F.col("three").alias("name")).union(p.select("two")).union(p.select("p_name")), ["small", "economy"])
    kind = F.col("l_linenumber") % 3
    ties = table(spark, d, "lineitem").join(p, F.col("p_partkey") == F.col("l_partkey")).select("l_suppkey", F.when(kind == 0, F.col("p_name")).when(kind == 1, F.col("two")).otherwise(F.col("three")).alias("name"))
    rewritten = ties.distinct().join(canonical, "name", "left").select(F.col("l_suppkey").alias("supplier"), F.coalesce("canonical", "name").alias("body")).distinct()
    return rewritten.groupBy("body").agg(F.count("*").alias("n_suppliers"))


@query("""WITH i AS (SELECT l_orderkey AS g, l_linenumber * 100000000 + l_orderkey AS item, min(l_quantity) AS low, max(l_quantity + l_discount * 100) AS high FROM lineitem GROUP BY 1, 2),
  s AS (SELECT l_orderkey AS g, l_partkey AS span, min(l_quantity) * 0.9 AS low, min(l_quantity) * 0.9 + 4 AS high FROM lineitem GROUP BY 1, 2),
  j AS (SELECT item, span, least(i.high, s.high) - greatest(i.low, s.low) AS overlap, abs(i.low - s.low) AS away FROM i JOIN s ON i.g = s.g)
  SELECT item, span, round(overlap, 6) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY overlap DESC, away, span) AS r FROM j) WHERE r = 1""")
def interval_overlap_argmax(spark, d):
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "g")
    items = lines.groupBy("g", (F.col("l_linenumber") * 100000000 + F.col("g")).alias("item")).agg(F.min("l_quantity").alias("low"), F.max(F.col("l_quantity") + F.col("l_discount") * 100).alias("high"))
    spans = lines.groupBy("g", F.col("l_partkey").alias("span")).agg(F.min("l_quantity").alias("q")).select("g", "span", (F.col("q") * 0.9).alias("low"), (F.col("q") * 0.9 + 4).alias("high"))
    return R.best_overlap(items, spans, ["g"]).withColumn("overlap", F.round("overlap", 6))


RULES = [("th", "there", 1), ("th", "that", 1), ("and", "andere", 2), ("on", "onion", 1), ("her", "heresy", 2), ("pass", "password", 3), ("are", "are", 0)]


@query(f"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), c AS (SELECT word, count(*) AS n FROM w GROUP BY 1), r(label, anchor, most) AS (VALUES {', '.join(f"('{a}', '{b}', {k})" for a, b, k in RULES)})
  SELECT label, anchor, word, n FROM c JOIN r ON levenshtein(word, anchor) <= most""")
def fuzzy_vocabulary(spark, d):
    """Words of all documents within a few edits of a rule's anchor (JN18, FN38)."""
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word"))
    return R.vocabulary_hits(words, RULES).groupBy("label", "anchor", "word").agg(F.count("*").alias("n"))


@query(f"""WITH {edges_sql(10)}, {ties_sql(10, 'signup').replace('p AS', 'p9 AS')}, b9 AS (SELECT person AS node, count(*) AS n_bodies FROM p9 GROUP BY 1)
  SELECT coalesce(deg.node, b9.node) AS node, degree, n_bodies FROM deg FULL JOIN b9 ON deg.node = b9.node""")
def merge_two_networks(spark, d):
    """Degrees in one network beside those in another; blank where a node has no part in it (JN6)."""
    one = G.degrees(G.project(ties(spark, d, 10), shared=False).select("src", "dst"))
    two = ties(spark, d, 10, "signup").groupBy(F.col("person").alias("node")).agg(F.count("*").alias("n_bodies"))
    return R.merge_measures(one, two, "node").select("node", "degree", "n_bodies")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT user_id FROM events) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000)")
def semi_and_anti(spark, d):
    """Customers with events and without orders of one status (JN4, JN5)."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    users = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"))
    open_orders = table(spark, d, "orders").where("o_orderstatus = 'P' AND o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(users, "c_custkey", "left_semi").join(open_orders, "c_custkey", "left_anti")


@query("""WITH g AS (SELECT user_id, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS kinds FROM events GROUP BY 1) SELECT c_custkey, coalesce(kinds, 'unknown') AS kinds FROM customer LEFT JOIN g ON c_custkey = user_id""")
def left_with_list_payload(spark, d):
    """A list of kinds for each customer, or a default (JN2, JN3, AGG14, AGG15)."""
    kinds = table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), ";").alias("kinds"))
    return table(spark, d, "customer").select("c_custkey").join(kinds, "c_custkey", "left").select("c_custkey", F.coalesce("kinds", F.lit("unknown")).alias("kinds"))


@query("""WITH g AS (SELECT n_nationkey, CASE WHEN n_regionkey IN (0, 1) THEN 'west' WHEN n_nationkey % 2 = 0 THEN 'even' WHEN n_regionkey = 4 THEN 'four' ELSE 'other' END AS zone FROM nation) SELECT zone, count(*) AS n FROM customer JOIN g ON c_nationkey = n_nationkey GROUP BY 1""")
def gazetteer_precedence(spark, d):
    """Places looked up in lists, the first list that has one deciding (JN17)."""
    n = table(spark, d, "nation")
    zone = F.when(F.col("n_regionkey").isin(0, 1), "west").when(F.col("n_nationkey") % 2 == 0, "even").when(F.col("n_regionkey") == 4, "four").otherwise("other")
    placed = n.select(F.col("n_nationkey").alias("c_nationkey"), zone.alias("zone"))
    return table(spark, d, "customer").join(placed, "c_nationkey").groupBy("zone").agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'signup') SELECT user_id FROM u EXCEPT SELECT user_id FROM events WHERE value > 98 AND event_type = 'error'""")
def intersect_except(spark, d):
    e = table(spark, d, "events")
    kind = lambda k: e.where(F.col("event_type") == k).select("user_id")
    return kind("purchase").intersect(kind("signup")).exceptAll(e.where("value > 98 AND event_type = 'error'").select("user_id").distinct())


@query("""WITH w AS (SELECT item_id, unnest(range(len(string_split(text, ' ')))) AS i, unnest(string_split(text, ' ')) AS word FROM benchmark) SELECT item_id, word FROM (SELECT *, row_number() OVER (PARTITION BY item_id, lower(word) ORDER BY i) AS r FROM w) WHERE r = 1""")
def case_insensitive_distinct(spark, d):
    """Words distinct but for case, the first form of each kept (SET6, SET7)."""
    words = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("i", "word")).withColumn("low", F.lower("word"))
    return R.first_wins(words, ["item_id", "low"], ["i"]).select("item_id", "word")


@query("""SELECT o_orderpriority, n, CAST(place AS INT) AS place FROM (SELECT o_orderpriority, count(*) AS n, CASE substr(o_orderpriority, 1, 1) WHEN '5' THEN 1 WHEN '3' THEN 2 WHEN '1' THEN 3 ELSE 4 END AS place FROM orders GROUP BY 1) ORDER BY place, o_orderpriority""")
def fixed_order(spark, d):
    """Counts in a fixed order of categories, the rest last (SRT5)."""
    n = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    place = F.array_position(F.array(F.lit("5"), F.lit("3"), F.lit("1")), F.substring("o_orderpriority", 1, 1)).cast("int")
    return n.withColumn("place", F.when(place > 0, place).otherwise(4)).orderBy("place", "o_orderpriority")


@query("""WITH t AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 12) SELECT p.p_brand, p_type, count(*) AS n FROM part p JOIN t ON p.p_brand = t.p_brand GROUP BY 1, 2""")
def top_groups_by_class(spark, d):
    """The mix of classes within the twelve largest groups (SRT4)."""
    p = table(spark, d, "part").select("p_brand", "p_type")
    top = p.groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(12).select("p_brand")
    return p.join(F.broadcast(top), "p_brand").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))


@query("""SELECT 'purchase' AS kind, user_id AS source, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS target FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'signup', user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) FROM events WHERE event_type = 'signup'""")
def combined_edges(spark, d):
    """Edge lists of two kinds in one table, each with its kind (SET1, PRJ3, PRJ4)."""
    parts = [ties(spark, d, 60, k, distinct=False).select(F.lit(k).alias("kind"), F.col("person").alias("source"), F.col("body").alias("target")) for k in ("purchase", "signup")]
    return parts[0].unionByName(parts[1])


@query("""SELECT doc_id FROM documents WHERE len(string_split(trim(text), ' ')) > 0 AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(string_split(lower(text), ' ')) AS w) WHERE NOT regexp_matches(w, '^[a-z]*[.,]?$')) AND n_chars < 400""")
def all_tokens_predicate(spark, d):
    """Short documents whose every word has one shape (FIL7)."""
    words = F.split(F.lower("text"), " ")
    return table(spark, d, "documents").where("n_chars < 400").where(F.forall(words, lambda w: w.rlike("^[a-z]*[.,]?$"))).select("doc_id")
