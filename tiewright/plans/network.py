"""Queries on co-membership networks: people are users, bodies are time slots in which they had an event of one kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiewright.operators import components as C
from tiewright.operators import graph as G
from tiewright.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL text."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def ties(spark, d: str, minutes: int = 60, kind: str = "purchase", distinct: bool = True) -> DataFrame:
    """(person, body): users and the slots of their events; slots count from 1970, whatever the session's time zone."""
    slot = F.floor((F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01")) * 1440 + F.hour("ts") * 60 + F.minute("ts")) / minutes).cast("long")
    found = table(spark, d, "events").where(F.col("event_type") == kind).select(F.col("user_id").alias("person"), slot.alias("body"))
    return found.distinct() if distinct else found


def ties_sql(minutes: int = 60, kind: str = "purchase") -> str:
    return f"p AS (SELECT DISTINCT user_id AS person, CAST(floor(epoch(ts) / {60 * minutes}) AS BIGINT) AS body FROM events WHERE event_type = '{kind}')"


def edges_sql(minutes: int = 60, cap: int = 60) -> str:
    """p, and e: the projection's pairs."""
    return f"""{ties_sql(minutes)},
      ok AS (SELECT body FROM p GROUP BY body HAVING count(*) BETWEEN 2 AND {cap}),
      pairs AS (SELECT a.person AS src, b.person AS dst, a.body FROM p a JOIN p b ON a.body = b.body AND a.person < b.person WHERE a.body IN (SELECT body FROM ok)),
      e AS (SELECT DISTINCT src, dst FROM pairs), s AS (SELECT src AS node, dst AS other FROM e UNION ALL SELECT dst, src FROM e),
      deg AS (SELECT node, count(*) AS degree FROM s GROUP BY node)"""


def small_graph(spark, d: str) -> DataFrame:
    return G.project(ties(spark, d, 10), shared=False).select("src", "dst")


def part_ties(spark, d: str) -> DataFrame:
    """A graph of many components: customers and the parts they returned in bulk, as negative and positive numbers."""
    lines = table(spark, d, "lineitem").where("l_quantity >= 49 AND l_returnflag = 'R'")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select((-F.col("o_custkey") - 1).alias("src"), F.col("l_partkey").alias("dst")).distinct()


PART_TIES = """g AS (SELECT DISTINCT -o_custkey - 1 AS src, l_partkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 49 AND l_returnflag = 'R'),
  s AS (SELECT src AS node, dst AS other FROM g UNION SELECT dst, src FROM g),
  reach AS (SELECT node, node AS seen FROM s UNION SELECT reach.node, s.other FROM reach JOIN s ON reach.seen = s.node),
  lab AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)"""


@query(f"WITH {edges_sql()} SELECT src, dst, count(*) AS weight, string_agg(CAST(body AS VARCHAR), ';' ORDER BY body) AS shared FROM pairs GROUP BY src, dst")
def comembership_projection(spark, d):
    return G.project(ties(spark, d))


@query(f"WITH {edges_sql(60, 5)} SELECT src, dst, count(*) AS weight FROM pairs GROUP BY src, dst")
def comembership_capped(spark, d):
    return G.project(ties(spark, d), cap=5, shared=False)


@query(f"""WITH {edges_sql()}, tri AS (SELECT a.src AS a, a.dst AS b, b.dst AS c FROM e a JOIN e b ON a.dst = b.src JOIN e x ON x.src = a.src AND x.dst = b.dst),
  t AS (SELECT node, count(*) AS n FROM (SELECT a AS node FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) GROUP BY node)
  SELECT deg.node, degree, round(CASE WHEN degree < 2 THEN 0.0 ELSE 2.0 * coalesce(n, 0) / (degree * (degree - 1)) END, 6) AS clustering FROM deg LEFT JOIN t ON deg.node = t.node""")
def comembership_degree_clustering(spark, d):
    edges = G.project(ties(spark, d), shared=False).select("src", "dst")
    return G.clustering(edges).withColumn("clustering", F.round("clustering", 6))


@query(f"""WITH {edges_sql(10)}, tri AS (SELECT a.src AS a, a.dst AS b, b.dst AS c FROM e a JOIN e b ON a.dst = b.src JOIN e x ON x.src = a.src AND x.dst = b.dst),
  t AS (SELECT node, count(*) AS n FROM (SELECT a AS node FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) GROUP BY node)
  SELECT round(avg(CASE WHEN degree < 2 THEN 0.0 ELSE 2.0 * coalesce(n, 0) / (degree * (degree - 1)) END), 6) AS average_clustering, count(*) AS n_nodes FROM deg LEFT JOIN t ON deg.node = t.node""")
def average_clustering(spark, d):
    return G.clustering(small_graph(spark, d)).agg(F.round(F.avg("clustering"), 6).alias("average_clustering"), F.count("*").alias("n_nodes"))


@query(f"""WITH {ties_sql()}, raw AS (SELECT user_id AS person, count(*) AS n_ties FROM events WHERE event_type = 'purchase' GROUP BY user_id)
  SELECT p.person, count(*) AS degree, any_value(n_ties) AS n_ties FROM p JOIN raw ON p.person = raw.person GROUP BY p.person""")
def tie_degree_vs_node_degree(spark, d):
    all_ties = ties(spark, d, distinct=False)
    return all_ties.groupBy("person").agg(F.countDistinct("body").alias("degree"), F.count("*").alias("n_ties"))


@query(f"WITH RECURSIVE {PART_TIES} SELECT node, component FROM lab")
def connected_components(spark, d):
    return C.components(part_ties(spark, d))


@query(f"WITH RECURSIVE {PART_TIES}, z AS (SELECT component, count(*) AS size FROM lab GROUP BY component) SELECT size, count(*) AS n_components, CAST(sum(size) AS BIGINT) AS n_nodes FROM z GROUP BY size")
def component_size_distribution(spark, d):
    return C.size_distribution(C.components(part_ties(spark, d)))


@query(f"WITH RECURSIVE {PART_TIES}, z AS (SELECT component, count(*) AS size FROM lab GROUP BY component ORDER BY size DESC, component LIMIT 1) SELECT node, component FROM lab WHERE component IN (SELECT component FROM z)")
def giant_component(spark, d):
    return C.giant(C.components(part_ties(spark, d))).select("node", "component")


PATHS = f"""{edges_sql(10)},
  bfs AS (SELECT DISTINCT node AS source, node, 0 AS dist FROM s UNION SELECT bfs.source, s.other, bfs.dist + 1 FROM bfs JOIN s ON bfs.node = s.node WHERE bfs.dist < 14),
  dist AS (SELECT source, node, min(dist) AS dist FROM bfs GROUP BY source, node)"""


@query(f"WITH RECURSIVE {PATHS} SELECT source AS node, round(count(*)::DOUBLE / sum(dist) * count(*) / ((SELECT count(*) FROM deg) - 1), 6) AS closeness FROM dist WHERE dist > 0 GROUP BY source")
def closeness(spark, d):
    return G.closeness(small_graph(spark, d)).withColumn("closeness", F.round("closeness", 6))


@query(f"WITH RECURSIVE {PATHS} SELECT dist, count(*) AS n_pairs, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM dist WHERE dist > 0 GROUP BY dist")
def path_lengths(spark, d):
    found = G.length_counts(small_graph(spark, d))
    return found.withColumn("share", F.round(F.col("n_pairs") / F.sum("n_pairs").over(Window.partitionBy()), 6))


@query(f"WITH RECURSIVE {PATHS} SELECT dist, count(*) AS n_pairs FROM dist WHERE dist > 0 AND source IN (SELECT node FROM deg ORDER BY md5('11:' || node), node LIMIT 120) GROUP BY dist")
def path_lengths_sampled(spark, d):
    """Distances from 120 nodes chosen by a seeded hash (FIL10)."""
    edges = small_graph(spark, d)
    chosen = G.degrees(edges).select("node").orderBy(F.md5(F.concat(F.lit("11:"), F.col("node").cast("string"))), "node").limit(120)
    return G.length_counts(edges, chosen)


LEVELS = 9


def _betweenness_sql() -> str:
    """Paths counted level by level, then the share of shortest paths through each node, over pairs of its component."""
    levels = ["l0 AS (SELECT DISTINCT node AS source, node, 0 AS dist, 1.0::DOUBLE AS paths FROM s)"]
    for i in range(1, LEVELS + 1):
        seen = " UNION ALL ".join(f"SELECT source, node FROM l{j}" for j in range(i))
        levels.append(f"l{i} AS (SELECT x.source, s.other AS node, {i} AS dist, sum(paths) AS paths FROM l{i - 1} x JOIN s ON x.node = s.node WHERE (x.source, s.other) NOT IN ({seen}) GROUP BY x.source, s.other)")
    union = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(LEVELS + 1))
    return f"""WITH {edges_sql(10)}, {', '.join(levels)}, d AS ({union}), n AS (SELECT source AS node, count(*) AS n FROM d GROUP BY source),
      b AS (SELECT a.node AS node, sum(a.paths * c.paths / t.paths) AS dep FROM d a JOIN d c ON a.node = c.source JOIN d t ON t.source = a.source AND t.node = c.node AND t.dist = a.dist + c.dist WHERE a.dist > 0 AND c.dist > 0 GROUP BY a.node)
      SELECT n.node, round(CASE WHEN n <= 2 THEN 0.0 ELSE coalesce(dep, 0.0) / ((n - 1) * (n - 2)) END, 6) AS betweenness FROM n LEFT JOIN b ON n.node = b.node"""


@query(_betweenness_sql())
def betweenness(spark, d):
    return G.betweenness(small_graph(spark, d)).withColumn("betweenness", F.round("betweenness", 6))


@query(f"WITH {edges_sql()} SELECT round(corr(x.degree, y.degree), 6) AS r, count(*) AS n_ends FROM s JOIN deg x ON s.node = x.node JOIN deg y ON s.other = y.node")
def degree_assortativity(spark, d):
    return G.degree_assortativity(G.project(ties(spark, d), shared=False).select("src", "dst")).withColumn("r", F.round("r", 6))


@query(f"""WITH {edges_sql(10)}, low AS (SELECT node FROM deg WHERE degree <= 40), s2 AS (SELECT node, other FROM s WHERE node IN (SELECT node FROM low) AND other IN (SELECT node FROM low)),
  d2 AS (SELECT node, count(*) AS degree FROM s2 GROUP BY node), p2 AS (SELECT s2.node, other, 1.0::DOUBLE / degree AS p FROM s2 JOIN d2 ON s2.node = d2.node),
  q AS (SELECT a.node, b.other, sum(a.p * b.p) AS q FROM p2 a JOIN p2 b ON a.other = b.node AND a.node <> b.other GROUP BY a.node, b.other)
  SELECT p2.node, any_value(degree) AS degree, round(sum((p + coalesce(q, 0)) ** 2), 6) AS "constraint" FROM p2 LEFT JOIN q ON p2.node = q.node AND p2.other = q.other JOIN d2 ON d2.node = p2.node GROUP BY p2.node""")
def burt_constraint(spark, d):
    return G.constraint(small_graph(spark, d)).withColumn("constraint", F.round("constraint", 6))


def _core_sql(rounds: int = 14) -> str:
    steps = ["v0 AS (SELECT node, degree AS core FROM deg)"]
    for i in range(1, rounds + 1):
        steps.append(f"v{i} AS MATERIALIZED (SELECT node, max(least(core, n)) AS core FROM (SELECT s.node, v.core, sum(count(*)) OVER (PARTITION BY s.node ORDER BY v.core DESC) AS n FROM s JOIN v{i - 1} v ON s.other = v.node GROUP BY s.node, v.core) GROUP BY node)")
    return f"WITH {edges_sql(10)}, {', '.join(steps)} SELECT node, CAST(core AS BIGINT) AS core FROM v{rounds}"


@query(_core_sql())
def k_core(spark, d):
    return G.core_numbers(small_graph(spark, d))


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_quantity >= 45)
  SELECT a.p AS src, b.p AS dst, count(*) AS weight FROM l a JOIN l b ON a.o = b.o AND a.p < b.p GROUP BY a.p, b.p""")
def reverse_projection(spark, d):
    lines = table(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("body"), F.col("l_partkey").alias("person"))
    return G.project(lines, shared=False)


@query("""WITH q AS (SELECT DISTINCT user_id AS person, event_type AS place FROM events), p2 AS (SELECT a.place AS src, b.place AS dst, count(*) AS weight FROM q a JOIN q b ON a.person = b.person AND a.place < b.place GROUP BY 1, 2)
  SELECT src, dst, weight FROM p2 ORDER BY weight DESC, src, dst LIMIT 3""")
def place_projection_heaviest(spark, d):
    """Kinds of event tied by common users, and the heaviest ties (GR16, AGG16)."""
    held = table(spark, d, "events").select(F.col("user_id").alias("body"), F.col("event_type").alias("person"))
    return G.project(held, shared=False).orderBy(F.desc("weight"), "src", "dst").limit(3)


@query(f"""WITH {ties_sql()}, top AS (SELECT person FROM p GROUP BY person ORDER BY count(*) DESC, person LIMIT 4), own AS (SELECT * FROM p WHERE person IN (SELECT person FROM top)),
  pr AS (SELECT a.person, a.body AS b1, b.body AS b2 FROM own a JOIN own b ON a.person = b.person AND a.body < b.body),
  r AS (SELECT DISTINCT pr.person, b1, b2 FROM pr JOIN p x ON x.body = b1 AND x.person <> pr.person JOIN p y ON y.body = b2 AND y.person = x.person)
  SELECT own.person, count(*) AS n_bodies, (SELECT count(*) FROM pr WHERE pr.person = own.person) AS n_pairs, (SELECT count(*) FROM r WHERE r.person = own.person) AS n_redundant FROM own GROUP BY own.person""")
def ego_redundancy(spark, d):
    found = ties(spark, d)
    top = found.groupBy("person").count().orderBy(F.desc("count"), "person").limit(4)
    return G.ego_redundancy(found, top)


@query(f"""WITH RECURSIVE {edges_sql(10)}, rk AS (SELECT node, row_number() OVER (ORDER BY degree DESC, node) AS targeted, row_number() OVER (ORDER BY md5('42:' || node), node) AS random FROM deg),
  st AS (SELECT unnest(range(0, 101, 10)) AS removed), alive AS (SELECT 'targeted' AS strategy, removed, node FROM rk, st WHERE targeted > removed UNION ALL SELECT 'random', removed, node FROM rk, st WHERE random > removed),
  reach AS (SELECT strategy, removed, node, node AS seen FROM alive UNION SELECT r.strategy, r.removed, r.node, s.other FROM reach r JOIN s ON r.seen = s.node JOIN alive a ON a.strategy = r.strategy AND a.removed = r.removed AND a.node = s.other)
  SELECT strategy, CAST(removed AS INT) AS removed, max(n) AS giant FROM (SELECT strategy, removed, node, count(*) AS n FROM reach GROUP BY ALL) GROUP BY 1, 2""")
def attack_tolerance(spark, d):
    return G.attack_tolerance(small_graph(spark, d), list(range(0, 101, 10)))


@query(f"""WITH {ties_sql()}, x AS (SELECT 'person' AS side, count(*) AS degree FROM p GROUP BY person UNION ALL SELECT 'body', count(*) FROM p GROUP BY body)
  SELECT side, least(degree, 10) AS band, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY side), 6) AS share FROM x GROUP BY side, least(degree, 10)""")
def two_mode_marginals(spark, d):
    """Degrees on both sides, banded at 10 (GR18)."""
    found = ties(spark, d)
    sides = found.groupBy("person").agg(F.count("*").alias("degree")).select(F.lit("person").alias("side"), "degree").unionByName(found.groupBy("body").agg(F.count("*").alias("degree")).select(F.lit("body").alias("side"), "degree"))
    banded = sides.groupBy("side", F.least("degree", F.lit(10)).alias("band")).agg(F.count("*").alias("n"))
    return banded.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("side")), 6))
