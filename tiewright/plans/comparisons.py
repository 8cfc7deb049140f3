"""Queries that compose several operators: batteries, matched comparisons, centrality against degree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tiewright.operators import components as C
from tiewright.operators import graph as G
from tiewright.operators import inference as I
from tiewright.operators import profile as P
from tiewright.plans.network import ORACLES as NETWORK_SQL
from tiewright.plans.network import edges_sql, small_graph, ties, ties_sql
from tiewright.plans.statistics import segment_labels
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


ATTRIBUTES = {"segment": "c_mktsegment", "region_side": "CASE WHEN c_nationkey < 12 THEN 'low' ELSE 'high' END", "balance": "CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END", "constant": "'one'"}


def _battery_sql() -> str:
    parts = [
        f"SELECT '{name}' AS attribute, a, count(*) AS n, sum(CAST(a = b AS INT)) AS same FROM (SELECT {expr.replace('c_', 'x.c_')} AS a, {expr.replace('c_', 'y.c_')} AS b FROM s JOIN customer x ON s.node = x.c_custkey JOIN customer y ON s.other = y.c_custkey) GROUP BY a"
        for name, expr in ATTRIBUTES.items()
    ]
    return f"""WITH {edges_sql()}, g AS ({' UNION ALL '.join(parts)}), t AS (SELECT attribute, count(*) AS n_groups, sum(n)::DOUBLE AS m, sum(same)::DOUBLE AS s, sum(n * n)::DOUBLE AS sq FROM g GROUP BY attribute)
      SELECT attribute, n_groups, CAST(m / 2 AS BIGINT) AS n_edges, round((s / m - sq / (m * m)) / (1 - sq / (m * m)), 6) AS r, round((m - 2 * s) / m, 6) AS ei FROM t WHERE n_groups >= 2 AND m >= 20"""


@query(_battery_sql())
def homophily_battery(spark, d):
    """Assortativity and E-I of several attributes; those without two groups are left out (ST11)."""
    c = table(spark, d, "customer")
    labels = {name: c.select(F.col("c_custkey").alias("node"), F.expr(expr).alias("label")) for name, expr in ATTRIBUTES.items()}
    found = I.battery(G.project(ties(spark, d), shared=False).select("src", "dst"), labels, least=10)
    return found.withColumns({"r": r6("r"), "ei": r6("ei")})


def _robust_sql(name: str, where: str) -> str:
    return f"""SELECT '{name}' AS variant, round((s / m - sq / (m * m)) / (1 - sq / (m * m)), 6) AS value FROM (SELECT sum(n)::DOUBLE AS m, sum(same)::DOUBLE AS s, sum(n * n)::DOUBLE AS sq FROM (
      SELECT a, count(*) AS n, sum(CAST(a = b AS INT)) AS same FROM (SELECT x.c_mktsegment AS a, y.c_mktsegment AS b FROM (SELECT DISTINCT i.person AS node, j.person AS other FROM p i JOIN p j ON i.body = j.body AND i.person <> j.person WHERE {where}) q JOIN customer x ON q.node = x.c_custkey JOIN customer y ON q.other = y.c_custkey) GROUP BY a))"""


#: Edges with the labels and strata of both ends: quartiles of degree, cut at values, among all nodes with ties.
STRATA = """v AS (SELECT list_sort(list(degree)) AS v FROM deg), st AS (SELECT node, CAST(degree > v[1 + CAST(floor(0.25 * len(v)) AS INT)] AS INT) + CAST(degree > v[1 + CAST(floor(0.5 * len(v)) AS INT)] AS INT) + CAST(degree > v[1 + CAST(floor(0.75 * len(v)) AS INT)] AS INT) AS stratum FROM deg, v),
  en AS (SELECT s.node, s.other, x.c_mktsegment AS a, y.c_mktsegment AS b, g.stratum AS s, h.stratum AS t FROM s JOIN customer x ON s.node = x.c_custkey JOIN customer y ON s.other = y.c_custkey JOIN st g ON g.node = s.node JOIN st h ON h.node = s.other)"""


def chance_sql(stratum: str) -> str:
    """The mean share of edges within labels when labels move within ``stratum`` (s or t of an edge, or one for all)."""
    s, t = (stratum, stratum) if stratum == "0" else ("s", "t")
    return f"""(WITH k AS (SELECT stratum, a, count(*)::DOUBLE AS k, sum(count(*)) OVER (PARTITION BY stratum) AS n FROM (SELECT DISTINCT node, {s} AS stratum, a FROM en) GROUP BY 1, 2),
      c AS (SELECT x.stratum AS s, y.stratum AS t, sum(CASE WHEN x.stratum = y.stratum THEN x.k * (x.k - 1) / (x.n * (x.n - 1)) ELSE x.k * y.k / (x.n * y.n) END) AS chance FROM k x JOIN k y ON x.a = y.a GROUP BY 1, 2)
      SELECT avg(coalesce(chance, 0)) FROM en LEFT JOIN c ON c.s = {'0' if stratum == '0' else 'en.s'} AND c.t = {'0' if stratum == '0' else 'en.t'})"""


@query(f"""WITH {edges_sql()}, {STRATA}, n AS (SELECT p.person, p.body, c_mktsegment AS label FROM p JOIN customer ON c_custkey = person), b AS (SELECT x.body, avg(CAST(x.label = y.label AS INT)) AS pure FROM n x JOIN n y ON x.body = y.body AND x.person < y.person GROUP BY x.body)
  {_robust_sql('all', 'i.body IN (SELECT body FROM ok)')} UNION ALL {_robust_sql('without_marked', "i.body IN (SELECT body FROM ok) AND NOT regexp_matches(CAST(i.body AS VARCHAR), '[05]$')")} UNION ALL {_robust_sql('marked_only', "i.body IN (SELECT body FROM ok) AND regexp_matches(CAST(i.body AS VARCHAR), '[05]$')")}
  UNION ALL SELECT 'beyond_chance', round(avg(CAST(a = b AS INT)) - {chance_sql('0')}, 6) FROM en UNION ALL SELECT 'beyond_chance_within_quartiles', round(avg(CAST(a = b AS INT)) - {chance_sql('s')}, 6) FROM en
  UNION ALL SELECT 'equal_bodies', round(avg(pure), 6) FROM b""")
def robustness_battery(spark, d):
    """One measure under five conditions: bodies left out or kept by a pattern of their names, what it exceeds chance by when
    labels move freely and within quartiles of degree only, and with bodies counting alike (ST13, FIL6)."""
    found, labels = ties(spark, d), segment_labels(spark, d)
    marked = F.col("body").cast("string").rlike("[05]$")
    make = lambda t: I.nominal_assortativity(G.project(t, shared=False).select("src", "dst"), labels).select(F.col("r").alias("value"))
    edges = G.project(found, shared=False).select("src", "dst")
    strata = P.index_cut_quartiles(G.degrees(edges).withColumn("all", F.lit(1)), "degree", ["all"]).select("node", "stratum")
    beyond = lambda s: I.expected_same(edges, labels, s).select((F.col("same") - F.col("expected")).alias("value"))
    parts = {
        "all": make(found), "without_marked": make(found.where(~marked)), "marked_only": make(found.where(marked)), "beyond_chance": beyond(None), "beyond_chance_within_quartiles": beyond(strata),
        "equal_bodies": I.body_purity(found, labels).select(F.col("purity").alias("value")),
    }
    rows = [df.select(F.lit(k).alias("variant"), r6("value").alias("value")) for k, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query(f"""WITH RECURSIVE {edges_sql(10)}, reach AS (SELECT DISTINCT node, node AS seen FROM s UNION SELECT reach.node, s.other FROM reach JOIN s ON reach.seen = s.node), lab AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
  z AS (SELECT component FROM lab GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)
  SELECT c_mktsegment AS label, count(*) AS n, round(avg(degree), 6) AS mean FROM deg JOIN customer ON c_custkey = deg.node WHERE deg.node IN (SELECT node FROM lab WHERE component IN (SELECT component FROM z)) GROUP BY 1""")
def matched_comparison(spark, d):
    """Mean degree by label within the giant component (ST17, GR22, GR3)."""
    edges = small_graph(spark, d)
    members = C.giant(C.components(edges))
    return I.matched_means(G.degrees(edges), members, segment_labels(spark, d), "degree").withColumn("mean", r6("mean"))


@query(f"""WITH RECURSIVE {edges_sql(10)}, reach AS (SELECT DISTINCT node, node AS seen FROM s UNION SELECT reach.node, s.other FROM reach JOIN s ON reach.seen = s.node), lab AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
  z AS (SELECT component FROM lab GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)
  SELECT c_mktsegment AS label, count(*) AS n, round(avg(degree), 6) AS mean FROM deg JOIN customer ON c_custkey = deg.node WHERE deg.node IN (SELECT node FROM lab WHERE component IN (SELECT component FROM z)) AND regexp_matches(CAST(c_custkey AS VARCHAR), '[0-4]$') AND c_acctbal >= 0 GROUP BY 1""")
def matched_comparison_one_basis(spark, d):
    """Mean degree by label within the giant component, among labels that rest on the same evidence only (ST17)."""
    edges = small_graph(spark, d)
    basis = F.when(~F.col("c_custkey").cast("string").rlike("[0-4]$"), "name").when(F.col("c_acctbal") < 0, "place").otherwise("stated")
    labels = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("label"), basis.alias("basis"))
    return I.matched_means(G.degrees(edges), C.giant(C.components(edges)), labels, "degree", "stated").withColumn("mean", r6("mean"))


@query(f"""WITH bb AS ({NETWORK_SQL['betweenness']}), {edges_sql(10)} SELECT degree, count(*) AS n, round(list_sort(list(betweenness))[count(*) // 2 + 1], 6) AS upper_median FROM bb JOIN deg ON bb.node = deg.node GROUP BY degree HAVING count(*) >= 5""")
def degree_vs_betweenness(spark, d):
    """The upper median of betweenness at each degree that five nodes have (GR21)."""
    edges = small_graph(spark, d)
    both = G.betweenness(edges).join(G.degrees(edges), "node").withColumn("betweenness", r6("betweenness"))
    return P.upper_medians(both, "betweenness", ["degree"]).where("n >= 5")


@query(f"""WITH bb AS ({NETWORK_SQL['betweenness']}), {edges_sql(10)}, x AS (SELECT bb.node, degree, betweenness, betweenness / degree AS per_tie FROM bb JOIN deg ON bb.node = deg.node)
  SELECT round(corr(degree, betweenness), 6) AS r, count(*) AS n, (SELECT node FROM x WHERE betweenness > 0 ORDER BY round(per_tie, 9) DESC, node LIMIT 1) AS leanest FROM x""")
def degree_betweenness_correlation(spark, d):
    """Pearson's r of degree and betweenness, and the broker with the most betweenness for each tie (GR21)."""
    edges = small_graph(spark, d)
    both = G.betweenness(edges).join(G.degrees(edges), "node").withColumn("betweenness", r6("betweenness"))
    lean = F.struct((-F.round(F.col("betweenness") / F.col("degree"), 9)).alias("k"), "node")
    return both.agg(r6(F.corr("degree", "betweenness")).alias("r"), F.count("*").alias("n"), F.min(F.when(F.col("betweenness") > 0, lean))["node"].alias("leanest"))


@query("""WITH b AS (SELECT user_id, CAST(floor(min(value) / 10) * 10 AS INT) AS cohort, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1), g AS (SELECT cohort, count(*) AS n, round(avg(CAST(kinds >= 5 AS INT)), 6) AS share_wide FROM b GROUP BY 1) SELECT least(cohort, 20) AS cohort, CAST(sum(n) AS BIGINT) AS n, round(sum(n * share_wide) / sum(n), 4) AS share_wide FROM g GROUP BY 1""")
def cohort_rates(spark, d):
    """A rate by cohort, late cohorts in one (AGG7, AGG20)."""
    users = table(spark, d, "events").groupBy("user_id").agg((F.floor(F.min("value") / 10) * 10).cast("int").alias("cohort"), F.countDistinct("event_type").alias("kinds"))
    return users.groupBy(F.least("cohort", F.lit(20)).alias("cohort")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("kinds") >= 5).cast("int")), 4).alias("share_wide"))
