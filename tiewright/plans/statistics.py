"""Queries for homophily, exact and permutation tests, and regression: labels are market segments of users."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiewright.operators import graph as G
from tiewright.operators import inference as I
from tiewright.operators import profile as P
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


def segment_labels(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("label"))


def edges(spark, d):
    return G.project(ties(spark, d), shared=False).select("src", "dst")


def r6(c):
    return F.round(c, 6)


ENDS = f"""{edges_sql()}, lab AS (SELECT c_custkey AS node, c_mktsegment AS label FROM customer),
  en AS (SELECT s.node, s.other, x.label AS a, y.label AS b FROM s JOIN lab x ON s.node = x.node JOIN lab y ON s.other = y.node)"""


@query(f"""WITH {ENDS}, m AS (SELECT count(*)::DOUBLE AS m, sum(CAST(a = b AS INT)) AS same FROM en), q AS (SELECT sum(n * n)::DOUBLE AS sq FROM (SELECT a, count(*) AS n FROM en GROUP BY a))
  SELECT round((same / m - sq / (m * m)) / (1 - sq / (m * m)), 6) AS r, CAST(m / 2 AS BIGINT) AS n_edges FROM m, q""")
def label_assortativity(spark, d):
    return I.nominal_assortativity(edges(spark, d), segment_labels(spark, d)).withColumn("r", r6("r"))


@query(f"""WITH {ENDS}, c AS (SELECT count(*) FILTER (a = b) AS n_internal, count(*) FILTER (a <> b) AS n_external FROM en WHERE node < other) SELECT n_internal, n_external, round((n_external - n_internal)::DOUBLE / (n_external + n_internal), 6) AS ei FROM c""")
def ei_index(spark, d):
    return I.external_internal(edges(spark, d), segment_labels(spark, d)).withColumn("ei", r6("ei"))


@query(f"""WITH {ENDS}, g AS (SELECT a AS label, avg(CAST(a = b AS INT)) AS share, count(DISTINCT node) AS size FROM en GROUP BY a), x AS (SELECT *, (size - 1)::DOUBLE / (sum(size) OVER () - 1) AS e FROM g)
  SELECT label, size, round(share, 6) AS share, round((share - e) / (1 - e), 6) AS coleman FROM x""")
def coleman(spark, d):
    return I.coleman(edges(spark, d), segment_labels(spark, d)).withColumns({"share": r6("share"), "coleman": r6("coleman")})


@query(f"""WITH {ties_sql()}, n AS (SELECT p.person, p.body, c_mktsegment AS label FROM p JOIN customer ON c_custkey = person), b AS (SELECT x.body, avg(CAST(x.label = y.label AS INT)) AS pure FROM n x JOIN n y ON x.body = y.body AND x.person < y.person GROUP BY x.body)
  SELECT round(avg(pure), 6) AS purity, count(*) AS n_bodies FROM b""")
def body_purity(spark, d):
    return I.body_purity(ties(spark, d), segment_labels(spark, d)).withColumn("purity", r6("purity"))


@query(f"""WITH {ENDS}, o AS (SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM en WHERE node < other GROUP BY 1, 2), g AS (SELECT a, count(DISTINCT node) AS people, count(*) AS ends FROM en GROUP BY a),
  h AS (SELECT a, people::DOUBLE / sum(people) OVER () AS p, ends::DOUBLE / sum(ends) OVER () AS q FROM g)
  SELECT o.a, o.b, n, round(n::DOUBLE / sum(n) OVER (), 6) AS share, round(x.p * y.p * CASE WHEN o.a = o.b THEN 1 ELSE 2 END, 6) AS by_size, round(x.q * y.q * CASE WHEN o.a = o.b THEN 1 ELSE 2 END, 6) AS by_ends FROM o JOIN h x ON o.a = x.a JOIN h y ON o.b = y.a""")
def mixing_expected(spark, d):
    return I.mixing(edges(spark, d), segment_labels(spark, d)).withColumns({c: r6(c) for c in ("share", "by_size", "by_ends")})


@query(f"""WITH {ties_sql(60)}, n AS (SELECT p.person, p.body, c_mktsegment AS label FROM p JOIN customer ON c_custkey = person WHERE p.body IN (SELECT body FROM p GROUP BY body HAVING count(*) BETWEEN 2 AND 60)),
  e AS (SELECT x.person AS src, y.person AS dst, x.label AS a, y.label AS b, count(*) AS k, min(x.body) AS body FROM n x JOIN n y ON x.body = y.body AND x.person < y.person GROUP BY 1, 2, 3, 4),
  en AS (SELECT k, body, a AS x, b AS y FROM e UNION ALL SELECT k, body, b, a FROM e),
  bodies AS (SELECT DISTINCT body FROM en WHERE k = 1),
  c AS (SELECT bodies.body, x, count(*) AS n, sum(CAST(x = y AS INT)) AS s FROM bodies JOIN en ON NOT (k = 1 AND en.body = bodies.body) GROUP BY 1, 2),
  t AS (SELECT body, sum(n)::DOUBLE AS m, sum(s)::DOUBLE AS s, sum(n * n)::DOUBLE AS sq FROM c GROUP BY body),
  w AS (SELECT sum(n)::DOUBLE AS m, sum(s)::DOUBLE AS s, sum(n * n)::DOUBLE AS sq FROM (SELECT x, count(*) AS n, sum(CAST(x = y AS INT)) AS s FROM en GROUP BY x)),
  r AS (SELECT t.body, (t.s / t.m - t.sq / (t.m * t.m)) / (1 - t.sq / (t.m * t.m)) AS r, (w.s / w.m - w.sq / (w.m * w.m)) / (1 - w.sq / (w.m * w.m)) AS r0 FROM t, w WHERE t.m >= 20)
  SELECT body, round(r, 6) AS r, round(r - r0, 6) AS swing FROM r""")
def leave_one_body_out(spark, d):
    return I.leave_one_out(ties(spark, d), segment_labels(spark, d), least=10).withColumns({"r": r6("r"), "swing": r6("swing")})


@query()
def label_permutation(spark, d):
    found = I.label_permutation(edges(spark, d), segment_labels(spark, d), draws=2000)
    return found.withColumns({c: r6(c) for c in ("observed", "mean", "sd", "p", "same", "same_mean")})


@query()
def label_permutation_stratified(spark, d):
    """Labels move within quartiles of degree only (ST10, ST13)."""
    e = edges(spark, d)
    strata = P.index_cut_quartiles(G.degrees(e).withColumn("all", F.lit(1)), "degree", ["all"]).select("node", "stratum")
    return I.label_permutation(e, segment_labels(spark, d), draws=2000, strata=strata).withColumns({c: r6(c) for c in ("observed", "mean", "sd", "p", "same", "same_mean")})


@query(f"""WITH {ENDS}, m AS (SELECT count(*)::DOUBLE AS m, sum(CAST(a = b AS INT)) AS same FROM en), q AS (SELECT sum(n * n)::DOUBLE AS sq FROM (SELECT a, count(*) AS n FROM en GROUP BY a)) SELECT round((same / m - sq / (m * m)) / (1 - sq / (m * m)), 6) AS observed FROM m, q""")
def label_permutation_observed(spark, d):
    return I.label_permutation(edges(spark, d), segment_labels(spark, d), draws=5).select(r6("observed").alias("observed"))


@query()
def mean_diff_permutation(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment IN ('BUILDING', 'MACHINERY')")
    return I.mean_difference_permutation(c, "c_acctbal", "c_mktsegment", draws=20_000)


@query("""SELECT round(avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING') - avg(c_acctbal) FILTER (c_mktsegment = 'MACHINERY'), 6) AS observed FROM customer""")
def mean_diff_observed(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment IN ('BUILDING', 'MACHINERY')")
    return I.mean_difference_permutation(c, "c_acctbal", "c_mktsegment", draws=2).select(r6("observed").alias("observed"))


@query(f"""WITH {ENDS} SELECT count(DISTINCT node) AS n_nodes, CASE WHEN count(DISTINCT node) >= 40 THEN 'tested' ELSE 'too few' END AS stage FROM en""")
def stage_guard(spark, d):
    """Whether a stage has the forty labelled nodes that a test needs (ST19)."""
    found = edges(spark, d)
    tested = I.label_permutation(found, segment_labels(spark, d), draws=3, least=40).select(F.when(F.col("p").isNull(), "too few").otherwise("tested").alias("stage"))
    return I.labelled_ends(found, segment_labels(spark, d)).agg(F.countDistinct("node").alias("n_nodes")).crossJoin(F.broadcast(tested))


@query(f"""WITH {ties_sql()}, n AS (SELECT p.person, p.body, c_mktsegment AS label FROM p JOIN customer ON c_custkey = person), k AS (SELECT body, label, count(*)::DOUBLE AS k FROM n GROUP BY 1, 2), b AS (SELECT sum(k * (k - 1) / 2) AS same, sum(k) * (sum(k) - 1) / 2 AS pairs FROM k GROUP BY body)
  SELECT round(1 - sum(same) / sum(pairs), 6) AS observed FROM b""")
def body_mixing_observed(spark, d):
    """The share of mixed pairs that the draws are held against (ST5)."""
    return I.body_mixing_permutation(ties(spark, d), segment_labels(spark, d), draws=2).select(r6("observed").alias("observed"))


@query()
def body_mixing_permutation(spark, d):
    return I.body_mixing_permutation(ties(spark, d), segment_labels(spark, d), draws=2000).withColumns({c: r6(c) for c in ("observed", "mean", "p")})


FISHER = """WITH t AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic = 1) AS a, count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c, count(*) FILTER (quality = 0 AND toxic = 0) AS d FROM labels l JOIN documents x ON l.doc_id = x.doc_id GROUP BY lang),
  x AS (SELECT t.*, unnest(range(greatest(0, a + c - (c + d)), least(a + b, a + c) + 1)) AS k FROM t),
  p AS (SELECT *, exp(lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) + lgamma(c + d + 1) - lgamma(a + c - k + 1) - lgamma(c + d - (a + c - k) + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1)) AS pk FROM x)
  SELECT lang, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(d) AS d, round(least(1.0, sum(pk) FILTER (pk <= s * (1 + 1e-9))), 6) AS p FROM (SELECT p.*, max(CASE WHEN k = a THEN pk END) OVER (PARTITION BY lang) AS s FROM p) GROUP BY lang"""


@query(FISHER)
def fisher_2x2(spark, d):
    """Quality against toxicity in each language."""
    joined = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    cell = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    cells = joined.groupBy("lang").agg(cell(1, 1).alias("a"), cell(1, 0).alias("b"), cell(0, 1).alias("c"), cell(0, 0).alias("d"))
    return I.fisher(cells, "lang").withColumn("p", r6("p"))


@query("""WITH x AS (SELECT l_extendedprice AS y, l_quantity AS x FROM lineitem), s AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, avg(x) AS mx FROM x), e AS (SELECT *, sqrt((syy - b * b * sxx) / (n - 2)) AS sd FROM s)
  SELECT 'l_quantity' AS term, round(b, 4) AS estimate, round(sd / sqrt(sxx), 4) AS std_error FROM e UNION ALL SELECT '(intercept)', round(a, 4), round(sd * sqrt(1.0 / n + mx * mx / sxx), 4) FROM e""")
def ols_simple(spark, d):
    found = I.least_squares(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return I.report_table(spark, [(t, b, s) for t, b, s, _ in found], ["term", "estimate", "std_error"]).withColumns({"estimate": F.round("estimate", 4), "std_error": F.round("std_error", 4)})


OLS_CONTROLS = """WITH lines AS (SELECT l_orderkey, sum(l_quantity) AS q, count(*) AS k FROM lineitem GROUP BY 1), j AS (SELECT o_totalprice::DOUBLE AS y, CAST(o_orderstatus = 'O' AS INT)::DOUBLE AS a, q::DOUBLE AS q, k::DOUBLE AS k FROM orders JOIN lines ON o_orderkey = l_orderkey),
  o AS (SELECT y, a, (q - avg(q) OVER ()) / stddev_pop(q) OVER () AS b, (k - avg(k) OVER ()) / stddev_pop(k) OVER () AS c FROM j),
  s AS (SELECT count(*)::DOUBLE AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, n * var_pop(a) AS aa, n * covar_pop(a, b) AS ab, n * covar_pop(a, c) AS ac, n * var_pop(b) AS bb, n * covar_pop(b, c) AS bc, n * var_pop(c) AS cc,
    n * covar_pop(y, a) AS ya, n * covar_pop(y, b) AS yb, n * covar_pop(y, c) AS yc, n * var_pop(y) AS yy FROM o),
  i AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM s),
  v AS (SELECT *, (bb * cc - bc * bc) / det AS iaa, (ac * bc - ab * cc) / det AS iab, (ab * bc - ac * bb) / det AS iac, (aa * cc - ac * ac) / det AS ibb, (ab * ac - aa * bc) / det AS ibc, (aa * bb - ab * ab) / det AS icc FROM i),
  e AS (SELECT *, iaa * ya + iab * yb + iac * yc AS e1, iab * ya + ibb * yb + ibc * yc AS e2, iac * ya + ibc * yb + icc * yc AS e3 FROM v),
  f AS (SELECT *, sqrt((yy - e1 * ya - e2 * yb - e3 * yc) / (n - 4)) AS sd, my - e1 * ma - e2 * mb - e3 * mc AS e0, 1 / n + ma * (ma * iaa + mb * iab + mc * iac) + mb * (ma * iab + mb * ibb + mc * ibc) + mc * (ma * iac + mb * ibc + mc * icc) AS i00 FROM e),
  t AS (SELECT '(intercept)' AS term, e0 AS b, sd * sqrt(i00) AS se FROM f UNION ALL SELECT 'open', e1, sd * sqrt(iaa) FROM f UNION ALL SELECT 'z_quantity', e2, sd * sqrt(ibb) FROM f UNION ALL SELECT 'z_lines', e3, sd * sqrt(icc) FROM f)
  SELECT term, round(b, 2) AS estimate, round(se, 2) AS std_error, round(b / se, 3) AS t FROM t"""


@query(OLS_CONTROLS)
def ols_controls(spark, d):
    """Order totals on a group and two z-scored controls."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n_lines"))
    o = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("open", (F.col("o_orderstatus") == "O").cast("double"))
    o = P.z_scores(o, {"z_quantity": "quantity", "z_lines": "n_lines"})
    return I.report_table(spark, I.least_squares(o, "o_totalprice", ["open", "z_quantity", "z_lines"]), ["term", "estimate", "std_error", "t"]).withColumns({"estimate": F.round("estimate", 2), "std_error": F.round("std_error", 2), "t": F.round("t", 3)})


@query(ORACLES["leave_one_body_out"].replace("SELECT body, round(r, 6) AS r, round(r - r0, 6) AS swing FROM r", "SELECT body, round(r - r0, 6) AS swing FROM r ORDER BY abs(round(r - r0, 6)) DESC, body LIMIT 6"))
def leave_one_out_top(spark, d):
    """The six bodies without which assortativity moves most (SRT8)."""
    found = I.leave_one_out(ties(spark, d), segment_labels(spark, d), least=10).select("body", r6("swing").alias("swing"))
    return found.orderBy(F.desc(F.abs("swing")), "body").limit(6)
