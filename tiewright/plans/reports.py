"""Whole reports as one table each: what was read from the entries, and every measure of every node."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiewright.functions import records as R
from tiewright.operators import components as C
from tiewright.operators import graph as G
from tiewright.plans.network import ORACLES as NETWORK_SQL
from tiewright.plans.network import edges_sql, small_graph
from tiewright.plans.records import BASE, BODIES, PERSONS, PLACES, TYPES, entries, pick
from tiewright.sources.tables import materialize

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def stacked(df: DataFrame, section: str, measures: dict) -> DataFrame:
    """(section, measure, n, total): for each measure the rows for which its column holds, all in one pass."""
    sums = df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(name) for name, c in measures.items()])
    pairs = ", ".join(f"'{name}', `{name}`" for name in measures)
    return sums.selectExpr(f"'{section}' AS section", f"stack({len(measures)}, {pairs}) AS (measure, n)", "total")


#: The measures of each section, with the templates whose entries have them.
FOUND = {
    "person": {"birth_year": "1, 8, 20, 23", "birth_day": "1, 23", "city": "1, 8, 9, 13, 17, 20, 23", "address": "1", "honours": "1, 10, 20", "occupations": "1, 9, 17, 20, 23", "schools": "1", "works": "23"},
    "place": {"population": "0, 12", "distance_km": "0, 11", "caidat": "0, 18", "owners": "0", "archaeology": "0"},
    "organisation": {"founded_year": "2, 22", "n_members": "2, 22", "kinds": "2, 22", "seat": "2", "purpose": "2"},
}
KIND = {"person": PERSONS, "place": PLACES, "organisation": BODIES}
PARTS = " UNION ALL ".join(f"SELECT '{s}' AS section, '{m}' AS measure, count(*) FILTER (t IN ({ts})) AS n, count(*) AS total FROM e WHERE {KIND[s]}" for s, ms in FOUND.items() for m, ts in ms.items())


@query(f"""WITH {BASE}, x AS (SELECT 'type' AS section, {pick([x.split()[0] for x in TYPES], 't')} AS measure FROM e UNION ALL SELECT 'rule', {pick([x.split()[1] for x in TYPES], 't')} FROM e),
  r AS (SELECT section, measure, count(*) AS n, (SELECT count(*) FROM e) AS total FROM x GROUP BY ALL UNION ALL {PARTS}) SELECT section, measure, n, total, round(n::DOUBLE / total, 6) AS share FROM r""")
def validation_report(spark, d):
    """Entries by type and rule, and how many of each type have each field; entries are read and typed once."""
    typed = materialize(R.classify(entries(spark, d)), "typed")
    all_of = typed.agg(F.count("*").alias("total"))
    kinds = typed.select(F.explode(F.array(F.struct(F.lit("type").alias("section"), F.col("entry_type").alias("measure")), F.struct(F.lit("rule").alias("section"), F.col("rule").alias("measure")))).alias("x"))
    parts = [kinds.groupBy("x.section", "x.measure").agg(F.count("*").alias("n")).crossJoin(F.broadcast(all_of))]
    readers = {"person": R.person_fields, "place": R.place_fields, "organisation": R.organisation_fields}
    has = {"honours": F.col("n_honours") > 0, "occupations": F.size("occupations") > 0, "schools": F.size("schools") > 0, "works": F.col("has_works"), "kinds": F.size("kinds") > 0}
    for section, measures in FOUND.items():
        found = readers[section](typed.where(F.col("entry_type") == section))
        parts.append(stacked(found, section, {m: has.get(m, F.col(m).isNotNull()) for m in measures}))
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn("share", F.round(F.col("n") / F.col("total"), 6))


@query(f"""WITH RECURSIVE {edges_sql(10)}, bb AS ({NETWORK_SQL['betweenness']}), cc AS ({NETWORK_SQL['closeness']}), reach AS (SELECT DISTINCT node, node AS seen FROM s UNION SELECT reach.node, s.other FROM reach JOIN s ON reach.seen = s.node),
  z AS (SELECT node, count(*) AS component_size FROM reach GROUP BY node) SELECT deg.node, degree, closeness, betweenness, component_size FROM deg JOIN bb USING (node) JOIN cc USING (node) JOIN z USING (node)""")
def measures_export(spark, d):
    """Every node with its degree, closeness, betweenness and the size of its component."""
    edges = materialize(small_graph(spark, d), "edges")
    labels = materialize(C.components(edges), "labels")
    sizes = labels.join(labels.groupBy("component").agg(F.count("*").alias("component_size")), "component").select("node", "component_size")
    tables = [G.degrees(edges), G.closeness(edges), G.betweenness(edges), sizes]
    return reduce(lambda a, b: a.join(b, "node"), tables).withColumns({c: F.round(c, 6) for c in ("closeness", "betweenness")})
