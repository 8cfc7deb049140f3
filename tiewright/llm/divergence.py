"""How the sources of each language differ in their words: counts and pair sums by shards of terms, in DuckDB inside tasks.

Rows of (lang, source, term) are counted where the texts are read and dealt out by a hash of lang and term. Each shard counts
its terms in SQL and keeps those of enough documents; Spark adds up the shards' totals, from which come the shares p and q.
A second pass over the shards gives, in SQL again, partial sums over the terms that two sources share and the first terms of
every group; Spark merges sums and ranks.

A source that lacks a term has the share of a count of 0, which is the same for all terms it lacks. So the sum over all kept
terms is that of two such shares for every term, corrected by what a source's own terms change (from the number of terms at
each share) and by what the shared terms change (from the shards). All arithmetic is on integers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiewright.llm.bpe import whole_text
from tiewright.sources.tables import materialize

#: Runs of letters and of whatever is not ASCII; texts are matched as UTF-8 after A-Z were lower-cased.
TERM = re.compile(rb"[a-z\x80-\xff]+")
MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Entries that a task counts before it sends them on.
HELD = 400_000
#: DuckDB's memory in a task; a shard that needs more ends the task, and more shuffle partitions make shards smaller.
SHARD_MEMORY = "700MB"
COUNTED = "lang string, source string, term string, n long, docs long"
KEPT = "lang string, source string, term string, n long, lang_n long, lead int"
MERGED = "part string, lang string, source string, item string, value decimal(38,0)"

COUNT_SHARD = f"""
WITH counted AS (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs) AS docs FROM shard GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::BIGINT AS lang_n, min(source) AS lead FROM counted GROUP BY ALL HAVING sum(docs) >= {MIN_DOCS})
SELECT lang, source, term, n, lang_n, (source = lead)::INT AS lead FROM counted JOIN kept USING (lang, term)
"""
SUM_SHARD = f"""
WITH held AS MATERIALIZED (FROM shard),
ranked AS (
  SELECT lang, source, term, (p - q) * (p - q) // q AS value FROM held WHERE p > q
  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {TOP})
SELECT 'pair' AS part, a.lang, a.source, b.source AS item, sum(
    (a.p - b.p) * (a.p - b.p) // b.p - (a.p - b.p0) * (a.p - b.p0) // b.p0
    - (a.p0 - b.p) * (a.p0 - b.p) // b.p + (a.p0 - b.p0) * (a.p0 - b.p0) // b.p0)::DECIMAL(38, 0) AS value
FROM held a JOIN held b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
UNION ALL
SELECT 'term', lang, source, term, value::DECIMAL(38, 0) FROM ranked
"""


def term_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (lang, source, text): for each term of a group its occurrences and documents, added up over many documents."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def sent():
        for (lang, source), (n, docs) in found.items():
            terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
            size = len(n)
            columns = [pa.repeat(pa.scalar(lang, pa.string()), size), pa.repeat(pa.scalar(source, pa.string()), size), terms, pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        found.clear()

    for batch in batches:
        texts = batch.column(2).cast(pa.large_binary())
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
            if (group := found.get((lang, source))) is None:
                group = found[lang, source] = (Counter(), Counter())
            before = len(group[0])
            terms = TERM.findall(text.as_py().lower())
            group[0].update(terms)
            group[1].update(set(terms))
            held += len(group[0]) - before
            if held >= HELD:
                yield from sent()
                held = 0
    yield from sent()


def in_shard(sql: str, schema: pa.Schema):
    """A function of a task's batches: the rows of ``sql`` over all of them, as the view ``shard``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": SHARD_MEMORY, "temp_directory": "", "preserve_insertion_order": False})
        con.register("shard", pa.RecordBatchReader.from_batches(schema, batches))
        yield from con.sql(sql).to_arrow_reader(50_000)
        con.close()

    return run


def arrow_schema(*fields: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([pa.field(name, kind) for name, kind in fields])


def share(count: str, total: str) -> Column:
    """1 + floor(SCALE * (count + 1) / total), exact; null if the total is 0."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({count} + 1 as decimal(20,0))) div cast(nullif({total}, 0) as decimal(20,0))")


def gap(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def divergences(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) of ``docs``, as the module's queries say.

    Nulls in any of the three columns count as empty strings; a group whose texts have no terms still has a row against each
    other source of its language, and one without others has none. Repeated rows are documents of their own. Equal values
    are ranked by the item's UTF-8 bytes. An empty table gives no rows, and other columns are not read.
    """
    rows = docs.select(whole_text(F.col(lang)).alias("lang"), whole_text(F.col(source)).alias("source"), whole_text(F.col(text)).alias("text"))
    strings = [(c, pa.string()) for c in ("lang", "source", "term")]
    counted = arrow_schema(*strings, ("n", pa.int64()), ("docs", pa.int64()))
    kept = rows.mapInArrow(term_counts, COUNTED).repartition("lang", "term").mapInArrow(in_shard(COUNT_SHARD, counted), KEPT)
    kept = materialize(kept, "terms")

    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    langs = kept.groupBy("lang").agg(F.sum("lead").alias("v"), F.sum("n").alias("n_lang"))
    groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = materialize(groups.na.fill(0).withColumn("p0", share("0", "n_group + v")), "groups")

    known = kept.join(groups, ["lang", "source"]).withColumns({"p": share("n", "n_group + v"), "q": share("lang_n", "n_lang + v")})
    held = arrow_schema(*strings, *((c, pa.int64()) for c in ("p", "q", "p0")))
    merged = known.select("lang", "source", "term", "p", "q", "p0").repartition("lang", "term").mapInArrow(in_shard(SUM_SHARD, held), MERGED)
    merged = materialize(merged, "sums")

    ends = [groups.select("lang", F.col("source").alias(end), F.col("p0").alias(f"{end}_p0"), *more) for end, more in (("a", ["v"]), ("b", []))]
    pairs = ends[0].join(ends[1], "lang").where("a <> b")
    absent = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), F.expr(f"coalesce(v * cast({gap('a_p0', 'b_p0')} as decimal(38,0)), 0)").alias("value"))
    levels = known.groupBy("lang", F.col("source").alias("a"), F.col("p0").alias("a_p0"), "p").agg(F.count("*").alias("terms"))
    ahead = levels.join(ends[1], "lang").where("a <> b")
    one_sided = ahead.select(
        "lang",
        F.inline(
            F.expr(
                f"array(struct(a as source, b as item, cast(terms * cast({gap('p', 'b_p0')} - {gap('a_p0', 'b_p0')} as decimal(20,0)) as decimal(38,0)) as value),"
                f" struct(b as source, a as item, cast(terms * cast({gap('b_p0', 'p')} - {gap('b_p0', 'a_p0')} as decimal(20,0)) as decimal(38,0)) as value))"
            )
        ),
    )
    shared = merged.where("part = 'pair'").select("lang", "source", "item", "value")
    sums = absent.unionByName(one_sided).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.withColumn("part", F.lit("pair")).unionByName(merged.where("part = 'term'"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = both.withColumn("rank", F.row_number().over(order)).where(f"part = 'pair' or rank <= {TOP}")
    return ranked.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergences(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= {MIN_DOCS}),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
grps AS (SELECT DISTINCT lang, source FROM docs),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS n_lang FROM kept GROUP BY ALL),
sizes AS (SELECT lang, source, sum(n) AS n_group FROM counts GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    (1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.n_group, 0) + l.v))::BIGINT AS p,
    (1 + ({SCALE}::HUGEINT * (k.lang_n + 1)) // (l.n_lang + l.v))::BIGINT AS q
  FROM grps g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN sizes s USING (lang, source) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM parts)
SELECT lang, source, part, item, value::BIGINT AS value, place::INT AS rank FROM ranked WHERE part = 'pair' OR place <= {TOP}
"""
