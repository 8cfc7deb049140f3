"""Queries over long sequences: the lines of all documents as one, and each document's lines as a printed volume."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiewright.functions import text as T
from tiewright.operators import scan as P
from tiewright.operators import segment as G
from tiewright.operators import sequence as S
from tiewright.plans.windows import KEY_SQL, LINES, lines

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {LINES}, k AS (SELECT doc_id, i, line, length(line) AS size, {KEY_SQL} AS key, length(line) >= 120 AS anchor, length(line) >= 20 AND {KEY_SQL} <> '' AS plausible FROM l),
  s AS (SELECT *, CAST(row_number() OVER w = 1 OR (regexp_matches(lag(line) OVER w, '[.!]$') AND regexp_matches(line, '^[A-Z]')) AS INT) AS starts, lag(substr(line, 1, 1)) OVER w IS DISTINCT FROM substr(line, 1, 1) AS changed,
    sum(CAST(size % 97 = 0 AS INT)) OVER (w ROWS UNBOUNDED PRECEDING) AS section, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS running FROM k WINDOW w AS (ORDER BY doc_id, i)),
  a AS (SELECT *, sum(starts) OVER (ORDER BY doc_id, i ROWS UNBOUNDED PRECEDING) AS paragraph,
    coalesce(first_value(CASE WHEN anchor THEN substr(key, 1, 4) END IGNORE NULLS) OVER (PARTITION BY section ORDER BY doc_id, i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '￿') AS ahead FROM s),
  f AS (SELECT *, anchor OR (plausible AND substr(key, 1, 4) <= ahead) AS fits FROM a),
  m AS (SELECT *, max(CASE WHEN fits THEN substr(key, 1, 6) END) OVER (PARTITION BY section ORDER BY doc_id, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM f)
  SELECT doc_id, CAST(i AS INT) AS i, CAST(paragraph AS BIGINT) AS paragraph, CAST(section AS BIGINT) AS section, changed, CAST(running AS BIGINT) AS running, round(running::DOUBLE / sum(size) OVER (), 6) AS share, ahead,
    CASE WHEN anchor THEN 'anchor' WHEN NOT plausible THEN 'implausible' WHEN fits AND coalesce(last, '') <= substr(key, 1, 6) THEN 'window' ELSE 'outside' END AS reason FROM m""")
def one_sequence(spark, d):
    """All lines of all documents as one sequence: paragraphs, sections, changes, shares, anchors, accepted lines (WIN2 to WIN5, WIN13, WIN16)."""
    key = F.upper(F.substring(F.regexp_replace("line", "[^A-Za-z]", ""), 1, 8))
    size = F.char_length("line")
    rows = lines(spark, d).select(
        "doc_id", "i", size.alias("size"), key.alias("key"), F.substring("line", 1, 1).alias("initial"), F.col("line").rlike(r"[.!]\z").alias("ends"), F.col("line").rlike("^[A-Z]").alias("capital"),
        (size >= 120).alias("anchor"), ((size >= 20) & (key != "")).alias("plausible"), (size % 97 == 0).cast("int").alias("boundary"),
    )
    ranged = P.in_ranges(rows, ["doc_id", "i"])
    before = P.scanned(ranged, ended=P.Scan("last", F.col("ends")), previous=P.Scan("last", F.col("initial")), section=P.Scan("sum", F.col("boundary"), True), running=P.Scan("sum", F.col("size"), True))
    starts = (F.col("ended").isNull() | (F.col("ended") & F.col("capital"))).cast("int")
    numbered = P.scanned(before.withColumn("starts", starts), paragraph=P.Scan("sum", F.col("starts"), True), ahead=P.Scan("next", F.when(F.col("anchor"), F.substring("key", 1, 4)), by=("section",)))
    accepted = P.window_over_ranges(numbered, "key", "anchor", "plausible", ("section",))
    total = rows.agg(F.sum("size").alias("total"))
    return accepted.join(F.broadcast(total)).select(
        "doc_id", "i", "paragraph", "section", (~F.col("previous").eqNullSafe(F.col("initial"))).alias("changed"), "running", F.round(F.col("running") / F.col("total"), 6).alias("share"),
        F.coalesce("ahead", F.lit("￿")).alias("ahead"), "reason",
    )


LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
QUOTED = ", ".join(f"'{w}'" for w in T.RUBRICS)
OPENERS = ", ".join(f"'{w}'" for w in T.CONTINUATION)
#: The lines as a volume might have them: headings at fixed places, every third length with a word in capitals in front.
PRINTED = f"""p AS (SELECT doc_id, i, CASE WHEN i % 9 = 8 THEN 'SUPPLEMENT.' WHEN length(line) % 3 = 0 THEN translate(regexp_extract(line, '^[^ ]*', 0), '{LOWER}', '{UPPER}') || ',' || regexp_replace(line, '^[^ ]*', '') ELSE line END AS line FROM l)"""
HEAD = r"(SELECT trim(substr(t, 1, 1) || regexp_extract(regexp_replace(regexp_replace(substr(t, 2), '\s*\(', ';', 'g'), '\.(\s|$)', ';', 'g'), '^[^,;:]*', 0), ' .,:;-—') FROM (SELECT text AS t))"
SORT_KEY = r"trim(regexp_replace(regexp_replace(upper(strip_accents(replace({}, 'ß', 'ss'))), '[^A-Z ]+', '', 'g'), '\s+', ' ', 'g'))"
CAPS = rf"""(CASE WHEN length(regexp_replace(strip_accents(head), '[^\p{{L}}]', '', 'g')) > 0 THEN length(regexp_replace(strip_accents(head), '[^\p{{Lu}}]', '', 'g'))::DOUBLE / length(regexp_replace(strip_accents(head), '[^\p{{L}}]', '', 'g')) ELSE 0 END > 0.85
  AND length(word) >= 3 AND word NOT IN ({QUOTED}) AND NOT regexp_matches(word, '^[IVXLCDM]+$'))"""


@query(rf"""WITH RECURSIVE {LINES}, {PRINTED},
  b AS (SELECT doc_id, i, line, sum(CASE WHEN row_number = 1 OR (ended AND regexp_matches(line, '^[A-Z]')) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS par
    FROM (SELECT *, row_number() OVER w AS row_number, regexp_matches(lag(line) OVER w, '[.!]$') AS ended FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i))),
  t AS (SELECT doc_id, par, trim(regexp_replace(string_agg(line, ' ' ORDER BY i), '\s+', ' ', 'g')) AS text FROM b GROUP BY ALL),
  h AS (SELECT doc_id, par, text, {HEAD} AS head FROM t),
  c AS (SELECT *, {SORT_KEY.format('head')} AS key, string_split({SORT_KEY.format("replace(head, '-', ' ')")}, ' ')[1] AS word, regexp_matches(upper(strip_accents(head)), '^(SUPPLEMENT|SUPPLEMENTS|ADDENDA|ADDITIONS|APPENDICE|ANNEXE)\b') AND length(regexp_replace(upper(strip_accents(text)), '[^A-Z]', '', 'g')) <= 24 AS heading FROM h),
  s AS (SELECT *, substr(replace(key, ' ', ''), 1, 6) AS k6, sum(heading::INT) OVER (PARTITION BY doc_id ORDER BY par) AS seq FROM c),
  x AS (SELECT doc_id, seq, par, k6, row_number() OVER (PARTITION BY doc_id, seq ORDER BY par) AS n FROM s WHERE NOT heading AND {CAPS}),
  r AS (SELECT doc_id, seq, par, n, [k6] AS tails, 1::BIGINT AS size FROM x WHERE n = 1 UNION ALL
    SELECT x.doc_id, x.seq, x.par, x.n, list_concat(list_append(tails[1:len(list_filter(tails, lambda y: y <= k6))], k6), tails[len(list_filter(tails, lambda y: y <= k6)) + 2:]), len(list_filter(tails, lambda y: y <= k6)) + 1 FROM r JOIN x ON x.doc_id = r.doc_id AND x.seq = r.seq AND x.n = r.n + 1),
  g AS (SELECT doc_id, seq, max(n) AS n, size FROM r WHERE (doc_id, seq, size) IN (SELECT doc_id, seq, max(size) FROM r GROUP BY ALL) GROUP BY ALL UNION ALL
    SELECT g.doc_id, g.seq, (SELECT max(r.n) FROM r WHERE r.doc_id = g.doc_id AND r.seq = g.seq AND r.size = g.size - 1 AND r.n < g.n), g.size - 1 FROM g WHERE g.size > 1),
  a AS (SELECT s.*, x.par IS NOT NULL AND g.n IS NOT NULL AS anchor,
    length(head) BETWEEN 1 AND 90 AND length(regexp_replace(head, '[^\p{{L}}]', '', 'g')) >= 2 AND regexp_matches(head, '^\p{{Lu}}') AND regexp_split_to_array(lower(strip_accents(head)), '[\s''’]')[1] NOT IN ({OPENERS}) AND string_split(key, ' ')[1] NOT IN ({QUOTED}) AS plausible
    FROM s LEFT JOIN x ON x.doc_id = s.doc_id AND x.seq = s.seq AND x.par = s.par AND NOT heading LEFT JOIN g ON g.doc_id = x.doc_id AND g.seq = x.seq AND g.n = x.n),
  w AS (SELECT *, anchor OR (plausible AND substr(k6, 1, 4) <= coalesce(first_value(CASE WHEN anchor THEN substr(k6, 1, 4) END IGNORE NULLS) OVER (PARTITION BY doc_id, seq ORDER BY par ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '￿')) AS fits FROM a WHERE NOT heading),
  v AS (SELECT *, CASE WHEN anchor THEN 'anchor' WHEN NOT plausible THEN 'implausible' WHEN fits AND coalesce(max(CASE WHEN fits THEN k6 END) OVER (PARTITION BY doc_id, seq ORDER BY par ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') <= k6 THEN 'window' ELSE 'outside' END AS reason FROM w),
  u AS (SELECT doc_id, par, text, head, reason, reason IN ('anchor', 'window') AS accepted FROM v UNION ALL SELECT doc_id, par, text, head, 'sequence_heading', false FROM a WHERE heading),
  e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY par) = 1 AS first FROM u),
  n AS (SELECT *, sum((accepted OR first)::INT) OVER (PARTITION BY doc_id ORDER BY par) AS entry FROM e)
  SELECT doc_id, CAST(entry AS BIGINT) AS entry, arg_min(head, par) AS head, arg_min(CASE WHEN first AND NOT accepted THEN 'first_paragraph' ELSE reason END, par) AS reason, count(*) AS n_paragraphs, length(trim(string_agg(text, ' ' ORDER BY par))) AS n_chars FROM n GROUP BY doc_id, entry""")
def segmented_entries(spark, d):
    """Entries cut out of documents printed as volumes, with headings that restart their order (WIN2, WIN4 to WIN6, FN22 to FN26)."""
    word = F.translate(F.regexp_extract("line", "^[^ ]*", 0), LOWER, UPPER)
    printed = F.when(F.col("i") % 9 == 8, "SUPPLEMENT.").when(F.char_length("line") % 3 == 0, F.concat(word, F.lit(","), F.regexp_replace("line", "^[^ ]*", ""))).otherwise(F.col("line"))
    rows = lines(spark, d).select("doc_id", "i", printed.alias("text"))
    starts = F.lag("text").over(S.frame(["doc_id"], ["i"])).rlike(r"[.!]\z") & F.col("text").rlike("^[A-Z]")
    paras = G.paragraphs(rows.withColumn("starts", starts), "starts", ["doc_id"], "i")
    return G.entries(paras, ["doc_id"]).select("doc_id", "entry", "head", "reason", "n_paragraphs", F.char_length("text").cast("long").alias("n_chars"))
