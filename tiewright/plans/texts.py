"""Queries for text rules, table functions and evidence voting on the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiewright.functions import names as N
from tiewright.functions import text as T
from tiewright.operators import label as L
from tiewright.sources.files import view_number
from tiewright.sources.tables import spread, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)licen[cs]e') THEN 'notice' WHEN regexp_matches(substr(text, 1, 200), '[|]') THEN 'table' WHEN n_chars < 140 THEN 'stub' WHEN regexp_matches(text, '^[A-Z][a-z]+ ') AND n_chars >= 4000 THEN 'article' ELSE 'note' END AS type,
  CASE WHEN regexp_matches(text, '(?i)licen[cs]e') THEN 'licence_word' WHEN regexp_matches(substr(text, 1, 200), '[|]') THEN 'bars_in_opening' WHEN n_chars < 140 THEN 'short' WHEN regexp_matches(text, '^[A-Z][a-z]+ ') AND n_chars >= 4000 THEN 'capital_and_long' ELSE 'residual' END AS rule FROM documents""")
def rule_cascade(spark, d):
    """Documents typed by ordered rules, with the rule that decided (S12)."""
    text, n = F.col("text"), F.col("n_chars")
    rules = [
        (text.rlike("(?i)licen[cs]e"), "notice", "licence_word"),
        (F.substring(text, 1, 200).rlike("[|]"), "table", "bars_in_opening"),
        (n < 140, "stub", "short"),
        (text.rlike("^[A-Z][a-z]+ ") & (n >= 4000), "article", "capital_and_long"),
    ]
    return table(spark, d, "documents").select("doc_id", T.cascade(rules, ("note", "residual")).alias("x")).select("doc_id", "x.type", "x.rule")


LABELS = [("german", r"(^|[^\p{L}])(der|die|und|nicht)([^\p{L}]|$)"), ("english", r"(^|[^\p{L}])(the|and|with)([^\p{L}]|$)"), ("french", r"(^|[^\p{L}])(le|les|dans|pour)([^\p{L}]|$)"), ("spanish", r"(^|[^\p{L}])(el|los|para|una)([^\p{L}]|$)"), ("secret", "(?i)token|password"), ("address", "[a-z0-9.]+@[a-z]+[.]")]


@query(r"""SELECT doc_id, concat_ws(';', CASE WHEN regexp_matches(text, '(^|[^\p{L}])(der|die|und|nicht)([^\p{L}]|$)') THEN 'german' END, CASE WHEN regexp_matches(text, '(^|[^\p{L}])(the|and|with)([^\p{L}]|$)') THEN 'english' END, CASE WHEN regexp_matches(text, '(^|[^\p{L}])(le|les|dans|pour)([^\p{L}]|$)') THEN 'french' END,
  CASE WHEN regexp_matches(text, '(^|[^\p{L}])(el|los|para|una)([^\p{L}]|$)') THEN 'spanish' END, CASE WHEN regexp_matches(text, '(?i)token|password') THEN 'secret' END, CASE WHEN regexp_matches(text, '[a-z0-9.]+@[a-z]+[.]') THEN 'address' END) AS labels FROM documents""")
def multi_label(spark, d):
    """All labels of documents in fixed order, the first being the primary one (S13)."""
    return table(spark, d, "documents").select("doc_id", F.array_join(T.labels(F.col("text"), LABELS), ";").alias("labels"))


@query(r"""SELECT item_id, trim(regexp_replace(regexp_replace(upper(strip_accents(replace(text, 'ß', 'ss'))), '[^A-Z ]+', '', 'g'), '\s+', ' ', 'g')) AS sort_key, substr(regexp_replace(regexp_replace(upper(strip_accents(replace(text, 'ß', 'ss'))), '[^A-Z ]+', '', 'g'), ' ', '', 'g'), 1, 6) AS cmp_key FROM benchmark""")
def sort_keys(spark, d):
    """Filing keys of passages (FN1, FN4, FN5)."""
    key = T.sort_key(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", key.alias("sort_key"), T.cmp_key(key).alias("cmp_key"))


@query(r"""SELECT DISTINCT w AS word, trim(regexp_replace(regexp_replace(upper(strip_accents(replace(w, 'ß', 'ss'))), '[^A-Z ]+', ' ', 'g'), '\s+', ' ', 'g')) AS name_key, trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(w)), '^(l''|la |le |les |de |du |des )+', ''), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g')) AS norm_key FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark)""")
def normalised_keys(spark, d):
    """Comparison keys of words (FN2, FN6, FN7)."""
    words = table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return words.select("word", T.name_key(F.col("word"), ("FILS",)).alias("name_key"), T.org_key(F.col("word")).alias("norm_key"))


@query(r"""WITH x AS (SELECT event_id, CAST(1500 + event_id % 500 AS VARCHAR) AS y FROM events), r AS (SELECT event_id, y, CASE event_id % 4 WHEN 0 THEN replace(y, '8', 'S') WHEN 1 THEN '1.' || substr(y, 2) WHEN 2 THEN replace(y, '0', 'O') ELSE replace(y, '6', '(i') END AS raw FROM x)
  SELECT event_id, raw, CASE WHEN NOT contains(raw, '(') AND CAST(y AS INT) BETWEEN 1600 AND 1915 THEN CAST(y AS INT) END AS year FROM r""")
def year_repair(spark, d):
    """Years damaged in known ways and mended, or refused (FN27)."""
    y = (F.lit(1500) + F.col("event_id") % 500).cast("string")
    raw = F.when(F.col("event_id") % 4 == 0, F.replace(y, F.lit("8"), F.lit("S"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("1."), F.substring(y, 2, 9))).when(F.col("event_id") % 4 == 2, F.replace(y, F.lit("0"), F.lit("O"))).otherwise(F.replace(y, F.lit("6"), F.lit("(i")))
    return table(spark, d, "events").select("event_id", raw.alias("raw")).withColumn("year", T.clean_year(F.col("raw")))


@query(r"""SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, regexp_extract(url, '^https?://([^/]+)', 1) AS host, len(regexp_extract_all(html, '<a href=')) AS n_links FROM pages""")
def page_fields(spark, d):
    """Fields taken out of pages by patterns."""
    return table(spark, d, "pages").select(
        "page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"),
        F.size(F.regexp_extract_all("html", F.lit("<a href="), 0)).cast("long").alias("n_links"),
    )


@query(r"""WITH s AS (SELECT conv_id, turn, role, regexp_split_to_array(text, '[.]\s+') AS parts FROM conversations), e AS (SELECT conv_id, turn, unnest(range(len(parts))) AS position_order, unnest(parts) AS position FROM s)
  SELECT conv_id, turn, position_order, trim(position, ' .,') AS position FROM e WHERE length(trim(position, ' .,')) >= 6""")
def sentence_posts(spark, d):
    """Turns cut into sentences; the order counts those left out for being short (S16)."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"[.]\s+", ";;").alias("t"))
    cut = c.select("conv_id", "turn", F.posexplode(F.split("t", ";;")).alias("position_order", "position")).withColumn("position_order", F.col("position_order").cast("long"))
    return cut.withColumn("position", F.btrim("position", F.lit(" .,"))).where(F.char_length("position") >= 6)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query(r"""SELECT p_partkey, concat('https://example.org/f', p_partkey, '.item') AS url, CAST(p_partkey AS INT) AS view FROM part""")
def templated_url(spark, d):
    """Addresses made from a template, and the number taken out of them again (PRJ2, SRC7)."""
    url = F.format_string("https://example.org/f%d.item", F.col("p_partkey"))
    return table(spark, d, "part").select("p_partkey", url.alias("url")).withColumn("view", view_number(F.col("url")))


@query(r"""SELECT item_id, 'HEAD.' AS head, trim(substr(text, 1, length(text) // 2)) || ' last' AS studies, nullif(trim(substr(text, length(text) // 2 + 1)), '') AS aim FROM benchmark""")
def section_split(spark, d):
    """Labelled parts of a text, repeated ones joined (FN30)."""
    half = F.floor(F.char_length("text") / 2).cast("int")
    t = F.concat(F.lit("HEAD. ETUDES: "), F.substring(F.col("text"), F.lit(1), half), F.lit(" BUT : "), F.substring(F.col("text"), half + 1, F.char_length("text")), F.lit(" ETUDES : last"))
    rows = table(spark, d, "benchmark").select("item_id", t.alias("t"))
    rows = rows.withColumn("s", T.sections(F.col("t"), {"studies": r"ETUDES?\s*:", "aim": r"BUT\s*:"}))
    return rows.select("item_id", *[F.element_at("s", k).alias(k) for k in ("head", "studies", "aim")])


@query(r"""WITH e AS (SELECT user_id, event_type, CASE event_type WHEN 'purchase' THEN 'buyer' WHEN 'signup' THEN 'member' WHEN 'error' THEN 'member' ELSE 'reader' END AS label, CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END AS w FROM (SELECT DISTINCT user_id, event_type FROM events)),
  v AS (SELECT user_id, label, sum(w) AS total, max(w) AS strongest FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, label) AS r FROM v)
  SELECT c_custkey AS entity, coalesce(a.label, 'unknown') AS label, CASE WHEN a.total = b.total THEN 'low' WHEN a.strongest >= 3 THEN 'high' WHEN a.strongest = 2 THEN 'medium' WHEN a.strongest IS NOT NULL THEN 'low' END AS confidence,
    CASE WHEN a.total = b.total THEN a.label || ';' || b.label ELSE '' END AS competing FROM customer LEFT JOIN r a ON a.user_id = c_custkey AND a.r = 1 LEFT JOIN r b ON b.user_id = c_custkey AND b.r = 2""")
def evidence_labels(spark, d):
    """Labels by weighted evidence, silence staying unknown (AGG17, AGG18)."""
    kind = F.col("event_type")
    found = table(spark, d, "events").select(F.col("user_id").alias("entity"), kind.alias("token")).distinct()
    kind = F.col("token")
    found = found.withColumn("label", F.when(kind == "purchase", "buyer").when(kind.isin("signup", "error"), "member").otherwise("reader")).withColumn("weight", F.when(kind == "purchase", 3).when(kind == "signup", 2).otherwise(1))
    out = L.tally(table(spark, d, "customer").select(F.col("c_custkey").alias("entity")), found)
    return out.select("entity", "label", "confidence", F.array_join("competing", ";").alias("competing"))


@query(r"""WITH x AS (SELECT l.doc_id, CASE WHEN regexp_matches(text, '\b(idiot|moron|scum)\b') THEN 'toxic' ELSE 'clean' END AS rule, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS prior FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
  SELECT count(*) FILTER (rule = prior) AS n_agree, count(*) FILTER (rule <> prior) AS n_disagree, round(count(*) FILTER (rule = prior)::DOUBLE / count(*), 6) AS precision FROM x""")
def rule_agreement(spark, d):
    """A rule's label against an earlier one (AGG19)."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    rows = rows.select(F.when(F.col("text").rlike(r"\b(idiot|moron|scum)\b"), "toxic").otherwise("clean").alias("rule"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("prior"))
    return L.agreement(rows, "rule", "prior").withColumn("precision", F.round("precision", 6))


@query(r"""WITH x AS (SELECT conv_id, turn, substr(text, 1, 1) AS a, regexp_replace(regexp_replace(substr(text, 2), '\s*\(', ';', 'g'), '\.(\s|$)', ';', 'g') AS b FROM conversations)
  SELECT conv_id, turn, trim(CASE WHEN a = chr(10) THEN '' ELSE a || regexp_extract(b, '^[^,;:\n]*', 0) END, ' .,:;-—') AS head FROM x""")
def headwords(spark, d):
    """What stands before the first delimiter of a turn (FN22)."""
    return table(spark, d, "conversations").select("conv_id", "turn", T.split_headword(F.col("text")).alias("head"))


@query("""SELECT c_custkey, role, CASE role WHEN 'president' THEN 'Marcille' WHEN 'treasurer' THEN 'Vilatte L.-E' ELSE upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) END AS name FROM customer, (VALUES ('president'), ('vice_president'), ('treasurer')) r(role)""")
def officer_lists(spark, d):
    """Officers read out of made-up lists of customers' names (TF1)."""
    c = spread(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").select("c_custkey", F.concat(F.lit("Prés., M. Marcille; v.-prés., M. "), F.initcap("c_mktsegment"), F.lit("; Vilatte L.-E., trés.")).alias("text"))
    return N.officers(c, "text").select("c_custkey", "role", "name")
