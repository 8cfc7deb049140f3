"""Entries out of paragraphs in filing order, on volumes written by hand."""

import duckdb
from pyspark.sql import functions as F

from tiewright.operators import segment as G
from tiewright.plans import volumes, windows

VOLUME = [
    "Préface du volume, sans ordre.", "ABADIE (Jean), avocat.", "Agriculture. La vigne.", "il naquit à Tunis.", "AUBERT, rentier.", "Zaghouan, montagne.", "BERTIN, notaire.", "ETUDES : lycée.", "XIV, siècle.", "CARON, maçon.", "Zone franche.",
    "SUPPLÉMENT.", "ABEILLE, apiculteur.", "Suite de la notice.", "Acacia. Arbre.", "ADAM, juge.",
]


def cut(spark, rows):
    paras = spark.createDataFrame(rows, "v string, paragraph int, text string")
    return [(r.v, r.entry, r.head, r.reason, r.n_paragraphs, r.text) for r in G.entries(paras, ["v"]).orderBy("v", "entry").collect()]


def test_entries_of_a_volume(spark):
    got = cut(spark, [("a", i, t) for i, t in enumerate(VOLUME)])
    assert [(e[2], e[3], e[4]) for e in got] == [
        ("Préface du volume", "first_paragraph", 1), ("ABADIE", "anchor", 1), ("Agriculture", "window", 2), ("AUBERT", "anchor", 2), ("BERTIN", "anchor", 3), ("CARON", "anchor", 1),
        ("Zone franche", "window", 2), ("ABEILLE", "anchor", 2), ("Acacia", "window", 1), ("ADAM", "anchor", 1),
    ]
    assert got[2][5] == "Agriculture. La vigne. il naquit à Tunis." and got[4][5].endswith("ETUDES : lycée. XIV, siècle.") and got[6][5] == "Zone franche. SUPPLÉMENT."


def test_reasons_of_what_joins_the_entry_above(spark):
    paras = spark.createDataFrame([("a", i, t) for i, t in enumerate(VOLUME)], "v string, paragraph int, text string")
    got = {r.head: (r.reason, r.sequence) for r in G.judged(paras, ["v"]).collect()}
    assert got["Zaghouan"] == ("outside", 0) and got["il naquit à Tunis"][0] == "implausible" and got["ETUDES"][0] == "implausible"
    assert got["SUPPLÉMENT"] == ("sequence_heading", None) and got["ABEILLE"] == ("anchor", 1)


def test_volumes_do_not_touch_and_empty_ones_have_no_entries(spark):
    assert cut(spark, []) == []
    got = cut(spark, [("a", 1, "ZOLA, x."), ("b", 1, "ABEL, y."), ("b", 2, ""), ("b", 3, None)])
    assert [e[:5] for e in got] == [("a", 1, "ZOLA", "anchor", 1), ("b", 1, "ABEL", "anchor", 3)]


def test_the_longest_run_is_the_scaffold(spark):
    got = cut(spark, [("a", i, f"{w}, x.") for i, w in enumerate(["MARTIN", "ABEL", "ZOLA", "BLANC", "CARON", "DURAND"])])
    assert [e[2] for e in got if e[3] == "anchor"] == ["ABEL", "BLANC", "CARON", "DURAND"]
    assert [e[2] for e in got] == ["MARTIN", "ABEL", "BLANC", "CARON", "DURAND"]


def test_headings_count_letters_as_the_sql_does(spark, tmp_path):
    """A sharp s is no letter of A to Z, so 24 letters and two of them still make a heading; with three letters more it is none."""
    texts = ["\n".join([f"Zeile {i}." for i in range(8)] + ["x", f"{t}ßß das weiter gute.", "Abend."]) for t in ("a", "aaaa")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT doc_id, entry, head, reason, n_paragraphs, n_chars FROM ({volumes.ORACLES['segmented_entries']})").fetchall()
    got = [tuple(r) for r in volumes.QUERIES["segmented_entries"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    paras = spark.createDataFrame([(i, 0, f"SUPPLEMENT. {t}ßß das weiter gute") for i, t in enumerate(("a", "aaaa"))], "v int, paragraph int, text string")
    assert {r.v: r.reason for r in G.judged(paras, ["v"]).collect()} == {0: "sequence_heading", 1: "anchor"}


def test_carriage_returns_and_other_separators_as_in_the_sql(spark, tmp_path):
    """Only a line feed ends a line: a period before a carriage return does not, and a line separator may stand in a headword."""
    texts = ["Eins ist hier.\r\nZwei ist da.\r\nDrei\n", "Abend\u2028 und Morgen, so.\nMittag \x85heute, ja.\nZeit.\u2028\nNacht.", "\u2028Rand, so."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for plans, name in ((volumes, "segmented_entries"), (windows, "gaps_islands")):
        got = plans.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({plans.ORACLES[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_lines_become_paragraphs(spark):
    lines = spark.createDataFrame([("a", 1, "Un  mot", None), ("a", 2, "deux.", False), ("a", 3, None, False), ("a", 4, "Trois", True)], "v string, i int, text string, starts boolean")
    got = sorted(map(tuple, G.paragraphs(lines, "starts", ["v"], "i").collect()))
    assert got == [("a", 1, "Un mot deux."), ("a", 2, "Trois")]


def test_query_meets_every_reason(spark):
    got = volumes.QUERIES["segmented_entries"](spark, "/root/testdata/sf0.001").groupBy("reason").agg(F.count("*"), F.max("n_paragraphs")).collect()
    assert {r.reason for r in got} == {"anchor", "window", "first_paragraph"} and max(r[2] for r in got) > 2
