import random

import duckdb
import pyarrow as pa
import pytest

from tests.oracle import connect, differences, rows_of
from tiewright.llm import divergence as V

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "lead"]


def against_sql(spark, rows):
    """Operator and SQL over the same rows, with clashing extra columns beside them."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, lead int"
    got = V.divergences(spark.createDataFrame([(*r, 0, 7) for r in rows], schema))
    con = duckdb.connect()
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string()]
    table = pa.table({c: pa.array([r[i] for r in rows], kinds[i]) for i, c in enumerate(COLUMNS[:4])})
    con.register("documents", table)
    result = con.execute(V.SQL)
    return rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of([c[0] for c in result.description], result.fetchall())


def test_small_table_as_sql(spark):
    assert differences(spark, SF, V.op12_source_divergence, V.SQL) is None


def test_nulls_empties_repeats_and_ties(spark):
    rng = random.Random(3)
    words = "a Ab aB ÄÖ äö x1y straße İ ß z' q".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30))), rng.choice(["en", "de", "", None]), rng.choice(["s0", "s1", "é", "", None])) for i in range(80)]
    rows += [(90, None, "en", "s9"), (91, "", "xx", "only"), (92, "alone alone", "xx", None), (5, "a Ab", "en", "s0"), (5, "a Ab", "en", "s0"), (None, "a" * 50_000, "en", "s1")]
    got, want = against_sql(spark, rows)
    assert got == want and any("xx" in r for r in got)


def test_groups_without_kept_terms_have_pairs_of_0(spark):
    got = V.divergences(spark.createDataFrame([("a b", "en", "s"), ("c", "en", "t")], "text string, lang string, source string")).collect()
    assert sorted(map(tuple, got)) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_empty_table(spark):
    got = V.divergences(spark.createDataFrame([], "text string, lang string, source string"))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and got.count() == 0


def test_terms_beyond_what_a_task_holds_and_ranks_to_200(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(f"{chr(97 + w // 26)}{chr(97 + w % 26)}" for w in (int(rng.random() ** 2 * 600) for _ in range(400))), "en", f"s{i % 3}") for i in range(60)]
    got, want = against_sql(spark, rows)
    assert got == want and max(int(dict(zip(sorted(["lang", "source", "part", "item", "value", "rank"]), r))["rank"]) for r in got) == V.TOP


@pytest.mark.parametrize("held", [1, 50])
def test_counts_sent_in_portions_add_up(monkeypatch, held):
    monkeypatch.setattr(V, "HELD", held)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 3, "source": ["s"] * 3, "text": ["b a A", "a c", ""]})
    found = {}
    for out in V.term_counts([batch]):
        for r in out.to_pylist():
            n, docs = found.get(r["term"], (0, 0))
            found[r["term"]] = (n + r["n"], docs + r["docs"])
    assert found == {"a": (3, 2), "b": (1, 1), "c": (1, 1)}


def test_oracle_is_over_the_given_table():
    assert connect(SF).execute(f"SELECT count(*) FROM ({V.SQL})").fetchone()[0] > 0
