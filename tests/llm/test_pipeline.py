"""The pipeline's rows against a plain version of every stage."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.test_text_operators import plain_containments
from tiewright.llm import secrets as S
from tiewright.llm import simhash as H
from tiewright.llm import toxicity as X
from tiewright.llm.bpe import default_tokenizer

SF = "/root/testdata/sf0.001"


def plain_shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    k = min(width, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def checked_groups(spark, rows):
    """The kept ids of the near-dedup stage, held against all pairs: no row goes without a partner, nine of ten pairs are found."""
    frame = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")
    group = {r.doc_id: r.component_id for r in H.near_groups(frame, H.WIDE, 5, similarity=0.8).collect()}
    sets = {r.doc_id: plain_shingles(r.text) for r in rows}
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if alike(sets[a], sets[b]) >= 0.8]
    partner = {x for pair in pairs if group[pair[0]] == group[pair[1]] for x in pair}
    assert all(c == d or d in partner for d, c in group.items())
    assert sum(group[a] == group[b] for a, b in pairs) >= 0.9 * len(pairs) and pairs
    return {d for d, c in group.items() if c == d}


def test_stages_have_the_asked_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "bpe"]
    assert P.ORACLE_SQL is None


def test_run_against_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    grammar = X.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in docs.collect() if grammar.score(r.text) < X.CUT]
    kept = checked_groups(spark, rows)
    rows = [r for r in rows if r.doc_id in kept]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {x[0] for x in plain_containments([(r.doc_id, r.text) for r in rows], items)}
    rows = [r for r in rows if r.doc_id not in leaked]
    library, want = Tokenizer.from_file(default_tokenizer("byte_bpe_50k.json")), {}
    for r in rows:
        spans = S.describe(S.find(r.text))[4]
        want[r.doc_id] = (r.lang, r.source, library.encode(S.redact(r.text, spans), add_special_tokens=False).ids)
    got = {r.doc_id: (r.lang, r.source, r.ids) for r in P.run(spark, SF).collect()}
    assert got == want
    assert 100 < len(got) < docs.count() and leaked


def test_every_stage_keeps_columns_and_survives_edge_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0), (-2, None, None, "s", None), (-3, "x " * 60_000, "en", "s", 120_000), (-3, "x " * 60_000, "en", "s", 120_000)], docs.schema)
    both = docs.unionByName(odd)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, both, SF)
        assert out.columns == docs.columns and out.schema == docs.schema, name
        assert out.count() > 0
        assert stage(spark, both.limit(0), SF).count() == 0
    assert P.bpe(spark, both, SF).count() == both.count()


def test_keep_one_of_each_group(spark):
    near = " ".join(["alpha beta gamma", *(f"w{i * i % 997}" for i in range(900))])
    rows = [(4, near, "a"), (2, near, "b"), (2, near, "b"), (9, near + " omega", "c"), (7, "something else entirely here", "d"), (7, "another text under the same key", "e"), (None, "no key at all", "f"), (None, "no key at all", "g")]
    kept = H.keep_one(spark.createDataFrame(rows, "doc_id long, text string, mark string"))
    got = sorted((r.doc_id or 0, r.text[:9]) for r in kept.collect())
    assert got == [(0, "no key at"), (2, "alpha bet"), (7, "another t"), (7, "something")]
    assert kept.columns == ["doc_id", "text", "mark"]


def test_links_are_verified_by_shingles(spark):
    """Pairs planted at similarities of 0.6 to 0.95: none under 0.8 is linked, and nine in ten of those above."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, planted = [], []
    for i in range(300):
        words = [word() for _ in range(rng.randrange(120, 500))]
        other, target = list(words), rng.choice([0.6, 0.7, 0.76, 0.79, 0.81, 0.85, 0.95])
        own = plain_shingles(" ".join(words))
        while alike(own, plain_shingles(" ".join(other))) > target + 0.02:
            other[rng.randrange(len(other))] = word()
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        planted.append((alike(own, plain_shingles(" ".join(other))), 2 * i, 2 * i + 1))
    got = {r.doc_id: r.component_id for r in H.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), H.WIDE, 5, similarity=0.8).collect()}
    assert not any(got[b] == a for s, a, b in planted if s < 0.8) and any(0.75 < s < 0.8 for s, _, _ in planted)
    near = [got[b] == a for s, a, b in planted if s >= 0.8]
    assert len(near) > 80 and sum(near) >= 0.9 * len(near)


def test_results_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [{(r.doc_id, r.component_id) for r in H.near_groups(d).collect()} for d in (docs, docs.repartition(13).orderBy(F.rand(3)))]
    assert found[0] == found[1]
    digest = lambda d: hashlib.sha256(repr(sorted((r.doc_id, r.spans) for r in S.scan(d).collect())).encode()).hexdigest()
    assert digest(docs) == digest(docs.repartition(7))
    assert np.isfinite([r.toxicity for r in X.scored(docs, X.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))).select("toxicity").collect()]).all()
