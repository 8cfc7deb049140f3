import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tiewright.llm import bpe as B
from tiewright.llm import token_counts as C
from tiewright.llm import token_store as S

BYTE, WORD = B.default_tokenizer("byte_bpe_50k.json"), B.default_tokenizer("word_bpe_49k.json")
PIECES = [" ", " ", "  ", "\n", "\n\n", "\t", "a", "the", ".", "1", "'s", "É", "\xa0", "\x85", "　", "\x1c", "\r\n", "<|endoftext|>", "<|startoftext|>", "é", "Σ"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    some = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(15))) for _ in range(3000)]
    every = [f"a{chr(c)}b{chr(c)}{chr(c)} {chr(c)}x 1{chr(c)}2  {chr(c)}" for c in [*range(0x2000), *range(0x1F300, 0x1F400)]]
    return [*some, *every, "", "x" * 5000, "ab" * 3000 + " z", "é" * 300]


def test_ids_equal_the_library(texts):
    library = Tokenizer.from_file(BYTE)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    own = B.byte_level(BYTE)
    assert [own.encode(t).tolist() for t in texts] == want
    assert [np.frombuffer(x, "<u2").tolist() for x in S.library_encoder(BYTE).encode(texts)] == want
    assert [own.decode(np.array(i)) for i in want] == [library.decode(i, skip_special_tokens=False) for i in want]


def test_scan_and_heap_make_the_same_merges(texts):
    merges = B.Merges(BYTE)
    for t in texts[-2:] + texts[:200]:
        ids = [merges.first[b] for b in t.encode()]
        assert merges._scan(list(ids)) == merges._heap(list(ids))


def test_segments_do_not_change_ids(texts, monkeypatch):
    want = [B.byte_level(BYTE).encode_bytes(t) for t in texts[:2000]]
    monkeypatch.setattr(B, "SEGMENT_CHARS", 3)
    monkeypatch.setattr(S, "SEGMENT_CHARS", 3)
    assert [B.byte_level(BYTE).encode_bytes(t) for t in texts[:2000]] == want
    assert S.LibraryEncoder(BYTE).encode(texts[:2000]) == want


def test_counts_equal_the_library(texts):
    library = Tokenizer.from_file(WORD)
    counter = C.word_counter(WORD)
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert counter.count(t) == len(e.ids)


def test_chunks_are_spliced_and_overlaps_widened(texts):
    counter, rng = C.word_counter(WORD), random.Random(4)
    for _ in range(200):
        t = "".join(rng.choice(["word ", "x" * rng.randrange(90), " ", "\n", "é", "<|endoftext|>"]) for _ in range(60))
        for chunk, overlap in ((10, 1), (64, 8), (100, 200)):
            assert counter.count(t, chunk, overlap) == counter.count_plain(t)


def edge_table(spark):
    rows = [(3, "b c", "x"), (1, None, "y"), (2, "", None), (3, "b c", "x"), (None, "z", "n"), (4, "long word " * 40_000, "l")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("n_tokens", F.lit("clash"))


def test_digests_and_counts_on_edge_cases(spark):
    library = Tokenizer.from_file(BYTE)
    docs = edge_table(spark)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.bpe_digests(docs, BYTE).collect()}
    want = set()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == want
    assert B.bpe_digests(docs.limit(0), BYTE).count() == C.token_counts(docs.limit(0), WORD).count() == 0
    counted = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in C.token_counts(docs, WORD).collect()}
    assert counted == {(3, 3, 2, False), (1, 0, 0, False), (2, 0, 0, False), (None, 1, 1, False), (4, 400_000, 80_000, True)}


def test_encode_and_decode_keep_other_columns(spark):
    docs = edge_table(spark)
    coded = B.bpe_encode(docs, BYTE)
    assert coded.columns == ["doc_id", "n_tokens", "ids"]
    back = B.bpe_decode(coded, BYTE).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((r.doc_id or 0, r.text or "") for r in docs.collect())


@pytest.mark.parametrize("offsets", [[0], [0, 0], [0, 5, 5, 9], list(range(0, 100_000, 37)), [0, 1 << 33], [0, *np.cumsum(np.random.default_rng(0).integers(0, 900, 3000)).tolist()]])
def test_elias_fano(offsets):
    made = S.EliasFano.encode(offsets)
    again = S.EliasFano(len(offsets), offsets[-1], made.low, made.high, made.samples)
    assert again.all().tolist() == offsets
    assert [again.select(i) for i in range(len(offsets))] == offsets
    if len(offsets) > 100:
        assert len(made.low) + len(made.high) + len(made.samples) < 8 * len(offsets) / 2


def plain_store(rows):
    library, start, out = Tokenizer.from_file(BYTE), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_store_on_edge_cases(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT_DOCS", 2)
    docs = edge_table(spark)
    S.write_store(docs, BYTE, f"file://{tmp_path}/store")
    got = [tuple(r) for r in S.read_store(spark, f"file://{tmp_path}/store").orderBy("start").collect()]
    assert got == plain_store([(r.doc_id, r.text) for r in docs.collect()])
    row = spark.read.parquet(f"file://{tmp_path}/store").where("array_contains(doc_ids, 4)").first()
    at = list(row.doc_ids).index(4)
    assert len(S.document_ids(row, at)) == next(n for k, _, n, _ in got if k == 4)
    S.write_store(docs.limit(0), BYTE, f"file://{tmp_path}/none")
    assert S.read_store(spark, f"file://{tmp_path}/none").count() == 0


def test_generations_of_units(monkeypatch):
    """Units that pass from one generation to the next, and are forgotten, keep their ids."""
    monkeypatch.setattr(S.LibraryEncoder, "MOST", 7)
    coder, library = S.LibraryEncoder(BYTE), Tokenizer.from_file(BYTE)
    texts = [" ".join(f"w{(i * j) % 23}" for j in range(1, 9)) + "\nend" for i in range(40)]
    for some in (texts[:3], texts[3:20], texts[20:], texts):
        assert [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode(some)] == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_queries_on_whole_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(map(tuple, S.op8_token_store(spark, d).collect())) == plain_store(docs)
    library, words = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    want = {}
    for k, t in docs:
        ids = library.encode(t, add_special_tokens=False).ids
        want[k] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.op3_bpe_roundtrip(spark, d).collect()} == want
    n = {k: len(words.encode(t, add_special_tokens=False).ids) for k, t in docs}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in C.op5_token_counts(spark, d).collect()} == {k: (len(t.encode()), n[k], n[k] > 2048) for k, t in docs}
