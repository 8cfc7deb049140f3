import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from tiewright.llm import personal as P

SF = "/root/testdata/sf0.001"
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * 2 if i % 2 else int(d)
        total += n // 10 + n % 10
    return total % 10 == 0


def plain_base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and plain_luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def model_of(texts):
    return P.SkipChain.empty().fit(*P.examples(texts))


@pytest.fixture(scope="module")
def model(spark):
    return P.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_rules_against_plain_patterns():
    rng = random.Random(4)
    pieces = ["+1 (319) 555-5132", "4799134681044206", "4799-1346 8104-4206", "1.2.3.4", "255.256.1.1", "0001.2.3.004.5", "a.b@c.d.e", "x@y", "@@", "a@b.c@d.e", "ß", "\n", "+", "-", " ", ".", "(", "7", "12345", "é@à.b", "q%+_@-.-", "1" * 30, "😀"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(9)))
        assert P.base_spans(text) == plain_base(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 100_000, "+1 " * 100_000, "a@" * 100_000, "(at)" * 50_000):
        begun = time.perf_counter()
        P.found([text], P.SkipChain.empty())
        assert time.perf_counter() - begun < 20


def graph_of(n, chain, skip, rng):
    graph = P.Field(n=n, chain=chain, skip=skip)
    for i in range(n):
        for c in rng.sample(range(len(P.NAMES)), 4):
            graph.rows.append(i)
            graph.columns.append(c)
    return graph


@pytest.mark.parametrize("chain, skip, cycles", [([(0, 1), (1, 2), (2, 3)], [], False), ([(0, 1), (2, 3)], [(1, 2)], False), ([], [(0, 1), (0, 2), (0, 3)], False), ([(0, 1), (1, 2)], [(0, 2)], True)])
def test_messages_against_all_labellings(chain, skip, cycles):
    rng, numbers = random.Random(1), np.random.default_rng(1)
    scale = 0.4 if cycles else 1.5
    model = P.SkipChain(numbers.normal(0, scale, (len(P.NAMES), P.LABELS)), numbers.normal(0, scale, (P.LABELS, P.LABELS)), numbers.normal(0, scale, P.LABELS))
    n = 1 + max(itertools.chain(*chain, *skip))
    graph = graph_of(n, chain, skip, rng)
    observed = np.array([-1] * (n - 1) + [2])
    own, total = model.alone(graph), np.zeros((n, P.LABELS))
    for labels in itertools.product(range(P.LABELS), repeat=n):
        if labels[-1] == 2:
            score = sum(own[i, y] for i, y in enumerate(labels)) + sum(model.chain[labels[a], labels[b]] for a, b in chain) + sum(model.skip[labels[a]] for a, b in skip if labels[a] == labels[b])
            for i, y in enumerate(labels):
                total[i, y] += np.exp(score)
    assert np.allclose(model.marginals(graph, observed), total / total.sum(1, keepdims=True), atol=0.05 if cycles else 1e-9)


def kinds_of(text, model):
    (base, added), = P.found([text], model)
    return [(P.KINDS[k], text[a:b]) for a, k, b in base], [(P.NEAR[k], text[a:b]) for a, k, b in added]


def test_other_mentions_get_the_label_of_the_first(model):
    assert kinds_of("call +1 (319) 555-5132 today or 319-555-5132 later", model) == ([("phone", "+1 (319) 555-5132")], [("near_phone", "319-555-5132")])
    assert kinds_of("mail john.doe@x.example.com or john.doe (at) x.example.com, john.doe himself", model)[1] == [("near_email", "john.doe (at) x.example.com"), ("near_email", "john.doe")]
    assert kinds_of("card 4799134681044206 again 4799.1346.8104.4206 but 4799134681044207", model)[1] == [("near_card", "4799.1346.8104.4206")]
    assert kinds_of("host 55.63.178.142 alias 55-63-178-142", model)[1] == [("near_ip", "55-63-178-142")]


def test_skip_edges_carry_what_a_token_alone_does_not_say(model):
    alone = P.SkipChain(model.features, model.chain, np.zeros(P.LABELS))
    text = "from +44 20 7946 0958 to 020794609580 and 442079460958"
    assert kinds_of("442079460958", model) == ([], [])
    assert ("near_phone", "442079460958") in kinds_of(text, model)[1] and ("near_phone", "442079460958") not in kinds_of(text, alone)[1]


def test_neighbours_that_spoil_each_other_for_the_rules(model):
    assert kinds_of("go +1 (269) 555-3296 4524132264652876 end", model) == ([], [("near_phone", "+1 (269) 555-3296"), ("near_card", "4524132264652876")])


def test_clean_numbers_stay(model):
    for text in ("in 2024-05-17 version 1.2.3 of 12 parts, 3,000 units", "order 31955551 of 1999", "fig.12 no.345 1.5 2:30", "a 4799134681044207 b"):
        assert kinds_of(text, model) == ([], [])


def test_results_do_not_depend_on_the_batch(model):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["+1 (319) 555-5132", "319-555-5132", "x", "4524132264652876", "a.b@c.de", "a.b", "12 34"]) for _ in range(12)) for _ in range(40)]
    together = P.found(texts, model)
    assert together == [P.found([t], model)[0] for t in texts]


def test_query_against_plain_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = P.op11_personal_data(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts) and any(r.n_email for r in got)
    for r in got:
        base = plain_base(texts[r.doc_id])
        shown = [f"{P.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in base) for i in range(4))
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(shown) <= set(spans) and spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), (P.KINDS + P.NEAR).index(s.split(":")[0])))


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    schema = "doc_id string, text string, body int, hash int, spans int"
    rows = [("a", None, 1, 1, 1), ("a", "", 1, 1, 1), (None, "mail a.b@c.de", 1, 1, 1), (None, "mail a.b@c.de", 1, 1, 1), ("z", "é 😀 1.2.3.4", 1, 1, 1)]
    got = sorted(map(tuple, P.personal_data(spark.createDataFrame(rows, schema)).select("doc_id", "n_email", "n_ip", "spans").collect()), key=str)
    assert got == [("a", 0, 0, ""), ("a", 0, 0, ""), ("z", 0, 1, "ip:4:11"), (None, 1, 0, "email:5:13"), (None, 1, 0, "email:5:13")]
    assert P.personal_data(spark.createDataFrame([], schema)).count() == 0


def test_fit_needs_no_examples():
    assert (P.SkipChain.empty().fit(*P.examples([])).features == 0).all()
    assert model_of(["no numbers here"]).features.shape == (len(P.NAMES), P.LABELS)
