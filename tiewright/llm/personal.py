"""Personal data: exact rules for four kinds, and a skip-chain conditional random field that adds what the rules miss.

The rules give the base spans. The field's variables are the tokens that have a digit or an at sign (or repeat the name before
one); all other words are outside by definition. Neighbouring tokens form chains. Tokens further apart that repeat each other,
or are alike (the same seven last digits, the same name before an at sign), are joined by skip edges, each occurrence to the one
before it. Chains and skip edges share their potentials over all documents. Tokens in base spans are observed; messages along
both sorts of edges carry their labels to other mentions in the document, whose way of writing no rule covers.

Weights are learned by pseudo-likelihood from a bounded sample of texts, labelled by the rules and extended by other writings of
their own spans and by numbers that are none.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiewright.llm.bpe import whole_text

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the spans that the field adds, in the order of KINDS; in lists of spans they come after them.
NEAR = tuple(f"near_{k}" for k in KINDS)
#: The label of words that are no personal data; the mark of those of which it is not known, which teach nothing.
OUTSIDE, LABELS, UNKNOWN = 0, 1 + len(KINDS), -1

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

SEED = re.compile(r"[0-9@]|[\[({]at[\])}]")
REST = re.compile(r"[A-Za-z0-9._%+@()\[\]{}-]*+")
TOKEN = LOCAL | frozenset("@()[]{}")
DOTTED = re.compile(r"(?<![A-Za-z])[A-Za-z]++(?:[._%+-][A-Za-z]++)+")
BRACKETED = re.compile(r"[\[({]at[\])}]")
GROUPS = re.compile(r"[0-9]+")
#: Between neighbours of a chain.
GAP = frozenset(" -().\t")

#: Texts to learn from (those of the smallest hashes), and code points of each that are kept for it.
MAX_TRAIN, TRAIN_CHARS = 2048, 2000
#: Rounds of messages, all edges at once; steps of the fit.
ROUNDS, STEPS = 25, 250
#: Tokens whose messages a task computes together.
TOGETHER = 50_000


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(GROUPS.findall(text))


def octets(parts: list[str]) -> bool:
    return len(parts) == 4 and all(p.isdigit() and (len(p) <= 3 or not p[:-3].strip("0")) and int(p[-3:]) <= 255 for p in parts)


def email_spans(text: str) -> list[tuple[int, int, int]]:
    """Leftmost matches of a name, an at sign and a dotted domain, looked for around each at sign."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            done = domain.end()
            out.append((start, 0, done))
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the rules' matches, by start, then kind; code points, ends exclusive."""
    spans = email_spans(text)
    spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if octets(m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(number := digits_of(m.group())) <= 19 and luhn(number):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return sorted(spans)


def tokens(text: str) -> list[tuple[int, int]]:
    """Start and end of the field's variables, in order."""
    found, done, seed = [], 0, SEED.search(text)
    while seed:
        start = seed.start()
        while start > done and text[start - 1] in TOKEN:
            start -= 1
        done = REST.match(text, seed.start()).end()
        whole = text[start:done]
        left, right = len(whole) - len(whole.lstrip("._%-)]}")), len(whole.rstrip("._%+-([{"))
        if left < right:
            found.append((start + left, start + right))
        seed = SEED.search(text, done)
    if any(text[a] in "[({" and BRACKETED.match(text, a) or text[b - 1] in "])}" for a, b in found):
        found = with_ends(text, found)
    names = {name_of(text[a:b]) for a, b in found} - {""}
    if names:
        known = {a for a, _ in found}
        more = [(m.start(), m.end()) for m in DOTTED.finditer(text) if m.group().lower() in names and m.start() not in known]
        ends = sorted(found)
        found = sorted(ends + [s for s in more if not covered(s, ends)]) if more else found
    return found


def with_ends(text: str, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The tokens and, beside each that begins or ends with a bracketed at, the word before or after it."""
    out: list[tuple[int, int]] = []
    for i, (a, b) in enumerate(found):
        if BRACKETED.match(text, a):
            end = a - (text[a - 1 : a] == " ")
            start, least = end, out[-1][1] if out else 0
            while start > least and text[start - 1] in LOCAL:
                start -= 1
            if start < end:
                out.append((start, end))
        if not out or out[-1][1] <= a:
            out.append((a, b))
        if BRACKETED.fullmatch(text, max(a, b - 4), b):
            start = b + (text[b : b + 1] == " ")
            end = REST.match(text, start).end()
            end = start + len(text[start:end].rstrip("._%+-([{"))
            if start < end and (i + 1 == len(found) or end <= found[i + 1][0]):
                out.append((start, end))
    return out


def covered(span: tuple[int, int], ordered: list[tuple[int, int]]) -> bool:
    """Whether a span meets one of the spans in order that do not meet each other."""
    at = bisect.bisect_right(ordered, span)
    return any(0 <= i < len(ordered) and ordered[i][0] < span[1] and span[0] < ordered[i][1] for i in (at - 1, at))


def name_of(token: str) -> str:
    """What stands before an at sign, in lower case; empty without one."""
    name, at, _ = BRACKETED.sub("@", token, count=1).partition("@")
    return name.lower() if at else ""


def bucket(n: int) -> int:
    """Of a number of digits: 0 for none, then 1-2, 3, 4, 5-6, 7-8, 9-11, 12-15, 16-19, more."""
    return sum(n > most for most in (0, 2, 3, 4, 6, 8, 11, 15, 19))


NAMES = (
    "bias", *(f"digits{i}" for i in range(10)), *(f"run{i}" for i in range(10)), "at", "at_domain", "bracketed", "letters", "only_digits", "luhn", "run_luhn", "plus", "run_plus", "paren", "hyphen", "hyphens",
    "dot", "dots", "octets", "octets_otherwise", "long", "three_three_four", "fours", "name_seen", "underscore",
)
FEATURE = {name: i for i, name in enumerate(NAMES)}


@dataclass
class Field:
    """The variables and edges of some texts; features are pairs of (variable, feature)."""

    n: int = 0
    rows: list[int] = field(default_factory=list)
    columns: list[int] = field(default_factory=list)
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)

    def add(self, text: str, spans: list[tuple[int, int]]) -> None:
        """The variables of a text, with its edges."""
        words = [text[a:b] for a, b in spans]
        names = {name_of(w) for w in words} - {""}
        joined = [0 < spans[i][0] - spans[i - 1][1] <= 2 and GAP.issuperset(text[spans[i - 1][1] : spans[i][0]]) if i else False for i in range(len(spans))]
        numeric = [not any(c.isalpha() or c == "@" for c in w) for w in words]
        runs: list[list[int]] = []
        for i in range(len(words)):
            if i and joined[i] and numeric[i] and numeric[i - 1]:
                runs[-1].append(i)
            else:
                runs.append([i])
        last: dict[str, int] = {}
        for run in runs:
            number, first = "".join(digits_of(words[i]) for i in run), words[run[0]]
            so_far = ""
            for i in run:
                own = digits_of(words[i])
                so_far = (so_far + own)[-7:]
                for name in self._features(words[i], own, number, first, names):
                    self.rows.append(self.n + i)
                    self.columns.append(FEATURE[name])
                keys = [f"#{so_far}"] if len(so_far) == 7 and numeric[i] else []
                if (name := name_of(words[i]) or words[i].lower()) in names:
                    keys.append(f"@{name}")
                for key in keys:
                    if key in last and not (last[key] == i - 1 and joined[i]):
                        self.skip.append((self.n + last[key], self.n + i))
                    last[key] = i
        self.chain += [(self.n + i - 1, self.n + i) for i in range(len(words)) if joined[i]]
        self.n += len(words)

    @staticmethod
    def _features(word: str, own: str, number: str, first: str, names: set[str]) -> Iterable[str]:
        yield "bias"
        yield f"digits{bucket(len(own))}"
        yield f"run{bucket(len(number))}"
        groups = [len(g) for g in GROUPS.findall(word)]
        name, at, domain = word.partition("@")
        tests = (
            ("at", at), ("at_domain", at and name and DOMAIN.fullmatch(domain)), ("bracketed", BRACKETED.search(word)), ("letters", any(c.isalpha() for c in word)), ("only_digits", word.isdigit()),
            ("luhn", 12 <= len(own) <= 19 and luhn(own)), ("run_luhn", 12 <= len(number) <= 19 and luhn(number)), ("plus", word[0] == "+"), ("run_plus", first[0] == "+"), ("paren", word[0] == "("),
            ("hyphen", word.count("-") == 1), ("hyphens", word.count("-") > 1), ("dot", word.count(".") == 1), ("dots", word.count(".") > 1), ("octets", octets(word.split("."))),
            ("octets_otherwise", octets(word.replace("_", "-").split("-"))), ("long", len(word) > 24), ("three_three_four", groups in ([3, 3, 4], [3, 4]) and not any(c.isalpha() for c in word)),
            ("fours", len(groups) > 2 and set(groups) == {4}), ("name_seen", not at and word.lower() in names), ("underscore", "_" in word),
        )
        yield from (test for test, holds in tests if holds)


@dataclass
class SkipChain:
    """Log potentials: of a feature with a label, of the labels of neighbours, of one label at both ends of a skip edge."""

    features: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    @classmethod
    def empty(cls) -> SkipChain:
        return cls(np.zeros((len(NAMES), LABELS)), np.zeros((LABELS, LABELS)), np.zeros(LABELS))

    def alone(self, graph: Field) -> np.ndarray:
        """Each variable's potentials from its own features."""
        out = np.zeros((graph.n, LABELS))
        np.add.at(out, np.array(graph.rows, int), self.features[np.array(graph.columns, int)])
        return out

    def marginals(self, graph: Field, observed: np.ndarray) -> np.ndarray:
        """Probabilities of labels after ROUNDS rounds of messages; ``observed`` has a label, or -1, for each variable.

        Exact on a graph without cycles whose paths are no longer than that. A text's result does not depend on others.
        """
        own = self.alone(graph)
        known = observed >= 0
        own[known] = -1e4
        own[known, observed[known]] = 0
        edges = [*graph.chain, *graph.skip]
        if edges:
            one, two = np.array(edges).T
            forward = np.concatenate([np.repeat(self.chain[None], len(graph.chain), 0), np.repeat(np.diag(self.skip)[None], len(graph.skip), 0)])
            source, target, back = np.r_[one, two], np.r_[two, one], np.r_[np.arange(len(one)) + len(one), np.arange(len(one))]
            potential = np.concatenate([forward, forward.transpose(0, 2, 1)])
            messages = np.zeros((len(source), LABELS))
            for _ in range(ROUNDS):
                belief = own.copy()
                np.add.at(belief, target, messages)
                sent = ((belief[source] - messages[back])[:, :, None] + potential)
                most = sent.max(1, keepdims=True)
                messages = (most + np.log(np.exp(sent - most).sum(1, keepdims=True)))[:, 0]
                messages -= messages.max(1, keepdims=True)
            np.add.at(own, target, messages)
        out = np.exp(own - own.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)

    def fit(self, graph: Field, labels: np.ndarray, weight: float = 0.02) -> SkipChain:
        """Raise the pseudo-likelihood: of every label given the variable's features and its neighbours' labels."""
        if not graph.n:
            return self
        x = np.zeros((graph.n, len(NAMES)))
        x[np.array(graph.rows), np.array(graph.columns)] = 1
        known = (labels != UNKNOWN)[:, None]
        truth = np.eye(LABELS)[labels] * known
        chain, skip = (np.array(e, int).reshape(-1, 2) for e in (graph.chain, graph.skip))
        before, after, beside = np.zeros((graph.n, LABELS)), np.zeros((graph.n, LABELS)), np.zeros((graph.n, LABELS))
        np.add.at(before, chain[:, 1], truth[chain[:, 0]])
        np.add.at(after, chain[:, 0], truth[chain[:, 1]])
        np.add.at(beside, skip[:, 0], truth[skip[:, 1]])
        np.add.at(beside, skip[:, 1], truth[skip[:, 0]])
        weights = [self.features, self.chain, self.skip]
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
        for step in range(1, STEPS + 1):
            score = x @ weights[0] + before @ weights[1] + after @ weights[1].T + beside * weights[2]
            guess = np.exp(score - score.max(1, keepdims=True))
            error = (truth - known * guess / guess.sum(1, keepdims=True)) / graph.n
            slopes = [x.T @ error, before.T @ error + error.T @ after, (beside * error).sum(0)]
            for i, slope in enumerate(slopes):
                slope = slope - weight / graph.n * weights[i]
                first, second = moments[i] = (0.9 * moments[i][0] + 0.1 * slope, 0.999 * moments[i][1] + 0.001 * slope**2)
                weights[i] = weights[i] + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        return SkipChain(*weights)


def observed_labels(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> np.ndarray:
    """For each token the label of the first base span that it meets, or -1."""
    out = np.full(len(spans), -1)
    at = 0
    for i, (a, b) in enumerate(spans):
        while at < len(base) and base[at][2] <= a:
            at += 1
        meets = [k for s, k, e in base[at : at + 4] if s < b and a < e]
        if meets:
            out[i] = 1 + meets[0]
    return out


def written_otherwise(kind: int, span: str, rng: random.Random) -> str:
    """The span as no rule would find it."""
    number = digits_of(span)
    if kind == 0:
        name, _, domain = span.partition("@")
        return rng.choice([f"{name}(at){domain}", f"{name}[at]{domain}", f"{name} (at) {domain}", name])
    if kind == 1:
        return rng.choice("-_").join(span.split("."))
    if kind == 2:
        return rng.choice("._").join(number[i : i + 4] for i in range(0, len(number), 4))
    a, b, c = number[-10:-7], number[-7:-4], number[-4:]
    return rng.choice([f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"{a}{b}{c}", f"00{number}", f"{b}-{c}"])


def none_of_them(rng: random.Random) -> str:
    """A number that is no personal data."""
    n = lambda size: "".join(rng.choice("0123456789") for _ in range(size))
    number = n(rng.choice([12, 13, 16, 19]))
    return rng.choice([n(1), n(2), n(4), n(5), n(6), n(7), n(8), n(9), n(10), n(11), f"20{n(2)}-0{rng.randrange(1, 10)}-1{n(1)}", f"{n(2)}.{n(2)}", f"v{n(1)}.{n(1)}.{n(2)}", f"{n(1)}.{n(1)}.{n(1)}", f"fig.{n(1)}", f"{rng.choice(['ab.cd', 'efg.hi', 'kl_mno'])}.{n(2)}", f"no.{n(3)}", f"{n(1)},{n(3)}", f"{n(4)}-{n(4)}", f"#{n(5)}", f"{n(3)}-{n(2)}-{n(3)}-{n(1)}", number if not luhn(number) else number[:-1] + str((int(number[-1]) + 5) % 10), f"{n(2)}:{n(2)}", f"{n(3)}x{n(3)}", f"a{n(2)}", hashlib.md5(n(4).encode()).hexdigest()])


def examples(texts: Iterable[str]) -> tuple[Field, np.ndarray]:
    """A field over the texts and their labels; each text is extended by other writings of its spans, pairs of them side by side, and other numbers."""
    graph, labels = Field(), []
    for text in texts:
        rng, size = random.Random(hashlib.sha256(text.encode()).digest()), len(text)
        base = base_spans(text)
        marked = [(a, 1 + k, b) for a, k, b in base]
        for a, k, b in base[:20]:
            if rng.random() < 0.7:
                text += " x "
                start, text = len(text), text + written_otherwise(k, text[a:b], rng)
                marked.append((start, 1 + k, len(text)))
        for (a, k, b), (c, n, d) in zip(base[:20], [*base[1:20], *base[:1]]):
            if rng.random() < 0.5:  # side by side, where the rules for numbers often drop both
                text += " x "
                for part, label in ((text[a:b], 1 + k), (text[c:d], 1 + n)):
                    marked.append((len(text), label, len(text) + len(part)))
                    text += f"{part} "
        for _ in range(rng.randrange(3)):
            text += f" x {none_of_them(rng)}"
        spans = tokens(text)
        graph.add(text, spans)
        for a, b in spans:
            label = next((k for s, k, e in marked if s < b and a < e), OUTSIDE)
            labels.append(UNKNOWN if label == OUTSIDE and a < size and crowded(text, a, b) else label)
    return graph, np.array(labels, int)


def crowded(text: str, start: int, end: int) -> bool:
    """Whether a number stands beside another, so that the rules may have dropped it for its neighbour."""
    before, after = text[max(0, start - 3) : start].rstrip(" -("), text[end : end + 3].lstrip(" -(+)")
    return text[start] in "0123456789+(" and (before[-1:].isdigit() or after[:1].isdigit())


def shortened(text: str) -> str:
    """The tokens of a text with a word between those that are no neighbours, up to TRAIN_CHARS."""
    out, end = "", 0
    for a, b in tokens(text):
        gap = text[end:a]
        out += (gap if out and len(gap) <= 2 and GAP.issuperset(gap) else " x ") + text[a:b]
        end = b
        if len(out) > TRAIN_CHARS:
            break
    return out


def train(docs: DataFrame, text: str = "text") -> SkipChain:
    """Fit on at most MAX_TRAIN texts with digits or at signs: those of the smallest hashes, equal texts once."""
    rows = docs.select(whole_text(text).alias("body")).where(F.col("body").rlike("[0-9@]")).select(F.xxhash64("body").alias("hash"), "body")
    last = rows.select("hash").distinct().orderBy("hash").limit(MAX_TRAIN).agg(F.max("hash")).first()[0]
    if last is None:
        return SkipChain.empty()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shortened(t) for t in batch.column(1).to_pylist()], pa.string())], names=["hash", "body"])

    sample = rows.where(F.col("hash") <= last).mapInArrow(run, "hash long, body string").groupBy("hash").agg(F.min("body").alias("body"))
    return SkipChain.empty().fit(*examples(r.body for r in sorted(sample.collect(), key=lambda r: r.hash)))


def added_spans(text: str, spans: list[tuple[int, int]], guesses: np.ndarray, observed: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of what the field marks beyond the observed tokens; neighbours of one kind are one span."""
    out: list[tuple[int, int, int]] = []
    for (a, b), p, seen in zip(spans, guesses, observed):
        label = int(p.argmax())
        if seen >= 0 or label == OUTSIDE or p[label] <= 0.5:
            continue
        if out and out[-1][1] == label - 1 and a - out[-1][2] <= 2 and GAP.issuperset(text[out[-1][2] : a]):
            out[-1] = (out[-1][0], label - 1, b)
        else:
            out.append((a, label - 1, b))
    return out


def found(texts: list[str], model: SkipChain) -> list[tuple[list, list]]:
    """Base and added spans of each text."""
    out: list = []
    waiting: list = []
    graph = Field()

    def settle() -> None:
        nonlocal graph
        if waiting:
            observed = np.concatenate([w[3] for w in waiting])
            guesses, at = model.marginals(graph, observed), 0
            for place, text, spans, seen in waiting:
                out[place] = (out[place][0], added_spans(text, spans, guesses[at : at + len(spans)], seen))
                at += len(spans)
        waiting.clear()
        graph = Field()

    for place, text in enumerate(texts):
        if not SEED.search(text):
            out.append(([], []))
            continue
        base, spans = base_spans(text), tokens(text)
        out.append((base, []))
        seen = observed_labels(spans, base)
        if (seen < 0).any():
            graph.add(text, spans)
            waiting.append((place, text, spans, seen))
        if graph.n >= TOGETHER:
            settle()
    settle()
    return out


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def described(base: list, added: list) -> tuple:
    shown = [f"{KINDS[k]}:{a}:{b}" for a, k, b in base]
    both = sorted([*base, *((a, len(KINDS) + k, b) for a, k, b in added)])
    return (*(sum(k == i for _, k, _ in base) for i in range(len(KINDS))), hashlib.sha256(",".join(shown).encode()).hexdigest(), ",".join(f"{(KINDS + NEAR)[k]}:{a}:{b}" for a, k, b in both))


def personal_data(docs: DataFrame, model: SkipChain | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: the key as doc_id, the numbers of base spans by kind, base_sha256, and all spans.

    The field is fitted on ``docs`` unless a ``model`` is given. Null and empty texts have no spans; repeated rows are reported
    each; texts are read whole; other columns are not read; an empty table gives no rows. A span of the rules is never changed
    or dropped, and what the field adds meets none of them.
    """
    model = model or train(docs, text)
    rows = docs.select(F.col(key).alias("doc_id"), whole_text(text).alias("body"))
    names = [x.split()[0] for x in FOUND.split(", ")]

    def run(batches):
        for batch in batches:
            columns = list(zip(*(described(*f) for f in found(batch.column(1).to_pylist(), model)))) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], names=["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {FOUND}")


def op11_personal_data(spark, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
