"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are symbols, told by their marks: insult, negation, speech, quotation mark, target, modal, violence. Five transducers
read them: ``insult`` tags a word as an insult and ``threat`` violence after a modal; ``negation`` tags either after a negation
as negated, ``reported`` either after a verb of speech or inside quotation marks as reported; ``target`` tags a target that
follows a threat, by the threat's kind, and says at the end of the clause whether anybody was meant. They are arc tables,
composed once into one machine (``compose``), which reads a clause from left to right; a clause's weight goes to channels by
the tags. Quotation marks stay open over the clauses of a paragraph (a line). A document is scored by what its clauses matched,
never by words alone.

The insult marks come from a trie of weighted arcs over characters. Its words and word beginnings are few seeds, and what is
learned from labelled rows, as the log odds in toxic against other documents, less a standard error. Channels are weighed by
a logistic model, so that negation and quotation discount as much as the labels say. Labels come from at most ``MAX_TRAIN``
rows, those with the smallest hashes of their ids; that alone bounds the trie.

Texts are scored whole, however long; null texts count as empty.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiewright.llm.bpe import _Memo, whole_text
from tiewright.llm.skew import unused
from tiewright.sources.tables import drop, materialize

MAX_TRAIN = 20_000
MIN_SUPPORT = 3
PREFIXES = (3, 4, 5, 6)
#: Standard errors of log odds that a pattern needs if most of its documents are not toxic: among all words of a corpus,
#: thousands are by chance more frequent in toxic ones by one or two.
STRONG = 4
CUT = 0.3
CLAUSE = re.compile(r"[^.!?;\n]+")
#: A contracted not stays with its verb.
WORD = re.compile(r"[^\W\d_]*n['’]t\b|[^\W\d_]+|[\"“”„«»]")

#: Seeds of the transducers, in four languages.
TARGETS = frozenset("you your yourself he she they him her them du dich dein ihr sie tu toi ton vous il elle tú usted él ella ellos".split())
CONTRACTIONS = frozenset("isn't aren't wasn't weren't don't doesn't didn't won't wouldn't can't couldn't shouldn't haven't hasn't hadn't ain't".split())
NEGATIONS = CONTRACTIONS | {w.replace("'", "’") for w in CONTRACTIONS} | frozenset("not no never nor nicht kein keine nie ne pas jamais non nunca jamás".split())
REPORTED = frozenset("said says saying quoted wrote claimed called sagte schrieb zitiert dit disait écrit dijo dice escribió".split())
QUOTES = frozenset('"“”„«»')
INSULTS = {w: 2.0 for w in "idiot moron stupid scum trash loser pathetic worthless disgusting dumb dummkopf idiota estúpido imbécile crétin".split()}
#: "ll" and "going" are what words make of "I'll" and "I'm going to".
THREAT_MODALS = frozenset("will ll gonna going shall werde wirst wird vais va vas voy".split())
THREATS = frozenset("kill hurt destroy beat punish töten schlagen tuer frapper matar golpear".split())
#: How far before a match a negation or a verb of speech still governs it, in words.
REACH = 3
#: Threats at somebody, violence announced at nobody, and threats at somebody that are denied or reported stand apart.
CHANNELS = ("plain", "aimed", "negated", "reported", "threat", "loose", "withdrawn", "peak", "clauses")


def patterns_of(word: str) -> list[str]:
    """A word's own pattern, and the beginnings that other words may share with it."""
    return [f"{word}$", *(word[:k] for k in PREFIXES if len(word) > k)]


def weight(toxic: float, other: float, n_toxic: float, n_other: float) -> float:
    """Log odds of a pattern, less one standard error."""
    odds = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((other + 0.5) / (n_other + 1))
    return odds - math.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))


#: Marks of a symbol.
INSULT, NEGATION, REPORT, QUOTE, TARGET, MODAL, VIOLENCE = (1 << k for k in range(7))
SYMBOLS = 1 << 7
#: Kinds of a match. A tag has the kind of an insult, of a threat, and of the threat that a target completes, two bits each.
NONE, PLAIN, NEGATED, SAID = 0, 1, 2, 3
THREAT, AIMED = 2, 4
#: Tags that come into a transducer: none is completed before the last one.
INCOMING = 1 << AIMED
#: Symbols that can give a tag; a clause without any gives none.
ACTIVE = frozenset(s for s in range(SYMBOLS) if s & (INSULT | VIOLENCE))


@dataclass(frozen=True)
class Transducer:
    """Arc tables by [state, symbol, tag]: the state after the arc, and the tag it gives. State 0 is the start."""

    after: np.ndarray
    gives: np.ndarray


def transducer(states: int, arc) -> Transducer:
    """``arc(state, symbol, tag)`` -> (state, tag), for every state, symbol and tag that comes in."""
    table = np.array([[[arc(q, s, t) for t in range(INCOMING)] for s in range(SYMBOLS)] for q in range(states)])
    return Transducer(table[..., 0], table[..., 1])


def _countdown(mark: int):
    """States that tell how many more words a mark governs: REACH after it, one less with each word."""
    return lambda q, s: REACH if s & mark else max(0, q - 1)


def _turned(tag: int, kind: int) -> int:
    """The tag with its plain matches turned into another kind."""
    for at in (0, THREAT):
        if tag >> at & 3 == PLAIN:
            tag += kind - PLAIN << at
    return tag


def grammar_transducers() -> dict[str, Transducer]:
    negation, reported, modal = _countdown(NEGATION), _countdown(REPORT), _countdown(MODAL)

    def speech(q, s, t):
        """The state is the countdown and, from REACH + 1 on, the same inside quotation marks."""
        inside, left = divmod(q, REACH + 1)
        now = inside ^ bool(s & QUOTE)
        return now * (REACH + 1) + reported(left, s), _turned(t, SAID) if left or now else t

    def target(q, s, t):
        """The state is whether a target was named, and twice a place: of a threat that waits for one, by kind and words left."""
        named, waits = q & 1 or int(bool(s & TARGET)), q >> 1
        kind, left = divmod(waits - 1, REACH) if waits else (0, 0)
        if waits and s & TARGET:
            t, waits = t | kind + 1 << AIMED, 0
        elif waits:
            waits = waits - 1 if left else 0
        if threat := t >> THREAT & 3:
            waits = threat * REACH
        return named + 2 * waits, t

    return {
        "insult": transducer(1, lambda q, s, t: (0, t | PLAIN if s & INSULT else t)),
        "threat": transducer(REACH + 1, lambda q, s, t: (modal(q, s), t | PLAIN << THREAT if s & VIOLENCE and q else t)),
        "negation": transducer(REACH + 1, lambda q, s, t: (negation(q, s), _turned(t, NEGATED) if q else t)),
        "reported": transducer(2 * (REACH + 1), speech),
        "target": transducer(2 * (1 + 3 * REACH), target),
    }


def compose(first: Transducer, second: Transducer) -> Transducer:
    """Both run side by side; the second reads the tags that the first gives. A state is first * states of second + second."""
    n, m = len(first.after), len(second.after)
    symbols = np.arange(SYMBOLS)[None, None, :, None]
    tag = first.gives[:, None]  # (n, 1, symbols, tags)
    state = np.arange(m)[None, :, None, None]
    after = first.after[:, None] * m + second.after[state, symbols, tag]
    return Transducer(after.reshape(n * m, SYMBOLS, -1), second.gives[state, symbols, tag].reshape(n * m, SYMBOLS, -1))


class Machine:
    """The composed transducers, which start without a tag: rows of arcs by state."""

    def __init__(self):
        parts = list(grammar_transducers().values())
        whole = Transducer(parts[0].after[..., :1], parts[0].gives[..., :1])
        for part in parts[1:]:
            whole = compose(whole, part)
        self.after: list[list[int]] = whole.after[:, :, NONE].tolist()
        self.gives: list[list[int]] = whole.gives[:, :, NONE].tolist()
        #: By which the state of ``reported`` counts in a state of the whole.
        self.unit = len(parts[-1].after)

    def read(self, symbols: list[int], inside: bool = False) -> tuple[list[int], bool]:
        """(the tag of each symbol, whether a target was named) of one clause that begins ``inside`` quotation marks or not."""
        state, tags = self.unit * (REACH + 1) * inside, []
        for s in symbols:
            tags.append(self.gives[state][s])
            state = self.after[state][s]
        return tags, bool(state & 1)


MACHINE = Machine()


class Lexicon:
    """A trie of weighted arcs over characters: a word's weight is the largest one that its path meets or ends with."""

    def __init__(self, weights: dict[str, float]):
        self.arcs: dict[tuple[int, str], int] = {}
        self.passing, self.ending = [0.0], [0.0]
        for pattern, w in weights.items():
            node = 0
            for c in pattern.removesuffix("$"):
                node = self.arcs.setdefault((node, c), len(self.passing))
                if node == len(self.passing):
                    self.passing.append(0.0)
                    self.ending.append(0.0)
            side = self.ending if pattern.endswith("$") else self.passing
            side[node] = max(side[node], w)

    def weight(self, word: str) -> float:
        node, best = 0, 0.0
        for k, c in enumerate(word):
            if k and self.passing[node] > best:
                best = self.passing[node]
            node = self.arcs.get((node, c), -1)
            if node < 0:
                return best
        return max(best, self.ending[node])


def marks(word: str) -> int:
    """The marks that a word has whatever was learned."""
    kinds = ((NEGATION, NEGATIONS), (REPORT, REPORTED), (QUOTE, QUOTES), (TARGET, TARGETS), (MODAL, THREAT_MODALS), (VIOLENCE, THREATS))
    return sum(mark for mark, listed in kinds if word in listed)


class Grammar:
    """Weights and channels. ``counts``: pattern to (toxic, other) numbers of training documents that have it."""

    def __init__(self, counts: dict[str, tuple[int, int]], n_toxic: int, n_other: int):
        self.counts, self.n_toxic, self.n_other = counts, n_toxic, n_other
        self.weights = {p: w for p, (t, o) in counts.items() if t >= MIN_SUPPORT and (w := weight(t, o, n_toxic, n_other)) > 0}
        seeds = {f"{word}$": max(w, self.weights.get(f"{word}$", 0.0)) for word, w in INSULTS.items()}
        self.lexicon = Lexicon(self.weights | seeds)
        self.memo = _Memo(self._symbol)
        self.coefficients: np.ndarray | None = None

    def _symbol(self, word: str) -> int:
        return marks(word) | (INSULT if self.lexicon.weight(word) > 0 else 0)

    def without(self, word: str, label: int) -> float:
        """A word's weight as if one document of that label, which has the word, had not been counted."""
        best = INSULTS.get(word, 0.0)
        for p in patterns_of(word):
            t, o = self.counts.get(p, (0, 0))
            t, o = t - label, o - (1 - label)
            if t >= MIN_SUPPORT:
                best = max(best, weight(t, max(o, 0), self.n_toxic - label, self.n_other - (1 - label)))
        return best

    def channels(self, text: str, insult=None) -> list[float]:
        """What the clauses of a text sum up to in each channel; ``insult``: other weights of the words marked as insults."""
        insult, symbol = insult or self.lexicon.weight, self.memo.__getitem__
        sums, peak, matched = dict.fromkeys(CHANNELS, 0.0), 0.0, 0
        for paragraph in text.lower().split("\n"):
            inside, quotes = False, not QUOTES.isdisjoint(paragraph)
            for clause in CLAUSE.findall(paragraph):
                words = WORD.findall(clause)
                symbols = list(map(symbol, words))
                began = inside
                if quotes:
                    inside ^= sum(1 for s in symbols if s & QUOTE) % 2 == 1
                if ACTIVE.isdisjoint(symbols):
                    continue
                heavy = {}
                for i, s in enumerate(symbols):
                    if s & INSULT:
                        if (w := insult(words[i])) > 0:
                            heavy[i] = w
                        else:
                            symbols[i] = s & ~INSULT
                tags, aimed = MACHINE.read(symbols, began)
                if not any(tags):
                    continue
                matched += 1
                channel = {PLAIN: "aimed" if aimed else "plain", NEGATED: "negated", SAID: "reported"}
                for i, tag in enumerate(tags):
                    if tag & 3:
                        sums[channel[tag & 3]] += heavy[i]
                        peak = max(peak, heavy[i])
                    if tag >> THREAT & 3 == PLAIN:
                        sums["loose"] += 1
                    if tag >> AIMED == PLAIN:
                        sums["threat"] += 1
                        sums["loose"] -= 1
                    elif tag >> AIMED:
                        sums["withdrawn"] += 1
        sums["peak"], sums["clauses"] = peak, float(matched)
        return [math.log1p(sums[c]) if c != "peak" else sums[c] for c in CHANNELS]

    def fit(self, rows: np.ndarray, labels: np.ndarray, ridge: float = 0.5, steps: int = 40) -> None:
        """Weigh the channels by ridge-regularised logistic regression (Newton steps)."""
        x = np.column_stack([np.ones(len(rows)), rows])
        b = np.zeros(x.shape[1])
        penalty = np.full(x.shape[1], ridge)
        penalty[0] = 1e-3
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (labels - p) - penalty * b)
            b = b + step
            if np.abs(step).max() < 1e-8:
                break
        self.coefficients = b

    def score(self, text: str) -> float:
        z = float(self.coefficients[0] + np.dot(self.coefficients[1:], self.channels(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(body, toxic) of at most MAX_TRAIN labelled documents outside the held-out quarter, by the smallest hashes.

    Of rows that share a key one is taken, that whose text has the smallest hash; of several labels the largest.
    """
    marked = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    found = docs.select("doc_id", whole_text("text").alias("body")).join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id").agg(F.min_by("body", F.xxhash64("body")).alias("body"), F.max("toxic").alias("toxic"))
    return one.select("body", F.col("toxic").cast("int").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame) -> Grammar:
    """Learn the insult trie and the channels' weights from labelled documents.

    A training document's own count is taken out of the weights with which its channels are measured. Without any labelled
    rows of both kinds, as with empty tables, the seeds stand alone. Rows with a null key or label teach nothing.
    """
    rows = materialize(training_rows(docs, labels), "training")

    def tally(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {p for w in set(WORD.findall(text.lower())) for p in patterns_of(w)}
                counts.update((p, label) for p in found)
            if len(counts) > 500_000:
                yield dump(counts)
                counts.clear()
        yield dump(counts)

    def dump(counts):
        keys = list(counts)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], names=["pattern", "toxic", "n"])

    sums = rows.mapInArrow(tally, "pattern string, toxic int, n long").groupBy("pattern").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("o"))
    n_toxic, n_other = rows.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") != 1)).first()
    # more often in toxic documents than in others, by share
    t, o = F.col("t"), F.col("o")
    odds = F.log((t + 0.5) / F.lit(n_toxic + 1)) - F.log((o + 0.5) / F.lit(n_other + 1))
    error = F.sqrt(1 / (t + 0.5) + 1 / (o + 0.5))
    more = (t * F.lit(n_other) > o * F.lit(n_toxic)) & ((t > o) | (odds >= STRONG * error))
    counts = {r.pattern: (r.t, r.o) for r in sums.where((t >= MIN_SUPPORT) & more & (odds > error)).collect()}
    grammar = Grammar(counts, n_toxic, n_other)
    shared = rows.sparkSession.sparkContext.broadcast(grammar)

    def measure(batches):
        for batch in batches:
            g, out = shared.value, []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out.append([*g.channels(text, lambda w: g.without(w, label)), float(label)])
            columns = list(zip(*out)) if out else [()] * (len(CHANNELS) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in columns], names=[*CHANNELS, "label"])

    measured = rows.mapInArrow(measure, ", ".join(f"{c} double" for c in (*CHANNELS, "label"))).collect() if n_toxic and n_other else []
    drop(rows)
    if measured:
        table = np.array(sorted(map(tuple, measured)))
        grammar.fit(table[:, :-1], table[:, -1])
    else:
        grammar.coefficients = np.array([-3.0, *(1.0 if c in ("plain", "aimed", "threat") else 0.0 for c in CHANNELS)])
    return grammar


def scored(docs: DataFrame, grammar: Grammar, text: str = "text", out: str = "toxicity"):
    """``docs`` with a column ``out`` of scores from 0 to 1; null texts count as empty and get the score of no match.

    Repeated rows get repeated scores; an empty table stays empty; a column named ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    @F.pandas_udf("double")
    def score(texts):
        shared.value.memo.alone()
        return texts.map(shared.value.score).astype("float64")

    return docs.withColumn(out, score(whole_text(text)))


def clean_documents(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` with scores below ``cut``, with all their columns, whatever their names; repeated rows stay repeated."""
    out = unused(docs, "toxicity")
    return scored(docs, train(docs, labels), out=out).where(F.col(out) < cut).drop(out)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), out="score")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
