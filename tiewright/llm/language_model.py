"""Language-model scores from a weighted backoff automaton.

Tokens are lower-cased words and one end for each text. States stand for histories of two words, of one word, and of none, and
each has an arc for every token that follows it in training; a text starts in the state of two start marks. The failure arc
of a state leads to the state of its shorter history, and from the state of no history to the states that spell words byte by
byte, one for each byte before. With c the count of an arc and C that of its state, an arc weighs (c + m * below) / (C + m) and
a failure arc m / (C + m), where ``below`` is the token's weight in the shorter history and m the mass of that order. So every
state is a distribution, and no arc is left out, seen once or often. m is such that over all training tokens the failure arcs
get the mass of the arcs seen once (``mass``). One traversal from left to right carries the two words and adds log10 weights.

How it is computed. The tables of arcs are as large as the corpus, so none is broadcast or collected:

1. Texts are packed into blocks of about ``BLOCK_CHARS`` characters, one row each, and written to the shared folder.
2. Each block counts its distinct n-grams, known by 64-bit hashes, and sends them, sorted and delta coded, to ranges of keys.
3. Each range adds up the counts of all blocks, and answers each block with the totals of those n-grams whose total is not
   the block's own count; what only one block has needs no answer.
4. Each block meets its answers and traverses its texts.

A row that a block sends to a range holds the fewer n-grams the more ranges there are: with the constants below some hundred
for 30 GB of text, and about ten for 1 TB, beyond which the rows' own size would outweigh what they hold; for such corpora take
larger blocks and ranges.

Everything but the sums is vector arithmetic over the bytes of many texts. Words are told apart by 62 bits of a hash: among
10^9 different words about 0.1 pairs would be counted as one. 2- and 3-grams are told apart by ``NGRAM_BITS``: of 10^10
different ones, one in 28,000 shares its count with another; for far larger corpora take more bits and more disk.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiewright.llm.bpe import whole_text
from tiewright.sources.tables import materialize

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Characters of a block, bytes of text that are looked at in one vector operation, and bytes of text for each range of keys.
BLOCK_CHARS, PORTION, RANGE_BYTES = 8_000_000, 1 << 18, 1 << 22
ORDERS, NGRAM_BITS = 3, 48
#: The byte that stands for the end of a text (no UTF-8 has it), and the symbol between words.
END, GAP = 0xFF, 256
_SPACED = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
_SYMBOL = np.where(_SPACED, GAP, np.arange(256)).astype(np.int32)
_FACTOR = 0x9E3779B97F4A7C15 | 1
_START = np.uint64(0x243F6A8885A308D3)
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
#: Low bits of a key that are not used, by order.
UNUSED = [np.uint64(2), np.uint64(64 - NGRAM_BITS), np.uint64(64 - NGRAM_BITS)]
#: Exact small counts, then eight classes for each doubling.
_EXACT = 64


def held_out(key: Column) -> Column:
    """Texts that the model does not learn from: a tenth, by the checksum of the key. Rows with a null key are learned from."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(10)) == 0, F.lit(False))


# ---------------------------------------------------------------- tokens of many texts at once


class Powers:
    """Powers of an odd factor and of its inverse, by which the hash of any part of a byte array comes from running sums."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, PORTION + (PORTION >> 2))
            self.up, self.down = (np.full(size, f, np.uint64) for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64)))
            for powers in (self.up, self.down):
                powers[0] = 1
                np.cumprod(powers, out=powers)
        return self.up[:n], self.down[:n]


_powers = Powers()


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64(salt * _FACTOR & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def portions(texts: list[str]):
    """The lower-cased bytes of texts one after the other, each behind its end mark, cut between words into PORTIONs."""
    held, size = [], 0
    for text in texts:
        data = text.encode("utf-8", "surrogatepass").translate(LOWER)
        at = 0
        while len(data) - at > PORTION:
            cut = SPACE.search(data, at + PORTION)
            if not cut:
                break
            held.append(data[at : cut.start()])
            yield b" ".join([*held, b""])
            held, size, at = [], 0, cut.start()
        held += [data[at:] if at else data, b"\xff"]
        size += len(data) - at + 3
        if size >= PORTION:
            yield b" ".join([*held, b""])
            held, size = [], 0
    if held:
        yield b" ".join([*held, b""])


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, whether it is the end of a text, transitions of bytes): of bytes that end with a space.

    A transition is 257 times a symbol and the next one; the first is that from the space before the bytes. Between spaces
    there is none, and that is -1.
    """
    raw = np.frombuffer(data, np.uint8)
    space = _SPACED[raw]
    before = np.concatenate([[True], space[:-1]])
    start, stop = np.flatnonzero(before & ~space), np.flatnonzero(~before & space)
    up, down = _powers.of(len(raw))
    sums = np.cumsum((raw + np.uint64(1)) * up, dtype=np.uint64)
    head = np.where(start > 0, sums[start - 1], np.uint64(0)) if len(start) else np.empty(0, np.uint64)
    hashes = mixed((sums[stop - 1] - head) * down[start], 1) if len(start) else np.empty(0, np.uint64)
    symbol = _SYMBOL[raw]
    moves = np.concatenate([[np.int32(GAP)], symbol[:-1]]) * np.int32(257) + symbol
    moves[before & space] = -1
    return hashes, (raw[start] == END) if len(start) else np.empty(0, bool), moves


def spelled(moves: np.ndarray, log_moves: np.ndarray) -> np.ndarray:
    """log10 weight of spelling each word."""
    real = moves[moves >= 0]
    if not len(real):
        return np.empty(0)
    return np.add.reduceat(log_moves[real], np.flatnonzero(real // 257 == GAP))


def ngrams(words: np.ndarray, ends: np.ndarray):
    """Keys of the 1-, 2- and 3-gram that each token ends; texts begin with start marks."""
    first = np.concatenate([[True], ends[:-1]]) if len(ends) else np.empty(0, bool)
    before = np.where(first, _START, np.concatenate([[_START], words[:-1]])) if len(words) else words
    second = np.concatenate([[True], first[:-1]]) | first if len(first) else first
    twice = np.where(second, _START, np.concatenate([[_START, _START], words[:-2]])[: len(words)]) if len(words) else words
    yield words >> UNUSED[0] << UNUSED[0]
    yield mixed(mixed(before, 3) * _MIX[2] + words, 5) >> UNUSED[1] << UNUSED[1]
    yield mixed(mixed(mixed(twice, 7) + before, 9) * _MIX[2] + words, 11) >> UNUSED[2] << UNUSED[2]


# ---------------------------------------------------------------- blocks and coded keys


def encoded(values: np.ndarray) -> bytes:
    """Numbers in ascending order or small: their number, and the bytes of the (first) differences plane by plane, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return b"".join([len(values).to_bytes(4, "little"), pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)])


def decoded(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    if not n:
        return np.empty(0, np.uint64)
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[4:], 8 * n, asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def differences(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending[:1] * 0)


def joined(arrays: list[np.ndarray]) -> bytes:
    parts = list(map(encoded, arrays))
    return b"".join([x for p in parts for x in (len(p).to_bytes(4, "little"), p)])


def parted(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(decoded(data[at + 4 : at + 4 + n]))
        at += 4 + n
    return out


def range_starts(ranges: np.ndarray, bits: int) -> np.ndarray:
    """The least keys of the ranges of these numbers."""
    return ranges.astype(np.uint64) << np.uint64(64 - bits)


def pack(rows: DataFrame) -> DataFrame:
    """(block, n_bytes, n_learned, texts): about BLOCK_CHARS characters of (doc_id, held_out, body), as one compressed value."""

    def run(batches):
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            lengths = np.diff(np.frombuffer(batch.column(2).buffers()[1], np.int32)[batch.column(2).offset :][: batch.num_rows + 1]) if batch.num_rows else []
            at = 0
            for i, n in enumerate(lengths):
                size += int(n)
                if size >= BLOCK_CHARS:
                    held.append(batch.slice(at, i + 1 - at))
                    yield row(number, held)
                    number, held, size, at = number + 1, [], 0, i + 1
            if at < batch.num_rows:
                held.append(batch.slice(at))
        if held:
            yield row(number, held)

    def row(number, held):
        table = pa.Table.from_batches(held).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as writer:
            writer.write_table(table)
        n_bytes = pc.sum(pc.binary_length(table.column("body"))).as_py() or 0
        learned = table.num_rows - sum(table.column("held_out").to_pylist())
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([n_bytes]), pa.array([learned]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "n_bytes", "n_learned", "texts"])

    return rows.mapInArrow(run, "block long, n_bytes long, n_learned long, texts binary")


def unpacked(texts: bytes) -> pa.Table:
    return pa.ipc.open_stream(texts).read_all()


class Block:
    """The tokens of a block's texts, their n-grams and the block's own counts of them in texts that are learned from."""

    def __init__(self, texts: bytes, log_moves: np.ndarray | None = None):
        table = unpacked(texts)
        self.ids, self.held = table.column("doc_id").combine_chunks(), table.column("held_out").to_numpy()
        words, ends, spell, text = [np.empty(0, np.uint64)], [np.empty(0, bool)], [np.empty(0)], 0
        self.moves = np.zeros(257 * 257, np.int64)
        for data in portions(table.column("body").to_pylist()):
            found = words_of(data)
            words.append(found[0])
            ends.append(found[1])
            of_word = text + np.cumsum(found[1]) - found[1]
            text += int(found[1].sum())
            if log_moves is None:
                self._count_moves(found[2], ~self.held[of_word])
            else:
                spell.append(spelled(found[2], log_moves))
        del table
        self.spelled, ends = np.concatenate(spell), np.concatenate(ends)
        self.begin = np.concatenate([[0], np.flatnonzero(ends) + 1])[:-1]
        self.lengths = np.diff(np.concatenate([self.begin, [len(ends)]]))
        learned = np.repeat(~self.held, self.lengths)
        self.keys, self.place, self.counts = [], [], []
        for key in ngrams(np.concatenate(words), ends):
            distinct, place = np.unique(key, return_inverse=True)
            self.keys.append(distinct)
            self.place.append(place.astype(np.int32))
            self.counts.append(np.bincount(place[learned], minlength=len(distinct)).astype(np.int32))

    def _count_moves(self, moves: np.ndarray, learned: np.ndarray) -> None:
        """How often each transition of bytes occurs in words that are learned from."""
        moves = moves[moves >= 0]
        of_word = np.cumsum(moves // 257 == GAP, dtype=np.int32) - 1
        self.moves += np.bincount(moves[learned[of_word]], minlength=257 * 257)


# ---------------------------------------------------------------- counts of the corpus

SENT, ANSWER, TALLY, MOVES, TEXTS = range(5)


def _tables(kind: int, columns: list) -> pa.RecordBatch:
    block, where, n, blob = columns
    rows = len(block)
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(rows, kind, np.int32)), pa.array(np.asarray(block, np.int64)), pa.array(np.asarray(where, np.int32)), pa.array(np.asarray(n, np.int64)), pa.array(blob, pa.binary()),
    ], names=["kind", "block", "range", "n", "data"])


ROWS = "kind int, block long, range int, n long, data binary"


def send(batches, bits: int):
    """The n-grams of each block with its own counts, by ranges of keys, and the transitions of bytes."""
    for batch in batches:
        for i in range(batch.num_rows):
            number, block = batch.column(0)[i].as_py(), Block(batch.column(1)[i].as_py())
            ranges = np.unique(np.concatenate([k >> np.uint64(64 - bits) for k in block.keys]))
            starts = range_starts(ranges[1:], bits)
            cut = [(np.split(x, bounds), np.split(c, bounds)) for x, c, bounds in ((k, c, np.searchsorted(k, starts)) for k, c in zip(block.keys, block.counts))]
            for at, r in enumerate(ranges.tolist()):
                yield _tables(SENT, [[number], [r], [0], [joined([x for (k, c), unused in zip(cut, UNUSED) for x in (differences(k[at] >> unused), c[at])])]])
            seen = np.flatnonzero(block.moves)
            yield _tables(MOVES, [seen, (seen % (1 << bits)), block.moves[seen], [None] * len(seen)])


def class_of(counts: np.ndarray) -> np.ndarray:
    """The class of a count: itself if it is small, else by its logarithm."""
    large = _EXACT + np.floor(8 * np.log2(np.maximum(counts, _EXACT) / _EXACT)).astype(np.int64)
    return np.where(counts < _EXACT, counts, large)


def answer(batches):
    """For whole ranges, which come one after the other: answers to the blocks, and tallies of the counts."""
    held: list[tuple[int, bytes]] = []
    present = None
    for batch in batches:
        kinds, ranges = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        moves = np.flatnonzero(kinds == MOVES)
        if len(moves):
            yield _tables(MOVES, [batch.column(1).to_numpy()[moves], ranges[moves], batch.column(3).to_numpy()[moves], [None] * len(moves)])
        for i in np.flatnonzero(kinds == SENT).tolist():
            if ranges[i] != present:
                if held:
                    yield from settle(present, held)
                present, held = ranges[i], []
            held.append((batch.column(1)[i].as_py(), batch.column(4)[i].as_py()))
    if held:
        yield from settle(present, held)


def settle(number: int, held: list[tuple[int, bytes]]):
    parts = [parted(data) for _, data in held]
    answers: list[list[np.ndarray]] = [[] for _ in held]
    for order in range(ORDERS):
        keys = [np.cumsum(p[2 * order], dtype=np.uint64) for p in parts]
        counts = [p[2 * order + 1].astype(np.int64) for p in parts]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
        for to, own, at in zip(answers, counts, np.split(place, np.cumsum(list(map(len, keys)))[:-1])):
            other = np.flatnonzero(total[at] != own)
            to += [differences(other), total[at[other]]]
        classes = class_of(total) * 4 + order
        n = np.bincount(classes)
        sums = np.bincount(classes, weights=total).astype(np.int64)
        some = np.flatnonzero(n)
        yield _tables(TALLY, [np.concatenate([2 * some, 2 * some + 1]), [number] * 2 * len(some), np.concatenate([n[some], sums[some]]), [None] * 2 * len(some)])
    some = [i for i, a in enumerate(answers) if any(map(len, a))]
    yield _tables(ANSWER, [[held[i][0] for i in some], [number] * len(some), [0] * len(some), [joined(answers[i]) for i in some]])


# ---------------------------------------------------------------- the model


def mass(contexts: list[tuple[float, float]], once: float) -> float:
    """The mass of failure arcs: with it, states of given (count, number of states) leave ``once`` of all tokens to them."""
    total = sum(c * n for c, n in contexts)
    if not once or not total:
        return 0.5
    low, high = 1e-6, 1e12
    for _ in range(200):
        middle = math.sqrt(low * high)
        if sum(n * c * middle / (c + middle) for c, n in contexts) < once:
            low = middle
        else:
            high = middle
    return min(low, total)


class Model:
    """What the whole corpus says in a few numbers: masses, numbers of tokens and words, and weights of byte transitions."""

    def __init__(self, tally: dict[int, int], moves: dict[int, int], n_texts: int):
        counts: list[list[tuple[float, float]]] = [[] for _ in range(ORDERS)]
        once, distinct, tokens = [0] * ORDERS, [0] * ORDERS, [0] * ORDERS
        for key in {k // 2 for k in tally}:
            kind, order = divmod(key, 4)
            n, total = tally.get(2 * key, 0), tally.get(2 * key + 1, 0)
            if kind:
                counts[order].append((total / n, n))
                distinct[order] += n
                tokens[order] += total
                once[order] += n if kind == 1 else 0
        self.n, self.v, self.n_texts = tokens[0], distinct[0], n_texts
        self.masses = [mass([(self.n, 1)], once[0]), mass(sorted(counts[0]), once[1]), mass(sorted(counts[1]), once[2])]
        table = np.zeros((257, 257))
        for k, c in moves.items():
            table[divmod(k, 257)] = c
        can = np.append(~_SPACED, True) * np.ones((257, 1))  # no byte of white space is inside a word,
        can[GAP, GAP], can[:GAP, END], can[END] = 0, 0, np.arange(257) == GAP  # and the end is a word of one symbol
        weights = (table + can / can.sum(axis=1, keepdims=True)) / (table.sum(axis=1, keepdims=True) + 1)
        with np.errstate(divide="ignore"):
            self.log_moves = np.log10(weights).ravel()

    def traverse(self, block: Block, totals: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(log10 weight of each token, count of each token): arcs and failure arcs along all texts of a block."""
        c = [t[p].astype(float) for t, p in zip(totals, block.place)]
        below = (c[0] + self.masses[0] * 10**block.spelled) / (self.n + self.masses[0])
        for order in (1, 2):
            states = np.concatenate([[0.0], c[order - 1][:-1]])
            states[block.begin] = self.n_texts
            m = self.masses[order]
            below = np.where(states > 0, (c[order] + m * below) / (states + m), below)
        return np.log10(np.maximum(below, 1e-300)), c[0]


def traverse(batches, model: Model, id_type: pa.DataType):
    """Scores of the texts of whole blocks; the answers to a block come before its texts."""
    answers: dict[int, bytes] = {}
    present = None
    for batch in batches:
        for i in range(batch.num_rows):
            number = batch.column(1)[i].as_py()
            if number != present:
                present, answers = number, {}
            if batch.column(0)[i].as_py() == ANSWER:
                answers[batch.column(2)[i].as_py()] = batch.column(4)[i].as_py()
                continue
            yield scores(Block(batch.column(4)[i].as_py(), model.log_moves), answers, batch.column(3)[i].as_py(), model, id_type)
            answers = {}


def scores(block: Block, answers: dict[int, bytes], bits: int, model: Model, id_type: pa.DataType) -> pa.RecordBatch:
    totals = [c.astype(np.int64) for c in block.counts]
    ranges = range_starts(np.array(list(answers), np.int64), bits)
    starts = [np.searchsorted(k, ranges) for k in block.keys]
    for i, data in enumerate(answers.values()):
        parts = parted(data)
        for order in range(ORDERS):
            totals[order][starts[order][i] + np.cumsum(parts[2 * order]).astype(np.int64)] = parts[2 * order + 1].astype(np.int64)
    log, c = model.traverse(block, totals)
    base = np.log10((c + 0.1) / (model.n + 0.1 * (model.v + 1)))
    add = lambda x: np.add.reduceat(x, block.begin) if len(block.begin) else np.empty(0)
    return pa.RecordBatch.from_arrays([
        block.ids.cast(id_type), pa.array(block.held), pa.array(block.lengths.astype(np.int64)), pa.array(add((c > 0).astype(np.int64)).astype(np.int64)),
        pa.array(np.full(len(block.ids), model.n, np.int64)), pa.array(add(base).astype(float)), pa.array(add(log).astype(float)),
    ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def learn(blocks: DataFrame) -> tuple[Model, DataFrame, int]:
    """(the model, the answers to the blocks, bits of a range's number) over packed ``blocks``, perhaps none."""
    n_bytes, n_texts = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.coalesce(F.sum("n_learned"), F.lit(0))).first()
    bits = max(1, math.ceil(math.log2(max(2, n_bytes / RANGE_BYTES))))
    sent = blocks.select("block", "texts").mapInArrow(lambda it: send(it, bits), ROWS)
    dealt = sent.repartition("range").sortWithinPartitions("range")
    found = materialize(dealt.mapInArrow(answer, ROWS), "counts")
    sums = found.where(F.col("kind").isin(TALLY, MOVES)).groupBy("kind", "block").agg(F.sum("n").alias("n")).collect()
    model = Model({r.block: r.n for r in sums if r.kind == TALLY}, {r.block: r.n for r in sums if r.kind == MOVES}, n_texts)
    return model, found.where(F.col("kind") == ANSWER), bits


def score(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows that are not held out. Null texts count as empty: one token, the end. A very long text is
    looked at in portions; its tokens are held as numbers. Repeated rows each count and each get a result; an empty table
    gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"), whole_text(text).alias("body"))
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(rows.schema["doc_id"].dataType)
    blocks = materialize(pack(rows), "blocks")
    model, answers, bits = learn(blocks)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    texts = blocks.select(F.lit(TEXTS).alias("kind"), "block", F.lit(0).alias("range"), F.lit(bits).cast("long").alias("n"), F.col("texts").alias("data"))
    met = answers.unionByName(texts).repartition("block").sortWithinPartitions("block", "kind")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return met.mapInArrow(lambda it: traverse(it, shared.value, id_type), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
