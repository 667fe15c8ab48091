"""A hashed maximum-entropy language model with class-factored softmax, in two levels of classes.

    p(word | history) = p(class | history) * p(part | class, history) * p(word | class, part)

p(class | history) is a softmax over a few dozen classes. Its scores are sums of rows of one table that hashed features of
the history pick: the last word, the word before it (a skip), both together (an n-gram), the classes three and four back (a
skip-gram of classes), and the two last classes. The most frequent words are classes of their own; all other words are
classed by a hash of their ending, which tells languages and kinds of words apart, and the end of a text is a class too.
The words of an ending fall into parts by a hash of the whole word. p(part | class, history) is a softmax over these, with rows of a second
table that the last word with the class, and the last class with the class, pick. p(word | class, part) is the word's smoothed share of
the part, with one place in each part for words not seen in training. So every word's probability depends on the history at both
levels, and the probabilities of all words, and of an unknown word in each part, add up to one.

Training reads every training text once. In each round all workers start from the same table, make gradient steps over
minibatches of their part of the texts, and send back how far each row moved and on how many tokens; the moves are averaged
by tokens, block of rows by block, up a tree that ends in one table. Scoring works through the texts in the same minibatches.

Counts cover the whole training corpus. The most frequent words' counts are broadcast (a fixed number of them); words beyond
are counted in their text and joined with the counts by shuffling.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.common import saved

#: Classes: single frequent words, endings, and one for the end of a text. Rows of the table, and blocks in which it travels.
SINGLES, ENDINGS, ROWS, BLOCKS = 15, 16, 1 << 16, 32
CLASSES = SINGLES + ENDINGS + 1
#: Parts of the class of an ending.
PARTS = 16
#: Words whose counts are broadcast; training rounds; tokens of a minibatch; step size.
FREQUENT, ROUNDS, BATCH, STEP = 200_000, 2, 8192, 0.35
#: Branches that are added up at once on the way to one table.
FAN = 32
#: Smoothing of counts.
ALPHA = 0.1
#: Words that a worker holds the codes of; distinct words after which it hands on its counts.
HOT, CACHE = 1 << 14, 400_000
#: Fixed value: punctuation that is no part of a word's ending.
TAIL = b".,;:!?|#$%&*\"')"
#: Fixed value: the hash of the end token and of the places before a text.
END = 1


def ending(word: bytes) -> bytes:
    """The last two characters of a word, punctuation after it aside."""
    stem = word.rstrip(TAIL) or word
    return stem[-2:] if stem.isascii() else stem.decode(errors="ignore")[-2:].encode()


@dataclass(frozen=True)
class Classes:
    """Which class a word is in: a pure function of the table of single words."""

    singles: dict[bytes, int]

    def of(self, word: bytes) -> int:
        if (k := self.singles.get(word)) is not None:
            return k
        return SINGLES + zlib.crc32(ending(word)) % ENDINGS

    def cell(self, word: bytes) -> int:
        """The class and the part in one number."""
        k = self.of(word)
        return k * PARTS + (zlib.crc32(word) >> 12) % PARTS * (k >= SINGLES)


@dataclass(frozen=True)
class Model:
    """What workers need: classes, the tables of classes and of parts, the frequent words' numbers and log10(c + alpha), of the end at 0, and the parts' log10 masses."""

    classes: Classes
    table: np.ndarray
    fine: np.ndarray
    bias: np.ndarray
    fine_bias: np.ndarray
    number: dict[bytes, int]
    known: np.ndarray
    mass: np.ndarray


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def coder(classes: Classes, number: dict[bytes, int]) -> Callable[[list[bytes]], np.ndarray]:
    """A function from words to integers of (number among the frequent words, or 0; hash; class).

    It holds the codes of the most frequent words only, so that they stay in a processor's cache; looking up a rare word in
    a large table takes longer than making its code. All single words are among those held.
    """
    crc, get, singles = zlib.crc32, number.get, SINGLES
    endings = ENDINGS

    class Codes(dict):
        def __missing__(self, word: bytes) -> int:
            return get(word, 0) << 40 | (crc(word) | 2) << 8 | singles + crc(ending(word)) % endings

    codes = Codes({w: number[w] << 40 | (crc(w) | 2) << 8 | classes.of(w) for w in islice(number, HOT)})
    if len(number) <= HOT:
        get = {}.get  # all numbered words are held
    look_up = codes.__getitem__
    return lambda words: np.fromiter(map(look_up, words), np.int64, len(words))


@dataclass(frozen=True)
class Batch:
    """Every token of some texts, each text ended: rows of the two tables (features, tokens), classes, which tokens have parts, and the parts of these."""

    rows: np.ndarray
    classes: np.ndarray
    some: np.ndarray
    fine: np.ndarray
    parts: np.ndarray


def features(codes: list[np.ndarray]) -> Batch:
    end = np.array([END << 8 | CLASSES - 1], np.int64)
    start = np.full(4, END << 8 | CLASSES - 1, np.int64)
    flat = np.concatenate([x for c in codes for x in (start, c, end)])
    own = np.concatenate([np.arange(at, at + n) for at, n in zip(np.cumsum([4, *(len(c) + 5 for c in codes[:-1])]), [len(c) + 1 for c in codes], strict=True)])
    h, k = flat >> 8 & 0xFFFFFFFF, flat & 255
    w1, w2, k1 = h[own - 1], h[own - 2], k[own - 1]
    mixed = (
        w1 * 0x9E3779B1 + 0x51,
        w2 * 0x85EBCA6B + 0x1F3,
        w1 * 0xC2B2AE35 + w2 * 0x27D4EB2F + 0x9D7,
        (k[own - 3] << 8 | k[own - 4]) * 0x165667B1 + 0x3B1,
        (k1 << 8 | k[own - 2]) * 0x2545F491 + 0x7C5,
    )
    classes = k[own]
    some = np.flatnonzero((classes >= SINGLES) & (classes < CLASSES - 1))
    now = classes.take(some)
    finer = (w1.take(some) * 0x9E3779B1 + now * 0x85EBCA6B + 0x6D3, (k1.take(some) << 8 | now) * 0x27D4EB2F + 0x4C7)
    cut = lambda every: np.stack([((m ^ m >> 17) & ROWS - 1).astype(np.uint16) for m in every])
    return Batch(cut(mixed), classes, some, cut(finer), (h.take(own.take(some)) >> 12) % PARTS)


def log_probs(table: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Natural log probabilities of the classes or parts, (tokens, classes)."""
    z = table.take(rows[0], axis=0)
    for r in rows[1:]:
        z += table.take(r, axis=0)
    z += bias
    np.clip(z, -60, 60, out=z)  # so that no exponential overflows
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def step(table: np.ndarray, bias: np.ndarray, squares: np.ndarray, seen: np.ndarray, rows: np.ndarray, targets: np.ndarray) -> None:
    """One gradient step on a minibatch, in place; ``squares`` scales the steps of each row, ``seen`` counts its tokens."""
    if not len(targets):
        return
    grad = np.exp(log_probs(table, bias, rows))
    grad[np.arange(len(targets)), targets] -= 1
    for r in rows:
        order = np.argsort(r, kind="stable")  # a radix sort for 16-bit integers
        at = r.take(order)
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        at, n = at.take(starts), np.diff(starts, append=len(order))
        g = grad.take(order.take(starts), axis=0)
        many = n > 1  # only rows that several tokens pick need sums
        if many.any():
            k = n[many]
            g[many] = np.add.reduceat(grad.take(order[np.repeat(many, n)], axis=0), np.cumsum(k) - k, axis=0)
        squares[at] += np.einsum("ij,ij->i", g, g) / table.shape[1]
        table[at] -= (STEP / np.sqrt(squares[at] + 1e-3))[:, None] * g
        seen[at] += n


def log10_scores(m: Model, batch: Batch) -> np.ndarray:
    """For each token: log10 of p(class) * p(part) over the part's mass, which the word's smoothed count makes its probability."""
    got = log_probs(m.table, m.bias, batch.rows)[np.arange(len(batch.classes)), batch.classes].astype(np.float64)
    parts = np.zeros(len(got), np.int64)
    if len(batch.some):
        parts[batch.some] = batch.parts
        got[batch.some] += log_probs(m.fine, m.fine_bias.take(batch.classes.take(batch.some), axis=0), batch.fine)[np.arange(len(batch.parts)), batch.parts]
    return got / math.log(10) - m.mass[batch.classes, parts]


def minibatches(texts: Iterator[str | None], code: Callable[[list[bytes]], np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Coded texts in groups of about BATCH tokens; a longer text is a group of its own."""
    group, n = [], 0
    for t in texts:
        c = code(words_of(t))
        group.append(c)
        n += len(c) + 1
        if n >= BATCH:
            yield group
            group, n = [], 0
    if group:
        yield group


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """``(word, n)`` over all texts; the end of a text is the word null. Repeated rows count each time, null and empty texts with their end alone; an empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        ends = 0

        def out(ends: int) -> pa.RecordBatch:
            words = [w.decode() for w in counts]
            return pa.RecordBatch.from_arrays([pa.array([*words, None], pa.string()), pa.array([*counts.values(), ends], pa.int64())], ["word", "n"])

        for batch in batches:
            for t in batch.column(0):
                counts.update(words_of(t.as_py()))
                ends += 1
                if len(counts) > CACHE:
                    yield out(ends)
                    counts.clear()
                    ends = 0
        yield out(ends)

    return docs.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def most_frequent(counts: DataFrame, most: int) -> list:
    """At most ``most`` rows (word, n), the most frequent first: all words from a count up, found by a histogram of counts in steps of two percent."""
    step = F.floor(F.log2("n") * 32)
    words = counts.where("word is not null")
    steps = words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("step")).collect()
    least, total = None, 0
    for r in steps:
        total += r["k"]
        if total > most:
            break
        least = r["step"]
    if least is None:
        return []
    return sorted(words.where(step >= least).collect(), key=lambda r: (-r["n"], r["word"]))


def masses(counts: DataFrame, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each (class, part)."""
    n = CLASSES * PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, kinds = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            of = np.array([n - PARTS if w is None else classes.cell(w.encode()) for w in batch.column(0).to_pylist()], np.int64)
            tokens += np.bincount(of, batch.column(1).to_numpy(), n).astype(np.int64)
            kinds += np.bincount(of, minlength=n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(tokens), pa.array(kinds)], ["cell", "tokens", "kinds"])

    rows = counts.mapInArrow(run, "cell long, tokens long, kinds long").groupBy("cell").agg(F.sum("tokens").alias("t"), F.sum("kinds").alias("k")).collect()
    by = {r["cell"]: (r["t"], r["k"]) for r in rows}
    tokens, kinds = np.array([by.get(c, (0, 0)) for c in range(n)], np.int64).T
    return tokens.reshape(CLASSES, PARTS), kinds.reshape(CLASSES, PARTS)


def train_round(texts: DataFrame, model: Model) -> Model:
    """The model after one round of local steps on ``texts`` (one column), its tables averaged over the workers by tokens."""
    shared = texts.sparkSession.sparkContext.broadcast(replace(model, number=dict(islice(model.number.items(), HOT)), known=model.known[:1]))
    width = ROWS // BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        (table, fine), zero = (m.table.copy(), m.fine.copy()), lambda: np.zeros(ROWS, np.float32)
        squares, seen, fine_squares, fine_seen = zero(), zero(), zero(), zero()
        for group in minibatches((t.as_py() for b in batches for t in b.column(0)), coder(m.classes, m.number)):
            x = features(group)
            step(table, m.bias, squares, seen, x.rows, x.classes)
            step(fine, m.fine_bias.take(x.classes.take(x.some), axis=0), fine_squares, fine_seen, x.fine, x.parts)
        if not seen.any():
            return
        moved = np.concatenate([(table - m.table) * seen[:, None], seen[:, None], (fine - m.fine) * fine_seen[:, None], fine_seen[:, None]], axis=1).astype(np.float32)
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for b in range(BLOCKS):
            s = slice(b * width, (b + 1) * width)
            yield row(b, part, moved[s])

    def row(block: int, at: int, moved: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([at // FAN]), pa.array([at]), pa.array([moved.tobytes()], pa.binary())], ["block", "branch", "at", "moved"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for block, branch, x in zip(*(batch.column(c).to_pylist() for c in ("block", "branch", "moved")), strict=True):
                if key is not None and key != (block, branch):
                    yield row(*key, total)
                    key = None
                y = np.frombuffer(x, np.float32)
                key, total = (block, branch), y.copy() if key is None else total + y
        if key is not None:
            yield row(*key, total)

    # up a tree of FAN branches until one row a block is left; rows are added in the order of their tasks, so sums do not depend on who comes first
    schema = "block long, branch long, at long, moved binary"
    sums = texts.mapInArrow(run, schema)
    while True:
        sums = saved(sums.repartition("block", "branch").sortWithinPartitions("block", "branch", "at").mapInArrow(add, schema))
        if sums.count() <= BLOCKS:
            break
    table, fine = model.table.copy(), model.fine.copy()
    for r in sums.collect():
        y = np.frombuffer(r["moved"], np.float32).reshape(width, CLASSES + PARTS + 2)
        s = slice(r["block"] * width, (r["block"] + 1) * width)
        table[s] += y[:, :CLASSES] / np.maximum(y[:, CLASSES, None], 1)
        fine[s] += y[:, CLASSES + 1 : -1] / np.maximum(y[:, -1:], 1)
    shared.unpersist()
    return replace(model, table=table, fine=fine)


@dataclass(frozen=True)
class Trained:
    model: Model
    counts: DataFrame
    tokens: int
    kinds: int


def train(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, frequent: int = FREQUENT) -> Trained:
    """A model of the texts in ``docs``, each of which it reads once for counts and once for training.

    Null texts are empty ones; repeated rows are learned each time; very long texts are read whole, in minibatches; an empty table gives a model of nothing, which knows no word.
    """
    counts = saved(count_words(docs, text_col))
    n, v = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    most = most_frequent(counts, frequent)
    classes = Classes({r["word"].encode(): k for k, r in enumerate(most[:SINGLES])})
    tokens, kinds = masses(counts, classes)
    number = {r["word"].encode(): k for k, r in enumerate(most, 1)}
    known = np.log10(np.array([float(tokens[-1, 0]), *(float(r["n"]) for r in most)]) + ALPHA)
    bias = np.log((tokens.sum(axis=1) + 1) / (tokens.sum() + CLASSES)).astype(np.float32)
    fine_bias = np.log((tokens + 1) / (tokens.sum(axis=1, keepdims=True) + PARTS)).astype(np.float32)
    zeros = lambda n: np.zeros((ROWS, n), np.float32)
    model = Model(classes, zeros(CLASSES), zeros(PARTS), bias, fine_bias, number, known, np.log10(tokens + ALPHA * (kinds + 1)))
    part = F.pmod(F.xxhash64(text_col), F.lit(rounds))
    for r in range(rounds if n else 0):
        model = train_round(docs.where(part == r).select(text_col), model)
    return Trained(model, counts, int(n or 0), int(v or 0))


def score(docs: DataFrame, trained: Trained, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id, n_tokens, n_known, base_score, score. Null and empty texts have the end token alone.

    ``base_score`` is the unigram log10 probability, ``score`` the model's. Repeated rows and ids each get their own. A very long text is one
    minibatch, held in memory; an empty table gives no rows, and an empty training table even odds; other columns are left aside.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained.model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m = shared.value
        code, row = coder(m.classes, m.number), TaskContext.get().partitionId() << 36
        kind = pa.list_(pa.struct([("word", pa.string()), ("k", pa.int64())]))

        def scored(ids: list, texts: list[list[bytes]], type_: pa.DataType) -> pa.RecordBatch:
            nonlocal row
            codes = [code(w) for w in texts]
            got = log10_scores(m, features(codes))
            sizes = np.array([len(w) + 1 for w in texts])
            starts = np.cumsum(sizes) - sizes
            zero = np.zeros(1, np.int64)
            which = np.concatenate([x for c in codes for x in (c, zero)]) >> 40
            ends = starts + sizes - 1
            there = which > 0
            there[ends] = True
            counted = np.add.reduceat(np.where(there, m.known[which], 0.0), starts)
            n_known = np.add.reduceat(there.astype(np.int64), starts) - 1
            rare = []
            for w, a, b in zip(texts, starts.tolist(), ends.tolist(), strict=True):
                far = np.flatnonzero(~there[a:b]).tolist()
                rare.append([{"word": x.decode(), "k": k} for x, k in Counter([w[i] for i in far]).items()] if far else [])
            number = np.arange(row, row + len(texts))
            row += len(texts)
            cols = [pa.array(number), pa.array(ids, type_), pa.array(sizes), pa.array(n_known), pa.array(counted), pa.array(np.add.reduceat(got, starts)), pa.array(rare, kind)]
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            ids, texts, n = [], [], 0
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                w = words_of(t.as_py())
                ids.append(i.as_py())
                texts.append(w)
                n += len(w) + 1
                if n >= BATCH:
                    yield scored(ids, texts, batch.schema.field(0).type)
                    ids, texts, n = [], [], 0
            if texts:
                yield scored(ids, texts, batch.schema.field(0).type)

    names = ["row", "id", "n_tokens", "n_known", "counted", "context", "rare"]
    rows = saved(docs.select(id_col, text_col).mapInArrow(run, f"row long, id {dict(docs.dtypes)[id_col]}, n_tokens long, n_known long, counted double, context double, rare array<struct<word:string,k:bigint>>"))
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.k")
    met = rare.join(trained.counts, "word", "left")
    of_row = met.groupBy("row").agg(F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + ALPHA)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("more_known"))
    out = rows.drop("rare").join(of_row, "row", "left")
    counted = F.col("counted") + F.coalesce("more", F.lit(0.0))
    ends_known = 1 if trained.tokens else 0
    return out.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + ends_known).cast("long").alias("n_known"),
        (counted - F.col("n_tokens") * math.log10(trained.tokens + ALPHA * (trained.kinds + 1))).alias("base_score"),
        (counted + F.col("context")).alias("score"),
    )
