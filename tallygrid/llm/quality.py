"""Quality rules as a short-circuit cascade.

Each rule is a predicate on a text that rejects it. The time a rule takes and the share it rejects are measured on a
sample of all partitions, texts of any length, where they lie, each rule on its own; and the rules are put in order of rejections per second. A text then passes the rules
in that order and stops at the first that rejects it. The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Fixed value: the characters that count as upper case; not the numerals and circled letters that have a case but are no letters.
UPPER = regex.compile(r"\p{Lu}+")
#: Rows, about, of the sample on which costs and selectivities are measured.
SAMPLE_ROWS = 500


class View:
    """A text with its measures, each computed when it is first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\x0b\x0c\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_dup_lines(self) -> int:
        """Lines with a word that equal an earlier line."""
        lines = [x for x in self.text.split("\n") if x.strip(" \t\x0b\x0c\r")]
        return len(lines) - len(set(lines))

    @cached_property
    def n_lines(self) -> int:
        return sum(1 for x in self.text.split("\n") if x.strip(" \t\x0b\x0c\r"))

    @cached_property
    def n_upper(self) -> int:
        return sum(map(len, UPPER.findall(self.text)))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in a window of three that the text has twice or more."""
        n = self.n_words
        if n < 4:
            return 0
        number: dict[bytes, int] = {}
        ids = np.fromiter([number.setdefault(w, len(number)) for w in self.words], np.int64, n)
        v = len(number)
        if v < 1 << 20:
            grams = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
        else:
            two = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1]
            grams = two[:-1] * v + ids[2:]
        _, at, count = np.unique(grams, return_inverse=True, return_counts=True)
        again = count[at] > 1
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[k : n - 2 + k] |= again
        return int(hit.sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[View], bool]


def base_failed(v: View) -> bool:
    return v.n_words < 50 or 100 * v.n_repeat_words > 50 * v.n_words


#: The rules; each has wide margins, so that prose of any language passes.
RULES = (
    Rule("symbols", lambda v: 10 * v.n_symbols > v.word_chars),
    Rule("few_letters", lambda v: 2 * sum(map(str.isalpha, v.text)) < v.word_chars),
    Rule("word_length", lambda v: not 2 * v.n_words <= v.word_chars <= 20 * v.n_words),
    Rule("shouting", lambda v: v.text.count("!") * 4 > v.n_words),
    Rule("upper_case", lambda v: 2 * v.n_upper > v.word_chars),
    Rule("repeated_lines", lambda v: 10 * v.n_dup_lines > 5 * v.n_lines),
    Rule("repeated_words", lambda v: 100 * v.n_repeat_words > 50 * v.n_words),
    Rule("short", lambda v: v.n_words < 50),
)


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def measure(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[Measured]:
    """Each rule's seconds a text and share of rejections, on its own, so that each pays for the measures that it asks for."""
    out = []
    for r in rules:
        views = [View(t) for t in texts]
        began = time.perf_counter()
        n = sum(map(r.rejects, views))
        out.append(Measured(r, (time.perf_counter() - began) / max(len(views), 1), n / max(len(views), 1)))
    return out


def cascade(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules, by falling rejections per second on about ``sample_rows`` rows; rules that reject none of them by rising cost.

    The rows are drawn from all partitions, whatever their length, and measured in their tasks; the driver gets a row for each task and rule, summed. A
    long text weighs by the time that it takes. An empty table leaves the rules as they are.
    """
    total = docs.select(F.lit(1)).count()
    if not total or not rules:
        return list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            got = measure(batch.column(0).to_pylist(), rules)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array([m.seconds * n for m in got]), pa.array([m.rejected * n for m in got])], ["rule", "seconds", "rejected"])

    drawn = docs.select(F.col(f"`{text_col}`").alias("t")).sample(min(1.0, sample_rows / total), 42)
    summed = drawn.mapInArrow(run, "rule int, seconds double, rejected double").groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected")).collect()
    found = {r["rule"]: Measured(rules[r["rule"]], r["seconds"], r["rejected"]) for r in summed}
    return [m.rule for m in sorted((found.get(k, Measured(r, 0.0, 0.0)) for k, r in enumerate(rules)), key=lambda m: (-m.worth, m.seconds))]


def first_rejection(v: View, ordered: list[Rule]) -> str | None:
    return next((r.name for r in ordered if r.rejects(v)), None)


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """For every row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null or empty text has no words and fails. Repeated rows each get a verdict; very long texts are judged whole; an empty table gives none;
    other columns are left aside. All measures are asked for here, so the order of rules decides only what else is computed; see
    ``keep_good`` for the cascade alone. The rows are independent: no shuffle.
    """
    ordered = cascade(docs, text_col, rules, sample_rows)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, failed, kept = [], [], []
            for t in batch.column(1):
                v = View(t.as_py())
                rows.append([getattr(v, n) for n in names])
                failed.append(base_failed(v))
                kept.append(not failed[-1] and first_rejection(v, ordered) is None)
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())], [id_col, *names, "base_failed", "kept"])

    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, whole, that no rule rejects. The rules alone decide, in their measured order, what is computed.

    A null or empty text is rejected as one without words. Repeated rows stay or go together; very long texts are judged whole; an empty
    table gives none; other columns, whatever their names, are as they were.
    """
    ordered = cascade(docs, text_col, rules, sample_rows)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [first_rejection(View(t.as_py()), ordered) is None for t in batch.column(at)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.select([F.col(f"`{c}`") for c in docs.columns]).mapInArrow(run, docs.schema)
