"""Rules as data: one engine for flags, matches, counts and pairs over tables of rules, and one for rules that make items.

A short rule table becomes literals; a longer one is joined in broadcast blocks of bounded size (``MOST_RULES``). Rules that make items become columns too, with
the characters around a match where they look at these; ``generate`` is for parsers that no column can express.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions import classify, patterns

#: Rules that become literals of the plan, and rules of a block that is broadcast beyond.
MOST_LITERALS, MOST_RULES = 200, 10_000
ITEM = "description string, trade string, quantity double, unit string, confidence double"


def apply_rules(docs: DataFrame, rules: DataFrame, mode: str, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """``rules(ord, name, pattern, grp)`` on each text, by ``mode``:

    flag   keys, ord, name: the rule is found
    each   keys, ord, name, hit: every match's group
    count  keys, ord, name, hit, n: every distinct match and how often
    pairs  keys, first, second: two different rules found in one text, in rule order
    """
    few = rules.select("ord", "name", "pattern", "grp").limit(MOST_LITERALS + 1).collect()
    text = docs.select(*keys, F.col(text_col).alias("_text"))
    if len(few) <= MOST_LITERALS:
        # literal patterns are compiled once, and a text meets all rules in one pass of the plan
        one = [F.when(F.col("_text").rlike(r["pattern"]), F.struct(*(F.lit(r[c]).alias(c) for c in ("ord", "name", "pattern", "grp")), (F.regexp_extract_all("_text", F.lit(r["pattern"]), F.lit(r["grp"])) if mode in ("each", "count") else F.lit(None).cast("array<string>")).alias("hits"))) for r in few]
        met = text.withColumn("_met", F.explode(F.array_compact(F.array(*one)))).select(*keys, "_met.*") if one else text.limit(0).selectExpr(*keys, "0 AS ord", "'' AS name", "'' AS pattern", "0 AS grp", "array('') AS hits")
    else:
        met = _by_blocks(text, rules).withColumn("hits", F.regexp_extract_all("_text", F.col("pattern"), F.col("grp")))
    if mode == "flag":
        return met.select(*keys, "ord", "name")
    if mode == "pairs":
        names = met.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("ord", "name"))).alias("r"))
        two = F.flatten(F.transform("r", lambda a, i: F.transform(F.slice("r", i + 2, F.size("r")), lambda b: F.struct(a["name"].alias("first"), b["name"].alias("second")))))
        return names.select(*keys, F.explode(two).alias("p")).select(*keys, "p.first", "p.second")
    each = met.select(*keys, "ord", "name", F.explode("hits").alias("hit"))
    if mode == "each":
        return each
    if mode == "count":
        return each.groupBy(*keys, "ord", "name", "hit").agg(F.count(F.lit(1)).alias("n"))
    raise ValueError(f"no such mode: {mode}")


def _by_blocks(text: DataFrame, rules: DataFrame, block: int = MOST_RULES) -> DataFrame:
    """Texts with the rules they meet; each block of rules, by hash, is small enough to be broadcast, and there are as many blocks as are needed."""
    n = rules.count() // (block // 2) + 1
    dealt = rules.withColumn("_b", F.pmod(F.xxhash64("ord", "name", "pattern"), F.lit(n)))
    out = None
    for b in range(n):
        part = text.join(F.broadcast(dealt.where(F.col("_b") == b).drop("_b")), F.expr("_text RLIKE pattern"))
        out = part if out is None else out.unionByName(part)
    return out


def found_any(text: Column, patterns: Sequence[str], ignore_case: bool = True) -> Column:
    """Whether any pattern is found, as one alternation that is compiled once."""
    return text.rlike(("(?i)" if ignore_case else "") + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def drop_matching(items: DataFrame, patterns: Sequence[str], text_col: str = "description", ignore_case: bool = True) -> DataFrame:
    """Items in whose description no pattern is found, in any case unless told otherwise; a null description stays."""
    return items.where(~F.coalesce(found_any(F.col(text_col), patterns, ignore_case), F.lit(False)))


def filter_by_rules(items: DataFrame, rules: Sequence[dict], defaults: Sequence[tuple[str, str]], text_col: str = "description") -> DataFrame:
    """Rules ``{pattern, action}`` as data: only ``remove`` acts; a pattern that is no regular expression is searched as text."""
    rules = list(rules) or [{"pattern": p, "action": "remove"} for p, _ in defaults]
    good, plain = [], []
    for r in rules:
        if r.get("pattern") and r.get("action", "keep") == "remove":
            try:
                re.compile(r["pattern"])
                good.append(r["pattern"])
            except re.error:
                plain.append(r["pattern"].lower())
    hit = found_any(F.col(text_col), good)
    for p in plain:
        hit = hit | F.contains(F.lower(text_col), F.lit(p))
    return items.where(~F.coalesce(hit, F.lit(False)))


def learn_rules(ask: Callable[[list[str], list[str]], list[dict]] | None, wrong: Sequence[str], right: Sequence[str], defaults: Sequence[tuple[str, str]], most: int = 40) -> list[dict]:
    """Filter rules from examples: those that ``ask`` (a language model behind it, say) makes of at most ``most`` wrong and right descriptions.

    Answers without a pattern are left out. Without ``ask``, without wrong examples, after a failed call and after an empty answer the defaults hold.
    """
    usual = [{"pattern": p, "action": "remove", "reason": why} for p, why in defaults]
    if ask is None or not wrong:
        return usual
    try:
        said = ask(list(wrong)[:most], list(right)[:most])
    except Exception:  # a model that is out of reach must not end the job
        return usual
    return [r for r in said or () if isinstance(r, dict) and r.get("pattern")] or usual


@dataclass(frozen=True)
class Rule:
    """One rule that makes items of a text.

    mode      each: an item a match; count: an item a distinct match, with its number as quantity; flag or first: one item, for the first match
    describe  a template of the match's groups ({0} the whole), or a function of the match that gives a column; null or '' gives no item
    needs     sets of words: of each set, one must be in the text (any case)
    before, after   characters around a match that ``describe`` looks at
    """

    trade: str
    unit: str | None
    confidence: float
    describe: str | Callable[[patterns.Found], Column]
    pattern: str = ""
    mode: str = "each"
    needs: tuple[tuple[str, ...], ...] = ()
    flags: int = re.IGNORECASE
    before: int = 0
    after: int = 0

    def items(self, text: Column, upper: Column) -> Column:
        """The rule's items for a text, whose upper-cased form is ``upper``, as an array."""
        return self._given(upper, self._all(text, upper))

    def _given(self, upper: Column, items: Column) -> Column:
        for words in self.needs:
            items = F.when(classify.any_of(upper, words), items).otherwise(no_items())
        return items

    def _item(self, said: Column, quantity: Column | None = None) -> Column:
        return item(said, self.trade, quantity, self.unit, self.confidence)

    def _all(self, text: Column, upper: Column) -> Column:
        if not self.pattern:
            return F.array(self._item(F.lit(self.describe)))
        if self.mode in ("flag", "first") and isinstance(self.describe, str) and "{" not in self.describe:
            hit = patterns.may_have(text, upper, self.pattern, self.flags) & patterns.has(text, self.pattern, self.flags)
            return F.when(hit, F.array(self._item(F.lit(self.describe)))).otherwise(no_items())
        every = F.transform(patterns.found(text, self.pattern, self.flags, self.before, self.after, upper), lambda m: self.said(patterns.Found(m)))
        said = F.filter(every, lambda d: F.coalesce(d != "", F.lit(False)))
        if self.mode == "count":
            return classify.once(said, lambda all_said: F.transform(F.array_distinct(all_said), lambda d: self._item(d, F.size(F.filter(all_said, lambda x: x == d)).cast("double"))))
        said = said if self.mode == "each" else F.slice(said, 1, 1)
        return F.transform(said, lambda d: self._item(d))

    def said(self, m: patterns.Found) -> Column:
        return self.describe(m) if callable(self.describe) else patterns.stripped(filled(self.describe, m))


def filled(template: str, m: patterns.Found) -> Column:
    """A template with the groups of a match in it."""
    parts = re.split(r"\{(\d+)\}", template)
    return F.concat(*(m[int(p)] if k % 2 else F.lit(p) for k, p in enumerate(parts) if k % 2 or p))


def item(said: Column, trade: Column | str, quantity: Column | float | None, unit: Column | str | None, confidence: float) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        said.alias("description"), as_col(trade).cast("string").alias("trade"), as_col(quantity).cast("double").alias("quantity"),
        as_col(unit).cast("string").alias("unit"), F.lit(confidence).cast("double").alias("confidence"),
    )


def no_items() -> Column:
    return F.array().cast(f"array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>")


def items_of(text: Column, upper: Column, rules: Sequence[Rule]) -> Column:
    """All items that the rules give for a text, rule by rule, as an array."""
    return F.concat(no_items(), *(r.items(text, upper) for r in rules))


def itemize(docs: DataFrame, keys: Sequence[str], items: Callable[[Column, Column], Column], text_col: str = "text") -> DataFrame:
    """``keys``, seq and item columns: what ``items``, an array for the text and its upper-cased form, gives for each text, numbered within the text.

    All of it is columns, so texts stay in the JVM; a null text is an empty one.
    """
    held = docs.select(*keys, F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_upper", F.upper("_text"))
    out = held.select(*keys, F.posexplode(items(F.col("_text"), F.col("_upper"))).alias("seq", "_item"))
    return out.select(*keys, F.col("seq").cast("long").alias("seq"), "_item.*")


def generate(docs: DataFrame, keys: Sequence[str], generate_items: Callable[..., list[tuple]], text_col: str = "text", extra: Sequence[str] = ()) -> DataFrame:
    """``keys``, seq and item columns: what ``generate_items`` gives for each text (and the values of ``extra``), numbered within the text."""
    kinds = dict(docs.dtypes)
    names = ["description", "trade", "quantity", "unit", "confidence"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = len(keys)
            out = [(*row[:n], i, *item) for row in pdf.itertuples(index=False, name=None) for i, item in enumerate(generate_items(row[n] or "", *row[n + 1 :]))]
            got = pd.DataFrame(out, columns=[*keys, "seq", *names])
            yield got.astype({"quantity": "float64", "confidence": "float64"})

    return docs.select(*keys, text_col, *extra).mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", seq long, {ITEM}")
