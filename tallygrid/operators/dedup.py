"""Deduplication policies. All take rows with an order; the survivor of each is defined, ties included.

The keyed policies are one window or one aggregate on their key. The smart policy compares each row with all survivors
before it, which is no equivalence, so it runs row by row, but only within blocks that no duplicate can cross: a project's trade
decides all its rules but equal text, so rows are first reduced by text and then split by trade.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.functions import classify
from tallygrid.operators import substrings
from tallygrid.session import spread


def first_of(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key; rows with null keys are one key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def by_digest(df: DataFrame, content: str, order: Sequence[str]) -> DataFrame:
    """The first row of each distinct content."""
    return first_of(df, [F.md5(content)], order)


def by_prefix(df: DataFrame, scope: Sequence[str], text: str, order: Sequence[str], length: int = 80) -> DataFrame:
    """The first row of each lower-cased prefix within its scope."""
    return first_of(df, [*scope, F.lower(F.substring(text, 1, length))], order)


def by_prefix_preferred(preferred: DataFrame, other: DataFrame, scope: Sequence[str], text: str, order: Sequence[str], length: int = 60) -> DataFrame:
    """Both inputs, of equal trimmed prefixes the first, and the preferred input's before the other's."""
    both = preferred.withColumn("_source", F.lit(0)).unionByName(other.withColumn("_source", F.lit(1)))
    return first_of(both, [*scope, F.trim(F.lower(F.substring(text, 1, length)))], ["_source", *order]).drop("_source")


def base_of(text: str) -> Column:
    """The last part of a description between bars, trimmed and lower-cased."""
    return F.lower(F.trim(F.element_at(F.split(text, "[|]", -1), -1)))


def by_base_longest(df: DataFrame, scope: Sequence[str], text: str, order: str) -> DataFrame:
    """Of each base the row with the longest text, the first of equals, in the place of the base's first row (``order`` is its new value).

    One aggregate: rows combine before they are shuffled, so a base with many rows is no burden.
    """
    row = F.struct(F.length(text).alias("_len"), (-F.col(order)).alias("_first"), F.struct(*df.columns).alias("row"))
    got = df.groupBy(*scope, base_of(text).alias("_base")).agg(F.max(row).alias("m"), F.min(order).alias("_at"))
    return got.select("m.row.*", "_at").withColumn(order, F.col("_at")).drop("_at")


def not_contained(new: DataFrame, old: DataFrame, scope: Sequence[str], text: str) -> DataFrame:
    """New rows whose lower-cased text no old text of the scope contains, by an index of pieces; a null text is contained in none."""
    low = lambda d: d.select(*scope, F.lower(text).alias("_low"))
    found = substrings.containing(low(new), low(old), scope, "_low", "_low").select(*scope, "needle").distinct()
    return new.join(found, [*(new[c].eqNullSafe(found[c]) for c in scope), F.lower(new[text]) == found["needle"]], "left_anti")


# Tags that show two descriptions to be of one thing.
SMART_TAGS = (r"(vfd\s*\d+[\s\-]*\d*)", r"(vfd\s*\d+)", r"(rtu[\s\-]*\d+)", r"(vav[\s\-]*\d+)", r"(s[\s\-]*\d+)", r"(light\s*[a-z])", r"(panel\s*[a-z])")


# Spellings, replaced in turn before descriptions are compared.
SMART_SPELLINGS = (("vfd ", "vfd"), ("vfd1-6", "vfd 1-6"), (" - ", "-"), (" / ", "/"))


def smart_text(text: str) -> str:
    t = re.sub(r"\s+", " ", text.lower().strip())
    for a, b in SMART_SPELLINGS:
        t = t.replace(a, b)
    return t


def smart_survivors(rows: list[tuple[str, str, float]]) -> list[tuple[int, str, float]]:
    """(index, description, confidence) of the rows (trade, description, confidence) that stay.

    A row is a duplicate of the first survivor with the same text, or with its trade and a shared tag, or one text within the other, or
    (both longer than 25) the same first 25 characters. If it says more than that survivor, the survivor takes its
    description and the higher confidence.
    """
    kept: list[list] = []  # index, trade, description, confidence, text, tags
    for i, (trade, said, sure) in enumerate(rows):
        text = smart_text(said)
        tags = {m for p in SMART_TAGS for m in re.findall(p, text)}
        for k in kept:
            other = k[4]
            if text == other:
                break
            if k[1] != trade:
                continue
            if tags & k[5] or text in other or other in text or (len(text) > 25 < len(other) and text[:25] == other[:25]):
                if len(text) > len(other):
                    k[2], k[3], k[4], k[5] = said, max(k[3], sure), text, tags
                break
        else:
            kept.append([i, trade, said, sure, text, tags])
    return [(k[0], k[2], k[3]) for k in kept]


def smart(items: DataFrame, scope: str, order: str = "seq") -> DataFrame:
    """The smart policy over ``items`` (scope, order, description, trade, confidence, ...), one trade of a scope (a project) at a time.

    Equal texts are reduced first, by one window over the texts as the policy compares them. Rows of different trades are duplicates by equal
    texts only, so after that the trades are independent, and what is left of one is its distinct descriptions.
    """
    named = items.withColumn("trade", classify.trade_name(F.col("trade")))
    norm = F.regexp_replace(F.regexp_replace(F.lower("description"), r"^\s+|\s+$", ""), r"\s+", " ")
    for a, b in SMART_SPELLINGS:
        norm = F.replace(norm, F.lit(a), F.lit(b))
    rows = items.count()
    single = first_of(spread(named.withColumn("_norm", norm), scope, "_norm", rows=rows), [scope, "_norm"], [order]).drop("_norm")

    def firsts(pdf: pd.DataFrame) -> list[int]:
        """Where the groups of a sorted table begin."""
        same = pd.Series(True, index=pdf.index)
        for c in (scope, "trade"):
            last = pdf[c].shift()
            same &= pdf[c].eq(last) | (pdf[c].isna() & last.isna())
        return [0, *(i for i, x in enumerate(same) if not x and i)]

    def survivors(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(pdf["trade"].fillna(""), pdf["description"].fillna(""), pdf["confidence"].fillna(0.0), strict=True))
        starts = firsts(pdf)
        kept = [(a + i, said, sure) for a, b in zip(starts, [*starts[1:], len(rows)], strict=True) for i, said, sure in smart_survivors(rows[a:b])]
        out = pdf.iloc[[k[0] for k in kept]].copy()
        out["description"], out["confidence"] = [k[1] for k in kept], [k[2] for k in kept]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None  # a group that may go on in the next batch
        for pdf in batches:
            both = (pdf if held is None else pd.concat([held, pdf])).reset_index(drop=True)
            last = firsts(both)[-1] if len(both) else 0
            if last:
                yield survivors(both.iloc[:last].reset_index(drop=True))
            held = both.iloc[last:]
        if held is not None and len(held):
            yield survivors(held.reset_index(drop=True))

    # sorted and read in order, so that many small groups cost no more than their rows
    return spread(single, scope, "trade", rows=rows).sortWithinPartitions(scope, "trade", order).mapInPandas(run, single.schema)
