"""Cutting texts: lines, blocks, chunks, sections, spans."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(df: DataFrame, keys: Sequence[str], text_col: str = "text", trim: bool = False, least: int = 0) -> DataFrame:
    """``keys``, pos, line: the lines of each text, numbered from 0 before short ones are left out."""
    out = df.select(*keys, F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    if trim:
        out = out.withColumn("line", F.trim("line"))
    return out.where(F.length("line") >= least) if least else out


def keyword_lines(pages: DataFrame, keys: Sequence[str], page: str, keywords: Sequence[str], most: int = 30, text_col: str = "text") -> DataFrame:
    """``keys``, n, line: the first ``most`` lines of each key, by page and place, that contain a keyword in any case, with their page in front."""
    from pyspark.sql import Window

    each = pages.select(*keys, page, F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    hit = F.lit(False)
    for w in keywords:
        hit = hit | F.contains(F.lower("line"), F.lit(w.lower()))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(page, "pos", "line"))
    found = each.where(hit).withColumn("n", n).where(F.col("n") <= most)
    return found.select(*keys, "n", F.concat(F.lit("Page "), F.col(page).cast("string"), F.lit(": "), F.trim("line")).alias("line"))


def compact(text: Column) -> Column:
    """The trimmed lines of a text without the empty ones."""
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def compact_lines(df: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """``keys``, pos, line: trimmed lines that are not empty, numbered anew."""
    return df.select(*keys, F.posexplode(compact(F.col(text_col))).alias("pos", "line"))


def joined(df: DataFrame, keys: Sequence[str], order_col: str, text_col: str = "text", separator: str = "\n") -> DataFrame:
    """``keys`` and ``text``: parts joined in order, empty ones left out."""
    parts = F.array_sort(F.collect_list(F.when(F.length(text_col) > 0, F.struct(order_col, text_col))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x[text_col]), separator).alias("text"))


def packed(parts: Column, sizes: Column, most: int, separator: int = 0) -> Column:
    """Greedy packing: for each part the number of its chunk, from 0, so that no chunk passes ``most`` unless one part does.

    A chunk's size is the sum of its parts' sizes and of ``separator`` for each but the first. Runs as one fold over the row.
    """
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, size: Column) -> Column:
        over = (acc["size"] + size > most) & (acc["size"] > 0)
        chunk = F.when(over, acc["chunk"] + 1).otherwise(acc["chunk"])
        fresh = over | (acc["size"] == 0)
        return F.struct(chunk.alias("chunk"), F.when(fresh, size).otherwise(acc["size"] + size + separator).cast("int").alias("size"), F.concat(acc["out"], F.array(chunk)).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def chunk_pages(pages: DataFrame, keys: Sequence[str], order_col: str, text_col: str = "text", most: int = 12_000, least: int = 100) -> DataFrame:
    """``keys``, chunk, first, last, text: pages of ``least`` trimmed characters packed in order into chunks of ``most``."""
    kept = pages.where(F.length(F.trim(text_col)) >= least)
    grouped = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("page"), F.col(text_col).alias("text")))).alias("pages"))
    numbered = grouped.withColumn("chunks", packed(F.col("pages"), F.transform("pages", lambda x: F.length(x["text"])), most))
    each = numbered.select(*keys, F.explode(F.arrays_zip("pages", "chunks")).alias("x")).select(*keys, F.col("x.chunks").alias("chunk"), F.col("x.pages.page").alias("page"), F.col("x.pages.text").alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("page", "text")))
    return each.groupBy(*keys, "chunk").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"))


def split_blocks(text: Column, most: int = 4000) -> Column:
    """Blocks of a text (between blank lines) packed in order into pieces; the separator does not count towards ``most``."""
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, block: Column) -> Column:
        over = F.length(acc["now"]) + F.length(block) > most
        done = F.when(over & (acc["now"] != ""), F.concat(acc["out"], F.array(acc["now"]))).otherwise(acc["out"])
        return F.struct(F.when(over, block).otherwise(F.concat(acc["now"], F.lit("\n\n"), block)).alias("now"), done.alias("out"))

    return F.aggregate(F.split(text, "\n\n", -1), start, step, lambda a: F.when(a["now"] != "", F.concat(a["out"], F.array(a["now"]))).otherwise(a["out"]))


def keep_longer(spans: Column) -> Column:
    """Greedy merge of ``array<struct<start, end, ...>>``: by start, an overlap replaces the last kept one only if it is longer."""
    ordered = F.array_sort(spans)

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        apart = F.size(acc).__eq__(0) | (x["start"] >= last["end"])
        longer = (x["end"] - x["start"]) > (last["end"] - last["start"])
        return F.when(apart, F.concat(acc, F.array(x))).when(longer, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x))).otherwise(acc)

    return F.aggregate(ordered, F.slice(ordered, 1, 0), step)


def merge_boxes(boxes: Column, share: float = 0.3) -> Column:
    """Boxes ``array<struct<y1, x1, y2, x2>>`` in reading order, each merged with the one before if they overlap enough."""
    ordered = F.array_sort(boxes)

    def step(acc: Column, b: Column) -> Column:
        a = F.try_element_at(acc, F.lit(-1))
        over = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])) * F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
        area = F.least((a["x2"] - a["x1"]) * (a["y2"] - a["y1"]), (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]))
        both = F.struct(F.least(a["y1"], b["y1"]).alias("y1"), F.least(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y2"], b["y2"]).alias("y2"), F.greatest(a["x2"], b["x2"]).alias("x2"))
        merge = (F.size(acc) > 0) & (area > 0) & (over / F.nullif(area, F.lit(0)) > share)
        return F.when(merge, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(both))).otherwise(F.concat(acc, F.array(b)))

    return F.aggregate(ordered, F.slice(ordered, 1, 0), step)


def layout_text(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Recognised words (block, par, line, word, text, conf) as a page's text and its mean positive confidence, 0 without any."""
    row = words.groupBy(*keys, "block", "par", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda x: x["text"]), " ").alias("row"),
        F.sum(F.when(F.col("conf") > 0, F.col("conf"))).alias("s"),
        F.count_if(F.col("conf") > 0).alias("n"),
    )
    return row.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "par", "line", "row"))), lambda x: x["row"]), "\n").alias("text"),
        F.coalesce(F.sum("s") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("confidence"),
    )


def spans(df: DataFrame, keys: Sequence[str], patterns: Sequence[tuple[str, str]], text_col: str = "text", flags: int = re.IGNORECASE) -> DataFrame:
    """``keys``, ord, name, start, end, match, groups: every match of every (pattern, name), with its place.

    The built-in functions give matches without places, so this runs in Arrow batches; each text is read once.
    """
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = [(o, n, re.compile(p, flags)) for o, (p, n) in enumerate(patterns)]
        for pdf in batches:
            out = []
            for *key, text in pdf.itertuples(index=False):
                for o, n, p in ready:
                    out += [(*key, o, n, m.start(), m.end(), m.group(), [g or "" for g in m.groups()]) for m in p.finditer(text or "")]
            yield pd.DataFrame(out, columns=[*keys, "ord", "name", "start", "end", "match", "groups"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", ord int, name string, start int, end int, match string, groups array<string>"
    return df.select(*keys, text_col).mapInPandas(run, schema)


def schedules(df: DataFrame, keys: Sequence[str], patterns: Sequence[tuple[str, str]], next_section: str, text_col: str = "text", merge: bool = True, least: int = 100) -> DataFrame:
    """``keys``, kind, start, end, section: schedule sections of each text.

    A section goes from a heading to 3000 characters on, or to the next heading 50 to 5000 characters on, which may also make it
    longer. Of overlapping ones the longer stays, unless ``merge`` is off. Sections of ``least`` characters or fewer are left out.
    """
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready, border = [(n, re.compile(p, re.IGNORECASE)) for p, n in patterns], re.compile(next_section, re.IGNORECASE)
        for pdf in batches:
            out = []
            for *key, text in pdf.itertuples(index=False):
                text, found = text or "", []
                for n, p in ready:
                    for m in p.finditer(text):
                        s = m.start()
                        stop = border.search(text[s + 50 : s + 5000])
                        e = min(s + 50 + stop.start() if stop else s + 3000, len(text))
                        if e - s > least:
                            found.append((s, e, n))
                out += [(*key, n, s, e, text[s:e]) for s, e, n in (longer_of(found) if merge else found)]
            yield pd.DataFrame(out, columns=[*keys, "kind", "start", "end", "section"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", kind string, start int, end int, section string"
    return df.select(*keys, text_col).mapInPandas(run, schema)


def longer_of(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """``keep_longer`` for plain tuples; equal starts keep their order."""
    out: list[tuple[int, int, str]] = []
    for x in sorted(found, key=lambda s: s[0]):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
        elif x[1] - x[0] > out[-1][1] - out[-1][0]:
            out[-1] = x
    return out
