"""The takeoff pipelines: from pages of files to line items, for all projects in one plan.

pages(project_id, file_id, file_name, file_type, page_number, text) -> items(project_id, seq, description, trade, quantity,
unit, confidence, source_reference). Per-file parsers run in parallel by file; the rest is relational and keyed by project.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.functions import classify, false_positives, fixed, patterns, salvage
from tallygrid.operators import context, dedup, generators, parsers, rules, segment
from tallygrid.session import shuffled, spread

ITEM = ["description", "trade", "quantity", "unit", "confidence", "source_reference"]
PAGE_KEYS = ["project_id", "file_id", "page_number"]
FILE_KEYS = ["project_id", "file_id", "file_name", "file_type"]


def file_texts(pages: DataFrame, separator: str = "\n") -> DataFrame:
    """Each file's pages, in order, as one text."""
    return segment.joined(spread(pages, *FILE_KEYS), FILE_KEYS, "page_number", "text", separator)


def _staged(items: DataFrame, stage: int, order: list[str]) -> DataFrame:
    """Items with the columns that order them among all stages."""
    return items.select("project_id", F.lit(stage).alias("_stage"), F.array(*(F.col(c).cast("string") for c in order)).alias("_order"), *ITEM)


def _sequenced(items: DataFrame, rows: int = 0) -> DataFrame:
    """``seq`` from the stage and the order within it; of about ``rows`` rows."""
    w = Window.partitionBy("project_id").orderBy("_stage", "_order", "description")
    return spread(items, "project_id", rows=rows).withColumn("seq", F.row_number().over(w).cast("long")).select("project_id", "seq", *ITEM)


_TEXT_KEYS = ["project_id", "file_id", "file_name"]


def _of_files(got: DataFrame, stage: int, part: int = 0) -> DataFrame:
    """Items that are numbered within their file, as rows of a stage; the parts of a stage follow each other within a file."""
    return _staged(got.withColumn("source_reference", F.col("file_name")).withColumn("_at", F.format_string(f"{part}%010d", "seq")), stage, ["file_id", "_at"])


def _from_files(files: DataFrame, items: Callable[[Column, Column], Column], stage: int) -> DataFrame:
    return _of_files(rules.itemize(files, _TEXT_KEYS, items), stage)


def general_items(files: DataFrame, stage: int) -> DataFrame:
    """Files' schedule rows, floors, and running text where a file has no schedule; trades are set later, from the description."""
    sections = segment.schedules(files, _TEXT_KEYS, fixed.SCHEDULE_PATTERNS, fixed.NEXT_SECTION)
    row = sections.select(*_TEXT_KEYS, "kind", "start", F.posexplode(generators.schedule_rows(F.col("section"))).alias("i", "description"))
    row = row.select(*_TEXT_KEYS, (F.col("start").cast("long") * 100_000 + F.col("i")).alias("seq"), "description", F.concat(F.lit("?"), "kind").alias("trade"), F.lit(1.0).alias("quantity"), F.lit("EA").alias("unit"), F.lit(0.75).alias("confidence"))
    floors = rules.itemize(files, _TEXT_KEYS, generators.flooring)
    bare = files.join(shuffled(sections.select(*_TEXT_KEYS).distinct()), _TEXT_KEYS, "left_anti")
    told = rules.itemize(bare, _TEXT_KEYS, lambda text, upper: rules.items_of(text, upper, generators.GENERAL_TEXT))
    return _of_files(row, stage, 0).unionByName(_of_files(floors, stage, 1)).unionByName(_of_files(told, stage, 2))


def _named_trades(items: DataFrame) -> DataFrame:
    """Trades that wait for classification (marked with the schedule's kind) set from description and kind."""
    said = F.concat("description", F.lit(" "), F.substring("trade", 2, 100))
    return items.withColumn("trade", F.when(F.startswith("trade", F.lit("?")), classify.trade(said)).otherwise(F.col("trade")))


def has_any(text: str, words: tuple[str, ...]) -> Column:
    return classify.any_of(F.upper(text), words)


def default_items(pages: DataFrame, llm_filter: Callable[[list[str]], list[bool]] | None = None) -> DataFrame:
    """The default pipeline: context of drawings, files, filter, dedup, inference, dedup, and a plugged-in filter if one is given."""
    rows = pages.count()
    pages = spread(pages, *PAGE_KEYS, rows=rows)
    drawings = pages.where(F.contains(F.lower("file_type"), F.lit("drawing")))
    legend = parsers.finish_legend(drawings, PAGE_KEYS)
    rooms = parsers.room_schedule(drawings, PAGE_KEYS)
    tagged = parsers.equipment(drawings, PAGE_KEYS)
    at = ["file_id", "page_number", "pos"]
    files = file_texts(pages, "\n\n")
    plain = file_texts(pages).where("file_type = 'drawing'")
    stages = [
        _staged(context.legend_items(legend, rooms, ["project_id"], at), 1, at),
        _staged(context.room_items(rooms, legend, ["project_id"], at), 2, ["trade", "description"]),
        _staged(context.equipment_items(tagged, ["project_id"], at), 3, at),
        general_items(files, 4),
        _from_files(files.where("file_type in ('spec', 'addendum')"), lambda text, upper: rules.items_of(text, upper, generators.SPEC_SECTIONS), 5),
        _from_files(plain.where(has_any("text", fixed.MECHANICAL_GATES)), generators.mechanical, 6),
        _from_files(plain.where(has_any("text", fixed.ELECTRICAL_GATES)), generators.electrical, 7),
    ]
    every = stages[0]
    for s in stages[1:]:
        every = every.unionByName(s)
    items = rules.drop_matching(_named_trades(_sequenced(every, rows)), false_positives.FALSE_POSITIVES)
    items = dedup.by_base_longest(items, ["project_id", "trade"], "description", "seq")
    at = lambda d: d.withColumn("at", F.format_string("%012d", "seq"))
    both = _sequenced(_staged(at(items), 0, ["at"]).unionByName(_staged(at(inferred_items(pages)), 1, ["at"])), rows)
    out = dedup.by_base_longest(both, ["project_id", "trade"], "description", "seq")
    return out if llm_filter is None else plugged_filter(out, llm_filter)


#: Characters around a page, of at most so many pages before and after it, that a match in it may look at.
MARGIN, NEIGHBOURS = 600, 8


def with_margins(pages: DataFrame, margin: int = MARGIN) -> DataFrame:
    """``project_id``, page, text, start, end: each page with the ends of its neighbours' texts, and where it begins and ends in that.

    A margin goes on over short pages, ``NEIGHBOURS`` of them at most. Pages stand in the order of the joined project; empty ones are left out. Only the ends of pages meet in a window, not the texts.
    """
    kept = pages.where(F.length("text") > 0)
    w = Window.partitionBy("project_id").orderBy("page_number", "text_hash", "file_id")
    ends = kept.select("project_id", "file_id", "page_number", F.md5("text").alias("text_hash"), F.right("text", F.lit(margin)).alias("tail"), F.left("text", F.lit(margin)).alias("head"))
    before, after = F.collect_list("tail").over(w.rowsBetween(-NEIGHBOURS, -1)), F.collect_list("head").over(w.rowsBetween(1, NEIGHBOURS))
    cut = {"before": F.right(F.array_join(before, "\n"), F.lit(margin)), "after": F.left(F.array_join(after, "\n"), F.lit(margin))}
    ends = ends.withColumns({**{k: F.nullif(v, F.lit("")) for k, v in cut.items()}, "page": F.row_number().over(w)}).drop("tail", "head")
    # equal pages of a file have equal places
    ends = ends.dropDuplicates(["project_id", "file_id", "page_number", "text_hash"])
    met = kept.select("project_id", "file_id", "page_number", "text", F.md5("text").alias("text_hash")).dropDuplicates(["project_id", "file_id", "page_number", "text_hash"])
    both = met.join(shuffled(ends), ["project_id", "file_id", "page_number", "text_hash"])
    before, after = (F.coalesce(x, F.lit("")) for x in (F.concat("before", F.lit("\n")), F.concat(F.lit("\n"), "after")))
    return both.select("project_id", "page", F.concat(before, "text", after).alias("text"), F.length(before).alias("start"), (F.length(before) + F.length("text")).alias("end"))


def inferred_items(pages: DataFrame) -> DataFrame:
    """What the whole text of a project implies (floors, transitions, words that stand together anywhere in it), and the items that every project has.

    No project is joined into one row: floors and transitions are found page by page, with the ends of the pages before and after; words
    are flags of pages, combined by project; a mat that is named twice is counted over pages. Equal items are one.
    """
    at = (F.col("text"), F.col("upper"), F.col("start"), F.col("end"))
    pages = spread(pages, *PAGE_KEYS)
    both = spread(with_margins(pages), "project_id", "page").withColumn("upper", F.upper("text"))
    near = both.select("project_id", "page", F.posexplode(F.concat(generators.floors(*at), generators.transitions(*at))).alias("seq", "x")).select("project_id", "page", F.col("seq").cast("long").alias("seq"), "x.*")
    near = near.select("project_id", F.lit(1).alias("kind"), F.col("page").cast("long").alias("a"), F.col("seq").alias("b"), *ITEM[:5])
    upper = F.upper(F.coalesce("text", F.lit("")))
    needs = {w for r in generators.INFERRED for w in r.needs}
    names = {w: f"n{i}" for i, w in enumerate(sorted(needs))}
    mats = [F.when(patterns.may_have(F.col("text"), upper, p), F.regexp_count("text", F.lit(f"(?i){p}"))) for p, _ in generators.MATS]
    counted = pages.groupBy("project_id").agg(
        *(F.bool_or(classify.any_of(upper, w)).alias(n) for w, n in names.items()),
        *(F.sum(F.coalesce(m, F.lit(0))).alias(f"m{i}") for i, m in enumerate(mats)),
        *(F.sum((F.length(upper) - F.length(F.replace(upper, F.lit(name.upper()), F.lit("")))) / len(name)).alias(f"k{i}") for i, (_, name) in enumerate(generators.MATS)),
    )
    rows = [F.when((F.col(f"m{i}") > 0) & (F.col(f"k{i}") >= 2), _item(2, i, (name, "Flooring", None, "EA", 0.5))) for i, (_, name) in enumerate(generators.MATS)]
    for i, r in enumerate(generators.INFERRED):
        every = F.lit(True)
        for w in r.needs:
            every = every & F.col(names[w])
        rows.append(F.when(every, _item(3, i, (r.describe, r.trade, None, r.unit, r.confidence))))
    rows += [_item(4, i, x) for i, x in enumerate(generators.CONSTANTS)]
    flags = counted.select("project_id", F.explode(F.array_compact(F.array(*rows))).alias("x")).select("project_id", "x.*")
    once = near.unionByName(flags).groupBy("project_id", *ITEM[:5]).agg(F.min(F.struct("kind", "a", "b")).alias("first"))
    w = Window.partitionBy("project_id").orderBy("first")
    return once.withColumn("seq", F.row_number().over(w).cast("long")).select("project_id", "seq", *ITEM[:5], F.lit("project_context").alias("source_reference"))


def _item(kind: int, at: int, item: tuple) -> Column:
    said, trade, quantity, unit, confidence = item
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(at).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(said).alias("description"), F.lit(trade).alias("trade"),
        F.lit(quantity).cast("double").alias("quantity"), F.lit(unit).cast("string").alias("unit"), F.lit(confidence).cast("double").alias("confidence"),
    )


def rule_items(pages: DataFrame) -> DataFrame:
    """The second rule pipeline: context, parsers by file type, mechanical and electrical parts of every drawing, filter, prefix dedup."""
    rows = pages.count()
    pages = spread(pages, *PAGE_KEYS, rows=rows)
    drawings = pages.where("file_type = 'drawing'")
    legend, rooms, tagged = parsers.finish_legend(drawings, PAGE_KEYS), parsers.room_schedule(drawings, PAGE_KEYS), parsers.equipment(drawings, PAGE_KEYS)
    at, files = ["file_id", "page_number", "pos"], file_texts(pages)
    drawn = files.where("file_type = 'drawing'")
    paint = legend.where(F.startswith("code", F.lit("PNT")))
    every = _staged(context.legend_items(paint, rooms, ["project_id"], at), 1, at)
    every = every.unionByName(_staged(context.room_items(rooms, legend, ["project_id"], at).where("trade <> 'Ceilings' or description like '%CL-03%'"), 2, ["trade", "description"]))
    every = every.unionByName(_staged(context.equipment_items(tagged, ["project_id"], at), 3, at))
    for k, kind in enumerate(("spec", "drawing", "sow", "addendum")):
        every = every.unionByName(_from_files(files.where(F.col("file_type") == kind), generators.lines_by_type(kind), 10 + k))
    every = every.unionByName(_from_files(files.where("file_type not in ('spec', 'drawing', 'sow', 'addendum')"), generators.generic_lines, 14))
    every = every.unionByName(_from_files(drawn, generators.mechanical, 20)).unionByName(_from_files(drawn, generators.electrical, 21))
    items = rules.drop_matching(_sequenced(every, rows), false_positives.FALSE_POSITIVES_V2)
    return dedup.by_prefix(items, ["project_id", "trade"], "description", ["seq"])


def context_items(pages: DataFrame) -> DataFrame:
    """Context only: legends, rooms, equipment and callouts of drawings, fused by code and height."""
    rows = pages.count()
    pages = spread(pages, *PAGE_KEYS, rows=rows)
    drawings = pages.where("file_type = 'drawing'").withColumn("types", classify.page_types(F.col("text")))
    of = lambda kind: drawings.where(F.array_contains("types", kind)).drop("types")
    legend, rooms = parsers.finish_legend(of("finish_legend"), PAGE_KEYS, v2=True), parsers.room_schedule(of("room_schedule"), PAGE_KEYS, v2=True)
    fused = context.fusion_items(rooms, legend, ["project_id"], ["file_id", "page_number", "pos"])
    every = _staged(fused, 1, ["part", "code", "height"])
    units = lambda t: [(f"{x[0]}: {x[2]} {x[3]} ({x[1]})", "Mechanical", None, "EA", 0.9) for x in parsers.equipment_rows_v2(t)]
    every = every.unionByName(_of_files(rules.generate(of("equipment_schedule"), _TEXT_KEYS, units), 2))
    every = every.unionByName(_from_files(drawings, generators.callouts_v2, 3))
    return dedup.first_of(_sequenced(every, rows), ["project_id", "trade", F.lower("description")], ["seq"])


# Headings of pages that a language model would read too; the first of them wins.
CRITICAL = ("VAV TERMINAL UNIT SCHEDULE", "AC/HP SCHEDULE", "LIGHTING FIXTURE SCHEDULE", "ELECTRICAL PANEL SCHEDULE")


def critical_pages(pages: DataFrame) -> DataFrame:
    """Pages with a critical heading, any case, and the first such heading as ``kind``; one row a page."""
    return pages.withColumn("kind", classify.first_hit(F.upper("text"), [(h, (h,)) for h in CRITICAL], "")).where("kind <> ''")


def combined_items(pages: DataFrame, extract: Callable[[str], list[dict]] | None = None, most_chars: int = 12_000) -> DataFrame:
    """Rule items with those of a plugged-in extractor over critical pages, which are preferred; without one, the rule items.

    A page is sent whole, in pieces of at most ``most_chars`` characters, a call a piece.
    """
    by_rule = rule_items(pages)
    if extract is None:
        return by_rule
    starts = F.sequence(F.lit(1), F.length("text"), F.lit(most_chars))
    pieces = F.transform(starts, lambda i: F.substring(F.col("text"), i, F.lit(most_chars)))
    said = plugged_extractor(critical_pages(pages).select("project_id", "file_name", F.explode(pieces).alias("text")), extract)
    return dedup.by_prefix_preferred(said, by_rule, ["project_id", "trade"], "description", ["seq"])


def plugged_extractor(texts: DataFrame, extract: Callable[[str], list[dict]]) -> DataFrame:
    """Items that a function (a language model behind it, say) finds in texts; a call that fails gives none."""

    def parse(text: str) -> list[tuple]:
        try:
            found = extract(text)
        except Exception:  # one bad answer must not end a job over a whole corpus
            return []
        good = [x for x in found if x.get("description") and not any(w in x["description"].upper() for w in ("PLACEHOLDER", "API_KEY"))]
        return [(x["description"], x.get("trade") or "Other", x.get("quantity"), x.get("unit"), x.get("confidence", 0.5)) for x in good]

    got = rules.generate(texts, ["project_id", "file_name"], parse)
    return got.select("project_id", "seq", "description", "trade", "quantity", "unit", "confidence", F.col("file_name").alias("source_reference"))


# What a model is asked for, by the kind of a chunk.
CHUNK_ASKS = {
    "diffuser": "diffusers, registers and grilles, with tag, size, flow, material and maker",
    "vav": "terminal units, with tag, flow, maker and model",
    "rtu": "rooftop units, with tag, flow, voltage, maker and model",
    "lighting": "lighting fixtures, with tag, description, maker and model",
    "panel": "panels and breakers, with tag, rating and voltage",
    "equipment": "units of equipment, with tag, type, maker and model",
    "door": "doors, with number, size, material and hardware",
    "finish": "finishes, with code, material, maker, product and color",
}


def chunk_prompt(kind: str, text: str, file_name: str = "") -> str:
    """A prompt for one chunk, by its kind."""
    return f'List the {CHUNK_ASKS.get(kind, "construction items")} in this text as JSON {{"items": [...]}}.\nFILE: {file_name}\n\n{text}'


def chunk_items(chunks: DataFrame, ask: Callable[[str], str], keys: list[str], attempts: int = 5, wait: float = 2.0) -> DataFrame:
    """Items of ``chunks(keys, kind, section)`` by a plugged-in model: ``keys``, seq and item columns.

    A call that raises is tried again, ``attempts`` times in all, after ``wait``, 2 * ``wait``, 4 * ``wait`` ... seconds; then, and for an answer that has no
    items, the chunk gives none.
    """

    def parse(text: str, kind: str) -> list[tuple]:
        for k in range(attempts):
            try:
                said = ask(chunk_prompt(kind, text))
                break
            except Exception:  # a model may fail in any way; the next attempt may not
                if k + 1 < attempts:
                    time.sleep(wait * 2**k)
        else:
            return []
        return [(x["description"], x["trade"] or "Other", x["quantity"], x["unit"], x["confidence"]) for x in salvage.items(said)]

    return rules.generate(chunks, keys, parse, text_col="section", extra=["kind"])


def plugged_filter(items: DataFrame, keep: Callable[[list[str]], list[bool]], batch: int = 50, on_error: str = "keep") -> DataFrame:
    """Items that a function keeps, called with ``batch`` descriptions at a time; ``on_error`` 'keep' or 'drop' says what a failed call means."""
    if on_error not in ("keep", "drop"):
        raise ValueError("on_error is keep or drop")

    def run(batches):
        for pdf in batches:
            stays: list[bool] = []
            for k in range(0, len(pdf), batch):
                part = pdf["description"].iloc[k : k + batch].tolist()
                try:
                    got = list(keep(part))
                    stays += got if len(got) == len(part) else [on_error == "keep"] * len(part)
                except Exception:
                    stays += [on_error == "keep"] * len(part)
            yield pdf[pd.Series(stays, index=pdf.index, dtype=bool)]

    return items.mapInPandas(run, items.schema)


def extract_project(pages: DataFrame, mode: str = "default") -> DataFrame:
    """Line items of all projects in ``pages`` by one of the pipelines."""
    return {"default": default_items, "rules": rule_items, "context": context_items, "combined": combined_items}[mode](pages)
