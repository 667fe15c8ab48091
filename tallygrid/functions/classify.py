"""Classification expressions. Each takes its rules as data and builds one expression from them at plan time, so rules
stay data and the plan stays inside code generation: no join, no shuffle, no user-defined function."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallygrid.functions import fixed

Rules = Sequence[tuple[str, Sequence[str]]]


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row, however often ``f`` refers to it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def any_of(text: Column, words: Sequence[str]) -> Column:
    """Whether a text contains one of ``words`` as a substring."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def n_present(text: Column, words: Sequence[str]) -> Column:
    """How many of ``words`` a text contains."""
    out = F.lit(0)
    for w in words:
        out = out + F.contains(text, F.lit(w)).cast("int")
    return out


def occurrences(text: Column, word: str) -> Column:
    """How often ``word`` occurs in a text, without overlaps; by bytes, whose number a string knows."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(word), F.lit("")))) / len(word.encode())


def _quoted(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def _trie(words: Sequence[str]) -> str:
    """A pattern of the longest of ``words`` that begins where it is applied; words that begin alike share their beginning, so that a place is given up early."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    parts = []
    for head, tails in sorted(heads.items()):
        while all(tails) and len({t[0] for t in tails}) == 1:
            head, tails = head + tails[0][0], [t[1:] for t in tails]
        rest = _trie(tails) if any(tails) else ""
        parts.append(_quoted(head) + (f"(?:{rest})" + "?" * ("" in tails) if rest else ""))
    return "|".join(parts)


def spotted(text: Column, words: Sequence[str]) -> Column:
    """The words that begin at the places of a text, in order, as an array: at each place the longest one. One pass over the text, however many words there are."""
    words = sorted(set(words))
    letters = ("".join(sorted({_quoted(w[k]) for w in words})) for k in range(min(2, *map(len, words))))
    return F.regexp_extract_all(text, F.lit(f"(?={''.join(f'[{x}]' for x in letters)})(?=({_trie(words)}))"), F.lit(1))


def _overlaps(word: str) -> bool:
    """Whether two occurrences of a word can share letters."""
    return any(word.startswith(word[k:]) for k in range(1, len(word)))


def count_of(text: Column, spots: Column, words: Sequence[str], every: Sequence[str]) -> Column:
    """How often ``words`` occur in a text, each without overlaps, by the ``spots`` of ``every`` word in it.

    A spot is one occurrence of each word that it begins with. A word that can overlap itself, and is spotted more than once, is counted again on the text.
    """
    worth: dict[int, list[str]] = {}
    for s in set(every):
        if n := sum(s.startswith(w) for w in words):
            worth.setdefault(n, []).append(s)
    out = F.lit(0.0)
    for n, some in sorted(worth.items()):
        out = out + n * F.size(F.filter(spots, lambda x: x.isin(some)))
    for w in filter(_overlaps, words):
        met = F.size(F.filter(spots, lambda x: F.startswith(x, F.lit(w))))
        out = out + F.when(met > 1, occurrences(text, w) - met).otherwise(0.0)
    return out


def first_hit(text: Column, rules: Rules, default: str) -> Column:
    """The first class of which a keyword is contained."""
    out = None
    for name, words in rules:
        out = F.when(any_of(text, words), name) if out is None else out.when(any_of(text, words), name)
    return F.lit(default) if out is None else out.otherwise(default)


def by_prefix(code: Column, rules: Rules, default: Column) -> Column:
    """The first class that has a prefix of the code."""
    out = None
    for name, prefixes in rules:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.startswith(code, F.lit(p))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return default if out is None else out.otherwise(default)


def best_score(scores: Sequence[tuple[str, Column]], default: str) -> Column:
    """The class with the largest positive score, the earlier of equals."""
    entries = F.array(*(F.struct(s.cast("double").alias("score"), F.lit(-k).alias("order"), F.lit(name).alias("name")) for k, (name, s) in enumerate(scores)))
    best = F.array_max(entries)
    return F.when(best["score"] > 0, best["name"]).otherwise(default)


def by_count(text: Column, rules: Rules, default: str = "Other") -> Column:
    """The class whose keywords occur most often in sum; the text is read once for all keywords."""
    every = [w for _, words in rules for w in words]

    def best(lower: Column) -> Column:
        return once(spotted(lower, every), lambda spots: best_score([(name, count_of(lower, spots, words, every)) for name, words in rules], default))

    return once(F.lower(text), best)


def by_presence(text: Column, rules: Rules, default: str = "Other") -> Column:
    """The class of which most keywords are present."""
    return once(F.lower(text), lambda lower: best_score([(name, n_present(lower, words)) for name, words in rules], default))


# the domain's classifiers


def file_type(name: Column) -> Column:
    return first_hit(F.lower(name), fixed.FILE_TYPES, "other")


def file_type_listing(name: Column) -> Column:
    return first_hit(F.lower(name), fixed.FILE_TYPES_LISTING, "other")


def is_project_file(name: Column) -> Column:
    """Whether a file may hold items, by its name."""
    return ~any_of(F.lower(name), fixed.NON_PROJECT_NAMES)


def trade(text: Column) -> Column:
    """Brands first, then lighting words, then summed keyword counts; the text is read once for all of them."""
    named = (("Electrical", fixed.ELECTRICAL_BRANDS), ("HVAC", fixed.HVAC_BRANDS), ("Electrical", fixed.LIGHTING_WORDS))
    every = [w for _, words in (*named, *fixed.TRADES_BY_COUNT) for w in words]

    def of(lower: Column, spots: Column) -> Column:
        out = None
        for name, words in named:
            some = [s for s in every if any(s.startswith(w) for w in words)]
            hit = F.exists(spots, lambda x: x.isin(some))
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out.otherwise(best_score([(n, count_of(lower, spots, words, every)) for n, words in fixed.TRADES_BY_COUNT], "Other"))

    return once(F.lower(text), lambda lower: once(spotted(lower, every), lambda spots: of(lower, spots)))


def trade_present(text: Column) -> Column:
    return by_presence(text, fixed.TRADES_BY_PRESENCE)


def trade_first(text: Column) -> Column:
    return first_hit(F.lower(text), fixed.TRADES_BY_FIRST, "Other")


def trade_of_code(code: Column, material: Column) -> Column:
    """By prefix of the finish code, else by its material."""
    return by_prefix(F.upper(code), fixed.TRADES_BY_CODE, first_hit(F.lower(material), fixed.TRADES_BY_MATERIAL, "Other"))


def trade_name(name: Column) -> Column:
    """A trade's usual spelling; unknown ones in title case, none is Other."""
    table = F.create_map(*(F.lit(x) for kv in fixed.TRADE_NAMES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.trim(F.lower(name))), F.when(F.length(F.coalesce(name, F.lit(""))) > 0, F.initcap(name)).otherwise("Other"))


def equipment_trade(kind: Column) -> Column:
    return first_hit(F.lower(kind), fixed.EQUIPMENT_TRADES, "Mechanical")


def structure(text: Column) -> Column:
    """Struct of type, confidence and all positive scores of a text's structure; unknown and 0 if nothing fits."""

    def scored(upper: Column) -> list[tuple[str, Column]]:
        out = [(f"schedule:{n}", n_present(upper, [w.upper() for w in ws]).cast("double")) for n, ws in fixed.SCHEDULE_STRUCTURES]
        out += [(f"spec:{n}", n_present(upper, [w.upper() for w in ws]) * 0.5) for n, ws in fixed.SPEC_STRUCTURES]
        return [*out, ("drawing:plan", any_of(upper, ["PLAN", "FLOOR PLAN", "REFLECTED CEILING"]).cast("double")), ("notes:general", any_of(upper, ["GENERAL NOTES", "NOTES:"]).cast("double"))]

    def told(every: Column) -> Column:
        # of equal scores the earlier: entries are (score, -order, name)
        best = F.array_max(every)
        return F.struct(
            F.when(best["score"] > 0, best["name"]).otherwise("unknown").alias("type"),
            F.least(F.lit(1.0), best["score"]).alias("confidence"),
            F.map_from_entries(F.transform(F.filter(F.array_sort(every, lambda a, b: b["order"] - a["order"]), lambda x: x["score"] > 0), lambda x: F.struct(x["name"].alias("key"), x["score"].alias("value")))).alias("all_scores"),
        )

    entries = lambda upper: F.array(*(F.struct(s.alias("score"), F.lit(-k).alias("order"), F.lit(n).alias("name")) for k, (n, s) in enumerate(scored(upper))))
    return once(once(F.upper(text), entries), told)


def page_types(text: Column) -> Column:
    """All types of a page, in order."""
    return once(F.upper(text), lambda upper: F.array_compact(F.array(*(F.when(any_of(upper, ws), n) for n, ws in fixed.PAGE_TYPES))))


def unparsed_schedules(text: Column) -> Column:
    """The kinds of schedules on a page that no parser reads, for a report of what a takeoff leaves out; none of them gives items."""
    return F.array_intersect(page_types(text), F.array(*map(F.lit, fixed.UNPARSED_SCHEDULES)))


def page_gates(text: Column) -> Column:
    """What the first extractor looks for on a page; exact case."""
    return F.array_compact(F.array(*(F.when(any_of(text, ws), n) for n, ws in fixed.PAGE_GATES)))


def item_type(text: Column) -> Column:
    return first_hit(F.lower(text), fixed.ITEM_TYPES, "other")


def first_brand(text: Column, brands: Sequence[str]) -> Column:
    """The first brand, in order, that a text names; null if none."""
    upper, out = F.upper(text), None
    for b in brands:
        hit = F.contains(upper, F.lit(b.upper()))
        out = F.when(hit, b) if out is None else out.when(hit, b)
    return F.lit(None).cast("string") if out is None else out


def tags(text: Column) -> Column:
    """The distinct equipment tags of a text, in capitals."""
    return F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit("|".join(fixed.MATCH_TAGS)), F.lit(0)))


def log_stage(line: Column) -> Column:
    """The stage that a log line tells, or null."""
    return F.nullif(first_hit(F.lower(line), fixed.STAGES, ""), F.lit(""))


def pressure(load_ratio: Column, free_mb: Column) -> Column:
    """Pressure of a host from its load per processor and free memory."""
    return (
        F.when((load_ratio > 3.0) | (free_mb < 512), "critical")
        .when((load_ratio > 2.0) | (free_mb < 1024), "high")
        .when((load_ratio > 1.5) | (free_mb < 2048), "moderate")
        .otherwise("low")
    )


def load_flags(load: Column, processors: Column, free_mb: Column) -> Column:
    """Struct of the load per processor and whether it is heavy (2.0), moderate (1.5), and memory low (2048 MB)."""
    per = load / F.greatest(processors, F.lit(1))
    return F.struct(per.alias("ratio"), (per > 2.0).alias("heavy"), (per > 1.5).alias("moderate"), (free_mb < 2048).alias("low_memory"))


def is_scanned(text: Column, below: int = fixed.SCANNED_BELOW) -> Column:
    return F.length(F.trim(text)) < below


def low_quality(chars: Column, confidence: Column) -> Column:
    """Whether a recognised page is worth a second source."""
    return (chars < 50) | (confidence < 40)


def region(x1: Column, y1: Column, x2: Column, y2: Column, page_w: Column, page_h: Column) -> Column:
    """The kind of a page region, by the place of its middle and its height."""
    x, y, tall = (x1 + x2) / 2, (y1 + y2) / 2, y2 - y1
    return (
        F.when((y > page_h * 0.85) & (x > page_w * 0.6), "title_block")
        .when(((x > page_w * 0.6) & (tall > page_h * 0.1)) | (tall > page_h * 0.3), "schedule")
        .when((y < page_h * 0.3) & (x < page_w * 0.5), "notes")
        .otherwise("callout")
    )


def real_region(w: Column, h: Column, fill: Column, widths: tuple[int, int] = (40, 4000), heights: tuple[int, int] = (15, 4000)) -> Column:
    """Whether a contour may hold text: by bounds of its size, aspect 0.3 to 15 and fill 0.05 to 0.9."""
    return w.between(*widths) & h.between(*heights) & (w / F.nullif(h, F.lit(0))).between(0.3, 15) & fill.between(0.05, 0.9)
