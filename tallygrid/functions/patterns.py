"""Regular expressions over text columns: all matches with their groups and what stands around them, in the JVM.

Patterns are those of the domain, in the syntax that Python and Java share. They are read as Python reads them: letters, digits and white space of all
alphabets, and only a line feed ends a line.
"""

from __future__ import annotations

import re
from functools import reduce
from re import _constants as ops
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallygrid.functions.classify import any_of, once


def java(pattern: str, flags: int = re.IGNORECASE) -> str:
    """The pattern for the JVM, with flags of ``re``."""
    marks = "Ud" + "iu" * bool(flags & re.IGNORECASE) + "s" * bool(flags & re.DOTALL)
    return f"(?{marks})" + pattern.replace(r"\Z", r"\z")


def _runs(pattern: str, flags: int) -> list[list[tuple[str, ...]]]:
    """For each choice of a pattern sets of strings of two characters or more; of each set, a match of the choice holds at least one."""
    folded = bool(flags & re.IGNORECASE)

    def fits(c: str) -> bool:
        return c.isascii() and not (folded and c in "iIkK")

    def walk(parts) -> list[tuple[str, ...]]:
        out, run = [], ""
        for op, value in parts:
            if op is ops.LITERAL and fits(chr(value)):
                run += chr(value)
                continue
            if op is ops.AT:
                continue
            out, run = out + [(run,)] * (len(run) > 1), ""
            if op is ops.SUBPATTERN and not (value[1] or value[2]):
                out += walk(value[3])
            elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and value[0] > 0:
                out += walk(value[2])
            elif op is ops.BRANCH and all(each := [_longest(walk(b)) for b in value[1]]):
                out.append(tuple(x for some in each for x in some))
        return out + [(run,)] * (len(run) > 1)

    every = [walk(_parser.parse(choice, flags)) for choice in _choices(pattern)]
    return [[tuple(dict.fromkeys(x.upper() if folded else x for x in some)) for some in found] for found in every]


def _longest(found: list[tuple[str, ...]]) -> tuple[str, ...]:
    return max(found, key=lambda some: min(map(len, some)), default=())


def _choices(pattern: str) -> list[str]:
    """The alternatives of a whole pattern; the parser would take out what they begin with. Groups that are referred to by number keep it only if there is one choice."""
    if re.search(r"\\[1-9]|\(\?P?[=<(]", pattern):
        return [pattern]
    out, depth, k, start, listed = [], 0, 0, 0, False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif listed:
            listed = c != "]" or k == first
        elif c == "[":
            listed, first = True, k + 1 + (pattern[k + 1] == "^")
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[start:k])
            start = k + 1
        k += 1
    return [*out, pattern[start:]]


def needed(pattern: str, flags: int = re.IGNORECASE) -> tuple[str, ...]:
    """Strings of which each match of a pattern holds at least one; none if the pattern has no such strings of two characters.

    Where case is ignored they are in capitals, to be looked for in the upper-cased text; i and k are left out, as other letters count as these that are no capitals of theirs.
    """
    each = [_longest(found) for found in _runs(pattern, flags)]
    return tuple(dict.fromkeys(x for some in each for x in some)) if all(each) else ()


def may_have_any(upper: Column, each: tuple[str, ...]) -> Column:
    """False where a text, ``upper`` in capitals, can hold no match of any of these patterns in any case: a choice needs all of its strings."""
    every = {tuple(sorted(found, key=lambda some: -min(map(len, some)))) for p in each for found in _runs(p, re.IGNORECASE)}
    out = F.lit(False)
    for found in sorted(every):
        out = out | reduce(lambda a, b: a & b, (any_of(upper, some) for some in found), F.lit(True))
    return out


def may_have(text: Column, upper: Column, pattern: str, flags: int = re.IGNORECASE) -> Column:
    """False where a text, ``upper`` in capitals, cannot hold a match, told without the pattern; so that few texts are searched."""
    some = needed(pattern, flags)
    return any_of(upper if flags & re.IGNORECASE else text, some) if some else F.lit(True)


class Found:
    """One match, as a struct: its groups, 0 for all of it, and the characters before and after that ``found`` was asked for."""

    def __init__(self, row: Column):
        self.row = row

    def __getitem__(self, group: int) -> Column:
        return self.row[f"g{group}"]

    @property
    def after(self) -> Column:
        return self.row["after"]

    @property
    def at(self) -> Column:
        return self.row["at"]

    def near(self, before: int, after: int) -> Column:
        """The match with so many characters before and after it, within those asked for."""
        return F.concat(F.right(self.row["before"], F.lit(before)), self[0], F.left(self.row["after"], F.lit(after)))


def found(text: Column, pattern: str, flags: int = re.IGNORECASE, before: int = 0, after: int = 0, upper: Column | None = None, placed: bool = False) -> Column:
    """All matches of a pattern in a text, in order, as an array of structs for ``Found``; a group that takes no part is empty. ``upper`` is the text in capitals, if it is there.

    The text is read once, and again for each side that is asked for, if it has matches. Groups are those of the match read alone, which is matched in the same way.
    What stands around a match is captured without being consumed: after it by looking ahead, before it by looking behind from the match's start over
    exactly ``before`` characters, or fewer where the text begins. ``placed`` adds where a match begins, counted from 0 by what stands between matches; what stands around
    it is then cut out of the text by place, which is for short texts: looking behind tries up to twice ``before`` beginnings a match.
    """
    groups = re.compile(pattern).groups
    # a look-behind counts in halves of characters, so the last choice, which never holds, makes room for twice as many
    behind = rf"\A[\s\S]{{0,{before - 1}}}|[^\uDC00-\uDFFF][\s\S]{{{before - 1}}}|[\s\S]{{{2 * before}}}(?!)"
    sides = {"before": (rf"(?={pattern})(?<=({behind}))(?:{pattern})", groups + 1)} if before else {}
    sides |= {"after": (rf"(?:{pattern})(?=([\s\S]{{0,{after}}}))", groups + 1)} if after else {}

    def read(match: Column, around: dict[str, Column]) -> Column:
        alone = java(rf"\A(?:{pattern})\z", flags)
        return F.struct(match.alias("g0"), *(F.regexp_extract(match, alone, k).alias(f"g{k}") for k in range(1, groups + 1)), *(x.alias(name) for name, x in around.items()))

    def put(x: Column) -> Column:
        around = {"before": F.right(F.left(text, x["at"]), F.lit(before))} if before else {}
        around |= {"after": F.substring(text, x["at"] + F.length(x["match"]) + 1, F.lit(after))} if after else {}
        return read(x["match"], {"at": x["at"], **around})

    def of(matches: Column) -> Column:
        if placed:
            rows = F.transform(F.arrays_zip(matches.alias("match"), _places(text, java(pattern, flags), matches).alias("at")), put)
            return F.when(F.size(matches) > 0, rows).otherwise(F.slice(rows, 1, 0))
        if not sides:
            return F.transform(matches, lambda m: read(m, {}))
        each = {name: F.regexp_extract_all(text, F.lit(java(p, flags)), F.lit(k)) for name, (p, k) in sides.items()}
        zipped = F.arrays_zip(matches.alias("match"), *(x.alias(name) for name, x in each.items()))
        rows = F.transform(zipped, lambda x: read(x["match"], {name: x[name] for name in each}))
        return F.when(F.size(matches) > 0, rows).otherwise(F.slice(rows, 1, 0))

    matches = all_of(text, pattern, flags)
    if upper is not None:
        matches = F.when(may_have(text, upper, pattern, flags), matches).otherwise(F.array().cast("array<string>"))
    return once(matches, of)


def _places(text: Column, pattern: str, matches: Column) -> Column:
    """Where the matches of a text begin, from the lengths of them and of what stands between."""
    summed = lambda lengths: F.aggregate(lengths, F.lit(0), lambda a, x: a + x)

    def of(between: Column) -> Column:
        own = F.transform(matches, F.length)
        return F.transform(matches, lambda m, i: summed(F.slice(between, 1, i + 1)) + summed(F.slice(own, 1, i)))

    return once(F.transform(F.split(text, pattern, -1), F.length), of)


def all_of(text: Column, pattern: str, flags: int = re.IGNORECASE, group: int = 0) -> Column:
    """One group of all matches, as an array of strings."""
    return F.regexp_extract_all(text, F.lit(java(pattern, flags)), F.lit(group))


def pieces(text: Column, patterns: tuple[str, ...], margin: int, start: Column | None = None, end: Column | None = None, size: int = 1000) -> Column:
    """``array<struct<text, upper, start, end>>``: the pieces of a text that may hold a match of one of ``patterns``, in any case, each with ``margin`` characters before and after it, and where it begins and ends in that.

    The patterns must match letters, digits, white space and hyphens only: a text is cut in front of other characters, so each match lies in one piece, and what is
    found in pieces is what is found in the text. A long text is then searched only where a match may be. With ``start`` and ``end`` pieces are only of that part of the text.
    """
    assert margin <= size

    def of(cut: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            before, after = F.coalesce(F.right(F.get(cut, i - 1), F.lit(margin)), F.lit("")), F.coalesce(F.left(F.get(cut, i + 1), F.lit(margin)), F.lit(""))

            def placed(before: Column) -> Column:
                low, high = F.length(before), F.length(before) + F.length(x)
                if start is not None:
                    shift = F.aggregate(F.slice(cut, F.lit(1), i), F.lit(0), lambda n, y: n + F.length(y)) - F.length(before)
                    low, high = F.greatest(low, start - shift), F.least(high, end - shift)
                return once(F.concat(before, x, after), lambda t: F.struct(t.alias("text"), F.upper(t).alias("upper"), low.alias("start"), high.alias("end")))

            return F.when(once(F.upper(x), lambda u: may_have_any(u, patterns)), once(before, placed))

        return F.array_compact(F.transform(cut, piece))

    return once(F.regexp_extract_all(text, F.lit(rf"(?U)[\s\S]{{{size}}}[\w\s-]*|[\s\S]+"), F.lit(0)), of)


def first_of(text: Column, pattern: str, flags: int = re.IGNORECASE, group: int = 1) -> Column:
    """One group of the first match; null without a match, empty if the group takes no part."""
    return F.when(text.rlike(java(pattern, flags)), F.regexp_extract(text, java(pattern, flags), group))


def has(text: Column, pattern: str, flags: int = re.IGNORECASE) -> Column:
    return text.rlike(java(pattern, flags))


def is_all(text: Column, pattern: str, flags: int = 0) -> Column:
    """Whether the whole text is a match."""
    return text.rlike(java(rf"\A(?:{pattern})\z", flags))


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def titled(text: Column) -> Column:
    """Each run of letters with a capital in front and small letters behind."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), F.initcap), "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def place(text: Column, words: str) -> Column:
    """Where words are first found in a text, whatever their case, counted from 1; 0 if they are not."""
    return F.regexp_instr(text, F.lit(java(re.escape(words))))


def has_word(text: Column, words, lower: bool = False) -> Column:
    """Whether a text, in capitals or small letters, contains one of ``words``."""
    return once(F.lower(text) if lower else F.upper(text), lambda t: any_of(t, words))
