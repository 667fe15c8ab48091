"""Tests of the findings of round 4: each fails on the code that the finding was about."""

import re

import pytest
from pyspark.sql import functions as F

from tallygrid.functions import patterns
from tallygrid.operators import generators
from tests import plain_items
from tests.test_domain import said

FLOORS = tuple(p for p, *_ in (*generators.FLOORS, *generators.FLOOR_PARTS, *generators.MATS, ("TRANSITION",)))


def test_patterns_that_are_searched_in_pieces_fit_into_one():
    """floors match nothing but letters, digits, white space and hyphens, so no match goes over a cut, and each needs some string."""
    for p in FLOORS:
        assert not re.sub(r"\\[sw]|[\w\s-]|[\[\]()?:|*+]", "", p), p
        assert patterns.needed(p), p
    assert patterns.needed(r"vinyl\s+tile|vt") == ("NYL", "VT") and patterns.needed(r"a[|]bc\|d|(?:xy|xz)") == ()


@pytest.mark.parametrize("glue", [". ", " ", ", x " * 90])
def test_long_texts_are_searched_in_pieces(spark, glue):
    """what is found in pieces is what is found in the text, and few pieces are read."""
    filler = "Straße und some plain words 𝒳 of nothing" + glue
    told = ["Carpet tile 12\" x 12\" Manufacturer: Shaw", "schluter metal   trim", "VINYL TILE to carpet TRANSITION", "logo mat 3 ea", "Walk-Off Mat", "quarter\n round Color: Grey", "porcelain tile", "lvt", "wood base"]
    text = "".join(filler * (3 + 37 * k % 101) + t + glue for k, t in enumerate(told * 3))
    for columns, plain in ((generators.flooring, plain_items.flooring), (generators.transitions, plain_items.transitions)):
        assert said(spark, columns, text, told[0], "", glue) == [plain(text), plain(told[0]), plain(""), plain(glue)]
    part = lambda t, u: F.concat(generators.floors(t, u, F.lit(900), F.lit(5100)), generators.transitions(t, u, F.lit(900), F.lit(5100)))
    assert said(spark, part, text) == [plain_items.floors(text, 900, 5100) + plain_items.transitions(text, 900, 5100)]
    if glue == ". ":
        one = spark.createDataFrame([(text + filler * 5000,)], "text string").select(patterns.pieces(F.col("text"), FLOORS, 300).alias("x")).first()["x"]
        assert 0 < sum(len(x["text"]) for x in one) < 70_000 < len(text) + 5000 * len(filler)


def test_inferred_items_look_behind_nothing_and_broadcast_no_pages(spark):
    """no match tries hundreds of beginnings to see what stands before it, and pages are joined to their margins by a shuffle."""
    from tallygrid.plans import registry

    plan = registry.queries()["inferred_items"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "(?<=" not in plan and "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    text = "é𝒳" * 9 + "quarter round é " + "ab" * 9 + "Quarter  Round!"
    got = spark.createDataFrame([(text,)], "t string").select(patterns.found(F.col("t"), r"quarter\s+round", before=5, after=4, placed=True).alias("x")).first()["x"]
    assert [(m["g0"], m["before"], m["after"], m["at"]) for m in got] == [(m[0], text[max(0, m.start() - 5) : m.start()], text[m.end() : m.end() + 4], m.start()) for m in re.finditer(r"(?i)quarter\s+round", text)]


def test_pipeline_default_broadcasts_nothing_that_grows(spark):
    """legends, rooms, files and pages of all projects are joined by shuffles; Spark's estimate of them is that of two columns of part."""
    from tallygrid.plans import registry

    plan = registry.queries()["pipeline_default"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 5
