"""The pipeline's near-duplicates against exact shingle similarity."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallygrid.llm import near_text
from tests.conftest import SF


def exact_firsts(docs, least=0.8):
    """The smallest id of each component of (id, text) rows, by all pairs."""
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    top = list(range(len(docs)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (not a and not b) or len(a & b) >= least * len(a | b) > 0:
                top[root(i)] = root(j)
    first = {}
    for i, (d, _) in enumerate(docs):
        first[root(i)] = min(d, first.get(root(i), d))
    return set(first.values())


def changed(n, step, tag="x"):
    return " ".join(f"{tag}{i}" if step and i % step == step - 1 else f"w{i}" for i in range(n))


def test_stage_links_similar_texts_only(spark):
    """Copies with one word in fifty changed are at 0.82, with one in thirty at 0.71."""
    import corpus_pipeline

    texts = {1: changed(1000, 0), 2: changed(1000, 50), 3: "other " + "text of its own " * 3, 4: changed(600, 0, "y").upper().replace("W", "v"), 5: changed(600, 30, "z").replace("w", "v")}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r[0] for r in corpus_pipeline.dedup_near(spark, docs, SF).select("doc_id").collect()}
    assert kept == exact_firsts(list(texts.items())) == {1, 3, 4, 5}


def test_against_all_pairs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    have = [tuple(r) for r in d.select("doc_id", "text").collect()]
    for small in (near_text.SMALL, 2):
        assert {r[0] for r in near_text.one_of_each(d, small=small).select("doc_id").collect()} == exact_firsts(have)


def test_a_large_group_meets_at_its_centre(spark):
    """Copies of one text that are similar to it and not to each other are one group, though their bucket is large; what is far from it is not."""
    r = random.Random(1)
    base = [f"w{i}" for i in range(1000)]

    def copy(tag, changes):
        at = set(r.sample(range(5, 995), changes))
        return " ".join(f"{tag}-{i}" if i in at else w for i, w in enumerate(base))

    docs = [(500, " ".join(base)), *((i, copy(i, 15)) for i in range(60)), *((1000 + i, copy(1000 + i, 45)) for i in range(3))]
    assert exact_firsts(docs) == {0, 1000, 1001, 1002}
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x[0] for x in near_text.one_of_each(d, small=4).select("doc_id").collect()} == exact_firsts(docs)


@pytest.mark.parametrize("small", [32, 2])
def test_links_between_outsiders_are_not_lost(spark, small):
    """400 texts around one, 4 to 14 words of 500 changed: many are similar to each other and not to the middle, some to nothing."""
    r = random.Random(2)
    base = [f"w{i}" for i in range(500)]

    def copy(tag):
        at = set(r.sample(range(500), r.randint(4, 14)))
        return " ".join(f"{tag}-{i}" if i in at else w for i, w in enumerate(base))

    docs = [(i, copy(i)) for i in range(400)]
    short = [(1000 + i, " ".join(copy(1000 + i).split()[:360])) for i in range(60)]
    want = exact_firsts(docs + short)
    assert 150 < len(want) < 400
    d = spark.createDataFrame(docs + short, "doc_id long, text string").repartition(4)
    assert {x[0] for x in near_text.one_of_each(d, small=small).select("doc_id").collect()} == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=2, max_size=12), st.sets(st.integers(0, 40), max_size=40), st.sampled_from([0.5, 0.7, 0.8, 0.9]))
def test_what_sets_lack_and_have_besides_tells_similarity(groups, stock, least):
    """Whatever the stock, exactly the similar pairs are told."""
    stock = np.array(sorted(stock), np.uint64)
    sets = [np.array(sorted(g), np.uint64) for g in groups]
    rows = [near_text.apart_from(x, stock) for x in sets]
    table = {"lacks": [r[0] for r in rows], "n_lacks": np.array([r[1] for r in rows]), "n_more": np.array([len(r[2]) for r in rows]), "more": [r[2].view(np.int64) for r in rows], "n_stock": np.full(len(rows), len(stock)), "label": np.arange(len(rows))}
    told = {tuple(sorted(p)) for p in near_text.met(table, table, least)}
    assert told == {(j, i) for i, a in enumerate(sets) for j in range(i) if near_text.similarity(a, sets[j]) >= least}
