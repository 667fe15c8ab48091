"""Whole operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns; and on sf0.001 against plain versions."""

import hashlib
import zlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tallygrid.llm import bpe_tree, chat, common, decontaminate, line_dedup, maxent_lm, pii, quality, queries, sharding, simhash_golay, token_files
from tests.conftest import SF, same_rows
from tests.llm import brute

LONG = " ".join(f"w{i % 977}é" for i in range(30_000))
PROSE = " ".join(f"word{i} of note" for i in range(40))
ROWS = [(1, PROSE, "a"), (2, PROSE, "a"), (2, PROSE, "a"), (3, None, None), (4, "", "b"), (5, LONG, "b"), (None, "One two three", "b"), (6, PROSE.replace("word7 ", "word8 "), "a"), (7, " \n\t", "a")]
DOCS = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators use themselves."""
    d = spark.createDataFrame(ROWS, DOCS).repartition(3)
    return d.withColumns({c: F.lit(0) for c in ("n_words", "shard", "fp", "label", "kept", "n", "number", "host", "row", "n_dropped")}).cache()


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def sf(spark, table="documents"):
    return spark.read.parquet(f"{SF}/{table}.parquet")


def texts(spark, *cols, table="documents"):
    return [tuple(r) for r in sf(spark, table).select(*cols).collect()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, duck, name):
    same_rows(queries.queries()[name](spark, SF), duck.sql(queries.oracle_sql()[name]))


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([], "item_id long, text string")
    assert bpe_tree.encode_documents(none, queries.MULTI_RANKS, P.PATTERN).count() == 0
    assert simhash_golay.near_duplicates(none).count() == simhash_golay.one_of_each(none).count() == 0
    assert decontaminate.contamination(none, items).count() == decontaminate.keep_clean(none, items).count() == 0
    assert quality.verdicts(none).count() == quality.keep_good(none).count() == 0
    assert line_dedup.drop_boilerplate(none).count() == pii.pseudonymize(none, "k").count() == 0
    assert sharding.shard_rows(none, F.col("text")).count() == 0
    assert maxent_lm.score(none, maxent_lm.train(none)).count() == 0
    assert token_files.read(token_files.write(none, P.path("word_bpe_49k.json"), 1)).count() == 0
    assert chat.format_trees(chat.chain(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_bpe(spark, docs):
    want = sorted(((d, *brute.bpe(t, queries.MULTI_RANKS, P.PATTERN)) for d, t, _ in ROWS), key=repr)
    assert rows(bpe_tree.encode_documents(docs, queries.MULTI_RANKS, P.PATTERN), "*") == want
    ids = bpe_tree.encode_documents(docs, queries.MULTI_RANKS, P.PATTERN, with_ids=True).where("doc_id = 5").first()["ids"]
    assert bpe_tree.coder(queries.MULTI_RANKS, P.PATTERN).decode(ids).decode() == LONG


def test_simhash(spark, docs):
    got = simhash_golay.near_duplicates(docs)
    assert rows(got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id"), "*") == sorted(brute.simhash([r[:2] for r in ROWS]), key=repr)
    kept = simhash_golay.one_of_each(docs)
    assert kept.columns == docs.columns
    assert [r[0] for r in rows(kept, "doc_id")] == sorted((c for c in {c for _, _, c in brute.simhash([r[:2] for r in ROWS])}), key=lambda x: repr((x,)))
    few = texts(spark, "doc_id", "text")
    assert rows(queries.op5_simhash_golay(spark, SF), "*") == sorted(brute.simhash(few), key=repr)


def test_links_and_components(spark):
    base = [0, 1, 3, 7, 1 << 40, (1 << 40) | (7 << 20), -1, (1 << 63) - 1]
    e = simhash_golay.links(spark.createDataFrame([(f,) for f in base], "fp long"))
    want = {(min(a, b), max(a, b)) for a in base for b in base if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert {(r["a"], r["b"]) for r in e.collect()} == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (None, 5)], "a long, b long")
    got = dict(rows(common.components(chain), "node", "label"))
    assert set(got.values()) == {0, 200} and len(got) == 103


def test_decontamination(spark, docs):
    bench = [(1, "word3 of note word4 of note word5 of note word6 of note word7"), (1, "One TWO"), (2, "two Three"), (3, None), (4, "..."), (None, "w5é w6é w7é w8é w9é w10é w11é w12é w13é w14é w15é w16é w17é w18é")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    want = sorted(brute.contamination([r[:2] for r in ROWS], bench), key=repr)
    assert rows(decontaminate.contamination(docs, items), "*") == want
    assert rows(decontaminate.contamination(docs, items, most_literals=1, most_broadcast=1), "*") == want
    clean = [r for r, w in zip(ROWS, brute.contamination([r[:2] for r in ROWS], bench), strict=True) if not w[5]]
    assert rows(decontaminate.keep_clean(docs, items), "doc_id", "text") == sorted(((r[0], r[1]) for r in clean), key=repr)


def test_quality(spark, docs):
    got = {(r["doc_id"], r["n_words"]): r for r in quality.verdicts(docs).collect()}
    for d, t, _ in ROWS:
        want = brute.quality(t)
        assert {k: got[d, want["n_words"]][k] for k in want} == want
    kept = quality.keep_good(docs)
    assert kept.schema == docs.schema and {r[0] for r in kept.select("doc_id").collect()} <= {1, 2, 5, 6}


@pytest.mark.parametrize("most", [200_000, 0])
def test_line_dedup(spark, most):
    many = [(i, "h" if i < 20 else None, f"own {i}\nmenu\n\nfoot{'er' if i % 2 else ''}\nmenu") for i in range(24)] + [(90, "h", None), (91, None, ""), (91, None, "")]
    passage = " ".join(f"p{k}" for k in range(51))
    many += [(100 + i, "s", "copy\nof a page") for i in range(9)] + [(120, "s", f"x\n{passage}"), (121, "s", f"y\n{passage}"), (122, "s", passage + " longer"), (123, "s", "x y"), (124, "s", "y\nx")]
    d = spark.createDataFrame(many, "doc_id long, source string, text string").withColumn("n_lines", F.lit("x"))
    for ratio in (0.6, 0.01):
        got = line_dedup.drop_boilerplate(d, ratio=ratio, most_broadcast=most)
        assert rows(got, "doc_id", "text", "n_lines", "n_dropped") == sorted(brute.lines(many, ratio), key=repr)
    by = {r["doc_id"]: r["text"] for r in got.collect()}
    assert (by[100], by[120], by[121], by[124]) == ("copy\nof a page", "x", "y", "y\nx")  # a copied page stays, a repeated passage goes


def test_pii(spark):
    said = [
        (1, "mail jo.é1@x.org, +1 (743) 555-3824 und 4785380592391140 oder 4785-3805-9239-1140."),
        (2, "ip 1.2.3.4 no 300.1.1.1 v1.2.3.4.5 on 2024-02-29 not 2023-02-30, 31/12/1999 and 01.02.2003"),
        (3, "ssn 123-45-6789 no 000-45-6789 key 0123456789abcdef0123456789abcdef, 4785380592391140 4785380592391140"),
        (4, None),
        (5, ""),
        (6, "plain " * 5000),
    ]
    got = {r["doc_id"]: r for r in pii.pseudonymize(spark.createDataFrame(said, "doc_id long, text string").withColumn("n_ip", F.lit("x")), "k").collect()}
    for d, t in said:
        new, counts = brute.pseudonymize(t, "k", pii.PATTERNS) if t is not None else (None, {})
        assert got[d]["text"] == new and {k: got[d][f"n_{k}"] for k in pii.KINDS} == {k: counts.get(k, 0) for k in pii.KINDS}
    assert got[1]["text"].split("und ")[1][:16] in got[3]["text"] and "555-3824" not in got[1]["text"] and "300.1.1.1" in got[2]["text"]


def test_op3_and_op8_are_whole(spark):
    """The queries' rows for all documents: op3 by the library, op8 where a plain version reads alike."""
    have = texts(spark, "doc_id", "text")
    assert rows(queries.op3_bpe_tree(spark, SF), "*") == sorted(((d, *brute.bpe(t, queries.MULTI_RANKS, P.PATTERN)) for d, t in have), key=repr)
    got = {r["doc_id"]: r for r in queries.op8_pii_pseudonyms(spark, SF).collect()}
    assert len(got) == len(have)
    for d, t in have:
        new, counts = brute.pseudonymize(t, queries.PSEUDONYM_KEY, pii.PATTERNS)
        assert (got[d]["text"], {k: got[d][f"n_{k}"] for k in pii.KINDS}) == (new, {k: counts.get(k, 0) for k in pii.KINDS}), t
        assert got[d]["text_sha256"] == hashlib.sha256(new.encode()).hexdigest()


def test_the_key_is_not_in_the_plan(spark, docs):
    got = pii.pseudonymize(docs, "a-key-to-be-hidden")
    assert got.count() == len(ROWS)
    assert "a-key-to-be-hidden" not in got._jdf.queryExecution().toString()
    with pytest.raises(RuntimeError):
        common.shared_folder(type("S", (), {"conf": type("C", (), {"get": staticmethod(lambda k, d: d)}), "sparkContext": type("X", (), {"master": "spark://x:7077"})})())


def test_upper_case_is_the_category():
    """Roman numerals and circled letters are no upper-case letters, as in the query's SQL."""
    assert quality.View("AbÉ\u2167\u24b6ß").n_upper == 2


def test_pseudonyms_are_one_to_one():
    assert len({brute.feistel(x, 271, 271, "date", "k") for x in range(271 * 271)}) == 271 * 271


def test_sharding(spark, docs):
    d = docs.select("doc_id", "text", "shard").withColumn("size", F.length("text"))
    got = sharding.shard_rows(d.select("doc_id", "text", "size"), F.col("text"), shards=4).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(ROWS) and {len(x) for x in by.values()} == {2, 3} and all(sorted(x) == list(range(len(x))) for x in by.values())
    assert len({r["shard"] for r in got if r["text"] == PROSE}) == 1
    with pytest.raises(ValueError):
        sharding.shard_rows(d, F.col("text"), shards=0)


def test_sharding_with_a_hot_group(spark):
    d = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 1000).cast("string"))).alias("g"))
    got = sharding.shard_rows(d, F.col("g"), shards=7)
    per = got.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.count_distinct("slot").alias("s")).collect()
    assert {r["n"] for r in per} <= {428, 429} and sum(r["n"] for r in per) == 3000 and all(r["m"] + 1 == r["n"] == r["s"] for r in per)
    whole = got.where("g <> 'hot'").groupBy("g").agg(F.count_distinct("shard").alias("k"))
    # every row is linked and quotas are tight; six of seven pairs are apart at first
    assert whole.where("k > 1").count() < 0.3 * whole.count()


def test_op1_is_whole(spark):
    got = queries.op1_sharding(spark, SF).collect()
    have = dict(texts(spark, "doc_id", "text"))
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert (r["law"], r["grown_shard"]) == ("rows", None)
    sizes = [len(by.get(k, ())) for k in range(40)]
    assert set(by) <= set(range(40)) and max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in by.values())
    # links cut: far fewer groups of equal texts are spread than if rows were dealt by a hash of their id
    groups = {}
    for r in got:
        groups.setdefault(have[r["doc_id"]], []).append(r)
    apart = sum(len({r["shard"] for r in g}) > 1 for g in groups.values())
    dealt = sum(len({zlib.crc32(str(r["doc_id"]).encode()) % 40 for r in g}) > 1 for g in groups.values())
    assert apart < dealt
    assert len(got) == len(have) and all(r["text_crc32"] == zlib.crc32(have[r["doc_id"]].encode()) and r["size"] == len(have[r["doc_id"]].encode()) + 16 for r in got)


def test_language_model(spark):
    import math
    from collections import Counter

    d = texts(spark, "doc_id", "text")
    train = Counter()
    for i, t in d:
        if zlib.crc32(str(i).encode()) % 10:
            train.update([*maxent_lm.words_of(t), "end"])
    n, v = sum(train.values()), len(train)
    got = {r["doc_id"]: r for r in queries.op2_maxent_lm(spark, SF).collect()}
    for i, t in d:
        words = [*maxent_lm.words_of(t), "end"]
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        r = got[i]
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(train[w] > 0 for w in words), n)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_language_model_shuffles_rare_words(spark, docs):
    d = docs.select("doc_id", "text")
    one, two = (sorted(maxent_lm.score(d, maxent_lm.train(d, frequent=k, rounds=1)).collect(), key=repr) for k in (20, 200_000))
    for a, b in zip(one, two, strict=True):
        assert (a["doc_id"], a["n_tokens"], a["n_known"]) == (b["doc_id"], b["n_tokens"], b["n_known"]) and a["base_score"] == pytest.approx(b["base_score"])


def test_probabilities_add_up(spark):
    """Over all words seen and one unknown word in each class, after any history."""
    import numpy as np

    d = sf(spark).limit(60).select("text")
    t = maxent_lm.train(d)
    m = t.model
    counts = {r["word"]: r["n"] for r in t.counts.collect()}
    coder = maxent_lm.coder(m.classes, m.number)
    x = maxent_lm.features([coder(maxent_lm.words_of("the of and word"))])
    coarse = np.exp(maxent_lm.log_probs(m.table, m.bias, x.rows).astype(float))[2]
    w1, k1 = coder([b"of"])[0] >> 8 & 0xFFFFFFFF, coder([b"of"])[0] & 255

    def finer(k):
        """The probabilities of the parts of a class after "the of"."""
        if not maxent_lm.SINGLES <= k < maxent_lm.CLASSES - 1:
            return np.eye(maxent_lm.PARTS)[0]
        mixed = np.array([w1 * 0x9E3779B1 + k * 0x85EBCA6B + 0x6D3, (k1 << 8 | k) * 0x27D4EB2F + 0x4C7], np.int64)
        at = ((mixed ^ mixed >> 17) & maxent_lm.ROWS - 1)[:, None]
        return np.exp(maxent_lm.log_probs(m.fine, m.fine_bias[k][None], at).astype(float))[0]

    p = np.stack([coarse[k] * finer(k) for k in range(maxent_lm.CLASSES)])
    last = (maxent_lm.CLASSES - 1, 0)
    cells = {w: last if w is None else divmod(m.classes.cell(w.encode()), maxent_lm.PARTS) for w in counts}
    total = sum(p[cells[w]] * (n + 0.1) / 10 ** m.mass[cells[w]] for w, n in counts.items())
    total += sum(p[k, j] * 0.1 / 10 ** m.mass[k, j] for k in range(maxent_lm.CLASSES) for j in range(maxent_lm.PARTS))
    assert total == pytest.approx(1, abs=1e-4)


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    k = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for d, t, _ in order:
        ids = [*k.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    for segment, most in ((1 << 21, 500_000), (50, 0)):
        got = token_files.read(token_files.write(docs, P.path("word_bpe_49k.json"), 1, segment=segment), most_broadcast=most)
        assert rows(got, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)


def test_op9_is_the_library(spark):
    """The query's rows for all documents, from the library alone."""
    from tokenizers import Tokenizer

    k = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    k.encode_special_tokens = True
    want, at = [], 0
    for d, t in sorted(texts(spark, "doc_id", "text")):
        ids = [*k.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    assert rows(queries.op9_token_files(spark, SF), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)


def test_reply_trees(spark):
    nodes = spark.createDataFrame(
        [("t", 1, None, 1.0), ("t", 2, 1, 5.0), ("t", 3, 1, 1.0), ("t", 4, 2, 0.0), ("t", 5, 3, 9.0), ("t", 6, 99, 0.5), ("c", 1, 2, 1.0), ("c", 2, 1, 1.0), ("n", 1, None, None)],
        "tree string, node int, parent int, score double",
    )
    best = chat.best_paths(nodes, 2)
    assert rows(best, "tree", "rank", "node", "depth") == sorted([("t", 1, 1, 1), ("t", 1, 3, 2), ("t", 1, 5, 3), ("t", 2, 1, 1), ("t", 2, 2, 2), ("t", 2, 4, 3), ("n", 1, 1, 1)], key=repr)
    m = nodes.withColumn("role", F.when(F.col("node") % 2 == 1, "user").otherwise("assistant")).withColumn("text", F.concat(F.lit("[INST]"), F.col("node").cast("string")))
    said = {r["tree"]: r["formatted"] for r in chat.format_trees(m).collect()}
    assert chat.parse(said["t"]) == [("user", "[INST]1"), ("user", "[INST]3"), ("user", "[INST]5")]


def test_chat_edges(spark):
    talk = [(1, 1, "assistant", None), (1, 0, None, "x"), (1, 1, "assistant", "b"), (None, None, "user", "alone"), (2, 5, "user", "a" * 5000), *((3, i, "user", str(i)) for i in range(70))]
    d = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit(1))
    got = {r["tree"]: r for r in chat.read_back(chat.format_trees(chat.chain(d))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert {k: r["n_turns"] for k, r in got.items()} == {"1": 3, "": 1, "2": 1, "3": 70}
    assert got["1"]["turns_sha256"] == sha("\nx\nassistant\n\nassistant\nb\n") and (got["1"]["loss_chars"], got["1"]["loss_sha256"]) == (1, sha("b"))
    assert got["3"]["turns_sha256"] == sha("".join(f"user\n{i}\n" for i in range(70)))


def test_pipeline(spark):
    import corpus_pipeline

    d, counts = sf(spark), []
    for name, stage in corpus_pipeline.STAGES:
        before = d.columns
        d = common.saved(stage(spark, d, SF))
        counts.append(d.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert d.columns == before
    assert counts == sorted(counts, reverse=True) and counts[0] == counts[1] > counts[2] > 0
    assert rows(corpus_pipeline.run(spark, SF), "*") == rows(d, "*")


def plain_stages(have, bench):
    """The rows (doc_id, text) that each stage leaves by the plain versions, from the rows (doc_id, text, source) it is given."""
    from tests.llm.test_near_text import exact_firsts

    good = [r for r in have if quality.first_rejection(quality.View(r[1]), list(quality.RULES)) is None]
    assert not [r for r in good if brute.quality(r[1])["base_failed"]]
    yield good
    lined = [(d, t, h) for (d, t, _, _), (_, _, h) in zip(brute.lines([(d, h, t) for d, t, h in good]), good, strict=True)]
    yield lined
    numbers = exact_firsts(list(enumerate(t for _, t, _ in sorted(lined, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())))))
    ordered = sorted(lined, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    near = [ordered[i] for i in numbers]
    yield near
    yield [r for r, c in zip(near, brute.contamination([r[:2] for r in near], bench), strict=True) if not c[5]]


def test_pipeline_against_plain(spark):
    """Each stage of the pipeline, on what the one before it left, keeps what the plain versions keep."""
    import corpus_pipeline

    d = sf(spark)
    stages = plain_stages(texts(spark, "doc_id", "text", "source"), texts(spark, "item_id", "text", table="benchmark"))
    for (name, stage), want in zip(corpus_pipeline.STAGES[:4], stages, strict=True):
        d = common.saved(stage(spark, d, SF))
        assert rows(d, "doc_id", "text", "source") == sorted(want, key=repr), name
        assert d.where("n_chars <> length(text)").count() == 0
    last = corpus_pipeline.STAGES[4][1](spark, d, SF)
    assert rows(last, "*") == sorted(((i, *brute.bpe(t, queries.MULTI_RANKS, P.PATTERN)) for i, t, _ in want), key=repr)


@pytest.mark.parametrize("kind", ["edges", "empty"])
def test_pipeline_on_edges(spark, tmp_path, kind):
    """Nulls in any column, repeated rows, empty and very long texts; and no rows."""
    import corpus_pipeline

    clean = " ".join(f"clean{i} prose" for i in range(40))
    long = " ".join(f"long{i}é" for i in range(30_000))
    given = [(1, clean, "en", "a", len(clean)), (1, clean, "en", "a", len(clean)), (None, clean + " more", None, None, None), (2, None, None, None, None), (3, "", "en", "a", 0), (4, long, None, "b", len(long)), (4, long, None, "c", len(long)), (None, None, None, None, None)]
    docs = spark.createDataFrame(given if kind == "edges" else [], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (None, "w5é w6é w7é w8é w9é w10é w11é w12é w13é w14é w15é w16é w17é w18é")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = rows(corpus_pipeline.run(spark, str(tmp_path)), "*")
    assert got == ([(1, *brute.bpe(clean, queries.MULTI_RANKS, P.PATTERN)), (4, *brute.bpe(long, queries.MULTI_RANKS, P.PATTERN))] if kind == "edges" else [])
