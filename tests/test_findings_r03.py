"""One test for each finding of round 3: each fails on the code that the finding was about."""

import pytest

from tallygrid.plans import registry
from tests.conftest import same_rows


def test_rule_filter_minds_case_and_nulls(spark, duck, tmp_path):
    """patterns in the case that they are written in; a null text is in neither result."""
    texts = ["TOKEN = 'ABCDEF01'", "token = 'abcdef01'", "Ab.1@x", "A.1@x", None, "", "plain", "555-1234"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sql = registry.oracle_sql()["rule_filter"].replace("documents", f"'{tmp_path}/documents.parquet/*.parquet'")
    same_rows(registry.queries()["rule_filter"](spark, str(tmp_path)), duck.sql(sql))


def test_project_type_has_no_nested_loop(spark):
    """a marker in a project's folder or beside it, by an equi-join."""
    from tallygrid.sources import readers

    rows = [("/c/a", True), ("/c/a/Expected Out", True), ("/d/b", True), ("/d/expected", True), ("/e/f", True), ("/e/f/g/expected", True), ("/h", True), ("/h/expected.pdf", False)]
    ls = spark.createDataFrame(rows, "path string, is_dir boolean")
    mine = spark.createDataFrame([("1", "/c/a"), ("2", "/d/b"), ("3", "/e/f"), ("4", "/h"), ("5", None), ("6", "/c/a"), ("7", "/d")], "project_id string, path string")
    got = readers.project_type(ls, mine)
    assert dict(got.select("project_id", "type").collect()) == {"1": "sample", "2": "sample", "3": "challenge", "4": "challenge", "5": "challenge", "6": "sample", "7": "sample"}
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def _many_copies(spark):
    """Two sides of a project with few descriptions, said often, so that predictions run out; and one with few words."""
    import random

    r = random.Random(5)
    said = ["large ring plate", "ring plate large", "large plate", "small ring plate", "ring of steel plate", "old cap", "cap", None, "large ring plate of steel"]
    rows = [(pr, i, r.choice(said), float(r.randint(1, 9))) for pr in ("a", "b", None) for i in range(120)]
    d = spark.createDataFrame(rows, "project_id string, seq long, description string, quantity double")
    return d.where("seq % 3 > 0"), d.where("seq % 3 = 0")


def test_scored_links_tell_all_pairs(spark):
    """pairs of classes and membership say what all pairs of items say."""
    from tallygrid.operators import match

    e, p = _many_copies(spark)
    rows = match.scored_links(e, p).collect()
    of = {part: {(r["project_id"], r["other"]): r["class"] for r in rows if r["part"] == part} for part in ("expected", "predicted")}
    score = {(r["project_id"], r["class"], r["other"]): r["score"] for r in rows if r["part"] == "pair"}
    told = {(s, x, y, score[s, c, k]) for (s, x), c in of["expected"].items() for (t, y), k in of["predicted"].items() if s == t and (s, c, k) in score}
    every = {tuple(r) for r in match.scored(e, p).select("project_id", "e", "p", "score").collect()}
    assert told == every
    assert len(every) > 10 * len(score) > 0


@pytest.mark.parametrize("one_task", [10_000, 20])
def test_assigned_is_greedy_over_all_pairs(spark, one_task):
    """the assignment by classes is that over all pairs."""
    from tallygrid.operators import match

    e, p = _many_copies(spark)
    want = sorted(map(tuple, match.greedy(match.scored(e, p)).select("project_id", "e", "p", "score").collect()))
    assert sorted(map(tuple, match.assigned(e, p, one_task=one_task).select("project_id", "e", "p", "score").collect())) == want and len(want) > 40


def test_a_pair_is_scored_once(spark, tmp_path):
    """of a pair that comes again a task remembers the score."""
    from pyspark.sql import functions as F

    from tallygrid.functions import similarity

    path = str(tmp_path / "calls")

    def slow(a, b):
        with open(path, "a") as f:
            f.write("x")
        return 1.0

    d = spark.range(0, 30_000, 1, 1).select(F.concat(F.lit("a"), (F.col("id") % 3).cast("string")).alias("a"), F.lit("b").alias("b"))
    assert d.select(similarity._batched(slow)("a", "b").alias("s")).agg(F.sum("s")).first()[0] == 30_000
    assert len(open(path).read()) == 3


def test_report_is_dealt_by_rows(spark, monkeypatch):
    """many projects that say the same compress to little; tasks follow from the number of rows."""
    from tallygrid.operators import match

    e = spark.range(300).selectExpr("id AS project_id", "0L AS seq", "'porcelain tile flooring' AS description", "1.0D AS quantity")
    p = e.selectExpr("project_id", "seq", "CASE WHEN project_id % 3 = 0 THEN 'something else' ELSE description END AS description", "2.0D AS quantity")
    monkeypatch.setattr(match, "TASK_ROWS", 10, raising=False)
    out = match.report(e, p)
    assert out.rdd.getNumPartitions() >= 60
    assert [r["matched_items"] for r in out.orderBy("project_id").collect()] == [int(i % 3 > 0) for i in range(300)]


def test_partial_ratio_compares_few_windows(monkeypatch):
    """pairs that never came before are quick too; the result is that of all windows."""
    import random

    from tallygrid.functions import similarity

    def all_windows(a, b):
        a, b = (b, a) if len(a) > len(b) else (a, b)
        return max(similarity.ratio(a, b[max(0, end - len(a)) : end]) for end in range(1, len(b) + len(a)))

    r = random.Random(7)
    for letters in ("ab", "abcdé ", "abcdefghijklmnopqrstuvwxyz "):
        for _ in range(300):
            a, b = ("".join(r.choices(letters, k=r.randint(1, 30))) for _ in "ab")
            assert similarity.partial_ratio(a, b) == all_windows(a, b)
    calls, common = [], similarity._common
    monkeypatch.setattr(similarity, "_common", lambda *x: calls.append(1) or common(*x))
    similarity.partial_ratio("porcelain tile flooring in lobby", "new carpet tile, wall base and porcelain tiles for the flooring of a lobby and of corridors")
    assert 0 < len(calls) < 40


def test_score_layers_is_dealt_to_many_tasks(spark):
    """one small file with many parts is not one task."""
    from pyspark.sql import functions as F

    used = registry.queries()["score_layers"](spark, "/root/testdata/sf0.001").select(F.spark_partition_id().alias("t")).distinct()
    assert used.count() > 10


def test_score_layers_compares_two_texts_once(spark, tmp_path):
    """rows that hold the same two texts are no more work for Python; a null text has no score."""
    from tallygrid.functions.similarity import match_score
    from tallygrid.operators import match

    one, other = "porcelain tile flooring lobby", "lobby flooring porcelain tile grey"
    pairs = spark.range(3000).selectExpr("id", f"CASE WHEN id % 3 = 0 THEN '{one}' WHEN id % 3 = 1 THEN '{other}' END AS a", f"IF(id % 2 = 0, '{other}', '{one}') AS b")
    for most in (4, 3):
        got = match.score_each(pairs, "a", "b", most)
        assert {(r["id"], r["score"]) for r in got.select("id", "score").collect()} == {(r["id"], None if r["a"] is None else match_score(r["a"], r["b"])) for r in pairs.collect()}
    df = registry.queries()["score_layers"](spark, "/root/testdata/sf0.001")
    assert df.count() == 11 * spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()  # what is left for each row is a join


def test_near_dedup_takes_simhash_candidates():
    """F8: the pipeline's stage makes fingerprints of its shingles and looks them up by Golay keys."""
    import numpy as np

    from tallygrid.llm import near_text

    hashes = near_text.shingles(" ".join(f"w{i}" for i in range(300)))
    bits = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > len(hashes))
    assert near_text.fingerprint(hashes) & (1 << 64) - 1 == bits and near_text.fingerprint(np.zeros(0, np.uint64)) == 0


def test_near_fingerprints_are_exact(spark):
    import itertools
    import random

    from tallygrid.llm import near_text

    r, fps = random.Random(3), []
    for _ in range(20):
        base = r.getrandbits(63)
        fps += [base, base] + [base ^ sum(1 << b for b in r.sample(range(63), n)) for n in (1, 2, 3, 4)]
    sets = spark.createDataFrame(list(enumerate(fps)), "key long, fp long")
    got = {tuple(x) for x in near_text.near_fingerprints(sets).distinct().collect()}
    first = {}
    for k, f in enumerate(fps):
        first.setdefault(f, k)
    want = {(first[f], k) for k, f in enumerate(fps) if first[f] != k} | {tuple(sorted((first[f], first[g]))) for f, g in itertools.combinations(first, 2) if (f ^ g).bit_count() <= 3}
    assert got == want and len(want) > 80


def test_workbook_rows_are_written_as_they_come():
    """no table of a workbook is held."""
    from tallygrid.sources import sinks

    live, most = [0], [0]

    class Row(tuple):
        def __init__(self, *_):
            live[0] += 1
            most[0] = max(most[0], live[0])

        def __del__(self):
            live[0] -= 1

    book = sinks.workbook([("Line Items", (Row((i, f"<{i}>", None)) for i in range(5000)))])
    assert most[0] < 5 and len(book) < 200_000


def test_many_small_rows_are_dealt_to_many_tasks(spark):
    """F1, F9, F11 to F13: texts that are slow to read, and rows that compress well, do not meet in one task."""
    from tallygrid.session import TASK_ROWS, spread, tasks

    assert tasks(spark, 10 * TASK_ROWS * 100) >= 1000 and tasks(spark) >= 4 * spark.sparkContext.defaultParallelism
    d = spread(spark.range(1000).selectExpr("id % 100 AS k", "'same' AS said"), "k")
    used = d.mapInPandas(lambda batches: ([x.assign(n=len(x))] and x.assign(n=1).head(1)[["n"]] for x in batches), "n long")
    assert used.count() > 10


def test_pipeline_stages_hand_python_small_batches(spark):
    """pipeline: a partition of texts is not held whole by a Python worker, nor outside of the heap; a lower limit stays."""
    import corpus_pipeline
    from tallygrid.llm.common import BATCH_BYTES, small_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 400) AS text").coalesce(1)
    try:
        for name, stage in corpus_pipeline.STAGES:
            if name in ("quality_rules", "simhash_near_dedup", "byte_bpe"):
                spark.conf.set(key, was)
                stage(spark, docs.limit(0), "")
                sizes = [r["n"] for r in docs.mapInPandas(lambda bs: (b.head(1).assign(n=b["text"].str.len().sum())[["n"]] for b in bs), "n long").collect()]
                assert max(sizes) < 2 * BATCH_BYTES < sum(sizes), name
        spark.conf.set(key, "4k")
        small_batches(spark)
        assert spark.conf.get(key) == "4k"
    finally:
        spark.conf.set(key, was)


@pytest.mark.parametrize("special", [False, True])
def test_words_of_any_kind_and_a_full_table(special):
    """op9: the table of words gives the library's ids for words at each of its bounds, also when it is emptied over and over."""
    import random

    import numpy as np
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from tallygrid.llm.token_files import Words, WordTokenizer

    library, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), WordTokenizer(P.path("word_bpe_49k.json"), special, places=64)
    library.encode_special_tokens = not special
    r, letters = random.Random(9), "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100)))
    words = ["".join(r.choices(letters, k=r.randint(1, 20))) for _ in range(1500)] + list(letters) + ["a" * n for n in range(14, 20)] + ["é" * n for n in range(7, 10)]
    words += ["x\0", "x", "\0x", "\0", "x\0\0y", "", ".", "a.", "a..", "a.!?", "été$$$", "a" + "." * 8, "a" + "." * 9, "a" + "&" * 20, "A%%%", "a'##", "##", "Å.", "é,", "zq1zq2zq3zq4zq5", "中文字中文", "<|endoftext|>", "<|endoftext|>.", "́", "á", "\x01", " ", "a b", "÷", "ã÷", "÷.", "×,", "É!", "ß.", "a\u031f.", "ε.", "À", "i" * 15 + "é"]
    texts = ["", None, " \t", *(" ".join(r.choices(words, k=r.randint(1, 60))) + r.choice(["", " ", "\n", "\x0b"]) for _ in range(300)), *words]
    for part, own.at_once in ((texts, 1 << 20), (texts[::-1], 50), (texts, 7), ([], 50)):
        got = [np.frombuffer(x, "<u2").tolist() for x in own(part)]
        assert got == [library.encode(t or "", add_special_tokens=False).ids for t in part]
    assert len(own.words.rows) == 64 and 0 < own.words.used < 64
    one = Words(64)
    rows = np.zeros((30, 4), np.uint64)
    rows[:, 0], rows[:, 3] = np.arange(1, 31), 1
    one.add(rows)
    assert (one.find(rows[:, :2]) == rows).all() and not one.find(rows[:, :2] + np.uint64(1 << 40)).any()


def test_known_words_make_no_objects():
    """op9: words that the table has are not looked at one by one, and a mark after a word makes no new word."""
    import public_tokenizers as P

    from tallygrid.llm.token_files import WordTokenizer

    own = WordTokenizer(P.path("word_bpe_49k.json"))
    want = own(["tile flooring in the lobby , . été"])
    own._ids = own._each = None  # neither the library nor a path by single words is asked again
    got = own(["Tile flooring in the lobby, . été", "lobby. lobby, in. été."])
    assert got[0] == want[0] and len(got) == 2


def test_a_worker_keeps_its_tokenizer(monkeypatch):
    """op9: the next task of a worker finds the tokenizer and its words, though the task's function comes pickled."""
    from unittest.mock import MagicMock

    import public_tokenizers as P
    import pyarrow as pa
    import pyspark
    from pyspark import cloudpickle

    from tallygrid.llm import token_files

    docs, made, init = MagicMock(dtypes=[("doc_id", "bigint"), ("text", "string")]), [], token_files.WordTokenizer.__init__
    monkeypatch.setattr(token_files, "saved", lambda df: df)
    monkeypatch.setattr(pyspark, "TaskContext", MagicMock())
    pyspark.TaskContext.get().partitionId.return_value = 0
    monkeypatch.setattr(token_files.WordTokenizer, "__init__", lambda self, *a, **k: made.append(1) or init(self, *a, **k))
    token_files.write(docs, P.path("word_bpe_49k.json"), 1)
    run = docs.select().repartitionByRange().sortWithinPartitions().mapInArrow.call_args[0][0]
    for _ in range(2):
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some text"])], ["doc_id", "text"])
        (out,) = cloudpickle.loads(cloudpickle.dumps(run))(iter([batch]))
        assert token_files.unpack(out.column("payload")[0].as_py())[-1] == 1
    assert len(made) <= 1
