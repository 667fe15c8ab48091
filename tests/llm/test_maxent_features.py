"""What the language model looks at and how it steps."""

import numpy as np

from tallygrid.llm import maxent_lm


def test_two_last_classes_are_a_feature():
    """Histories of other words but the same two last classes share a row of the table, for any two classes."""
    classes = maxent_lm.Classes({})
    code = maxent_lm.coder(classes, {})
    a = maxent_lm.features([code([b"rating", b"motion"])]).rows
    b = maxent_lm.features([code([b"seeing", b"nation"])]).rows
    assert len(a) == 5 and a[4, 2] == b[4, 2] and (a[:3, 2] != b[:3, 2]).all()


def test_endings_are_characters():
    classes = maxent_lm.Classes({})
    assert maxent_lm.ending("été!".encode()) == "té".encode() and maxent_lm.ending(b"...") == b"..."[-2:]
    code = maxent_lm.coder(classes, {})
    for w in ("naïveté", "中文字", "word."):
        assert int(code([w.encode()])[0]) & 255 == classes.of(w.encode())
    assert maxent_lm.ending("aé".encode()) != maxent_lm.ending("bé".encode())


def test_minibatches_are_of_8192_tokens():
    groups = list(maxent_lm.minibatches(iter(["w " * 4095] * 4), lambda words: np.zeros(len(words), np.int64)))
    assert [len(g) for g in groups] == [2, 2]


def test_score_is_the_product_of_its_parts(spark):
    """Each document's score, word by word, from the trained tables and counts alone."""
    import math

    texts = ["the cat sat on the mat", "the dog sat", None, "", "a catalogue of dogs, cats and mats", "unseen words entirely here", "The CAT sat!"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trained = maxent_lm.train(d.where("doc_id < 5"), rounds=1)
    m, counts = trained.model, {r["word"]: r["n"] for r in trained.counts.collect()}
    cells = {w: (maxent_lm.CLASSES - 1, 0) if w is None else divmod(m.classes.cell(w.encode()), maxent_lm.PARTS) for w in counts}
    size = lambda cell: sum(n + 0.1 for w, n in counts.items() if cells[w] == cell) + 0.1
    code = maxent_lm.coder(m.classes, m.number)
    got = {r["doc_id"]: r["score"] for r in maxent_lm.score(d, trained).collect()}
    for i, t in enumerate(texts):
        words = maxent_lm.words_of(t)
        x = maxent_lm.features([code(words)])
        coarse, total = np.exp(maxent_lm.log_probs(m.table, m.bias, x.rows).astype(float)), 0.0
        finer = {int(at): maxent_lm.log_probs(m.fine, m.fine_bias[x.classes[at]][None], x.fine[:, [j]])[0].astype(float) for j, at in enumerate(x.some)}
        for at, w in enumerate([*words, None]):
            k, part = divmod(m.classes.cell(w), maxent_lm.PARTS) if w is not None else (maxent_lm.CLASSES - 1, 0)
            share = (counts.get(w.decode() if w is not None else None, 0) + 0.1) / size((k, part))
            total += math.log10(coarse[at, k]) + (finer[at][part] / math.log(10) if at in finer else 0.0) + math.log10(share)
        assert abs(got[i] - total) < 1e-4 * max(1, abs(total)), t


def test_words_that_follow_each_other_are_learnt(spark):
    """After training on pairs, the usual follower is likelier in its place than any other word of its own class is."""
    import random

    r = random.Random(3)
    pairs = [(f"aa{i}x", f"bb{i}ing") for i in range(40)]
    texts = [" ".join(w for _ in range(60) for w in r.choice(pairs)) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    trained = maxent_lm.train(d)
    told = spark.createDataFrame([(0, " ".join(w for p in pairs for w in p)), (1, " ".join(w for i in range(40) for w in (pairs[i][0], pairs[(i + 7) % 40][1])))], "doc_id long, text string")
    right, wrong = (x["score"] for x in maxent_lm.score(told, trained).orderBy("doc_id").collect())
    assert right > wrong + 5
