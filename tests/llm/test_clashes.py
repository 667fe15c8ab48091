"""Columns of the caller's whose names the operators use themselves, in any case: results and the columns themselves are as without them."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tallygrid.llm import bpe_tree, decontaminate, line_dedup, maxent_lm, near_text, pii, quality, queries, sharding, simhash_golay, token_files
from tests.conftest import SF

NAMES = (
    "a b beyond block bucket buckets cell cut cut_ _cut digest digest_ _digest doc key KEY_ found found_ _found fp h host host_ _host hashes id _id k kept kept_ _kept keys label "
    "least linked lines_ _lines n n_words name name_ _name new_ _new number page part place rank row row_ _r r size spot t total w win word words shard_ s none _s_key"
).split()
FORMS = [(i % 40, None if i % 11 == 0 else f"word{i % 7} of note, 4111 1111 1111 1111 seen on 2020-02-0{i % 9 + 1}.\nmenu\n" + " ".join(f"w{(i * k) % 97}" for k in range(60)), f"h{i % 2}") for i in range(60)]


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(FORMS)], "doc_id long, text string, source string, at long").repartition(3, "at").cache()


@pytest.fixture(scope="module")
def crowded(plain):
    return plain.select("*", *(F.concat(F.lit(f"{n}-"), F.col("at").cast("string")).alias(n) for n in NAMES)).cache()


def items(spark):
    return spark.createDataFrame([(1, "word3 of note 4111 1111 1111 1111 seen on 2020 02 04 menu w0 w3")], "item_id long, text string")


TOKENS = P.path("word_bpe_49k.json")
WHOLE = {
    "drop_boilerplate": lambda s, d: line_dedup.drop_boilerplate(d, ratio=0.3),
    "drop_boilerplate_by_join": lambda s, d: line_dedup.drop_boilerplate(d, ratio=0.3, most_broadcast=0),
    "drop_boilerplate_text_only": lambda s, d: line_dedup.drop_boilerplate(d, ratio=0.3, counts=False),
    "pseudonymize": lambda s, d: pii.pseudonymize(d, "k"),
    "keep_clean": lambda s, d: decontaminate.keep_clean(d, items(s)),
    "keep_good": lambda s, d: quality.keep_good(d, rules=quality.RULES[:3]),
    "golay_one_of_each": lambda s, d: simhash_golay.one_of_each(d),
    "near_one_of_each": lambda s, d: near_text.one_of_each(d),
    "shard_rows": lambda s, d: sharding.shard_rows(d, F.col("text"), shards=4),
}
NARROW = {
    "encode_documents": lambda s, d: bpe_tree.encode_documents(d, queries.MULTI_RANKS, P.PATTERN),
    "near_duplicates": lambda s, d: simhash_golay.near_duplicates(d),
    "contamination": lambda s, d: decontaminate.contamination(d, items(s)),
    "verdicts": lambda s, d: quality.verdicts(d),
    "token_files": lambda s, d: token_files.read(token_files.write(d, TOKENS, 1)),
    "maxent_lm": lambda s, d: maxent_lm.score(d, maxent_lm.train(d, rounds=1)).select("doc_id", "n_tokens", "n_known", F.round("base_score", 6)),
}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", WHOLE)
def test_whole_rows(spark, plain, crowded, name):
    want, got = WHOLE[name](spark, plain), WHOLE[name](spark, crowded).cache()
    assert set(crowded.columns) <= set(got.columns) and got.count() > 0
    new = [c for c in want.columns if c not in plain.columns]
    if name.endswith("one_of_each"):  # which of the rows that differ in other columns only stays depends on these
        assert rows(got.select("doc_id", "text")) == rows(want.select("doc_id", "text"))
    elif name != "shard_rows":
        assert rows(got.select(*plain.columns, *new)) == rows(want)
    else:
        assert rows(got.groupBy("shard").count()) == rows(want.groupBy("shard").count()) == [(k, 15) for k in range(4)]
    assert got.where(" OR ".join(f"`{n}` IS NULL OR `{n}` <> concat('{n}-', at)" for n in NAMES)).count() == 0
    assert {f.name: f.dataType for f in got.schema}.items() >= {f.name: f.dataType for f in crowded.schema}.items()


@pytest.mark.parametrize("name", NARROW)
def test_results(spark, plain, crowded, name):
    assert rows(NARROW[name](spark, crowded)) == rows(NARROW[name](spark, plain))


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, crowded, stage):
    import corpus_pipeline

    name, f = corpus_pipeline.STAGES[stage]
    docs = crowded.withColumns({c: F.lit("own") for c in ("n_lines", "n_dropped")})
    got = f(spark, docs, SF)
    if stage < 4:
        assert got.columns == docs.columns and got.where("n_lines <> 'own' OR n_dropped <> 'own'").count() == 0
        assert got.where(" OR ".join(f"`{n}` IS NULL OR `{n}` <> concat('{n}-', at)" for n in NAMES)).count() == 0
    none = f(spark, docs.limit(0), SF)
    assert none.count() == 0 and none.columns == got.columns
