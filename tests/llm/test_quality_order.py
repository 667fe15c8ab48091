"""The cascade's order decides what is computed."""

from tallygrid.llm import quality


def test_only_the_rules_reject(spark):
    """Word count and repeated words are rules like the others, so without them nothing else rejects."""
    docs = spark.createDataFrame([(1, "few words"), (2, None), (3, "again and again " * 40)], "doc_id long, text string")
    assert quality.keep_good(docs, rules=()).count() == 3
    named = {r.name: r for r in quality.RULES}
    assert [r[0] for r in quality.keep_good(docs, rules=(named["short"],)).select("doc_id").collect()] == [3]
    assert quality.keep_good(docs).count() == 0


def test_the_sample_covers_all_partitions_and_lengths(spark):
    """A rule that rejects long texts only, and those of the last partitions, is found to reject; a costly one that rejects nothing comes last."""
    import time

    from pyspark.sql import functions as F

    def slow(view):
        time.sleep(0.002)
        return False

    rules = (quality.Rule("slow", slow), quality.Rule("never", lambda v: False), quality.Rule("long", lambda v: len(v.text) > 100_000))
    docs = spark.range(0, 400, 1, 8).select(F.col("id").alias("doc_id"), F.when(F.col("id") >= 300, F.repeat(F.lit("long text "), F.lit(12_000))).otherwise("short").alias("text"))
    assert [r.name for r in quality.cascade(docs, rules=rules, sample_rows=100)] == ["long", "never", "slow"]
    assert quality.cascade(docs.limit(0), rules=rules) == list(rules) and quality.cascade(docs, rules=()) == []
    assert quality.keep_good(docs, rules=rules).count() == 300
