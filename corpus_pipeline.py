"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``, and columns that ``docs`` has besides, whatever
their names. An empty table gives an empty table in every stage. Stages that run Python limit, for the rest of the session, the bytes of a batch of rows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm import bpe_tree, decontaminate, line_dedup, near_text, quality
from tallygrid.llm.common import delete, scratch, shared_folder, small_batches


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    Null and empty texts have no words and go; very long texts are judged whole; repeated rows stay or go together.
    """
    small_batches(spark)
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; n_chars, where there is one, follows the text.

    Every row stays; a null text stays null, and its n_chars too becomes null; an empty one stays empty. Repeated rows and other copies of a text
    count as one page. Very long texts are cut in their row. A null source is a source of its own.
    """
    got = line_dedup.drop_boilerplate(docs, counts=False)
    return got.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else got


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: texts linked by a five-word shingle similarity of 0.8 or more.

    That of the smallest id stays, null ids last. Null and empty texts are copies of each other; of repeated rows one stays; the shingles of a
    very long text are held in memory.
    """
    small_batches(spark)
    return near_text.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate.

    Null and empty texts stay; repeated rows stay or go together; very long texts are judged whole.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.keep_clean(docs, items)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each document that is left, by digest: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have none; repeated rows give repeated results; a very long text is encoded in its row.
    """
    small_batches(spark)
    return bpe_tree.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("decontamination", decontaminated),
    ("byte_bpe", encode),
]

#: Near-duplicate components and merges by rank need iteration over texts that SQL cannot express; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``, each written to the cluster's shared folder and read again.

    What a stage wrote is deleted once the next has been written; the last stage's rows stay, for who reads the result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{at}/{k}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
