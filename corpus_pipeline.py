"""From documents to token files: language, near copies, benchmark leaks, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns; the last one returns
a row for each document in the files. `run` writes what each stage returns and reads it again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from obsframe.llm import common, decontam, langid, mixing, neardup, tokenfiles
from obsframe.session import cut_lineage, ensure_checkpoint_dir


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose doc_id is not in `ids`; those with a null doc_id stay."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts with letters of which one language has at least half. The model is fitted on the given labels."""
    return langid.accepted(docs, langid.fit(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near copies; of rows that repeat a doc_id, one."""
    repeated = cut_lineage(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if not repeated.isEmpty():
        docs = without(docs, repeated).unionByName(docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return without(docs, cut_lineage(neardup.near_duplicates(docs).filter("NOT kept")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return without(docs, cut_lineage(decontam.contaminated(docs, common.table(spark, sf_dir, "benchmark"))))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample to tempered source, language and topic weights, with nine tenths of the tokens as the aim."""
    drawn = mixing.sample(mixing.weighed(docs))
    return without(docs, cut_lineage(drawn.filter("NOT sampled").select("doc_id")))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files and return (doc_id, start, n_tokens, ids_crc32) as read from them."""
    return tokenfiles.index(spark, tokenfiles.write(docs, tokenfiles.new_folder(spark), tokenfiles.vocabulary()))


STAGES = [("language_id", language), ("minhash_near_dedup", near_copies), ("benchmark_decontamination", decontaminate),
          ("mixing", mixture), ("token_output", token_output)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4()}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
