"""The documents table from raw rows to token ids, in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and reread as the next one's docs. All but the last return the columns
of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelops.llm import bpe, byte_classifier, decontaminate, jaccard_join, line_templates
from labelops.session import stored

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    network = byte_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return byte_classifier.accepted(docs, network)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go but for their first; a document that has nothing left goes too."""
    return line_templates.without_emptied(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of each group of linked rows.

    Rows are told apart by all their columns, not by doc_id, so a doc_id may keep
    some of its rows and lose others. Of equal rows one stays; rows without words
    are linked with nothing and all stay. A null doc_id comes after all others.
    """
    # Nulls do not change a hash, so where they are is hashed as well.
    row = F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])
    keyed = docs.withColumn("__row", row)
    linked = jaccard_join.jaccard_join(keyed.select(F.col("__row").alias("doc_id"), "text")).where("n_shingles > 0")
    linked = linked.groupBy(F.col("doc_id").alias("__row")).agg(F.min("component_id").alias("group"), F.count("*").alias("copies"))
    ids = keyed.select("__row", F.col("doc_id").cast("long").alias("id")).distinct()
    rows = stored(linked.join(ids, "__row"), "linked_rows")
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "__row")).getField("__row").alias("first"))
    told = rows.join(first, "group")
    repeated = told.where("__row = first and copies > 1").select("__row")
    others = told.where("__row <> first or copies > 1").select("__row")
    once = keyed.join(others, "__row", "left_anti")
    one_of = keyed.join(repeated, "__row", "left_semi").dropDuplicates(["__row"])
    return once.unionByName(one_of).select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their digest, and that of the text decoded from them."""
    return bpe.encode_and_decode(docs, BYTE_BPE, with_ids=True)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("bpe_encoding", tokens),
]

# The classifier is trained and similarity components are iterative.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
