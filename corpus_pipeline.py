"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and returns the documents that the next one gets.

Language identification drops texts without any letter; near-duplicate groups keep their smallest doc_id; rows
that hold a window of a benchmark item go, other rows of their doc_id stay; personal data is masked in place; what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.llm import decontam, langid, pieces, pii, simhash
from trailmill.llm.common import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify(docs, langid.learn(docs), out_lang="__lang", out_score="__score")
    return found.where(F.col("__lang") != langid.UNKNOWN).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows leave by id and text hash: ids can be null or repeated, and a row goes for its own text only
    keyed = docs.withColumn("__th", F.xxhash64(F.coalesce("text", F.lit(""))))
    key = F.struct("doc_id", "__th")
    found = decontam.contamination(keyed.select(key.alias("key"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    bad = materialize(found.where("contaminated").select(F.col("key.doc_id").alias("__id"), F.col("key.__th").alias("__bad")).distinct(), "contaminated")
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__bad")), "left_anti").drop("__th")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(docs)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("pii", personal_data),
    ("sentencepiece", encode),
]

#: Language models, expectation-maximisation and merges are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
