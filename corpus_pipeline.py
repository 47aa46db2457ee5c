"""From raw documents to packed training sequences, in five stages.

``STAGES`` lists (name, function). Each function takes (spark, docs, sf_dir) and returns a
frame; all but the last return the columns of ``docs``. ``run`` writes every stage's result
as Parquet in the folder all executors share and reads it back as the next one's input.

Null and odd values: a document without a telling text (null, empty, no letter, or too short
to favour one language) has no language and goes with the first stage; rows without an id are
documents like any others, and different texts of one id are different documents; extra
columns pass through up to the last stage. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import language, mixing, packing, personal
from tallyspark.llm.minhash import near_duplicates
from tallyspark.llm.queries import tokenizer_path
from tallyspark.llm.scratch import saved

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told from their text."""
    learned = language.learn(
        docs.select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("language"))
    )
    return language.identify(docs, learned).where(~language.rejected()).select(*docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, none last.

    Rows are told apart by id and text, so different texts of one id are different documents,
    and copies without an id go like any others. Of rows that agree in both one stays.
    """
    key = F.struct(
        F.col("doc_id").isNull().alias("without"), "doc_id", F.xxhash64("text").alias("mark")
    )
    decided = near_duplicates(docs.select(key.alias("__key"), "text"), id_column="__key")
    kept = decided.where("kept").select("__key").distinct()
    row = F.struct(*docs.columns)
    return (
        docs.withColumn("__key", key)
        .join(kept, "__key", "left_semi")
        .groupBy("__key")
        .agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("row"))
        .select("row.*")
    )


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the text."""
    clean = personal.redacted(F.col("text"), personal.learn(docs))
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return (
        docs.withColumn("text", clean)
        .withColumn("n_chars", F.coalesce(length, "n_chars"))
        .select(*docs.columns)
    )


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.taken(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("language", identified),
    ("near_dedup", deduplicated),
    ("personal_data", redacted),
    ("mixing", mixed),
    ("packing", packed),
]

ORACLE_SQL = None  # compression, sketches and a tokenizer have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}").frame
    return STAGES[-1][1](spark, docs, sf_dir)
