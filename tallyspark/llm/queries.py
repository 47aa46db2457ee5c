"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import (
    divergence,
    extraction,
    language,
    mixing,
    oracles,
    packing,
    personal,
    quality,
    repeats,
    toxicity,
    warc,
)
from tallyspark.llm.minhash import near_duplicates
from tallyspark.llm.search import search
from tallyspark.llm.vectors import near_duplicate_vectors

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return personal.digest(documents, personal.learn(documents))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(_table(spark, sf_dir, "pages")))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    held = language.held_out(F.col("doc_id"))
    learned = language.learn(
        documents.where(~held).select(
            F.col("doc_id").alias("key"), "text", F.col("lang").alias("language")
        )
    )
    rows = documents.select("doc_id", "text", held.alias("held_out"))
    return language.identify(rows, learned).select(
        "doc_id",
        "held_out",
        F.col("__language").alias("lang_pred"),
        F.col("__score").alias("score"),
        F.col("__margin").alias("margin"),
        language.rejected().alias("rejected"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id",
        *(F.col(f"__mix.{name}") for name in ("size", "source_size", "target", "taken")),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(
        _table(spark, sf_dir, "documents"),
        _table(spark, sf_dir, "labels"),
        language.held_out(F.col("doc_id")),
    )


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op8_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(_table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_minhash": op1_minhash,
    "op2_personal_data": op2_personal_data,
    "op3_warc": op3_warc,
    "op4_language": op4_language,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_vectors": op7_vectors,
    "op8_extraction": op8_extraction,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "op11_search": op11_search,
    "op12_repeats": op12_repeats,
    "op13_divergence": op13_divergence,
}
SQL: dict[str, str] = {
    "op5_mixing": r"""
WITH sized AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || md5(coalesce(text, '')) || '/' ||
        row_number() OVER (PARTITION BY doc_id, text, source)), 1, 13))::BIGINT + 0.5::DOUBLE)
      / 4503599627370496.0::DOUBLE AS draw
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight,
    source_size * 3 AS cap FROM totals),
levels AS (
  SELECT *, cap::DOUBLE / weight AS ratio,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER sooner, 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER sooner, 0))::DOUBLE AS level
  FROM weighted
  WINDOW sooner AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
first_open AS (
  SELECT arg_min(level, ratio) AS level FROM levels WHERE ratio > level),
targets AS (
  SELECT source, source_size,
    coalesce(least(cap::DOUBLE, f.level * weight), cap::DOUBLE) AS target
  FROM levels LEFT JOIN first_open f ON true),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole
  FROM targets),
wants AS (SELECT *, target - whole * source_size AS wanted FROM parts),
rests AS (
  SELECT *, CASE WHEN source_size > 0 THEN wanted / source_size ELSE 0.0::DOUBLE END AS rest
  FROM wants),
ranked AS (
  SELECT s.*, r.source_size, r.target, r.whole, r.wanted, r.rest,
    CASE WHEN r.rest > 0 THEN (draw / (1.0::DOUBLE - draw)) / (rest / (1.0::DOUBLE - rest)) END AS rank
  FROM sized s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source),
summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after
  FROM ranked),
fitting AS (SELECT *, rest > 0 AND after <= wanted AS fits FROM summed),
gaps AS (
  SELECT *, wanted - coalesce(max(CASE WHEN fits THEN after END) OVER (PARTITION BY source), 0)
    AS missing FROM fitting),
fillers AS (
  SELECT *, CASE WHEN rest > 0 AND NOT fits AND abs(missing - size) < missing THEN
      row_number() OVER (PARTITION BY source, rest > 0 AND NOT fits AND abs(missing - size) < missing
                         ORDER BY abs(missing - size), rank, doc_id) END AS turn
  FROM gaps)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN fits OR coalesce(turn = 1, false) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM fillers
""",
    "op11_search": oracles.SEARCH,
    "op13_divergence": oracles.DIVERGENCE,
}
