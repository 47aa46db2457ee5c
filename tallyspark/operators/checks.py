"""Is the latest generation complete and coherent?"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.contract import (
    ANALYTIC_COLUMNS,
    ANALYTIC_SCHEMA,
    REASONS,
    SCHEMA_VERSION,
    STATISTIC_COLUMNS,
    TARGET_HEADER,
)
from tallyspark.functions.text import is_finite
from tallyspark.sources.generations import (
    MANIFEST_SCHEMA,
    QUALITY_SCHEMA,
    SUMMARY_SCHEMA,
    generation_path,
)

CANONICAL_UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
CHECKS_SCHEMA = T.StructType(
    [
        T.StructField("check", T.StringType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("detail", T.StringType()),
    ]
)


def _is_absent(problem: AnalysisException) -> bool:
    """No folder, or nothing in it."""
    return problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def _or_empty(spark: SparkSession, read, schema: T.StructType) -> DataFrame:
    try:
        return read()
    except AnalysisException as problem:
        if not _is_absent(problem):
            raise
        return spark.createDataFrame([], schema)


def _shape(schema: T.StructType) -> list[tuple[str, T.DataType]]:
    return [(field.name, field.dataType) for field in schema.fields]


def _all(tests: list[Column]) -> Column:
    return reduce(and_, tests)


def dataset_checks(
    spark: SparkSession, root: str, manifest: Row | None, *, count_table: bool = True
) -> DataFrame:
    """``check, ok, detail`` for the generation of ``manifest``.

    ``count_table=False`` leaves out the row count, which opens the footer of
    every file; a generation is never changed after its manifest row is written.
    """
    if manifest is None or not manifest["generation_id"]:
        return spark.createDataFrame(
            [("generation", False, "no manifest row with a generation")], CHECKS_SCHEMA
        )
    generation = manifest["generation_id"]

    def part(name: str) -> str:
        return generation_path(root, generation, name)

    try:
        stored = spark.read.parquet(part("sales"))
        schema_matches = _shape(stored.schema) == _shape(ANALYTIC_SCHEMA)
    except AnalysisException as problem:
        if not _is_absent(problem):
            raise
        stored, schema_matches = None, False

    line = T.StructType([T.StructField("value", T.StringType())])
    summary_text = _or_empty(spark, lambda: spark.read.text(part("summary")), line)
    parsed = F.from_json("value", SUMMARY_SCHEMA)
    keys = F.array_sort(F.json_object_keys(F.get_json_object("value", "$.statistics")))
    summary = summary_text.select(parsed.alias("s"), keys.alias("statistic_names")).select(
        F.col("s.generation_id").alias("generation_id"),
        F.col("s.processed_at").alias("s_processed_at"),
        F.col("s.statistics").alias("statistics"),
        "statistic_names",
    )
    quality = (
        _or_empty(
            spark, lambda: spark.read.schema(QUALITY_SCHEMA).json(part("quality")), QUALITY_SCHEMA
        )
        .groupBy("generation_id")
        .agg(
            F.array_sort(F.collect_list("reason")).alias("reasons"),
            F.count_if(
                F.col("rows").isNull() | (F.col("rows") < 0) | (F.col("rows") > F.col("total_rows"))
            ).alias("bad_counts"),
            *(
                # The one value all rows share, else null.
                F.when(
                    (F.min(name) == F.max(name)) & (F.count(name) == F.count("*")), F.min(name)
                ).alias(f"q_{name}")
                for name in (
                    "processed_at",
                    "policy",
                    "total_rows",
                    "valid_rows",
                    "discarded_rows",
                )
            ),
        )
    )
    joined = (
        spark.createDataFrame([manifest], MANIFEST_SCHEMA)
        .join(summary.withColumn("has_summary", F.lit(True)), "generation_id", "left")
        .join(quality.withColumn("has_quality", F.lit(True)), "generation_id", "left")
    )
    if count_table and stored is not None:
        counted = stored.groupBy(F.lit(generation).alias("generation_id")).agg(
            F.count("*").alias("n")
        )
        joined = joined.join(counted, "generation_id", "left").withColumn(
            "table_rows", F.coalesce("n", F.lit(0))
        )
        rows_match = F.col("table_rows") == F.col("valid_rows")
    else:
        joined = joined.withColumn("table_rows", F.lit(None).cast("bigint"))
        rows_match = F.lit(stored is not None)

    s = F.col("statistics")
    others = [s[name] for name in STATISTIC_COLUMNS if name not in ("suma", "conteo")]
    filled = (s["conteo"] > 0) & is_finite(s["suma"]) & _all([is_finite(c) for c in others])
    empty = (s["conteo"] == 0) & (s["suma"] == 0) & _all([c.isNull() for c in others])
    policy, moment = F.col("q_policy"), F.col("processed_at")

    checks: list[tuple[str, Column, Column]] = [
        (
            "generation",
            F.col("generation_id").rlike(CANONICAL_UUID)
            & F.col("has_summary")
            & F.col("has_quality")
            & F.lit(stored is not None),
            F.lit("table, summary, quality and manifest carry one generation"),
        ),
        (
            "declaration",
            (F.col("schema_version") == SCHEMA_VERSION)
            & (F.col("stat_target_column") == TARGET_HEADER)
            & (F.col("analytic_columns") == F.array(*map(F.lit, ANALYTIC_COLUMNS))),
            F.lit("schema version, target column and columns are as declared"),
        ),
        ("schema", F.lit(schema_matches), F.lit("the stored table has the analytic schema")),
        (
            "row_counts",
            rows_match
            & (F.col("valid_rows") >= 0)
            & (F.col("discarded_rows") >= 0)
            & (F.col("q_valid_rows") == F.col("valid_rows"))
            & (F.col("q_discarded_rows") == F.col("discarded_rows"))
            & (F.col("q_total_rows") == F.col("valid_rows") + F.col("discarded_rows")),
            F.format_string(
                "table %d, valid %d, discarded %d, total %d",
                "table_rows",
                "valid_rows",
                "discarded_rows",
                "q_total_rows",
            ),
        ),
        (
            "reasons",
            (F.col("reasons") == F.array(*map(F.lit, sorted(REASONS))))
            & (F.col("bad_counts") == 0),
            F.lit("exactly the named reasons, each from 0 to the total"),
        ),
        (
            "publication",
            (F.length(policy) > 0)
            & (F.length(moment) > 0)
            & (F.col("s_processed_at") == moment)
            & (F.col("q_processed_at") == moment),
            F.lit("policy present and one publication time"),
        ),
        (
            "statistics",
            (F.col("statistic_names") == F.array(*map(F.lit, sorted(STATISTIC_COLUMNS))))
            & (filled | empty)
            & (s["conteo"] == F.col("valid_rows")),
            F.lit("seven statistics, finite, null only without rows"),
        ),
    ]
    listed = F.array(
        *(
            F.struct(
                F.lit(name).alias("check"),
                F.coalesce(test, F.lit(False)).alias("ok"),
                detail.alias("detail"),
            )
            for name, test, detail in checks
        )
    )
    return joined.select(F.inline(listed))
