"""Copies of a published generation, each damaged in one way, and what the checks say of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.contract import ANALYTIC_COLUMNS
from tallyspark.operators.checks import CHECKS_SCHEMA, dataset_checks
from tallyspark.sources.generations import (
    QUALITY_SCHEMA,
    SUMMARY_SCHEMA,
    generation_path,
    latest_manifest,
    read_sales,
    remove_folder,
    write_sales,
)

Change = Callable[[DataFrame], DataFrame]
_OTHER = "00000000-0000-4000-8000-000000000000"


def _without_a_file(sales: DataFrame) -> DataFrame:
    """The rows of all files but one."""
    path = F.col("_metadata.file_path")
    lost = sales.select(F.min(path)).first()[0]
    return sales.where(path != F.lit(lost))


def _same(rows: DataFrame) -> DataFrame:
    return rows


# Name of the damage: change of table, quality report, summary; changed manifest fields.
DAMAGES: dict[str, tuple[Change, Change, Change, dict]] = {
    "none": (_same, _same, _same, {}),
    "lost_file": (_without_a_file, _same, _same, {}),
    "wrong_count": (_same, _same, _same, {"valid_rows": 1}),
    "ninth_column": (lambda sales: sales.withColumn("extra", F.lit(1)), _same, _same, {}),
    "missing_column": (lambda sales: sales.drop(ANALYTIC_COLUMNS[-1]), _same, _same, {}),
    "missing_reason": (_same, lambda q: q.where(F.col("reason") != q.select(F.min("reason")).first()[0]), _same, {}),
    "too_many_rows_of_a_reason": (_same, lambda q: q.withColumn("rows", F.col("total_rows") + 1), _same, {}),
    "other_id": (_same, _same, lambda s: s.withColumn("generation_id", F.lit(_OTHER)), {}),
    "other_time": (_same, lambda q: q.withColumn("processed_at", F.lit("1999-01-01T00:00:00Z")), _same, {}),
    "other_version": (_same, _same, _same, {"schema_version": 1}),
}


def damaged(spark: SparkSession, root: str, name: str, to: str) -> tuple[str, Row]:
    """Write the damaged copy of the newest generation of ``root``; its root and manifest."""
    manifest = latest_manifest(spark, root)
    generation = manifest["generation_id"]
    of_sales, of_quality, of_summary, fields = DAMAGES[name]

    def part(base: str, what: str) -> str:
        return generation_path(base, generation, what)

    write_sales(of_sales(read_sales(spark, part(root, "sales"))), part(to, "sales"))
    for what, schema, change in (
        ("quality", QUALITY_SCHEMA, of_quality),
        ("summary", SUMMARY_SCHEMA, of_summary),
    ):
        rows = change(spark.read.schema(schema).json(part(root, what)))
        rows.coalesce(1).write.option("ignoreNullFields", False).json(part(to, what))
    values = manifest.asDict()
    values.update({field: values[field] + more for field, more in fields.items()})
    return to, Row(**values)


def checks_of_damaged(spark: SparkSession, root: str, folder: str) -> DataFrame:
    """``damage, check, ok`` for every damage.

    A copy is as large as the generation, so each is deleted before the next one is written;
    of its checks the driver keeps one row each.
    """
    found = []
    for name in DAMAGES:
        try:
            to, manifest = damaged(spark, root, name, f"{folder}/{name}")
            checks = dataset_checks(spark, to, manifest).select("check", "ok").collect()
        finally:
            remove_folder(spark, f"{folder}/{name}")
        found += [(name, *row) for row in checks]
    schema = [T.StructField("damage", T.StringType()), CHECKS_SCHEMA["check"], CHECKS_SCHEMA["ok"]]
    return spark.createDataFrame(found, T.StructType(schema))


CHECKS_SQL = """
SELECT damage, "check", NOT list_contains(failing, "check") AS ok
FROM (VALUES ('none', []), ('lost_file', ['row_counts']),
    ('wrong_count', ['row_counts', 'statistics']), ('ninth_column', ['schema']),
    ('missing_column', ['schema']), ('missing_reason', ['reasons']),
    ('too_many_rows_of_a_reason', ['reasons']),
    ('other_id', ['generation', 'publication', 'statistics']), ('other_time', ['publication']),
    ('other_version', ['declaration'])) AS damages(damage, failing),
  (SELECT unnest(['generation', 'declaration', 'schema', 'row_counts', 'reasons', 'publication',
    'statistics']) AS "check")
"""
