"""Statistics over the latest published generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tallyspark.contract import STATISTIC_COLUMNS
from tallyspark.errors import NotReadyError
from tallyspark.operators.batch import batch_statistics
from tallyspark.operators.checks import dataset_checks
from tallyspark.operators.filters import FilterSpec
from tallyspark.operators.statistics import seven_statistics
from tallyspark.sources.generations import (
    QUALITY_SCHEMA,
    SUMMARY_SCHEMA,
    folder_listing,
    generation_path,
    latest_manifest,
    read_sales,
)


_verified: set[tuple] = set()  # generations found coherent, as they were then


def ready_manifest(spark: SparkSession, root: str) -> Row:
    """Manifest row of the latest generation; ``NotReadyError`` if it cannot be served.

    Files and bytes of the table are compared with the manifest on every call. All other
    checks, the row count included, run once per session for a generation whose folder
    has not changed since.
    """
    manifest = latest_manifest(spark, root)
    state: tuple = ()
    if manifest is not None and manifest["generation_id"]:
        generation = manifest["generation_id"]
        listed = folder_listing(spark, generation_path(root, generation, "sales"))
        if listed != (manifest["table_files"], manifest["table_bytes"]):
            raise NotReadyError("the dataset is not ready: files of the table are missing or changed")
        whole = folder_listing(spark, f"{root}/gen={generation}")
        state = (spark.sparkContext.applicationId, root, tuple(map(str, manifest)), whole)
        if state in _verified:
            return manifest
    checks = dataset_checks(spark, root, manifest)
    failed = [row["check"] for row in checks.where(~F.col("ok")).collect()]
    if failed:
        raise NotReadyError(f"the dataset is not ready: {', '.join(failed)}")
    _verified.add(state)
    return manifest


def published_sales(spark: SparkSession, root: str) -> DataFrame:
    manifest = ready_manifest(spark, root)
    return read_sales(spark, generation_path(root, manifest["generation_id"], "sales"))


def published_quality(spark: SparkSession, root: str) -> DataFrame:
    """``reason, rows`` and the totals of the latest generation."""
    manifest = ready_manifest(spark, root)
    path = generation_path(root, manifest["generation_id"], "quality")
    return spark.read.schema(QUALITY_SCHEMA).json(path)


def stored_statistics(spark: SparkSession, root: str) -> DataFrame:
    """The global statistics written at ingest; the table is not read."""
    manifest = ready_manifest(spark, root)
    path = generation_path(root, manifest["generation_id"], "summary")
    return spark.read.schema(SUMMARY_SCHEMA).json(path).select(
        *(F.col(f"statistics.{name}").alias(name) for name in STATISTIC_COLUMNS)
    )


def statistics(spark: SparkSession, root: str, spec: FilterSpec | None = None) -> DataFrame:
    """Seven statistics of the sales ``spec`` selects; without filters, the stored ones."""
    if spec is None or spec.is_empty:
        return stored_statistics(spark, root)
    return seven_statistics(spec.apply(published_sales(spark, root)))


def statistics_of_requests(spark: SparkSession, root: str, requests: DataFrame) -> DataFrame:
    """Seven statistics per request row; see ``batch_statistics``."""
    return batch_statistics(published_sales(spark, root), requests)
