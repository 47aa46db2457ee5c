"""Published dataset generations.

Layout under one root::

    gen=<uuid>/sales/     the analytic table (Parquet, zstd)
    gen=<uuid>/quality/   one JSON row per reason, with the totals
    gen=<uuid>/summary/   one JSON row with the global statistics
    gen=<uuid>/manifest/  one JSON row that describes the generation
    newest/               empty files ``<moment>-<uuid>`` of the newest generations, made last

A generation exists for readers only once its file in ``newest`` does. An empty file is there
or not on every store, so a crash at any point leaves the previous generation in place; its
name says all, so finding the newest generation costs one short listing, however many there
were. Nothing is overwritten: a reader never sees parts of two generations.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from tallyspark.contract import ANALYTIC_SCHEMA, STATISTICS_SCHEMA


_NAMED = 2  # generations that ``newest`` names; the second covers readers of the last swap
_MOMENT = "%Y%m%d%H%M%S%f"
_TIMESTAMPS = "spark.sql.parquet.outputTimestampType"


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


QUALITY_SCHEMA = _fields(
    generation_id=T.StringType(),
    processed_at=T.StringType(),
    policy=T.StringType(),
    total_rows=T.LongType(),
    valid_rows=T.LongType(),
    discarded_rows=T.LongType(),
    reason=T.StringType(),
    rows=T.LongType(),
)
SUMMARY_SCHEMA = _fields(
    generation_id=T.StringType(),
    processed_at=T.StringType(),
    statistics=STATISTICS_SCHEMA,
)
MANIFEST_SCHEMA = _fields(
    generation_id=T.StringType(),
    schema_version=T.LongType(),
    source=T.StringType(),
    source_files=T.LongType(),
    source_bytes=T.LongType(),
    source_changed_us=T.LongType(),
    source_listing=T.LongType(),
    source_fingerprint=T.StringType(),
    valid_rows=T.LongType(),
    discarded_rows=T.LongType(),
    processed_at=T.StringType(),
    duration_seconds=T.DoubleType(),
    stat_target_column=T.StringType(),
    analytic_columns=T.ArrayType(T.StringType()),
    table_files=T.LongType(),
    table_bytes=T.LongType(),
    on_malformed=T.StringType(),
    multi_line=T.BooleanType(),
)


def generation_path(root: str, generation_id: str, part: str) -> str:
    return f"{root}/gen={generation_id}/{part}"


def folder_listing(spark: SparkSession, path: str) -> tuple[int, int]:
    """Files below a folder and their bytes; (0, 0) if there is none. No file is opened."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return 0, 0
    summary = system.getContentSummary(folder)
    return summary.getFileCount(), summary.getLength()


def _open(spark: SparkSession, path: str):
    """A path and the file system it is on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no folder."""
    folder, system = _open(spark, path)
    if not system.exists(folder):
        return []
    return sorted(entry.getPath().getName() for entry in system.listStatus(folder))


def newest_generations(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(moment, generation) of the newest published generations, the newest first."""
    marks = (re.fullmatch(r"(\d{20})-(.+)", name) for name in _names(spark, f"{root}/newest"))
    return sorted((mark.groups() for mark in marks if mark), reverse=True)


def publish_generation(
    spark: SparkSession, root: str, generation_id: str, processed_at: str
) -> None:
    """Make a complete generation the newest one, in one step."""
    mark, system = _open(spark, f"{root}/newest/{re.sub(r'[^0-9]', '', processed_at)}-{generation_id}")
    system.mkdirs(mark.getParent())
    if not system.createNewFile(mark):
        raise OSError(f"{mark} exists already")


def forget_older(spark: SparkSession, root: str) -> None:
    """Let ``newest`` name the newest generations only."""
    for moment, generation in newest_generations(spark, root)[_NAMED:]:
        mark, system = _open(spark, f"{root}/newest/{moment}-{generation}")
        system.delete(mark, False)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder and all in it, if it is there."""
    folder, system = _open(spark, path)
    system.delete(folder, True)


def remove_generation(spark: SparkSession, root: str, generation_id: str) -> None:
    """Delete a generation that readers cannot find; a published one stays."""
    if generation_id in {generation for _, generation in newest_generations(spark, root)}:
        return
    remove_folder(spark, f"{root}/gen={generation_id}")


def expire_generations(spark: SparkSession, root: str, age: timedelta) -> list[str]:
    """Delete superseded generations and what crashed ingests left; returns their ids.

    The newest two always stay. Of the others one goes if the generation that superseded it
    was published, and its own last file written, more than ``age`` ago. So every reader has
    ``age`` to finish after its generation was superseded, and an ingest that runs is safe if
    it writes a file at least that often.
    """
    named = newest_generations(spark, root)
    if not named:
        return []
    superseded = datetime.strptime(named[-1][0], _MOMENT).replace(tzinfo=UTC).timestamp()
    limit = time.time() - age.total_seconds()
    if superseded > limit:
        return []
    published = {generation for _, generation in named}
    gone = []
    for name in _names(spark, root):
        generation = name.removeprefix("gen=")
        if generation == name or generation in published:
            continue
        folder, system = _open(spark, f"{root}/{name}")
        files, changed = system.listFiles(folder, True), 0
        while files.hasNext():
            changed = max(changed, files.next().getModificationTime())
        if changed / 1000 <= limit:
            system.delete(folder, True)
            gone.append(generation)
    return gone


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def write_sales(valid: DataFrame, path: str) -> None:
    """Parquet sink. Column statistics are always written.

    Moments are stored as microseconds: Spark's default form (INT96) has no statistics. Each
    task sorts its own rows by time, without a shuffle, so the column index lets a time
    range skip pages and row groups of every file, whatever the order of the source. Bloom
    filters on the two identifiers let a lookup of one customer or product skip row groups,
    which minimum and maximum cannot do for random values.
    """
    sorted_rows = valid.sortWithinPartitions("fecha") if "fecha" in valid.columns else valid
    with _setting(valid.sparkSession, _TIMESTAMPS, "TIMESTAMP_MICROS"):
        (
            sorted_rows.write.option("compression", "zstd")
            .option("parquet.bloom.filter.enabled#codigo_cliente", "true")
            .option("parquet.bloom.filter.enabled#sku", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .parquet(path)
        )


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANALYTIC_SCHEMA).parquet(path)


def write_rows(
    spark: SparkSession, rows: list[tuple], schema: T.StructType, path: str
) -> None:
    """A handful of rows as one JSON file; null fields stay visible."""
    frame = spark.createDataFrame(rows, schema).coalesce(1)
    frame.write.option("ignoreNullFields", False).json(path)


def _read_manifests(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST_SCHEMA).json(path)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def manifests(spark: SparkSession, root: str) -> DataFrame | None:
    """Manifest rows of all generations that are stored, expired ones left out."""
    return _read_manifests(spark, generation_path(root, "*", "manifest"))


def latest_manifest(spark: SparkSession, root: str) -> Row | None:
    """Manifest row of the newest published generation; no other one is read."""
    named = newest_generations(spark, root)
    if not named:
        return None
    rows = _read_manifests(spark, generation_path(root, named[0][1], "manifest"))
    return None if rows is None else rows.first()
