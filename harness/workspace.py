"""Where queries of the harness may write: the extract and the published dataset.

Both are made once per session and input folder, the way a daily extract is
ingested once and queried many times.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harness.dirty_sales import dirty_sales
from tallyspark.contract import GENDER_HEADER, GENDER_HEADER_ALIAS
from tallyspark.plans.ingest import ingest

_made: dict[tuple[str, str], str] = {}
# A compressed file is read by one task, so files are many and small.
_COMPRESSED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": 50_000}


def _once(spark: SparkSession, sf_dir: str, what: str, make) -> str:
    key = (f"{spark.sparkContext.applicationId} {sf_dir}", what)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def work_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where everything is one machine."""

    def choose() -> str:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            return tempfile.mkdtemp(prefix="run-")
        return f"{shared.rstrip('/')}/tally-{spark.sparkContext.applicationId}"

    return _once(spark, "", "work", choose)


def new_dir(spark: SparkSession, sf_dir: str, what: str) -> str:
    scale = sf_dir.rstrip("/").rsplit("/", 1)[-1]
    return f"{work_dir(spark)}/{scale}/{what}"


def write_extract(raw: DataFrame, path: str, separator: str, more: dict | None = None) -> None:
    (
        raw.write.option("header", True)
        .option("sep", separator)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .options(**more or {})
        .csv(path)
    )


def extract(spark: SparkSession, sf_dir: str) -> str:
    """The semicolon form, with the unaccented gender header, compressed."""

    def make() -> str:
        path = new_dir(spark, sf_dir, "extract")
        raw = dirty_sales(spark, sf_dir).withColumnRenamed(GENDER_HEADER, GENDER_HEADER_ALIAS)
        write_extract(raw, path, ";", _COMPRESSED)
        return path

    return _once(spark, sf_dir, "extract", make)


def comma_extract(spark: SparkSession, sf_dir: str) -> str:
    """The comma form: columns in reverse order, one more column, quoted separators."""

    def make() -> str:
        path = new_dir(spark, sf_dir, "comma")
        raw = dirty_sales(spark, sf_dir).withColumn("NOTA", F.lit('a, "b"; c'))
        write_extract(raw.select(*(F.col(f"`{c}`") for c in reversed(raw.columns))), path, ",")
        return path

    return _once(spark, sf_dir, "comma", make)


def published(spark: SparkSession, sf_dir: str) -> str:
    def make() -> str:
        root = new_dir(spark, sf_dir, "published")
        ingest(spark, extract(spark, sf_dir), root)
        return root

    return _once(spark, sf_dir, "published", make)
