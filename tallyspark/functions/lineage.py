"""Intermediate results written to the folder all executors share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def new_folder(spark: SparkSession, label: str) -> str:
    """A name of its own in the session's ``spark.checkpoint.dir``.

    Only a session on one machine without it gets a temporary folder; a cluster without it
    is refused.
    """
    context = spark.sparkContext
    shared = spark.conf.get(_SETTING, None) or context.getCheckpointDir()
    if not shared:
        if not context.master.startswith("local["):
            raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.mkdtemp(prefix="run-")
        shared = _own[context.applicationId]
    return f"{shared.rstrip('/')}/{label}-{uuid4().hex}"


def written(frame: DataFrame, path: str) -> DataFrame:
    """``frame``, computed once and read back from compressed files at ``path``."""
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


class Tables:
    """Written frames that are deleted when the block ends.

    Inside of the block Spark deletes the shuffle files of a query when the query ends, not
    when the driver comes to collect its garbage.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self._spark = spark
        self._folder = new_folder(spark, label)
        self._count = 0

    def __enter__(self) -> Tables:
        self._before = self._spark.conf.get(_FREE_SHUFFLES, None)
        self._spark.conf.set(_FREE_SHUFFLES, "true")
        return self

    def __exit__(self, *_) -> None:
        conf = self._spark.conf
        conf.unset(_FREE_SHUFFLES) if self._before is None else conf.set(_FREE_SHUFFLES, self._before)
        folder = self._spark._jvm.org.apache.hadoop.fs.Path(self._folder)
        folder.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(folder, True)

    def cut(self, frame: DataFrame) -> DataFrame:
        """``frame`` without its lineage; it can be read until the block ends."""
        self._count += 1
        return written(frame, f"{self._folder}/{self._count}")
