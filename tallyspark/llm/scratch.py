"""Tables written to the folder all executors share, to cut lineage and survive lost executors.

The folder is the session's ``spark.checkpoint.dir``. Only a session on one machine
that has none gets a temporary folder; a cluster without it is refused.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    shared = spark.conf.get(_SETTING, None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _own:
        _own[application] = tempfile.mkdtemp(prefix="run-")
    return _own[application]


@dataclass(frozen=True)
class Table:
    """A written frame. ``discard`` deletes it once nothing reads it any more."""

    frame: DataFrame
    path: str

    def discard(self) -> None:
        spark = self.frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.delete(path, True)


def saved(frame: DataFrame, label: str, by: str | None = None, free: bool = False) -> Table:
    """Write ``frame`` once and read it back; later plans start from the written rows.

    With ``by``, rows are written by their value of that column, and readers that ask for one
    value read nothing else. With ``free``, Spark deletes the job's shuffle files when the rows
    are written, as nothing reads them again.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid4().hex}"
    writer = frame.write.option("compression", "zstd")
    before = spark.conf.get(_FREE_SHUFFLES, None)
    if free:
        spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        if free:
            spark.conf.unset(_FREE_SHUFFLES) if before is None else spark.conf.set(_FREE_SHUFFLES, before)
    return Table(spark.read.schema(frame.schema).parquet(path), path)
