"""Generated code in pieces that the JVM compiles.

Spark generates one method for all neighbouring projections. Beyond 8,000 bytes of bytecode
the JVM never compiles it but interprets every row, some three times as slow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

COMPILED_BYTES = 8_000  # fixed value: the JVM's limit for a method it compiles


def new_method(rows: DataFrame) -> DataFrame:
    """The same rows; what follows is generated as code of its own.

    A node that only counts stands between, which costs a copy of each row and no shuffle.
    Columns nobody reads are still dropped below it; filters stay above.
    """
    return rows.observe(Observation(), F.count(F.lit(1)).alias("rows"))


def method_bytes(rows: DataFrame) -> list[int]:
    """Bytecode of the largest method of each generated part of a plan without shuffles."""
    session = rows.sparkSession
    debug = getattr(session._jvm.org.apache.spark.sql.execution.debug, "package$")
    parts = getattr(debug, "MODULE$").codegenStringSeq(rows._jdf.queryExecution().executedPlan())
    return [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())]
