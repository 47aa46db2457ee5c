"""The raw sales extract: a CSV file, or a directory or glob of equal ones."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.contract import GENDER_HEADER, GENDER_HEADER_ALIAS, NULL_TOKENS, RAW_COLUMNS
from tallyspark.errors import IngestError
from tallyspark.functions.text import null_if_token

MALFORMED = "__malformed"
REPLACEMENT = "\ufffd"
_BROKEN_LINE = "__broken_line"


def header_line(spark: SparkSession, path: str) -> str:
    first = spark.read.text(path).first()
    if first is None:
        raise IngestError("the source is empty")
    return first["value"].removeprefix("﻿")


def detect_separator(header: str) -> str:
    """The more frequent of ``;`` and ``,`` in the header; a tie means ``,``."""
    separator = max(",;", key=header.count)
    if separator not in header:
        raise IngestError("the header has no separator")
    return separator


def check_header(names: list[str]) -> None:
    """Every contract column once; ``GENERO`` may stand for ``GÉNERO``, but not beside it."""
    folded = [name.casefold() for name in names]
    repeated = sorted({name for name in names if folded.count(name.casefold()) > 1})
    if repeated:
        raise IngestError(f"repeated columns: {', '.join(repeated)}")
    if GENDER_HEADER in names and GENDER_HEADER_ALIAS in names:
        raise IngestError(f"both {GENDER_HEADER_ALIAS} and {GENDER_HEADER} are present")
    present = {GENDER_HEADER if name == GENDER_HEADER_ALIAS else name for name in names}
    missing = sorted(set(RAW_COLUMNS) - present)
    if missing:
        raise IngestError(f"missing columns: {', '.join(missing)}")


def read_sales_csv(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """The 15 contract columns as text, plus ``__malformed`` (too few or too many fields).

    The header of the first file gives separator and columns; Spark checks the
    header of every other file against it. ``multi_line`` allows line breaks
    inside quotes, but makes each file one task.
    """
    line = header_line(spark, path)
    separator = detect_separator(line)
    names = next(csv.reader([line], delimiter=separator))
    check_header(names)
    named = [name or f"_c{position}" for position, name in enumerate(names)]
    schema = T.StructType(
        [T.StructField(name, T.StringType()) for name in (*named, _BROKEN_LINE)]
    )
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", named != names)
        .option("sep", separator)
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BROKEN_LINE)
        # Pruned columns are not parsed, and then a wrong field count goes unseen.
        .option("columnPruning", False)
        .option("multiLine", multi_line)
        .csv(path)
    )
    if GENDER_HEADER_ALIAS in names:
        rows = rows.withColumnRenamed(GENDER_HEADER_ALIAS, GENDER_HEADER)
    return rows.select(
        *(null_if_token(F.col(f"`{name}`"), NULL_TOKENS).alias(name) for name in RAW_COLUMNS),
        F.col(_BROKEN_LINE).isNotNull().alias(MALFORMED),
    )


def damaged_lines(spark: SparkSession, path: str) -> int:
    """Lines whose bytes are not UTF-8. The CSV reader turns such bytes into ``REPLACEMENT``."""
    lines = spark.read.text(path)
    return lines.where(~F.call_function("is_valid_utf8", F.col("value"))).count()


def source_listing(spark: SparkSession, path: str) -> Row:
    """Files, bytes, newest change and a hash over all of them; no content is read."""
    files = spark.read.format("binaryFile").load(path)
    change = F.unix_micros("modificationTime")
    identity = F.xxhash64("path", "length", change)
    return files.agg(
        F.count("*").alias("source_files"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("source_bytes"),
        F.coalesce(F.max(change), F.lit(0)).alias("source_changed_us"),
        F.coalesce(F.bit_xor(identity), F.lit(0)).alias("source_listing"),
    ).first()
