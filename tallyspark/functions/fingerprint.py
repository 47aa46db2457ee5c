"""Order-independent fingerprint of row contents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NULL = "\u0001"
_SEPARATOR = "\u001f"
_HEX_DIGITS = 15  # 60 bits, always a positive BIGINT


def row_text(columns: Sequence[str]) -> Column:
    """The whole row as one text; null differs from empty and fields cannot run together."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(_NULL)) for c in columns]
    return F.concat_ws(_SEPARATOR, *parts)


def row_hash(columns: Sequence[str]) -> Column:
    """MD5 of the row's text."""
    return F.md5(row_text(columns).cast("binary"))


def _half(digest: Column, start: int) -> Column:
    number = F.conv(F.substring(digest, start, _HEX_DIGITS), 16, 10).cast("bigint")
    return number.cast("decimal(28,0)")  # sums stay exact beyond 10**18 rows


def fingerprint_counters(digest: Column) -> list[Column]:
    """Partial aggregates: row count and the sums of two 60-bit halves of each row hash.

    A sum, unlike an xor, also notices a row that occurs twice more or less.
    """
    return [
        F.count(F.lit(1)).alias("fp_rows"),
        F.sum(_half(digest, 1)).alias("fp_high"),
        F.sum(_half(digest, 1 + _HEX_DIGITS)).alias("fp_low"),
    ]


def fingerprint_text(row: object) -> str:
    """The counters of one result row as one comparable text."""
    return "-".join(str(int(row[name] or 0)) for name in ("fp_rows", "fp_high", "fp_low"))


def fingerprint(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: ``fp_rows, fp_high, fp_low``. Row order does not matter."""
    digest = row_hash(columns or rows.columns).alias("digest")
    return rows.select(digest).agg(*fingerprint_counters(F.col("digest")))
