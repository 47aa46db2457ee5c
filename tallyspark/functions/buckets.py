"""Order-preserving buckets used to find exact ranks without sorting the data.

Both bucket functions never decrease when the value grows, so the bucket that
holds a rank can be read from bucket counts alone. That is all exactness needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Few steps keep the partial counts of a pass small (tasks x steps rows move); the
# price is one more pass over data that is packed into very few doubles.
STEPS_PER_DOUBLING = 16
LINEAR_STEPS = 2_048
EXACT_LIMIT = 262_144  # most distinct values one ranking task ever sees

_SHIFT = 20_000  # keeps floor(16 * log2|v|) positive for every double


def magnitude_bucket(value: Column) -> Column:
    """Logarithmic bucket: at most 2 * 33,600 different numbers over all finite doubles."""
    size = F.floor(F.log2(F.abs(value)) * STEPS_PER_DOUBLING) + _SHIFT
    return F.when(value == 0, F.lit(0.0)).otherwise(F.signum(value) * size)


def doubling_bucket(value: Column) -> Column:
    """Coarse logarithmic bucket, one per doubling: whole ``magnitude_bucket``s."""
    fine = magnitude_bucket(value)
    return F.signum(fine) * F.floor(F.abs(fine) / STEPS_PER_DOUBLING)


def band_bucket(value: Column, low: Column, high: Column, exact: Column) -> Column:
    """Bucket inside a closed band: the value itself if ``exact``, else its step."""
    width = (high - low) / LINEAR_STEPS
    return F.when(exact, value).otherwise(F.floor((value - low) / width).cast("double"))


def few_values_left(
    low: Column, high: Column, rows: Column, most_rows: int | None = None
) -> Column:
    """True if the band cannot hold more than ``EXACT_LIMIT`` distinct doubles.

    Either it has few rows (at most ``most_rows`` if given), or few doubles exist between its ends: values next
    to ``m`` are at least ``m * 2**-53`` apart, and a first band spans less than
    one doubling of one sign.
    """
    smallest = F.least(F.abs(low), F.abs(high))
    gap = F.greatest(smallest * 2.0**-53, F.lit(5e-324))
    few = EXACT_LIMIT if most_rows is None else min(most_rows, EXACT_LIMIT)
    return (rows <= few) | ((high - low) / gap <= EXACT_LIMIT)


def path_columns(depth: int) -> list[str]:
    return [f"__step_{level}" for level in range(1, depth + 1)]


def add_path(rows: DataFrame, value: str, depth: int, most_steps: int = LINEAR_STEPS) -> DataFrame:
    """Add ``path_columns(depth)``: nested buckets that do not depend on any band.

    The first is the doubling, the second the magnitude bucket; each further one is the step
    inside the bucket before it. Values with equal paths share a bucket whoever asks, so many bands can be
    looked into with one count.
    """
    steps = min(most_steps, LINEAR_STEPS)
    size, sign = F.abs(F.col(value)), F.signum(F.col(value))
    base, width = F.col("__base"), F.col("__width")
    lowest = F.pow(F.lit(2.0), (F.abs("__step_2") - _SHIFT) / STEPS_PER_DOUBLING)
    made = rows.withColumn("__step_1", doubling_bucket(F.col(value)))
    if depth > 1:
        made = made.withColumn("__step_2", magnitude_bucket(F.col(value)))
    for level, name in enumerate(path_columns(depth)[2:]):
        if level == 0:
            made = made.withColumn("__base", F.least(lowest, F.lit(1.79e308)))
            span = base * (2.0 ** (1 / STEPS_PER_DOUBLING) - 1)
        else:
            made = made.withColumn("__base", base + F.col("__inside") * width)
            span = width
        made = made.withColumn("__width", F.greatest(span / steps, F.lit(5e-324)))
        made = made.withColumn("__inside", F.floor((size - base) / width).cast("double"))
        made = made.withColumn(name, sign * F.col("__inside"))
    return made.drop("__base", "__width", "__inside")
