"""The seven statistics of one numeric column, over all rows or per key.

Count, sum, mean, minimum, maximum and population deviation are ordinary
partial aggregates. The exact median is found by narrowing: count rows per
order-preserving bucket, keep the bucket that holds the middle ranks, and look
into that bucket again with finer buckets. Every pass is a map-side combined
``groupBy`` over a bounded number of buckets, so no task ever holds or sorts
more than ``EXACT_LIMIT`` entries of one key, however large or skewed the data.

A double needs at most ``PASSES`` passes; a pass which has nothing left to
resolve is dropped (here by returning early, per key by adaptive execution).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.contract import STATISTIC_COLUMNS, STATISTICS_SCHEMA, TARGET_COLUMN
from tallyspark.errors import StatisticsError
from tallyspark.functions.buckets import band_bucket, few_values_left, magnitude_bucket
from tallyspark.functions.text import is_finite

# One logarithmic pass leaves a band with at most 2**49 doubles, three linear ones
# cut it by 2**11 each, and the last ranks single values.
PASSES = 5

_VALUE = "__value"
_BUCKET = "__bucket"
BAND = ("__low", "__high", "__rows", "__below", "__exact")
RANKS = ("__rank_low", "__rank_high")
MEDIAN = "mediana"


def finite_values(rows: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """Only the target (as ``__value``) and the kept columns; null, NaN and infinity dropped."""
    target = F.col(column).cast("double")
    return rows.where(is_finite(target)).select(*keep, target.alias(_VALUE))


def _per_bucket(values: DataFrame, keys: Sequence[str], bucket: Column, *more: Column) -> DataFrame:
    return values.groupBy(*keys, bucket.alias(_BUCKET)).agg(
        F.count("*").alias("__n"),
        F.min(_VALUE).alias("__min"),
        F.max(_VALUE).alias("__max"),
        *more,
    )


def _locate(
    counts: DataFrame,
    keys: Sequence[str],
    ranks: tuple[Column, Column],
    *more: Column,
    most_rows: int | None = None,
) -> DataFrame:
    """Per key: the band that holds both middle ranks, or the median if it is settled.

    ``counts`` carries ``__upto``, the number of rows up to and including a bucket.
    """
    below = F.col("__upto") - F.col("__n")
    low_here = (below < ranks[0]) & (ranks[0] <= F.col("__upto"))
    high_here = (below < ranks[1]) & (ranks[1] <= F.col("__upto"))
    found = counts.groupBy(*keys).agg(
        F.max(F.when(low_here, F.col("__min"))).alias("__low"),
        F.max(F.when(low_here, F.col("__max"))).alias("__high"),
        F.max(F.when(low_here, F.col("__n"))).alias("__rows"),
        F.max(F.when(low_here, below)).alias("__below"),
        F.max(F.when(high_here, F.col("__min"))).alias("__next"),
        F.max(ranks[0]).alias(RANKS[0]),
        F.max(ranks[1]).alias(RANKS[1]),
        *more,
    )
    low, high, following = F.col("__low"), F.col("__high"), F.col("__next")
    median = (
        # Ranks in different buckets are the end of one and the start of the other.
        F.when(low != following, (high + following) / 2).when(low == high, low)
    )
    return found.select(
        *(c for c in found.columns if c != "__next"),
        median.alias(MEDIAN),
        few_values_left(low, high, F.col("__rows"), most_rows).alias("__exact"),
    )


def first_pass(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Six statistics plus the first band, from a single scan."""
    buckets = _per_bucket(
        values,
        keys,
        magnitude_bucket(F.col(_VALUE)),
        F.sum(_VALUE).alias("__sum"),
        F.var_pop(_VALUE).alias("__var"),
    )
    return first_band(buckets, keys)


def first_band(
    buckets: DataFrame, keys: Sequence[str], most_rows: int | None = None
) -> DataFrame:
    """Six statistics plus the first band from counts and moments per logarithmic bucket.

    A band of more than ``most_rows`` rows, if given, is not ranked value by value.
    """
    everything = Window.partitionBy(*keys)
    ordered = everything.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = buckets.select(
        "*",
        F.sum("__n").over(ordered).alias("__upto"),
        F.sum("__n").over(everything).alias("__total"),
        F.sum("__sum").over(everything).alias("__grand"),
    )
    total, mean = F.col("__total"), F.col("__grand") / F.col("__total")
    middle = (F.expr("(__total + 1) div 2"), F.expr("__total div 2 + 1"))
    spread = F.col("__n") * (
        F.col("__var") + F.pow(F.col("__sum") / F.col("__n") - mean, F.lit(2.0))
    )
    return _locate(
        counts,
        keys,
        middle,
        F.max("__grand").alias("suma"),
        F.max(total).alias("conteo"),
        F.max(mean).alias("promedio"),
        F.min("__min").alias("minimo"),
        F.max("__max").alias("maximo"),
        F.sqrt(F.sum(spread) / F.max(total)).alias("desviacion_estandar"),
        most_rows=most_rows,
    )


def next_pass(
    values: DataFrame, keys: Sequence[str], band: Mapping[str, Column]
) -> DataFrame:
    """Look into the open bands again.

    ``band`` gives the band columns and ranks per row of ``values``: columns that
    were joined to it, or literals if there are no keys.
    """
    value = F.col(_VALUE)
    inside = values.where((value >= band["__low"]) & (value <= band["__high"]))
    bucket = band_bucket(value, band["__low"], band["__high"], band["__exact"])
    known = ("__below", *RANKS)
    if keys:
        buckets = _per_bucket(inside, keys, bucket, *(F.min(band[c]).alias(c) for c in known))
    else:
        buckets = _per_bucket(inside, keys, bucket).withColumns({c: band[c] for c in known})
    return next_band(buckets, keys)


def next_band(
    buckets: DataFrame, keys: Sequence[str], most_rows: int | None = None
) -> DataFrame:
    """The bucket of the middle ranks, from counts per bucket of the open bands."""
    ordered = (
        Window.partitionBy(*keys)
        .orderBy(_BUCKET)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counts = buckets.withColumn("__upto", F.col("__below") + F.sum("__n").over(ordered))
    return _locate(counts, keys, (F.col(RANKS[0]), F.col(RANKS[1])), most_rows=most_rows)


def _compute(rows: DataFrame, column: str) -> tuple:
    """Values of ``STATISTIC_COLUMNS``, finite or not.

    Up to ``PASSES`` scans of the one column. Each returns a single row, whose
    band becomes a literal range predicate of the next scan, so Parquet row
    groups outside the band are skipped.
    """
    values = finite_values(rows, column)
    found = first_pass(values, ()).first()
    if found["conteo"] is None:
        return (0.0, 0, None, None, None, None, None)
    band, median = found, found[MEDIAN]
    while median is None:
        literals = {name: F.lit(band[name]) for name in (*BAND, *RANKS)}
        band = next_pass(values, (), literals).first()
        median = band[MEDIAN]
    return tuple(median if name == MEDIAN else found[name] for name in STATISTIC_COLUMNS)


def _all_finite(statistics: tuple) -> bool:
    return all(number is None or abs(number) < float("inf") for number in statistics)


def seven_statistics(rows: DataFrame, column: str = TARGET_COLUMN) -> DataFrame:
    """One row with the seven statistics of ``column``.

    Null, NaN and infinite values do not count. No values: sum 0, count 0, the
    rest null. Raises ``StatisticsError`` if finite values give a statistic that
    is not finite.
    """
    result = _compute(rows, column)
    if not _all_finite(result):
        raise StatisticsError("finite values gave a statistic that is not a finite number")
    return rows.sparkSession.createDataFrame([result], STATISTICS_SCHEMA)


def flagged_statistics(rows: DataFrame, column: str = TARGET_COLUMN) -> DataFrame:
    """Like ``seven_statistics``, but overflow sets ``no_finita`` instead of raising."""
    result = _compute(rows, column)
    schema = T.StructType([*STATISTICS_SCHEMA.fields, T.StructField("no_finita", T.BooleanType())])
    return rows.sparkSession.createDataFrame([(*result, not _all_finite(result))], schema)


def statistics_per_key(
    keys: Sequence[str],
    matches: Callable[[DataFrame | None], DataFrame],
) -> DataFrame:
    """The seven statistics per key, as one lazy plan.

    ``matches(None)`` gives the rows of every key (key columns and ``__value``);
    ``matches(bands)`` gives only rows of the keys in ``bands`` and carries the
    band columns. Keys must not be null; keys without rows do not appear.
    """
    known = reduce(and_, (F.col(key).isNotNull() for key in keys))
    first = first_pass(matches(None).where(known), keys)
    # Naming every statistic here keeps this use of the first pass equal to the
    # final one, so its shuffle is computed once and reused.
    reached = first.where(
        reduce(and_, (F.col(c).isNotNull() for c in STATISTIC_COLUMNS if c != MEDIAN))
    )
    medians = []
    for _ in range(PASSES - 1):
        still_open = reached.where(F.col(MEDIAN).isNull()).select(*keys, *BAND, *RANKS)
        columns = {name: F.col(name) for name in (*BAND, *RANKS)}
        reached = next_pass(matches(still_open), keys, columns)
        medians.append(reached.where(F.col(MEDIAN).isNotNull()).select(*keys, MEDIAN))
    later = reduce(DataFrame.unionByName, medians).withColumnRenamed(MEDIAN, "__later")
    return first.join(later, list(keys), "left").select(
        *keys,
        *(
            F.coalesce(MEDIAN, "__later").alias(MEDIAN) if name == MEDIAN else name
            for name in STATISTIC_COLUMNS
        ),
    )
