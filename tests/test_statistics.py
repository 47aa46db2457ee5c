from __future__ import annotations

import math
import random
from statistics import fmean, median, pstdev

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.contract import STATISTIC_COLUMNS, STATISTICS_SCHEMA
from tallyspark.errors import StatisticsError
from tallyspark.functions import buckets
from tallyspark.functions.buckets import band_bucket, few_values_left, magnitude_bucket
from tallyspark.operators.statistics import (
    PASSES,
    finite_values,
    flagged_statistics,
    seven_statistics,
    statistics_per_key,
)

_SCHEMA = T.StructType([T.StructField("monto_aplicado", T.DoubleType())])


def _frame(spark, values):
    return spark.createDataFrame([(value,) for value in values], _SCHEMA)


def _expected(values):
    return {
        "suma": pytest.approx(math.fsum(values)),
        "conteo": len(values),
        "promedio": pytest.approx(fmean(values)),
        "minimo": min(values),
        "maximo": max(values),
        "mediana": median(values),
        "desviacion_estandar": pytest.approx(pstdev(values), abs=1e-9),
    }


@pytest.mark.parametrize(
    "values",
    [
        [3.5, 17.25, 900.0],
        [6.0, 6.5, 11.0, 64.0],
        [1.0, 1.0, 2.0, 3.0, 5.0, 8.0, 13.0, 21.0, 34.0],
        [98765.4321],
        [0.3, 0.7, 1e-5, 12.6],
        [-5.0, -1.0, 0.0, 3.0],
        [0.0, -0.0, 0.0],
        [1e-300, 2e-300, 1e100],
    ],
)
def test_statistics_match_the_standard_library(spark, values):
    result = seven_statistics(_frame(spark, values))
    assert result.schema == STATISTICS_SCHEMA
    assert result.first().asDict() == _expected(values)


@pytest.mark.parametrize("values", [[], [math.nan, math.inf, -math.inf, None]])
def test_without_finite_values_only_sum_and_count_exist(spark, values):
    row = seven_statistics(_frame(spark, values)).first()
    assert tuple(row) == (0.0, 0, None, None, None, None, None)


def test_null_nan_and_infinity_do_not_count(spark):
    row = seven_statistics(_frame(spark, [1.5, None, math.nan, math.inf, -math.inf, 2.5])).first()
    assert row.asDict() == _expected([1.5, 2.5])


def test_overflow_raises_or_is_flagged(spark):
    huge = _frame(spark, [1e308, 1e308])
    with pytest.raises(StatisticsError):
        seven_statistics(huge)
    assert flagged_statistics(huge).first()["no_finita"] is True
    assert flagged_statistics(_frame(spark, [1.0])).first()["no_finita"] is False


def _hard_values(kind: str) -> list[float]:
    chance = random.Random(kind)
    if kind == "one value holds most rows":
        return [7.25] * 700 + [chance.uniform(-1e6, 1e6) for _ in range(300)]
    if kind == "outliers far away":
        return [chance.uniform(99.0, 101.0) for _ in range(999)] + [1e300, -1e300]
    if kind == "neighbouring doubles":
        start, values = 1000.1, []
        for _ in range(500):
            values += [start] * chance.randint(1, 4)
            start = math.nextafter(start, math.inf)
        return values
    if kind == "all magnitudes":
        return [chance.choice((-1, 1)) * 10.0 ** chance.uniform(-320, 300) for _ in range(1001)]
    return [math.ulp(0.0) * chance.randint(0, 2000) for _ in range(1000)]


_KINDS = (
    "one value holds most rows",
    "outliers far away",
    "neighbouring doubles",
    "all magnitudes",
    "smallest doubles",
)


@pytest.mark.parametrize("kind", _KINDS)
def test_median_is_exact_with_every_pass_in_use(spark, kind, monkeypatch):
    """With tiny limits small data goes through all narrowing passes."""
    monkeypatch.setattr(buckets, "EXACT_LIMIT", 4)
    monkeypatch.setattr(buckets, "LINEAR_STEPS", 16)
    values = _hard_values(kind)
    random.Random(1).shuffle(values)
    assert flagged_statistics(_frame(spark, values)).first()["mediana"] == median(values)


@pytest.mark.parametrize("kind", _KINDS)
def test_real_limits_settle_in_the_promised_passes(spark, kind):
    values = spark.range(1).select(
        F.explode(F.array(*(F.lit(v) for v in _hard_values(kind)[:50]))).alias("monto_aplicado")
    )
    rows = spark.range(1).select(F.lit("k").alias("k")).crossJoin(values)
    kept = finite_values(rows, "monto_aplicado", ["k"])

    def matches(bands):
        return kept if bands is None else kept.join(bands, "k")

    assert PASSES == 5
    found = statistics_per_key(["k"], matches).first()
    assert found["mediana"] == median(_hard_values(kind)[:50])


def test_buckets_never_decrease_and_bands_shrink(spark):
    chance = random.Random(3)
    values = sorted(
        {0.0, 5e-324, -5e-324, 1.7e308, -1.7e308}
        | {chance.choice((-1, 1)) * 2.0 ** chance.uniform(-1074, 1023) for _ in range(3000)}
        | {float(n) for n in range(-50, 50)}
    )
    rows = _frame(spark, values).select(
        F.col("monto_aplicado").alias("v"), magnitude_bucket(F.col("monto_aplicado")).alias("b")
    )
    found = sorted(rows.collect())
    numbers = [row["b"] for row in found]
    assert numbers == sorted(numbers)
    assert max(map(abs, numbers)) < 40_000
    low, high = 1000.0, 1040.0
    inside = sorted({chance.uniform(low, high) for _ in range(3000)} | {low, high})
    band = band_bucket(F.col("v"), F.lit(low), F.lit(high), F.lit(False))
    steps = [r["b"] for r in sorted(_frame(spark, inside).select(F.col("monto_aplicado").alias("v"))
                                    .withColumn("b", band).collect())]
    assert steps == sorted(steps) and 0 <= steps[0] and steps[-1] <= buckets.LINEAR_STEPS
    few = spark.range(1).select(
        few_values_left(F.lit(1000.0), F.lit(1040.0), F.lit(10**9)).alias("wide"),
        few_values_left(F.lit(1000.0), F.lit(1000.0 + 1e-10), F.lit(10**9)).alias("narrow"),
        few_values_left(F.lit(0.0), F.lit(1e300), F.lit(5)).alias("few_rows"),
    ).first()
    assert tuple(few) == (False, True, True)


def test_per_key_equals_one_by_one(spark):
    chance = random.Random(5)
    rows = [(chance.choice("aaab"), chance.uniform(-10, 1e5)) for _ in range(400)]
    rows += [("c", 1.0), ("d", math.nan), (None, 3.0)]
    frame = spark.createDataFrame(rows, "k string, monto_aplicado double")
    kept = finite_values(frame, "monto_aplicado", ["k"])

    def matches(bands):
        return kept if bands is None else kept.join(F.broadcast(bands), "k")

    plan = statistics_per_key(["k"], matches)
    found = {row["k"]: row for row in plan.collect()}
    assert set(found) == {"a", "b", "c"}
    for key, row in found.items():
        values = [v for k, v in rows if k == key]
        assert {c: row[c] for c in STATISTIC_COLUMNS} == _expected(values)
    # Settled passes are dropped at run time, so the source is read at most three times.
    final = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Scan ExistingRDD") <= 3


def test_global_plan_reads_one_column_and_ranks_few_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id AS a", "id * 1.5D AS v", "'x' AS c").write.parquet(path)
    from tallyspark.operators.statistics import first_pass

    plan = first_pass(finite_values(spark.read.parquet(path), "v"), ())
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<v:double>" in text
    assert "partial_count" in text  # counted per bucket before anything moves
    assert text.index("Window") < text.index("partial_count")
