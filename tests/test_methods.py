"""The generated code of the ingest path stays below the size that the JVM compiles."""

from __future__ import annotations

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tallyspark.functions.methods import COMPILED_BYTES, method_bytes, new_method
from tallyspark.operators import quality
from tallyspark.operators.normalize import analytic_projection, normalize
from tallyspark.plans.ingest import counted_rows
from tallyspark.sources.sales_csv import read_sales_csv
from tests.sales_fixture import valid_rows, write_csv


@pytest.fixture()
def raw(spark, tmp_path):
    return read_sales_csv(spark, write_csv(tmp_path / "sales.csv", valid_rows()))


def _published(raw):
    marked = counted_rows(raw, Observation())
    return analytic_projection(marked.where(~F.col(quality.INVALID)))


@pytest.mark.parametrize(
    "plan",
    [
        normalize,
        lambda raw: quality.valid_rows(normalize(raw)),
        lambda raw: quality.discarded_rows(normalize(raw)),
        lambda raw: analytic_projection(quality.valid_rows(normalize(raw))),
        _published,
    ],
    ids=["normalize", "valid", "discarded", "analytic", "publish"],
)
def test_every_method_of_the_ingest_is_compiled(raw, plan):
    sizes = method_bytes(plan(raw))
    assert sizes and max(sizes) < COMPILED_BYTES


def test_a_new_method_keeps_rows_and_drops_unread_columns_below(spark, tmp_path):
    path = str(tmp_path / "numbers")
    spark.range(10).withColumns({"a": F.col("id") * 2, "b": F.col("id") * 3}).write.parquet(path)
    rows = new_method(spark.read.parquet(path).withColumn("c", F.col("a") + F.col("b")))
    assert rows.count() == 10 and rows.agg(F.sum("c")).first()[0] == 225
    plan = rows.select("a")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a:bigint>" in plan
