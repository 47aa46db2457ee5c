"""Row-quality rules: name them, count them, split by them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyspark.contract import CHANNELS, MAX_AGE
from tallyspark.functions.methods import new_method
from tallyspark.functions.text import UUID, is_finite

INVALID = "__invalid"


def _missing_or(test: Column, *columns: str) -> Column:
    return reduce(or_, (F.col(c).isNull() for c in columns)) | test


def _not_positive(column: str) -> Column:
    return _missing_or(F.col(column) <= 0, column)


def rules() -> dict[str, Column]:
    """Reason -> "this row is bad for that reason". Never null; reasons may overlap."""
    discount = F.col("porcentaje_descuento")
    age = F.col("edad_en_transaccion")
    return {
        "fecha_invalida": F.col("fecha").isNull(),
        "canal_invalido": _missing_or(~F.col("canal").isin(*CHANNELS), "canal"),
        "sku_invalido": _not_positive("sku"),
        "producto_invalido": _missing_or(F.col("producto") == "", "producto"),
        "unidades_invalidas": _not_positive("unidades"),
        # Between two finite ends: NaN and infinity fail the test as well.
        "descuento_invalido": _missing_or(
            ~discount.between(0.0, 1.0), "porcentaje_descuento"
        ),
        "monto_invalido": _missing_or(~is_finite(F.col("monto_aplicado")), "monto_aplicado"),
        "boleta_invalida": _not_positive("boleta"),
        "local_invalido": _not_positive("local"),
        "uuid_invalido": _missing_or(~F.col("codigo_cliente").rlike(UUID), "codigo_cliente"),
        "fecha_nacimiento_invalida": F.col("fecha_nacimiento").isNull(),
        "genero_invalido": F.col("genero_informado") & F.col("genero_codigo").isNull(),
        "edad_invalida": _missing_or(~age.between(0, MAX_AGE), "edad_en_transaccion"),
    }


def mark(sales: DataFrame) -> DataFrame:
    """One boolean column per reason and ``__invalid`` for "any reason".

    The rules are compiled apart from the normalisation below them.
    """
    named = rules()
    marked = new_method(sales).select("*", *(test.alias(name) for name, test in named.items()))
    return marked.withColumn(INVALID, reduce(or_, (F.col(name) for name in named)))


def counters() -> list[Column]:
    """Aggregates over marked rows; ``count_if`` gives 0, not null, without rows."""
    return [
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(~F.col(INVALID)).alias("valid_rows"),
        F.count_if(F.col(INVALID)).alias("discarded_rows"),
        *(F.count_if(F.col(name)).alias(name) for name in rules()),
    ]


def quality_report(sales: DataFrame) -> DataFrame:
    """One row: total, valid, discarded and the count of each reason."""
    return mark(sales).agg(*counters())


def observed(sales: DataFrame, observation: Observation | None = None, *more: Column) -> DataFrame:
    """Marked rows that count themselves on the way, so a split needs no second pass.

    The counting node also keeps Spark from moving a later filter below the
    normalisation, which would evaluate all of that twice for every row.
    """
    return mark(sales).observe(observation or Observation(), *counters(), *more)


def valid_rows(sales: DataFrame, observation: Observation | None = None) -> DataFrame:
    return observed(sales, observation).where(~F.col(INVALID)).select(*sales.columns)


def discarded_rows(sales: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Bad rows with the boolean column of every reason."""
    return observed(sales, observation).where(F.col(INVALID)).drop(INVALID)
