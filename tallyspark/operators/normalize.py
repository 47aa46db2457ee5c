"""Raw text rows to typed sales rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.contract import (
    ANALYTIC_COLUMNS,
    GENDER_FEMALE,
    GENDER_HEADER,
    GENDER_MALE,
    GENDER_OTHER,
    GENDER_UNSPECIFIED,
)
from tallyspark.functions.moments import add_sale_moment, age_on, business_date
from tallyspark.functions.text import strip, to_date, to_double, to_long

_CLEANED = {  # output name -> raw header; personal columns are never selected
    "fecha": "FECHA",
    "canal": "CANAL",
    "sku": "SKU",
    "producto": "PRODUCTO",
    "unidades": "UNIDADES",
    "porcentaje_descuento": "PORCENTAJE DESCUENTO",
    "monto_aplicado": "MONTO APLICADO",
    "boleta": "BOLETA",
    "local": "LOCAL",
    "codigo_cliente": "CODIGO CLIENTE",
    "fecha_nacimiento": "FECHA NACIMIENTO",
    "genero_codigo": GENDER_HEADER,
}
_INTEGERS = ("sku", "unidades", "boleta", "local", "genero_codigo")
_DOUBLES = ("porcentaje_descuento", "monto_aplicado")


def normalize(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Typed columns, age at the sale and gender text. Unreadable values become null.

    ``raw`` has the text columns of the contract; ``keep`` names more of its
    columns to carry along. Every projection uses only columns of the one before
    it, so no expression is evaluated twice.
    """
    stripped = raw.select(
        *keep, *(strip(F.col(f"`{header}`")).alias(name) for name, header in _CLEANED.items())
    )
    typed = add_sale_moment(stripped, "fecha", "__instant").select(
        *keep,
        F.col("__instant").alias("fecha"),
        F.upper("canal").alias("canal"),
        "producto",
        *(to_long(F.col(name)).alias(name) for name in _INTEGERS),
        *(to_double(F.col(name)).alias(name) for name in _DOUBLES),
        F.lower("codigo_cliente").alias("codigo_cliente"),
        to_date(F.col("fecha_nacimiento")).alias("fecha_nacimiento"),
        (F.col("genero_codigo").isNotNull() & (F.col("genero_codigo") != "")).alias(
            "genero_informado"
        ),
    )
    code = F.col("genero_codigo")
    return typed.withColumns(
        {
            "edad_en_transaccion": age_on(business_date(F.col("fecha")), F.col("fecha_nacimiento")),
            "genero_texto": F.when(code == 1, GENDER_MALE)
            .when(code == 2, GENDER_FEMALE)
            .when(code.isNull() | (code == 0), GENDER_UNSPECIFIED)
            .otherwise(GENDER_OTHER),
        }
    )


def analytic_projection(sales: DataFrame) -> DataFrame:
    """The eight published columns, in contract order."""
    return sales.select(*ANALYTIC_COLUMNS)
