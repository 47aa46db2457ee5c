"""Names, schemas and closed value sets the whole package agrees on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. Callers and stored datasets depend on them, so they are stated
# here as they are and nowhere else.
# ---------------------------------------------------------------------------

RAW_COLUMNS = (
    "FECHA",
    "CANAL",
    "SKU",
    "PRODUCTO",
    "UNIDADES",
    "PORCENTAJE DESCUENTO",
    "MONTO APLICADO",
    "BOLETA",
    "LOCAL",
    "CODIGO CLIENTE",
    "RUN CLIENTE",
    "NOMBRES",
    "APELLIDOS",
    "FECHA NACIMIENTO",
    "GÉNERO",
)
GENDER_HEADER = "GÉNERO"
GENDER_HEADER_ALIAS = "GENERO"
NULL_TOKENS = ("", "NULL", "null")

CHANNELS = ("POS", "WEB", "APP", "CCT", "APR", "WPR")

GENDER_UNSPECIFIED = "No especificado"
GENDER_MALE = "Masculino"
GENDER_FEMALE = "Femenino"
GENDER_OTHER = "Otro"
GENDERS = (GENDER_UNSPECIFIED, GENDER_MALE, GENDER_FEMALE, GENDER_OTHER)

FILTER_NAMES = (
    "GENERO",
    "EDAD",
    "CANAL",
    "CODIGO_PRODUCTO",
    "ID_PERSONA",
    "LOCAL",
    "FECHA_DESDE",
    "FECHA_HASTA",
)

REASONS = (
    "fecha_invalida",
    "canal_invalido",
    "sku_invalido",
    "producto_invalido",
    "unidades_invalidas",
    "descuento_invalido",
    "monto_invalido",
    "boleta_invalida",
    "local_invalido",
    "uuid_invalido",
    "fecha_nacimiento_invalida",
    "genero_invalido",
    "edad_invalida",
)

UUID_MARK = "[UUID_REDACTADO]"
RUN_MARK = "[RUN_REDACTADO]"

MAX_AGE = 120
BUSINESS_UTC_OFFSET = "-04:00"
BUSINESS_UTC_OFFSET_MINUTES = -240  # fixed UTC-4, no daylight saving
SCHEMA_VERSION = 1
TARGET_COLUMN = "monto_aplicado"
TARGET_HEADER = "MONTO APLICADO"

# ---------------------------------------------------------------------------
# Schemas. Order of the published columns is part of the contract.
# ---------------------------------------------------------------------------

RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in RAW_COLUMNS])

ANALYTIC_SCHEMA = T.StructType(
    [
        T.StructField("fecha", T.TimestampType()),
        T.StructField("canal", T.StringType()),
        T.StructField("sku", T.LongType()),
        T.StructField("monto_aplicado", T.DoubleType()),
        T.StructField("local", T.LongType()),
        T.StructField("codigo_cliente", T.StringType()),
        T.StructField("genero_texto", T.StringType()),
        T.StructField("edad_en_transaccion", T.ShortType()),
    ]
)
ANALYTIC_COLUMNS = tuple(ANALYTIC_SCHEMA.names)

STATISTICS_SCHEMA = T.StructType(
    [
        T.StructField("suma", T.DoubleType()),
        T.StructField("conteo", T.LongType()),
        T.StructField("promedio", T.DoubleType()),
        T.StructField("minimo", T.DoubleType()),
        T.StructField("maximo", T.DoubleType()),
        T.StructField("mediana", T.DoubleType()),
        T.StructField("desviacion_estandar", T.DoubleType()),
    ]
)
STATISTIC_COLUMNS = tuple(STATISTICS_SCHEMA.names)

REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("genero", T.StringType()),
        T.StructField("edad", T.ShortType()),
        T.StructField("canal", T.StringType()),
        T.StructField("codigo_producto", T.LongType()),
        T.StructField("id_persona", T.StringType()),
        T.StructField("local", T.LongType()),
        T.StructField("fecha_desde", T.TimestampType()),
        T.StructField("fecha_hasta", T.TimestampType()),
        T.StructField("fecha_hasta_exclusiva", T.BooleanType()),
    ]
)
