"""Test harness: a deterministic dirty sales extract made from ``lineitem``.

One raw row per line item, all text. The keys decide where each kind of dirt
goes, so that every rule and every parse branch is hit. ``RAW_SQL`` is the same
derivation for the reference database.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.contract import RAW_COLUMNS


def _choose(default: Column, *cases: tuple[Column, Column | str | None]) -> Column:
    chain = F
    for test, value in cases:
        chain = chain.when(test, F.lit(value) if not isinstance(value, Column) else value)
    return chain.otherwise(default)


def _two_digits(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def dirty_sales(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys`` names columns of ``lineitem`` to keep beside the raw ones."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    r, d, hms, person, price = map(F.col, ("__r", "__d", "__hms", "__person", "__price"))
    digest = F.md5(F.col("l_orderkey").cast("string").cast("binary"))
    born = F.date_add(F.lit("1930-01-01").cast("date"), ((r * 37) % 24000).cast("int"))

    def every(n: int) -> Column:
        return r % n == 0

    def turn(n: int, k: int) -> Column:
        return r % n == k

    # Shared parts first: nested in every case, they would be compiled many times.
    parts = (
        items.withColumn("__r", F.col("l_orderkey") * 7 + F.col("l_linenumber"))
        .withColumn("__digest", digest)
        .withColumns(
            {
                "__d": F.to_date("l_shipdate").cast("string"),
                "__hms": F.concat_ws(
                    ":", _two_digits(r % 24), _two_digits(r % 60), _two_digits((r * 7) % 60)
                ),
                "__person": F.concat_ws(
                    "-",
                    *(
                        F.substring("__digest", start, size)
                        for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
                    ),
                ),
                "__price": F.col("l_extendedprice").cast("decimal(18,2)").cast("string"),
            }
        )
    )
    columns = {
        "FECHA": _choose(
            F.concat(d, F.lit("T"), hms),
            (every(101), "fecha-invalida"),
            (turn(11, 0), d),
            (turn(11, 1), F.concat(d, F.lit("T"), hms, F.lit("Z"))),
            (turn(11, 2), F.concat(d, F.lit(" "), hms, F.lit("+03:00"))),
            (turn(11, 3), F.concat(d, F.lit("T"), hms, F.lit("+03"))),
            (turn(11, 4), F.concat(d, F.lit("T"), hms, F.lit("-0400"))),
            (turn(11, 5), F.concat(F.lit("  "), d, F.lit("T"), F.left(hms, F.lit(5)))),
            (turn(11, 6), F.concat(d, F.lit("T"), hms, F.lit(".250z"))),
        ),
        "CANAL": _choose(
            F.lit("WPR"),
            (every(103), None),
            (every(29), "FAX"),
            (turn(6, 0), " pos "),
            (turn(6, 1), "WEB"),
            (turn(6, 2), "app"),
            (turn(6, 3), "CCT"),
            (turn(6, 4), "apr"),
        ),
        "SKU": _choose(
            F.col("l_partkey").cast("string"), (every(53), "NO-ENTERO"), (every(59), "1.0")
        ),
        "PRODUCTO": _choose(
            F.concat(F.lit("PRODUCTO "), F.col("l_partkey").cast("string")), (every(61), "   ")
        ),
        "UNIDADES": _choose(F.col("l_quantity").cast("bigint").cast("string"), (every(67), "0")),
        "PORCENTAJE DESCUENTO": _choose(
            F.col("l_discount").cast("decimal(9,2)").cast("string"), (every(71), "1.5"), (every(73), "1d")
        ),
        "MONTO APLICADO": _choose(
            price,
            (every(79), "NaN"),
            (every(83), "monto-invalido"),
            (every(7), F.concat(F.lit("-"), price)),
        ),
        "BOLETA": _choose((F.col("l_orderkey") + 1).cast("string"), (every(89), "-1")),
        "LOCAL": _choose((F.col("l_suppkey") + 100).cast("string"), (every(97), "uno")),
        "CODIGO CLIENTE": _choose(
            person, (every(107), "uuid-invalido"), (every(2), F.upper(person))
        ),
        "RUN CLIENTE": F.lit("12.345.678-K"),
        "NOMBRES": F.lit("N"),
        "APELLIDOS": F.lit("A"),
        "FECHA NACIMIENTO": _choose(
            born.cast("string"),
            (every(109), "1990-1-5"),
            (every(113), "1990-02-30"),
            (every(127), "2030-01-01"),
            (every(131), "1860-02-29"),
            (every(17), "1992-02-29"),
        ),
        "GÉNERO": _choose(
            F.lit(""),
            (every(137), "x"),
            (every(149), "-1"),
            (turn(5, 0), "0"),
            (turn(5, 1), "1"),
            (turn(5, 2), " 2 "),
            (turn(5, 3), "7"),
        ),
    }
    return parts.select(*keys, *(columns[name].alias(name) for name in RAW_COLUMNS))


RAW_SQL = """
item AS (
  SELECT *, l_orderkey * 7 + l_linenumber AS r,
         strftime(l_shipdate, '%Y-%m-%d') AS d,
         md5(CAST(l_orderkey AS VARCHAR)) AS h,
         printf('%.2f', l_extendedprice) AS price
  FROM lineitem
), clock AS (
  SELECT *,
         lpad(CAST(r % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(r % 60 AS VARCHAR), 2, '0')
           || ':' || lpad(CAST((r * 7) % 60 AS VARCHAR), 2, '0') AS hms,
         substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-'
           || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS u
  FROM item
), raw AS (
  SELECT l_orderkey, l_linenumber,
    CASE WHEN r % 101 = 0 THEN 'fecha-invalida' WHEN r % 11 = 0 THEN d
         WHEN r % 11 = 1 THEN d || 'T' || hms || 'Z'
         WHEN r % 11 = 2 THEN d || ' ' || hms || '+03:00'
         WHEN r % 11 = 3 THEN d || 'T' || hms || '+03'
         WHEN r % 11 = 4 THEN d || 'T' || hms || '-0400'
         WHEN r % 11 = 5 THEN '  ' || d || 'T' || substr(hms, 1, 5)
         WHEN r % 11 = 6 THEN d || 'T' || hms || '.250z'
         ELSE d || 'T' || hms END AS r_fecha,
    CASE WHEN r % 103 = 0 THEN NULL WHEN r % 29 = 0 THEN 'FAX' WHEN r % 6 = 0 THEN ' pos '
         WHEN r % 6 = 1 THEN 'WEB' WHEN r % 6 = 2 THEN 'app' WHEN r % 6 = 3 THEN 'CCT'
         WHEN r % 6 = 4 THEN 'apr' ELSE 'WPR' END AS r_canal,
    CASE WHEN r % 53 = 0 THEN 'NO-ENTERO' WHEN r % 59 = 0 THEN '1.0'
         ELSE CAST(l_partkey AS VARCHAR) END AS r_sku,
    CASE WHEN r % 61 = 0 THEN '   ' ELSE 'PRODUCTO ' || CAST(l_partkey AS VARCHAR) END AS r_producto,
    CASE WHEN r % 67 = 0 THEN '0' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS r_unidades,
    CASE WHEN r % 71 = 0 THEN '1.5' WHEN r % 73 = 0 THEN '1d'
         ELSE printf('%.2f', l_discount) END AS r_descuento,
    CASE WHEN r % 79 = 0 THEN 'NaN' WHEN r % 83 = 0 THEN 'monto-invalido'
         WHEN r % 7 = 0 THEN '-' || price ELSE price END AS r_monto,
    CASE WHEN r % 89 = 0 THEN '-1' ELSE CAST(l_orderkey + 1 AS VARCHAR) END AS r_boleta,
    CASE WHEN r % 97 = 0 THEN 'uno' ELSE CAST(l_suppkey + 100 AS VARCHAR) END AS r_local,
    CASE WHEN r % 107 = 0 THEN 'uuid-invalido' WHEN r % 2 = 0 THEN upper(u) ELSE u END AS r_cliente,
    CASE WHEN r % 109 = 0 THEN '1990-1-5' WHEN r % 113 = 0 THEN '1990-02-30'
         WHEN r % 127 = 0 THEN '2030-01-01' WHEN r % 131 = 0 THEN '1860-02-29'
         WHEN r % 17 = 0 THEN '1992-02-29'
         ELSE strftime(DATE '1930-01-01' + CAST((r * 37) % 24000 AS INTEGER), '%Y-%m-%d')
         END AS r_nacimiento,
    CASE WHEN r % 137 = 0 THEN 'x' WHEN r % 149 = 0 THEN '-1' WHEN r % 5 = 0 THEN '0'
         WHEN r % 5 = 1 THEN '1' WHEN r % 5 = 2 THEN ' 2 ' WHEN r % 5 = 3 THEN '7'
         ELSE '' END AS r_genero
  FROM clock
)"""
