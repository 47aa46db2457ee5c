"""Test harness: filter requests made from the given tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.contract import CHANNELS, GENDERS, REQUEST_SCHEMA


def _typed(rows: DataFrame, **given) -> DataFrame:
    columns = [F.col("request_id")]
    for field in REQUEST_SCHEMA.fields:
        value = given.get(field.name, F.lit(None))
        columns.append(value.cast(field.dataType).alias(field.name))
    return rows.select(*columns)


def _instant(date_text, days) -> F.Column:
    """Midnight UTC-4 of a day, as an instant."""
    day = F.date_add(F.lit(date_text).cast("date"), days.cast("int"))
    return F.timestamp_seconds(F.unix_date(day).cast("bigint") * 86400 + 4 * 3600)


def typed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per supplier, nation, region and customer, in four shapes and none."""

    def table(name: str, key: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return rows.withColumn("request_id", F.concat(F.lit(f"{name}-"), F.col(key).cast("string")))

    def pick(values, index) -> F.Column:
        return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))

    shop = F.col("s_suppkey")
    nation = F.col("n_nationkey")
    region = F.col("r_regionkey")
    customer = F.col("c_custkey")
    digest = F.md5(customer.cast("string").cast("binary"))
    person = F.concat_ws(
        "-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    )
    parts = [
        _typed(
            table("supplier", "s_suppkey"),
            local=shop + 100,
            canal=F.when(shop % 3 == 0, pick(CHANNELS, shop)),
        ),
        _typed(
            table("nation", "n_nationkey"),
            genero=pick(GENDERS, nation),
            fecha_desde=_instant("1995-01-01", nation * 60),
            fecha_hasta=_instant("1995-01-01", nation * 60 + 400),
            fecha_hasta_exclusiva=nation % 2 == 0,
        ),
        _typed(
            table("region", "r_regionkey"),
            canal=F.when(region < 3, pick(CHANNELS, region)),
            edad=F.when(region == 3, F.lit(40)),
        ),
        _typed(table("customer", "c_custkey"), id_persona=person),
    ]
    first, *others = parts
    for other in others:
        first = first.unionByName(other)
    return first


def time_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A time range per customer and nothing else: overlapping, open at either end, repeated."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey")
    start, days = key % 1900, key % 23 * 30 + 1
    return _typed(
        rows.withColumn("request_id", key),
        fecha_desde=F.when(key % 7 != 0, _instant("1992-06-01", start)),
        fecha_hasta=F.when(key % 5 != 0, _instant("1992-06-01", start + days)),
        fecha_hasta_exclusiva=key % 2 == 0,
    )


TIME_REQUESTS_SQL = """
requests AS (
  SELECT c_custkey AS request_id,
    CASE WHEN c_custkey % 7 <> 0 THEN CAST(DATE '1992-06-01'
      + CAST(c_custkey % 1900 AS INTEGER) AS TIMESTAMP) + INTERVAL 4 HOUR END AS desde,
    CASE WHEN c_custkey % 5 <> 0 THEN CAST(DATE '1992-06-01'
      + CAST(c_custkey % 1900 + c_custkey % 23 * 30 + 1 AS INTEGER) AS TIMESTAMP)
      + INTERVAL 4 HOUR END AS hasta,
    c_custkey % 2 = 0 AS exclusiva
  FROM customer
)"""


_CHANNEL_LIST = ", ".join(f"'{c}'" for c in CHANNELS)
_GENDER_LIST = ", ".join(f"'{g}'" for g in GENDERS)
TYPED_REQUESTS_SQL = f"""
requests AS (
  SELECT 'supplier-' || CAST(s_suppkey AS VARCHAR) AS request_id, NULL AS genero, NULL AS edad,
         CASE WHEN s_suppkey % 3 = 0 THEN [{_CHANNEL_LIST}][CAST(s_suppkey % 6 AS INTEGER) + 1]
              END AS canal,
         NULL AS id_persona, s_suppkey + 100 AS local,
         NULL AS desde, NULL AS hasta, FALSE AS exclusiva
  FROM supplier
  UNION ALL
  SELECT 'nation-' || CAST(n_nationkey AS VARCHAR),
         [{_GENDER_LIST}][CAST(n_nationkey % 4 AS INTEGER) + 1], NULL, NULL, NULL, NULL,
         CAST(DATE '1995-01-01' + CAST(n_nationkey * 60 AS INTEGER) AS TIMESTAMP) + INTERVAL 4 HOUR,
         CAST(DATE '1995-01-01' + CAST(n_nationkey * 60 + 400 AS INTEGER) AS TIMESTAMP)
           + INTERVAL 4 HOUR,
         n_nationkey % 2 = 0
  FROM nation
  UNION ALL
  SELECT 'region-' || CAST(r_regionkey AS VARCHAR), NULL, CASE WHEN r_regionkey = 3 THEN 40 END,
         CASE WHEN r_regionkey < 3 THEN [{_CHANNEL_LIST}][CAST(r_regionkey % 6 AS INTEGER) + 1] END,
         NULL, NULL, NULL, NULL, FALSE
  FROM region
  UNION ALL
  SELECT 'customer-' || CAST(c_custkey AS VARCHAR), NULL, NULL, NULL,
         substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-'
           || substr(h, 17, 4) || '-' || substr(h, 21, 12),
         NULL, NULL, NULL, FALSE
  FROM (SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR)) AS h FROM customer)
)"""


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three untyped filter pairs per request from ``events``, good and bad ones."""
    n, k = F.col("event_id"), F.expr("event_id div 3")
    turn = (k * 7 + (n % 3) * 5) % 9
    digest = F.md5(F.col("user_id").cast("string").cast("binary"))
    hyphened = F.concat_ws(
        "-", *(F.substring(digest, a, m) for a, m in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    )
    day = F.to_date("ts").cast("string")
    clock = F.date_format("ts", "HH:mm:ss")
    moment = (
        F.when(n % 7 == 0, day)
        .when(n % 7 == 1, F.concat(day, F.lit("T"), clock))
        .when(n % 7 == 2, F.concat(day, F.lit(" "), clock, F.lit("z")))
        .when(n % 7 == 3, F.concat(day, F.lit("T"), clock, F.lit("+03:00")))
        .when(n % 7 == 4, F.concat(F.lit(" "), F.replace(day, F.lit("-"), F.lit(""))))
        .when(n % 7 == 5, F.concat(day, F.lit("T"), clock, F.lit(".25-0430")))
        .otherwise(F.lit("31.12.1999"))
    )

    def pick(*values) -> F.Column:
        return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))

    whole = F.concat(F.when(n % 5 == 0, F.lit(" +00")).otherwise(F.lit("")), (k % 125).cast("string"))
    value = (
        F.when(n % 97 == 0, F.lit(None).cast("string"))
        .when(turn == 0, pick(" femenino ", "MASCULINO", "Otro", "no especificado", "neutro"))
        .when(turn == 1, F.when(n % 13 == 0, F.lit("30.0")).otherwise(whole))
        .when(turn == 2, pick("pos", " WEB ", "App", "cct", "APR", "wpr", "KIOSCO"))
        .when(turn == 3, F.when(n % 13 == 0, F.lit("99999999999999999999")).otherwise(whole))
        .when(
            turn == 4,
            F.when(n % 4 == 0, F.upper(hyphened))
            .when(n % 4 == 1, F.concat(F.lit("{"), hyphened, F.lit("}")))
            .when(n % 4 == 2, digest)
            .otherwise(F.substring(hyphened, 1, 18)),
        )
        .when(turn == 5, F.when(n % 13 == 0, F.lit("9223372036854775808")).otherwise(whole))
        .otherwise(moment)
    )
    names = ("GENERO", "EDAD", "CANAL", "CODIGO_PRODUCTO", "ID_PERSONA", "LOCAL")
    name = F.when(n % 11 == 0, F.lit("CANAL"))
    for index, filter_name in enumerate((*names, "FECHA_DESDE", "FECHA_HASTA")):
        name = name.when(turn == index, F.lit(filter_name))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        k.alias("request_id"), name.otherwise(F.lit("DESCONOCIDO")).alias("consulta"),
        value.alias("valor"),
    )


VALIDATION_SQL = r"""
WITH e AS (
  SELECT event_id AS n, event_id // 3 AS k, user_id, ts,
         ((event_id // 3) * 7 + (event_id % 3) * 5) % 9 AS turn,
         md5(CAST(user_id AS VARCHAR)) AS h,
         strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%H:%M:%S') AS hms
  FROM events
), shaped AS (
  SELECT *,
    substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-'
      || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS u,
    CASE n % 7 WHEN 0 THEN d WHEN 1 THEN d || 'T' || hms WHEN 2 THEN d || ' ' || hms || 'z'
      WHEN 3 THEN d || 'T' || hms || '+03:00' WHEN 4 THEN ' ' || replace(d, '-', '')
      WHEN 5 THEN d || 'T' || hms || '.25-0430' ELSE '31.12.1999' END AS moment,
    CASE n % 7 WHEN 0 THEN CAST(d AS TIMESTAMP) + INTERVAL 4 HOUR
      WHEN 1 THEN CAST(d || ' ' || hms AS TIMESTAMP) + INTERVAL 4 HOUR
      WHEN 2 THEN CAST(d || ' ' || hms AS TIMESTAMP)
      WHEN 3 THEN CAST(d || ' ' || hms AS TIMESTAMP) - INTERVAL 3 HOUR
      WHEN 4 THEN CAST(d AS TIMESTAMP) + INTERVAL 4 HOUR
      WHEN 5 THEN CAST(d || ' ' || hms || '.25' AS TIMESTAMP) + INTERVAL 270 MINUTE
      END AS instant,
    CASE WHEN n % 5 = 0 THEN ' +00' ELSE '' END || CAST(k % 125 AS VARCHAR) AS whole
  FROM e
), pairs AS (
  SELECT *,
    CASE WHEN n % 11 = 0 THEN 'CANAL' ELSE
      coalesce(['GENERO', 'EDAD', 'CANAL', 'CODIGO_PRODUCTO', 'ID_PERSONA', 'LOCAL',
                'FECHA_DESDE', 'FECHA_HASTA'][CAST(turn AS INTEGER) + 1], 'DESCONOCIDO')
      END AS consulta,
    CASE WHEN n % 97 = 0 THEN NULL
      WHEN turn = 0 THEN [' femenino ', 'MASCULINO', 'Otro', 'no especificado', 'neutro']
        [CAST(k % 5 AS INTEGER) + 1]
      WHEN turn = 1 THEN CASE WHEN n % 13 = 0 THEN '30.0' ELSE whole END
      WHEN turn = 2 THEN ['pos', ' WEB ', 'App', 'cct', 'APR', 'wpr', 'KIOSCO']
        [CAST(k % 7 AS INTEGER) + 1]
      WHEN turn = 3 THEN CASE WHEN n % 13 = 0 THEN '99999999999999999999' ELSE whole END
      WHEN turn = 4 THEN CASE n % 4 WHEN 0 THEN upper(u) WHEN 1 THEN '{' || u || '}'
        WHEN 2 THEN h ELSE substr(u, 1, 18) END
      WHEN turn = 5 THEN CASE WHEN n % 13 = 0 THEN '9223372036854775808' ELSE whole END
      ELSE moment END AS valor
  FROM shaped
), parsed AS (
  SELECT *, trim(valor) AS t,
    consulta IN ('EDAD', 'CODIGO_PRODUCTO', 'LOCAL') AS is_number,
    consulta IN ('FECHA_DESDE', 'FECHA_HASTA') AS is_date
  FROM pairs
), valued AS (
  SELECT *,
    CASE WHEN regexp_full_match(t, '[+-]?[0-9]+')
          AND length(ltrim(replace(t, '+', ''), '0')) <= 19
         THEN TRY_CAST(t AS HUGEINT) END AS whole_value,
    CASE lower(t) WHEN 'femenino' THEN 'Femenino' WHEN 'masculino' THEN 'Masculino'
      WHEN 'otro' THEN 'Otro' WHEN 'no especificado' THEN 'No especificado' END AS gender,
    CASE WHEN upper(t) IN ('POS', 'WEB', 'APP', 'CCT', 'APR', 'WPR') THEN upper(t) END AS channel,
    CASE WHEN length(replace(trim(t, '{}'), '-', '')) = 32 THEN u END AS person,
    CASE WHEN is_date AND valor IS NOT NULL THEN instant
      + CASE WHEN consulta = 'FECHA_HASTA' AND n % 7 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END
      END AS moment_at
  FROM parsed
), judged AS (
  SELECT *,
    CASE WHEN consulta = 'DESCONOCIDO' THEN 'unknown_filter'
      WHEN valor IS NULL THEN 'missing_value'
      WHEN is_number AND whole_value IS NULL THEN 'not_integer'
      WHEN consulta = 'EDAD' AND whole_value > 120 THEN 'out_of_range'
      WHEN consulta IN ('LOCAL', 'CODIGO_PRODUCTO')
        AND (whole_value < 1 OR whole_value > 9223372036854775807) THEN 'out_of_range'
      WHEN is_date AND moment_at IS NULL THEN 'not_iso_date'
      WHEN consulta = 'GENERO' AND gender IS NULL THEN 'unknown_gender'
      WHEN consulta = 'CANAL' AND channel IS NULL THEN 'unknown_channel'
      WHEN consulta = 'ID_PERSONA' AND person IS NULL THEN 'not_uuid' END AS own,
    count(*) OVER (PARTITION BY k, consulta) AS times,
    max(CASE WHEN consulta = 'FECHA_DESDE' THEN moment_at END) OVER (PARTITION BY k) AS first_at,
    max(CASE WHEN consulta = 'FECHA_HASTA' THEN moment_at END) OVER (PARTITION BY k) AS last_at,
    max(CASE WHEN consulta = 'FECHA_HASTA' AND moment_at IS NOT NULL AND n % 7 = 0 THEN 1 ELSE 0 END)
      OVER (PARTITION BY k) AS open_end
  FROM valued
), verdict AS (
  SELECT k AS request_id, consulta, valor,
    CASE WHEN own IS NULL THEN CASE WHEN is_number THEN CAST(whole_value AS VARCHAR)
      WHEN consulta = 'GENERO' THEN gender WHEN consulta = 'CANAL' THEN channel
      WHEN consulta = 'ID_PERSONA' THEN person END END AS valor_norm,
    moment_at AS instante,
    CASE WHEN is_date AND moment_at IS NOT NULL THEN consulta = 'FECHA_HASTA' AND n % 7 = 0 END AS exclusiva,
    CASE WHEN own = 'unknown_filter' THEN own WHEN times > 1 THEN 'repeated_filter'
      WHEN own IS NOT NULL THEN own
      WHEN is_date AND (first_at > last_at OR (open_end = 1 AND first_at = last_at))
        THEN 'reversed_range' END AS error_code
  FROM judged
)"""


_ARABIC = "".join(chr(0x0660 + digit) for digit in range(10))


def week_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two untyped pairs per order: an ISO week date in six forms, an age in Arabic digits."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    year = F.extract(F.lit("YEAROFWEEK"), day).cast("string")
    week = F.concat(F.lit("W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    week_day = (F.weekday(day) + 1).cast("string")
    shape = key % 6
    moment = (
        F.when(shape == 0, F.concat_ws("-", year, week, week_day))
        .when(shape == 1, F.concat(year, week, week_day))
        .when(shape == 2, F.concat_ws("-", year, week))
        .when(shape == 3, F.concat(year, week, F.lit("T10:30")))
        .when(shape == 4, F.concat(F.concat_ws("-", year, week, week_day), F.lit(" 0915z")))
        .otherwise(F.concat(year, F.lit("-W54")))
    )
    bound = F.when(F.expr("o_orderkey div 6 % 2 = 0"), "FECHA_DESDE").otherwise("FECHA_HASTA")
    age = F.translate((key % 130).cast("string"), "0123456789", _ARABIC)
    pairs = F.explode(
        F.array(
            F.struct(bound.alias("consulta"), moment.alias("valor")),
            F.struct(F.lit("EDAD").alias("consulta"), age.alias("valor")),
        )
    )
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(key.alias("request_id"), pairs.alias("pair")).select("request_id", "pair.*")


WEEKS_SQL = f"""
WITH o AS (
  SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders
), w AS (
  SELECT k, d, CAST(date_trunc('week', d) AS DATE) AS monday, strftime(d, '%G') AS y,
    'W' || strftime(d, '%V') AS w, CAST(isodow(d) AS VARCHAR) AS u
  FROM o
)
SELECT k AS request_id, CASE WHEN k // 6 % 2 = 0 THEN 'FECHA_DESDE' ELSE 'FECHA_HASTA' END AS consulta,
  CASE k % 6 WHEN 0 THEN y || '-' || w || '-' || u WHEN 1 THEN y || w || u WHEN 2 THEN y || '-' || w
    WHEN 3 THEN y || w || 'T10:30' WHEN 4 THEN y || '-' || w || '-' || u || ' 0915z'
    ELSE y || '-W54' END AS valor,
  CAST(NULL AS VARCHAR) AS valor_norm,
  CASE k % 6 WHEN 0 THEN CAST(d AS TIMESTAMP) + INTERVAL 4 HOUR
    WHEN 1 THEN CAST(d AS TIMESTAMP) + INTERVAL 4 HOUR
    WHEN 2 THEN CAST(monday AS TIMESTAMP) + INTERVAL 4 HOUR
    WHEN 3 THEN CAST(monday AS TIMESTAMP) + INTERVAL 870 MINUTE
    WHEN 4 THEN CAST(d AS TIMESTAMP) + INTERVAL 555 MINUTE END AS instante,
  CASE WHEN k % 6 < 5 THEN FALSE END AS exclusiva,
  CASE WHEN k % 6 = 5 THEN 'not_iso_date' END AS error_code
FROM w
UNION ALL
SELECT k, 'EDAD', translate(CAST(k % 130 AS VARCHAR), '0123456789', '{_ARABIC}'),
  CASE WHEN k % 130 <= 120 THEN CAST(k % 130 AS VARCHAR) END, NULL, NULL,
  CASE WHEN k % 130 > 120 THEN 'out_of_range' END
FROM o"""
