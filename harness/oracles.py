"""SQL for the reference database: the same results from the same tables."""

from __future__ import annotations

from harness.dirty_sales import RAW_SQL
from harness.request_tables import TIME_REQUESTS_SQL, TYPED_REQUESTS_SQL, VALIDATION_SQL
from tallyspark.contract import CHANNELS, REASONS

_INTEGER = r"'^[+-]?[0-9]+$'"
_DECIMAL = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"
_MOMENT = (
    r"'^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(?::(\d{2}(?:\.\d{1,6})?))?"
    r"(?:([zZ])|([+-])([01]\d|2[0-3])(?::?([0-5]\d))?)?)?$'"
)
_UUID = r"'^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$'"


def _group(number: int) -> str:
    return f"regexp_extract(trim(r_fecha), {_MOMENT}, {number})"


def _long(column: str) -> str:
    return (
        f"CASE WHEN regexp_matches(trim({column}), {_INTEGER}) "
        f"THEN TRY_CAST(trim({column}) AS BIGINT) END"
    )


def _double(column: str) -> str:
    return (
        f"CASE WHEN regexp_matches(trim({column}), {_DECIMAL}) "
        f"THEN TRY_CAST(trim({column}) AS DOUBLE) END"
    )


# raw -> typed columns, one row per line item, with its keys
NORMAL = f"""{RAW_SQL},
moment AS (
  SELECT *,
    CASE WHEN regexp_matches(trim(r_fecha), {_MOMENT}) THEN TRY_CAST({_group(1)} || ' '
      || CASE WHEN {_group(2)} = '' THEN '00:00' ELSE {_group(2)} END || ':'
      || CASE WHEN {_group(3)} = '' THEN '00' ELSE {_group(3)} END AS TIMESTAMP) END AS wall,
    CASE WHEN {_group(4)} <> '' THEN 0
      WHEN {_group(5)} <> '' THEN CASE {_group(5)} WHEN '-' THEN -1 ELSE 1 END
        * (60 * CAST({_group(6)} AS INTEGER)
           + CASE WHEN {_group(7)} = '' THEN 0 ELSE CAST({_group(7)} AS INTEGER) END)
      ELSE -240 END AS shift
  FROM raw
), typed AS (
  SELECT l_orderkey, l_linenumber,
    wall - to_minutes(CAST(shift AS BIGINT)) AS fecha,
    upper(trim(r_canal)) AS canal,
    {_long("r_sku")} AS sku,
    trim(r_producto) AS producto,
    {_long("r_unidades")} AS unidades,
    {_double("r_descuento")} AS porcentaje_descuento,
    {_double("r_monto")} AS monto_aplicado,
    {_long("r_boleta")} AS boleta,
    {_long("r_local")} AS local,
    lower(trim(r_cliente)) AS codigo_cliente,
    CASE WHEN regexp_matches(trim(r_nacimiento), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')
      THEN TRY_CAST(trim(r_nacimiento) AS DATE) END AS fecha_nacimiento,
    {_long("r_genero")} AS genero_codigo,
    coalesce(length(trim(r_genero)) > 0, FALSE) AS genero_informado
  FROM moment
), aged AS (
  SELECT *, CAST(fecha - INTERVAL 4 HOUR AS DATE) AS dia FROM typed
), normal AS (
  SELECT * EXCLUDE (dia),
    CAST(year(dia) - year(fecha_nacimiento)
      - CASE WHEN month(dia) < month(fecha_nacimiento)
               OR (month(dia) = month(fecha_nacimiento) AND day(dia) < day(fecha_nacimiento))
             THEN 1 ELSE 0 END AS SMALLINT) AS edad_en_transaccion,
    CASE WHEN genero_codigo = 1 THEN 'Masculino' WHEN genero_codigo = 2 THEN 'Femenino'
      WHEN genero_codigo IS NULL OR genero_codigo = 0 THEN 'No especificado'
      ELSE 'Otro' END AS genero_texto
  FROM aged
)"""

_CHANNEL_SET = ", ".join(f"'{c}'" for c in CHANNELS)
MARKED = f"""{NORMAL}, marked AS (
  SELECT *,
    fecha IS NULL AS fecha_invalida,
    canal IS NULL OR canal NOT IN ({_CHANNEL_SET}) AS canal_invalido,
    sku IS NULL OR sku <= 0 AS sku_invalido,
    producto IS NULL OR length(producto) = 0 AS producto_invalido,
    unidades IS NULL OR unidades <= 0 AS unidades_invalidas,
    porcentaje_descuento IS NULL OR NOT isfinite(porcentaje_descuento)
      OR porcentaje_descuento < 0 OR porcentaje_descuento > 1 AS descuento_invalido,
    monto_aplicado IS NULL OR NOT isfinite(monto_aplicado) AS monto_invalido,
    boleta IS NULL OR boleta <= 0 AS boleta_invalida,
    local IS NULL OR local <= 0 AS local_invalido,
    codigo_cliente IS NULL OR NOT regexp_matches(codigo_cliente, {_UUID}) AS uuid_invalido,
    fecha_nacimiento IS NULL AS fecha_nacimiento_invalida,
    genero_informado AND genero_codigo IS NULL AS genero_invalido,
    edad_en_transaccion IS NULL OR edad_en_transaccion < 0
      OR edad_en_transaccion > 120 AS edad_invalida
  FROM normal
), ventas AS (
  SELECT fecha, canal, sku, monto_aplicado, local, codigo_cliente, genero_texto,
         edad_en_transaccion
  FROM marked WHERE NOT ({" OR ".join(REASONS)})
)"""

_TYPED_COLUMNS = """fecha, canal, producto, sku, unidades, boleta, local, genero_codigo,
  porcentaje_descuento, monto_aplicado, codigo_cliente, fecha_nacimiento, genero_informado,
  edad_en_transaccion, genero_texto"""


def statistics(value: str, source: str, where: str = "TRUE") -> str:
    return f"""SELECT round(coalesce(sum({value}), 0.0) + 1e-7, 2) AS suma,
  CAST(count(*) AS BIGINT) AS conteo,
  round(avg({value}) + 1e-7, 4) AS promedio, min({value}) AS minimo, max({value}) AS maximo,
  round(median({value}) + 1e-7, 4) AS mediana, round(stddev_pop({value}) + 1e-7, 4) AS desviacion_estandar
FROM {source} WHERE ({where}) AND {value} IS NOT NULL AND isfinite({value})"""


def filtered(where: str) -> str:
    return f"WITH {MARKED} {statistics('monto_aplicado', 'ventas', where)}"


_LINEITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "nullif(l_tax, 0)", "l_returnflag", "l_linestatus", "l_shipdate")
_DIGEST = f"""md5({" || chr(31) || ".join(
    f"coalesce(CAST({column} AS VARCHAR), chr(1))" for column in _LINEITEM
)})"""

_UUID_TEXT = r"'\b[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\b', '[UUID_REDACTADO]', 'gi'"
_RUN_TEXT = r"'\b\d{1,3}(?:\.\d{3}){2}-[\dkK]\b', '[RUN_REDACTADO]', 'g'"


def redacted(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, {_UUID_TEXT}), {_RUN_TEXT})"


_NOISY = """CASE event_id % 5 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE
  WHEN 2 THEN NULL WHEN 3 THEN '-Infinity'::DOUBLE ELSE value END"""

MARKED_TEXT = """CASE (conv_id + turn) % 4
  WHEN 0 THEN text || ' ' || u || ', 12.345.678-K.'
  WHEN 1 THEN upper(u) || ': ' || text
  WHEN 2 THEN '(1.234.567-' || CAST(turn % 10 AS VARCHAR) || ')' || text
  ELSE text || ' x' || u || ' 12345678-9 112.345.678-k' END"""


_PER_REQUEST = """SELECT r.request_id, round(coalesce(sum(v.monto_aplicado), 0.0) + 1e-7, 2) AS suma,
  CAST(count(v.monto_aplicado) AS BIGINT) AS conteo,
  round(avg(v.monto_aplicado) + 1e-7, 4) AS promedio, min(v.monto_aplicado) AS minimo,
  max(v.monto_aplicado) AS maximo, round(median(v.monto_aplicado) + 1e-7, 4) AS mediana,
  round(stddev_pop(v.monto_aplicado) + 1e-7, 4) AS desviacion_estandar, FALSE AS no_finita"""
_IN_RANGE = """(r.desde IS NULL OR v.fecha >= r.desde)
    AND (r.hasta IS NULL OR (r.exclusiva AND v.fecha < r.hasta)
         OR (NOT r.exclusiva AND v.fecha <= r.hasta))"""


def oracle_sql() -> dict[str, str]:
    reasons = ", ".join(f"CAST(count_if({r}) AS BIGINT) AS {r}" for r in REASONS)
    any_reason = " OR ".join(REASONS)
    sql = {
        "stats_global": statistics("l_extendedprice", "lineitem"),
        "stats_events_value": statistics("value", "events"),
        "stats_orders_totalprice": statistics("o_totalprice", "orders"),
        "stats_empty": statistics("l_extendedprice", "lineitem", "l_quantity < 0"),
        "stats_nonfinite": statistics("v", f"(SELECT {_NOISY} AS v FROM events)"),
        "stats_overflow_flag": """SELECT CAST(count(*) AS BIGINT) AS conteo, NOT isfinite(sum(v)) AS no_finita
            FROM (SELECT l_extendedprice * 1e303 AS v FROM lineitem)""",
        "median_exact": "SELECT round(median(l_extendedprice) + 1e-7, 4) AS mediana FROM lineitem",
        "normalize_text": f"WITH {NORMAL} SELECT l_orderkey, l_linenumber, canal, producto, codigo_cliente FROM normal",
        "normalize_int": f"WITH {NORMAL} SELECT l_orderkey, l_linenumber, sku, unidades, boleta, local, genero_codigo FROM normal",
        "normalize_double": f"WITH {NORMAL} SELECT l_orderkey, l_linenumber, porcentaje_descuento, monto_aplicado FROM normal",
        "normalize_birthdate": f"WITH {NORMAL} SELECT l_orderkey, l_linenumber, fecha_nacimiento FROM normal",
        "normalize_timestamp": f"WITH {NORMAL} SELECT l_orderkey, l_linenumber, fecha FROM normal",
        "age_at_sale": f"WITH {NORMAL} SELECT l_orderkey, l_linenumber, edad_en_transaccion FROM normal",
        "gender_text": f"WITH {NORMAL} SELECT l_orderkey, l_linenumber, genero_texto, genero_informado FROM normal",
        "quality_report": f"""WITH {MARKED} SELECT CAST(count(*) AS BIGINT) AS total_rows,
            CAST(count_if(NOT ({any_reason})) AS BIGINT) AS valid_rows,
            CAST(count_if({any_reason}) AS BIGINT) AS discarded_rows, {reasons} FROM marked""",
        "published_quality": f"""WITH {MARKED}, counts AS (
            SELECT CAST(count(*) AS BIGINT) AS total_rows,
              CAST(count_if(NOT ({any_reason})) AS BIGINT) AS valid_rows,
              CAST(count_if({any_reason}) AS BIGINT) AS discarded_rows, {reasons} FROM marked)
            {" UNION ALL ".join(
                f"SELECT '{r}' AS reason, {r} AS rows, total_rows, valid_rows, discarded_rows FROM counts"
                for r in REASONS)}""",
        "valid_rows": f"WITH {MARKED} SELECT {_TYPED_COLUMNS} FROM marked WHERE NOT ({any_reason})",
        "discarded_rows": f"WITH {MARKED} SELECT {_TYPED_COLUMNS}, {', '.join(REASONS)} FROM marked WHERE {any_reason}",
        "published_row_count": f"WITH {MARKED} SELECT CAST(count(*) AS BIGINT) AS filas FROM ventas",
        "dataset_checks": f"""WITH {MARKED}, counts AS (
            SELECT count(*) AS n, count_if(NOT ({any_reason})) AS good FROM marked)
            SELECT * FROM (VALUES
              ('generation', TRUE, 'table, summary, quality and manifest carry one generation'),
              ('declaration', TRUE, 'schema version, target column and columns are as declared'),
              ('schema', TRUE, 'the stored table has the analytic schema'),
              ('reasons', TRUE, 'exactly the named reasons, each from 0 to the total'),
              ('publication', TRUE, 'policy present and one publication time'),
              ('statistics', TRUE, 'seven statistics, finite, null only without rows')
            ) AS fixed("check", ok, detail)
            UNION ALL
            SELECT 'row_counts', TRUE, 'table ' || good || ', valid ' || good || ', discarded '
              || (n - good) || ', total ' || n FROM counts""",
        "month_of_sales": f"""WITH {MARKED} SELECT * FROM ventas
            WHERE fecha >= TIMESTAMP '1995-03-01' AND fecha < TIMESTAMP '1995-04-01'""",
        "fingerprint": f"""SELECT CAST(count(*) AS BIGINT) AS fp_rows,
            CAST(sum(CAST(CAST('0x' || substr(h, 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS fp_high,
            CAST(sum(CAST(CAST('0x' || substr(h, 16, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS fp_low
            FROM (SELECT {_DIGEST} AS h FROM lineitem)""",
        "batch_stats": f"""WITH {MARKED}, {TYPED_REQUESTS_SQL}
            {_PER_REQUEST}
            FROM requests r LEFT JOIN ventas v
              ON (r.genero IS NULL OR r.genero = v.genero_texto)
             AND (r.edad IS NULL OR r.edad = v.edad_en_transaccion)
             AND (r.canal IS NULL OR r.canal = v.canal)
             AND (r.id_persona IS NULL OR r.id_persona = v.codigo_cliente)
             AND (r.local IS NULL OR r.local = v.local)
             AND {_IN_RANGE}
            GROUP BY r.request_id""",
        "batch_time_ranges": f"""WITH {MARKED}, {TIME_REQUESTS_SQL}
            {_PER_REQUEST}
            FROM requests r LEFT JOIN ventas v ON {_IN_RANGE}
            GROUP BY r.request_id""",
        "request_validation": f"{VALIDATION_SQL} SELECT * FROM verdict",
        "accepted_requests": f"""{VALIDATION_SQL}
            SELECT request_id, max(CASE WHEN consulta = 'GENERO' THEN valor_norm END) AS genero,
              CAST(max(CASE WHEN consulta = 'EDAD' THEN valor_norm END) AS SMALLINT) AS edad,
              max(CASE WHEN consulta = 'CANAL' THEN valor_norm END) AS canal,
              CAST(max(CASE WHEN consulta = 'CODIGO_PRODUCTO' THEN valor_norm END) AS BIGINT)
                AS codigo_producto,
              max(CASE WHEN consulta = 'ID_PERSONA' THEN valor_norm END) AS id_persona,
              CAST(max(CASE WHEN consulta = 'LOCAL' THEN valor_norm END) AS BIGINT) AS local,
              max(CASE WHEN consulta = 'FECHA_DESDE' THEN instante END) AS fecha_desde,
              max(CASE WHEN consulta = 'FECHA_HASTA' THEN instante END) AS fecha_hasta,
              coalesce(bool_or(CASE WHEN consulta = 'FECHA_HASTA' THEN exclusiva END), FALSE)
                AS fecha_hasta_exclusiva
            FROM verdict GROUP BY request_id HAVING count(error_code) = 0""",
        "redact_conversations": f"""SELECT conv_id, turn, {redacted(MARKED_TEXT)} AS text
            FROM (SELECT *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4)
                    || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS u
                  FROM (SELECT *, md5(CAST(conv_id AS VARCHAR)) AS h FROM conversations))""",
        "redact_documents": f"""SELECT doc_id, {redacted('text')} || CASE doc_id % 4
            WHEN 0 THEN ' ñ9.876.543-2, 0f8fad5b-d9cb-469f-a165-70867728950'
            WHEN 1 THEN ' «[RUN_REDACTADO]»'
            WHEN 2 THEN ' ([UUID_REDACTADO])'
            ELSE ' 中0f8fad5b-d9cb-469f-a165-70867728950e 19.876.543-22' END AS text
            FROM documents""",
    }
    sql["csv_comma_discarded"] = sql["discarded_rows"]
    analytic = f"WITH {MARKED} SELECT * FROM ventas"
    for name in ("analytic_projection", "csv_ingest", "publish_and_read", "reingest_unchanged"):
        sql[name] = analytic
    sql["summary_cached"] = filtered("TRUE")
    for name, (_, where) in FILTERS.items():
        sql[name] = filtered(where)
    return sql


# Query -> (filter pairs as a user gives them, the same condition in SQL)
FILTERS: dict[str, tuple[list[tuple[str, object]], str]] = {
    "filter_gender": ([("GENERO", " femenino ")], "genero_texto = 'Femenino'"),
    "filter_age": ([("EDAD", " 30 ")], "edad_en_transaccion = 30"),
    "filter_channel": ([("CANAL", " app ")], "canal = 'APP'"),
    "filter_product": ([("CODIGO_PRODUCTO", "+17")], "sku = 17"),
    "filter_person": (  # MD5 of '7', cut like every customer code of the extract
        [("ID_PERSONA", "{8F14E45F-CEEA-167A-5A36-DEDD4BEA2543}")],
        "codigo_cliente = '8f14e45f-ceea-167a-5a36-dedd4bea2543'",
    ),
    "filter_shop": ([("LOCAL", 103)], "local = 103"),
    "filter_from": ([("FECHA_DESDE", "1998-06-01")], "fecha >= TIMESTAMP '1998-06-01 04:00:00'"),
    "filter_until": (
        [("FECHA_HASTA", "1996-02-29T12:30:00-03:00")],
        "fecha <= TIMESTAMP '1996-02-29 15:30:00'",
    ),
    "filter_date_only_upper": (
        [("FECHA_HASTA", "1996-02-29")],
        "fecha < TIMESTAMP '1996-03-01 04:00:00'",
    ),
    "filter_instant_upper": (
        [("FECHA_HASTA", "19960229")],
        "fecha <= TIMESTAMP '1996-02-29 04:00:00'",
    ),
    "filter_date_range": (
        [("FECHA_DESDE", "1997-01-01"), ("FECHA_HASTA", "1997-12-31")],
        "fecha >= TIMESTAMP '1997-01-01 04:00:00' AND fecha < TIMESTAMP '1998-01-01 04:00:00'",
    ),
    "filter_and_all": (
        [
            ("GENERO", "Masculino"),
            ("CANAL", "POS"),
            ("FECHA_DESDE", "1995-06-01T00:00:00"),
            ("FECHA_HASTA", "2000-11-29T23:59:59Z"),
        ],
        "genero_texto = 'Masculino' AND canal = 'POS' AND fecha >= TIMESTAMP '1995-06-01 04:00:00'"
        " AND fecha <= TIMESTAMP '2000-11-29 23:59:59'",
    ),
    "filter_no_match": (
        [("EDAD", 120), ("LOCAL", 1)],
        "edad_en_transaccion = 120 AND local = 1",
    ),
}
