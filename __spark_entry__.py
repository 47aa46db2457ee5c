"""

``FIXTURES.md`` section 3 describes the raw sales extract, which is derived from
``lineitem``. It is written once per session, ingested once, and then queried.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from datetime import timedelta
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from harness import oracles, workspace  # noqa: E402
from harness.damaged import CHECKS_SQL, checks_of_damaged  # noqa: E402
from harness.dirty_sales import dirty_sales  # noqa: E402
from harness.request_tables import (  # noqa: E402
    WEEKS_SQL,
    raw_requests,
    time_requests,
    typed_requests,
    week_requests,
)

from tallyspark.functions.fingerprint import fingerprint  # noqa: E402
from tallyspark.functions.moments import utc_wall_clock  # noqa: E402
from tallyspark.functions.privacy import redact  # noqa: E402
from tallyspark.operators import quality  # noqa: E402
from tallyspark.operators.checks import dataset_checks  # noqa: E402
from tallyspark.operators.filters import FilterSpec  # noqa: E402
from tallyspark.operators.normalize import analytic_projection, normalize  # noqa: E402
from tallyspark.operators.requests import accepted_requests, validate_requests  # noqa: E402
from tallyspark.operators.statistics import flagged_statistics, seven_statistics  # noqa: E402
from tallyspark.plans import query  # noqa: E402
from tallyspark.plans.ingest import ingest  # noqa: E402
from tallyspark.sources.generations import expire_generations, latest_manifest  # noqa: E402
from tallyspark.sources.sales_csv import read_sales_csv  # noqa: E402

try:
    import corpus_pipeline
    from tallyspark.llm import queries as llm_queries
except ModuleNotFoundError as problem:  # the optional package, or a module it needs, is not there
    if (problem.name or "").startswith("tallyspark.") and not problem.name.startswith("tallyspark.llm"):
        raise
    corpus_pipeline = llm_queries = None

Query = Callable[[SparkSession, str], DataFrame]

_DIGITS = {"suma": 2, "promedio": 4, "mediana": 4, "desviacion_estandar": 4}
_NO_TIE = 1e-7  # a mean of few prices often ends in an exact half of the last digit
_KEYS = ("l_orderkey", "l_linenumber")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(statistics: DataFrame) -> DataFrame:
    """Sums of doubles depend on their order in the last digits; compare rounded."""
    return statistics.select(
        *(
            F.round(F.col(c) + _NO_TIE, _DIGITS[c]).alias(c) if c in _DIGITS else F.col(c)
            for c in statistics.columns
        )
    )


def _clock(rows: DataFrame) -> DataFrame:
    """Instants as UTC wall clock, so the session time zone has no part in a comparison."""
    instants = [name for name, kind in rows.dtypes if kind == "timestamp"]
    return rows.withColumns({name: utc_wall_clock(F.col(name)) for name in instants})


def _statistics_of(table: str, column: str) -> Query:
    return lambda spark, sf_dir: _rounded(seven_statistics(_table(spark, sf_dir, table), column))


def _empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    nothing = _table(spark, sf_dir, "lineitem").where(F.col("l_quantity") < 0)
    return _rounded(seven_statistics(nothing, "l_extendedprice"))


def _nonfinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("event_id") % 5
    noisy = (
        F.when(turn == 0, F.lit(float("nan")))
        .when(turn == 1, F.lit(float("inf")))
        .when(turn == 2, F.lit(None))
        .when(turn == 3, F.lit(float("-inf")))
        .otherwise(F.col("value"))
    )
    return _rounded(seven_statistics(_table(spark, sf_dir, "events").withColumn("v", noisy), "v"))


def _overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    huge = _table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_extendedprice") * 1e303)
    return flagged_statistics(huge, "v").select("conteo", "no_finita")


def _median(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = _table(spark, sf_dir, "lineitem")
    return _rounded(seven_statistics(prices, "l_extendedprice")).select("mediana")


def _normalized(*columns: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = normalize(dirty_sales(spark, sf_dir, _KEYS), keep=_KEYS)
        return _clock(rows.select(*_KEYS, *columns))

    return run


def _extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(read_sales_csv(spark, workspace.extract(spark, sf_dir)))


def _quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_extract(spark, sf_dir))


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clock(quality.valid_rows(_extract(spark, sf_dir)))


def _discarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clock(quality.discarded_rows(_extract(spark, sf_dir)))


def _analytic(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = normalize(dirty_sales(spark, sf_dir))
    return _clock(analytic_projection(quality.valid_rows(sales)))


def _csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows by way of a CSV file: separator, header alias and null tokens."""
    return _clock(analytic_projection(quality.valid_rows(_extract(spark, sf_dir))))


def _csv_comma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the rules discard, from the comma form of the extract."""
    rows = normalize(read_sales_csv(spark, workspace.comma_extract(spark, sf_dir)))
    return _clock(quality.discarded_rows(rows))


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.published_sales(spark, workspace.published(spark, sf_dir))


def _publish_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = workspace.published(spark, sf_dir)
    ingest(spark, workspace.extract(spark, sf_dir), root, force=True)
    return _clock(query.published_sales(spark, root))


def _reingest_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingesting the same extract again publishes nothing; the rows stay the same."""
    root = workspace.published(spark, sf_dir)
    result = ingest(spark, workspace.extract(spark, sf_dir), root)
    if result.status != "sin_cambios":
        raise RuntimeError(f"an unchanged extract was published again: {result}")
    return _clock(query.published_sales(spark, root))


def _publish_and_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three publications, the first of which expires; a reader of the second loses nothing."""
    root = workspace.new_dir(spark, sf_dir, f"expiry-{uuid4().hex}")
    source = workspace.extract(spark, sf_dir)
    first = ingest(spark, source, root, force=True)
    ingest(spark, source, root, force=True)
    second = _clock(query.published_sales(spark, root))
    ingest(spark, source, root, force=True)
    gone = expire_generations(spark, root, timedelta(0))
    if gone != [first.generation_id]:
        raise RuntimeError(f"other generations expired than the first: {gone}")
    return second


def _row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir).agg(F.count("*").alias("filas"))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(query.statistics(spark, workspace.published(spark, sf_dir), FilterSpec()))


def _published_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = query.published_quality(spark, workspace.published(spark, sf_dir))
    return rows.select("reason", "rows", "total_rows", "valid_rows", "discarded_rows")


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = workspace.published(spark, sf_dir)
    return dataset_checks(spark, root, latest_manifest(spark, root))


def _checks_of_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checks say of the published generation and of copies damaged in one way each."""
    folder = workspace.new_dir(spark, sf_dir, f"damaged-{uuid4().hex}")
    return checks_of_damaged(spark, workspace.published(spark, sf_dir), folder)


def _month_of_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One month of the published table, of which only the pages of that month are read."""
    moment = F.col("fecha")
    return _clock(
        _published(spark, sf_dir).where(
            (moment >= F.to_timestamp(F.lit("1995-03-01T00:00:00Z")))
            & (moment < F.to_timestamp(F.lit("1995-04-01T00:00:00Z")))
        )
    )


def _filtered(name: str) -> Query:
    pairs, _ = oracles.FILTERS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = workspace.published(spark, sf_dir)
        return _rounded(query.statistics(spark, root, FilterSpec.from_pairs(pairs)))

    return run


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = workspace.published(spark, sf_dir)
    return _rounded(query.statistics_of_requests(spark, root, typed_requests(spark, sf_dir)))


def _batch_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that set a time range and nothing else, so every sale could meet every one."""
    root = workspace.published(spark, sf_dir)
    return _rounded(query.statistics_of_requests(spark, root, time_requests(spark, sf_dir)))


def _validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clock(validate_requests(raw_requests(spark, sf_dir)))


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clock(accepted_requests(validate_requests(raw_requests(spark, sf_dir))))


def _weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Week dates and digits of another script, as the rules for one request take them."""
    return _clock(validate_requests(week_requests(spark, sf_dir)))


def _fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns: keys, amounts, text, instants, and nulls in place of zero taxes."""
    rows = _clock(_table(spark, sf_dir, "lineitem"))
    found = fingerprint(rows.withColumn("l_tax", F.nullif("l_tax", F.lit(0.0))))
    sums = (F.col(c).cast("string").alias(c) for c in ("fp_high", "fp_low"))
    return found.select("fp_rows", *sums)


def _redact_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.md5(F.col("conv_id").cast("string").cast("binary"))
    person = F.concat_ws(
        "-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    )
    turn, text = (F.col("conv_id") + F.col("turn")) % 4, F.col("text")
    last = (F.col("turn") % 10).cast("string")
    marked = (
        F.when(turn == 0, F.concat(text, F.lit(" "), person, F.lit(", 12.345.678-K.")))
        .when(turn == 1, F.concat(F.upper(person), F.lit(": "), text))
        .when(turn == 2, F.concat(F.lit("(1.234.567-"), last, F.lit(")"), text))
        .otherwise(F.concat(text, F.lit(" x"), person, F.lit(" 12345678-9 112.345.678-k")))
    )
    rows = _table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", redact(marked).alias("text"))


def _redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers behind every text: two to be replaced, two that letters run into."""
    person = "0f8fad5b-d9cb-469f-a165-70867728950e"
    kind = F.col("doc_id") % 4
    planted = (
        F.when(kind == 0, f" ñ9.876.543-2, {person[:-1]}")
        .when(kind == 1, " «9.876.543-2»")
        .when(kind == 2, f" ({person})")
        .otherwise(f" 中{person} 19.876.543-22")
    )
    rows = _table(spark, sf_dir, "documents")
    return rows.select("doc_id", redact(F.concat("text", planted)).alias("text"))


_QUERIES: dict[str, Query] = {
    "stats_global": _statistics_of("lineitem", "l_extendedprice"),
    "stats_events_value": _statistics_of("events", "value"),
    "stats_orders_totalprice": _statistics_of("orders", "o_totalprice"),
    "stats_empty": _empty,
    "stats_nonfinite": _nonfinite,
    "stats_overflow_flag": _overflow,
    "median_exact": _median,
    "normalize_text": _normalized("canal", "producto", "codigo_cliente"),
    "normalize_int": _normalized("sku", "unidades", "boleta", "local", "genero_codigo"),
    "normalize_double": _normalized("porcentaje_descuento", "monto_aplicado"),
    "normalize_birthdate": _normalized("fecha_nacimiento"),
    "normalize_timestamp": _normalized("fecha"),
    "age_at_sale": _normalized("edad_en_transaccion"),
    "gender_text": _normalized("genero_texto", "genero_informado"),
    "quality_report": _quality_report,
    "valid_rows": _valid,
    "discarded_rows": _discarded,
    "analytic_projection": _analytic,
    "csv_ingest": _csv_ingest,
    "csv_comma_discarded": _csv_comma,
    "publish_and_read": _publish_and_read,
    "reingest_unchanged": _reingest_unchanged,
    "publish_and_expire": _publish_and_expire,
    "published_row_count": _row_count,
    "published_quality": _published_quality,
    "summary_cached": _summary,
    "dataset_checks": _checks,
    "checks_of_damaged": _checks_of_damaged,
    "month_of_sales": _month_of_sales,
    **{name: _filtered(name) for name in oracles.FILTERS},
    "batch_stats": _batch,
    "batch_time_ranges": _batch_time,
    "request_validation": _validation,
    "accepted_requests": _accepted,
    "request_week_dates": _weeks,
    "fingerprint": _fingerprint,
    "redact_conversations": _redact_conversations,
    "redact_documents": _redact_documents,
}


def entry(spark: SparkSession) -> DataFrame:
    """Quality report of the raw extract: every parse branch and every rule in one pass."""
    return queries()["quality_report"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    if llm_queries is None:
        return dict(_QUERIES)
    return {**_QUERIES, **llm_queries.QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    own = oracles.oracle_sql()
    own |= {"checks_of_damaged": CHECKS_SQL, "request_week_dates": WEEKS_SQL}
    own["publish_and_expire"] = own["publish_and_read"]
    if llm_queries is None:
        return own
    whole = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**own, **llm_queries.SQL, **whole}
