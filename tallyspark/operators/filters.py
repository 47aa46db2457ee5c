"""Filter requests: from user values to one conjunctive predicate."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, fields
from datetime import UTC, date, datetime, time, timedelta, timezone
from functools import reduce
from operator import and_
from uuid import UUID

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.contract import (
    BUSINESS_UTC_OFFSET_MINUTES,
    CHANNELS,
    FILTER_NAMES,
    GENDERS,
    MAX_AGE,
    REQUEST_SCHEMA,
)
from tallyspark.errors import FilterError

MAX_DIGITS = 19
MAX_LONG = 2**63 - 1
_BUSINESS_ZONE = timezone(timedelta(minutes=BUSINESS_UTC_OFFSET_MINUTES))
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)

# Smallest and largest accepted integer per filter.
INTEGER_RANGES = {
    "EDAD": (0, MAX_AGE),
    "CODIGO_PRODUCTO": (1, MAX_LONG),
    "LOCAL": (1, MAX_LONG),
}


def _integer(name: str, raw: object) -> int:
    if type(raw) not in (str, int):  # a bool is an int to isinstance
        raise FilterError("not_integer", f"{name} takes an integer")
    text = str(raw).strip()
    if not re.fullmatch(r"[+-]?\d+", text) or len(text.lstrip("+-").lstrip("0")) > MAX_DIGITS:
        raise FilterError("not_integer", f"{name} takes an integer")
    # Strip zeros first: Python refuses to read very long digit strings.
    value = int(text.lstrip("+-").lstrip("0") or "0") * (-1 if text[0] == "-" else 1)
    smallest, largest = INTEGER_RANGES[name]
    if not smallest <= value <= largest:
        raise FilterError("out_of_range", f"{name} must be from {smallest} to {largest}")
    return value


def _text(name: str, raw: object) -> str:
    if not isinstance(raw, str):
        raise FilterError("not_text", f"{name} takes text")
    return raw.strip()


def _gender(name: str, raw: object) -> str:
    wanted = _text(name, raw).casefold()
    for gender in GENDERS:
        if gender.casefold() == wanted:
            return gender
    raise FilterError("unknown_gender", f"{name} is one of {', '.join(GENDERS)}")


def _channel(name: str, raw: object) -> str:
    channel = _text(name, raw).upper()
    if channel not in CHANNELS:
        raise FilterError("unknown_channel", f"{name} is one of {', '.join(CHANNELS)}")
    return channel


def _person(name: str, raw: object) -> str:
    try:
        return str(UUID(_text(name, raw)))
    except ValueError:
        raise FilterError("not_uuid", f"{name} takes a UUID") from None


@dataclass(frozen=True)
class Boundary:
    """A UTC instant; ``exclusive`` if the instant itself is outside the range."""

    instant: datetime
    exclusive: bool = False


def parse_boundary(name: str, raw: object, *, upper: bool) -> Boundary:
    """ISO date or date-time. Without an offset it is UTC-4.

    An upper bound given as ``YYYY-MM-DD`` covers that whole day; any other form,
    the compact ``YYYYMMDD`` included, is a point in time.
    """
    text = _text(name, raw) if isinstance(raw, str) else ""
    try:
        if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text):
            day = date.fromisoformat(text) + timedelta(days=1 if upper else 0)
            midnight = datetime.combine(day, time(), _BUSINESS_ZONE)
            return Boundary(midnight.astimezone(UTC), exclusive=upper)
        moment = datetime.fromisoformat(re.sub(r"[zZ]\Z", "+00:00", text))
        if moment.tzinfo is None:
            moment = moment.replace(tzinfo=_BUSINESS_ZONE)
        return Boundary(moment.astimezone(UTC))
    except (ValueError, OverflowError):
        raise FilterError("not_iso_date", f"{name} takes an ISO 8601 date or date-time") from None


def _instant(value: datetime) -> Column:
    """Literal instant, whatever the session time zone."""
    return F.timestamp_micros(F.lit((value - _EPOCH) // timedelta(microseconds=1)))


@dataclass(frozen=True)
class FilterSpec:
    """Validated filters; ``None`` means not set. All set filters must hold."""

    genero: str | None = None
    edad: int | None = None
    canal: str | None = None
    codigo_producto: int | None = None
    id_persona: str | None = None
    local: int | None = None
    fecha_desde: datetime | None = None
    fecha_hasta: datetime | None = None
    fecha_hasta_exclusiva: bool = False

    @classmethod
    def from_pairs(cls, pairs: Iterable[tuple[str, object]]) -> FilterSpec:
        """Build from ``(filter name, raw value)`` pairs; raises ``FilterError``."""
        given: dict[str, object] = {}
        for name, raw in pairs:
            if name not in FILTER_NAMES:
                raise FilterError("unknown_filter", "this filter does not exist")
            if name in given:
                raise FilterError("repeated_filter", f"{name} is given more than once")
            if raw is None:
                raise FilterError("missing_value", f"{name} has no value")
            given[name] = raw
        readers: dict[str, Callable[[str, object], object]] = {
            "GENERO": _gender,
            "EDAD": _integer,
            "CANAL": _channel,
            "CODIGO_PRODUCTO": _integer,
            "ID_PERSONA": _person,
            "LOCAL": _integer,
        }
        values = {
            name.lower(): readers[name](name, raw) for name, raw in given.items() if name in readers
        }
        if "FECHA_DESDE" in given:
            start = parse_boundary("FECHA_DESDE", given["FECHA_DESDE"], upper=False)
            values["fecha_desde"] = start.instant
        if "FECHA_HASTA" in given:
            end = parse_boundary("FECHA_HASTA", given["FECHA_HASTA"], upper=True)
            values.update(fecha_hasta=end.instant, fecha_hasta_exclusiva=end.exclusive)
        return cls(**values)._checked()

    def _checked(self) -> FilterSpec:
        if self.fecha_desde is not None and self.fecha_hasta is not None:
            late = self.fecha_desde > self.fecha_hasta
            if late or (self.fecha_hasta_exclusiva and self.fecha_desde == self.fecha_hasta):
                raise FilterError("reversed_range", "FECHA_DESDE lies after FECHA_HASTA")
        return self

    @property
    def names(self) -> list[str]:
        """Names of the set filters in contract order; never their values."""
        return [name for name in FILTER_NAMES if getattr(self, name.lower()) is not None]

    @property
    def is_empty(self) -> bool:
        return not self.names

    def predicate(self) -> Column:
        """Plain comparisons of stored columns with literals, so Parquet can skip by them."""
        tests = []
        for value, column in (
            (self.genero, "genero_texto"),
            (self.edad, "edad_en_transaccion"),
            (self.canal, "canal"),
            (self.codigo_producto, "sku"),
            (self.id_persona, "codigo_cliente"),
            (self.local, "local"),
        ):
            if value is not None:
                tests.append(F.col(column) == F.lit(value))
        if self.fecha_desde is not None:
            tests.append(F.col("fecha") >= _instant(self.fecha_desde))
        if self.fecha_hasta is not None:
            limit = _instant(self.fecha_hasta)
            sold = F.col("fecha")
            tests.append(sold < limit if self.fecha_hasta_exclusiva else sold <= limit)
        return reduce(and_, tests) if tests else F.lit(True)

    def apply(self, sales: DataFrame) -> DataFrame:
        return sales if self.is_empty else sales.where(self.predicate())


def requests_frame(spark: SparkSession, specs: dict[str, FilterSpec]) -> DataFrame:
    """Filter specs as a request table for ``batch_statistics``."""
    schema = T.StructType([T.StructField("request_id", T.StringType()), *REQUEST_SCHEMA.fields])
    rows = [
        (key, *(getattr(spec, field.name) for field in fields(spec))) for key, spec in specs.items()
    ]
    return spark.createDataFrame(rows, schema)
