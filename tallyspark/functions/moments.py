"""Instants, fixed-offset calendar dates and ages.

Everything goes through epoch micro- and milliseconds, so no result depends on
``spark.sql.session.timeZone``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.contract import BUSINESS_UTC_OFFSET, BUSINESS_UTC_OFFSET_MINUTES

# Date, optional time to the minute, second or microsecond, optional offset.
SALE_MOMENT = (
    r"^\d{4}-\d{2}-\d{2}"
    r"(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?"
    r"(?:[zZ]|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d)?)?)?\z"
)
_MICROS_PER_MINUTE = 60_000_000
_SECONDS_PER_DAY = 86_400
_MICROS_PER_DAY = _SECONDS_PER_DAY * 1_000_000


def add_sale_moment(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Add the instant (TIMESTAMP) of a stripped ISO text; without an offset it is UTC-4.

    The pattern fixes the layout, so the parts are cut by position instead of by
    one regular expression per part. One projection per step: nested in a single
    expression, the shared parts would be compiled and evaluated many times.
    """
    source, tail, sign_at = F.col(text), F.col("__tail"), F.col("__sign_at")
    seconds, offset = F.col("__seconds"), F.col("__offset")
    zulu = F.upper(F.right(tail, F.lit(1))) == "Z"
    cut = (
        # After HH:MM comes [:SS[.f]][offset].
        rows.withColumn("__tail", F.substring(source, 17, 32))
        .withColumn("__sign_at", F.greatest(F.locate("+", tail), F.locate("-", tail)))
        .withColumns(
            {
                "__seconds": F.when(sign_at > 0, F.substring(tail, F.lit(1), sign_at - 1))
                .when(zulu, F.rtrim(tail, F.lit("zZ")))
                .otherwise(tail),
                "__offset": F.when(sign_at > 0, F.substring(tail, sign_at, F.lit(6)))
                .when(zulu, F.lit("+00:00"))
                .otherwise(F.lit(BUSINESS_UTC_OFFSET)),
            }
        )
    )
    clock = F.when(F.length(source) == 10, F.lit("00:00:00")).otherwise(
        F.concat(
            F.substring(source, 12, 5), F.when(seconds == "", F.lit(":00")).otherwise(seconds)
        )
    )
    parsed = cut.withColumns(
        {
            # Read the wall clock as if it were UTC, then move by the offset.
            "__wall": F.when(
                source.rlike(SALE_MOMENT),
                F.concat(F.left(source, F.lit(10)), F.lit(" "), clock, F.lit("Z")),
            ).try_cast("timestamp"),
            "__minutes": F.substring(offset, 2, 2).try_cast("bigint") * 60
            + F.coalesce(
                F.replace(F.substring(offset, 4, 3), F.lit(":"), F.lit("")).try_cast("bigint"),
                F.lit(0),
            ),
        }
    )
    minutes = F.when(F.left(offset, F.lit(1)) == "-", -F.col("__minutes")).otherwise(
        F.col("__minutes")
    )
    instant = F.timestamp_micros(F.unix_micros("__wall") - minutes * _MICROS_PER_MINUTE)
    return parsed.withColumn(name, instant).drop(
        "__tail", "__sign_at", "__seconds", "__offset", "__wall", "__minutes"
    )


def business_date(instant: Column) -> Column:
    """Calendar date of an instant at UTC-4."""
    seconds = F.unix_seconds(instant) + BUSINESS_UTC_OFFSET_MINUTES * 60
    day = (seconds - F.pmod(seconds, F.lit(_SECONDS_PER_DAY))) / _SECONDS_PER_DAY
    return F.date_from_unix_date(day.cast("int"))


def utc_wall_clock(instant: Column) -> Column:
    """UTC wall clock of an instant as TIMESTAMP_NTZ."""
    seconds = F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def _as_number(day: Column) -> Column:
    return F.year(day) * 10_000 + F.month(day) * 100 + F.dayofmonth(day)


def age_on(day: Column, birth: Column) -> Column:
    """Completed years; a 29 February birthday is still pending on 28 February.

    As ``yyyymmdd`` numbers the difference loses a whole year exactly while the
    birthday is pending, also for dates before the birth.
    """
    years = F.floor((_as_number(day) - _as_number(birth)) / 10_000)
    return years.try_cast("smallint")


_DAY = r"^\d{4}-\d{2}-\d{2}"
_COMPACT_DAY = r"^\d{8}"
_WEEK = r"^\d{4}-?W\d{2}"
_WEEK_AND_DAY = r"^\d{4}-W\d{2}-[1-7](?![0-9])"  # before digits the hyphen belongs to the time
_DIGITS_AFTER_WEEK = r"^\d{4}W\d{2}(\d*)"
# A fraction, always of a second, may follow hours, minutes or seconds; without colons it
# may also follow the seconds without its mark, if it has two digits.
_MARKED = r"[.,]\d+"
_EXTENDED_TIME = rf":\d{{2}}(?:{_MARKED}|:\d{{2}}(?:[.,:]\d+)?)?"
_COMPACT_TIME = rf"\d{{2}}(?:{_MARKED}|\d{{2}}(?:{_MARKED}|\d{{2,}})?)?"
_TIME = rf"\d{{2}}(?:{_MARKED}|{_EXTENDED_TIME}|{_COMPACT_TIME})?\z"
_CLOCK = "^" + _TIME
# Before an offset the ISO parser passes over one ASCII character behind a whole part.
_CLOCK_AND_ONE = r"^\d{2}(?::\d{2}(?::\d{2})?|\d{2}(?:\d{2})?)?[\x00-Y\[-\x7f]\z"
_OFFSET = "^[+-]" + _TIME
_FIRST_MICROS = -62_135_596_800_000_000  # 0001-01-01T00:00:00Z
_LAST_MICROS = 253_402_300_799_999_999  # 9999-12-31T23:59:59.999999Z


def _whole(digits: Column) -> Column:
    """``HHMMSS`` of a time without colons."""
    return F.rpad(F.regexp_extract(digits, r"^\d{0,6}", 0), 6, "0")


def _fraction(digits: Column) -> Column:
    """Six digits of the fraction, with or without a mark in front."""
    return F.rpad(F.regexp_extract(digits, r"^(?:\d{0,6}[.,]|\d{6})(\d{0,6})", 1), 6, "0")


def is_whole_day(text: Column) -> Column:
    """``YYYY-MM-DD`` and nothing else."""
    return text.rlike(_DAY + r"\z")


def _with_day(rows: DataFrame) -> DataFrame:
    """Add ``__day`` (``YYYY-MM-DD`` or null) and ``__day_length`` for the start of ``__source``.

    Behind a compact week, one digit or an even number of them starts with the weekday, as
    a time has an even number of digits and one character stands before it.
    """
    source, digits, week_day = F.col("__source"), F.col("__week_digits"), F.col("__week_day")
    year, week = F.col("__week_year"), F.col("__week")
    extended, in_week = source.rlike(_DAY), source.rlike(_WEEK)
    compact_week = in_week & (F.substring(source, 5, 1) == "W")
    has_day = F.when(compact_week, (digits == 1) | ((digits > 0) & (digits % 2 == 0))).otherwise(
        source.rlike(_WEEK_AND_DAY)
    )
    bare = F.when(compact_week, F.lit(7)).otherwise(F.lit(8))
    named = F.when(compact_week, F.lit(8)).otherwise(F.lit(10))
    fourth = F.make_date(year, F.lit(1), F.lit(4))  # always in the first week
    monday = F.date_add(fourth, (week - 1) * 7 - F.weekday(fourth))
    same_year = F.year(F.date_add("__monday", 3)) == year  # a week belongs to its Thursday's year
    return (
        rows.withColumn("__week_digits", F.length(F.regexp_extract("__source", _DIGITS_AFTER_WEEK, 1)))
        .withColumns(
            {
                "__day_length": F.when(in_week, F.when(has_day, named).otherwise(bare))
                .when(extended, F.lit(10))
                .otherwise(F.lit(8)),
                "__week_year": F.when(in_week, F.left("__source", F.lit(4)).try_cast("int")),
                "__week": F.when(
                    in_week, F.replace(F.substring(source, 6, 3), F.lit("W"), F.lit(""))
                ),
                "__week_day": F.when(
                    has_day, F.substring("__source", F.when(compact_week, 8).otherwise(10), F.lit(1))
                )
                .otherwise(F.lit("1"))
                .try_cast("int"),
            }
        )
        .withColumn("__week", F.substring("__week", 1, 2).try_cast("int"))
        .withColumn("__monday", monday)
        .withColumn(
            "__day",
            F.when(
                in_week,
                F.when(
                    same_year & week_day.between(1, 7), F.date_add("__monday", week_day - 1)
                ).cast("string"),
            )
            .when(extended, F.left("__source", F.lit(10)))
            .when(
                source.rlike(_COMPACT_DAY),
                F.regexp_replace(F.left("__source", F.lit(8)), r"^(....)(..)(..)", "$1-$2-$3"),
            ),
        )
    )


def add_boundary(rows: DataFrame, text: str, upper: Column, name: str) -> DataFrame:
    """Add the instant of a stripped ISO 8601 filter boundary; without an offset it is UTC-4.

    Extended and compact calendar and week dates, any character before the time,
    any number of fraction digits (six count). Where ``upper`` holds, a whole day
    (``YYYY-MM-DD`` only) gives the following midnight.
    """
    source, rest, body = F.col("__source"), F.col("__rest"), F.col("__body")
    day_length = F.col("__day_length")
    clock, offset, digits = F.col("__clock"), F.col("__offset"), F.col("__digits")
    hms, sizes, size, wall = F.col("__hms"), F.col("__sizes"), F.col("__size"), F.col("__wall")
    cut = (
        _with_day(rows.withColumn("__source", F.regexp_replace(text, r"[zZ]\z", "+00:00")))
        .withColumn("__rest", F.substring(source, day_length + 1, F.length(source)))
        .withColumn("__body", F.substring(rest, F.lit(2), F.length(rest)))
        .withColumns(
            {
                "__clock": F.regexp_extract(body, r"^[^+-]*", 0),
                "__offset": F.regexp_extract(body, r"[+-].*\z", 0),
            }
        )
        .withColumn(
            "__clock",
            F.when(
                (offset != "") & clock.rlike(_CLOCK_AND_ONE),
                F.substring(clock, F.lit(1), F.length(clock) - 1),
            ).otherwise(clock),
        )
        .withColumns(
            {
                "__digits": F.replace(clock, F.lit(":"), F.lit("")),
                "__shift": F.replace(
                    F.substring(offset, F.lit(2), F.length(offset)), F.lit(":"), F.lit("")
                ),
            }
        )
        .withColumns(
            {
                "__hms": _whole(digits),
                "__fraction": _fraction(digits),
                "__sizes": _whole(F.col("__shift")),
            }
        )
        .withColumns(
            {
                "__wall": F.unix_micros(
                    F.concat(
                        "__day",
                        F.lit(" "),
                        F.regexp_replace(hms, r"^(..)(..)(..)", "$1:$2:$3"),
                        F.lit("."),
                        "__fraction",
                        F.lit("Z"),
                    ).try_cast("timestamp")
                ),
                "__size": (
                    F.substring(sizes, 1, 2).try_cast("bigint") * 3600
                    + F.substring(sizes, 3, 2).try_cast("bigint") * 60
                    + F.substring(sizes, 5, 2).try_cast("bigint")
                )
                * 1_000_000
                + _fraction(F.col("__shift")).try_cast("bigint"),
            }
        )
    )
    shift = F.when(offset == "", F.lit(BUSINESS_UTC_OFFSET_MINUTES * _MICROS_PER_MINUTE)).otherwise(
        F.when(F.left(offset, F.lit(1)) == "-", -size).otherwise(size)
    )
    next_day = F.when(upper & is_whole_day(F.col(text)), F.lit(_MICROS_PER_DAY)).otherwise(F.lit(0))
    layout = (rest == "") | (
        clock.rlike(_CLOCK) & ((offset == "") | (offset.rlike(_OFFSET) & (size < _MICROS_PER_DAY)))
    )
    # A day must exist by itself before the next one is taken.
    good = layout & wall.between(_FIRST_MICROS, _LAST_MICROS)
    micros = F.col("__micros")
    judged = cut.withColumn(
        "__micros", F.when(good, wall + next_day - shift)
    )
    instant = F.when(micros.between(_FIRST_MICROS, _LAST_MICROS), F.timestamp_micros(micros))
    return judged.withColumn(name, instant).select(*rows.columns, name)
