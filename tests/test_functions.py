from __future__ import annotations

import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.fingerprint import fingerprint, fingerprint_text
from tallyspark.functions.moments import add_sale_moment, age_on, business_date, utc_wall_clock
from tallyspark.functions.privacy import redact
from tallyspark.functions.text import null_if_token, strip, to_date, to_double, to_long


def _texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")


def _values(frame, column):
    return [row["out"] for row in frame.select("i", column.alias("out")).orderBy("i").collect()]


def test_strip_knows_unicode_white_space(spark):
    frame = _texts(spark, ["  a b\t\n", " 　x ", "", None, "   "])
    assert _values(frame, strip(F.col("s"))) == ["a b", "x", "", None, ""]


def test_null_tokens_are_exact(spark):
    frame = _texts(spark, ["", "NULL", "null", "Null", " NULL", "x", None])
    found = _values(frame, null_if_token(F.col("s"), ("", "NULL", "null")))
    assert found == [None, None, None, "Null", " NULL", "x", None]


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("5", 5),
        ("+5", 5),
        ("-5", -5),
        ("007", 7),
        ("1.0", None),
        ("1e3", None),
        ("\x015", None),
        ("5\n", None),
        ("٣", None),
        ("9223372036854775807", 2**63 - 1),
        ("9223372036854775808", None),
        ("", None),
        (None, None),
    ],
)
def test_to_long(spark, text, value):
    assert _values(_texts(spark, [text]), to_long(F.col("s"))) == [value]


def test_to_double(spark):
    texts = ["1", "1.", ".5", "-1.5e2", "+2E-1", "1d", "1f", "0x1p3", "NaN", "inf", "1e999", "", "."]
    found = _values(_texts(spark, texts), to_double(F.col("s")))
    assert found == [1.0, 1.0, 0.5, -150.0, 0.2, None, None, None, None, None, float("inf"), None, None]


def test_to_date(spark):
    texts = ["1990-01-05", "1990-1-5", "1990-02-30", "1992-02-29", "1990", "1990-01-05T00", None]
    found = _values(_texts(spark, texts), to_date(F.col("s")))
    assert found == [date(1990, 1, 5), None, None, date(1992, 2, 29), None, None, None]


_MOMENTS = {
    "2026-05-08T00:02:53Z": datetime(2026, 5, 8, 0, 2, 53),
    "2026-05-08 00:02:53+03:00": datetime(2026, 5, 7, 21, 2, 53),
    "2026-05-08T00:02:53+03": datetime(2026, 5, 7, 21, 2, 53),
    "2026-05-08T00:02:53-0430": datetime(2026, 5, 8, 4, 32, 53),
    "2026-05-08": datetime(2026, 5, 8, 4),
    "2026-01-15T09:00:00": datetime(2026, 1, 15, 13),
    "2026-01-15T09:00": datetime(2026, 1, 15, 13),
    "2026-01-15 09:00z": datetime(2026, 1, 15, 9),
    "2026-01-15T09:00:01.25z": datetime(2026, 1, 15, 9, 0, 1, 250000),
    "2026-04-05T00:30:00": datetime(2026, 4, 5, 4, 30),  # summer time ends in Chile
    "2026-04-05 03:30Z": datetime(2026, 4, 5, 3, 30),
    "1960-02-29T23:59:59.999999": datetime(1960, 3, 1, 3, 59, 59, 999999),
    "2026": None,
    "2026-05": None,
    "2026-5-8": None,
    "12:30": None,
    "2026-05-08Z": None,
    "2026-05-08T24:00": None,
    "2026-05-08T10:00+24:00": None,
    "2026-05-08T10:00+01:60": None,
    "2026-05-08T10:00 Europe/Paris": None,
    "2026-02-30T10:00": None,
    "08/05/2026": None,
    "fecha-invalida": None,
    "": None,
}


def test_sale_moments_do_not_depend_on_the_session_zone(spark, any_zone):
    frame = add_sale_moment(_texts(spark, list(_MOMENTS)), "s", "moment")
    found = _values(frame, utc_wall_clock(F.col("moment")))
    assert dict(zip(_MOMENTS, found, strict=True)) == _MOMENTS


@pytest.mark.parametrize(
    ("sold", "born", "age"),
    [
        ("2025-02-28", "2000-02-29", 24),
        ("2025-03-01", "2000-02-29", 25),
        ("2024-02-29", "2000-02-29", 24),
        ("2026-01-15T00:30:00Z", "2000-01-15", 25),  # still 14 January at UTC-4
        ("2026-01-15T04:00:00Z", "2000-01-15", 26),
        ("2026-01-15", "2026-01-15", 0),
        ("2025-06-01", "2025-12-31", -1),
        ("2024-01-01", "2025-01-01", -1),
        ("2026-01-15", "1860-02-29", 165),
    ],
)
def test_age_counts_completed_years_at_the_local_sale_date(spark, sold, born, age):
    frame = add_sale_moment(_texts(spark, [sold]), "s", "moment")
    found = _values(frame, age_on(business_date(F.col("moment")), F.lit(born).cast("date")))
    assert found == [age]


_PERSON = "11111111-1111-4111-8111-111111111111"


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (f"valores {_PERSON} y 12.345.678-K", "valores [UUID_REDACTADO] y [RUN_REDACTADO]"),
        (f"{_PERSON.upper()},1.234.567-9", "[UUID_REDACTADO],[RUN_REDACTADO]"),
        (f"x{_PERSON} é12.345.678-k 12.345.678-kñ", None),
        ("12345678-9 112.345.67-1 1234.567.890-1", None),
        (f"{_PERSON}-{_PERSON}", "[UUID_REDACTADO]-[UUID_REDACTADO]"),
        (None, None),
    ],
)
def test_redaction(spark, text, expected):
    expected = text if expected is None else expected
    assert _values(_texts(spark, [text]), redact(F.col("s"))) == [expected]
    if text is not None:  # the same rule in another regular expression engine
        person = re.sub(r"(?i)\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b", "[UUID_REDACTADO]", text)
        assert re.sub(r"\b\d{1,3}\.\d{3}\.\d{3}-[\dkK]\b", "[RUN_REDACTADO]", person) == expected


def test_fingerprint_sees_content_but_not_order(spark):
    def mark(rows):
        return fingerprint_text(fingerprint(spark.createDataFrame(rows, "a string, b string")).first())

    rows = [("1", None), ("2", "x"), (None, "1"), ("2", "x")]
    assert mark(rows) == mark(rows[::-1])
    others = ([("1", ""), *rows[1:]], [(None, "1"), *rows[1:]], rows[:3], [*rows, rows[1], rows[1]],
              [("1x", None), ("2", ""), (None, "1"), ("2", "x")])
    assert len({mark(rows), *map(mark, others)}) == 1 + len(others)
    assert fingerprint_text(fingerprint(spark.createDataFrame([], "a string")).first()) == "0-0-0"
