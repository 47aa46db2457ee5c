from __future__ import annotations

from datetime import UTC, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.errors import FilterError
from tallyspark.functions.moments import utc_wall_clock
from tallyspark.operators.filters import FilterSpec
from tallyspark.operators.requests import accepted_requests, validate_requests

_PERSON = "3D8594A2-3D1E-3FFC-85ED-6A94F3BAAAA9"
_VALUES = [
    *(("EDAD", v) for v in ("30", " +30 ", "-1", "121", "0", "30.0", "", "3e1", "-0", "1" * 20, None)),
    *(("EDAD", v) for v in ("٣٠", "-٠", "०७", "𝟗𝟗", "0٣", "+٣ ", "٣ ٠", "²", "+", "-", "+-1", "٠" * 20, "٠" * 18 + "1")),
    *(("GENERO", v) for v in ("No eſpecificado", "no especiﬁcado", "femenıno", "FEMENİNO")),
    *(("CANAL", v) for v in ("poſ", "ＰＯＳ")),
    *(("ID_PERSONA", v) for v in ("٣" * 32, "{+" + "a" * 31 + "}", "0x" + "B" * 30, "0X_" + "a" * 29,
                                  "a_" * 15 + "bb", "a__" + "b" * 29, "_" + "a" * 31, "{ " + "a" * 31 + "}",
                                  "0x" * 16, "g" * 32, "𝟗" * 32, "{}" + "a" * 32, "+" * 32)),
    *(("LOCAL", v) for v in ("101", "+" + "0" * 90 + "101", str(2**63 - 1), str(2**63), "0", "uno")),
    *(("CODIGO_PRODUCTO", v) for v in ("1", "-5", "9" * 19, "1_0")),
    *(("GENERO", v) for v in (" femenino", "MASCULINO", "Otro", "no especificado", "x", "")),
    *(("CANAL", v) for v in ("pos", " WEB　", "TIENDA", "")),
    *(("ID_PERSONA", v) for v in (_PERSON, "{" + _PERSON + "}", "urn:uuid:" + _PERSON,
                                  _PERSON.replace("-", ""), _PERSON[:18], "x", _PERSON + "0")),
    *(
        (name, v)
        for name in ("FECHA_DESDE", "FECHA_HASTA")
        for v in (
            "2026-01-15", " 20260115 ", "2026-01-15T09:30", "2026-01-15 09", "20260115T0930",
            "20260115T093000.5+05", "2026-01-15T09:30:00,25Z", "2026-01-15x09:30:00.1234567z",
            "2026-01-15T09:30:00+05:75", "2026-01-15T09:30:00+23:59:59", "2026-01-15T09:30-0430",
            "2026-01-15Z", "2026-01-15-05:00", "2026-01-15T09:30:00+24:00", "2026-01-15T24:00",
            "2026-01-15T0930:00", "2026-01-15T", "2026-01-15T09:30:60", "2026-02-30", "2026-1-5",
            "13/07/2026", "9999-12-31", "9999-12-30", "9999-12-31T20:00:00", "9999-12-31T19:59:59",
            "0001-01-01", "0001-01-01T00:00:00+05:00", "0000-01-01", "ayer", "", "٢٠٢٦-01-15",
            "2026-W03", "2026W03", "2026-W03-2", "2026W037", "2026-W03-8", "2026W030", "2026-W00",
            "2026-W53", "2020-W53-7", "2026-w03", "9999-W52-5", "9999-W52-6", "0001-W01", "0000-W52",
            "2026-W03T10", "2026-W03-10:30", "2026-W03-2T10", "2026-W03-2-10:30", "2026-W03-2Z",
            "2026-W03-2310:30", "2026W03210", "2026W0310", "2026W032101", "2026W03101112",
            "2026W031011121", "2026-W03210", "2026-W03-05:00", "2026W03-05:00", "2026W03z",
            "20260115T0930151234", "2026-01-15T0930151", "2026-01-15T09:30:151", "2026-01-15T093015.",
            "2026-01-15T09:30:15+05:00:00.5", "2026-01-15T09:30:15-0500001", "2026-01-15T09:30.5",
            "2026-01-15T09:30:15+23:59:59.9999999", "2026-01-15T09:30:15+05:00:00,", "2026-01-15T09.5", "20260115T0930,25+05.5",
            "20260115T09301", "2026-01-15T09:30:15:25", "2026-01-15 09:430Z", "20260115T093+05",
            "2026-01-15T09:30:+05", "2026-01-15T09:30ñZ", "2026-01-15T09:30ZZ", "20260115T103015,-0430",
            "2026-01-15T09:30:15-0500", "20260115T093015+050000123",
            "2026-W03-", "2026-W03T", "2026-W03-9:30", "2026-W03-1٣10", "2026W" + "1" * 9000,
        )
    ),
    ("DESCONOCIDO", "1"),
    ("genero", "Otro"),
]


def _by_python(name, value):
    try:
        spec = FilterSpec.from_pairs([(name, value)])
    except FilterError as problem:
        return problem.code, None, None
    found = getattr(spec, name.lower())
    if isinstance(found, datetime):
        return None, found.astimezone(UTC).replace(tzinfo=None), spec.fecha_hasta_exclusiva
    return None, str(found), None


def _by_spark(spark, pairs):
    frame = spark.createDataFrame(
        [(i, name, value) for i, (name, value) in enumerate(pairs)],
        "request_id long, consulta string, valor string",
    )
    rows = validate_requests(frame).withColumn("instante", utc_wall_clock(F.col("instante")))
    return [
        (r["error_code"], r["instante"] if r["valor_norm"] is None else r["valor_norm"], r["exclusiva"])
        if r["error_code"] is None
        else (r["error_code"], None, None)
        for r in rows.orderBy("request_id").collect()
    ]


def test_columns_agree_with_the_python_rules(spark, any_zone):
    found = _by_spark(spark, _VALUES)
    expected = [_by_python(name, value) for name, value in _VALUES]
    assert [p for p in zip(_VALUES, found, expected, strict=True) if p[1] != p[2]] == []


_DATES = st.from_regex(
    r"\A(19|20)\d\d(-(0[1-9]|1[0-3])-([0-2]\d|3[01])|(0[1-9]|1[0-2])([0-2]\d|3[01]))"
    r"([T _]([01]\d|2[0-4])(:[0-5]\d(:[0-6]\d([.,]\d{1,8})?)?)?([zZ]|[+-]([01]\d|2[0-4])(:?\d\d)?)?)?\Z"
)


_WEEKS = st.from_regex(
    r"\A(19|20)\d\d(-W[0-5]\d(-[0-8])?|W[0-5]\d[0-8]?)"
    r"([T _5-]([01]\d|2[0-4])(:?[0-5]\d(:?[0-6]\d([.,]\d{1,8})?)?)?([zZ]|[+-]([01]\d|2[0-4])(:?\d\d)?)?)?\Z"
)
_NUMBERS = st.from_regex(r"\A[ +-]?[0٠٣०७𝟗1²x]{1,22}\Z")
_PEOPLE = st.from_regex(r"\A(urn:uuid:|\{)?[+0a]?[xX_0]?[0-9A-F٣_]{30}(-?[0-9a-f]){0,2}\}?\Z")
_ANY_PAIR = st.one_of(
    st.tuples(st.sampled_from(["FECHA_DESDE", "FECHA_HASTA"]), _WEEKS),
    st.tuples(st.sampled_from(["EDAD", "LOCAL", "CODIGO_PRODUCTO"]), _NUMBERS),
    st.tuples(st.just("ID_PERSONA"), _PEOPLE),
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(_ANY_PAIR, min_size=60))
def test_random_weeks_and_digits_agree_with_the_python_rules(spark, pairs):
    found = _by_spark(spark, pairs)
    expected = [_by_python(name, value) for name, value in pairs]
    assert [p for p in zip(pairs, found, expected, strict=True) if p[1] != p[2]] == []


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["FECHA_DESDE", "FECHA_HASTA"]), _DATES), min_size=40))
def test_random_dates_agree_with_the_python_rules(spark, pairs):
    found = _by_spark(spark, pairs)
    expected = [_by_python(name, value) for name, value in pairs]
    assert [p for p in zip(pairs, found, expected, strict=True) if p[1] != p[2]] == []


def test_whole_request_rules(spark):
    pairs = [
        ("a", "CANAL", "POS"), ("a", "LOCAL", "1"),
        ("b", "CANAL", "POS"), ("b", "CANAL", "WEB"), ("b", "EDAD", "30"),
        ("c", "FECHA_DESDE", "2026-03-02"), ("c", "FECHA_HASTA", "2026-03-01"),
        ("d", "FECHA_DESDE", "2026-03-01"), ("d", "FECHA_HASTA", "2026-03-01"),
        ("e", "FECHA_DESDE", "2026-03-02T00:00:01Z"), ("e", "FECHA_HASTA", "2026-03-02T00:00:00Z"),
        ("f", "FECHA_DESDE", "2026-03-02T04:00:00Z"), ("f", "FECHA_HASTA", "2026-03-01"),
    ]
    frame = spark.createDataFrame(pairs, "request_id string, consulta string, valor string")
    validated = validate_requests(frame)
    errors = {}
    for row in validated.collect():
        errors.setdefault(row["request_id"], []).append(row["error_code"])
    assert errors.pop("a") == [None, None] and errors.pop("d") == [None, None]
    assert sorted(errors.pop("b"), key=str) == [None, "repeated_filter", "repeated_filter"]
    assert errors == {key: ["reversed_range"] * 2 for key in "cef"}
    accepted = {row["request_id"]: row for row in accepted_requests(validated).collect()}
    assert set(accepted) == {"a", "d"}
    assert (accepted["a"]["canal"], accepted["a"]["local"], accepted["a"]["edad"]) == ("POS", 1, None)
    assert accepted["d"]["fecha_hasta_exclusiva"] and not accepted["a"]["fecha_hasta_exclusiva"]


@pytest.mark.parametrize(
    ("name", "value", "kind", "code"),
    [
        ("EDAD", "30", "integer", None),
        ("EDAD", "true", "boolean", "not_integer"),
        ("EDAD", "30", "number", "not_integer"),
        ("CANAL", "1", "integer", "not_text"),
        ("ID_PERSONA", "1" * 32, "integer", "not_text"),
        ("FECHA_DESDE", "20260115", "integer", "not_iso_date"),
        ("GENERO", None, "null", "missing_value"),
    ],
)
def test_value_types(spark, name, value, kind, code):
    frame = spark.createDataFrame(
        [(1, name, value, kind)],
        "request_id int, consulta string, valor string, valor_tipo string",
    )
    assert validate_requests(frame).first()["error_code"] == code
