from __future__ import annotations

from datetime import UTC, datetime, timedelta
from pathlib import Path
from statistics import median, pstdev
from uuid import UUID

import pytest
from pyspark.sql import functions as F

from tallyspark.contract import CHANNELS
from tallyspark.errors import FilterError
from tallyspark.functions import buckets
from tallyspark.operators import batch
from tallyspark.operators.batch import (
    EQUALITY,
    WIDTHS,
    _on_axis,
    batch_statistics,
    cells_of,
    predicates_of,
    sales_in_cells,
)
from tallyspark.operators.filters import FilterSpec, parse_boundary, requests_frame
from tallyspark.operators.normalize import analytic_projection, normalize
from tallyspark.operators.statistics import finite_values, seven_statistics

from .sales_fixture import valid_rows

_PERSON = "3D8594A2-3D1E-3FFC-85ED-6A94F3BAAAA9"
_SECOND = valid_rows()[1]


def _spec(**given):
    return FilterSpec.from_pairs(list(given.items()))


def test_no_filters():
    assert FilterSpec.from_pairs([]).is_empty
    assert FilterSpec.from_pairs([]).names == []


def test_values_are_normalised_and_named_in_order():
    spec = _spec(LOCAL="101", ID_PERSONA=f" {_PERSON} ", CODIGO_PRODUCTO="+1001", CANAL=" web ",
                 EDAD=" 30 ", GENERO="  femenino ")
    assert spec == FilterSpec("Femenino", 30, "WEB", 1001, str(UUID(_PERSON)), 101)
    assert spec.names == ["GENERO", "EDAD", "CANAL", "CODIGO_PRODUCTO", "ID_PERSONA", "LOCAL"]


@pytest.mark.parametrize(
    ("name", "value", "code"),
    [
        *((name, value, "not_integer") for name in ("EDAD", "CODIGO_PRODUCTO", "LOCAL")
          for value in (False, 7.5, "7,5", "0x1F", " ", "2 3", "8" * 20, -(10**19))),
        *(("EDAD", value, "out_of_range") for value in ("-3", 300)),
        *(("CODIGO_PRODUCTO", value, "out_of_range") for value in ("-0", 9 * 10**18 + 10**18 - 1)),
        ("LOCAL", -(2**40), "out_of_range"),
        *((name, ["POS"], "not_text") for name in ("GENERO", "CANAL", "ID_PERSONA")),
        ("GENERO", "Femenina", "unknown_gender"),
        ("CANAL", "P.O.S", "unknown_channel"),
        *(("ID_PERSONA", value, "not_uuid") for value in ("", "g" + _PERSON[1:], _PERSON + "f")),
        *((name, None, "missing_value") for name in ("CANAL", "FECHA_HASTA")),
        *((name, "1", "unknown_filter") for name in ("Local", "CANAL ", "")),
        *(("FECHA_DESDE", v, "not_iso_date") for v in (2.5, "2025-W60-1", "mañana", "2023-02-29", "3-4-2025")),
        ("FECHA_HASTA", "9999-12-31", "not_iso_date"),
    ],
)
def test_bad_values_are_refused(name, value, code):
    with pytest.raises(FilterError) as problem:
        FilterSpec.from_pairs([(name, value)])
    assert problem.value.code == code


def test_repeated_filter_is_refused():
    with pytest.raises(FilterError) as problem:
        FilterSpec.from_pairs([("LOCAL", 101), ("LOCAL", 102)])
    assert problem.value.code == "repeated_filter"


@pytest.mark.parametrize(
    ("value", "number"), [("0" * 6000 + "42", 42), (2**62 + 1, 2**62 + 1), ("\t+9\n", 9)]
)
def test_good_integers(value, number):
    assert _spec(LOCAL=value).local == number


@pytest.mark.parametrize(
    "value", ["{" + _PERSON + "}", "urn:uuid:" + _PERSON, _PERSON.replace("-", ""), _PERSON.lower()]
)
def test_every_uuid_spelling(value):
    assert _spec(ID_PERSONA=value).id_persona == _PERSON.lower()


@pytest.mark.parametrize("channel", CHANNELS)
def test_every_channel(channel):
    assert _spec(CANAL=f"\n{channel.swapcase()}\t").canal == channel


@pytest.mark.parametrize(
    ("raw", "upper", "instant", "exclusive"),
    [
        ("2026-01-15", False, datetime(2026, 1, 15, 4), False),
        ("2026-07-13", True, datetime(2026, 7, 14, 4), True),
        ("20260115", True, datetime(2026, 1, 15, 4), False),
        ("2026-01-15T09:30:00", False, datetime(2026, 1, 15, 13, 30), False),
        ("2026-01-15T09:30:00z", True, datetime(2026, 1, 15, 9, 30), False),
        ("2026-01-15T09:30:00-05:00", True, datetime(2026, 1, 15, 14, 30), False),
        ("2026-01-15T09:30:00+03:00", True, datetime(2026, 1, 15, 6, 30), False),
        (" 2026-01-15 ", False, datetime(2026, 1, 15, 4), False),
    ],
)
def test_boundaries(raw, upper, instant, exclusive):
    found = parse_boundary("F", raw, upper=upper)
    assert (found.instant, found.exclusive) == (instant.replace(tzinfo=UTC), exclusive)


@pytest.mark.parametrize(
    ("start", "end", "good"),
    [
        ("2026-01-15", "2026-01-15", True),
        ("2026-01-15T09:00:00-03:00", "2026-01-15T12:00:00Z", True),
        ("2026-03-02", "2026-03-01", False),
        ("2026-03-02T01:00:00-03:00", "2026-03-01", False),
        ("2026-03-02T00:00:01Z", "2026-03-02T00:00:00Z", False),
    ],
)
def test_range_order(start, end, good):
    if good:
        assert _spec(FECHA_DESDE=start, FECHA_HASTA=end).names == ["FECHA_DESDE", "FECHA_HASTA"]
    else:
        with pytest.raises(FilterError) as problem:
            _spec(FECHA_DESDE=start, FECHA_HASTA=end)
        assert problem.value.code == "reversed_range"


@pytest.fixture(scope="module")
def sales(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sales") / "t")
    raw = spark.createDataFrame([tuple(row.values()) for row in valid_rows()], list(valid_rows()[0]))
    analytic_projection(normalize(raw)).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


# Filters -> amounts of the matching fixture rows, smallest first.
_CASES = {
    "gender": ({"GENERO": " femenino "}, (1625.25, 14190.5, 15192.0, 18990.0)),
    "other": ({"GENERO": " otro "}, (-3250.75, 9933.25)),
    "age": ({"EDAD": "30"}, (9933.25,)),
    "age as number": ({"EDAD": 22}, (3250.75, 14190.5, 15192.0)),
    "channel": ({"CANAL": " app "}, (15192.0, 44200.0)),
    "product": ({"CODIGO_PRODUCTO": "325"}, (7115.5, 7490.0, 7490.0)),
    "person": ({"ID_PERSONA": _SECOND["CODIGO CLIENTE"].upper()}, (7490.0, 7490.0)),
    "shop": ({"LOCAL": "15"}, (-3250.75, 3250.75, 14190.5)),
    "range": (
        {"FECHA_DESDE": "2023-02-14", "FECHA_HASTA": "2023-04-09"},
        (3250.75, 7115.5, 15192.0),
    ),
    "from": ({"FECHA_DESDE": "2023-12-31"}, (14190.5,)),
    "until": ({"FECHA_HASTA": "2023-01-03"}, (7490.0, 18990.0)),
    "exact instant": (
        {"FECHA_DESDE": "2023-01-03T12:12:30Z", "FECHA_HASTA": "2023-01-03T08:12:30"},
        (18990.0,),
    ),
    "and": ({"GENERO": "Masculino", "CANAL": "POS", "LOCAL": "12"}, (7490.0,)),
    "all eight": (
        {
            "GENERO": "MASCULINO",
            "EDAD": "51",
            "CANAL": "pos",
            "CODIGO_PRODUCTO": 325,
            "ID_PERSONA": _SECOND["CODIGO CLIENTE"].upper(),
            "LOCAL": _SECOND["LOCAL"],
            "FECHA_DESDE": "2023-01-03",
            "FECHA_HASTA": "2023-01-04",
        },
        (7490.0,),
    ),
    "nothing": ({"GENERO": "Femenino", "CANAL": "POS"}, ()),
    "no filter": ({}, tuple(sorted(float(row["MONTO APLICADO"]) for row in valid_rows()))),
}


def _amounts(spec, sales):
    return tuple(sorted(row[0] for row in spec.apply(sales).select("monto_aplicado").collect()))


@pytest.mark.parametrize("case", [c for c in _CASES if c != "no filter"])
def test_filters_select_the_expected_rows(sales, case, any_zone):
    given, amounts = _CASES[case]
    assert _amounts(_spec(**given), sales) == amounts


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ({"LOCAL": "15"}, (14190.5, 3, 4730.166666666667, -3250.75, 14190.5, 3250.75, 7196.795844718367)),
        ({"CANAL": "POS"}, (11729.25, 3, 3909.75, -3250.75, 7490.0, 7490.0, 5063.238106686274)),
    ],
)
def test_known_statistics(sales, given, expected):
    assert tuple(seven_statistics(_spec(**given).apply(sales)).first()) == pytest.approx(expected)


def test_filters_reach_the_parquet_scan(sales):
    spec = _spec(CANAL="POS", LOCAL=101, FECHA_HASTA="2026-06-30")
    frame = spec.apply(sales).select("monto_aplicado")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    for part in ("EqualTo(canal,POS)", "EqualTo(local,101)", "LessThan(fecha,"):
        assert part in pushed
    assert "sku" not in pushed[pushed.index("ReadSchema") :]


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_batch_equals_one_request_at_a_time(spark, sales, broadcast_bytes):
    specs = {name: _spec(**given) for name, (given, _) in _CASES.items()}
    found = batch_statistics(sales, requests_frame(spark, specs), broadcast_bytes=broadcast_bytes)
    rows = {row["request_id"]: row for row in found.collect()}
    assert set(rows) == set(_CASES)
    for name, (_, amounts) in _CASES.items():
        row = rows[name]
        assert (row["conteo"], row["suma"], row["no_finita"]) == (len(amounts), sum(amounts), False)
        middle = sorted(amounts)
        expected = (middle[(len(amounts) - 1) // 2] + middle[len(amounts) // 2]) / 2 if amounts else None
        assert row["mediana"] == expected


def _placed(sales, requests, small=True):
    """The rows that the first pass joins, and the cells of the requests."""
    cells = cells_of(predicates_of(requests).drop("request_id").dropDuplicates(["__predicate"]))
    shapes = [row[0] for row in cells.select("__shape").distinct().collect()]
    values = finite_values(sales, "monto_aplicado", ["fecha", *EQUALITY.values()]).withColumn(
        "__time", _on_axis(F.unix_micros("fecha"))
    )
    wanted = cells.select("__key", "__width_of", "__cell").distinct()
    return sales_in_cells(values, cells, wanted, shapes, small=small)


@pytest.fixture(scope="module")
def many_sales(spark):
    """3,000 sales, seven hours and one microsecond apart, one without time, in two channels."""
    n = F.col("id")
    moment = F.timestamp_micros(F.lit(1_700_000_000_000_000) + n * 25_200_000_001)
    return spark.range(3000).select(
        F.when(n != 1500, moment).alias("fecha"),
        F.when(n % 2 == 0, "POS").otherwise("WEB").alias("canal"),
        n.alias("sku"),
        ((n * 7919) % 3001 / 8.0).alias("monto_aplicado"),
        n.alias("local"),
        F.lit("x").alias("codigo_cliente"),
        F.lit("Otro").alias("genero_texto"),
        F.lit(30).cast("short").alias("edad_en_transaccion"),
    )


def _ranges(count):
    """Overlapping ranges, exclusive and inclusive, with ends at odd microseconds."""
    first = datetime(2023, 11, 14, tzinfo=UTC)
    for n in range(count):
        start = first + timedelta(days=n % 97, microseconds=n % 7)
        end = start + timedelta(days=n % 301 + 1, seconds=n)
        yield str(n), FilterSpec(
            fecha_desde=None if n % 11 == 0 else start,
            fecha_hasta=None if n % 13 == 1 else end,
            fecha_hasta_exclusiva=n % 2 == 0,
        )


def test_joined_rows_do_not_grow_with_the_requests(spark, many_sales):
    few, many = (
        _placed(many_sales, requests_frame(spark, dict(_ranges(n)))).count() for n in (100, 1600)
    )
    # One shape of requests: a sale is counted in one leaf, whatever the widths in use.
    assert few <= many <= many_sales.count()
    same = {str(n): FilterSpec(canal="POS") for n in range(1600)}
    assert _placed(many_sales, requests_frame(spark, same)).count() == 1500


def test_batch_of_time_ranges_equals_plain_filters(spark, many_sales):
    specs = dict(_ranges(60)) | {
        "empty": FilterSpec(
            fecha_desde=datetime(2024, 1, 1, tzinfo=UTC),
            fecha_hasta=datetime(2024, 1, 1, tzinfo=UTC),
            fecha_hasta_exclusiva=True,
        )
    }
    rows = {
        row["request_id"]: row
        for row in batch_statistics(many_sales, requests_frame(spark, specs)).collect()
    }
    sold = [
        (row["fecha"].replace(tzinfo=UTC), row["monto_aplicado"])
        for row in many_sales.where("fecha is not null").collect()
    ]
    for name, spec in specs.items():
        amounts = [
            amount
            for at, amount in sold
            if (spec.fecha_desde is None or at >= spec.fecha_desde)
            and (
                spec.fecha_hasta is None
                or at < spec.fecha_hasta
                or (at == spec.fecha_hasta and not spec.fecha_hasta_exclusiva)
            )
        ]
        assert (rows[name]["conteo"], rows[name]["suma"]) == (len(amounts), sum(amounts)), name
        if amounts:
            assert rows[name]["mediana"] == median(amounts)
            assert rows[name]["desviacion_estandar"] == pytest.approx(pstdev(amounts))


def test_batch_median_is_exact_with_many_passes(spark, many_sales, monkeypatch):
    """With tiny limits a few thousand values need all steps."""
    monkeypatch.setattr(buckets, "EXACT_LIMIT", 4)
    monkeypatch.setattr(buckets, "LINEAR_STEPS", 4)
    signed = many_sales.withColumn("monto_aplicado", F.col("monto_aplicado") - 150.0)
    specs = {"all": FilterSpec(), "pos": FilterSpec(canal="POS"), "one": FilterSpec(local=7)}
    rows = {
        row["request_id"]: row["mediana"]
        for row in batch_statistics(signed, requests_frame(spark, specs)).collect()
    }
    for name, test in (("all", "true"), ("pos", "canal = 'POS'"), ("one", "local = 7")):
        assert rows[name] == median(r[0] for r in signed.where(test).select("monto_aplicado").collect())


def test_long_texts_are_measured_before_a_broadcast(spark, sales):
    long_person = requests_frame(spark, {"a": FilterSpec(id_persona="x" * 5000), "b": FilterSpec()})
    frames = []
    original = batch.sales_in_cells

    def seen(*given, **named):
        frames.append(named["small"])
        return original(*given, **named)

    batch.sales_in_cells = seen
    try:
        rows = batch_statistics(sales, long_person, broadcast_bytes=5000).collect()
    finally:
        batch.sales_in_cells = original
    assert {row["request_id"]: row["conteo"] for row in rows} == {"a": 0, "b": 12}
    assert frames and not any(frames)


def test_batch_needs_unique_requests(spark, sales):
    requests = requests_frame(spark, {"a": FilterSpec(canal="POS")})
    with pytest.raises(FilterError):
        batch_statistics(sales, requests.unionByName(requests))


def test_batch_flags_overflow_per_request(spark, sales):
    huge = sales.withColumn("monto_aplicado", F.when(F.col("canal") == "POS", 1e308).otherwise(1.0))
    specs = {"bad": FilterSpec(canal="POS"), "good": FilterSpec(canal="WEB")}
    rows = batch_statistics(huge, requests_frame(spark, specs)).collect()
    assert {row["request_id"]: row["no_finita"] for row in rows} == {"bad": True, "good": False}


def test_one_shop_with_a_third_of_all_rows_is_split(spark):
    """Without a broadcast the hot key's rows go to several tasks, and none is lost."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1MB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1MB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    n = F.col("id")
    sales = spark.range(0, 600_000, 1, 8).select(
        F.timestamp_seconds(n).alias("fecha"),
        F.lit("POS").alias("canal"),
        n.alias("sku"),
        (n * 7 % 100_003 / 100.0).alias("monto_aplicado"),
        F.when(n % 3 == 0, F.lit(1)).otherwise(n % 5000 + 2).cast("long").alias("local"),
        F.lit("x").alias("codigo_cliente"),
        F.lit("Otro").alias("genero_texto"),
        F.lit(30).cast("short").alias("edad_en_transaccion"),
    )
    requests = requests_frame(spark, {str(k): FilterSpec(local=k) for k in range(1, 200)})
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        found = batch_statistics(sales, requests, broadcast_bytes=0)
        rows = {row["request_id"]: row for row in found.collect()}
        placed = _placed(sales, requests, small=False)
        placed.collect()
        final = placed._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert "skew=true" in final
    expected = sales.where("local = 1").agg(F.count("*"), F.median("monto_aplicado")).first()
    assert (rows["1"]["conteo"], rows["1"]["mediana"]) == tuple(expected) == (200_000, 499.995)
    assert sum(row["conteo"] for row in rows.values()) == sales.where("local < 200").count()


def _disk_files(spark):
    """Shuffle files that Spark holds, and files in the shared folder."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held, shuffles = blocks.getAllFiles().iterator(), set()
    while held.hasNext():
        if (name := held.next().getName()).startswith("shuffle_"):
            shuffles.add(name)
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    return shuffles, {path for path in shared.rglob("*") if path.is_file()}


def test_a_large_batch_is_answered_in_slices_and_leaves_its_result_only(
    spark, many_sales, monkeypatch
):
    """Shapes with many keys, with and without times, null keys among the sales."""
    monkeypatch.setattr(batch, "SLICE_BYTES", 100_000)
    sales = many_sales.withColumn("local", F.when(F.col("sku") % 11 != 0, F.col("sku") % 40))
    start = datetime(2024, 6, 1, tzinfo=UTC)
    tests = {f"s{n}": (FilterSpec(local=n), f"local = {n}") for n in range(42)}
    tests |= {
        f"t{n}": (
            FilterSpec(local=n, canal="POS", fecha_desde=start),
            f"local = {n} and canal = 'POS' and fecha >= timestamp '2024-06-01 00:00:00Z'",
        )
        for n in range(40)
    }
    tests |= {"all": (FilterSpec(), "true"), "pos": (FilterSpec(canal="POS"), "canal = 'POS'")}
    parts, original = [], batch._answered

    def seen(values, requested, part, tables):
        parts.append(part)
        return original(values, requested, part, tables)

    monkeypatch.setattr(batch, "_answered", seen)
    requests = requests_frame(spark, {name: spec for name, (spec, _) in tests.items()}).localCheckpoint()
    before = _disk_files(spark)
    found = batch_statistics(sales, requests, broadcast_bytes=5_000)
    after = _disk_files(spark)
    assert not after[0] - before[0]  # no shuffle file waits for the garbage collector
    assert {path.parent.name.split("-")[0] for path in after[1] - before[1]} == {"answers"}
    assert [part.slices for part in parts] == [1, 1, 2, 2] and not parts[0].once
    rows = {row["request_id"]: row for row in found.collect()}
    assert set(rows) == set(tests)
    sold = sales.select("monto_aplicado", *(F.expr(test).alias(n) for n, (_, test) in tests.items()))
    sold = sold.collect()
    for name in tests:
        amounts = [row["monto_aplicado"] for row in sold if row[name]]
        assert (rows[name]["conteo"], rows[name]["suma"]) == (len(amounts), sum(amounts)), name
        assert rows[name]["mediana"] == (median(amounts) if amounts else None), name
        if amounts:
            assert rows[name]["desviacion_estandar"] == pytest.approx(pstdev(amounts))
