"""Many filter requests answered together, without comparing sales with requests.

Each request sets some of six equality filters and an optional time range. Equal requests
are one *predicate*. The equality values are its *key*; the time range is cut into *cells*,
aligned pieces of fixed widths, so that every moment lies in one cell per width and a range
of any length takes few of them. A sale finds the keys it has by a hash join (one row per
set of filters in use) and then its *leaf*, the narrowest asked-for cell, or part of one, that
holds it. Sales are counted once, per leaf and value bucket; counts of leaves are added up to
the wider cells around them, and those per predicate. So no sale is copied per width, and
what is joined does not grow with the number of requests.

Keys and cells too large for a broadcast are met by shuffled sales. Then one shape of requests
is answered after the other, and a large one in slices of its keys: only the columns of that
shape are shuffled, once for all passes, and the shuffle and table files of a slice are
deleted before the next one.

The exact median narrows as for a single request, but with buckets that are the same for
all, so predicates that share cells and buckets share the counts as well, and in finer
steps (doublings, sixteenths of them, linear), so a cell has few buckets in every pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tallyspark.contract import (
    BUSINESS_UTC_OFFSET_MINUTES,
    REQUEST_SCHEMA,
    STATISTIC_COLUMNS,
    TARGET_COLUMN,
)
from tallyspark.errors import FilterError
from tallyspark.functions.buckets import add_path, doubling_bucket, path_columns
from tallyspark.functions.lineage import Tables, new_folder, written
from tallyspark.functions.text import is_finite
from tallyspark.operators.statistics import (
    BAND,
    MEDIAN,
    RANKS,
    finite_values,
    next_band,
)

REQUEST_ID = "request_id"
BROADCAST_BYTES = 32 << 20  # of keys and cells; larger ones use shuffle joins
SLICE_BYTES = 1 << 30  # of sales that are shuffled for a join at once
_MOST_SLICES = 8  # each reads the sales, so there are few however large they are

EQUALITY = {  # request column -> sales column
    "genero": "genero_texto",
    "edad": "edad_en_transaccion",
    "canal": "canal",
    "codigo_producto": "sku",
    "id_persona": "codigo_cliente",
    "local": "local",
}
_BIT = {name: 1 << position for position, name in enumerate(EQUALITY)}

_DAY = 86_400_000_000
# Each width divides the next; days begin at UTC-4, like the days of requests.
WIDTHS = (1, 100, 10_000, 1_000_000, 60_000_000, 3_600_000_000, *(_DAY * 8**k for k in range(9)))
_END_OF_TIME = 3 * WIDTHS[-1]  # 137,000 years
_CELL_BYTES = 200  # a cell: a 32-character key, numbers, row overhead
_KEY_BYTES = 500  # a key without its texts
_CELL = ("__key", "__width_of", "__cell")
_STEPS = 32  # linear steps of a bucket; a cell is asked for few buckets in every pass
_FEW_ROWS = 128  # a predicate's band of fewer rows is ranked value by value
_CELLS = "array<struct<width:bigint,at:bigint>>"
_PREDICATE = "__predicate"
_TYPES = {field.name: field.dataType.simpleString() for field in REQUEST_SCHEMA.fields}
_TEXTS = [name for name, kind in _TYPES.items() if kind == "string"]


@dataclass(frozen=True)
class _Part:
    """Requests that are answered together: of some shapes, or a slice of the keys of one.

    ``small``: keys and cells are broadcast. ``many_keys`` and ``many_cells`` say that keys, or
    cells per predicate, are too large for it, which Spark could not tell from the size of
    compressed files.
    """

    shapes: tuple[int, ...]
    timed: bool
    small: bool = False
    many_keys: bool = False
    many_cells: bool = False
    broadcast_bytes: int = BROADCAST_BYTES
    once: bool = False  # sales are placed once for all passes
    slice: int = 0
    slices: int = 1

    def of_requests(self, rows: DataFrame) -> DataFrame:
        own = rows.where(F.col("__shape").isin(*self.shapes))
        return self._slice(own, {name: name for name in EQUALITY})

    def of_sales(self, values: DataFrame) -> DataFrame:
        return self._slice(values, EQUALITY)

    def _slice(self, rows: DataFrame, named: dict[str, str]) -> DataFrame:
        if self.slices == 1:
            return rows
        texts = (
            F.col(named[name]).try_cast(_TYPES[name]).cast("string") for name in _used(self.shapes)
        )
        return rows.where(F.pmod(F.xxhash64(*texts), F.lit(self.slices)) == self.slice)


def _used(shapes: Sequence[int]) -> list[str]:
    return [name for name, bit in _BIT.items() if any(bit & shape for shape in shapes)]


def _sized(frame: DataFrame, many: bool, small: bool = False) -> DataFrame:
    """One side of a join, which is broadcast if small, and never if there are many rows."""
    if small:
        return F.broadcast(frame)
    return frame.hint("merge") if many else frame


def _shape() -> Column:
    bits = (
        F.when(F.col(name).isNotNull(), F.lit(bit)).otherwise(F.lit(0))
        for name, bit in _BIT.items()
    )
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _on_axis(micros: Column) -> Column:
    moved = micros + BUSINESS_UTC_OFFSET_MINUTES * 60_000_000
    inside = F.greatest(F.lit(-_END_OF_TIME), F.least(moved, F.lit(_END_OF_TIME - 1)))
    return F.when(micros.isNotNull(), inside)


def _digest(*names: str) -> Column:
    return F.md5(F.to_json(F.struct(*names)).cast("binary"))


def _cells(start: Column, end: Column) -> Column:
    """The fewest aligned cells that make up ``[start, end)``, as (width, first microsecond)."""

    def up(width: Column) -> Column:
        return start + F.pmod(-start, width)

    def down(width: Column) -> Column:
        return end - F.pmod(end, width)

    def run(first: Column, stop: Column, width: Column) -> Column:
        starts = F.sequence(first, stop - width, width)
        cells = F.transform(starts, lambda at: F.struct(width.alias("width"), at.alias("at")))
        return F.when(first < stop, cells).otherwise(F.array().cast(_CELLS))

    def of_width(pair: Column) -> Column:
        width, wider = pair["width"], pair["wider"]
        # Whatever wider cells can take is left to them.
        inner = up(wider) < down(wider)
        return F.concat(
            run(up(width), F.when(inner, up(wider)).otherwise(down(width)), width),
            run(F.when(inner, down(wider)).otherwise(down(width)), down(width), width),
        )

    pairs = ",".join(
        f"struct({width}L AS width, {wider}L AS wider)"
        for width, wider in zip(WIDTHS, (*WIDTHS[1:], 1 << 62), strict=True)
    )
    return F.flatten(F.transform(F.expr(f"array({pairs})"), of_width))


def predicates_of(requests: DataFrame) -> DataFrame:
    """Typed requests with predicate, key, shape and time range on the axis (null = always)."""
    timed = F.col("fecha_desde").isNotNull() | F.col("fecha_hasta").isNotNull()
    after_end = F.when(F.col("fecha_hasta_exclusiva"), F.lit(0)).otherwise(F.lit(1))
    start = F.coalesce(_on_axis(F.unix_micros("fecha_desde")), F.lit(-_END_OF_TIME))
    end = F.coalesce(_on_axis(F.unix_micros("fecha_hasta")) + after_end, F.lit(_END_OF_TIME))
    return (
        requests.select(
            REQUEST_ID,
            *(F.col(f.name).cast(f.dataType).alias(f.name) for f in REQUEST_SCHEMA.fields),
        )
        .select(
            REQUEST_ID,
            *EQUALITY,
            _shape().alias("__shape"),
            F.when(timed, start).alias("__start"),
            F.when(timed, end).alias("__end"),
            F.col("fecha_desde").isNotNull().alias("__has_start"),
            F.col("fecha_hasta").isNotNull().alias("__has_end"),
        )
        .withColumn("__key", _digest(*EQUALITY))
        .withColumn(_PREDICATE, _digest("__key", "__start", "__end"))
    )


def cells_of(predicates: DataFrame) -> DataFrame:
    """A row per predicate and cell. Without a time range the one cell has width 0."""
    always = F.expr("array(struct(0L AS width, 0L AS at))")
    cells = F.when(F.col("__start").isNull(), always).otherwise(
        _cells(F.col("__start"), F.col("__end"))
    )
    return (
        predicates.withColumn("__c", F.explode(cells))
        .withColumns({"__width_of": F.col("__c.width"), "__cell": F.col("__c.at")})
        .drop("__c", "__start", "__end")
    )


def _widths(cells: DataFrame) -> list[int]:
    """The widths in use, 0 (always) left out: at most ``len(WIDTHS)`` numbers."""
    found = cells.select("__width_of").distinct().collect()
    return sorted(row["__width_of"] for row in found if row["__width_of"])


def cells_around(cells: DataFrame) -> tuple[list[int], DataFrame]:
    """The widths in use, narrow ones first, and the cells that are, or hold, one of ``cells``."""
    widths = _widths(cells)
    wider = F.filter(
        F.array(*(F.lit(one).cast("bigint") for one in widths)) if widths else F.lit(None).cast("array<bigint>"),
        lambda one: one >= F.col("__width_of"),
    )
    found = (
        cells.where("__width_of > 0")
        .select("__key", "__cell", F.explode(wider).alias("__width_of"))
        .withColumn("__cell", _start_of_cell(F.col("__cell"), F.col("__width_of")))
        .distinct()
    )
    return widths, found


def _start_of_cell(time: Column, width: Column | int) -> Column:
    return time - F.pmod(time, F.lit(width) if isinstance(width, int) else width)


def sales_in_cells(
    values: DataFrame,
    cells: DataFrame,
    wanted: DataFrame,
    shapes: Sequence[int],
    *,
    around: tuple[Sequence[int], DataFrame] | None = None,
    depth: int = 0,
    small: bool = False,
    many_keys: bool = False,
    many_cells: bool = False,
) -> DataFrame:
    """``__value`` with its leaf: the narrowest part of the wanted cells that it lies in.

    ``cells`` has rows of ``cells_of``; ``wanted`` has distinct cells and, if ``depth`` is
    given, the path of the value buckets that are asked for in each; ``around`` is
    ``cells_around`` of the wanted cells, or of more. A leaf is a wanted cell or one around
    it. A sale gives at most one row per shape (and kind of look, steps or exact), however
    many requests and widths.
    """
    widths, holding = cells_around(wanted) if around is None else around
    used = _used(shapes)
    keys = cells.groupBy("__key", "__shape", *used).agg(
        F.bool_or(F.col("__width_of") == 0).alias("__always")
    )
    if used and len(shapes) == 1:
        # All its requests set all the columns, so a sale without one of them meets none.
        sale = values.select(
            "__value", "__time", *(F.col(EQUALITY[name]).alias(f"__sale_{name}") for name in used)
        )
        same = reduce(and_, (F.col(f"__sale_{name}") == F.col(name) for name in used))
    else:
        sale = values.withColumn(
            "__sale_shape", F.explode(F.array(*map(F.lit, shapes))) if shapes else F.lit(0)
        ).select(
            "__value",
            "__time",
            "__sale_shape",
            *(
                F.when(
                    F.col("__sale_shape").bitwiseAND(_BIT[name]) != 0, F.col(EQUALITY[name])
                ).alias(f"__sale_{name}")
                for name in used
            ),
        )
        same = reduce(
            and_,
            (F.col(f"__sale_{name}").eqNullSafe(F.col(name)) for name in used),
            F.col("__sale_shape") == F.col("__shape"),
        )
    placed = sale.join(_sized(keys, many_keys, small), same).select(
        "__value", "__time", "__key", "__always"
    )
    if depth:
        placed = _asked_for(placed, wanted, depth, many_keys, small)
    leaf = F.when(F.col("__always"), F.lit(0).cast("bigint"))
    for width in reversed(widths):
        at, hit = f"__at_{width}", f"__hit_{width}"
        found = holding.where(F.col("__width_of") == width).select(
            "__key", F.col("__cell").alias(at), F.lit(True).alias(hit)
        )
        placed = placed.withColumn(at, _start_of_cell(F.col("__time"), width)).join(
            _sized(found, many_cells, small), ["__key", at], "left"
        )
        leaf = F.when(F.col(hit), F.lit(width)).otherwise(leaf)
    width = F.col("__width_of")
    start = _start_of_cell(F.col("__time"), F.when(width > 0, width))
    return (
        placed.withColumn("__width_of", leaf)
        .where(width.isNotNull())
        .withColumn("__cell", F.when(width == 0, F.lit(0)).otherwise(start))
        .drop("__always", *(f"__{name}_{one}" for one in widths for name in ("at", "hit")))
    )


def _asked_for(
    rows: DataFrame, wanted: DataFrame, depth: int, many: bool, small: bool = False
) -> DataFrame:
    """Rows whose value is in a bucket that is asked for with their key."""
    look = ["__key", *path_columns(depth)]
    asked = wanted.select(*look, "__exact").distinct()
    return add_path(rows, "__value", depth, _STEPS).join(_sized(asked, many, small), look)


def _rolled_up(leaves: DataFrame, widths: Sequence[int]) -> DataFrame:
    """Rows of leaves as rows of every wider cell around them, of the widths in use."""
    width, cell = F.col("__width_of"), F.col("__cell")
    every = F.array(*(F.lit(one).cast("bigint") for one in (0, *widths)))
    wider = F.filter(every, lambda one: (one == 0) | (one >= width) & (width > 0))
    at = F.when(F.col("__wider") == 0, F.lit(0)).otherwise(
        _start_of_cell(cell, F.when(F.col("__wider") > 0, F.col("__wider")))
    )
    return (
        leaves.withColumn("__wider", F.explode(wider))
        .withColumn("__cell", at)
        .withColumn("__width_of", F.col("__wider"))
        .drop("__wider")
    )


def _counts() -> list[Column]:
    return [F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")]


def _merged_moments(found: DataFrame, *by: str) -> DataFrame:
    """Count, bounds and moments of parts as those of their union; few parts make one."""
    parts = F.collect_list(F.struct("n", "sum", "var")).alias("__parts")
    merged = found.groupBy(*by).agg(*_counts(), F.sum("sum").alias("sum"), parts)
    mean = F.col("sum") / F.col("n")
    squares = F.aggregate(
        "__parts",
        F.lit(0.0),
        lambda total, part: total
        + part["n"] * (part["var"] + F.pow(part["sum"] / part["n"] - mean, F.lit(2.0))),
    )
    return merged.withColumn("var", squares / F.col("n")).drop("__parts")


def _first(
    found: DataFrame,
    cells: DataFrame,
    widths: Sequence[int],
    many: bool,
    many_wanted: bool,
    tables: Tables,
) -> DataFrame:
    """Six statistics and the first band per predicate, from sales in leaves."""
    wanted = cells.select(*_CELL).distinct()
    leaves = tables.cut(
        found.groupBy(*_CELL, doubling_bucket(F.col("__value")).alias("__bucket")).agg(
            F.count("*").alias("n"),
            F.min("__value").alias("low"),
            F.max("__value").alias("high"),
            F.sum("__value").alias("sum"),
            F.var_pop("__value").alias("var"),
        )
    )
    members = _sized(cells.select(_PREDICATE, *_CELL), many)

    def in_cells(rows: DataFrame) -> DataFrame:
        return _rolled_up(rows, widths).join(
            _sized(wanted, many_wanted), list(_CELL), "left_semi"
        )

    moments = _merged_moments(in_cells(_merged_moments(leaves, *_CELL)), *_CELL)
    totals = tables.cut(_merged_moments(members.join(moments, list(_CELL)), _PREDICATE))
    counted = in_cells(leaves).groupBy(*_CELL, "__bucket").agg(*_counts())
    ranks = totals.select(
        _PREDICATE,
        F.lit(0).cast("bigint").alias("__below"),
        F.expr("(n + 1) div 2").alias(RANKS[0]),
        F.expr("n div 2 + 1").alias(RANKS[1]),
    )
    merged = (
        members.join(counted, list(_CELL))
        .groupBy(_PREDICATE, "__bucket")
        .agg(*_counts())
        .join(_sized(ranks, many), _PREDICATE)
    )
    six = totals.select(
        _PREDICATE,
        F.col("sum").alias("suma"),
        F.col("n").alias("conteo"),
        (F.col("sum") / F.col("n")).alias("promedio"),
        F.col("low").alias("minimo"),
        F.col("high").alias("maximo"),
        F.sqrt("var").alias("desviacion_estandar"),
    )
    return _band(merged).join(_sized(six, many), _PREDICATE)


def _band(merged: DataFrame) -> DataFrame:
    """Per predicate, the bucket that holds its middle ranks."""
    named = {"n": "__n", "low": "__min", "high": "__max"}
    return next_band(merged.withColumnsRenamed(named), [_PREDICATE], _FEW_ROWS)


def _asked(cells: DataFrame, still_open: DataFrame, depth: int, many: bool) -> DataFrame:
    """Per predicate, the cells and the bucket of the given depth that are to be looked into."""
    return (
        _sized(cells.select(_PREDICATE, *_CELL), many)
        .join(add_path(still_open, "__low", depth, _STEPS), _PREDICATE)
        .select(_PREDICATE, *_CELL, *path_columns(depth), "__exact", "__below", *RANKS)
    )


def _next(
    found: DataFrame,
    asked: DataFrame,
    widths: Sequence[int],
    depth: int,
    many: bool,
    many_wanted: bool,
) -> DataFrame:
    """Look into the open bands, which are buckets of the given depth, of sales in leaves."""
    path = path_columns(depth)
    look = [*_CELL, *path, "__exact"]
    known = ("__below", *RANKS)
    wanted = asked.select(*look).distinct()
    finer = add_path(found.drop(*path), "__value", depth + 1, _STEPS)
    bucket = F.when(F.col("__exact"), F.col("__value")).otherwise(
        F.col(path_columns(depth + 1)[-1])
    )
    leaves = finer.groupBy(*look, bucket.alias("__bucket")).agg(
        F.count("*").alias("n"), F.min("__value").alias("low"), F.max("__value").alias("high")
    )
    counted = (
        _rolled_up(leaves, widths)
        .join(_sized(wanted, many_wanted), look, "left_semi")
        .groupBy(*look, "__bucket")
        .agg(*_counts())
    )
    merged = (
        _sized(asked, many)
        .join(counted, look)
        .groupBy(_PREDICATE, "__bucket")
        .agg(*_counts(), *(F.min(name).alias(name) for name in known))
    )
    return _band(merged)


def _answered(
    values: DataFrame, requested: DataFrame, part: _Part, tables: Tables
) -> DataFrame:
    """The seven statistics per predicate of a part, from all sales and all cells."""
    cells = requested if part.small else tables.cut(part.of_requests(requested))
    sales = part.of_sales(values)
    if not part.timed:
        sales = sales.withColumn("__time", F.lit(None).cast("bigint"))
    widths, holding = cells_around(cells)
    around = widths, tables.cut(holding)
    shapes, many = list(part.shapes), part.many_cells
    # Predicates share cells, so the distinct ones can be few.
    many_held = many and around[1].count() * _CELL_BYTES > part.broadcast_bytes
    many_wanted = part.many_keys or many_held
    sizes = {"small": part.small, "many_keys": part.many_keys, "many_cells": many_held}

    wanted = cells.select(*_CELL).distinct()
    placed = sales_in_cells(sales, cells, wanted, shapes, around=around, **sizes)
    if part.once:
        placed = tables.cut(placed.drop("__time"))
    first = tables.cut(_first(placed, cells, widths, many, many_wanted, tables))
    reached, medians, depth = first, [], 0
    while not (still_open := reached.where(F.col(MEDIAN).isNull())).isEmpty():
        depth += 1
        bands = still_open.select(_PREDICATE, *BAND, *RANKS)
        asked = tables.cut(_asked(cells, bands, depth, many))
        inside = F.col("__value").between(*bands.agg(F.min("__low"), F.max("__high")).first())
        if part.once:
            found = _asked_for(placed.where(inside), asked, depth, part.many_keys)
        else:
            found = sales_in_cells(
                sales.where(inside), cells, asked, shapes, around=around, depth=depth, **sizes
            )
        reached = tables.cut(_next(found, asked, widths, depth, many, many_wanted))
        medians.append(reached.where(F.col(MEDIAN).isNotNull()).select(_PREDICATE, MEDIAN))
    if not medians:
        return first.select(_PREDICATE, *STATISTIC_COLUMNS)
    later = reduce(DataFrame.unionByName, medians).withColumnRenamed(MEDIAN, "__later")
    median = F.coalesce(MEDIAN, "__later").alias(MEDIAN)
    return first.join(_sized(later, many), _PREDICATE, "left").select(
        _PREDICATE, *(median if name == MEDIAN else name for name in STATISTIC_COLUMNS)
    )


def _parts(sizes: Sequence[Row], values: DataFrame, broadcast_bytes: int) -> Iterator[_Part]:
    """All shapes at once if their keys and cells can be broadcast, else the large ones alone."""

    def bytes_of(size: Row) -> int:
        # A predicate has one cell at least, so this bounds keys and cells alike.
        return size["cells"] * (_CELL_BYTES + _KEY_BYTES) + size["text_bytes"]

    few, total = [], 0
    rest = sorted(sizes, key=lambda size: (bytes_of(size), size["__shape"]))
    while rest and total + bytes_of(rest[0]) <= broadcast_bytes:
        total += bytes_of(rest[0])
        few.append(rest.pop(0))
    if few or not rest:
        shapes = tuple(sorted(size["__shape"] for size in few))
        yield _Part(shapes, timed=any(size["timed"] for size in few), small=not rest)
    if not rest:
        return
    texts = [name for name in _used([size["__shape"] for size in rest]) if name in _TEXTS]
    lengths = (F.sum(F.octet_length(EQUALITY[name])).alias(name) for name in texts)
    facts = values.agg(F.count("*").alias("n"), *lengths).first()
    for size in rest:
        used = _used([size["__shape"]])
        moved = facts["n"] * 8 * (3 + len(used)) + sum(facts[n] or 0 for n in used if n in texts)
        slices = max(1, min(_MOST_SLICES, -(-moved // SLICE_BYTES))) if used else 1
        for number in range(slices):
            yield _Part(
                (size["__shape"],),
                timed=size["timed"],
                many_keys=size["keys"] * _KEY_BYTES + size["text_bytes"] > broadcast_bytes,
                many_cells=size["cells"] * _CELL_BYTES > broadcast_bytes,
                broadcast_bytes=broadcast_bytes,
                once=True,
                slice=number,
                slices=slices,
            )


def _numbered(predicates: DataFrame, tables: Tables) -> DataFrame:
    """Predicates with numbers in place of the digests, which are grouped and joined by."""
    keys = tables.cut(
        predicates.select("__key").distinct().withColumn("__k", F.monotonically_increasing_id())
    )
    return tables.cut(
        predicates.withColumn("__p", F.monotonically_increasing_id()).join(keys, "__key")
    ).withColumnsRenamed({"__key": "__key_text", "__k": "__key"})


def batch_statistics(
    sales: DataFrame,
    requests: DataFrame,
    column: str = TARGET_COLUMN,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``request_id`` and the seven statistics of the sales each request selects.

    ``requests`` has a unique ``request_id`` and the columns of ``REQUEST_SCHEMA``
    (null = filter not set). A request without matches gives the empty statistics.
    ``no_finita`` marks a request whose statistics overflow. The passes run when this is
    called, each only if a median is still open; the result is read from files.
    """
    spark = requests.sparkSession
    with Tables(spark, "batch") as tables:
        answers = _per_request(sales, requests, column, broadcast_bytes, tables)
        return written(answers, new_folder(spark, "answers"))


def _per_request(
    sales: DataFrame, requests: DataFrame, column: str, broadcast_bytes: int, tables: Tables
) -> DataFrame:
    typed = tables.cut(predicates_of(requests))
    facts = typed.agg(
        F.count("*").alias("n"),
        F.count_distinct(REQUEST_ID).alias("ids"),
        F.collect_set("__shape").alias("shapes"),  # at most 64 numbers
        F.count("__start").alias("timed"),
        F.count_if("__has_start").alias("bounded_below"),
        F.count_if("__has_end").alias("bounded_above"),
        F.min("__start").alias("earliest"),
        F.max("__end").alias("latest"),
    ).first()
    if facts["n"] != facts["ids"]:
        raise FilterError("repeated_request", "request_id must be present and unique")

    distinct = typed.drop(REQUEST_ID, "__has_start", "__has_end").dropDuplicates([_PREDICATE])
    predicates = _numbered(distinct, tables)
    numbered = predicates.drop(_PREDICATE, "__key_text").withColumnRenamed("__p", _PREDICATE)
    cells = tables.cut(cells_of(numbered))
    text_bytes = F.coalesce(F.sum(F.octet_length(F.concat_ws("", *_TEXTS))), F.lit(0))
    by_shape = cells.groupBy("__shape").agg(
        F.count("*").alias("cells"),
        F.count_distinct("__key").alias("keys"),
        text_bytes.alias("text_bytes"),
        F.bool_or(F.col("__width_of") > 0).alias("timed"),
    )
    used = _used(facts["shapes"])
    # What no request can match need not be read.
    wanted = sales
    offset = BUSINESS_UTC_OFFSET_MINUTES * 60_000_000
    if facts["n"] and facts["bounded_below"] == facts["n"]:
        wanted = wanted.where(
            F.col("fecha") >= F.timestamp_micros(F.lit(facts["earliest"] - offset))
        )
    if facts["n"] and facts["bounded_above"] == facts["n"]:
        wanted = wanted.where(F.col("fecha") < F.timestamp_micros(F.lit(facts["latest"] - offset)))
    time = _on_axis(F.unix_micros("fecha")) if facts["timed"] else F.lit(None).cast("bigint")
    kept = [*(EQUALITY[name] for name in used), *(["fecha"] if facts["timed"] else [])]
    values = finite_values(wanted, column, kept).withColumn("__time", time)

    answers = []
    for part in _parts(by_shape.collect(), values, broadcast_bytes):
        with Tables(sales.sparkSession, "part") as own:
            answers.append(tables.cut(_answered(values, cells, part, own)))
    found = reduce(DataFrame.unionByName, answers)

    measured = [c for c in STATISTIC_COLUMNS if c not in ("suma", "conteo")]
    overflow = reduce(
        or_, (~F.coalesce(is_finite(F.col(c)), F.lit(True)) for c in ("suma", *measured))
    )
    found = predicates.select(_PREDICATE, "__p").join(
        found.withColumnRenamed(_PREDICATE, "__p"), "__p"
    )
    return typed.select(REQUEST_ID, _PREDICATE).join(found, _PREDICATE, "left").select(
        REQUEST_ID,
        *(
            F.coalesce(name, F.lit(0)).cast(kind).alias(name)
            if (kind := {"suma": "double", "conteo": "bigint"}.get(name))
            else F.col(name)
            for name in STATISTIC_COLUMNS
        ),
        overflow.alias("no_finita"),
    )
