"""Near-duplicate vectors by a pivot-permutation index.

Reference vectors (pivots) are a bounded sample. A vector is described by its ``NEAREST``
pivots in order of nearness; an inverted list holds, per label and pair of pivots, the
vectors that have both among them, so that two vectors meet exactly if their shared-pivot
count is at least two. Lists are cut into blocks of bounded size. A pair that meets in several
lists is compared only in the list of its two first shared pivots, by cosine in double
precision. A block returns link counts and at most one link per row that connects anything;
pairs are never emitted.

The number of pivots follows the square root of the number of vectors up to
``MOST_PIVOTS``, so lists keep their length while it grows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.arrow_runs import lists, numbers, whole_runs
from tallyspark.llm.components import components
from tallyspark.llm.minhash import _forest
from tallyspark.llm.scratch import saved

COSINE = 0.93
NEAREST = 8
LEAST_PIVOTS, MOST_PIVOTS = 64, 8192
_PER_ROOT = 4  # pivots for each square root of the number of vectors
_NO_PAIR = (0, 0xFFFF)
_APART = 0.8  # cosine that two pivots stay below
_BLOCK = 512  # rows of one side of a block
_SHORT = 48  # rows of a list that is compared together with others
_PAIRS = 1 << 16  # compared at a time


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)  # no overflow in the squares
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _described(pivots: dict[int, np.ndarray]):
    """Adds the nearest pivots, by number, in order of nearness (-1: there are fewer)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = numbers(batch.column(batch.schema.get_field_index("size")))
            flat = batch.column(batch.schema.get_field_index("embedding")).flatten()
            flat, end = numbers(flat, np.float64), np.cumsum(size)
            near = np.full((batch.num_rows, NEAREST), -1, dtype=np.int32)
            raw: list[bytes] = [b""] * batch.num_rows
            for dimension in np.unique(size).tolist():
                rows = np.nonzero(size == dimension)[0]
                places = (end[rows] - dimension)[:, None] + np.arange(dimension)
                unit = _unit(flat[places])
                for row, one in zip(rows.tolist(), unit, strict=True):
                    raw[row] = one.tobytes()
                references = pivots.get(dimension)
                if references is None or len(references) < 2:
                    near[rows, :2] = _NO_PAIR  # too few pivots to tell: all share a list
                else:
                    likeness = unit @ references.T
                    order = np.argsort(-likeness, axis=1, kind="stable")[:, :NEAREST]
                    near[rows, : order.shape[1]] = order
            kept = [batch.column(place) for place in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, lists(near, NEAREST), pa.array(raw, pa.binary())],
                names=[*batch.schema.names[:-1], "near", "unit"],
            )

    return run


def _first_shared(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two smallest shared pivots of each pair of rows."""
    shared = (left[:, :, None] == right[:, None, :]).any(axis=2) & (left >= 0)
    values = np.sort(np.where(shared, left, np.iinfo(np.int32).max), axis=1)
    return values[:, 0], values[:, 1]


def _short_links(unit, near, pair, starts, length: int, least: float) -> np.ndarray:
    """Links within short lists of one length, many lists at a time, as pairs of rows."""
    a, b = np.triu_indices(length, 1)
    found = [np.empty((0, 2), dtype=np.int64)]
    step = max(1, _PAIRS // max(1, len(a)))
    for low in range(0, len(starts), step):
        own = starts[low : low + step][:, None]
        left, right = (own + a).reshape(-1), (own + b).reshape(-1)
        first, second = _first_shared(near[left], near[right])
        here = (first == pair[left] >> 16) & (second == pair[left] & 0xFFFF)
        left, right = left[here], right[here]
        alike = np.einsum("ij,ij->i", unit[left], unit[right]) >= least
        found.append(np.stack([left[alike], right[alike]], axis=1))
    return np.concatenate(found)


def _block_links(unit, near, pair, part, sides, least: float) -> np.ndarray:
    """Links between the two sides of one block, as pairs of rows."""
    left, right = np.nonzero(part == sides[0])[0], np.nonzero(part == sides[1])[0]
    if not len(left) or not len(right):
        return np.empty((0, 2), dtype=np.int64)
    alike = unit[left] @ unit[right].T >= least
    # Pairs that share a pivot before this list's second, other than its first, meet earlier.
    first, second = int(pair[0]) >> 16, int(pair[0]) & 0xFFFF
    earlier = np.unique(near[(near >= 0) & (near < second) & (near != first)])
    if len(earlier):
        holds = (near[:, :, None] == earlier).any(axis=1).astype(np.float32)
        alike &= holds[left] @ holds[right].T == 0
    rows, columns = np.nonzero(alike)
    pairs = np.stack([left[rows], right[columns]], axis=1)
    return pairs[pairs[:, 0] < pairs[:, 1]] if sides[0] == sides[1] else pairs


def _told(key: np.ndarray, copies: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
    """``rep, other, links``: counts per vector, and connecting links with a count of 0."""
    rows, place = np.unique(links.reshape(-1), return_inverse=True)
    ends = place.reshape(-1, 2)
    weight = copies[rows]
    counts = np.bincount(ends[:, 0], weights=weight[ends[:, 1]], minlength=len(rows))
    counts += np.bincount(ends[:, 1], weights=weight[ends[:, 0]], minlength=len(rows))
    chosen = np.array(_forest(len(rows), ends), dtype=np.int64).reshape(-1, 2)
    names = key[rows]
    nothing = np.zeros(len(chosen), dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([names, names[chosen[:, 0]]])),
            pa.concat_arrays([pa.nulls(len(rows), pa.int64()), pa.array(names[chosen[:, 1]])]),
            pa.array(np.concatenate([counts.astype(np.int64), nothing])),
        ],
        names=["rep", "other", "links"],
    )


def _compared(least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["label", "size", "pair", "part_a", "part_b"]
        for table, bounds in whole_runs(batches, keys):
            key, copies, size, pair, part, side_a, side_b = (
                numbers(table.column(name))
                for name in ("rep", "copies", "size", "pair", "part", "part_a", "part_b")
            )
            near = numbers(table.column("near").combine_chunks().flatten(), np.int32)
            near, raw = near.reshape(-1, NEAREST), table.column("unit").to_pylist()
            starts, lengths = bounds[:-1], np.diff(bounds)
            short = (side_a[starts] == side_b[starts]) & (lengths <= _SHORT)
            for dimension in np.unique(size).tolist():
                rows = np.nonzero(size == dimension)[0]
                unit = np.zeros((len(size), dimension))
                unit[rows] = np.frombuffer(b"".join(raw[row] for row in rows)).reshape(
                    -1, dimension
                )
                same = size[starts] == dimension
                links = [np.empty((0, 2), dtype=np.int64)]
                for length in np.unique(lengths[same & short]).tolist():
                    own = starts[same & short & (lengths == length)]
                    links.append(_short_links(unit, near, pair, own, length, least))
                for low, length in zip(
                    starts[same & ~short].tolist(), lengths[same & ~short].tolist(), strict=True
                ):
                    cut = slice(low, low + length)
                    sides = (int(side_a[low]), int(side_b[low]))
                    own = _block_links(unit[cut], near[cut], pair[cut], part[cut], sides, least)
                    links.append(low + own)
                yield _told(key, copies, np.concatenate(links))

    return run


def _pivots(distinct: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Unit reference vectors per dimension, at most ``count`` of each.

    From the ``2 * count`` vectors whose ids hash lowest, those that are not close to one
    chosen before: a dense group must not be described by its own members, which its
    vectors would put in a different order each.
    """
    sample = (
        distinct.orderBy(F.xxhash64("rep"), "rep").select("embedding").limit(2 * count).collect()
    )
    by_dimension: dict[int, list] = {}
    for row in sample:
        by_dimension.setdefault(len(row["embedding"]), []).append(row["embedding"])
    chosen = {}
    for size, vectors in by_dimension.items():
        units = _unit(np.array(vectors, dtype=np.float64))
        kept = np.empty((min(count, len(units)), size))
        filled = 0
        for unit in units:
            if filled < len(kept) and not (kept[:filled] @ unit >= _APART).any():
                kept[filled] = unit
                filled += 1
        chosen[size] = kept[:filled]
    return chosen


def near_duplicate_vectors(
    vectors: DataFrame,
    *,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    least: float = COSINE,
) -> DataFrame:
    """``<id>, n_links, component_id, kept`` for every row of ``vectors``.

    Vectors of one label and dimension are linked if they meet in the index and their
    cosine is at least ``least``. ``n_links`` counts linked rows, equal vectors included.
    Null, empty and zero vectors, vectors with a null or non-finite component, and rows
    without a label link with nothing and are their own component. A row without an id
    links with nothing; its component is null and it is kept. Ids are whole numbers and
    should not repeat; repeated rows count as linked rows of one component. No rows, no
    result. Other columns are ignored.
    """
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(label_column).alias("label"),
        F.col(vector_column).alias("embedding"),
    )
    whole_number = isinstance(rows.schema["label"].dataType, T.IntegralType)
    label = F.col("label").cast("long") if whole_number else F.xxhash64("label")
    sound = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ) & F.exists("embedding", lambda x: x != 0)
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))
    usable = rows.where(fit).withColumn("label", label)
    distinct = saved(
        usable.groupBy("label", "embedding").agg(
            F.min("id").alias("rep"), F.count("*").alias("copies")
        ),
        "vectors-distinct",
    ).frame
    count = distinct.count()
    wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, math.ceil(_PER_ROOT * math.sqrt(count))))
    index = saved(
        distinct.select(
            "rep", "label", F.size("embedding").cast("long").alias("size"), "copies", "embedding"
        ).mapInArrow(
            _described(_pivots(distinct, wanted)),
            "rep long, label long, size long, copies long, near array<int>, unit binary",
        ),
        "vectors-index",
    ).frame

    ordered = F.array_sort(F.filter("near", lambda pivot: pivot >= 0))
    pairs = F.filter(
        F.array(
            *(
                F.shiftleft(F.get(ordered, F.lit(a)), 16).bitwiseOR(F.get(ordered, F.lit(b)))
                for a, b in combinations(range(NEAREST), 2)
            )
        ),
        lambda pair: pair.isNotNull(),
    )
    entries = index.select("rep", "label", "size", F.explode(pairs.cast("array<bigint>")).alias("pair"))
    place = ["label", "size", "pair"]
    longer = (
        entries.groupBy(*place)
        .agg(F.count("*").alias("members"))
        .where("members > 1")
        .select(*place, F.ceil(F.col("members") / _BLOCK).alias("parts"))
    )
    blocks = (
        entries.join(longer, place)
        .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
        .withColumn(
            "other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
        )
        .select(
            *place,
            F.least("part", "other").alias("part_a"),
            F.greatest("part", "other").alias("part_b"),
            "part",
            "rep",
        )
        .join(index.select("rep", "copies", "near", "unit"), "rep")
        .repartition(*place, "part_a", "part_b")
        .sortWithinPartitions(*place, "part_a", "part_b")
    )
    told = saved(
        blocks.mapInArrow(_compared(least), "rep long, other long, links long"), "vectors-links"
    ).frame
    counted = told.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(
        told.where("other is not null").select("rep", "other"), "vectors-components"
    )
    known = (
        distinct.join(counted, "rep", "left")
        .join(classes.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "label",
            "embedding",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
            F.coalesce("component", "rep").alias("component"),
        )
    )
    found = usable.join(known, ["label", "embedding"]).select("id", "links", "component")
    unsound = rows.where(~fit).select(
        "id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component")
    )
    return found.union(unsound).select(
        F.col("id").alias(id_column),
        F.col("links").alias("n_links"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )
