"""Helpers for functions over Arrow batches."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator, Sequence
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


_PART_BYTES = 4 << 20
_SHARED = "_tallyspark_worker"


def per_process(key: tuple, make: Callable[[], object]) -> object:
    """What the tasks of one Python worker share: made by the first that asks for it.

    Functions come to a worker by value, with globals of their own in every task; a module
    entered in ``sys.modules`` stays as long as the worker does.
    """
    shared = sys.modules.setdefault(_SHARED, ModuleType(_SHARED)).__dict__
    if key not in shared:
        shared[key] = make()
    return shared[key]


def text_parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about 4 MB of text each; a longer text is a slice alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(numbers(sizes))
    low = 0
    while low < batch.num_rows:
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + _PART_BYTES, side="right")))
        yield batch.slice(low, high - low)
        low = high


def binaries(column: pa.Array) -> list[bytes | None]:
    """A text column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def numbers(column: pa.Array, kind=np.int64) -> np.ndarray:
    """A column without nulls as numpy values."""
    return np.asarray(column.to_numpy(zero_copy_only=False), dtype=kind)


def lists(values: np.ndarray, width: int) -> pa.Array:
    """A list column of rows with ``width`` values each, from a matrix."""
    rows = len(values)
    offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1)))


def runs(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The maximal runs of rows with equal, non-null integer ``keys`` in a sorted stream.

    A run may cross batches; only the current one is held.
    """
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [numbers(batch.column(batch.schema.get_field_index(key))) for key in keys]
        changed = np.zeros(batch.num_rows - 1, dtype=bool)
        for column in columns:
            changed |= column[1:] != column[:-1]
        cuts = [0, *(np.nonzero(changed)[0] + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(int(column[low]) for column in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def whole_runs(
    batches: Iterable[pa.RecordBatch], keys: Sequence[str]
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete runs of equal ``keys``, with the bounds of the runs in them.

    Like ``runs``, but many short runs come at once.
    """
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        changed = np.zeros(table.num_rows - 1, dtype=bool)
        for column in (numbers(table.column(key)) for key in keys):
            changed |= column[1:] != column[:-1]
        return np.concatenate([[0], np.nonzero(changed)[0] + 1, [table.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        edges = (batch.slice(0, 1), batch.slice(batch.num_rows - 1))
        if len(held) > 1 and edges[0].select(keys).equals(edges[1].select(keys)):
            continue  # inside one long run, most likely
        table = pa.Table.from_batches(held)
        bounds = cut(table)
        if bounds[-2]:
            yield table.slice(0, int(bounds[-2])), bounds[:-1]
        held = table.slice(int(bounds[-2])).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, cut(table)
