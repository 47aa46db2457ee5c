"""Repeated windows by a depth-limited radix sort of suffixes, most significant digit first.

A window of ``depth`` bytes repeats if another suffix agrees with it through that depth; so
suffixes are sorted only that far, and equal groups are the repeated windows. Sorting all
suffixes would move many times the corpus, so passes get finer as fewer suffixes are left:

1. First digit. Of every window one suffix is an *anchor*: the one with the least hash of
   its first ``DIGIT`` bytes, the leftmost among equals. Equal windows have their anchor at the
   same place, so their anchors have an equal digit. Consecutive windows with one anchor are a
   *stretch*. Stretches (two hashes and a place) are dealt into buckets by their digit and
   sorted there. Of equal stretches all but those of the smallest document are repeats at
   once. A stretch whose digit no other document has leaves; so does most text.
2. Remaining digits. The few stretches left, which differ but share a digit, are fetched,
   and their windows are sorted by their bytes, eight at a time. Windows that are alone
   after a digit leave. Of equal windows all but those of the smallest document are repeats.

Copies are settled where they meet first: a task forwards a stretch or window once per
slice of text, with its smallest document. A digit that a sample of documents shows to be
common is dealt by whole stretches instead, and digits with many different stretches are
dealt by whole windows, so no task gathers a passage that a large part of the corpus shares.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.arrow_runs import binaries, numbers, runs, text_parts, whole_runs
from tallyspark.llm.radix import equal_groups, radix_order, starts_of_runs
from tallyspark.llm.scratch import saved
from tallyspark.llm.shingles import mixed

DEPTH = 50
DIGIT = 26  # bytes of the first digit; of each window the anchor has DEPTH - DIGIT + 1 places
_SEGMENT = 8 << 20  # of a longer text at a time
_JOINED = 1 << 20  # of shorter texts at a time
_FORWARDED = 3 << 18  # stretches a task gathers before it deals them out
_BUCKET_BYTES = 8 << 20  # of text per bucket
_SAMPLED, _COMMON = 4096, 8  # documents of the sample, and how many of them make a digit common
_MANY = 4096  # different stretches of one digit that are dealt by windows
_ODD = 0x9E3779B97F4A7C15
_PLACE_BITS = 24
_MARK = "doc long, mark long, start long, stop long, digit long, wide boolean"


def _digit_hashes(joined: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes at every place, by doubling."""
    step = (joined.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    step ^= step >> np.uint64(32)
    power, size, left = np.uint64(_ODD), 1, width
    made, length = None, 0
    while left:
        if left & 1:
            rest = step if made is None else made[: len(step) - length] * power
            made = rest if made is None else rest[: len(step) - length] + step[length:]
            length += size
        left >>= 1
        if left:
            step = step[:-size] * power + step[size:]
            power, size = power * power, size * 2
    return mixed(made[: len(joined) - width + 1])


def stretches(joined: np.ndarray, ends: np.ndarray, depth: int, digit: int):
    """First window, last window and digit of every stretch of the texts that end at ``ends``."""
    places = depth - digit + 1
    sizes = np.diff(ends, prepend=0)
    long = sizes >= depth
    if not long.any():
        nothing = np.empty(0, dtype=np.int64)
        return nothing, nothing, nothing.astype(np.uint64)
    hashes = _digit_hashes(joined, digit)
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    least = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    reach = 1
    while reach * 2 <= places:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < places:
        least = np.minimum(least[: len(least) - (places - reach)], least[places - reach :])
    inside = np.zeros(len(joined) + 1, dtype=np.int8)
    np.add.at(inside, ends[long] - sizes[long], 1)
    np.add.at(inside, ends[long] - depth + 1, -1)
    windows = np.nonzero(np.cumsum(inside))[0]
    anchors = (least[windows] & mask).astype(np.int64)
    starts = starts_of_runs([anchors])
    return windows[starts], windows[np.append(starts[1:], len(windows)) - 1], hashes[anchors[starts]]


def _segments(part: pa.RecordBatch, depth: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Bytes of the texts with the ends, row and offset of each; long texts in several goes."""
    rows, offsets, held, size = [], [], [], 0

    def joined() -> tuple[np.ndarray, ...]:
        ends = np.cumsum([len(text) for text in held])
        return np.frombuffer(b"".join(held), np.uint8), ends, np.array(rows), np.array(offsets)

    for row, text in enumerate(binaries(part.column(2))):
        text = text or b""
        if len(text) <= _SEGMENT:
            rows.append(row), offsets.append(0), held.append(text)
            size += len(text)
            if size >= _JOINED:
                yield joined()
                rows, offsets, held, size = [], [], [], 0
            continue
        for low in range(0, len(text), _SEGMENT):
            cut = text[low : low + _SEGMENT + depth - 1]
            yield np.frombuffer(cut, np.uint8), np.array([len(cut)]), np.array([row]), np.array([low])
    if held:
        yield joined()


def _stretches_of(part: pa.RecordBatch, depth: int, digit: int):
    """Columns of all stretches: digit, whole, row of the text, start, length."""
    for joined, ends, row, offset in _segments(part, depth):
        first, last, digits = stretches(joined, ends, depth, digit)
        view, stop = memoryview(joined), last + depth
        whole = np.fromiter(
            (xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), stop.tolist())),
            np.uint64,
            len(first),
        )
        text = np.searchsorted(ends, first, side="right")
        begin = ends - np.diff(ends, prepend=0)
        yield (
            digits,
            whole,
            row[text],
            (first - begin[text] + offset[text]).astype(np.int64),
            (stop - first).astype(np.uint8),
        )


def _deal(depth: int, digit: int, buckets: int, common: np.ndarray):
    """Texts to fragments: the stretches of a slice, by bucket, each kind from its smallest document."""

    def bucket_of(values: np.ndarray) -> np.ndarray:
        return ((mixed(values) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)

    def fragments(parts: list[tuple], texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        digits, whole, row, start, length = (np.concatenate(c) for c in zip(*parts))
        order = radix_order([whole])
        digits, whole, row, start, length = (
            column[order] for column in (digits, whole, row, start, length)
        )
        known = np.concatenate(texts)  # a row of doc and mark per text
        doc = known[row, 0]
        runs_at = starts_of_runs([digits, whole])
        sizes = np.diff(np.append(runs_at, len(doc)))
        repeat = doc > np.repeat(np.minimum.reduceat(doc, runs_at), sizes)
        wide = np.isin(digits, common)
        bucket = bucket_of(np.where(wide, whole, digits))
        bucket[repeat] = bucket_of(known[row[repeat], 1].view(np.uint64))
        by_bucket = np.argsort(bucket, kind="stable")
        cuts = starts_of_runs([bucket[by_bucket]])
        for low, high in zip(cuts, np.append(cuts[1:], len(by_bucket)), strict=True):
            here = by_bucket[low:high]
            used, place = np.unique(row[here], return_inverse=True)
            columns = (
                known[used],
                digits[here],
                whole[here],
                place.astype(np.uint32),
                start[here].astype(np.uint32),
                length[here],
                repeat[here].astype(np.uint8) + 2 * wide[here].astype(np.uint8),
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(bucket[here[0]])], pa.int64())]
                + [pa.array([column.tobytes()], pa.binary()) for column in columns],
                names=["bucket", "known", "digits", "whole", "row", "start", "length", "flags"],
            )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        texts: list[np.ndarray] = []
        count = before = 0
        for batch in batches:
            for part in text_parts(batch, 2):
                texts.append(np.stack([numbers(part.column(0)), numbers(part.column(1))], axis=1))
                for digits, whole, row, start, length in _stretches_of(part, depth, digit):
                    held.append((digits, whole, row + before, start, length))
                    count += len(digits)
                before += part.num_rows
                if count >= _FORWARDED:
                    yield from fragments(held, texts)
                    held, texts, count, before = [], [], 0, 0
        if count:
            yield from fragments(held, texts)

    return run


_FRAGMENT = (
    "bucket long, known binary, digits binary, whole binary, row binary, start binary, "
    "length binary, flags binary"
)


def _first_digit():
    """Per bucket: repeated stretches (no digit), and those whose digit another document has."""
    kinds = (("digits", np.uint64), ("whole", np.uint64), ("row", np.uint32))
    kinds += (("start", np.uint32), ("length", np.uint8), ("flags", np.uint8))

    def marks(known, row, start, length, digits, wide) -> pa.RecordBatch:
        size = len(row)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(known[row, 0]),
                pa.array(known[row, 1]),
                pa.array(start.astype(np.int64)),
                pa.array(start.astype(np.int64) + length),
                pa.array([None] * size, pa.int64()) if digits is None else pa.array(digits.view(np.int64)),
                pa.array(np.zeros(size, dtype=bool) if wide is None else wide),
            ],
            names=["doc", "mark", "start", "stop", "digit", "wide"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["bucket"]):
            known, rows, before = [], [], 0
            columns = {name: [] for name, _ in kinds}
            for at in range(group.num_rows):
                for name, kind in kinds:
                    columns[name].append(np.frombuffer(group.column(name)[at].as_py(), kind))
                known.append(np.frombuffer(group.column("known")[at].as_py(), np.int64).reshape(-1, 2))
                rows.append(columns["row"][-1].astype(np.int64) + before)
                before += len(known[-1])
            known, row = np.concatenate(known), np.concatenate(rows)
            digits, whole, _, start, length, flags = (np.concatenate(columns[n]) for n, _ in kinds)
            settled = (flags & 1) > 0
            if settled.any():
                yield marks(known, row[settled], start[settled], length[settled], None, None)
            open_rows = np.nonzero(~settled)[0]
            if not len(open_rows):
                continue
            order = open_rows[
                radix_order([digits[open_rows], whole[open_rows]])
            ]
            digits, whole, row, start, length, wide = (
                column[order] for column in (digits, whole, row, start, length, (flags & 2) > 0)
            )
            doc = known[row, 0]
            of_digit, of_whole = starts_of_runs([digits]), starts_of_runs([digits, whole])
            sizes, same = (np.diff(np.append(starts, len(doc))) for starts in (of_digit, of_whole))
            repeat = doc > np.repeat(np.minimum.reduceat(doc, of_whole), same)
            if repeat.any():
                yield marks(known, row[repeat], start[repeat], length[repeat], None, None)
            is_start = np.zeros(len(doc), dtype=np.int64)
            is_start[of_whole] = 1
            different = np.add.reduceat(is_start, of_digit)
            shared = np.minimum.reduceat(doc, of_digit) < np.maximum.reduceat(doc, of_digit)
            left = np.repeat((different > 1) & shared, sizes) | wide
            wide = wide | np.repeat(different > _MANY, sizes)
            left &= ~repeat
            if left.any():
                yield marks(known, row[left], start[left], length[left], digits[left], wide[left])

    return run


def _windows(joined: np.ndarray, places: np.ndarray, depth: int) -> list[np.ndarray]:
    """The digits of the windows at ``places``: their bytes, eight by eight."""
    rows = np.lib.stride_tricks.sliding_window_view(joined, depth)[places]
    padded = np.zeros((len(places), -(-depth // 8) * 8), dtype=np.uint8)
    padded[:, :depth] = rows
    values = padded.view(">u8").astype(np.uint64)
    return [np.ascontiguousarray(values[:, at]) for at in range(values.shape[1])]


def _repeated(joined, places, doc, depth) -> np.ndarray:
    """Which windows also start in a smaller document."""
    rows, group = equal_groups(_windows(joined, places, depth))
    found = np.zeros(len(places), dtype=bool)
    if len(rows):
        starts = starts_of_runs([group])
        least = np.minimum.reduceat(doc[rows], starts)
        found[rows] = doc[rows] > np.repeat(least, np.diff(np.append(starts, len(rows))))
    return found


_PIECE = "bucket long, doc long, mark long, start long, piece binary"


def _fetch(depth: int):
    """Texts with their open stretches to pieces of text, or single windows of wide digits.

    Windows of a batch that repeat a smaller document of it are passed on without a piece.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, 2):
                texts = binaries(part.column(2))
                ids, marks = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows, single = [], []
                for doc, mark, text, wanted in zip(ids, marks, texts, part.column(3).to_pylist()):
                    for one in wanted:
                        low, high = one["start"], one["stop"]
                        if one["wide"]:
                            single += [(doc, mark, at, text[at : at + depth]) for at in range(low, high - depth + 1)]
                        else:
                            rows.append((one["digit"], doc, mark, low, text[low:high]))
                first: dict[bytes, int] = {}
                for doc, _, _, window in single:
                    first[window] = min(first.get(window, doc), doc)
                for doc, mark, at, window in single:
                    if doc > first[window]:
                        rows.append((mark, doc, mark, at, None))
                    else:
                        rows.append((xxhash.xxh3_64_intdigest(window) - (1 << 63), doc, mark, at, window))
                for low in range(0, len(rows), 1 << 16):
                    columns = list(zip(*rows[low : low + (1 << 16)]))
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(column, pa.int64()) for column in columns[:4]), pa.array(columns[4], pa.binary())],
                        names=["bucket", "doc", "mark", "start", "piece"],
                    )

    return run


def _later_digits(depth: int):
    """Pieces, by bucket, to the runs of their windows that repeat a smaller document."""

    def removed(doc, mark, start, stop) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(column, pa.int64()) for column in (doc, mark, start, stop)],
            names=["doc", "mark", "start", "stop"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in whole_runs(batches, ["bucket"]):
            doc, mark, start = (numbers(table.column(n)) for n in ("doc", "mark", "start"))
            pieces = table.column("piece").to_pylist()
            sizes = np.array([len(piece or b"") for piece in pieces])
            known = sizes == 0
            if known.any():
                yield removed(doc[known], mark[known], start[known], start[known] + depth)
            if known.all():
                continue
            joined = np.frombuffer(b"".join(piece or b"" for piece in pieces), np.uint8)
            begin = np.cumsum(sizes) - sizes
            count = np.maximum(sizes - depth + 1, 0)
            piece = np.repeat(np.arange(len(pieces)), count)
            within = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
            found = _repeated(joined, begin[piece] + within, doc[piece], depth)
            piece, within = piece[found], within[found]
            if len(piece):
                breaks = np.ones(len(piece), dtype=bool)
                breaks[1:] = (piece[1:] != piece[:-1]) | (within[1:] != within[:-1] + 1)
                first = np.nonzero(breaks)[0]
                last = np.append(first[1:], len(piece)) - 1
                of = piece[first]
                yield removed(doc[of], mark[of], start[of] + within[first], start[of] + within[last] + depth)

    return run


def _cut():
    """``text, ranges`` and the row's id to what is left and the runs that went."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            for part in text_parts(batch, 1):
                gone, left, sizes = [], [], []
                for text, ranges in zip(binaries(part.column(1)), part.column(2).to_pylist()):
                    text, merged, kept, end = text or b"", [], [], 0
                    for one in sorted((r["start"], r["stop"]) for r in ranges or ()):
                        if merged and one[0] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], one[1])
                        else:
                            merged.append(list(one))
                    for start, stop in merged:
                        kept.append(text[end:start])
                        end = stop
                    kept.append(text[end:])
                    gone.append([{"start": a, "stop": b} for a, b in merged])
                    left.append(b"".join(kept))
                    sizes.append(len(text))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(gone, spans), pa.array(left, pa.binary())],
                    names=["id", "n_bytes", "spans", "kept"],
                )

    return run


def _common_digits(texts: DataFrame, rows: int, depth: int, digit: int) -> np.ndarray:
    """Digits that many documents of a bounded sample have. They only decide who sorts what."""

    def digits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, 2):
                for found, _, row, *_ in _stretches_of(part, depth, digit):
                    order = np.lexsort((row, found))
                    found, row = found[order], row[order]
                    once = found[starts_of_runs([found, row])]
                    yield pa.RecordBatch.from_arrays([pa.array(once.view(np.int64))], names=["digit"])

    draw = F.pmod(F.xxhash64("doc", "mark", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    common = (
        texts.where(draw < _SAMPLED / max(rows, 1))
        .mapInArrow(digits, "digit long")
        .groupBy("digit")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= _COMMON)
    )
    return np.array([row["digit"] for row in common.collect()], dtype=np.int64).view(np.uint64)


def _listed(ranges: DataFrame, *columns: str) -> DataFrame:
    return ranges.groupBy("doc", "mark").agg(F.collect_list(F.struct(*columns)).alias("ranges"))


def remove_repeats(
    documents: DataFrame,
    *,
    depth: int = DEPTH,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``<id>, n_bytes, spans, kept``: each text without what smaller documents also hold.

    Texts are their UTF-8 bytes, in full. A byte goes if a string of ``depth`` bytes that
    covers it also starts in a document with a smaller id, as the texts were given. ``spans``
    are the maximal removed runs (``start``, ``stop``) in order, ``kept`` the bytes left, which
    need not be valid UTF-8. Ids are integers. Rows that share an id are not smaller than each
    other, so neither loses anything to the other. A row without an id loses nothing and nothing
    is lost to it. Null and empty texts, and those shorter than ``depth``, stay as they are.
    Result: a row per row. Other columns are ignored, whatever their names.
    """
    digit = max(1, depth * DIGIT // DEPTH)
    mark = F.xxhash64(text_column)

    def keyed(*more: str | Column) -> DataFrame:
        return documents.select(
            F.col(id_column).cast("long").alias("doc"), mark.alias("mark"), F.col(text_column).alias("text"), *more
        )

    texts = keyed().where("doc is not null and octet_length(text) >= %d" % depth)
    rows, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = max(8, -(-size // _BUCKET_BYTES))
    common = _common_digits(texts, rows, depth, digit)
    marks = saved(
        texts.mapInArrow(_deal(depth, digit, buckets, common), _FRAGMENT)
        .repartition(buckets, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_first_digit(), _MARK),
        "repeats-marks",
        free=True,
    ).frame
    open_stretches = _listed(marks.where("digit is not null"), "start", "stop", "digit", "wide")
    later = saved(
        texts.join(open_stretches, ["doc", "mark"])
        .mapInArrow(_fetch(depth), _PIECE)
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_later_digits(depth), "doc long, mark long, start long, stop long"),
        "repeats-later",
        free=True,
    ).frame
    columns = ["doc", "mark", "start", "stop"]
    ranges = _listed(marks.where("digit is null").select(*columns).union(later.select(*columns)), "start", "stop")
    kind = documents.schema[id_column].dataType.simpleString()
    return (
        keyed(F.col(id_column).alias("id"))
        .join(ranges, ["doc", "mark"], "left")
        .select("id", "text", "ranges")
        .mapInArrow(
            _cut(), f"id {kind}, n_bytes long, spans array<struct<start:bigint,stop:bigint>>, kept binary"
        )
        .withColumnRenamed("id", id_column)
    )


def digest(documents: DataFrame, **settings) -> DataFrame:
    """``<id>, n_bytes, n_removed, n_spans, kept_sha256`` of ``remove_repeats``."""
    found = remove_repeats(documents, **settings)
    return found.select(
        found.columns[0],
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
