"""A suffix array per group of texts: token runs that recur in different texts.

The array holds every suffix of every text, compared up to ``LONG`` tokens, as a shorter
agreement is no long repeat. It is sorted most significant digit first:

1. The first digit is a hash of ``DIGIT`` tokens and the group. Of all suffixes whose first
   ``LONG`` tokens hold an anchor (the window's least digit) the anchor stands for them: equal
   windows have equal anchors. Digits are dealt out by their top bits as packed numbers, and
   a suffix whose digit no other text has is in its place and done.
2. The suffixes left are sorted by their tokens into ranges of the whole array. Neighbours
   are compared: what agrees in ``LONG`` tokens is one repeated substring.

Ranges are cut by suffix and text, so a run that stands on every text of a large group is
counted over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.arrow_runs import binaries, numbers, text_parts, whole_runs
from tallyspark.llm.scratch import saved
from tallyspark.llm.shingles import WordHasher, mixed, windows

LONG = 8  # tokens that make a repeated substring long
DIGIT = 5  # tokens of the first digit
_BUCKETS = 12  # bits of a digit that deal it out; the next 32 are sent
_OWNERS = 15  # bits of a row's number within its slice
_LOOSE = np.uint16(1 << _OWNERS)
INNER = b"M"
_SHORT = np.uint64(0xA0761D6478BD642F)


class Suffixes:
    """The suffixes of some texts that are ``LONG`` tokens, or a whole shorter text.

    ``place`` is where each begins in ``tokens``, ``owner`` the number of its text, ``digit``
    that of its anchor. ``starts`` are the bounds of the texts.
    """

    def __init__(self, texts: list[bytes | None], groups: list[str], hasher: WordHasher) -> None:
        words = [(text or b"").split() for text in texts]
        sizes = np.array([len(one) for one in words], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.tokens = hasher.hashes([word for one in words for word in one])
        self.salts = np.array([xxhash.xxh64_intdigest(one.encode()) for one in groups], np.uint64)
        of_token = np.repeat(np.arange(len(texts)), sizes)
        digits = windows(self.tokens, DIGIT)
        first = np.arange(max(0, len(self.tokens) - LONG + 1))
        first = first[of_token[first] == of_token[first + LONG - 1]]
        best = first
        for step in range(1, LONG - DIGIT + 1):
            best = np.where(digits[first + step] < digits[best], first + step, best)
        short = np.nonzero((sizes > 0) & (sizes < LONG))[0]
        lows = self.starts[short]
        whole = [
            windows(self.tokens[low : low + size], size)[0]
            for low, size in zip(lows.tolist(), sizes[short].tolist(), strict=True)
        ]
        whole = np.array(whole, dtype=np.uint64) + _SHORT * sizes[short].astype(np.uint64)
        place = np.concatenate([first, lows])
        order = np.argsort(place, kind="stable")
        self.place = place[order]
        self.anchor = np.concatenate([best, lows])[order]
        self.owner = of_token[self.place]
        digit = np.concatenate([digits[best], whole])[order]
        self.digit = mixed(digit ^ self.salts[self.owner]) >> np.uint64(64 - 32 - _BUCKETS)

    def heads(self, chosen: np.ndarray) -> pa.Array:
        """Group and first ``LONG`` tokens of the chosen suffixes, in bytes that sort like them."""
        place, owner = self.place[chosen], self.owner[chosen]
        at = place[:, None] + np.arange(LONG)
        inside = at < self.starts[owner + 1][:, None]
        head = np.zeros((len(place), LONG + 1), dtype=">u8")
        head[:, 0] = self.salts[owner]
        head[:, 1:][inside] = self.tokens[at[inside]]
        return _packed(head.tobytes(), np.arange(len(place) + 1) * head.itemsize * (LONG + 1))


def _packed(data: bytes, offsets: np.ndarray) -> pa.Array:
    ends = pa.py_buffer(offsets.astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, ends, pa.py_buffer(data)])


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of about 4 MB whose ``row`` (column 0) differ in the lowest ``_OWNERS`` bits only."""
    for part in text_parts(batch, text):
        base = numbers(part.column(0)) >> _OWNERS
        cuts = [0, *(np.nonzero(np.diff(base))[0] + 1).tolist(), part.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            yield part.slice(low, high - low)


def _digits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``row, group, loose, text`` to ``bucket, base, owners, digits``: all anchors, packed."""
    hasher = WordHasher()
    for batch in batches:
        for part in _slices(batch, 3):
            rows = numbers(part.column(0))
            made = Suffixes(binaries(part.column(3)), part.column(1).to_pylist(), hasher)
            if not len(made.place):
                continue
            loose = np.asarray(part.column(2).to_numpy(zero_copy_only=False), dtype=bool)
            owners = (rows & ((1 << _OWNERS) - 1)).astype("<u2") | np.where(loose, _LOOSE, 0).astype("<u2")
            new = np.concatenate([[True], made.anchor[1:] != made.anchor[:-1]])
            digit, owner = made.digit[new], owners[made.owner[new]]
            order = np.argsort(digit >> np.uint64(32), kind="stable")
            digit, owner = digit[order], owner[order]
            bucket = (digit >> np.uint64(32)).astype(np.int32)
            edges = np.concatenate([[0], np.nonzero(np.diff(bucket))[0] + 1, [len(bucket)]])
            base = int(rows[0]) >> _OWNERS << _OWNERS
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[edges[:-1]]),
                    pa.array(np.full(len(edges) - 1, base, dtype=np.int64)),
                    _packed(owner.tobytes(), edges * 2),
                    _packed(digit.astype("<u4").tobytes(), edges * 4),
                ],
                names=["bucket", "base", "owners", "digits"],
            )


def _recurring(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``row, digit, texts, loose`` of digits that different texts have, from sorted buckets."""
    for table, _ in whole_runs(batches, ["bucket"]):
        counts = numbers(pc.binary_length(table.column("digits"))) // 4
        owner = np.frombuffer(b"".join(table.column("owners").to_pylist()), "<u2")
        low = np.frombuffer(b"".join(table.column("digits").to_pylist()), "<u4")
        digit = np.repeat(numbers(table.column("bucket")) << 32, counts) | low.astype(np.int64)
        row = np.repeat(numbers(table.column("base")), counts) | (owner & (_LOOSE - 1)).astype(np.int64)
        order = np.lexsort((row, digit))
        digit, row, loose = digit[order], row[order], (owner[order] & _LOOSE) > 0
        new = np.concatenate([[True], (digit[1:] != digit[:-1]) | (row[1:] != row[:-1])])
        digit, row, loose = digit[new], row[new], loose[new]
        first = np.nonzero(np.concatenate([[True], digit[1:] != digit[:-1]]))[0]
        texts = np.diff(np.concatenate([first, [len(digit)]]))
        some = np.maximum.reduceat(loose, first)
        texts, some = np.repeat(texts, texts), np.repeat(some, texts)
        again = texts > 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(one[again]) for one in (row, digit, texts, some)],
            names=["row", "digit", "texts", "loose"],
        )


def recurring_digits(texts: DataFrame) -> DataFrame:
    """``row, digit, texts, loose``: first digits of suffixes that two texts of a group have.

    ``texts`` has ``row`` (its own for every text), ``group``, ``loose`` and ``text``. Of each
    digit the number of its texts is given, and whether one of them is ``loose``. Digits may
    agree by chance: what they select is compared token by token afterwards.
    """
    dealt = texts.select("row", "group", "loose", "text").mapInArrow(
        _digits, "bucket int, base long, owners binary, digits binary"
    )
    sorted_ = dealt.repartition("bucket").sortWithinPartitions("bucket")
    found = sorted_.mapInArrow(_recurring, "row long, digit long, texts long, loose boolean")
    return saved(found, "suffix-digits", free=True).frame


def _selected(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes of each text whose digits are among the chosen."""
    hasher = WordHasher()
    for batch in batches:
        for part in text_parts(batch, 3):
            texts = binaries(part.column(3))
            made = Suffixes(texts, part.column(1).to_pylist(), hasher)
            lines, chosen = part.column(2).to_pylist(), part.column(5).to_pylist()
            bounds = np.searchsorted(made.owner, np.arange(part.num_rows + 1))
            picked, within = [np.empty(0, np.int64)], [np.empty(0, bool)]
            for number, text in enumerate(texts):
                places = np.arange(bounds[number], bounds[number + 1])
                places = places[np.isin(made.digit[places], np.array(chosen[number], np.uint64))]
                counts = [len(line.split()) for line in text.split(b"\n")]
                inner = np.repeat(np.frombuffer(lines[number], np.uint8) == INNER[0], counts)
                total = np.concatenate([[0], np.cumsum(inner)])
                at, width = made.place[places] - made.starts[number], min(LONG, len(inner))
                picked.append(places)
                within.append(total[at + width] - total[at] == width)
            places = np.concatenate(picked)
            if len(places):
                owner = made.owner[places]
                yield pa.RecordBatch.from_arrays(
                    [
                        made.heads(places),
                        part.column(0).take(pa.array(owner)),
                        pa.array((made.place[places] - made.starts[owner]).astype(np.int32)),
                        pa.array(np.concatenate(within)),
                        part.column(4).take(pa.array(owner)),
                    ],
                    names=["suffix", "row", "at", "inside", "same"],
                )


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of neighbours in the sorted array that agree in ``LONG`` tokens.

    ``suffix, outside, inside``: the number of different texts in the run, by where it
    stands in them. A run that crosses batches gives a row for each.
    """
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        heads = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u8").reshape(-1, LONG + 1)
        inside = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=bool)
        same = numbers(batch.column(2))
        before = last or (~heads[0], inside[0], same[0])
        agree = heads == np.concatenate([before[0][None, :], heads[:-1]])
        common = np.logical_and.accumulate(agree, axis=1).sum(axis=1) - 1  # LCP; the group is no token
        starts = common < LONG
        new = starts | (inside != np.concatenate([[before[1]], inside[:-1]]))
        new |= same != np.concatenate([[before[2]], same[:-1]])
        last = heads[-1].copy(), inside[-1], same[-1]
        first = np.nonzero(starts | (np.arange(len(starts)) == 0))[0]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(first)),
                pa.array(np.add.reduceat((new & ~inside).astype(np.int64), first)),
                pa.array(np.add.reduceat((new & inside).astype(np.int64), first)),
            ],
            names=["suffix", "outside", "inside"],
        )


def repeats(texts: DataFrame) -> DataFrame:
    """``row, at, outside, inside``: suffixes that agree in ``LONG`` tokens with others.

    ``texts`` has ``row``, ``group``, ``lines`` (a byte per line of the text, ``INNER`` for the
    inner part), ``text``, ``same`` (texts with equal values count once) and the ``digits`` that
    select suffixes. ``at`` is the token where a suffix begins; ``inside`` and ``outside`` count
    the texts that have it wholly in the inner part, or not.
    """
    suffixes = saved(
        texts.select("row", "group", "lines", "text", "same", "digits").mapInArrow(
            _selected, "suffix binary, row long, at int, inside boolean, same long"
        ),
        "suffix-selected",
    ).frame
    order = ["suffix", "inside", "same"]
    runs = (
        suffixes.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(*order)
        .mapInArrow(_neighbours, "suffix binary, outside long, inside long")
        .groupBy("suffix")
        .agg(F.sum("outside").alias("outside"), F.sum("inside").alias("inside"))
        .where("outside + inside > 1")
    )
    return suffixes.select("suffix", "row", "at").join(runs, "suffix").drop("suffix")
