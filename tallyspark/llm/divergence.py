"""Source divergence audit: which sources of a language use its terms unlike each other.

Terms are counted by length-bucketed packing. A task finds the bounds of all terms of a
slice of texts at once and deals them out by length: terms of at most 8 bytes become one
big-endian uint64, of at most 16 bytes two, and these are radix-sorted (16 bits a pass)
and run-counted as numbers; longer terms are sorted as bytes, one bucket per length. A task
keeps the counted runs, merges them when they have grown, and passes them on when merging
no longer helps, so its memory is bounded; Spark adds up what the tasks found.

Counts become smoothed shares (parts in 10^9). Source pairs are compared in cells: some
thousand terms of a language by two blocks of sources. A cell is a small matrix and gives
one partial sum per pair of sources, never a row per term and pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.arrow_runs import binaries, numbers, runs, text_parts
from tallyspark.llm.byte_terms import LETTERS, lowering_table, term_bounds
from tallyspark.llm.radix import radix_order, starts_of_runs
from tallyspark.llm.scratch import saved

MIN_DOCS = 3
RANKS = 200
SCALE = 1_000_000_000
_HELD = 1 << 20  # counted runs that a task keeps of one bucket
_CELL_TERMS = 2048
_CELL_SOURCES = 256
_COUNTED = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("term", pa.binary())]
    + [("n", pa.int64()), ("docs", pa.int64())]
)


def run_counts(
    keys: list[np.ndarray], n: np.ndarray, docs: np.ndarray
) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Different rows of ``keys`` with their sums of ``n`` and ``docs``."""
    if not len(n):
        return keys, n, docs
    order = radix_order(keys)
    keys = [key[order] for key in keys]
    starts = starts_of_runs(keys)
    return (
        [key[starts] for key in keys],
        np.add.reduceat(n[order], starts),
        np.add.reduceat(docs[order], starts),
    )


def packed(joined: np.ndarray, starts: np.ndarray, lengths: np.ndarray, words: int):
    """Terms of at most 8 * ``words`` bytes as that many numbers; unused bytes are zero."""
    wide = np.lib.stride_tricks.sliding_window_view(joined, 8 * words)[starts]
    found = []
    for word in range(words):
        value = np.ascontiguousarray(wide[:, 8 * word : 8 * word + 8]).view(">u8")[:, 0]
        unused = 8 * np.clip(8 * (word + 1) - lengths, 0, 8)
        shift = np.minimum(unused, 63).astype(np.uint64)
        cut = (value.astype(np.uint64) >> shift) << shift
        found.append(np.where(unused == 64, np.uint64(0), cut))
    return found


class _Bucket:
    """Counted runs of one length class: group, words, n, docs."""

    def __init__(self, words: int) -> None:
        self.words = words
        self.parts: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, group: np.ndarray, doc: np.ndarray, values: list[np.ndarray]) -> None:
        """Count single terms: first per document, then per group."""
        ones = np.ones(len(doc), dtype=np.int64)
        keys, n, docs = run_counts([*values, doc], ones, ones)
        docs = np.ones(len(n), dtype=np.int64)
        self.keep(run_counts([group[keys[-1]], *keys[:-1]], n, docs))

    def keep(self, part) -> None:
        self.parts.append(part)
        self.rows += len(part[1])

    def merged(self):
        if not self.parts:
            nothing = np.empty(0, dtype=np.int64)
            return [nothing.astype(np.uint64)] * (self.words + 1), nothing, nothing
        columns = [np.concatenate(column) for column in zip(*(p[0] for p in self.parts))]
        n, docs = (np.concatenate([part[at] for part in self.parts]) for at in (1, 2))
        whole = run_counts(columns, n, docs)
        self.parts, self.rows = [], 0
        return whole

    def terms(self, values: list[np.ndarray]) -> list[bytes]:
        rows = np.stack(values, axis=1).astype(">u8")
        return rows.view(f"S{8 * self.words}")[:, 0].tolist()


class _LongBucket:
    """Counted longer terms, sorted as bytes, one bucket per length."""

    def __init__(self) -> None:
        self.found: dict[tuple[int, bytes], list[int]] = {}
        self.size = 0

    def add(self, joined, starts, lengths, doc, group) -> None:
        for length in np.unique(lengths).tolist():
            here = np.nonzero(lengths == length)[0]
            rows = np.lib.stride_tricks.sliding_window_view(joined, length)[starts[here]]
            same, code = np.unique(np.ascontiguousarray(rows).view(f"S{length}")[:, 0], return_inverse=True)
            ones = np.ones(len(here), dtype=np.int64)
            keys, n, docs = run_counts([code.astype(np.uint64), doc[here]], ones, ones)
            docs = np.ones(len(n), dtype=np.int64)
            keys, n, docs = run_counts([group[keys[1]], keys[0]], n, docs)
            for g, at, a, b in zip(keys[0].tolist(), keys[1].tolist(), n.tolist(), docs.tolist()):
                key = (g, bytes(same[at]))
                held = self.found.get(key)
                if held is None:
                    self.found[key] = [a, b]
                    self.size += 200 + length
                else:
                    held[0] += a
                    held[1] += b


def _count_terms():
    table = lowering_table(LETTERS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple, int] = {}
        short, middle, long = _Bucket(1), _Bucket(2), _LongBucket()

        def rows(groups, terms, n, docs) -> pa.RecordBatch:
            of = list(names)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([of[g][0] for g in groups], pa.string()),
                    pa.array([of[g][1] for g in groups], pa.string()),
                    pa.array(terms, pa.binary()),
                    pa.array(n, pa.int64()),
                    pa.array(docs, pa.int64()),
                ],
                schema=_COUNTED,
            )

        def passed_on(last: bool) -> Iterator[pa.RecordBatch]:
            for bucket in (short, middle):
                if not bucket.parts or not last and bucket.rows < _HELD:
                    continue
                keys, n, docs = bucket.merged()
                if last or len(n) > _HELD // 2:
                    for low in range(0, len(n), 1 << 16):
                        cut = slice(low, low + (1 << 16))
                        terms = bucket.terms([key[cut] for key in keys[1:]])
                        yield rows(keys[0][cut].tolist(), terms, n[cut], docs[cut])
                else:
                    bucket.keep((keys, n, docs))
            if long.found and (last or long.size > (32 << 20)):
                found = list(long.found.items())
                for low in range(0, len(found), 1 << 12):
                    cut = found[low : low + (1 << 12)]
                    groups, terms = zip(*(key for key, _ in cut))
                    n, docs = zip(*(value for _, value in cut))
                    yield rows(groups, terms, n, docs)
                long.found, long.size = {}, 0

        for batch in batches:
            for part in text_parts(batch, 2):
                texts = [(text or b"").translate(table) for text in binaries(part.column(2))]
                group = np.array(
                    [
                        names.setdefault(name, len(names))
                        for name in zip(part.column(0).to_pylist(), part.column(1).to_pylist())
                    ],
                    dtype=np.uint32,
                )
                joined = np.frombuffer(b" ".join(texts) + b" " * 16, dtype=np.uint8)
                ends = np.cumsum(np.array([len(text) + 1 for text in texts]))
                starts, lengths = term_bounds(joined)
                doc = np.searchsorted(ends, starts, side="right").astype(np.uint32)
                for bucket, low, high in ((short, 1, 8), (middle, 9, 16)):
                    here = np.nonzero((lengths >= low) & (lengths <= high))[0]
                    if len(here):
                        values = packed(joined, starts[here], lengths[here], bucket.words)
                        bucket.add(group, doc[here], values)
                here = lengths > 16
                long.add(joined, starts[here], lengths[here], doc[here], group)
                yield from passed_on(last=False)
        yield from passed_on(last=True)

    return run


def term_counts(documents: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents, from ``lang, source, text``."""
    counted = documents.mapInArrow(
        _count_terms(), "lang string, source string, term binary, n long, docs long"
    )
    return (
        counted.withColumn("term", F.col("term").cast("string"))
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )


def _share(n: Column, everything: Column) -> Column:
    """1 + floor(10^9 * (n + 1) / everything), without overflow."""
    scaled = (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(
        everything > 0, 1 + F.call_function("div", scaled, everything.cast("decimal(20,0)"))
    )


def _excess(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _cells():
    """Per cell, the partial sums of all pairs of its sources."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs(batches, ["place", "chunk", "part_a", "part_b"]):
            first = {name: numbers(cell.column(name).slice(0, 1))[0] for name in cell.schema.names if name not in ("term", "p")}
            code, p = numbers(cell.column("code")), numbers(cell.column("p"))
            base = numbers(cell.column("p0"))
            term = cell.column("term").combine_chunks()
            codes, row = np.unique(code, return_inverse=True)
            zero = np.zeros(len(codes), dtype=np.int64)
            zero[row] = base
            filled = ~np.asarray(term.is_null())
            kinds = term.filter(pa.array(filled)).dictionary_encode()
            width = len(kinds.dictionary)
            if not width:
                continue
            shares = np.repeat(zero[:, None], width, axis=1)
            shares[row[filled], numbers(kinds.indices)] = p[filled]
            a, b = int(first["part_a"]), int(first["part_b"])
            part = codes // _CELL_SOURCES
            for one, other in {(a, b), (b, a)}:
                left, right = np.nonzero(part == one)[0], np.nonzero(part == other)[0]
                if not len(right):
                    continue
                for at in left.tolist():
                    off = shares[at][None, :] - shares[right]
                    sums = (off * off // shares[right]).sum(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(right), first["place"]), pa.int64()),
                            pa.array(np.full(len(right), codes[at]), pa.int64()),
                            pa.array(codes[right], pa.int64()),
                            pa.array(sums, pa.int64()),
                            pa.array(np.full(len(right), width), pa.int64()),
                        ],
                        names=["place", "code", "other", "partial", "terms"],
                    )

    return run


def _pair_sums(counts: DataFrame, sources: DataFrame) -> DataFrame:
    """``place, code, other, partial, terms`` summed over all cells."""
    last = F.floor((F.col("sources") - 1) / _CELL_SOURCES)
    own = F.floor(F.col("code") / _CELL_SOURCES)

    def dealt(rows: DataFrame) -> DataFrame:
        return (
            rows.withColumn("own", own)
            .withColumn("mate", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
            .select(
                "place",
                "chunk",
                F.least("own", "mate").alias("part_a"),
                F.greatest("own", "mate").alias("part_b"),
                "code",
                "p0",
                "term",
                "p",
            )
        )

    chunks = F.ceil(F.col("v") / _CELL_TERMS)
    heads = sources.where("v > 0").select(
        "*",
        F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)).alias("chunk"),
        F.lit(None).cast("string").alias("term"),
        F.lit(0).cast("bigint").alias("p"),
    )
    found = counts.withColumn("chunk", F.pmod(F.xxhash64("term"), chunks))
    keys = ["place", "chunk", "part_a", "part_b"]
    return (
        dealt(heads)
        .unionByName(dealt(found))
        .repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(_cells(), "place long, code long, other long, partial long, terms long")
        .groupBy("place", "code", "other")
        .agg(F.sum("partial").alias("partial"), F.sum("terms").alias("terms"))
    )


def audit(
    documents: DataFrame,
    *,
    text_column: str = "text",
    lang_column: str = "lang",
    source_column: str = "source",
    min_docs: int = MIN_DOCS,
    ranks: int = RANKS,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from the others.

    Each language keeps the terms that at least ``min_docs`` of its documents hold. Part
    ``pair`` has a row per other source of the language: the sum over all kept terms of
    floor((p - q)^2 / q), 0 if no term is kept. Part ``term`` has the ``ranks`` terms that
    the source uses most beyond its language.

    Null text, language and source are read as empty; every row is a document, so repeated
    rows count again. A group without terms has pairs and no terms. Equal values rank by
    the item's UTF-8 bytes. A language with one source has no pairs. No rows, no result.
    Other columns are ignored, whatever their names.
    """
    texts = documents.select(
        *(
            F.coalesce(F.col(column).cast("string"), F.lit("")).alias(name)
            for name, column in (("lang", lang_column), ("source", source_column), ("text", text_column))
        )
    )
    counted = saved(term_counts(texts), "audit-counts").frame
    kept = saved(
        counted.groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
        .where(F.col("docs") >= min_docs),
        "audit-terms",
    ).frame
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    in_groups = counted.join(kept.select("lang", "term", "lang_n"), ["lang", "term"])
    totals = in_groups.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    within = Window.partitionBy("lang").orderBy("source")
    sources = saved(
        texts.select("lang", "source")
        .distinct()
        .join(langs, "lang", "left")
        .join(totals, ["lang", "source"], "left")
        .na.fill(0, ["v", "lang_total", "total"])
        .select(
            "lang",
            "source",
            "v",
            (F.col("lang_total") + F.col("v")).alias("lang_all"),
            (F.col("total") + F.col("v")).alias("all"),
            F.xxhash64("lang").alias("place"),
            (F.row_number().over(within) - 1).cast("bigint").alias("code"),
            F.count("*").over(Window.partitionBy("lang")).alias("sources"),
        )
        .withColumn("p0", _share(F.lit(0), F.col("all"))),
        "audit-sources",
    ).frame
    shares = saved(
        in_groups.join(sources, ["lang", "source"]).select(
            *sources.columns,
            "term",
            _share(F.col("n"), F.col("all")).alias("p"),
            _share(F.col("lang_n"), F.col("lang_all")).alias("q"),
        ),
        "audit-shares",
    ).frame

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (
        shares.where("p > q")
        .select(
            "lang",
            "source",
            F.lit("term").alias("part"),
            F.col("term").alias("item"),
            _excess(F.col("p"), F.col("q")).alias("value"),
        )
        .withColumn("rank", F.row_number().over(by_value))
        .where(F.col("rank") <= ranks)
    )
    sums = _pair_sums(shares.drop("q"), sources)
    unseen = (F.col("v") - F.coalesce("terms", F.lit(0))) * _excess(F.col("p0"), F.col("q0"))
    pairs = (
        sources.join(
            sources.select("lang", *(F.col(c).alias(n) for c, n in (("source", "item"), ("code", "other"), ("p0", "q0")))),
            "lang",
        )
        .where("code <> other")
        .join(sums, ["place", "code", "other"], "left")
        .select(
            "lang",
            "source",
            F.lit("pair").alias("part"),
            "item",
            F.when(F.col("v") > 0, F.coalesce("partial", F.lit(0)) + unseen)
            .otherwise(0)
            .cast("bigint")
            .alias("value"),
        )
        .withColumn("rank", F.row_number().over(by_value))
    )
    return terms.unionByName(pairs)
