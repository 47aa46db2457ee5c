"""Near-duplicate documents by Fast Similarity Sketching, banding and exact verification.

1. One pass over the texts gives each document its set of word shingles, a 128-bit
   digest of the set, and a sketch (Dahlgaard, Knudsen, Thorup, "Fast Similarity
   Sketching", 2017): in round *i* every shingle is thrown into a random bin with value
   *i + random*, a bin keeps its smallest value, and rounds end when all bins are filled.
   After as many rounds as bins, round *bins + k* fills bin *k*, so every coordinate is
   filled. Rows of coordinates are hashed into bands.
2. Equal sets become one representative, so copies are never expanded into pairs.
3. Representatives with an equal band share a bucket. The member with the most
   bucket mates becomes the bucket's pivot, and pivots with the same name form one
   group over all bands: group size, not its square, is what is shuffled.
4. Every member is compared exactly with its pivot. What differs from the pivot (a bit
   per pivot shingle, and the shingles the pivot lacks) is all that is kept of a set.
5. Two members that both link to the pivot are connected through it. Every other pair of
   a group is compared exactly from those differences, in blocks of bounded size; a block
   emits at most one link per row.
6. Links give connected components.

A pair at similarity 0.8 shares no bucket with probability (1 - 0.8^rows)^bands, 7 in a
million at the defaults; above 0.85, below 1 in 10 million. Every link is verified.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.arrow_runs import binaries, lists, numbers, runs, text_parts
from tallyspark.llm.components import components
from tallyspark.llm.scratch import saved
from tallyspark.llm.shingles import WordHasher, mixed, shingle_sets

BANDS = 30
ROWS = 5
WORDS = 5
PERCENT = 80
_STAR_ROWS, _STAR_SHINGLES = 256, 1 << 20  # of one group in one task at a time
_BLOCK_ROWS, _BLOCK_BYTES = 256, 4 << 20  # of one side of a block
_COLUMNS = 4096  # of a block's matrices at a time
_VALUE_BITS = 40
_UNFILLED = np.int64(np.iinfo(np.int64).max)


def _thrown(shingles: np.ndarray, turn: int) -> np.ndarray:
    return mixed(shingles + np.uint64((turn + 1) * 0xD1342543DE82EF95 % 2**64))


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One row of ``bins`` values per non-empty set."""
    shingles = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(one) for one in sets])
    table = np.full((len(sets), bins), _UNFILLED, dtype=np.int64)
    flat = table.reshape(-1)
    value_mask = np.uint64((1 << _VALUE_BITS) - 1)
    for turn in range(2 * bins):
        thrown = _thrown(shingles, turn)
        value = (thrown & value_mask).astype(np.int64) + np.int64(turn << _VALUE_BITS)
        if turn < bins:
            place = ((thrown >> np.uint64(_VALUE_BITS)) * np.uint64(bins)) >> np.uint64(
                64 - _VALUE_BITS
            )
            slot = owner * bins + place.astype(np.int64)
        else:
            slot = owner * bins + (turn - bins)
        np.minimum.at(flat, slot, value)
        open_sets = (table == _UNFILLED).any(axis=1)
        still = open_sets[owner]
        if not still.any():
            break
        if not still.all():
            shingles, owner = shingles[still], owner[still]
    return table


def _bands(table: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash per band; the band's number is part of it."""
    parts = table.astype(np.uint64).reshape(len(table), bands, rows)
    keys = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for row in range(rows):
        keys = mixed(keys ^ parts[:, :, row])
    return keys.view(np.int64)


def _digest(one: np.ndarray) -> tuple[int, int]:
    whole = xxhash.xxh3_128_digest(one.tobytes())
    return tuple(np.frombuffer(whole, dtype=np.int64).tolist())


def _signatures(words: int, bands: int, rows: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for part in text_parts(batch, 1):
                sets = shingle_sets(binaries(part.column(1)), words, hasher)
                keys = np.zeros((len(sets), bands), dtype=np.int64)
                filled = [place for place, one in enumerate(sets) if len(one)]
                if filled:
                    table = sketches([sets[place] for place in filled], bands * rows)
                    keys[filled] = _bands(table, bands, rows)
                digests = [_digest(one) if len(one) else (None, None) for one in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(one) for one in sets], pa.int64()),
                        pa.array([one[0] for one in digests], pa.int64()),
                        pa.array([one[1] for one in digests], pa.int64()),
                        lists(keys, bands),
                    ],
                    names=["id", "n", "h1", "h2", "bands"],
                )

    return run


def _sets(words: int):
    """``text, h1, h2, ...`` to ``..., shingles``, for rows whose text has that digest.

    Rows of one document follow each other; its set is made once.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for part in text_parts(batch, 0):
                coded = part.column(0).dictionary_encode()
                sets = shingle_sets(binaries(coded.dictionary), words, hasher)
                digests = np.array([_digest(one) for one in sets]).reshape(-1, 2)
                place = numbers(coded.indices)
                meant = digests[place, 0] == numbers(part.column(1))
                meant &= digests[place, 1] == numbers(part.column(2))
                made = pa.array([one.tobytes() for one in sets], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(column) for column in range(3, part.num_columns)),
                        made.take(coded.indices),
                    ],
                    names=[*part.schema.names[3:], "shingles"],
                ).filter(pa.array(meant))

    return run


def _found_in(sought: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Which of the sorted values ``sought`` are among the sorted ``there``."""
    if not len(there):
        return np.zeros(len(sought), dtype=bool)
    place = np.searchsorted(there, sought)
    return there[np.minimum(place, len(there) - 1)] == sought


def _similar(common, n_a, n_b, percent: int):
    """100 * intersection >= percent * union."""
    return (100 + percent) * common >= percent * (n_a + n_b)


def _stars(percent: int):
    """Per group, pivot first: compare every member with the pivot."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["group", "salt"]):
            sets = [np.frombuffer(one, np.uint64) for one in group.column("shingles").to_pylist()]
            pivot = sets[0]
            linked, sizes, bits, added = [], [], [], []
            for one in sets[1:]:
                kept = _found_in(pivot, one)
                linked.append(bool(_similar(int(kept.sum()), len(pivot), len(one), percent)))
                sizes.append(len(one))
                bits.append(np.packbits(kept).tobytes())
                added.append(one[~_found_in(one, pivot)].tobytes())
            members = group.slice(1).combine_chunks()
            if members.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        members.column("group").combine_chunks(),
                        members.column("pivot").combine_chunks(),
                        members.column("member").combine_chunks(),
                        pa.array(linked, pa.bool_()),
                        pa.array(sizes, pa.int64()),
                        pa.array(bits, pa.binary()),
                        pa.array(added, pa.binary()),
                    ],
                    names=["group", "pivot", "member", "linked", "n", "bits", "added"],
                )

    return run


def _common_added(added: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of added shingles, for rows ``left`` by rows ``right``."""
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    values = np.concatenate(added)
    owner = np.repeat(np.arange(len(added)), [len(one) for one in added])
    order = np.argsort(values)
    values, owner = values[order], owner[order]
    again = np.concatenate([[False], values[1:] == values[:-1]])
    shared = again | np.concatenate([again[1:], [False]])  # by two rows at least
    column = np.cumsum(~again[shared]) - 1
    owner = owner[shared]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        inside = (column >= first) & (column < first + _COLUMNS)
        present = np.zeros((len(added), _COLUMNS), dtype=np.float32)
        present[owner[inside], column[inside] - first] = 1
        common += present[left] @ present[right].T
    return common


def _forest(rows: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """The pairs that connect something not yet connected."""
    root = list(range(rows))

    def find(node: int) -> int:
        while root[node] != node:
            root[node] = root[root[node]]
            node = root[node]
        return node

    chosen = []
    for a, b in pairs.tolist():
        first, second = find(a), find(b)
        if first != second:
            root[max(first, second)] = min(first, second)
            chosen.append((a, b))
    return chosen


def _blocks(percent: int):
    """Per block, compare the rows of one part of a group with those of another."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, ["group", "part_a", "part_b"]):
            part = numbers(block.column("part"))
            a, b = numbers(block.column("part_a"))[0], numbers(block.column("part_b"))[0]
            left, right = np.nonzero(part == a)[0], np.nonzero(part == b)[0]
            if not len(left) or not len(right):
                continue
            n = numbers(block.column("n"))
            bits = np.array(
                [np.frombuffer(one, np.uint8) for one in block.column("bits").to_pylist()]
            )
            common = np.zeros((len(left), len(right)), dtype=np.float32)
            for first in range(0, bits.shape[1], _COLUMNS // 8):
                slab = bits[:, first : first + _COLUMNS // 8]
                kept = np.unpackbits(slab, axis=1).astype(np.float32)
                common += kept[left] @ kept[right].T
            added = [np.frombuffer(one, np.uint64) for one in block.column("added").to_pylist()]
            sizes = np.array([len(one) for one in added])
            most = common + np.minimum(sizes[left][:, None], sizes[right][None, :])
            if _similar(most, n[left][:, None], n[right][None, :], percent).any():
                common = common + _common_added(added, left, right)
                alike = _similar(common, n[left][:, None], n[right][None, :], percent)
                rows, columns = np.nonzero(alike)
                pairs = np.stack([left[rows], right[columns]], axis=1)
                chosen = _forest(block.num_rows, pairs[pairs[:, 0] != pairs[:, 1]])
                if chosen:
                    member = block.column("member").combine_chunks()
                    ends = np.array(chosen)
                    yield pa.RecordBatch.from_arrays(
                        [member.take(pa.array(ends[:, 0])), member.take(pa.array(ends[:, 1]))],
                        names=["a", "b"],
                    )

    return run


def _groups(representatives: DataFrame) -> DataFrame:
    """``pivot, member, n``: every pivot with all that share a bucket it stands for."""
    entries = representatives.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("mates")).where("mates > 1")
    active = saved(entries.join(shared, "bucket"), "dedup-buckets").frame
    known = active.groupBy("rep").agg(F.sum("mates").alias("known"))
    pivots = (
        active.join(known, "rep")
        .groupBy("bucket")
        .agg(F.max(F.struct("known", "rep")).alias("best"))
        .select("bucket", F.col("best.rep").alias("pivot"))
    )
    return (
        active.join(pivots, "bucket")
        .select("pivot", F.col("rep").alias("member"), "n")
        .distinct()
    )


def _links(texts: DataFrame, representatives: DataFrame, words: int, percent: int) -> DataFrame:
    """``a, b``: verified links that connect what is connected."""
    kind = texts.schema["id"].dataType.simpleString()
    pairs = saved(_groups(representatives), "dedup-groups").frame
    # Written, so that the join with it has two plain sides and a hot pivot can be split.
    sizes = saved(
        pairs.groupBy("pivot").agg(
            F.greatest(
                F.ceil(F.count("*") / _STAR_ROWS), F.ceil(F.sum("n") / _STAR_SHINGLES)
            ).alias("salts")
        ),
        "dedup-sizes",
    ).frame
    digests = representatives.groupBy(F.col("rep").alias("member")).agg(
        F.min(F.struct("h1", "h2")).alias("digest")
    )
    is_pivot = F.col("member") == F.col("pivot")
    one = F.array(F.pmod(F.xxhash64("member"), F.col("salts")))
    everywhere = F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)
    wanted = pairs.join(sizes, "pivot").join(digests, "member").select(
        F.col("member").alias("id"),
        "digest.h1",
        "digest.h2",
        "pivot",
        is_pivot.alias("is_pivot"),
        F.explode(F.when(is_pivot, everywhere).otherwise(one)).alias("salt"),
    )
    whole_number = isinstance(texts.schema["id"].dataType, T.IntegralType)
    group = F.col("pivot").cast("long") if whole_number else F.xxhash64("pivot")
    stars = (
        texts.join(wanted, "id")
        .select(
            "text",
            "h1",
            "h2",
            group.alias("group"),
            "salt",
            "pivot",
            F.col("id").alias("member"),
            "is_pivot",
        )
        .mapInArrow(
            _sets(words),
            f"group long, salt long, pivot {kind}, member {kind}, is_pivot boolean, "
            "shingles binary",
        )
        .repartition("group", "salt")
        .sortWithinPartitions("group", "salt", F.desc("is_pivot"))
        .mapInArrow(
            _stars(percent),
            f"group long, pivot {kind}, member {kind}, linked boolean, n long, bits binary, "
            "added binary",
        )
    )
    compared = saved(stars, "dedup-stars").frame
    linked = compared.where("linked").select(F.col("pivot").alias("a"), F.col("member").alias("b"))

    size = F.length("bits") + F.length("added")
    parts = {
        name: F.greatest(
            F.ceil(F.count_if(test) / _BLOCK_ROWS),
            F.ceil(F.sum(F.when(test, size).otherwise(0)) / _BLOCK_BYTES),
        ).alias(name)
        for name, test in (("loose", ~F.col("linked")), ("tied", F.col("linked")))
    }
    open_groups = (
        compared.groupBy("group")
        .agg(*parts.values(), F.count("*").alias("members"))
        .where("loose > 0 and members > 1")
    )
    spread = F.xxhash64("member")
    own = F.when(
        F.col("linked"), F.col("loose") + F.pmod(spread, F.greatest("tied", F.lit(1)))
    ).otherwise(F.pmod(spread, F.col("loose")))
    last = F.when(F.col("linked"), F.col("loose")).otherwise(F.col("loose") + F.col("tied")) - 1
    blocks = (
        compared.join(open_groups, "group")
        .withColumn("part", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .select(
            "group",
            F.least("part", "other").alias("part_a"),
            F.greatest("part", "other").alias("part_b"),
            "part",
            "member",
            "n",
            "bits",
            "added",
        )
        .repartition("group", "part_a", "part_b")
        .sortWithinPartitions("group", "part_a", "part_b")
        .mapInArrow(_blocks(percent), f"a {kind}, b {kind}")
    )
    return linked.union(blocks)


def _of_ids(of_texts: DataFrame) -> DataFrame:
    """From links of (id, text) pairs to links of ids: an id connects all its texts."""
    found = saved(of_texts, "dedup-texts").frame
    pairs = found.select(F.col("id.id").alias("id"), F.col("component_id").alias("part")).distinct()
    least = pairs.groupBy("id").agg(F.min("part").alias("least"))
    classes = components(
        pairs.join(least, "id").where("part <> least").select("part", "least"), "dedup-ids"
    )
    joined = found.join(classes.withColumnRenamed("node", "component_id"), "component_id", "left")
    whole = F.coalesce("component", "component_id")["id"]
    return joined.select(
        F.col("id.id").alias("id"), "n_shingles", whole.alias("part"), (F.col("id.id") == whole).alias("kept")
    )


def near_duplicates(
    documents: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``<id>, n_shingles, component_id, kept`` for every row of ``documents``.

    Documents whose sets of ``words``-word shingles have a Jaccard similarity of at
    least ``percent`` per cent are linked; ``component_id`` is the smallest id reachable.
    A text with fewer words is one shingle. Null, empty and blank texts have no shingle
    and link with nothing. A row without an id links with nothing: its ``component_id``
    is null and it is kept. Rows that repeat an id are one document with all their texts: what
    links with one of them links with the id. No rows, no result. Other columns are ignored,
    whatever their names.
    """
    texts = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    signatures = saved(
        texts.mapInArrow(
            _signatures(words, bands, rows),
            f"id {kind}, n long, h1 long, h2 long, bands array<long>",
        ),
        "dedup-signatures",
    ).frame
    known = signatures.where("n > 0 and id is not null")
    digest = F.struct("h1", "h2", "n")
    clashes = known.groupBy("id").agg(F.min(digest).alias("a"), F.max(digest).alias("b"))
    if not clashes.where("a <> b").isEmpty():
        of_texts = near_duplicates(
            texts.where("id is not null").select(
                F.struct("id", F.xxhash64("text").alias("mark")).alias("id"), "text"
            ),
            id_column="id",
            words=words,
            percent=percent,
            bands=bands,
            rows=rows,
        )
        without_id = signatures.where("id is null")
        return _of_ids(of_texts).union(
            without_id.select("id", "n", F.lit(None).cast(kind), F.lit(True))
        ).toDF(id_column, "n_shingles", "component_id", "kept")
    representatives = saved(
        signatures.where("n > 0 and id is not null")
        .groupBy("h1", "h2", "n")
        .agg(F.min("id").alias("rep"), F.first("bands").alias("bands")),
        "dedup-sets",
    ).frame
    links = _links(texts.where("id is not null"), representatives, words, percent)
    classes = components(links, "dedup-links")
    of_set = (
        representatives.select("h1", "h2", "rep")
        .join(classes.withColumnRenamed("node", "rep"), "rep", "left")
        .select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    )
    named = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return (
        signatures.select("id", "n", "h1", "h2")
        .join(of_set, ["h1", "h2"], "left")
        .select(
            F.col("id").alias(id_column),
            F.col("n").alias("n_shingles"),
            named.alias("component_id"),
            F.coalesce(F.col("id") == named, F.lit(True)).alias("kept"),
        )
    )
