"""Ranked lexical search by sequential reads of impact-sorted lists (NRA).

Fagin, Lotem and Naor ("Optimal aggregation algorithms for middleware", 2001) read every
term's list from its highest contribution down and never look a document up. What has been
read of a document is its lower bound; adding the next unread contribution (the bar) of
each list in which it has not been seen gives its upper bound.

1. One pass over the documents makes the postings of the terms that are asked for.
2. Counts per term and level of contribution (map-side combined) cut each list into blocks
   that grow fourfold. The postings are written by block, so a round reads one block of
   all lists, in order of contribution, and no list is ever sorted in one place.
3. A round adds its block to the score intervals. While an item is open, every document
   of its lists is admitted. It closes when no unseen document can reach its k-th
   lower bound; from then on a block is read for the remaining candidates alone, and
   those whose upper bound falls below the k-th lower one leave.
4. An item is resolved when all its remaining candidates are known exactly; so membership,
   ties and final scores are. Rounds end when every item is; their number grows with the
   logarithm of the longest list.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.arrow_runs import binaries, text_parts
from tallyspark.llm.byte_terms import LETTERS_AND_DIGITS, lowering_table
from tallyspark.llm.scratch import Table, saved

TOP = 10
FIRST_BLOCK = 256  # postings of a list in its first block, about
GROWTH = 4
_LEVELS = 1024
_BITS = 60  # places per number of seen lists


def _term_counts():
    """``row, text`` (a row's key, of any type) to ``row, n, terms, tfs``: the terms of a text with their counts."""
    table = lowering_table(LETTERS_AND_DIGITS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, 1):
                found = [
                    Counter((text or b"").translate(table).split())
                    for text in binaries(part.column(1))
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([sum(one.values()) for one in found], pa.int64()),
                        pa.array([list(one) for one in found], pa.list_(pa.binary())),
                        pa.array([list(one.values()) for one in found], pa.list_(pa.int64())),
                    ],
                    names=["row", "n", "terms", "tfs"],
                )

    return run


def _counted(texts: DataFrame) -> DataFrame:
    return texts.mapInArrow(_term_counts(), "row {}, n long, terms array<binary>, tfs array<long>".format(
        texts.schema["row"].dataType.simpleString()))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _found(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per document (``id, n``, no term) and one per posting that is asked for.

    All from one pass that numbers the documents. A document's own row has a key of its own
    in the join with the terms, so a join by shuffle deals those rows out evenly.
    """
    none = F.struct(F.lit(None).cast("binary").alias("term"), F.lit(0).cast("bigint").alias("tf"))
    counted = (
        _counted(documents.select(F.col("id").alias("row"), "text"))
        .withColumnRenamed("row", "id")
        .withColumn("row", F.monotonically_increasing_id())
    )
    pairs = F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))
    rows = counted.select(
        "row", "id", "n", F.explode(F.concat(F.array(none), pairs)).alias("pair")
    ).select("row", "id", "n", "pair.term", "pair.tf")
    own_key = F.concat(F.lit("\0"), F.col("row").cast("string")).cast("binary")
    asked = wanted.select(F.col("term").alias("key")).distinct().withColumn("asked", F.lit(True))
    return (
        rows.withColumn("key", F.coalesce("term", own_key))
        .join(asked, "key", "left")
        .where("term is null or asked")
        .select("row", F.when(F.col("term").isNull(), F.col("id")).alias("id"), "n", "term", "tf")
    )


def _lists(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``row, term, part, block`` of all postings, and ``term, block, top`` of their lists.

    ``part`` is what a posting adds to a score; it is never 0. ``top`` is the highest
    of a block.
    """
    all_docs, all_terms = (
        found.where("term is null and n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    )
    postings = found.where("term is not null")
    ratio = F.lit(2.0 * all_docs + 2) / (2 * F.col("df") + 1)
    weights = postings.groupBy("term").agg(F.count("*").alias("df")).select(
        "term", F.floor(1000 * F.log(ratio)).alias("w")
    )
    m = 10 + _div(90 * F.col("n") * F.lit(all_docs), F.lit(max(all_terms, 1)))
    impact = _div(1_000_000_000 * F.col("tf"), 1000 * F.col("tf") + 8 * m)
    parts = (
        postings.join(saved(weights, "search-weights").frame, "term")
        .select(
            "row",
            "term",
            (F.col("w") * impact).alias("part"),
            _div(impact * _LEVELS, F.lit(1_000_000)).alias("level"),
        )
        .where("part > 0")
    )
    levels = parts.groupBy("term", "level").agg(F.count("*").alias("here"), F.max("part").alias("top"))
    higher = (
        Window.partitionBy("term").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("here").over(higher), F.lit(0))
    turn = F.log(before * (GROWTH - 1) / FIRST_BLOCK + 1) / F.log(F.lit(float(GROWTH)))
    blocks = saved(
        levels.withColumn("block", F.floor(turn + 1e-9).cast("int")), "search-levels"
    ).frame
    return (
        parts.join(blocks.select("term", "level", "block"), ["term", "level"]).drop("level"),
        blocks.groupBy("term", "block").agg(F.max("top").alias("top")),
    )


class _Seen:
    """The lists in which a document was seen, as bits of as many numbers as items need."""

    def __init__(self, places: int) -> None:
        self.columns = [f"seen{at}" for at in range(max(1, -(-places // _BITS)))]

    def of(self, place: Column) -> list[Column]:
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % _BITS).cast("int"))
        word = F.floor(place / _BITS)
        return [F.when(word == at, bit).otherwise(0).alias(c) for at, c in enumerate(self.columns)]

    def holds(self, place: Column) -> Column:
        word = F.get(F.array(*self.columns), F.floor(place / _BITS).cast("int"))
        return F.bit_get(word, (place % _BITS).cast("int")) == 1


def _bars(wanted: DataFrame, tops: DataFrame, block: int) -> DataFrame:
    """``item, bars, unseen``: after ``block``, the bar of each list by place, and their sum."""
    after = tops.where(F.col("block") > block).groupBy("term").agg(F.max("top").alias("bar"))
    place = F.struct("place", F.coalesce("bar", F.lit(0)).alias("bar"))
    return (
        wanted.join(after, "term", "left")
        .groupBy("item")
        .agg(F.sort_array(F.collect_list(place)).alias("places"), F.sum(place["bar"]).alias("unseen"))
        .select("item", "places", "unseen")
    )


def _resolve(wanted: DataFrame, postings: DataFrame, tops: DataFrame, k: int) -> list[Table]:
    """``item, row, score`` of every document that can be among the first ``k`` of an item."""
    blocks = [row["block"] for row in tops.select("block").distinct().orderBy("block").collect()]
    places = wanted.agg(F.max("place")).first()[0]
    seen = _Seen((places or 0) + 1)
    keys, held = ["item", "row"], ["lower", *seen.columns]
    state: Table | None = None
    done: list[Table] = []
    for block in blocks:
        here = postings.where(F.col("block") == block)
        if state is None:
            fresh, known = here.join(wanted, "term"), []
        else:
            missing = (
                live.where("closed")
                .join(wanted, "item")
                .where(~seen.holds(F.col("place")))
                .select(*keys, "place", "term")
            )
            still_open = wanted.join(limits.where("not closed").select("item"), "item", "left_semi")
            fresh = here.join(still_open, "term").select(*keys, "place", "part")
            fresh = fresh.union(here.join(missing, ["term", "row"]).select(*keys, "place", "part"))
            remaining = live.join(wanted.select("item").distinct(), "item", "left_semi")
            known = [remaining.select(*keys, *held)]
        rows = fresh.select(*keys, F.col("part").alias("lower"), *seen.of(F.col("place")))
        for more in known:
            rows = rows.union(more)
        intervals = saved(
            rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in held)), "search-intervals"
        )
        if state:
            state.discard()
        state = intervals
        first = Window.partitionBy("item").orderBy(F.desc("lower"))
        threshold = (
            state.frame.select("item", "lower")
            .withColumn("turn", F.row_number().over(first))
            .where(F.col("turn") <= k)
            .groupBy("item")
            .agg(F.when(F.count("*") == k, F.min("lower")).otherwise(0).alias("least"))
        )
        limits = saved(
            _bars(wanted, tops, block)
            .join(threshold, "item")
            .withColumn("closed", F.expr("unseen < least or unseen = 0")),
            "search-limits",
        ).frame
        nothing = F.lit(0).cast("bigint")
        unread = F.aggregate(
            "places", nothing, lambda a, b: a + F.when(seen.holds(b["place"]), nothing).otherwise(b["bar"])
        )
        live = (
            state.frame.join(limits, "item")
            .withColumn("upper", F.col("lower") + unread)
            .where("not closed or upper >= least")
            .select(*keys, *held, "upper", "closed")
        )
        exact = (
            live.groupBy("item")
            .agg(F.bool_and(F.col("closed") & (F.col("upper") == F.col("lower"))).alias("exact"))
            .where("exact")
        )
        done.append(
            saved(
                live.join(exact, "item", "left_semi").select(*keys, F.col("lower").alias("score")),
                "search-done",
            )
        )
        resolved = done[-1].frame.select("item").distinct()
        wanted = saved(wanted.join(resolved, "item", "left_anti"), "search-wanted").frame
        if not wanted.take(1):
            break
    return done


def search(
    documents: DataFrame,
    queries: DataFrame,
    *,
    k: int = TOP,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    query_column: str = "text",
) -> DataFrame:
    """``<item>, rank, <id>, score``: each item's ``k`` best documents with a score above 0.

    Terms are runs of ASCII letters, digits and characters outside ASCII, with A-Z in lower
    case. Rows of ``queries`` that share an item id (null is one) are one item, asked for each
    of its terms once. Every row of ``documents`` is a document of its own: repeated ids and
    texts stand side by side. Null and empty texts have no terms: such a document counts
    for nothing, such an item has no rows. Equal scores rank by ascending id, a null id last.
    Empty tables give no rows. Other columns are ignored, whatever their names.
    """
    items = saved(
        queries.select(F.col(item_column).alias("item_id"))
        .distinct()
        .withColumn("item", F.monotonically_increasing_id()),
        "search-items",
    ).frame
    asked = (
        queries.select(F.col(item_column).alias("asked_id"), F.col(query_column).alias("text"))
        .join(items, F.col("asked_id").eqNullSafe(F.col("item_id")))
        .select(F.col("item").alias("row"), "text")
    )
    by_term = Window.partitionBy("item").orderBy("term")
    wanted = saved(
        _counted(asked)
        .select(F.col("row").alias("item"), F.explode("terms").alias("term"))
        .distinct()
        .withColumn("place", F.row_number().over(by_term) - 1),
        "search-wanted",
    ).frame
    texts = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    found = saved(_found(texts, wanted), "search-found")
    lists, tops = _lists(found.frame)
    postings = saved(lists, "search-postings", by="block")
    done = _resolve(wanted, postings.frame, saved(tops, "search-tops").frame, k)
    postings.discard()
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    scores = [one.frame for one in done] or [
        wanted.select("item", F.lit(0).cast("bigint").alias("row"), F.lit(0).cast("bigint").alias("score")).limit(0)
    ]
    return (
        reduce(DataFrame.union, scores)
        .join(found.frame.where("term is null").select("row", "id"), "row")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .join(items, "item")
        .select(
            F.col("item_id").alias(item_column), "rank", F.col("id").alias(id_column), "score"
        )
    )
