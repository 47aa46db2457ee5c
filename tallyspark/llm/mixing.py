"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size is how often each of its documents is expected in the mix.
The whole part is given to every document as certain copies. The rest is an inclusion
probability; documents are ranked by their random odds over their inclusion odds (Rosén,
"On sampling with probability proportional to size", 1997), and the first in rank that fit
the words still wanted get one copy more, with one document whose size is nearest to what
is then still missing.

The ranks of a source are never sorted in one place: words are counted per cell of the rank
scale (map-side combined), the cell that holds the end of the selection is divided again,
and only what is left of it is sorted. What comes out is one row per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.scratch import saved

WEIGHTS = (5, 2, 1)
MOST = 3  # times its size that a source or document may be taken
CELLS = 4096
_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("bigint")


def _draw(key: Column, text: Column, number: Column) -> Column:
    """A number in (0, 1) that depends on the row's values alone, so reruns agree."""
    mark = F.md5(F.coalesce(text, F.lit("")))
    parts = F.concat_ws("/", F.coalesce(key.cast("string"), F.lit("")), mark, number.cast("string"))
    digits = F.substring(F.md5(parts), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + 0.5) / float(1 << 52)


def _drawn(documents: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """``documents`` with ``__draw``, a draw of its own for every row.

    Rows that agree in id, text and source are numbered; they are alike, so it does not
    matter which has which number. Only a table with such rows is dealt out for it.
    """
    equal = [F.col(id_column), F.xxhash64(text_column), F.length(text_column), F.col(source_column)]
    repeated = documents.groupBy(*equal).count().where("count > 1")
    number = F.lit(1)
    if not repeated.isEmpty():
        number = F.row_number().over(Window.partitionBy(*equal).orderBy(F.lit(0)))
    return documents.withColumn("__draw", _draw(F.col(id_column), F.col(text_column), number))


def _rank(draw: Column, rest: Column) -> Column:
    """Random odds over inclusion odds; smaller is taken first. Null if none is to be taken."""
    odds = (draw / (1.0 - draw)) / (rest / (1.0 - rest))
    return F.when((rest > 0) & (rest < 1), odds).when(rest >= 1, F.lit(0.0))


def source_targets(
    sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST
) -> DataFrame:
    """``source, source_size, target, whole, rest, wanted`` from ``source, size``.

    Sources by code point, null last, take the weights in turn. A target stops at ``most``
    times the source's size and what is left goes to the others by weight: the level at
    which all targets together are the sum of all sizes.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    place = (F.row_number().over(order) - 1) % len(weights)
    everything = Window.partitionBy()
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighted = totals.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    ).withColumn("cap", F.col("source_size") * most)
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    sooner = filled.rowsBetween(Window.unboundedPreceding, -1)
    levels = weighted.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(sooner), F.lit(0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(sooner), F.lit(0))),
    ).withColumn("turn", F.row_number().over(filled))
    open_level = F.when(
        F.col("cap") / F.col("weight") > F.col("level"), F.struct("turn", "level")
    )
    level = F.min(open_level).over(everything)["level"]
    cap = F.col("cap").cast("double")
    target = F.coalesce(F.least(cap, level * F.col("weight")), cap)
    size = F.col("source_size")
    return (
        levels.withColumn("target", target)
        .withColumn("whole", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0))
        .withColumn("wanted", F.col("target") - F.col("whole") * size)
        .withColumn("rest", F.when(size > 0, F.col("wanted") / size).otherwise(F.lit(0.0)))
        .select("source", "source_size", "target", "whole", "rest", "wanted")
    )


def _cells(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Per cell its words, the words before it, and the last document in rank."""
    counted = ranked.groupBy(*keys, "cell").agg(
        F.sum("size").alias("here"),
        F.first("wanted").alias("wanted"),
        F.first("base").alias("base"),
        F.max(F.struct("rank", "id")).alias("last"),
    )
    sooner = (
        Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.col("base") + F.coalesce(F.sum("here").over(sooner), F.lit(0))
    return counted.withColumn("before", before).withColumn("after", before + F.col("here"))


def _ends(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, last, reached``: the last document in rank that fits, the words up to it."""
    scale = F.col("rank") / (1.0 + F.col("rank"))
    ranked = (
        sized.alias("a")
        .join(targets.where("rest > 0").alias("b"), F.expr("a.source <=> b.source"))
        .select("a.id", "a.source", "a.size", "a.draw", "b.wanted", "b.rest")
        .withColumn("rank", _rank(F.col("draw"), F.col("rest")))
        .withColumn("place", scale * CELLS)
        .withColumn("base", F.lit(0).cast("bigint"))
        .drop("rest", "draw")
    )
    found = []
    for _ in range(2):
        ranked = ranked.withColumn("cell", F.floor("place"))
        cells = saved(_cells(ranked, ["source"]), "mix-cells").frame
        found.append(cells.where("after <= wanted").select("source", "last", "after"))
        edge = cells.where("before < wanted and after > wanted")
        ranked = (
            ranked.alias("a")
            .join(edge.alias("b"), F.expr("a.source <=> b.source AND a.cell = b.cell"))
            .select("a.id", "a.source", "a.size", "a.wanted", "a.rank", "b.before", "a.place")
            .withColumnRenamed("before", "base")
            .withColumn("place", (F.col("place") - F.floor("place")) * CELLS)
        )
    within = Window.partitionBy("source").orderBy("rank", "id")
    after = F.col("base") + F.sum("size").over(
        within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found.append(
        ranked.withColumn("after", after)
        .where("after <= wanted")
        .select("source", F.struct("rank", "id").alias("last"), "after")
    )
    every = found[0].union(found[1]).union(found[2])
    return every.groupBy("source").agg(
        F.max("last").alias("last"), F.max("after").alias("reached")
    )


def _among(rank: Column, key: Column, last: Column) -> Column:
    """Not behind the last document in rank; nothing is, if there is none."""
    tie = (rank == last["rank"]) & (key.isNull() | (key <= last["id"]))
    return F.coalesce((rank < last["rank"]) | tie, F.lit(False))


def _rules(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source: all that decides about its documents."""
    ends = saved(
        targets.alias("a")
        .join(_ends(sized, targets).alias("b"), F.expr("a.source <=> b.source"), "left")
        .select(
            "a.*",
            "b.last",
            (F.col("a.wanted") - F.coalesce("b.reached", F.lit(0))).alias("missing"),
        ),
        "mix-ends",
    ).frame
    rank, off = _rank(F.col("a.draw"), F.col("b.rest")), F.abs(F.col("missing") - F.col("size"))
    fillers = (
        sized.alias("a")
        .join(ends.where("rest > 0").alias("b"), F.expr("a.source <=> b.source"))
        .where(~_among(rank, F.col("a.id"), F.col("b.last")) & (off < F.col("missing")))
        .groupBy("a.source")
        .agg(F.min(F.struct(off.alias("off"), rank.alias("rank"), "a.id")).alias("filler"))
    )
    return (
        ends.alias("a")
        .join(fillers.alias("b"), F.expr("a.source <=> b.source"), "left")
        .select(F.struct("a.*", "b.filler").alias("__rule"))
    )


def mix(
    documents: DataFrame,
    *,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """``documents`` with one column more, ``__mix``: size, source_size, target, copies, taken.

    ``size`` is the number of words; ``copies`` (0 to ``most``) says how often the mix takes
    the document and ``taken`` is copies times size. A null source is a source. Null and
    empty texts have size 0 and take 0 words. Every row has a draw of its own, also without an
    id or with one that others have; rows that are alike in id, text and source are told apart
    by a number, for which alone they are dealt out.
    Documents are not shuffled: they meet one row per source, which Spark broadcasts as
    long as that table, a written one, is small. No rows, no result. Other columns pass
    through.
    """
    drawn = _drawn(documents, id_column, text_column, source_column)
    sized = saved(
        drawn.select(
            F.col(id_column).alias("id"),
            F.col(source_column).alias("source"),
            n_words(F.col(text_column)).alias("size"),
            F.col("__draw").alias("draw"),
        ),
        "mix-sizes",
    ).frame
    targets = saved(source_targets(sized, weights, most), "mix-targets").frame
    rules = saved(_rules(sized, targets), "mix-rules").frame
    rule, key = F.col("__rule"), F.col(id_column)
    rank, filler = _rank(F.col("__draw"), rule["rest"]), rule["filler"]
    fills = (rank == filler["rank"]) & key.eqNullSafe(filler["id"])
    more = (rule["rest"] > 0) & (_among(rank, key, rule["last"]) | F.coalesce(fills, F.lit(False)))
    copies = rule["whole"] + F.when(more, 1).otherwise(0)
    size = n_words(F.col(text_column))
    return (
        drawn.join(rules, F.col(source_column).eqNullSafe(rule["source"]))
        .withColumn(
            "__mix",
            F.struct(
                size.alias("size"),
                rule["source_size"].alias("source_size"),
                rule["target"].alias("target"),
                copies.cast("bigint").alias("copies"),
                (copies * size).cast("bigint").alias("taken"),
            ),
        )
        .drop("__rule", "__draw")
    )


def taken(documents: DataFrame, **settings) -> DataFrame:
    """The mix itself: the rows of ``documents``, each as often as it is taken."""
    copies = F.col("__mix.copies").cast("int")
    return mix(documents, **settings).select(
        *documents.columns, F.explode(F.array_repeat(F.lit(0), copies)).alias("__copy")
    ).drop("__copy")
