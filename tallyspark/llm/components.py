"""Connected components by alternating stars.

Each round hooks every node to the smallest node it sees (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014). Minima are map-side combined and edges
are joined, so a node with very many neighbours is never gathered in one place. The
edges of a round are written, so a lost executor never repeats earlier rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.scratch import Table, saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Link all larger neighbours of a node to the smallest node beside it."""
    both = edges.union(edges.select("low", "high")).toDF("node", "other")
    least = both.groupBy("node").agg(F.min("other").alias("seen"))
    least = least.select("node", F.least("node", "seen").alias("least"))
    return (
        both.join(least, "node")
        .where(F.col("other") > F.col("node"))
        .select(F.col("other").alias("high"), F.col("least").alias("low"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("high").agg(F.min("low").alias("least"))
    moved = (
        edges.join(least, "high")
        .where(F.col("low") != F.col("least"))
        .select(F.col("low").alias("high"), F.col("least").alias("low"))
    )
    return moved.union(least.toDF("high", "low")).distinct()


def _state(edges: DataFrame) -> tuple:
    digest = F.xxhash64("high", "low")
    return tuple(edges.agg(F.count("*"), F.bit_xor(digest), F.sum(digest % 1_000_003)).first())


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node, component`` for every node of ``edges`` that is not the smallest of its own.

    ``edges`` has two columns of one sortable type. Loops, repeats and nulls count for
    nothing; without edges the result is empty. A node that is missing is its own
    component, as is the smallest node of each component.
    """
    a, b = (F.col(name) for name in edges.columns)
    ordered = (
        edges.where(a != b)
        .select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))
        .distinct()
    )
    current: Table = saved(ordered, label)
    state = _state(current.frame)
    while state[0]:
        following = saved(_small_star(_large_star(current.frame)), label)
        current.discard()
        before, current, state = state, following, _state(following.frame)
        if state == before:
            break
    return current.frame.toDF("node", "component")
