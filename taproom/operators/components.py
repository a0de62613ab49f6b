"""Connected components, and greedy passes that are finished component by component."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taproom.session import cut

ROUNDS = 3  # parallel rounds before the rest is looked at by component
LOCAL_ROWS = 100_000  # rows of a component that one task finishes by itself


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node joined with it) for every node of links (a, b).

    Each round ties every node to the smallest of its neighbours, first over larger and then over
    smaller neighbours, so the number of rounds follows the logarithm of the longest path.
    """
    edges = cut(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )

    def state(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = state(edges)
    while seen[0]:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = cut(small.union(low.select("u", "low")).distinct())
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def finish(
    rows: DataFrame,
    one_round: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    links: Callable[[DataFrame], DataFrame],
    node: str,
    local: Callable,
    rounds: int = ROUNDS,
    local_rows: int = LOCAL_ROWS,
) -> DataFrame:
    """All rows a sequential greedy pass accepts.

    `one_round` gives (accepted, still open) and accepts only what the pass accepts. After a few rounds
    the open rows are split into components of `links` (over the column `node`); a component of at most
    `local_rows` rows is finished by `local` (a pandas function of its rows) in one task, a larger one in
    further rounds. No size ends in an error.
    """
    accepted: list[DataFrame] = []
    left, turn = rows, 0
    while True:
        chosen, left = one_round(left)
        accepted.append(chosen)
        turn += 1
        if left.isEmpty():
            break
        if turn % rounds:
            continue
        roots = components(links(left)).select(F.col("node").alias(node), F.col("root").alias("_root"))
        rooted = cut(left.join(roots, node, "left").withColumn("_root", F.coalesce("_root", F.col(node))))
        sizes = rooted.groupBy("_root").agg((F.count("*") > local_rows).alias("_large"))
        marked = cut(rooted.join(sizes, "_root"))
        small = marked.where(~F.col("_large")).drop("_large")
        solved = small.groupBy("_root").applyInPandas(local, small.schema).select(*left.columns)
        accepted.append(cut(solved))
        left = marked.where("_large").select(*left.columns)
        if left.isEmpty():
            break
    out = accepted[0]
    for more in accepted[1:]:
        out = out.unionByName(more)
    return out
