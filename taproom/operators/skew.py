"""Equi-joins whose hot keys are split over many tasks, exactly."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 200_000


def split_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    hot_rows: int = HOT_ROWS,
    how: str = "inner",
    tasks: int | None = None,
) -> DataFrame:
    """Join on `keys`, cutting every key with more than `hot_rows` rows of `big` into pieces.

    Rows of `big` under a hot key are dealt to pieces by the hash of the whole row; rows of `small`
    under that key are copied to each piece. Cold keys are joined as they are. The list of hot keys
    has at most rows(big)/hot_rows entries, so the helper joins stay small whatever the data, and
    Spark's adaptive execution decides from measured sizes whether to broadcast them. With `tasks`, for joins that make
    many more rows than they read, which sizes don't tell, it is `pairs_join` over so many partitions.
    """
    if tasks:
        return pairs_join(big, small, keys, tasks)
    counts = big.groupBy(*keys).count()
    hot = counts.where(F.col("count") > hot_rows).select(
        *keys, F.ceil(F.col("count") / hot_rows).cast("int").alias("_pieces")
    )
    pieces = F.coalesce(F.col("_pieces"), F.lit(1))
    left = (
        big.join(hot, keys, "left")
        .withColumn("_piece", F.pmod(F.xxhash64(*big.columns), pieces).cast("int"))
        .drop("_pieces")
    )
    right = (
        small.join(hot, keys, "left")
        .withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .drop("_pieces")
    )
    return left.join(right, [*keys, "_piece"], how).drop("_piece")


def shuffle_partitions(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def piece_count(frame: DataFrame) -> int:
    """Pieces that a key with many rows is dealt over."""
    return min(256, max(16, shuffle_partitions(frame) // 4))


def piece_join(many: DataFrame, few: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Join on `keys` that are few and have many rows each, so that every task makes about as many rows.

    Rows of `many` are dealt over the pieces of their key by the column `by`, rows of `few` are copied to each piece.
    """
    pieces, tasks = piece_count(many), shuffle_partitions(many)
    left = many.withColumn("_piece", F.pmod(F.xxhash64(by), F.lit(pieces)).cast("int"))
    right = few.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    left, right = (side.repartition(tasks, *keys, "_piece") for side in (left, right))
    return left.join(right, [*keys, "_piece"]).drop("_piece")


def grid_join(one: DataFrame, other: DataFrame, keys: list[str], by_one: str, by_other: str) -> DataFrame:
    """`piece_join` for two large sides: the pairs of a key are dealt over a square of pieces, so each side is copied to
    as many of them as the square is long, not to all."""
    tasks = shuffle_partitions(one)
    side = math.ceil(math.sqrt(piece_count(one)))
    copies = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    left = one.withColumn("_row", F.pmod(F.xxhash64(by_one), F.lit(side)).cast("int")).withColumn("_column", copies)
    right = other.withColumn("_column", F.pmod(F.xxhash64(by_other), F.lit(side)).cast("int")).withColumn("_row", copies)
    left, right = (s.repartition(tasks, *keys, "_row", "_column") for s in (left, right))
    return left.join(right, [*keys, "_row", "_column"]).drop("_row", "_column")


PACK_ROWS = 1024  # rows that one packed row holds, at most about


def _packed(few: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a key as few rows with a list of them each (`_rows`), so copies of them are small."""
    rest = [name for name in few.columns if name not in keys]
    blocks = few.groupBy(*keys).agg(F.ceil(F.count("*") / PACK_ROWS).alias("_blocks"))
    block = F.pmod(F.xxhash64(*rest), F.col("_blocks"))
    held = few.join(blocks, keys).withColumn("_block", block).groupBy(*keys, "_block")
    listed = held.agg(F.collect_list(F.struct(*rest)).alias("_rows")).drop("_block")
    # A list of plain values is a third of a list of rows of one value.
    return listed.withColumn("_rows", F.transform("_rows", lambda row: row[rest[0]])) if len(rest) == 1 else listed


def _unpacked(joined: DataFrame, columns: list[str], rest: list[str]) -> DataFrame:
    return joined.select(*columns, F.explode("_rows").alias(rest[0]) if len(rest) == 1 else F.inline("_rows"))


def packed_join(many: DataFrame, few: DataFrame, keys: list[str], by: str, each: list[Column | str] | None = None) -> DataFrame:
    """`piece_join` for pairs that are far more than the rows of both sides.

    Rows of `few` are copied to the pieces in lists and spread out as the last step, next to each row of `many`: copies
    take little, so there are more pieces and tasks are more even, and a pair costs no more than being written. `each` are
    the columns made of a row of `many` (all of it else); one may be an `explode`, done once for a list and not for each pair.
    """
    rest = [name for name in few.columns if name not in keys]
    tasks = shuffle_partitions(many)
    pieces = min(1024, max(16, 2 * tasks))
    left = _packed(few, keys).withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    right = many.withColumn("_piece", F.pmod(F.xxhash64(by), F.lit(pieces)).cast("int"))
    left, right = (side.repartition(tasks, *keys, "_piece") for side in (left, right))
    joined = left.join(right, [*keys, "_piece"])
    if each is None:
        return _unpacked(joined, many.columns, rest)
    made = joined.select("_rows", *each)
    return _unpacked(made, made.columns[1:], rest)


PIECE_PAIRS = 4_000_000  # pairs of one key that a task makes at once, about


def pairs_join(
    many: DataFrame, few: DataFrame, keys: list[str], tasks: int | None = None, piece_pairs: int = PIECE_PAIRS
) -> DataFrame:
    """Join on `keys` of which some may have very many pairs, others are many with few rows each.

    Both sides are counted first. A key is dealt over pieces by the pairs it makes, and rows of `few` under it are copied to
    them in lists (`packed_join`); all other keys are one piece. Both sides are read twice, so write what is costly.
    """
    rest = [name for name in few.columns if name not in keys]
    tasks = tasks or shuffle_partitions(many)
    counts = many.groupBy(*keys).agg(F.count("*").alias("_m")).join(few.groupBy(*keys).agg(F.count("*").alias("_f")), keys)
    pieces = F.least(F.ceil(F.col("_m").cast("double") * F.col("_f") / piece_pairs), F.lit(4 * tasks)).cast("int")
    hot = counts.withColumn("_pieces", pieces).where("_pieces > 1").select(*keys, "_pieces")
    of = F.coalesce("_pieces", F.lit(1))
    left = _packed(few, keys).join(hot, keys, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), of - 1)))
    right = many.join(hot, keys, "left").withColumn("_piece", F.pmod(F.xxhash64(*many.columns), of).cast("int"))
    left, right = (side.drop("_pieces").repartition(tasks, *keys, "_piece") for side in (left, right))
    return _unpacked(left.join(right, [*keys, "_piece"]), many.columns, rest)


def with_row(frame: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table (an ungrouped aggregate) to every row.

    The row is a scalar subquery: it is computed once and read as a constant, so nothing is joined
    or shuffled. A table of more than one row is an error.
    """
    value = row.select(F.struct(*row.columns)).scalar()
    return frame.withColumn("_one", value).select(
        *frame.columns, *[F.col("_one")[name].alias(name) for name in row.columns]
    )
