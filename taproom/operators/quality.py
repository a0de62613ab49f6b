"""Validation, duplicate detection, coverage and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taproom import vocab as V
from taproom.operators import components
from taproom.session import cut

Rule = tuple[str, Column, str]


def issues(rules: list[Rule]) -> Column:
    """Messages of the rules a row breaks, as "column: message"; unknown counts as broken."""
    return F.array_compact(
        F.array(
            *[
                F.when(~F.coalesce(test, F.lit(False)), F.lit(f"{column}: {message}"))
                for column, test, message in rules
            ]
        )
    )


def missing_columns(frame: DataFrame, required: tuple[str, ...]) -> list[str]:
    return sorted(set(required) - set(frame.columns))


def require_columns(frame: DataFrame, required: tuple[str, ...]) -> None:
    missing = missing_columns(frame, required)
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")


def first_accepted(rows: DataFrame, order: str, keys: list[str], local_rows: int = components.LOCAL_ROWS):
    """Add `duplicate`: the row shares a key with a row accepted earlier in the order.

    Rejected rows do not block later ones. In a round a row that comes first under all its keys
    among the undecided rows is accepted, and undecided rows sharing a key with an accepted one are
    rejected. First-of-key is a partial aggregate joined on the unique row order, so a key shared
    by very many rows is never gathered in one task. Chains of rows that block each other are finished
    by component.
    """

    def one_round(left: DataFrame) -> tuple[DataFrame, DataFrame]:
        fresh = left.select(order)
        for key in keys:
            first = left.groupBy(key).agg(F.min(order).alias(order)).select(order)
            fresh = fresh.join(first, order, "left_semi")
        chosen = cut(left.join(fresh, order, "left_semi"))
        rest = left
        for key in keys:
            rest = rest.join(chosen.select(key), key, "left_anti")
        return chosen, cut(rest)

    def links(left: DataFrame) -> DataFrame:
        parts = [
            left.join(left.groupBy(key).agg(F.min(order).alias("_first")), key).select(
                F.col(order).alias("a"), F.col("_first").alias("b")
            )
            for key in keys
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        return out

    def local(group):
        group = group.sort_values(order, kind="stable")
        seen, keep = [set() for _ in keys], []
        for values in zip(*[group[key] for key in keys], strict=True):
            free = not any(v in known for v, known in zip(values, seen, strict=True))
            keep.append(free)
            if free:
                for v, known in zip(values, seen, strict=True):
                    known.add(v)
        return group[keep]

    accepted = components.finish(
        cut(rows.select(order, *keys)), one_round, links, order, local, local_rows=local_rows
    )
    mark = accepted.select(order).withColumn("_accepted", F.lit(True))
    return rows.join(mark, order, "left").withColumn("duplicate", F.col("_accepted").isNull()).drop(
        "_accepted"
    )


def import_counts(checked: DataFrame) -> DataFrame:
    """total, valid, invalid, duplicate rows and whether the import is clean (one row)."""
    invalid = F.size("issues") > 0
    return checked.agg(
        F.count("*").alias("totalRows"),
        F.count_if(~invalid & ~F.col("duplicate")).alias("validRows"),
        F.count_if(invalid).alias("invalidRows"),
        F.count_if(~invalid & F.col("duplicate")).alias("duplicateRows"),
        (F.count_if(invalid | F.col("duplicate")) == 0).alias("isClean"),
    )


def coverage(venues: DataFrame, facts: tuple[str, ...] = V.FACTS) -> DataFrame:
    """Known and positive count and share per fact: one pass, then a reshape of one row."""
    wide = venues.agg(
        F.count("*").alias("_all"),
        *[F.struct(F.count(f).alias("k"), F.count_if(F.col(f)).alias("t")).alias(f) for f in facts],
    )
    rows = F.array(
        *[
            F.struct(F.lit(f).alias("fact"), F.col(f)["k"].alias("known"), F.col(f)["t"].alias("positive"))
            for f in facts
        ]
    )
    long = wide.select("_all", F.explode(rows).alias("r"))
    return long.select(
        "r.*", F.round(F.col("r.known") / F.col("_all"), 4).alias("knownShare")
    )


def row_hash(columns: list[str]) -> Column:
    """Hash of one row's values."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def fingerprint(frame: DataFrame, columns: list[str], buckets: int = 4096) -> DataFrame:
    """Order-free hash of a table.

    Rows are hashed, summed per hash prefix into counts and exact decimal sums (a partial
    aggregate, no list of all hashes), and the fixed number of bucket lines is hashed once more.
    """
    hashed = frame.select(row_hash(columns).alias("h"))
    part = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    tail = F.conv(F.substring("h", 9, 12), 16, 10).cast("decimal(38,0)")
    summed = hashed.groupBy((part % buckets).alias("b")).agg(
        F.count("*").alias("n"), F.sum(tail).alias("s")
    )
    lines = F.array_sort(
        F.collect_list(F.concat_ws(":", F.lpad(F.col("b").cast("string"), 6, "0"), "n", "s"))
    )
    return summed.agg(F.sha2(F.concat_ws(",", lines), 256).alias("fingerprint"))


def is_current(frame: DataFrame, columns: list[str], stored: str) -> bool:
    """Whether a stored fingerprint still describes the table."""
    return fingerprint(frame, columns).first()["fingerprint"] == stored
