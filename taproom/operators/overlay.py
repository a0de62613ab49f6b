"""Upserts on keyed tables, written as joins so that any table format can hold the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(
    current: DataFrame, incoming: DataFrame, key: list[str], rules: dict[str, Column] | None = None
) -> DataFrame:
    """Incoming rows replace current ones by key; `rules` decide single columns.

    A rule sees both rows as structs `old` and `new` (null when that side is missing).
    """
    rules = rules or {}
    columns = [name for name in current.columns if name not in key]
    left = current.select(*key, F.struct(*columns).alias("old"))
    right = incoming.select(*key, F.struct(*columns).alias("new"))
    both = left.join(right, key, "full")
    old, new = F.col("old"), F.col("new")

    def value(name: str) -> Column:
        if name in rules:
            return F.when(new.isNull(), old[name]).when(old.isNull(), new[name]).otherwise(rules[name])
        return F.when(new.isNull(), old[name]).otherwise(new[name])

    return both.select(*key, *[value(name).alias(name) for name in columns])


def keep_trusted(source: str, trusted: tuple[str, ...], column: str) -> Column:
    """Rule: the old value stands while its source is trusted."""
    old, new = F.col("old"), F.col("new")
    return F.when(old[source].isin(*trusted), old[column]).otherwise(new[column])


def upsert_pubs(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Map import: hours from people or official sites and trusted address labels survive."""
    hours = ("manual", "official")
    rules = {
        "opening_hours": keep_trusted("hours_source", hours, "opening_hours"),
        "hours_source": keep_trusted("hours_source", hours, "hours_source"),
        "address_source": keep_trusted(
            "address_source", ("manual", "reverseGeocoded", "officialWebsite"), "address_source"
        ),
    }
    return upsert(current, incoming, ["id"], rules)


def backfill_hours(pubs: DataFrame) -> DataFrame:
    """Fill hours and source labels from tags where they are still missing."""
    tagged = F.try_element_at("tags", F.lit("opening_hours"))
    due = F.col("opening_hours").isNull() | (F.col("hours_source") == "none")
    return pubs.select(
        *[c for c in pubs.columns if c not in ("opening_hours", "hours_source", "address_source")],
        F.coalesce("opening_hours", F.when(due, tagged)).alias("opening_hours"),
        F.when(
            due & (F.col("hours_source") == "none") & (F.coalesce(tagged, F.lit("")) != ""), "osm"
        ).otherwise(F.col("hours_source")).alias("hours_source"),
        F.when(
            due & (F.coalesce(F.col("address"), F.lit("")) == ""), "openStreetMap"
        ).otherwise(F.col("address_source")).alias("address_source"),
    )


def _newer() -> Column:
    return F.struct("new.updatedAt", "new.seq") >= F.struct("old.updatedAt", "old.seq")


def _newest(column: str) -> Column:
    return F.when(_newer(), F.col(f"new.{column}")).otherwise(F.col(f"old.{column}"))


def _later_photo(column: str) -> Column:
    old_at, new_at = F.col("old.photoAt"), F.col("new.photoAt")
    take_new = new_at.isNotNull() & (old_at.isNull() | (new_at >= old_at))
    return F.when(take_new, F.col(f"new.{column}")).otherwise(F.col(f"old.{column}"))


def merge_ratings(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Join two folded rating tables; the result is the same whichever write arrived first."""
    rules = {
        **{name: _newest(name) for name in ("beenHere", "rating", "updatedAt", "seq")},
        "photo": _later_photo("photo"),
        "photoAt": _later_photo("photoAt"),
        "visitedAt": F.least("old.visitedAt", "new.visitedAt"),
    }
    return upsert(current, incoming, ["userId", "venueId"], rules)


def latest_rating_per_key(ratings: DataFrame) -> DataFrame:
    """Fold several writes of one batch: newest wins, newest photo and first visit survive."""
    order = F.struct("updatedAt", "seq")
    with_photo = F.when(F.col("photo").isNotNull(), order)
    return ratings.groupBy("userId", "venueId").agg(
        F.max_by("beenHere", order).alias("beenHere"),
        F.max_by(F.struct("rating"), order)["rating"].alias("rating"),
        F.max_by("photo", with_photo).alias("photo"),
        F.max(F.when(F.col("photo").isNotNull(), F.col("updatedAt"))).alias("photoAt"),
        F.min("visitedAt").alias("visitedAt"),
        F.max("updatedAt").alias("updatedAt"),
        F.max_by("seq", order).alias("seq"),
    )


def upsert_ratings(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Newest write wins; the photo and the first visit time survive later writes."""
    return merge_ratings(current, latest_rating_per_key(incoming))


def publish_new(log: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Append rows whose key is not in the log yet; repeats inside the batch count once."""
    rest = [name for name in incoming.columns if name not in key]
    single = incoming.groupBy(*key).agg(F.min(F.struct(*rest)).alias("r")).select(*key, "r.*")
    fresh = single.join(log.select(*key), key, "left_anti")
    return log.unionByName(fresh, allowMissingColumns=True)


def refresh_queue(queue: DataFrame, proposed: DataFrame, key: list[str]) -> DataFrame:
    """Keep decided items, drop undecided ones, add proposals whose key is not decided."""
    decided = queue.where(F.col("reviewStatus") != "manual_review")
    return publish_new(decided, proposed, key)


def apply_review(queue: DataFrame, decisions: DataFrame, today: Column) -> DataFrame:
    """Set status and reason by review id; an unknown id is an error."""
    from taproom.operators.canonical import must

    joined = queue.withColumn("_queued", F.lit(True)).join(
        decisions.select(
            "reviewId", F.col("status").alias("_status"), F.col("reason").alias("_reason")
        ),
        "reviewId",
        "full",
    )
    known = joined.where(must(F.col("_queued").isNotNull(), "unknown review id"))
    return (
        known.withColumn("reviewStatus", F.coalesce("_status", "reviewStatus"))
        .withColumn("reviewReason", F.coalesce("_reason", "reviewReason"))
        .withColumn("reviewedAt", F.when(F.col("_status").isNotNull(), today).otherwise(F.col("reviewedAt")))
        .drop("_queued", "_status", "_reason")
    )


def refresh_from_site(pubs: DataFrame, extracted: DataFrame, now: Column) -> DataFrame:
    """Stored site extraction: fill missing phone and address, replace hours unless set by hand.

    `extracted`: id, siteHours, sitePhone, siteAddress.
    """
    joined = pubs.join(extracted.withColumn("_seen", F.lit(True)), "id", "left")
    open_row = F.coalesce(F.col("_seen"), F.lit(False)) & (F.col("hours_source") != "manual")
    new_hours = open_row & F.col("siteHours").isNotNull()
    new_address = open_row & F.col("address").isNull() & F.col("siteAddress").isNotNull()
    values = {
        "opening_hours": F.when(new_hours, F.col("siteHours")).otherwise(F.col("opening_hours")),
        "hours_source": F.when(new_hours, "official").otherwise(F.col("hours_source")),
        "hours_confidence": F.when(new_hours, "high").otherwise(F.col("hours_confidence")),
        "hours_last_checked": F.when(open_row, now).otherwise(F.col("hours_last_checked")),
        "phone": F.when(open_row, F.coalesce("phone", "sitePhone")).otherwise(F.col("phone")),
        "address": F.when(new_address, F.col("siteAddress")).otherwise(F.col("address")),
        "address_source": F.when(new_address, "officialWebsite").otherwise(F.col("address_source")),
    }
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in pubs.columns])


def merge_missing(loaded: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """Add the rows of `more` whose key is not loaded yet."""
    fresh = more.join(loaded.select(key), key, "left_anti")
    return loaded.unionByName(fresh, allowMissingColumns=True)
