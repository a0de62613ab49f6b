"""Learning from feedback, and the append logs as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from taproom.catalog.base import Tables, query, sql
from taproom.catalog.evidence import HITS, KM, KNOWN, LIKED, LIKED_KNOWN, SCORE
from taproom.catalog.requestsql import FEEDBACK_TEXTS, PREFS
from taproom.catalog.windows import LABELS
from taproom.functions import requests as R
from taproom.operators import feedback, overlay
from taproom.session import checkpoint_dir
from taproom.sources import tables
from taproom.streaming import feedback as stream

EXAMPLES = {
    "labels_": (
        "SELECT *, eventType = 'like' AS liked_ FROM (SELECT sessionId, venueId, eventId, eventType, q AS query FROM (SELECT coalesce(sessionId, 'anonymous') AS sessionId, "
        "regexp_replace(trim(lower(query)), '\\s+', ' ', 'g') AS queryKey, venueId, arg_max(eventId, (recordedAt, eventId)) AS eventId, "
        "arg_max(eventType, (recordedAt, eventId)) AS eventType, arg_max(query, (recordedAt, eventId)) AS q FROM fx_feedback "
        "WHERE eventType IN ('like', 'dislike') AND query IS NOT NULL GROUP BY ALL))"
    ),
    "asked": (
        "SELECT v.*, l.eventId, l.sessionId, l.liked_, p.location, p.priceLevel AS wantPrice, p.noiseLevel AS wantNoise, p.requiredFeatures, p.preferredFeatures, "
        "p.excludedFeatures, p.postcode AS wantPostcode, p.query, to_json([CAST(p.location AS VARCHAR), p.postcode, p.priceLevel, p.noiseLevel, CAST(p.groupSize AS VARCHAR), "
        "array_to_string(p.requiredFeatures, ','), array_to_string(p.preferredFeatures, ','), array_to_string(p.excludedFeatures, ','), "
        "array_to_string(p.excludedLocations, ','), array_to_string(p.excludedPriceLevels, ','), array_to_string(p.contradictions, ',')]) AS grp "
        "FROM labels_ l JOIN prefs p ON p.query = l.query JOIN fx_venue v ON v.venueId = l.venueId"
    ),
    "parts": f"SELECT *, {KM} AS km, {HITS} AS hits, {KNOWN} AS known, {LIKED} AS liked, {LIKED_KNOWN} AS likedKnown FROM asked",
    "listed": SCORE["listed"],
    "ranked": SCORE["ranked"],
}


def examples(t: Tables):
    return feedback.training_examples(t.fx("feedback"), t.venues())


@query(
    "L05_training_examples",
    sql(
        "feedback venue",
        "SELECT eventId, sessionId, venueId, CAST(liked_ AS INT) AS label, score AS baselineScore FROM ranked",
        **FEEDBACK_TEXTS, **PREFS, **EXAMPLES,
    ),
)
def training_examples(t: Tables):
    return examples(t).select("eventId", "sessionId", "venueId", "label", "baselineScore")


@query(
    "S18_training_set_sink",
    sql(
        "feedback venue",
        "SELECT CAST(liked_ AS INT) AS label, count(*) AS rows, round(avg(score), 6) AS meanBaseline FROM ranked GROUP BY liked_",
        **FEEDBACK_TEXTS, **PREFS, **EXAMPLES,
    ),
)
def training_sink(t: Tables):
    path = shared(t, "training")
    tables.write_training_set(examples(t), path)
    stored = t.spark.read.option("header", True).csv(path)
    return stored.groupBy(F.col("label").cast("int").alias("label")).agg(
        F.count("*").alias("rows"), F.round(F.avg(F.col("baselineScore").cast("double")), 6).alias("meanBaseline")
    )


FLAG = "CASE WHEN {0} THEN 1.0E0 ELSE 0.0E0 END"
Q_FEATURES = ", ".join(
    [
        "round(coalesce(greatest(0.0E0, 1.0E0 - km / 8.0E0), 0.0E0), 6) AS distanceScore",
        FLAG.format("area = location") + " AS areaMatch",
        FLAG.format("wantPrice IS NOT NULL") + " AS priceRequested",
        FLAG.format("priceLevel = wantPrice") + " AS priceMatch",
        FLAG.format("list_contains(excludedFeatures, 'outdoorSeating')") + " AS outdoorExcluded",
        FLAG.format("(list_contains(requiredFeatures, 'outdoorSeating') AND hasOutdoorSeating IS TRUE) OR (NOT list_contains(requiredFeatures, 'outdoorSeating') "
                    "AND list_contains(excludedFeatures, 'outdoorSeating') AND hasOutdoorSeating IS FALSE)") + " AS outdoorMatch",
        FLAG.format("noiseLevel = wantNoise") + " AS noiseMatch",
        "round(coalesce(rating / 5.0E0, 0.0E0), 6) AS ratingNormalized",
        "coalesce(popularityScore, 0.0E0) AS popularityScore",
    ]
    + [FLAG.format(f"list_contains(requiredFeatures, '{feature}')") + f" AS {name}Requested" for name, (feature, _) in feedback.LEARNED.items()]
    + [FLAG.format(f"{fact} IS NOT NULL") + f" AS {name}Known" for name, (_, fact) in feedback.LEARNED.items()]
    + [FLAG.format(f"list_contains(requiredFeatures, '{feature}') AND {fact} IS TRUE") + f" AS {name}Match" for name, (feature, fact) in feedback.LEARNED.items()]
)


@query(
    "H39_learning_features",
    sql("feedback venue", f"SELECT eventId, {Q_FEATURES} FROM parts", **FEEDBACK_TEXTS, **PREFS, **EXAMPLES),
)
def learning_features(t: Tables):
    names = [
        "distanceScore", "areaMatch", "priceRequested", "priceMatch", "outdoorExcluded", "outdoorMatch", "noiseMatch",
        "ratingNormalized", "popularityScore",
        *[f"{n}{s}" for s in ("Requested", "Known", "Match") for n in feedback.LEARNED],
    ]
    return examples(t).select("eventId", *[F.round(n, 6).alias(n) for n in names])


@query(
    "L05_source_counts",
    sql(
        "feedback venue",
        "SELECT (SELECT count(*) FROM fx_feedback) AS allEvents, (SELECT count(*) FROM fx_feedback WHERE eventType IN ('like', 'dislike') AND query IS NOT NULL) AS explicitEvents, "
        "count(*) AS deduplicatedExplicitEvents, count(*) FILTER (venueId NOT IN (SELECT venueId FROM fx_venue)) AS missingVenues FROM lab",
        lab=LABELS,
    ),
)
def source_counts(t: Tables):
    return feedback.source_counts(t.fx("feedback"), t.fx("venue"))


@query(
    "A10_readiness_gate",
    sql(
        "feedback venue",
        "SELECT labels, likes, dislikes, groups, labels >= 100 AS enoughLabels, likes >= 20 AS enoughLikes, dislikes >= 20 AS enoughDislikes, groups >= 10 AS enoughGroups, "
        "labels >= 100 AND likes >= 20 AND dislikes >= 20 AND groups >= 10 AS ready FROM (SELECT count(*) AS labels, count(*) FILTER (liked_) AS likes, "
        "count(*) FILTER (NOT liked_) AS dislikes, count(DISTINCT grp) AS groups FROM asked)",
        **FEEDBACK_TEXTS, **PREFS, labels_=EXAMPLES["labels_"], asked=EXAMPLES["asked"],
    ),
)
def readiness(t: Tables):
    return feedback.readiness(examples(t))


@query("L02_grouped_split")
def grouped_split(t: Tables):
    split = feedback.grouped_split(examples(t))
    if split is None:
        split = examples(t).limit(0).withColumn("isTest", F.lit(False))
    return split.groupBy("isTest").agg(
        F.count("*").alias("rows"), F.countDistinct("queryGroup").alias("groups"), F.max("label").alias("hi"),
        F.min("label").alias("lo"),
    )


def split_once(t: Tables):
    """The split written to the shared folder: fitting reads it many times."""
    from taproom.session import cut

    split = feedback.grouped_split(examples(t))
    return None if split is None else cut(split)


@query("L03_logistic_regression")
def logistic_regression(t: Tables):
    _, coefficients = feedback.fit_and_compare(split_once(t))
    return coefficients


@query("O06_coefficient_order")
def coefficient_order(t: Tables):
    _, coefficients = feedback.fit_and_compare(split_once(t))
    return coefficients.withColumn("size", F.abs("coefficient"))


@query("L04_baseline_comparison")
def baseline_comparison(t: Tables):
    metrics, _ = feedback.fit_and_compare(split_once(t))
    return metrics


# -- streams --------------------------------------------------------------------------------------


def shared(t: Tables, name: str) -> str:
    return f"{checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def event_stream(t: Tables):
    """The feedback events as a file stream, out of order and with repeated deliveries."""
    path = shared(t, "events")
    events = t.fx("feedback").withColumn("recommendationRank", F.col("recommendationRank").cast("int"))
    # Files by the hash of the id hold all times; every fifth event comes again, some weeks late.
    events.drop("n").repartition(4, F.xxhash64("eventId")).write.parquet(path)
    events.where("n % 5 = 0").drop("n").repartition(2, "venueId").write.mode("append").parquet(path)
    return t.spark.readStream.schema(events.drop("n").schema).option("maxFilesPerTrigger", 2).parquet(path)


@query(
    "T01_feedback_ingest",
    sql(
        "feedback venue",
        "SELECT eventId, 'kept' AS outcome FROM fx_feedback WHERE venueId IN (SELECT venueId FROM fx_venue WHERE n % 3 <> 0) UNION ALL "
        "SELECT eventId, 'unknown venue' FROM fx_feedback WHERE venueId NOT IN (SELECT venueId FROM fx_venue WHERE n % 3 <> 0)",
    ),
)
def feedback_ingest(t: Tables):
    good, bad, state = shared(t, "kept"), shared(t, "rejects"), shared(t, "state")
    stream.ingest(event_stream(t), t.fx("venue").where("n % 3 <> 0"), good, bad, state).awaitTermination()
    kept = t.spark.read.parquet(good).select("eventId", F.lit("kept").alias("outcome"))
    return kept.unionByName(t.spark.read.parquet(bad).select("eventId", F.col("rejectReason").alias("outcome")))


@query("T02_latest_label_state", sql("feedback", LABELS))
def latest_label_state(t: Tables):
    table = shared(t, "labels")
    stream.upsert_labels_stream(event_stream(t), table, shared(t, "state")).awaitTermination()
    return stream.label_table(t.spark, table).select("sessionId", "queryKey", "venueId", "eventId", "eventType")


def rating_rows(t: Tables):
    return t.fx("rating").select(
        F.col("userId").cast("string").alias("userId"), "venueId", "beenHere", "rating", "photo",
        F.col("updatedAt").alias("visitedAt"), "updatedAt", F.col("pos").alias("seq"),
    )


Q_RATINGS = (
    "SELECT CAST(userId AS VARCHAR) AS userId, venueId, arg_max(beenHere, (updatedAt, pos)) AS beenHere, "
    "arg_max({'r': rating}, (updatedAt, pos)).r AS rating, arg_max(photo, (updatedAt, pos)) FILTER (photo IS NOT NULL) AS photo, min(updatedAt) AS visitedAt, "
    "max(updatedAt) AS updatedAt FROM fx_rating GROUP BY userId, venueId"
)


@query("T03_ratings_upsert", sql("rating", Q_RATINGS))
def ratings_upsert(t: Tables):
    path, table, state = shared(t, "ratings"), shared(t, "table"), shared(t, "state")
    rows = rating_rows(t)
    rows.repartitionByRange(3, "updatedAt").sortWithinPartitions("updatedAt").write.parquet(path)
    source = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    stream.upsert_ratings_stream(source, table, state).awaitTermination()
    return stream.rating_table(t.spark, table).drop("seq", "photoAt")


@query("T03_ratings_upsert_batch", sql("rating", Q_RATINGS))
def ratings_batch(t: Tables):
    rows = rating_rows(t)
    first = overlay.latest_rating_per_key(rows.where("seq % 2 = 0"))
    merged = overlay.upsert_ratings(first, rows.where("seq % 2 = 1"))
    return merged.drop("seq", "photoAt")


@query(
    "U07_intent_parser_plugin",
    sql(
        "request",
        "SELECT requestId, query, location FROM fx_request JOIN prefs USING (query)",
        texts="SELECT DISTINCT query FROM fx_request", **PREFS,
    ),
)
def parser_plugin(t: Tables):
    def parser(frame):
        return frame.join(R.parsed_texts(frame), "query")

    return parser(t.fx("request").drop("vector")).select("requestId", "query", F.col("prefs.location").alias("location"))
