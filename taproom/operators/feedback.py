"""Feedback labels, training examples, learning and the diary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taproom import vocab as V
from taproom.functions import facts, geo, requests, text
from taproom.operators import evaluation, ranking
from taproom.operators.skew import with_row

# Feature name of the learner -> (requested feature, fact column), and the names in their order.
LEARNED = {
    "food": ("food", "servesFood"),
    "sports": ("sports", "showsSports"),
    "liveMusic": ("liveMusic", "hasLiveMusic"),
    "dj": ("dj", "hasDj"),
    "dogFriendly": ("dogFriendly", "dogFriendly"),
    "wheelchair": ("wheelchairAccess", "wheelchairAccessible"),
    "reservations": ("reservations", "acceptsReservations"),
    "group": ("groups", "suitableForGroups"),
}
FEATURE_NAMES = (
    "distanceScore", "areaMatch", "priceRequested", "priceKnown", "priceMatch",
    "foodRequested", "foodKnown", "foodMatch",
    "outdoorRequested", "outdoorExcluded", "outdoorKnown", "outdoorMatch",
    "sportsRequested", "sportsKnown", "sportsMatch",
    "liveMusicRequested", "liveMusicKnown", "liveMusicMatch",
    "djRequested", "djKnown", "djMatch",
    "dogFriendlyRequested", "dogFriendlyKnown", "dogFriendlyMatch",
    "wheelchairRequested", "wheelchairKnown", "wheelchairMatch",
    "reservationsRequested", "reservationsKnown", "reservationsMatch",
    "groupRequested", "groupKnown", "groupMatch",
    "noiseRequested", "noiseKnown", "noiseMatch",
    "ratingKnown", "ratingNormalized", "popularityKnown", "popularityScore",
)


def explicit(events: DataFrame) -> DataFrame:
    """Likes and dislikes that carry a request."""
    said = F.coalesce(F.col("query"), F.lit("")) != ""
    return events.where(F.col("eventType").isin("like", "dislike") & said)


def latest_labels(events: DataFrame) -> DataFrame:
    """Last explicit label per (session, normalised request, venue), by a partial aggregate."""
    keyed = explicit(events).withColumn(
        "sessionId", F.coalesce(F.nullif("sessionId", F.lit("")), F.lit("anonymous"))
    ).withColumn("queryKey", text.query_key(F.col("query")))
    return _last_of_key(keyed)


def newer_labels(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Fold two tables of labels into one; the result is the same whichever was written first."""
    return _last_of_key(current.unionByName(incoming))


def _last_of_key(labels: DataFrame) -> DataFrame:
    rest = F.struct("eventId", "eventType", "query", "recommendationRank", "recordedAt")
    last = labels.groupBy("sessionId", "queryKey", "venueId").agg(
        F.max_by(rest, F.struct("recordedAt", "eventId")).alias("e")
    )
    return last.select("sessionId", "queryKey", "venueId", "e.*")


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def learning_features() -> dict[str, Column]:
    """The forty indicator columns of a (prefs, venue) row."""
    prefs = F.col("prefs")
    distance = geo.area_distance_km(prefs["location"], F.col("latitude"), F.col("longitude"))
    out = {
        "distanceScore": F.coalesce(
            F.greatest(F.lit(0.0), 1.0 - distance / V.AREA_RADIUS_KM), F.lit(0.0)
        ),
        "areaMatch": _flag(F.col("area") == prefs["location"]),
        "priceRequested": _flag(prefs["priceLevel"].isNotNull()),
        "priceKnown": _flag(F.col("priceLevel").isNotNull()),
        "priceMatch": _flag(F.col("priceLevel") == prefs["priceLevel"]),
    }
    for name, (feature, fact) in LEARNED.items():
        asked = F.array_contains(prefs["requiredFeatures"], feature)
        out[f"{name}Requested"] = _flag(asked)
        out[f"{name}Known"] = _flag(F.col(fact).isNotNull())
        out[f"{name}Match"] = _flag(asked & F.col(fact))
    outdoor = F.col("hasOutdoorSeating")
    asked = F.array_contains(prefs["requiredFeatures"], "outdoorSeating")
    avoided = F.array_contains(prefs["excludedFeatures"], "outdoorSeating")
    out["outdoorRequested"] = _flag(asked)
    out["outdoorExcluded"] = _flag(avoided)
    out["outdoorKnown"] = _flag(outdoor.isNotNull())
    out["outdoorMatch"] = F.when(asked, _flag(outdoor)).otherwise(_flag(avoided & ~outdoor))
    out["noiseRequested"] = _flag(prefs["noiseLevel"].isNotNull())
    out["noiseKnown"] = _flag(F.col("noiseLevel").isNotNull())
    out["noiseMatch"] = _flag(F.col("noiseLevel") == prefs["noiseLevel"])
    out["ratingKnown"] = _flag(F.col("rating").isNotNull())
    out["ratingNormalized"] = F.coalesce(F.col("rating") / 5.0, F.lit(0.0))
    out["popularityKnown"] = _flag(F.col("popularityScore").isNotNull())
    out["popularityScore"] = F.coalesce(F.col("popularityScore"), F.lit(0.0))
    return {name: out[name] for name in FEATURE_NAMES}


def training_examples(events: DataFrame, venues: DataFrame) -> DataFrame:
    """One labelled (request, venue) row per latest explicit label whose venue exists.

    Requests repeat heavily, so each distinct text is parsed once and joined back.
    """
    labels = latest_labels(events)
    rows = labels.join(requests.parsed_texts(labels), "query").join(venues, "venueId")
    scored = ranking.with_score(rows)
    return scored.select(
        "eventId",
        "sessionId",
        "query",
        requests.signature(F.col("prefs")).alias("queryGroup"),
        "venueId",
        F.col("name").alias("venueName"),
        (F.col("eventType") == "like").cast("int").alias("label"),
        "recommendationRank",
        F.col("score").alias("baselineScore"),
        *[column.alias(name) for name, column in learning_features().items()],
    )


def source_counts(events: DataFrame, venues: DataFrame) -> DataFrame:
    """allEvents, explicitEvents, deduplicatedExplicitEvents, missingVenues as one row."""
    known = venues.select("venueId").distinct().withColumn("_known", F.lit(True))
    said = F.coalesce(F.col("query"), F.lit("")) != ""
    totals = events.agg(
        F.count("*").alias("allEvents"),
        F.count_if(F.col("eventType").isin("like", "dislike") & said).alias("explicitEvents"),
    )
    kept = latest_labels(events).join(known, "venueId", "left").agg(
        F.count("*").alias("deduplicatedExplicitEvents"),
        F.count_if(F.col("_known").isNull()).alias("missingVenues"),
    )
    return totals.transform(with_row, kept)


def readiness(examples: DataFrame) -> DataFrame:
    """Observed label counts against the fixed minimums."""
    counts = examples.agg(
        F.count("*").alias("labels"),
        F.count_if(F.col("label") == 1).alias("likes"),
        F.count_if(F.col("label") == 0).alias("dislikes"),
        F.countDistinct("queryGroup").alias("groups"),
    )
    checks = {
        "enoughLabels": F.col("labels") >= V.MIN_LABELS,
        "enoughLikes": F.col("likes") >= V.MIN_POSITIVES,
        "enoughDislikes": F.col("dislikes") >= V.MIN_NEGATIVES,
        "enoughGroups": F.col("groups") >= V.MIN_GROUPS,
    }
    ready = checks["enoughLabels"]
    for name in ("enoughLikes", "enoughDislikes", "enoughGroups"):
        ready = ready & checks[name]
    return counts.select(
        "*", *[check.alias(name) for name, check in checks.items()], ready.alias("ready")
    )


WORD = 62  # tries a long holds the bits of


def grouped_split(
    examples: DataFrame, share: float = 0.3, tries: int = 100, seed: int = 42
) -> DataFrame | None:
    """Mark whole request groups as test until both sides hold both labels.

    Labels are first reduced to one row per group. A group's tries are bits, set where it is test, so one aggregate
    over the groups judges all tries at once, and the first good seed is used. None if no try is good.
    """
    groups = examples.groupBy("queryGroup").agg(
        F.max("label").alias("hi"), F.min("label").alias("lo")
    )
    parts = 1_000_000

    def is_test(at) -> Column:
        # A group is test when its hash falls in the first share of the range: nothing is sorted.
        return F.pmod(F.xxhash64(F.col("queryGroup"), at), F.lit(parts)) < int(share * parts)

    def with_bit(first: int):
        one = F.lit(1).cast("long")
        return lambda seen, i: seen + F.when(is_test(i + F.lit(seed + first)), F.call_function("shiftleft", one, i)).otherwise(0)

    words = range(0, tries, WORD)
    masks, judged = [], []
    for number, first in enumerate(words):
        size = min(WORD, tries - first)
        bits = F.sequence(F.lit(0), F.lit(size - 1))
        mask = F.aggregate(bits, F.lit(0).cast("long"), with_bit(first))
        masks.append(mask.alias(f"m{number}"))
        test, train = F.col(f"m{number}"), F.lit((1 << size) - 1).bitwiseXOR(F.col(f"m{number}"))
        liked, disliked = F.col("hi") == 1, F.col("lo") == 0
        sides = [F.coalesce(F.bit_or(F.when(has, side)), F.lit(0).cast("long")) for side in (test, train) for has in (liked, disliked)]
        judged.append(sides[0].bitwiseAND(sides[1]).bitwiseAND(sides[2]).bitwiseAND(sides[3]).alias(f"m{number}"))
    good = groups.select("hi", "lo", *masks).agg(*judged).first()
    for first, word in zip(words, good):
        if word:
            chosen = seed + first + (word & -word).bit_length() - 1
            return examples.select(
                "queryGroup", *[c for c in examples.columns if c != "queryGroup"], is_test(F.lit(chosen)).alias("isTest")
            )
    return None


def not_available(spark: SparkSession, reason: str) -> tuple[DataFrame, DataFrame]:
    """The result of an experiment that can't be run: one row that says why, and no coefficients."""
    metrics = spark.createDataFrame(
        [(f"not available: {reason}", None, None, None)],
        "ranker string, rocAuc double, logLoss double, accuracy double",
    )
    return metrics, spark.createDataFrame([], "feature string, coefficient double")


def fit_and_compare(split: DataFrame | None, spark: SparkSession | None = None) -> tuple[DataFrame, DataFrame]:
    """(metrics of baseline and model on the test side, coefficients by absolute size).

    Without a split, or with one label alone on either side, the metrics are a single row that says so.
    """
    if split is None:
        return not_available(spark or SparkSession.active(), "no split has both labels on both sides")
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    train, test = split.where(~F.col("isTest")), split.where("isTest")
    sides = {
        r["isTest"]: r for r in split.groupBy("isTest").agg(F.count("*").alias("n"), F.sum("label").alias("p")).collect()
    }
    if any(side not in sides or not 0 < sides[side]["p"] < sides[side]["n"] for side in (False, True)):
        return not_available(split.sparkSession, "a side of the split has one label only")
    n, p = sides[False]["n"], sides[False]["p"]
    weight = F.when(F.col("label") == 1, n / (2.0 * p)).otherwise(n / (2.0 * (n - p)))
    stages = [
        VectorAssembler(inputCols=list(FEATURE_NAMES), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        LogisticRegression(
            labelCol="label",
            weightCol="weight",
            regParam=1.0 / n,
            elasticNetParam=0.0,
            maxIter=1000,
            standardization=False,
        ),
    ]
    model = Pipeline(stages=stages).fit(train.withColumn("weight", weight))
    predicted = model.transform(test).withColumn(
        "modelScore", vector_to_array("probability")[1]
    )
    baseline = F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col("baselineScore")))
    predicted = predicted.withColumn("baseline", baseline)
    metrics = None
    for name, column in (("baseline", "baseline"), ("model", "modelScore")):
        row = evaluation.binary_metrics(predicted, "label", column).select(
            F.lit(name).alias("ranker"), "*"
        )
        metrics = row if metrics is None else metrics.unionByName(row)
    learned = model.stages[-1].coefficients.toArray().tolist()
    spark = split.sparkSession
    coefficients = spark.createDataFrame(
        list(zip(FEATURE_NAMES, [round(v, 6) for v in learned], strict=True)),
        "feature string, coefficient double",
    ).orderBy(F.desc(F.abs("coefficient")), "feature")
    return metrics, coefficients


def diary(ratings: DataFrame, venues: DataFrame) -> DataFrame:
    """A user's visited venues, newest first."""
    visited = ratings.where("beenHere").join(venues.select("venueId", "name", "area"), "venueId")
    return visited.orderBy("userId", F.desc("updatedAt"), "venueId")


def diary_stats(ratings: DataFrame, venues: DataFrame, now: Column) -> DataFrame:
    """Per user: visits, visits since Monday (UTC), ratings, mean, share of the dataset seen."""
    known = venues.select("venueId").distinct()
    total = known.agg(F.count("*").alias("venueTotal"))
    visited = ratings.where("beenHere").join(
        known.withColumn("_known", F.lit(True)), "venueId", "left"
    )
    seen = visited.where("_known").select("userId", "venueId").distinct()
    distinct = seen.groupBy("userId").agg(F.count("*").alias("venuesVisited"))
    stats = visited.groupBy("userId").agg(
        F.count("*").alias("visitedTotal"),
        F.count_if(F.col("visitedAt") >= F.date_trunc("week", now)).alias("visitedThisWeek"),
        F.count("rating").alias("ratedTotal"),
        F.round(F.avg("rating"), 1).alias("averageRating"),
    )
    joined = stats.join(distinct, "userId", "left").transform(with_row, total)
    share = F.when(
        F.col("venueTotal") > 0,
        F.round(100.0 * F.coalesce("venuesVisited", F.lit(0)) / F.col("venueTotal"), 1),
    ).otherwise(0.0)
    return joined.withColumn("venuesVisited", F.coalesce("venuesVisited", F.lit(0))).withColumn(
        "venuePercent", share
    )


def label_from_rating(rating: Column) -> Column:
    """Event a rating stands for; nothing in the middle."""
    return F.when(rating > 4, "like").when(rating < 2, "dislike")
