"""Explainable weighted score, evidence blend, personalisation, result pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taproom import vocab as V
from taproom.functions import facts, geo, text
from taproom.functions.similarity import clamp
from taproom.operators.filters import fact_masks, feature_mask
from taproom.operators.skew import split_join

GROUP_BIT = 1 << V.FEATURES.index("groups")


def half_up(value: Column, digits: int) -> Column:
    """Round half up on the decimal value, undisturbed by binary noise in the last places."""
    return F.round(F.round(value, 9), digits)


def _mean(hits: Column, known: Column) -> Column:
    return F.when(known > 0, hits / known)


def _preferred(column: Column, mask: Column) -> Column:
    return F.bit_count(column.bitwiseAND(mask)).cast("double")


def factors() -> Column:
    """Active factors of a (prefs, venue) row: array<struct<name,weight,value>> in fixed order."""
    prefs = F.col("prefs")
    true_bits, false_bits = fact_masks()
    known_bits = true_bits.bitwiseOR(false_bits)
    need = feature_mask(F.array_except(prefs["requiredFeatures"], F.array(F.lit("groups"))))
    want = feature_mask(prefs["preferredFeatures"])
    no_outdoor = F.array_contains(prefs["excludedFeatures"], "outdoorSeating")
    noise_known = prefs["noiseLevel"].isNotNull() & F.col("noiseLevel").isNotNull()
    hits = (
        _preferred(true_bits, need)
        + F.when(no_outdoor & facts.is_false(F.col("hasOutdoorSeating")), 1.0).otherwise(0.0)
        + F.when(noise_known & (F.col("noiseLevel") == prefs["noiseLevel"]), 1.0).otherwise(0.0)
    )
    known = (
        _preferred(known_bits, need)
        + F.when(no_outdoor, 1.0).otherwise(0.0)
        + F.when(noise_known, 1.0).otherwise(0.0)
    )
    distance = geo.area_distance_km(prefs["location"], F.col("latitude"), F.col("longitude"))
    groups = F.array_contains(prefs["requiredFeatures"], "groups")
    values = (
        ("rating", "rating", F.col("rating") / 5.0),
        ("popularity", "popularity", F.col("popularityScore")),
        (
            "location",
            "location",
            F.when(
                prefs["location"].isNotNull(),
                F.greatest(F.lit(0.0), 1.0 - distance / V.AREA_RADIUS_KM),
            ),
        ),
        (
            "price",
            "price",
            (F.col("priceLevel") == prefs["priceLevel"]).cast("double"),
        ),
        ("requiredFeatures", "features", _mean(hits, known)),
        (
            "preferredFeatures",
            "features",
            _mean(_preferred(true_bits, want), _preferred(known_bits, want)),
        ),
        (
            "groupSuitability",
            "groupSuitability",
            F.when(groups, F.col("suitableForGroups").cast("double")),
        ),
    )
    parts = [
        F.struct(
            F.lit(name).alias("name"),
            F.lit(V.WEIGHTS[weight]).alias("weight"),
            value.alias("value"),
        )
        for name, weight, value in values
    ]
    return F.filter(F.array(*parts), lambda part: part["value"].isNotNull())


def with_score(pairs: DataFrame) -> DataFrame:
    """Add score, scoreBreakdown and distanceKm to (prefs, venue) rows."""
    prefs = F.col("prefs")
    staged = pairs.withColumn("_f", factors())
    weight = F.aggregate("_f", F.lit(0.0), lambda state, part: state + part["weight"])
    total = F.aggregate(
        "_f", F.lit(0.0), lambda state, part: state + part["weight"] * part["value"]
    )
    score = F.when(weight > 0, total / weight).otherwise(0.0)

    def shares(of: Column) -> Column:
        part = lambda x: F.struct(x["name"], F.round(x["weight"] * x["value"] / of, 3))
        return F.map_from_entries(F.transform("_f", part))

    # Handed in as a value: the sum of weights is made once a row and not once a factor.
    breakdown = F.get(F.transform(F.array(weight), shares), F.lit(0))
    return (
        staged.withColumn("score", F.round(clamp(score), 3))
        .withColumn("scoreBreakdown", breakdown)
        .withColumn(
            "distanceKm",
            geo.area_distance_km(prefs["location"], F.col("latitude"), F.col("longitude")),
        )
        .drop("_f")
    )


def reasons() -> Column:
    """Ordered explanation texts of a (prefs, venue) row."""
    prefs = F.col("prefs")
    located = F.when(
        F.col("area") == prefs["location"], F.concat(F.lit("Located in "), prefs["location"])
    )
    in_postcode = F.when(
        prefs["postcode"].isNotNull() & (F.coalesce(F.col("postcode"), F.lit("")) != ""),
        F.concat(F.lit("Located in postcode "), F.col("postcode")),
    )
    priced = F.when(
        F.col("priceLevel") == prefs["priceLevel"], F.lit("Matches the requested price range")
    )
    texts = [located, in_postcode, priced]
    for feature in V.FEATURES:
        if feature != "groups":
            asked = F.array_contains(prefs["requiredFeatures"], feature)
            texts.append(
                F.when(
                    asked & facts.is_true(facts.feature_column(feature)),
                    F.lit(V.FEATURE_REASONS[feature]),
                )
            )
        if feature == "outdoorSeating":
            texts.append(
                F.when(
                    F.array_contains(prefs["excludedFeatures"], feature)
                    & facts.is_false(F.col("hasOutdoorSeating")),
                    F.lit("Has no outdoor seating"),
                )
            )
    texts.append(
        F.when(
            F.col("noiseLevel") == prefs["noiseLevel"],
            F.concat(F.lit("Has a "), prefs["noiseLevel"], F.lit(" atmosphere")),
        )
    )
    labels = {
        **V.FEATURE_REASONS,
        **{name: f"Matches preferred {name}" for name in V.NOISE_FEATURES},
    }
    known = facts.feature_map()
    label_map = F.map_from_arrays(
        F.array(*[F.lit(name) for name in labels]), F.array(*[F.lit(v) for v in labels.values()])
    )
    liked = F.transform(
        F.filter(
            prefs["preferredFeatures"],
            lambda name: F.try_element_at(known, name).eqNullSafe(F.lit(True)),
        ),
        lambda name: F.try_element_at(label_map, name),
    )
    tail = [
        F.when(
            F.array_contains(prefs["requiredFeatures"], "groups")
            & facts.is_true(F.col("suitableForGroups")),
            F.lit(V.FEATURE_REASONS["groups"]),
        ),
        F.concat(
            F.lit("Rated "), text.one_decimal(F.col("rating")), F.lit(" out of 5")
        ),
        F.when(F.col("popularityScore") >= 0.8, F.lit("Strong local popularity")),
    ]
    tail[1] = F.when(F.col("rating").isNotNull(), tail[1])
    return F.concat(F.array_compact(F.array(*texts)), liked, F.array_compact(F.array(*tail)))


def verified_features() -> Column:
    return facts.facts_where(True, V.FEATURE_REASONS)


def unknown_features() -> Column:
    return facts.facts_where(None, V.FEATURE_REASONS)


def evidence_attributes(prefs: Column) -> Column:
    """Fact columns behind the required and excluded features of a request."""
    names = F.map_from_arrays(
        F.array(*[F.lit(name) for name in V.FEATURE_FACTS]),
        F.array(*[F.lit(fact) for fact in V.FEATURE_FACTS.values()]),
    )
    asked = F.array_union(prefs["requiredFeatures"], prefs["excludedFeatures"])
    return F.array_sort(
        F.array_compact(F.transform(asked, lambda name: F.try_element_at(names, name)))
    )


def structured(prefs: Column) -> Column:
    """The request names something the weighted score can judge."""
    return (
        prefs["location"].isNotNull()
        | prefs["priceLevel"].isNotNull()
        | prefs["noiseLevel"].isNotNull()
        | (F.size(prefs["requiredFeatures"]) > 0)
        | F.array_contains(prefs["excludedFeatures"], "outdoorSeating")
    )


def blend(scored: DataFrame, evidence: DataFrame, key: str = "requestId") -> DataFrame:
    """Mix the weighted score with the evidence score; rows without evidence drop out.

    The mix is decided per request: a quarter evidence when the request is structured and some
    candidate scored above zero, evidence alone otherwise. That signal is the column `anyScore`, or
    else a partial aggregate over all candidates, joined back.
    """
    if "anyScore" not in scored.columns:
        signal = scored.groupBy(key).agg(F.bool_or(F.col("score") > 0).alias("anyScore"))
        scored = scored.join(signal, key)
    named = F.col("structured") if "structured" in scored.columns else structured(F.col("prefs"))
    weight = F.when(named & F.col("anyScore"), 0.25).otherwise(1.0)
    mixed = scored.join(evidence, [key, "venueId"]).withColumn("_w", weight)
    return (
        mixed.withColumn("structuredPart", half_up((1.0 - F.col("_w")) * F.col("score"), 3))
        .withColumn("semanticPart", half_up(F.col("_w") * F.col("semanticScore"), 3))
        .withColumn(
            "score",
            half_up(
                (1.0 - F.col("_w")) * F.col("score") + F.col("_w") * F.col("semanticScore"), 3
            ),
        )
        .drop("_w", "anyScore")
    )


def trait_profile(venues: DataFrame) -> DataFrame:
    """venueId, name and the traits two venues are compared on."""
    return venues.select(
        "venueId",
        "name",
        facts.trait_bits().alias("bits"),
        F.col("area").alias("tArea"),
        F.col("priceLevel").alias("tPrice"),
        F.col("noiseLevel").alias("tNoise"),
    )


TRAITS = ("bits", "tArea", "tPrice", "tNoise")


def trait_similarity(left: str, right: str) -> Column:
    """Shared over all known positive traits of two profiles (columns under two prefixes)."""
    shared = F.bit_count(F.col(f"{left}bits").bitwiseAND(F.col(f"{right}bits")))
    size = F.bit_count(F.col(f"{left}bits")) + F.bit_count(F.col(f"{right}bits"))
    for trait in TRAITS[1:]:
        one, two = F.col(f"{left}{trait}"), F.col(f"{right}{trait}")
        shared = shared + F.coalesce((one == two).cast("int"), F.lit(0))
        size = size + one.isNotNull().cast("int") + two.isNotNull().cast("int")
    union = size - shared
    return F.when(union == 0, F.lit(0.0)).otherwise(shared / union)


def best_similar(
    ranked: DataFrame, ratings: DataFrame, venues: DataFrame, key: str = "requestId"
) -> DataFrame:
    """Most similar liked and disliked venue of the asking user for each ranked row.

    `ratings` has userId, venueId, rating and a total order `pos`. Venues with equal traits are
    equally similar, so a user's ratings are first reduced to the two earliest venues of each trait
    profile (two, because a row never counts its own venue), and the ranked rows to one of each user and
    venue, however many requests the user has. Both reductions are exact and remove the hot spot of users
    with many ratings.
    """
    profile = trait_profile(venues)
    rated = ratings.where((F.col("rating") > 4) | (F.col("rating") < 2)).join(profile, "venueId")
    rated = rated.withColumn("liked", F.col("rating") > 4)
    rated = rated.groupBy("userId", "liked", "venueId", "name", *TRAITS).agg(
        F.min_by("rating", "pos").alias("rating"), F.min("pos").alias("pos")
    )
    first = Window.partitionBy("userId", "liked", *TRAITS).orderBy("pos")
    kept = rated.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= 2).drop("_n")
    kept = kept.select(
        "userId",
        "liked",
        F.col("venueId").alias("rVenueId"),
        F.col("name").alias("rName"),
        F.col("rating").alias("rRating"),
        "pos",
        *[F.col(trait).alias(f"r{trait}") for trait in TRAITS],
    )
    asked = ranked.select("userId", "venueId").distinct().join(profile.drop("name"), "venueId")
    pairs = split_join(asked, kept, ["userId"]).where(F.col("venueId") != F.col("rVenueId"))
    pairs = pairs.withColumn("similarity", trait_similarity("", "r")).where(
        F.col("similarity") > 0
    )
    order = F.struct(F.col("similarity"), (-F.col("pos")).alias("p"))
    best = pairs.groupBy("userId", "venueId").agg(
        *[
            F.max_by(
                F.when(
                    F.col("liked") == liked,
                    F.struct(
                        F.col("similarity"),
                        F.col("rName").alias("name"),
                        F.col("rRating").alias("rating"),
                    ),
                ),
                F.when(F.col("liked") == liked, order),
            ).alias(name)
            for name, liked in (("bestLiked", True), ("bestDisliked", False))
        ]
    )
    if key == "userId":
        return best
    rows = ranked.select(key, "userId", "venueId")
    return rows.join(best, ["userId", "venueId"]).select(key, "venueId", "bestLiked", "bestDisliked")


def personalise(
    ranked: DataFrame, ratings: DataFrame, venues: DataFrame, key: str = "requestId"
) -> DataFrame:
    """Raise rows that resemble a loved venue, lower those that resemble a disliked one."""
    best = best_similar(ranked, ratings, venues, key)
    rows = ranked.join(best, [key, "venueId"], "left")
    liked, disliked = F.col("bestLiked"), F.col("bestDisliked")
    positive = F.when(
        liked["similarity"] >= 0.5, liked["similarity"] * (liked["rating"] / 5.0)
    ).otherwise(0.0)
    negative = F.coalesce(
        disliked["similarity"] * F.greatest(F.lit(0.0), 2.0 - disliked["rating"]), F.lit(0.0)
    )
    final = clamp(F.col("score") + 0.20 * positive - 0.35 * negative)

    def label(lead: str, best_row: Column, shown: Column) -> Column:
        stars = F.regexp_replace(best_row["rating"].cast("string"), r"\.0$", "")
        return F.when(
            shown, F.concat(F.lit(lead), best_row["name"], F.lit(" · "), stars, F.lit("★"))
        )

    near_disliked = disliked["similarity"] >= 0.5
    reason = F.concat_ws(
        " · ",
        label("Similar to ", liked, positive > 0),
        label("Less like ", disliked, near_disliked),
    )
    strongest = F.greatest(
        F.coalesce(liked["similarity"], F.lit(0.0)), F.coalesce(disliked["similarity"], F.lit(0.0))
    )
    return (
        rows.withColumn("searchFit", F.round("score", 3))
        .withColumn("positiveSimilarity", half_up(0.20 * positive, 3))
        .withColumn("negativeSimilarity", half_up(0.35 * negative, 3))
        .withColumn(
            "personalScore",
            F.when((positive > 0) | near_disliked, F.round(strongest, 3)),
        )
        .withColumn("personalReason", F.nullif(reason, F.lit("")))
        .withColumn("score", half_up(final, 3))
        .drop("bestLiked", "bestDisliked")
    )


def page(ranked: DataFrame, limit: int, offset: int = 0, key: str = "requestId") -> DataFrame:
    """Rows offset+1 .. offset+limit per request, with the total and whether more follow.

    The rank filter keeps the window to the first rows per task before the shuffle; totals are a
    separate partial aggregate.
    """
    totals = ranked.groupBy(key).agg(F.count("*").alias("totalAvailable"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "name", "venueId")
    top = ranked.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= offset + limit
    )
    return (
        top.where(F.col("rank") > offset)
        .join(totals, key)
        .withColumn("hasMore", F.col("totalAvailable") > offset + limit)
    )
