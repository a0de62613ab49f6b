"""Which preferences could act, and why a request has no result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taproom import vocab as V
from taproom.functions import facts, text
from taproom.operators.skew import with_row

FLAGGED = tuple(name for name in V.FEATURES if name != "groups")


def dataset_facts(venues: DataFrame) -> DataFrame:
    """One row on the whole dataset: which features are known, true, false anywhere, which levels."""
    names = (*V.FEATURES, *V.NOISE_FEATURES)

    def some(test) -> list[Column]:
        return [F.bool_or(test(facts.feature_column(name))).alias(name) for name in names]

    flags = {
        "known": some(lambda c: c.isNotNull()),
        "true": some(facts.is_true),
        "false": some(facts.is_false),
    }
    wide = venues.agg(
        *[c.alias(f"{kind}_{i}") for kind, cols in flags.items() for i, c in enumerate(cols)],
        F.bool_or(F.col("priceLevel").isNotNull()).alias("priceKnown"),
        F.bool_or(F.col("noiseLevel").isNotNull()).alias("noiseKnown"),
        F.collect_set(F.when(F.col("area").isin(*V.AREAS), F.col("area"))).alias("areas"),
        F.collect_set(
            F.when(F.col("priceLevel").isin(*V.PRICE_LEVELS), F.col("priceLevel"))
        ).alias("priceLevels"),
    )

    def as_map(kind: str) -> Column:
        return F.map_from_arrays(
            F.array(*[F.lit(name) for name in names]),
            F.array(*[F.col(f"{kind}_{i}") for i in range(len(names))]),
        ).alias(kind)

    return wide.select(
        as_map("known"), as_map("true"), as_map("false"), "priceKnown", "noiseKnown", "areas",
        "priceLevels",
    )


def _label(prefix: str, values: Column) -> Column:
    return F.transform(values, lambda value: F.concat(F.lit(prefix), value))


def _one(prefix: str, value: Column) -> Column:
    return F.array_compact(F.array(F.when(value.isNotNull(), F.concat(F.lit(prefix), value))))


def describe(parsed: DataFrame, venues: DataFrame, query: str = "query") -> DataFrame:
    """Add activePreferences, ignoredPreferences and warnings to parsed requests.

    The dataset is reduced to one row first and attached to every request.
    """
    from taproom.functions.requests import leftover_terms

    prefs = F.col("prefs")
    rows = parsed.transform(with_row, dataset_facts(venues)).withColumn("_terms", leftover_terms(F.col(query)))
    flagged = F.array(*[F.lit(name) for name in FLAGGED])
    groups = F.array_contains(prefs["requiredFeatures"], "groups")
    none = F.array().cast("array<string>")
    active = F.concat(
        _one("location:", prefs["location"]),
        _one("postcode:", prefs["postcode"]),
        _one("priceLevel:", prefs["priceLevel"]),
        _one("noiseLevel:", prefs["noiseLevel"]),
        F.array_intersect(prefs["requiredFeatures"], flagged),
        _label("prefer:", prefs["preferredFeatures"]),
        _label("exclude:", prefs["excludedFeatures"]),
        _label("exclude:location:", prefs["excludedLocations"]),
        _label("exclude:priceLevel:", prefs["excludedPriceLevels"]),
        F.when(groups, F.array(F.lit("groupSuitability"))).otherwise(none),
    )
    unknown = F.filter(
        prefs["preferredFeatures"], lambda name: ~F.coalesce(F.try_element_at("known", name), F.lit(False))
    )
    ignored = F.concat(
        F.when(~F.col("priceKnown"), _one("priceLevel:", prefs["priceLevel"])).otherwise(none),
        F.when(~F.col("noiseKnown"), _one("noiseLevel:", prefs["noiseLevel"])).otherwise(none),
        _label("prefer:", unknown),
        _label("unparsed:", F.col("_terms")),
    )
    warnings = F.array_compact(
        F.array(
            F.when(
                F.size("_terms") > 0,
                F.concat(
                    F.lit("Some query terms were not understood: "), F.array_join("_terms", ", ")
                ),
            ),
            F.when(
                F.size(prefs["contradictions"]) > 0,
                F.concat(
                    F.lit("The query contains conflicting requirements: "),
                    F.array_join(prefs["contradictions"], ", "),
                ),
            ),
            F.when(
                F.size(ignored) > 0,
                F.lit("Some preferences could not affect ranking because data was unavailable."),
            ),
        )
    )
    return rows.select(
        *parsed.columns,
        F.array_sort(F.array_except(active, ignored)).alias("activePreferences"),
        F.array_sort(F.array_distinct(ignored)).alias("ignoredPreferences"),
        warnings.alias("warnings"),
    )


def no_result_reasons(parsed: DataFrame, venues: DataFrame, key: str = "requestId") -> DataFrame:
    """(key, reasons) for requests without candidates: what no venue at all can satisfy.

    Whether any venue lies in a requested postcode is a semi-join on postcode prefixes.
    """
    prefs = F.col("prefs")
    prefixes = venues.select(text.postcode_prefix_key(F.col("postcode")).alias("p")).distinct()
    prefixes = prefixes.select(
        F.explode(
            F.transform(F.sequence(F.lit(1), F.greatest(F.length("p"), F.lit(1))), lambda n: F.substr("p", F.lit(1), n))
        ).alias("_prefix")
    ).distinct().withColumn("_served", F.lit(True))
    rows = (
        parsed.withColumn("_prefix", prefs["postcode"])
        .join(prefixes, "_prefix", "left")
        .transform(with_row, dataset_facts(venues))
    )
    flagged = F.array(*[F.lit(name) for name in FLAGGED])
    need = F.filter(
        F.array_intersect(flagged, prefs["requiredFeatures"]),
        lambda name: ~F.coalesce(F.try_element_at("true", name), F.lit(False)),
    )
    avoid = F.filter(
        prefs["excludedFeatures"], lambda name: ~F.coalesce(F.try_element_at("false", name), F.lit(False))
    )
    priced_out = F.filter(
        prefs["excludedPriceLevels"],
        lambda level: F.size(F.array_remove(F.col("priceLevels"), level)) == 0,
    )
    reasons = F.concat(
        F.array_compact(
            F.array(
                F.when(
                    prefs["postcode"].isNotNull() & F.col("_served").isNull(),
                    F.concat(
                        F.lit("No venues are available in postcode "), prefs["postcode"], F.lit(".")
                    ),
                ),
                F.when(
                    ~F.array_contains("areas", prefs["location"]),
                    F.concat(F.lit("No venues are available in "), prefs["location"], F.lit(".")),
                ),
            )
        ),
        F.transform(
            need,
            lambda name: F.concat(
                F.lit("No venues have verified "), name, F.lit(" data matching the request.")
            ),
        ),
        F.transform(
            avoid,
            lambda name: F.concat(
                F.lit("No venues have verified evidence excluding "), name, F.lit(".")
            ),
        ),
        F.transform(
            priced_out,
            lambda level: F.concat(
                F.lit("No venues have verified prices outside "), level, F.lit(".")
            ),
        ),
    )
    together = F.array(F.lit("No venue satisfies all verified requirements together."))
    conflict = F.array(F.lit("Conflicting requirements must be resolved before matching venues."))
    return rows.select(
        key,
        F.when(F.size(prefs["contradictions"]) > 0, conflict)
        .when(F.size(reasons) == 0, together)
        .otherwise(reasons)
        .alias("noResultReasons"),
    )
