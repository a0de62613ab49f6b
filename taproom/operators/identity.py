"""Matching directory listings to venues by the first unambiguous identity signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taproom import vocab as V
from taproom.functions import geo, text, urls
from taproom.functions.similarity import decode_entities
from taproom.operators.skew import split_join
from taproom.session import cut

NEAR_METRES = 35.0
CLEAR_METRES = 75.0
METHODS = ("name+postcode", "name+coordinates", "name+website", "name+address")


def venue_keys(venues: DataFrame) -> DataFrame:
    """Venue side of every strategy, normalised once."""
    return venues.select(
        "venueId",
        text.directory_name(decode_entities(F.col("name"))).alias("vName"),
        text.full_postcode(F.col("postcode")).alias("vPostcode"),
        F.col("latitude").alias("vLat"),
        F.col("longitude").alias("vLon"),
        F.nullif(urls.site_host(urls.with_scheme(F.col("website"))), F.lit("")).alias("vHost"),
        urls.website_path_key(F.col("website")).alias("vPath"),
        text.address_tokens(decode_entities(F.col("address"))).alias("vTokens"),
    )


def listing_keys(listings: DataFrame) -> DataFrame:
    return listings.select(
        "listingId",
        text.directory_name(decode_entities(F.col("sourceName"))).alias("lName"),
        F.col("sourcePostcode").alias("lPostcode"),
        F.col("latitude").alias("lLat"),
        F.col("longitude").alias("lLon"),
        F.nullif(urls.site_host(urls.with_scheme(F.col("website"))), F.lit("")).alias("lHost"),
        urls.website_path_key(F.col("website")).alias("lPath"),
        text.address_tokens(decode_entities(F.col("sourceAddress"))).alias("lTokens"),
    )


def _same_name() -> Column:
    return text.names_compatible(F.col("vName"), F.col("lName"))


def _only(pairs: DataFrame, method: int) -> DataFrame:
    """Listings with exactly one venue under a strategy."""
    single = pairs.groupBy("listingId").agg(
        F.min("venueId").alias("venueId"), F.max("venueId").alias("_last")
    )
    return single.where(F.col("venueId") == F.col("_last")).select(
        "listingId", "venueId", F.lit(method).alias("_method")
    )


def _only_named(known: DataFrame, seen: DataFrame, method: int) -> DataFrame:
    """Listings with exactly one venue of compatible name under a shared key `_k`.

    Equal names under a key are compared once: whether a listing has one venue shows in the smallest and largest id.
    """
    named = known.groupBy("_k", "vName").agg(F.min("venueId").alias("_a"), F.max("venueId").alias("_b"))
    met = split_join(named, seen.select("_k", "lName").distinct(), ["_k"]).where(_same_name())
    met = met.groupBy("_k", "lName").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    span = seen.select("listingId", "_k", "lName").join(met, ["_k", "lName"]).groupBy("listingId").agg(
        F.min("_a").alias("venueId"), F.max("_b").alias("_last")
    )
    return span.where(F.col("venueId") == F.col("_last")).select("listingId", "venueId", F.lit(method).alias("_method"))


def nearest_two(listings: DataFrame, venues: DataFrame, metres: float = CLEAR_METRES) -> DataFrame:
    """Nearest and second-nearest venue within the given metres of each listing.

    Only distances inside the clearance matter for the rule, so a grid of that size is enough.
    Nearest and runner-up come from partial aggregates. Of venues on one point only the two smallest ids can be
    either, so crowded points are met by two venues.
    """
    rank = F.dense_rank().over(Window.partitionBy("vLat", "vLon").orderBy("venueId"))
    venues = venues.withColumn("_rank", rank).where("_rank <= 2").drop("_rank")
    here = listings.withColumn("_cell", geo.home_cell(F.col("lLat"), F.col("lLon"), metres))
    there = venues.withColumn(
        "_cell", F.explode(geo.near_cells(F.col("vLat"), F.col("vLon"), metres))
    )
    far = geo.haversine(F.col("vLat"), F.col("vLon"), F.col("lLat"), F.col("lLon"))
    pairs = split_join(here, there, ["_cell"]).withColumn("distance", far)
    pairs = pairs.where(F.col("distance") <= metres)
    order = F.struct("distance", "venueId", "vName", "lName")
    best = pairs.groupBy("listingId").agg(F.min(order).alias("_best"))
    rest = (
        pairs.join(best.select("listingId", F.col("_best.venueId").alias("_first")), "listingId")
        .where(F.col("venueId") != F.col("_first"))
        .groupBy("listingId")
        .agg(F.min("distance").alias("nextDistance"))
    )
    return best.join(rest, "listingId", "left").select(
        "listingId", "_best.*", "nextDistance"
    )


def match_listings(listings: DataFrame, venues: DataFrame) -> DataFrame:
    """(listingId, venueId, matchMethod) by the first strategy that leaves one venue."""
    # Every strategy reads the keys again, so they are computed and written once.
    seen, known = cut(listing_keys(listings)), cut(venue_keys(venues))
    by_postcode = _only_named(
        known.where(F.col("vPostcode").isNotNull()).withColumn("_k", F.col("vPostcode")),
        seen.where(F.col("lPostcode").isNotNull()).withColumn("_k", F.col("lPostcode")),
        0,
    )
    near = nearest_two(seen, known).where(
        (F.col("distance") <= NEAR_METRES)
        & (F.col("nextDistance").isNull() | (F.col("nextDistance") > CLEAR_METRES))
        & _same_name()
    )
    by_host = split_join(
        known.where(F.col("vHost").isNotNull()).withColumn("_k", F.col("vHost")),
        seen.where(F.col("lHost").isNotNull()).withColumn("_k", F.col("lHost")),
        ["_k"],
    ).where(_same_name())
    nested = F.contains("lPath", "vPath") | F.contains("vPath", "lPath")
    # A bare host identifies a venue only when no other venue has a compatible name at all.
    only_name = _name_pairs_are_unique(seen, known)
    by_host = (
        by_host.where(nested)
        .join(only_name, "listingId", "left")
        .where((F.col("lPath") != "") | (F.col("vPath") != "") | F.col("_alone"))
    )
    options = (
        by_postcode
        .unionByName(near.select("listingId", "venueId", F.lit(1).alias("_method")))
        .unionByName(_only(by_host, 2))
        .unionByName(_only_named(*_address_keys(known, seen), 3))
    )
    first = options.groupBy("listingId").agg(F.min(F.struct("_method", "venueId")).alias("_m"))
    names = F.array(*[F.lit(name) for name in METHODS])
    return first.select(
        "listingId",
        F.col("_m.venueId").alias("venueId"),
        F.get(names, F.col("_m._method")).alias("matchMethod"),
    )


def _address_keys(known: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides by house number and a second address word; two sides that share these are of one address."""

    def pairs_of(column: Column) -> Column:
        numbers = F.filter(column, lambda token: F.rlike(token, F.lit(r"^\d+$")))
        return F.flatten(
            F.transform(
                numbers,
                lambda number: F.transform(
                    F.filter(column, lambda token: token != number),
                    lambda token: F.concat(number, F.lit("|"), token),
                ),
            )
        )

    left = known.withColumn("_k", F.explode(pairs_of(F.col("vTokens"))))
    right = seen.withColumn("_k", F.explode(pairs_of(F.col("lTokens"))))
    return left, right


def _name_pairs_are_unique(seen: DataFrame, known: DataFrame) -> DataFrame:
    """Listings compatible with exactly one venue name anywhere."""
    from taproom.operators.filters import substring_pairs

    # Equal names are met once, as whole rows would multiply.
    v = known.where(F.length("vName") > 0).groupBy("vName").agg(F.min("venueId").alias("_a"), F.max("venueId").alias("_b"))
    s = seen.where((F.length("lName") > 0) & F.col("lHost").isNotNull()).select("listingId", "lName")
    inside = substring_pairs(s, v, "lName", "vName").select(F.col("_needle").alias("lName"), F.col("_text").alias("vName"))
    around = substring_pairs(v, s, "vName", "lName").select(F.col("_text").alias("lName"), F.col("_needle").alias("vName"))
    span = inside.unionByName(around).join(v, "vName").groupBy("lName").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    span = s.join(span, "lName").groupBy("listingId").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    return span.select("listingId", (F.col("_a") == F.col("_b")).alias("_alone"))


def item_price(pints: Column, spellings: tuple[str, ...] = V.ITEM_SPELLINGS) -> Column:
    """Lowest price of the wanted item among (name, price) entries; null without one."""
    wanted = F.filter(pints, lambda pint: F.lower(pint["name"]).isin(*spellings))
    return F.array_min(F.transform(wanted, lambda pint: pint["price"]))


def directory_prices(listings: DataFrame, venues: DataFrame) -> DataFrame:
    """Lowest accepted price per matched venue with the method that matched it."""
    priced = listings.withColumn("priceGbp", item_price(F.col("pints"))).where(
        F.col("priceGbp").isNotNull()
    )
    matched = match_listings(priced, venues).join(priced, "listingId")
    best = matched.groupBy("venueId").agg(
        F.min(F.struct("priceGbp", "listingId", "matchMethod")).alias("b")
    )
    return best.select("venueId", "b.priceGbp", "b.listingId", "b.matchMethod")
