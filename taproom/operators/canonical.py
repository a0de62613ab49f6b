"""Canonical venues with field-level provenance, and the reviewed overlays on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taproom import vocab as V
from taproom.functions.text import one_decimal, tag_slugs

PROVENANCE = "map<string,struct<source:string,sourceRecordId:string,verifiedAt:date,confidence:double>>"
ENRICHED = (
    "servesFood", "hasOutdoorSeating", "hasLiveMusic", "dogFriendly", "wheelchairAccessible",
    "acceptsReservations",
)
CONTACT = ("address", "postcode", "website", "phone")
B_ONLY_CONFIDENCE = 0.8


def price_level(tier: Column) -> Column:
    """Price vocabulary of a four-step tier."""
    return F.when(tier == 1, "cheap").when(tier == 2, "moderate").when(tier.isin(3, 4), "expensive")


def price_band(amount: Column) -> Column:
    """Price vocabulary of an observed amount."""
    return F.when(amount < 4, "cheap").when(amount > 7, "expensive").when(
        amount.isNotNull(), "moderate"
    )


def provenance_entry(
    field: str, known: Column, source: Column, record: Column, at: Column, confidence: Column
) -> Column:
    """Map entry for one field, null while the field is unknown."""
    value = F.struct(
        source.alias("source"),
        record.alias("sourceRecordId"),
        at.cast("date").alias("verifiedAt"),
        confidence.cast("double").alias("confidence"),
    )
    return F.when(known, F.struct(F.lit(field).alias("key"), value.alias("value")))


def entries_to_map(entries: list[Column]) -> Column:
    return F.map_from_entries(F.array_compact(F.array(*entries))).cast(PROVENANCE)


def must(condition: Column, message: str) -> Column:
    """Filter that stops the job where the condition fails."""
    return F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def merge_linked(
    links: DataFrame,
    a: DataFrame,
    b: DataFrame,
    area: Column,
    verified_at: Column,
    a_label: str = "FSQ Places",
    b_label: str = "OpenStreetMap",
    prefix: str = "fsq-",
) -> DataFrame:
    """One venue per accepted link: A leads, B fills what A leaves empty.

    `links` has aId, bId, matchScore; `a` and `b` the source records keyed by aId and bId. `area`
    may refer to the columns of `a` through the alias "a".
    """
    joined = links.alias("l").join(a.alias("a"), "aId").join(b.alias("b"), "bId")
    score = F.col("l.matchScore")
    values, entries = {}, []
    for field in CONTACT:
        first = F.nullif(F.col(f"a.{field}"), F.lit(""))
        values[field] = F.coalesce(first, F.col(f"b.{field}"))
        entries.append(
            provenance_entry(
                field,
                values[field].isNotNull(),
                F.when(first.isNotNull(), a_label).otherwise(b_label),
                F.when(first.isNotNull(), F.col("aId")).otherwise(F.col("bId")),
                verified_at,
                score,
            )
        )
    for field in ENRICHED:
        values[field] = F.col(f"b.{field}")
        entries.append(
            provenance_entry(
                field, values[field].isNotNull(), F.lit(b_label), F.col("bId"), verified_at, score
            )
        )
    tier = F.col("a.priceTier")
    always = F.lit(True)
    for field, known in (
        ("name", always), ("latitude", always), ("longitude", always),
        ("priceTier", tier.isNotNull()), ("priceLevel", tier.isNotNull()),
    ):
        entries.append(
            provenance_entry(field, known, F.lit(a_label), F.col("aId"), verified_at, score)
        )
    labels = F.concat(
        F.coalesce(F.col("a.categories"), F.array().cast("array<string>")),
        F.coalesce(F.col("b.categories"), F.array().cast("array<string>")),
    )
    return joined.select(
        F.concat(F.lit(prefix), F.col("aId")).alias("venueId"),
        F.col("a.name").alias("name"),
        F.col("a.latitude").alias("latitude"),
        F.col("a.longitude").alias("longitude"),
        area.alias("area"),
        *[column.alias(name) for name, column in values.items()],
        tier.alias("priceTier"),
        price_level(tier).alias("priceLevel"),
        tag_slugs(labels).alias("tags"),
        F.lit(f"{a_label} + {b_label}").alias("dataSource"),
        F.lit(None).cast("string").alias("sourceUrl"),
        verified_at.cast("date").alias("lastVerifiedDate"),
        entries_to_map(entries).alias("attributeProvenance"),
    )


def second_source_only(
    b: DataFrame,
    area: Column,
    verified_at: Column,
    b_label: str = "OpenStreetMap",
    prefix: str = "osm-",
    url_root: str = "https://www.openstreetmap.org/",
) -> DataFrame:
    """Venues for unmatched B records, at a fixed lower confidence. Same columns as above."""
    score = F.lit(B_ONLY_CONFIDENCE)
    entries = [
        provenance_entry(
            field, F.col(field).isNotNull(), F.lit(b_label), F.col("bId"), verified_at, score
        )
        for field in (*CONTACT, *ENRICHED, "name", "latitude", "longitude")
    ]
    slugs = F.transform(
        "categories", lambda value: F.replace(F.lower(value), F.lit(" "), F.lit("-"))
    )
    return b.select(
        F.concat(F.lit(prefix), F.replace(F.col("bId"), F.lit("/"), F.lit("-"))).alias("venueId"),
        "name",
        "latitude",
        "longitude",
        area.alias("area"),
        *CONTACT,
        *ENRICHED,
        F.lit(None).cast("int").alias("priceTier"),
        F.lit(None).cast("string").alias("priceLevel"),
        F.array_sort(slugs).alias("tags"),
        F.lit(b_label).alias("dataSource"),
        F.concat(F.lit(url_root), F.col("bId")).alias("sourceUrl"),
        verified_at.cast("date").alias("lastVerifiedDate"),
        entries_to_map(entries).alias("attributeProvenance"),
    )


def _known_ids(venues: DataFrame, overlay: DataFrame, what: str) -> DataFrame:
    """Full join of venues and overlay (both keyed by venueId) that rejects unknown ids."""
    joined = venues.withColumn("_known", F.lit(True)).join(overlay, "venueId", "full")
    return joined.where(must(F.col("_known").isNotNull(), f"{what}: unknown venue id")).drop("_known")


def _one_per_venue(overlay: DataFrame, what: str) -> DataFrame:
    """One struct `_o` per venue; a second row for a venue is an error."""
    rest = [name for name in overlay.columns if name != "venueId"]
    single = overlay.groupBy("venueId").agg(
        F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_o")
    )
    return single.where(must(F.col("_n") == 1, f"{what}: duplicate venue id")).drop("_n")


def valid_override(fields: tuple[str, ...] = V.OVERRIDABLE) -> Column:
    """An override corrects at least one field and cites evidence only for corrected fields."""
    corrected = F.array_compact(
        F.array(*[F.when(F.col(name).isNotNull(), F.lit(name)) for name in fields])
    )
    cited = F.coalesce(F.map_keys("fieldEvidence"), F.array().cast("array<string>"))
    return (F.size(corrected) > 0) & (F.size(F.array_except(cited, corrected)) == 0)


def apply_overrides(venues: DataFrame, overrides: DataFrame) -> DataFrame:
    """Reviewed corrections win field by field, with their own provenance and date."""
    fields = [name for name in V.OVERRIDABLE if name in venues.columns and name in overrides.columns]
    checked = overrides.where(must(valid_override(tuple(fields)), "override corrects nothing"))
    joined = _known_ids(venues, _one_per_venue(checked, "override"), "override")
    o = F.col("_o")
    entries = [
        provenance_entry(
            name,
            o[name].isNotNull(),
            F.lit(V.OFFICIAL_SOURCE),
            F.coalesce(F.try_element_at(o["fieldEvidence"], F.lit(name)), o["evidenceUrl"]),
            o["verifiedAt"],
            F.lit(1.0),
        )
        for name in fields
    ]
    return _overlay(
        venues, joined, {name: F.coalesce(o[name], F.col(name)) for name in fields}, entries
    )


def _overlay(
    venues: DataFrame, joined: DataFrame, values: dict[str, Column], entries: list[Column]
) -> DataFrame:
    o = F.col("_o")
    values = {
        **values,
        "sourceUrl": F.coalesce(o["evidenceUrl"], F.col("sourceUrl")),
        "lastVerifiedDate": F.greatest("lastVerifiedDate", o["verifiedAt"]),
        "attributeProvenance": F.map_concat(
            F.col("attributeProvenance"), entries_to_map(entries)
        ),
    }
    return joined.select(
        *[values.get(name, F.col(name)).alias(name) for name in venues.columns]
    )


def apply_website_verifications(venues: DataFrame, verifications: DataFrame) -> DataFrame:
    """A reviewed web site replaces the listed one and becomes official."""
    joined = _known_ids(venues, _one_per_venue(verifications, "verification"), "verification")
    o = F.col("_o")
    entry = provenance_entry(
        "website", o.isNotNull(), F.lit(V.OFFICIAL_SOURCE), o["evidenceUrl"], o["verifiedAt"],
        F.lit(1.0),
    )
    return _overlay(venues, joined, {"website": F.coalesce(o["website"], F.col("website"))}, [entry])


def apply_facts(venues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Approved facts (venueId, feature, suggestedValue, evidenceUrl, reviewedAt, reviewStatus).

    One approved decision per venue and fact; anything else is an error. Facts land on the columns
    they name, the record's date becomes the latest review date.
    """
    approved = decisions.where(F.col("reviewStatus") == "approved")
    unique = approved.groupBy("venueId", "feature").agg(
        F.count("*").alias("_n"),
        F.first(
            F.struct("suggestedValue", "evidenceUrl", "reviewedAt")
        ).alias("_d"),
    )
    unique = unique.where(must(F.col("_n") == 1, "facts: duplicate approved decision"))
    facts = [name for name in V.FACTS if name in venues.columns]
    per_venue = unique.groupBy("venueId").agg(
        F.max("_d.reviewedAt").alias("_at"),
        *[F.max(F.when(F.col("feature") == name, F.col("_d"))).alias(f"_{name}") for name in facts],
    )
    joined = _known_ids(venues, per_venue, "facts")
    entries = [
        provenance_entry(
            name,
            F.col(f"_{name}").isNotNull(),
            F.lit(V.OFFICIAL_SOURCE),
            F.col(f"_{name}")["evidenceUrl"],
            F.col(f"_{name}")["reviewedAt"],
            F.lit(1.0),
        )
        for name in facts
    ]
    values = {
        name: F.coalesce(F.col(f"_{name}")["suggestedValue"], F.col(name)) for name in facts
    }
    values["lastVerifiedDate"] = F.greatest("lastVerifiedDate", "_at")
    values["attributeProvenance"] = F.map_concat(
        F.col("attributeProvenance"), entries_to_map(entries)
    )
    return joined.select(
        *[values.get(name, F.col(name)).alias(name) for name in venues.columns]
    )


def evidence_sentences(venues: DataFrame) -> DataFrame:
    """Attributable passages of each venue: identity, known facts, noise, price, rating."""
    name = F.col("name")
    provenance = F.col("attributeProvenance")

    def chunk(known: Column, sentence: Column, attributes: list[str], field: str) -> Column:
        origin = F.try_element_at(provenance, F.lit(field))
        record = origin["sourceRecordId"]
        url = F.when(F.rlike(record, F.lit("^https?://")), record).otherwise(F.col("sourceUrl"))
        return F.when(
            known,
            F.struct(
                sentence.alias("text"),
                F.coalesce(origin["source"], F.col("dataSource")).alias("source"),
                F.when(origin.isNull(), F.col("sourceUrl")).otherwise(url).alias("sourceUrl"),
                F.array(*[F.lit(item) for item in attributes]).alias("attributes"),
            ),
        )

    where = F.concat_ws(
        ", ", F.nullif(F.col("address"), F.lit("")), F.nullif(F.col("postcode"), F.lit(""))
    )
    identity = F.concat_ws(
        " ",
        F.concat(name, F.lit(" is a pub in "), F.col("area"), F.lit(".")),
        F.when(where != "", F.concat(F.lit("Its address is "), where, F.lit("."))),
        F.when(
            F.size("tags") > 0,
            F.concat(
                F.lit("It is described as "),
                F.array_join(F.array_sort("tags"), ", "),
                F.lit("."),
            ),
        ),
    )
    chunks = [chunk(F.lit(True), identity, ["name", "area", "address", "tags"], "name")]
    for wanted in (0, 1):
        for fact, sentences in V.FACT_SENTENCES.items():
            value = F.col(fact) if wanted == 0 else ~F.col(fact)
            chunks.append(
                chunk(value, F.concat(name, F.lit(" " + sentences[wanted])), [fact], fact)
            )
    for field, sentence in (
        ("noiseLevel", F.concat(name, F.lit(" has a "), F.col("noiseLevel"), F.lit(" atmosphere."))),
        ("priceLevel", F.concat(name, F.lit(" has a "), F.col("priceLevel"), F.lit(" price level."))),
        (
            "rating",
            F.concat(
                name,
                F.lit(" has a verified rating of "),
                one_decimal(F.col("rating")),
                F.lit(" out of 5."),
            ),
        ),
    ):
        chunks.append(chunk(F.col(field).isNotNull(), sentence, [field], field))
    exploded = venues.select("venueId", F.explode(F.array_compact(F.array(*chunks))).alias("c"))
    return exploded.select("venueId", "c.*")


def chunk_id() -> Column:
    """Stable identity of a passage over its five describing columns."""
    identity = F.struct("attributes", "source", "sourceUrl", "text", "venueId")
    return F.sha2(F.to_json(identity, {"ignoreNullFields": "false"}), 256)


def combine(*datasets: DataFrame) -> DataFrame:
    """Union of datasets; an id in two places is an error."""
    union = datasets[0]
    for frame in datasets[1:]:
        union = union.unionByName(frame, allowMissingColumns=True)
    counts = union.groupBy("venueId").agg(F.count("*").alias("_n"))
    twice = counts.where(F.col("_n") > 1)
    flagged = union.join(twice, "venueId", "left")
    return flagged.where(must(F.col("_n").isNull(), "combined datasets repeat a venue id")).drop("_n")


def overlay_prices(venues: DataFrame, latest: DataFrame) -> DataFrame:
    """Latest observation per venue replaces price level, amount and evidence."""
    joined = venues.drop("guinnessPriceGbp", "priceEvidenceUrl").join(latest, "venueId", "left")
    return joined.withColumn(
        "priceLevel", F.coalesce(F.col("observedLevel"), F.col("priceLevel"))
    ).drop("observedLevel")


def latest_prices(observations: DataFrame, item: str | None = None) -> DataFrame:
    """Last inserted observation of each venue, by a partial aggregate."""
    if item is not None:
        observations = observations.where(F.col("observedItem") == item)
    rest = F.struct("observedPriceGbp", "evidenceUrl")
    last = observations.groupBy("venueId").agg(F.max_by(rest, "observationId").alias("o"))
    return last.select(
        "venueId",
        price_band(F.col("o.observedPriceGbp")).alias("observedLevel"),
        F.col("o.observedPriceGbp").alias("guinnessPriceGbp"),
        F.col("o.evidenceUrl").alias("priceEvidenceUrl"),
    )
