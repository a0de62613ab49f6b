"""Fixed schemas of the stored entities."""

from __future__ import annotations

from taproom import vocab as V

PROVENANCE = "MAP<STRING, STRUCT<source STRING, sourceRecordId STRING, verifiedAt DATE, confidence DOUBLE>>"

VENUE = (
    "venueId STRING, name STRING, latitude DOUBLE, longitude DOUBLE, area STRING, address STRING, "
    "postcode STRING, website STRING, phone STRING, priceTier INT, priceLevel STRING, "
    "guinnessPriceGbp DOUBLE, priceEvidenceUrl STRING, "
    + ", ".join(f"{fact} BOOLEAN" for fact in V.FACTS)
    + ", noiseLevel STRING, rating DOUBLE, popularityScore DOUBLE, tags ARRAY<STRING>, "
    "dataSource STRING, sourceUrl STRING, lastVerifiedDate DATE, "
    f"attributeProvenance {PROVENANCE}"
)
PLACE_A = (
    "fsqPlaceId STRING, name STRING, latitude DOUBLE, longitude DOUBLE, address STRING, "
    "postcode STRING, website STRING, phone STRING, priceTier INT, categories ARRAY<STRING>"
)
PLACE_B = (
    "osmElementId STRING, name STRING, latitude DOUBLE, longitude DOUBLE, address STRING, "
    "postcode STRING, website STRING, phone STRING, servesFood BOOLEAN, "
    "hasOutdoorSeating BOOLEAN, hasLiveMusic BOOLEAN, dogFriendly BOOLEAN, "
    "wheelchairAccessible BOOLEAN, acceptsReservations BOOLEAN, categories ARRAY<STRING>"
)
PLACES_PAYLOAD = (
    "results ARRAY<STRUCT<fsq_place_id STRING, name STRING, latitude DOUBLE, longitude DOUBLE, "
    "location STRUCT<address STRING, formatted_address STRING, postcode STRING>, website STRING, "
    "tel STRING, price INT, categories ARRAY<STRUCT<name STRING>>>>"
)
MAP_PAYLOAD = (
    "elements ARRAY<STRUCT<type STRING, id BIGINT, lat DOUBLE, lon DOUBLE, "
    "center STRUCT<lat DOUBLE, lon DOUBLE>, tags MAP<STRING, STRING>>>"
)
FEEDBACK = (
    "eventId STRING, venueId STRING, eventType STRING, query STRING, recommendationRank INT, "
    "sessionId STRING, requestId STRING, rankingVersion STRING, datasetVersion STRING, "
    "recordedAt TIMESTAMP"
)
IMPORT_REQUIRED = (
    "venueId", "name", "latitude", "longitude", "area", "priceLevel", "servesFood",
    "hasOutdoorSeating", "showsSports", "suitableForGroups", "noiseLevel", "rating",
    "popularityScore", "tags", "dataSource", "lastVerifiedDate",
)
