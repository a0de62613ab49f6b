"""Scans, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from taproom import vocab as V
from taproom.catalog.base import FIXTURES, Tables, joined, query, sql
from taproom.operators import overlay, quality
from taproom.session import checkpoint_dir
from taproom.sources import payloads, schemas, tables, venues as VS
from taproom.operators.skew import with_row


def shared_path(t: Tables, name: str) -> str:
    return f"{checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "S01_validated_json_scan",
    sql("venue", "SELECT venueId, name, latitude, longitude, area, priceTier, rating FROM fx_venue"),
)
def validated_json(t: Tables):
    path = shared_path(t, "venues")
    t.venues().drop("n", "tagsText").select(F.to_json(F.struct("*")).alias("line")).write.text(path)
    return VS.read_json(t.spark, path).select(
        "venueId", "name", "latitude", "longitude", "area", "priceTier", "rating"
    )


IMPORT = {
    "n": "n",
    "venueId": "CASE WHEN n % 53 = 0 THEN '' ELSE concat('v-', CAST(n % 1300 AS STRING)) END",
    "name": "name",
    "latitude": "CASE WHEN n % 41 = 0 THEN 'north' WHEN n % 43 = 0 THEN '97.5' ELSE '51.5' END",
    "longitude": "'-0.1'",
    "area": "CASE WHEN n % 5 = 0 THEN concat(' ', upper(area)) ELSE area END",
    "priceLevel": "coalesce(priceLevel, 'unknown')",
    "servesFood": "CASE WHEN n % 37 = 0 THEN 'perhaps' ELSE 'true' END",
    "hasOutdoorSeating": "'false'",
    "showsSports": "'true'",
    "suitableForGroups": "'false'",
    "noiseLevel": "coalesce(noiseLevel, 'moderate')",
    "rating": "CASE WHEN n % 29 = 0 THEN '7' ELSE '4.5' END",
    "popularityScore": "'0.5'",
    "tags": "concat(' ', tagsText, '| |')",
    "dataSource": "dataSource",
    "lastVerifiedDate": "CASE WHEN n % 31 = 0 THEN 'soon' ELSE '2026-08-01' END",
}
RAW_SQL = ", ".join(f"{e} AS {n}" for n, e in IMPORT.items())
ISSUES_SQL = (
    "CAST(venueId = '' AS INT) + CAST(latitude IN ('north', '97.5') AS INT)"
    " + CAST(priceLevel = 'unknown' AS INT) + CAST(servesFood = 'perhaps' AS INT)"
    " + CAST(rating = '7' AS INT) + CAST(lastVerifiedDate = 'soon' AS INT)"
)


def raw_import(t: Tables):
    return t.fx("venue").selectExpr(*[f"{e} AS {n}" for n, e in IMPORT.items()])


# The duplicate rule taken literally: one row after the other, remembering accepted keys.
SEQUENTIAL = {
    "raw": f"SELECT {RAW_SQL} FROM fx_venue",
    "checked": f"SELECT *, {ISSUES_SQL} AS issueCount, "
    "lower(trim(name)) || chr(1) || lower(trim(area)) AS identity FROM raw",
    "lined": "SELECT *, row_number() OVER (ORDER BY n) AS i FROM checked WHERE issueCount = 0",
    "walk": (
        "SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS names, "
        "false AS dup, CAST(NULL AS BIGINT) AS n "
        "UNION ALL SELECT l.i, "
        "CASE WHEN list_contains(w.ids, l.venueId) OR list_contains(w.names, l.identity) "
        "THEN w.ids ELSE list_append(w.ids, l.venueId) END, "
        "CASE WHEN list_contains(w.ids, l.venueId) OR list_contains(w.names, l.identity) "
        "THEN w.names ELSE list_append(w.names, l.identity) END, "
        "list_contains(w.ids, l.venueId) OR list_contains(w.names, l.identity), l.n "
        "FROM walk w JOIN lined l ON l.i = w.i + 1"
    ),
}


def sequential_sql(body: str) -> str:
    return sql("venue", body, **SEQUENTIAL).replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "S02_csv_import_report",
    sequential_sql(
        "SELECT c.n, c.issueCount, coalesce(w.dup, false) AS duplicate, "
        "array_to_string(list_filter(list_transform(string_split(c.tags, '|'), lambda x: trim(x)), "
        "lambda x: x <> ''), '|') AS tagList FROM checked c LEFT JOIN walk w ON w.n = c.n"
    ),
)
def csv_import(t: Tables):
    path = shared_path(t, "import")
    # Files by ranges of n, in order of their names; tags hold quotes, commas and line ends.
    quoted = F.concat(F.lit('"The" old, one\n| '), "tags")
    rows = raw_import(t).withColumn("tags", quoted).repartitionByRange(4, "n").sortWithinPartitions("n")
    rows.write.option("header", True).option("escape", '"').csv(path)
    checked = VS.check_import(VS.read_csv(t.spark, path), "_row")
    tags = F.array_remove("tagList", '"The" old, one')
    return checked.select(
        F.col("n").cast("long").alias("n"), F.size("issues").alias("issueCount"), "duplicate",
        F.array_join(tags, "|").alias("tagList"),
    )


@query(
    "W10_import_duplicates",
    sequential_sql("SELECT n, dup AS duplicate FROM walk WHERE n IS NOT NULL"),
)
def import_duplicates(t: Tables):
    checked = VS.check_import(raw_import(t), "n")
    return checked.where(F.size("issues") == 0).select("n", "duplicate")


@query(
    "A02_import_quality_counts",
    sequential_sql(
        "SELECT count(*) AS totalRows, count(*) FILTER (c.issueCount = 0 AND NOT w.dup) AS validRows, "
        "count(*) FILTER (c.issueCount > 0) AS invalidRows, "
        "count(*) FILTER (c.issueCount = 0 AND w.dup) AS duplicateRows, "
        "count(*) FILTER (c.issueCount > 0 OR w.dup) = 0 AS isClean "
        "FROM checked c LEFT JOIN walk w ON w.n = c.n"
    ),
)
def import_counts(t: Tables):
    return quality.import_counts(VS.check_import(raw_import(t), "n"))


@query(
    "S04_places_payload",
    sql(
        "venue",
        "SELECT venueId AS fsqPlaceId, name, latitude, longitude, "
        "CASE WHEN n % 4 = 0 THEN concat(area, ', UK') ELSE address END AS address, postcode, "
        "website, phone, priceTier, replace(tagsText, '|', ',') AS categories FROM fx_venue",
    ),
)
def places_payload(t: Tables):
    place = F.struct(
        F.col("venueId").alias("fsq_place_id"), "name", "latitude", "longitude",
        F.struct(
            F.when(F.col("n") % 4 == 0, "").otherwise(F.col("address")).alias("address"),
            F.when(F.col("n") % 4 == 0, F.concat("area", F.lit(", UK"))).alias("formatted_address"),
            "postcode",
        ).alias("location"),
        "website", F.col("phone").alias("tel"), F.col("priceTier").alias("price"),
        F.transform(F.split("tagsText", r"\|"), lambda c: F.struct(c.alias("name"))).alias("categories"),
    )
    answers = t.fx("venue").groupBy(F.floor(F.col("n") / 50).alias("tile")).agg(
        F.to_json(F.struct(F.collect_list(place).alias("results"))).alias("body")
    )
    rows = payloads.places_records(answers).drop("tile")
    return rows.withColumn("categories", F.array_join("categories", ","))


TRUE_TAGS = "['" + "','".join(V.TAG_TRUE_VALUES) + "']"


def q_mapped(column: str, values: str) -> str:
    parts = f"list_distinct(list_transform(string_split({column}, ';'), lambda x: lower(trim(x))))"
    return (
        f"CASE WHEN trim(coalesce({column}, '')) = '' THEN NULL WHEN {parts} = ['no'] THEN false "
        f"WHEN list_has_any({parts}, {values}) THEN true ELSE NULL END"
    )


Q_FOOD = f"coalesce({q_mapped('t_food', TRUE_TAGS)}, CASE WHEN trim(coalesce(t_cuisine, '')) <> '' THEN true END)"
Q_FACTS = {
    "servesFood": Q_FOOD,
    "hasOutdoorSeating": q_mapped("t_outdoor", TRUE_TAGS),
    "hasLiveMusic": f"coalesce({q_mapped('t_live', chr(91) + chr(39) + 'yes' + chr(39) + chr(93))}, "
    f"{q_mapped('t_live2', chr(91) + chr(39) + 'yes' + chr(39) + chr(93))})",
    "dogFriendly": q_mapped("t_dog", "['yes', 'leashed']"),
    "wheelchairAccessible": q_mapped("t_wheelchair", "['yes']"),
    "acceptsReservations": q_mapped("t_reservation", "['yes', 'required', 'recommended']"),
}
Q_FACT_COLUMNS = ", ".join(f"{e} AS {n}" for n, e in Q_FACTS.items())
Q_SOURCE_ADDRESS = (
    "coalesce(t_full, CASE WHEN t_number IS NULL AND t_street IS NULL THEN NULL "
    "ELSE concat_ws(' ', t_number, t_street) END)"
)


@query(
    "S05_map_payload",
    sql(
        "tagged",
        "SELECT id AS osmElementId, name, 51.0E0 + CAST(n % 100 AS DOUBLE) / 1.0E2 AS latitude, "
        f"CAST(n % 50 AS DOUBLE) / 1.0E2 AS longitude, {Q_SOURCE_ADDRESS} AS address, "
        "t_postcode AS postcode, coalesce(t_website2, t_website) AS website, t_phone AS phone, "
        f"{Q_FACT_COLUMNS}, 'pub' AS categories FROM fx_tagged",
    ),
)
def map_payload(t: Tables):
    lat = F.lit(51.0) + (F.col("n") % 100).cast("double") / 100.0
    lon = (F.col("n") % 50).cast("double") / 100.0
    node = F.col("n") % 3 != 0
    element = F.struct(
        F.lit("node").alias("type"), F.col("n").alias("id"),
        F.when(node, lat).alias("lat"), F.when(node, lon).alias("lon"),
        F.when(~node, F.struct(lat.alias("lat"), lon.alias("lon"))).alias("center"),
        F.map_concat("tags", F.create_map(F.lit("amenity"), F.lit("pub"))).alias("tags"),
    )
    answers = t.tagged().groupBy(F.floor(F.col("n") / 50).alias("tile")).agg(
        F.to_json(F.struct(F.collect_list(element).alias("elements"))).alias("body")
    )
    return payloads.map_records(answers).withColumn("categories", F.array_join("categories", ","))


@query(
    "S06_tiled_dedupe",
    sql(
        "feedback",
        "SELECT venueId, arg_max(eventId, n) AS eventId, arg_max(recommendationRank, n) AS "
        "recommendationRank FROM fx_feedback GROUP BY venueId",
    ),
)
def tiled_dedupe(t: Tables):
    records = t.fx("feedback").select("venueId", "eventId", "recommendationRank", F.col("n").alias("tile"))
    return payloads.last_per_id(records, "venueId", "tile")


@query(
    "S06_grid_tiles",
    sql(
        "venue",
        "SELECT tile, round(51.28E0 + CAST(tile // 4 AS DOUBLE) * 0.14E0, 6) AS south, "
        "round(-0.51E0 + CAST(tile % 4 AS DOUBLE) * 0.21E0, 6) AS west, count(*) AS places FROM ("
        "SELECT least(2, CAST(floor((latitude - 51.28E0) / 0.14E0) AS BIGINT)) * 4 + "
        "least(3, CAST(floor((longitude + 0.51E0) / 0.21E0) AS BIGINT)) AS tile FROM fx_venue) "
        "GROUP BY tile",
    ),
)
def grid_tiles(t: Tables):
    tiles = payloads.grid(t.spark, 51.28, -0.51, 51.70, 0.33, 3, 4)
    row = F.least(F.lit(2), F.floor((F.col("latitude") - 51.28) / 0.14))
    column = F.least(F.lit(3), F.floor((F.col("longitude") + 0.51) / 0.21))
    counts = t.fx("venue").groupBy((row * 4 + column).alias("tile")).agg(F.count("*").alias("places"))
    return tiles.join(counts, "tile").select(
        "tile", F.round("south", 6).alias("south"), F.round("west", 6).alias("west"), "places"
    )


CURRENT = {
    "id": "id", "name": "concat('old ', name)", "address": "address", "website": "t_website",
    "opening_hours": "CASE WHEN n % 4 = 1 THEN NULL ELSE 'Mo-Su 10:00-22:00' END",
    "hours_source": "CASE n % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'none' WHEN 2 THEN 'osm' ELSE 'official' END",
    "address_source": (
        "CASE n % 3 WHEN 0 THEN 'openStreetMap' WHEN 1 THEN 'officialWebsite' ELSE 'reverseGeocoded' END"
    ),
}
INCOMING = {
    **CURRENT,
    "name": "name",
    "address": (
        "CASE WHEN t_number IS NULL AND t_street IS NULL AND t_city IS NULL AND t_postcode IS NULL "
        "THEN NULL ELSE concat_ws(', ', t_number, t_street, t_city, t_postcode) END"
    ),
    "opening_hours": "t_hours",
    "hours_source": "CASE WHEN t_hours IS NULL THEN 'none' ELSE 'osm' END",
    "address_source": "'openStreetMap'",
}


def _list(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


@query(
    "S07_relational_upsert",
    sql(
        "tagged",
        "SELECT coalesce(i.id, c.id) AS id, CASE WHEN i.id IS NULL THEN c.name ELSE i.name END AS name, "
        "CASE WHEN i.id IS NULL THEN c.address ELSE i.address END AS address, "
        "CASE WHEN i.id IS NULL THEN c.website ELSE i.website END AS website, "
        "CASE WHEN i.id IS NULL OR c.hours_source IN ('manual', 'official') THEN c.opening_hours "
        "ELSE i.opening_hours END AS opening_hours, "
        "CASE WHEN i.id IS NULL OR c.hours_source IN ('manual', 'official') THEN c.hours_source "
        "ELSE i.hours_source END AS hours_source, "
        "CASE WHEN i.id IS NULL OR c.address_source IN ('manual', 'reverseGeocoded', 'officialWebsite') "
        "THEN c.address_source ELSE i.address_source END AS address_source "
        "FROM cur c FULL JOIN inc i ON i.id = c.id",
        cur=f"SELECT {_list(CURRENT)} FROM fx_tagged WHERE n % 5 <> 0",
        inc=f"SELECT {_list(INCOMING)} FROM fx_tagged WHERE n % 2 = 0",
    ),
)
def relational_upsert(t: Tables):
    from taproom.functions.tags import import_address

    base = t.tagged()
    current = base.where("n % 5 <> 0").selectExpr(*[f"{e} AS {n}" for n, e in CURRENT.items()])
    incoming = (
        base.where("n % 2 = 0")
        .withColumn("_address", import_address(F.col("tags")))
        .selectExpr(*[f"{'_address' if n == 'address' else e} AS {n}" for n, e in INCOMING.items()])
    )
    return overlay.upsert_pubs(current, incoming)


@query(
    "S08_backfill_update",
    sql(
        "tagged",
        "SELECT id, coalesce(opening_hours, t_hours) AS opening_hours, "
        "CASE WHEN hours_source = 'none' AND t_hours IS NOT NULL THEN 'osm' ELSE hours_source END AS "
        "hours_source, CASE WHEN (opening_hours IS NULL OR hours_source = 'none') AND "
        "coalesce(address, '') = '' THEN 'openStreetMap' ELSE address_source END AS address_source FROM cur",
        cur=f"SELECT t_hours, {_list(CURRENT)} FROM fx_tagged",
    ),
)
def backfill(t: Tables):
    pubs = t.tagged().selectExpr("tags", *[f"{e} AS {n}" for n, e in CURRENT.items()])
    return overlay.backfill_hours(pubs).select("id", "opening_hours", "hours_source", "address_source")


SQUARE = (
    "SELECT s_suppkey AS k, -0.5E0 + CAST((s_suppkey * 37) % 700 AS DOUBLE) / 1.0E3 AS x, "
    "51.28E0 + CAST((s_suppkey * 53) % 350 AS DOUBLE) / 1.0E3 AS y FROM supplier"
)


def boundaries(t: Tables):
    """One GeoJSON text per supplier: a square with a square hole, wrapped in different ways."""
    k = F.col("s_suppkey")
    x = F.lit(-0.5) + ((k * 37) % 700).cast("double") / 1000.0
    y = F.lit(51.28) + ((k * 53) % 350).cast("double") / 1000.0

    def ring(low: float, high: float):
        corner = lambda dx, dy: F.array(x + dx, y + dy)
        return F.array(corner(low, low), corner(high, low), corner(high, high), corner(low, high), corner(low, low))

    polygon = F.array(ring(0.0, 0.06), ring(0.02, 0.03))
    plain = F.to_json(F.struct(F.lit("Polygon").alias("type"), polygon.alias("coordinates")))
    multi = F.to_json(
        F.struct(F.lit("MultiPolygon").alias("type"), F.array(polygon).alias("coordinates"))
    )
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), plain, F.lit("}"))
    body = (
        F.when(k % 3 == 0, F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.lit("]}")))
        .when(k % 3 == 1, multi)
        .otherwise(feature)
    )
    return t.table("supplier").select(k.cast("string").alias("boundaryId"), body.alias("body"))


@query(
    "S09_boundary_scan",
    f"WITH sq AS ({SQUARE}) SELECT concat(CAST(k AS STRING), '#0') AS polygonId, r AS ringNo, 5 AS vertices, "
    "round(CASE r WHEN 0 THEN x ELSE x + 0.02E0 END, 6) AS west, "
    "round(CASE r WHEN 0 THEN y + 0.06E0 ELSE y + 0.03E0 END, 6) AS north FROM sq, (VALUES (0), (1)) t(r)",
)
def boundary_scan(t: Tables):
    rings = payloads.boundary_rings(boundaries(t))
    return rings.select(
        "polygonId",
        "ringNo",
        F.size("vertices").alias("vertices"),
        F.round(F.array_min(F.transform("vertices", lambda v: v["lon"])), 6).alias("west"),
        F.round(F.array_max(F.transform("vertices", lambda v: v["lat"])), 6).alias("north"),
    )


def directory_pages(t: Tables):
    entry = F.struct(
        F.col("sourceName").alias("name"),
        F.col("sourceAddress").alias("address"),
        F.when(F.col("n") % 31 != 0, F.col("latitude")).alias("latitude"),
        "longitude",
        "website",
        F.array(
            F.array(F.col("pintName"), F.col("pintPrice").cast("string")),
            F.array(F.lit("Cheap"), F.lit("1.5")),
        ).alias("pints"),
    )
    body = F.to_json(F.map_from_entries(F.collect_list(F.struct("listingId", entry))))
    return t.fx("listing").groupBy(F.floor(F.col("n") / 40).alias("page_id")).agg(
        F.concat(
            F.lit("<html><script>\n  var pubsData = "), body, F.lit(";\n</script><body>pubs</body></html>")
        ).alias("html")
    )


POSTCODE_SQL = r"upper(regexp_replace(regexp_extract({0}, '(?i)\b([A-Z]{{1,2}}\d[A-Z\d]?\s*\d[A-Z]{{2}})\b', 1), '\s+', '', 'g'))"


@query(
    "S10_directory_page_scan",
    sql(
        "listing",
        "SELECT concat(CAST(CAST(floor(n / 40) AS BIGINT) AS STRING), '/', listingId) AS listingId, "
        "trim(sourceName) AS sourceName, sourceAddress, nullif("
        + POSTCODE_SQL.format("sourceAddress")
        + ", '') AS sourcePostcode, latitude, longitude, website, pintName, pintPrice "
        "FROM fx_listing WHERE n % 31 <> 0",
    ),
)
def directory_scan(t: Tables):
    found = payloads.directory_listings(directory_pages(t))
    return found.select(
        "listingId", "sourceName", "sourceAddress", "sourcePostcode", "latitude", "longitude", "website",
        F.col("pints")[0]["name"].alias("pintName"), F.col("pints")[0]["price"].alias("pintPrice"),
    )


def ld_pages(t: Tables):
    """Venue pages with structured data: one object, a graph, a broken block, a foreign object."""
    venue = F.to_json(
        F.struct(
            F.lit("Pub").alias("@type"),
            F.when(F.col("n") % 4 != 0, F.concat(F.lit("THE "), F.col("name"))).alias("name"),
            F.col("t_phone").alias("telephone"),
            F.when(F.col("n") % 5 == 0, F.array("t_hours")).alias("openingHours"),
            F.when(
                F.col("n") % 5 == 1,
                F.array(
                    F.struct(
                        F.array(F.lit("https://schema.org/Monday"), F.lit("Tuesday")).alias("dayOfWeek"),
                        F.lit("11:00").alias("opens"), F.lit("23:00").alias("closes"),
                    ),
                    F.struct(
                        F.array(F.lit("Monday"), F.lit("Someday")).alias("dayOfWeek"),
                        F.lit("09:00").alias("opens"), F.lit("10:00").alias("closes"),
                    ),
                ),
            ).alias("openingHoursSpecification"),
            F.struct(
                F.col("t_street").alias("streetAddress"), F.col("t_city").alias("addressLocality"),
                F.col("t_postcode").alias("postalCode"),
            ).alias("address"),
        )
    )
    body = F.when(
        F.col("n") % 3 == 0,
        F.concat(F.lit('{"@context":"x","@graph":[{"@type":"WebSite","name":"site"},'), venue, F.lit("]}")),
    ).otherwise(venue)
    foreign = '{"@type":"Event","name":"elsewhere","telephone":"999"}'
    html = F.concat(
        F.lit("<html><head><script type='application/ld+json'>{broken</script>"),
        F.lit(f'<script type="application/ld+json">{foreign}</script>'),
        F.lit('<script type="application/ld+json">'), body, F.lit("</script></head></html>"),
    )
    return t.tagged().select("id", "name", html.alias("html"))


Q_VALID_HOURS = (
    "CASE WHEN {0} = '24/7' THEN '24/7' WHEN {0} IN ('Mo-Su 25:00-26:00', 'call us') THEN NULL ELSE {0} END"
)


@query(
    "S11_structured_page_data",
    sql(
        "tagged",
        "SELECT id, CASE n % 5 WHEN 0 THEN " + Q_VALID_HOURS.format("t_hours")
        + " WHEN 1 THEN 'Mo 11:00-23:00,09:00-10:00; Tu 11:00-23:00' ELSE NULL END AS siteHours, "
        "trim(t_phone) AS sitePhone, CASE WHEN t_street IS NULL AND t_city IS NULL AND t_postcode IS NULL "
        "THEN NULL ELSE concat_ws(', ', t_street, t_city, t_postcode) END AS siteAddress FROM fx_tagged",
    ),
)
def structured_page_data(t: Tables):
    return payloads.site_data(ld_pages(t), "id", "name")


@query(
    "S12_browse_scan",
    sql("tagged", "SELECT id, name, t_phone AS phone FROM fx_tagged ORDER BY name, id LIMIT 500"),
)
def browse_scan(t: Tables):
    return VS.browse(t.fx("tagged").select("id", "name", F.col("t_phone").alias("phone")), None)


@query(
    "S13_fallback_source",
    sql(
        "venue",
        "SELECT venueId AS id, name, latitude, longitude, coalesce(address, area) AS address, website, "
        "phone, area AS tagArea, replace(tagsText, '|', ' ') AS features, 'none' AS hoursSource, "
        "'openStreetMap' AS addressSource FROM fx_venue ORDER BY lower(name), venueId LIMIT 200",
    ),
)
def fallback_source(t: Tables):
    def broken():
        # The reader is built without an error; the missing files are met when it runs.
        path = shared_path(t, "away")
        t.fx("tagged").select("id", "name").limit(10).write.json(path)
        rows = t.spark.read.schema("id string, name string").option("mode", "FAILFAST").parquet(path)
        return rows

    rows = VS.with_fallback(broken, t.venues, 200)
    return rows.select(
        "id", "name", "latitude", "longitude", "address", "website", "phone",
        F.col("tags")["area"].alias("tagArea"), F.col("tags")["features"].alias("features"),
        "hoursSource", "addressSource",
    )


@query("S14_stable_venue_scan", sql("venue", "SELECT venueId, name FROM fx_venue"))
def stable_scan(t: Tables):
    return VS.ordered(t.fx("venue").select("venueId", "name"))


@query(
    "S15_evidence_table_sink",
    sql(
        "chunk",
        "SELECT venueId, count(*) AS chunks, 64 AS dimensions, "
        "round(avg(sqrt(list_sum(list_transform(CAST(vector AS DOUBLE[]), lambda x: x * x)))), 6) AS meanNorm "
        "FROM (SELECT DISTINCT venueId, text, source, sourceUrl, attribute, first(vector) OVER "
        "(PARTITION BY text ORDER BY n) AS vector FROM fx_chunk) GROUP BY venueId",
    ),
)
def evidence_sink(t: Tables):
    chunks = t.chunks()
    vectors = chunks.groupBy("text").agg(F.min_by("vector", "n").alias("embedding"))
    described = chunks.select("venueId", "text", "source", "sourceUrl", "attributes")
    path = shared_path(t, "evidence")
    table = tables.evidence_table(described, vectors)
    tables.write_evidence(table, path, "v1", "given-vectors")
    stored = tables.read_evidence(t.spark, path, "v1")
    return stored.groupBy("venueId").agg(
        F.count("*").alias("chunks"), F.max("dimensions").alias("dimensions"),
        F.round(F.avg("norm"), 6).alias("meanNorm"),
    )


CAMDEN = "SELECT venueId FROM fx_venue WHERE area = 'Camden' AND servesFood"


@query(
    "S16_evidence_table_scan",
    sql(
        "venue chunk",
        f"SELECT chunkId, venueId, source FROM fx_chunk WHERE venueId IN ({CAMDEN})",
    ),
)
def evidence_scan(t: Tables):
    wanted = t.fx("venue").where("area = 'Camden' AND servesFood")
    return tables.candidate_chunks(t.chunks(), wanted).select("chunkId", "venueId", "source")


@query(
    "S17_feedback_log",
    sql(
        "feedback",
        "SELECT eventId, venueId, eventType, query, recommendationRank, sessionId, recordedAt FROM fx_feedback",
    ),
)
def feedback_log(t: Tables):
    path = shared_path(t, "feedback")
    events = t.fx("feedback").drop("n").withColumn("recommendationRank", F.col("recommendationRank").cast("int"))
    tables.append_feedback(events.where("recordedAt < TIMESTAMP'2024-01-15'"), path)
    # The second delivery holds everything again: what is stored already is left out.
    tables.append_feedback(events.unionByName(events.where("eventType = 'like'")), path)
    return tables.read_feedback(t.spark, path).select(
        "eventId", "venueId", "eventType", "query", "recommendationRank", "sessionId", "recordedAt"
    )


@query(
    "S19_report_sink",
    sql(
        "venue",
        "SELECT count(*) AS venues, count(servesFood) AS known, count(*) FILTER (servesFood) AS positive FROM fx_venue",
    ),
)
def report_sink(t: Tables):
    path = shared_path(t, "report")
    report = t.fx("venue").agg(
        F.count("*").alias("venues"), F.count("servesFood").alias("known"),
        F.count_if("servesFood").alias("positive"),
    )
    tables.write_report(report, path)
    return t.spark.read.schema(report.schema).json(path)


@query(
    "S20_id_list_scan",
    sql(
        "venue feedback",
        "SELECT venueId, name FROM fx_venue WHERE venueId IN (SELECT venueId FROM fx_feedback WHERE n % 3 < 2 AND n % 7 = 0)",
    ),
)
def id_list(t: Tables):
    item = (
        F.when(F.col("n") % 3 == 0, F.concat(F.lit('"'), "venueId", F.lit('"')))
        .when(F.col("n") % 3 == 1, F.to_json(F.struct("venueId", "eventType")))
        .otherwise(F.col("n").cast("string"))
    )
    lines = t.fx("feedback").where("n % 7 = 0").select(item.alias("item"))
    wanted = VS.selected_ids(lines)
    return t.fx("venue").join(wanted, "venueId", "left_semi").select("venueId", "name")


@query(
    "S21_snapshot_fingerprint",
    sql("venue", "SELECT true AS sameRows, false AS changedRow, 64 AS width FROM fx_venue LIMIT 1"),
)
def snapshot_fingerprint(t: Tables):
    columns = [c for c in FIXTURES["venue"].columns if c != "n"]
    venues = t.fx("venue")
    one = quality.fingerprint(venues, columns).withColumnRenamed("fingerprint", "a")
    again = quality.fingerprint(venues.repartition(5, "name"), columns).withColumnRenamed("fingerprint", "b")
    changed = venues.withColumn("phone", F.when(F.col("n") == 1, "changed").otherwise(F.col("phone")))
    other = quality.fingerprint(changed, columns).withColumnRenamed("fingerprint", "c")
    return one.transform(with_row, again).transform(with_row, other).select(
        (F.col("a") == F.col("b")).alias("sameRows"), (F.col("a") == F.col("c")).alias("changedRow"),
        F.length("a").alias("width"),
    )


@query(
    "S22_import_rules",
    "SELECT d.doc_id, (CASE WHEN length(text) BETWEEN 40 AND 4000 THEN 0 ELSE 1 END) + "
    "(CASE WHEN lang IN ('en', 'fr') THEN 0 ELSE 1 END) + (CASE WHEN quality IS NOT NULL THEN 0 ELSE 1 END) "
    "AS broken, concat_ws('; ', CASE WHEN length(text) BETWEEN 40 AND 4000 THEN NULL ELSE "
    "'text: must have 40 to 4000 characters' END, CASE WHEN lang IN ('en', 'fr') THEN NULL ELSE "
    "'lang: must be en or fr' END, CASE WHEN quality IS NOT NULL THEN NULL ELSE 'quality: is required' END) "
    "AS messages FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def import_rules(t: Tables):
    rows = t.table("documents").join(t.table("labels"), "doc_id", "left")
    rules = [
        ("text", F.length("text").between(40, 4000), "must have 40 to 4000 characters"),
        ("lang", F.col("lang").isin("en", "fr"), "must be en or fr"),
        ("quality", F.col("quality").isNotNull(), "is required"),
    ]
    return rows.withColumn("i", quality.issues(rules)).select(
        "doc_id", F.size("i").alias("broken"), F.array_join("i", "; ").alias("messages")
    )


