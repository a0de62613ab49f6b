"""Stored API payloads, boundaries, directory pages and structured page data."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from taproom import vocab as V
from taproom.functions import hours, tags as T, text, urls
from taproom.sources import schemas


def parse_payload(frame: DataFrame, column: str, schema: str) -> DataFrame:
    """Add `payload`; text that is not the expected JSON object stops the job."""
    parsed = F.from_json(F.col(column), schema, {"mode": "FAILFAST"})
    return frame.withColumn("payload", parsed)


def places_records(frame: DataFrame, column: str = "body") -> DataFrame:
    """Places-API answers to source A records, keeping the other columns of the frame.

    An answer without a results list is an error, and so is a place without id, name or coordinates
    or with coordinates or a price tier out of range.
    """
    keep = [name for name in frame.columns if name != column]
    parsed = parse_payload(frame, column, schemas.PLACES_PAYLOAD)
    missing = F.raise_error(F.lit("answer holds no results list")).cast("boolean")
    listed = F.when(F.col("payload.results").isNotNull(), F.lit(True)).otherwise(missing)
    parsed = parsed.where(listed)
    rows = F.col("payload.results")
    place = parsed.select(*keep, F.explode(rows).alias("r"))
    text = lambda name: F.length(F.coalesce(F.col(name), F.lit(""))) > 0
    good = (
        text("r.fsq_place_id") & text("r.name")
        & F.coalesce(F.col("r.latitude").between(-90, 90) & F.col("r.longitude").between(-180, 180), F.lit(False))
        & F.coalesce(F.col("r.price").between(1, 4), F.lit(True))
    )
    wrong = F.raise_error(F.concat(F.lit("invalid place record: "), F.to_json("r"))).cast("boolean")
    place = place.where(F.when(good, F.lit(True)).otherwise(wrong))
    return place.select(
        *keep,
        F.col("r.fsq_place_id").alias("fsqPlaceId"),
        "r.name",
        "r.latitude",
        "r.longitude",
        F.coalesce(
            F.nullif("r.location.address", F.lit("")), F.col("r.location.formatted_address")
        ).alias("address"),
        F.col("r.location.postcode").alias("postcode"),
        "r.website",
        F.col("r.tel").alias("phone"),
        F.col("r.price").alias("priceTier"),
        F.array_compact(
            F.transform(
                F.coalesce("r.categories", F.array().cast("array<struct<name:string>>")),
                lambda category: category["name"],
            )
        ).alias("categories"),
    )


def map_records(frame: DataFrame, column: str = "body") -> DataFrame:
    """Map-API answers to source B records; unnamed elements are skipped, missing coordinates fail."""
    parsed = parse_payload(frame, column, schemas.MAP_PAYLOAD)
    element = parsed.select(F.explode("payload.elements").alias("e")).where(
        F.try_element_at("e.tags", F.lit("name")).isNotNull()
    )
    tags = F.col("e.tags")
    missing = F.raise_error(F.lit("element has no coordinates")).cast("double")
    point = F.col("e.lat").isNotNull() & F.col("e.lon").isNotNull()
    amenity = F.array_compact(F.array(T.tag(tags, "amenity")))
    return element.select(
        F.concat_ws("/", "e.type", "e.id").alias("osmElementId"),
        T.tag(tags, "name").alias("name"),
        F.coalesce(F.when(point, F.col("e.lat")).otherwise(F.col("e.center.lat")), missing).alias(
            "latitude"
        ),
        F.coalesce(F.when(point, F.col("e.lon")).otherwise(F.col("e.center.lon")), missing).alias(
            "longitude"
        ),
        T.source_address(tags).alias("address"),
        T.present(tags, "addr:postcode").alias("postcode"),
        T.first_present(tags, "contact:website", "website", "url").alias("website"),
        T.first_present(tags, "contact:phone", "phone").alias("phone"),
        *[column.alias(name) for name, column in T.source_facts(tags).items()],
        amenity.alias("categories"),
    )


def grid(spark, south: float, west: float, north: float, east: float, rows: int, columns: int):
    """Tiles of a bounding box in row-major order."""
    if not (-90 <= south < north <= 90 and -180 <= west < east <= 180):
        raise ValueError("bounds must run from south-west to north-east")
    if rows < 1 or columns < 1:
        raise ValueError("rows and columns must be positive")
    step_lat, step_lon = (north - south) / rows, (east - west) / columns
    row, column = F.floor(F.col("id") / columns), F.col("id") % columns
    return spark.range(rows * columns).select(
        F.col("id").alias("tile"),
        (F.lit(south) + row * step_lat).alias("south"),
        (F.lit(west) + column * step_lon).alias("west"),
        (F.lit(south) + (row + 1) * step_lat).alias("north"),
        (F.lit(west) + (column + 1) * step_lon).alias("east"),
    )


def last_per_id(records: DataFrame, key: str, tile: str) -> DataFrame:
    """One record per id from overlapping tiles: the one of the last tile."""
    rest = [name for name in records.columns if name not in (key, tile)]
    last = records.groupBy(key).agg(F.max_by(F.struct(*rest), tile).alias("r"))
    return last.select(key, "r.*")


def boundary_rings(frame: DataFrame, column: str = "body") -> DataFrame:
    """(polygonId, ringNo, vertices) of GeoJSON text with a `boundaryId` column.

    A collection stands for its first feature. Anything but a Polygon or MultiPolygon is an error.
    """
    body = F.col(column)
    kind = F.get_json_object(body, "$.type")
    feature = F.when(kind == "FeatureCollection", F.get_json_object(body, "$.features[0]")).otherwise(
        body
    )
    of_feature = F.when(
        F.get_json_object(feature, "$.type") == "Feature", F.get_json_object(feature, "$.geometry")
    ).otherwise(feature)
    shape = frame.select("boundaryId", of_feature.alias("g")).select(
        "boundaryId",
        F.get_json_object("g", "$.type").alias("type"),
        F.get_json_object("g", "$.coordinates").alias("c"),
    )
    one = F.array(F.from_json("c", "array<array<array<double>>>"))
    many = F.from_json("c", "array<array<array<array<double>>>>")
    wrong = F.raise_error(F.lit("boundary must be a Polygon or MultiPolygon")).cast(
        "array<array<array<array<double>>>>"
    )
    polygons = F.when(F.col("type") == "Polygon", one).when(
        F.col("type") == "MultiPolygon", many
    ).otherwise(wrong)
    part = shape.select("boundaryId", F.posexplode(polygons).alias("p", "rings"))
    ring = part.select("boundaryId", "p", F.posexplode("rings").alias("ringNo", "points"))
    vertices = F.transform(
        "points", lambda point: F.struct(F.get(point, F.lit(0)).alias("lon"), F.get(point, F.lit(1)).alias("lat"))
    )
    return ring.select(
        F.concat_ws("#", "boundaryId", "p").alias("polygonId"), "ringNo", vertices.alias("vertices")
    )


DIRECTORY_ENTRY = (
    "map<string,struct<name:string,address:string,latitude:double,longitude:double,"
    "website:string,pints:array<array<string>>>>"
)


def directory_listings(pages: DataFrame, column: str = "html", key: str = "page_id") -> DataFrame:
    """Listings embedded in directory pages as one script line with a JSON object.

    Pints outside the accepted price range, and listings left without pints or coordinates, drop
    out; a page without the line stops the job.
    """
    line = F.regexp_extract(F.col(column), r"(?m)^[ \t]*var pubsData = (.*);[ \t]*$", 1)
    body = F.when(line != "", line).otherwise(
        F.raise_error(F.lit("directory page holds no listing data")).cast("string")
    )
    entry = pages.select(key, F.explode(F.from_json(body, DIRECTORY_ENTRY)).alias("entryKey", "v"))
    amount = lambda pint: F.get(pint, F.lit(1)).try_cast("double")
    pints = F.transform(
        F.filter(
            F.coalesce("v.pints", F.array().cast("array<array<string>>")),
            lambda pint: (F.size(pint) == 2) & amount(pint).between(V.PRICE_MIN, V.PRICE_MAX),
        ),
        lambda pint: F.struct(F.trim(F.get(pint, F.lit(0))).alias("name"), amount(pint).alias("price")),
    )
    listing = entry.select(
        F.concat_ws("/", F.col(key).cast("string"), "entryKey").alias("listingId"),
        F.trim(F.coalesce("v.name", F.lit(""))).alias("sourceName"),
        F.coalesce("v.address", F.lit("")).alias("sourceAddress"),
        text.full_postcode(F.coalesce("v.address", F.lit(""))).alias("sourcePostcode"),
        F.col("v.latitude").alias("latitude"),
        F.col("v.longitude").alias("longitude"),
        F.nullif("v.website", F.lit("")).alias("website"),
        pints.alias("pints"),
    )
    return listing.where(
        (F.size("pints") > 0) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    )


LD_BLOCK = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
VENUE_TYPE = "(?i)bar|pub|restaurant|cafe|localbusiness|foodestablishment"


def _strings(value: Column) -> Column:
    """A JSON value that is one string or a list of strings, as a list."""
    return F.when(value.startswith("["), F.from_json(value, "array<string>")).otherwise(
        F.array(value)
    )


def _address(value: Column) -> Column:
    parts = [
        text.blank_to_null(F.get_json_object(value, f"$.{name}"))
        for name in ("streetAddress", "addressLocality", "postalCode")
    ]
    joined = F.nullif(F.concat_ws(", ", *parts), F.lit(""))
    return F.when(value.startswith("{"), joined).otherwise(text.blank_to_null(value))


def _specifications(value: Column) -> Column:
    """Opening hours text of one specification object or a list of them."""
    listed = F.when(value.startswith("["), value).otherwise(
        F.concat(F.lit("["), value, F.lit("]"))
    )
    items = F.from_json(listed, "array<struct<dayOfWeek:string,opens:string,closes:string>>")
    full = F.filter(
        items,
        lambda item: text.blank_to_null(item["opens"]).isNotNull()
        & text.blank_to_null(item["closes"]).isNotNull()
        & item["dayOfWeek"].isNotNull(),
    )
    per_day = F.flatten(
        F.transform(
            full,
            lambda item: F.transform(
                _strings(item["dayOfWeek"]),
                lambda day: F.struct(
                    hours.day_code(day).alias("day"),
                    text.strip(item["opens"]).alias("opens"),
                    text.strip(item["closes"]).alias("closes"),
                ),
            ),
        )
    )
    return hours.from_specifications(F.filter(per_day, lambda s: s["day"].isNotNull()))


def page_objects(pages: DataFrame, key: str, column: str = "html", depth: int = 2) -> DataFrame:
    """(key, pos, body) of every object in a page's structured data, in document order.

    Lists and nested graphs are flattened inside one array expression, so a page is read once.
    """


    def items(value: Column) -> Column:
        listed = F.from_json(value, "array<string>")
        parts = F.when(value.startswith("["), listed).otherwise(F.array(value))
        return F.filter(parts, lambda part: F.coalesce(part.startswith("{"), F.lit(False)))

    def with_graph(value: Column, level: int) -> Column:
        if level == 0:
            return F.array(value)
        inner = items(F.get_json_object(value, "$['@graph']"))
        below = F.flatten(F.transform(inner, lambda part: with_graph(part, level - 1)))
        return F.concat(F.array(value), below)

    blocks = F.transform(F.regexp_extract_all(F.col(column), F.lit(LD_BLOCK), 1), text.strip)
    whole = F.filter(blocks, lambda block: F.try_parse_json(block).isNotNull())
    objects = F.flatten(
        F.transform(
            whole,
            lambda block: F.flatten(F.transform(items(block), lambda o: with_graph(o, depth))),
        )
    )
    return pages.select(key, F.posexplode(objects).alias("pos", "body"))


LD_OBJECT = (
    "struct<`@type`:string,name:string,telephone:string,openingHours:string,"
    "openingHoursSpecification:string,address:string>"
)


def site_data(pages: DataFrame, key: str, name: str | None = None, column: str = "html") -> DataFrame:
    """Hours, phone and address of each page: first usable value over its objects, independently.

    `name` is the column with the expected venue name; without it any venue-like object counts.
    Each object is parsed once, inside an array expression, before anything is filtered.
    """
    objects = page_objects(pages, key, column)
    expected = F.lit(None).cast("string")
    if name is not None:
        wanted = pages.select(key, text.site_name(F.col(name)).alias("_expected"))
        objects, expected = objects.join(wanted, key), F.col("_expected")

    def read(item: Column) -> Column:
        return F.struct(
            F.array_join(_strings(item["@type"]), " ").alias("kind"),
            text.blank_to_null(item["name"]).alias("title"),
            F.array_join(_strings(item["openingHours"]), "; ").alias("listed"),
            _specifications(item["openingHoursSpecification"]).alias("specified"),
            text.blank_to_null(item["telephone"]).alias("sitePhone"),
            _address(item["address"]).alias("siteAddress"),
        )

    parsed = F.transform(F.array(F.from_json("body", LD_OBJECT)), read)
    rows = objects.select(key, "pos", expected.alias("expected"), F.explode(parsed).alias("o"))
    venue_like = F.coalesce(F.rlike(F.col("o.kind"), F.lit(VENUE_TYPE)), F.lit(False))
    if name is None:
        usable = venue_like | F.col("o.kind").isNull()
    else:
        same = text.site_name(F.col("o.title")) == F.col("expected")
        usable = F.coalesce(same, F.lit(False)) | (venue_like & F.col("o.title").isNull())
    values = ("siteHours", "sitePhone", "siteAddress")
    hours_text = F.coalesce(hours.valid(F.col("o.listed")), hours.valid(F.col("o.specified")))
    found = rows.where(usable).select(
        key, "pos", hours_text.alias("siteHours"), "o.sitePhone", "o.siteAddress"
    )
    first = found.groupBy(key).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in values]
    )
    return pages.select(key).join(first, key, "left")


ANCHOR = r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"


def booking_link(pages: DataFrame, key: str, column: str = "html", base: str = "url") -> DataFrame:
    """First usable booking link of each page, absolute."""
    found = F.arrays_zip(
        F.regexp_extract_all(F.col(column), F.lit(ANCHOR), 1).alias("href"),
        F.regexp_extract_all(F.col(column), F.lit(ANCHOR), 2).alias("label"),
    )

    anchors = pages.select(key, base, F.posexplode(found).alias("pos", "a"))
    href, label = text.strip(F.col("a.href")), text.strip_markup(F.col("a.label"))
    signal = F.lower(F.concat_ws(" ", href, label))
    refused = F.rlike(signal, F.lit("privacy|cookie|unsubscribe|gift card"))
    said = F.rlike(signal, F.lit("book|reserv|reserve|table"))
    links = anchors.where(~refused).select(
        key, "pos", said.alias("said"), absolute(F.col(base), href).alias("link")
    )
    host = urls.site_host(F.col("link"))
    good = (
        urls.is_http(F.col("link"))
        & ~urls.host_in(host, V.SOCIAL_HOSTS)
        & (F.col("said") | urls.host_in(host, V.BOOKING_HOSTS))
    )
    first = links.where(good).groupBy(key).agg(F.min_by("link", "pos").alias("bookingUrl"))
    return pages.select(key).join(first, key, "left")


@F.pandas_udf(StringType())
def absolute(base: pd.Series, href: pd.Series) -> pd.Series:
    """Absolute form of a link on a page; null when it cannot be read as a url."""

    def join(pair):
        try:
            return urljoin(pair[0] or "", pair[1] or "")
        except ValueError:
            return None

    return pd.Series([join(pair) for pair in zip(base, href, strict=True)], dtype="object")


def first_over(frame: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """First non-null value of each column per key, each column on its own."""
    return frame.groupBy(key).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    )


def newest_per_key(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in the given order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")
