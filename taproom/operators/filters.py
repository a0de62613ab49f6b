"""Row filters: hard candidate filter, search filters, polygon test, evidence keep rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taproom import vocab as V
from taproom.functions import facts, text, urls
from taproom.operators.skew import pairs_join, piece_count, shuffle_partitions, with_row
from taproom.session import cut


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda left, right: left & right, conditions, F.lit(True))


def hard_filter(prefs: dict) -> Column:
    """Filter for one request whose preferences are plain Python values.

    Only the conditions the request has are built, so Catalyst pushes them into the scan.
    """
    if prefs.get("contradictions"):
        return F.lit(False)
    conditions = []
    if prefs.get("location"):
        conditions.append(F.col("area") == prefs["location"])
    if prefs.get("postcode"):
        wanted = "".join(prefs["postcode"].upper().split())
        conditions.append(text.postcode_prefix_key(F.col("postcode")).startswith(wanted))
    if prefs.get("excludedLocations"):
        conditions.append(~F.col("area").isin(*prefs["excludedLocations"]))
    if prefs.get("excludedPriceLevels"):
        conditions.append(~F.col("priceLevel").isin(*prefs["excludedPriceLevels"]))
    conditions += [
        facts.is_true(facts.feature_column(feature)) for feature in prefs.get("requiredFeatures", ())
    ]
    conditions += [
        facts.is_false(facts.feature_column(feature))
        for feature in prefs.get("excludedFeatures", ())
    ]
    return all_of(conditions)


def fact_masks(prefix: str = "") -> tuple[Column, Column]:
    """Known-true and known-false features as two integers, one bit per feature."""
    names = [facts.feature_sql(name, prefix) for name in (*V.FEATURES, *V.NOISE_FEATURES)]
    return (
        F.expr(facts.bits_sql([f"{name} <=> true" for name in names])),
        F.expr(facts.bits_sql([f"{name} <=> false" for name in names])),
    )


def feature_mask(features: Column) -> Column:
    """A list of feature names as one integer with the same bits."""
    names = (*V.FEATURES, *V.NOISE_FEATURES)
    bits = F.expr("map(" + ", ".join(f"'{name}', {1 << i}L" for i, name in enumerate(names)) + ")")
    return F.aggregate(
        F.array_distinct(features),
        F.lit(0).cast("long"),
        lambda state, name: state + F.coalesce(F.try_element_at(bits, name), F.lit(0)),
    )


def candidates(requests: DataFrame, venues: DataFrame, pieces: int | None = None) -> DataFrame:
    """Request x venue pairs that pass every hard condition of the request.

    `requests` has a `prefs` struct, `venues` the fact columns. Each request is routed to one key
    it cannot match without (its area, else a required fact, else an excluded fact, else "any"),
    and a venue is sent to every key it satisfies, so the pairs come from an equi-join instead of a
    product. Keys are few and large by nature, so both sides carry a piece number: venues are dealt
    over the pieces, requests copied to each. The number of pieces follows the session's shuffle
    partitions within bounds. Venues are dealt over all partitions first: their table is small
    in bytes, a task or two, but pairs are many times its rows.
    """
    if pieces is None:
        pieces = piece_count(venues)
    venues = venues.repartition(shuffle_partitions(venues), "venueId")
    prefs = F.col("prefs")
    names = (*V.FEATURES, *V.NOISE_FEATURES)
    request_key = F.coalesce(
        F.concat(F.lit("area:"), prefs["location"]),
        F.concat(F.lit("true:"), F.get(prefs["requiredFeatures"], F.lit(0))),
        F.concat(F.lit("false:"), F.get(prefs["excludedFeatures"], F.lit(0))),
        F.lit("any"),
    )
    routed = (
        requests.where(F.size(prefs["contradictions"]) == 0)
        .withColumn("_key", request_key)
        .withColumn("_need", feature_mask(prefs["requiredFeatures"]))
        .withColumn("_avoid", feature_mask(prefs["excludedFeatures"]))
        .withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    )
    true_bits, false_bits = fact_masks()
    routes = ", ".join(
        f"CASE WHEN {facts.feature_sql(name)} THEN 'true:{name}' "
        f"WHEN NOT {facts.feature_sql(name)} THEN 'false:{name}' END"
        for name in names
    )
    keys = F.expr(f"array_compact(array('any', concat('area:', area), {routes}))")
    # At most one key an area and two a feature; a venue is not sent to those that no request has.
    asked = requests.where(F.size(prefs["contradictions"]) == 0).agg(F.collect_set(request_key).alias("_asked"))
    spread = (
        with_row(venues, asked)
        .withColumn("_key", F.explode(F.array_intersect(keys, "_asked")))
        .withColumn("_true", true_bits)
        .withColumn("_false", false_bits)
        .withColumn("_piece", F.pmod(F.xxhash64("venueId"), F.lit(pieces)).cast("int"))
        .drop("_asked")
    )
    postcode = text.postcode_prefix_key(F.col("postcode"))
    conditions = [
        prefs["location"].isNull() | (F.col("area") == prefs["location"]),
        prefs["postcode"].isNull() | postcode.startswith(prefs["postcode"]),
        ~F.array_contains(prefs["excludedLocations"], F.col("area")),
        (F.size(prefs["excludedPriceLevels"]) == 0)
        | (
            F.col("priceLevel").isNotNull()
            & ~F.array_contains(prefs["excludedPriceLevels"], F.col("priceLevel"))
        ),
        F.col("_true").bitwiseAND(F.col("_need")) == F.col("_need"),
        F.col("_false").bitwiseAND(F.col("_avoid")) == F.col("_avoid"),
    ]
    pairs = routed.join(spread, ["_key", "_piece"]).where(all_of(conditions))
    return pairs.drop("_key", "_piece", "_need", "_avoid", "_true", "_false")


def relevant(required: Column, excluded: Column, prefix: str = "") -> Column:
    """All required facts true, all excluded facts false, and at least one of them named."""
    values = facts.fact_map(prefix)
    return (
        (F.size(required) + F.size(excluded) > 0)
        & F.forall(required, lambda name: F.try_element_at(values, name).eqNullSafe(F.lit(True)))
        & F.forall(excluded, lambda name: F.try_element_at(values, name).eqNullSafe(F.lit(False)))
    )


def facet_search(
    frame: DataFrame,
    index: Column,
    query: str,
    facets: tuple[str, ...] = (),
    saved: DataFrame | None = None,
    visited: DataFrame | None = None,
    key: str = "venueId",
) -> DataFrame:
    """Rows whose search text contains the query and whose every chosen facet is known true."""
    wanted = text.search_text(F.lit(query))
    found = frame.where((wanted == "") | F.contains(index, wanted))
    for facet in facets:
        found = found.where(facts.is_true(F.col(facet)))
    for ids in (saved, visited):
        if ids is not None:
            found = found.join(ids.select(key), key, "left_semi")
    return found


def search_or_area(
    frame: DataFrame, requests: DataFrame, haystack: str, area: str
) -> DataFrame:
    """Substring hits per request (`needle`); without any, the rows of its `namedArea`."""
    pairs = cut(substring_pairs(requests, frame, "needle", haystack))
    literal = _met(requests, frame, "needle", haystack, pairs)
    # A request without a needle meets no text, so it goes to its area too.
    missed = requests.join(pairs.select(F.col("_needle").alias("needle")).distinct(), "needle", "left_anti")
    missed = missed.withColumn("_area", F.lower("namedArea"))
    fallback = pairs_join(frame.withColumn("_area", F.lower(F.col(area))), missed, ["_area"]).drop("_area")
    return literal.unionByName(fallback)


def named_area(query: Column) -> Column:
    """First supported area named in a request."""
    lowered = F.lower(query)
    return F.coalesce(
        *[
            F.when(F.contains(lowered, F.lit(area.lower())), F.lit(area))
            for area in ("Camden", "Westminster", "Waterloo", "London Bridge", "Shoreditch", "Brixton")
        ]
    )


def text_area(value: Column) -> Column:
    """Area read from address and tags."""
    return (
        F.when(F.rlike(value, F.lit("(?i)camden")), F.lit("Camden"))
        .when(F.rlike(value, F.lit("(?i)westminster|soho|mayfair|pimlico")), F.lit("Westminster"))
        .otherwise(F.lit("London"))
    )


RUN = 3  # characters of the runs that texts are met on
CELL_ROWS = 20_000  # texts and needles that one task compares under one run, at most about


def _runs(value: Column, size: int) -> Column:
    """Every run of `size` characters of a text; none when it is shorter."""
    last = F.length(value) - (size - 1)
    pieces = F.transform(F.sequence(F.lit(1), last), lambda at: F.substring(value, at, size))
    return F.when(last >= 1, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def substring_pairs(
    needles: DataFrame, haystacks: DataFrame, needle: str, haystack: str, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Distinct texts (_needle, _text) of which the second contains the first. Nulls meet nothing.

    A text can contain a needle only if it contains every run of three characters of it (a shorter needle is
    its own run), so the join has an equi-key: the run of the needle that the fewest texts have. Only texts
    under a run that some needle chose are met, and a run with many texts or many needles is cut into a grid
    of cells. Every needle has one run, so a pair comes once.
    """
    asked = needles.select(F.col(needle).alias("_needle")).where(F.col("_needle").isNotNull()).distinct()
    texts = haystacks.select(F.col(haystack).alias("_text")).where(F.col("_text").isNotNull()).distinct()
    # Runs shorter than three are cut only where a needle is as short.
    lengths = asked.agg(F.collect_set(F.least(F.length("_needle"), F.lit(RUN))).alias("_lengths"))
    short = [
        F.when(F.array_contains("_lengths", size), _runs(F.col("_text"), size)).otherwise(F.array().cast("array<string>"))
        for size in range(1, RUN)
    ]
    empty = F.when(F.array_contains("_lengths", 0), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    every = F.concat(empty, *short, _runs(F.col("_text"), RUN))
    spread = with_row(texts, lengths).select("_text", F.explode(every).alias("_run"))

    own = F.when(F.length("_needle") < RUN, F.array("_needle")).otherwise(_runs(F.col("_needle"), RUN))
    counts = spread.groupBy("_run").agg(F.count("*").alias("_texts"))
    options = asked.select("_needle", F.explode(own).alias("_run")).join(counts, "_run", "left")
    # A run that no text has is the rarest: its needle meets nothing.
    rarest = options.groupBy("_needle").agg(F.min(F.struct(F.coalesce("_texts", F.lit(0)).alias("n"), "_run")).alias("r"))
    keyed = rarest.select("_needle", F.col("r._run").alias("_run"), F.col("r.n").alias("_texts")).where("_texts > 0")
    cells = keyed.groupBy("_run").agg(
        F.ceil(F.max("_texts") / cell_rows).cast("int").alias("_rows"),
        F.ceil(F.count("*") / cell_rows).cast("int").alias("_columns"),
    )

    def dealt(frame: DataFrame, value: str, mine: str, of: str, other: str, copies: str) -> DataFrame:
        placed = frame.join(cells, "_run").withColumn(mine, F.pmod(F.xxhash64(value), of).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(copies) - 1))).drop("_rows", "_columns")

    left = dealt(spread, "_text", "_row", "_rows", "_column", "_columns")
    right = dealt(keyed.drop("_texts"), "_needle", "_column", "_columns", "_row", "_rows")
    pairs = left.join(right, ["_run", "_row", "_column"]).where(F.contains("_text", "_needle"))
    return pairs.select("_needle", "_text")


def _met(needles: DataFrame, haystacks: DataFrame, needle: str, haystack: str, pairs: DataFrame) -> DataFrame:
    rows = haystacks.join(pairs, F.col(haystack) == F.col("_text")).drop("_text")
    return pairs_join(rows, needles.withColumn("_needle", F.col(needle)), ["_needle"]).drop("_needle")


def substring_join(
    needles: DataFrame, haystacks: DataFrame, needle: str, haystack: str, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Rows whose haystack contains the needle, without comparing every pair.

    Equal needles and equal texts are compared once (`substring_pairs`) and met with their rows afterwards;
    a needle with many rows on both sides is dealt over many tasks.
    """
    return _met(needles, haystacks, needle, haystack, cut(substring_pairs(needles, haystacks, needle, haystack, cell_rows)))


def direct_name_matches(requests: DataFrame, venues: DataFrame) -> DataFrame:
    """Requests and venues whose names contain one another, each pair once."""
    asked = requests.withColumn("_search", text.words_only(F.col("query")))
    asked = asked.where(F.col("_search") != "")
    named = venues.withColumn("_title", text.words_only(F.col("name")))
    inside = substring_join(asked, named, "_search", "_title")
    around = substring_join(
        named, asked.where(F.length("_search") >= 5), "_title", "_search"
    ).where(F.col("_search") != F.col("_title"))
    return inside.unionByName(around).drop("_search", "_title")


def keep_passage(block: Column, name: Column) -> Column:
    """Long enough, no page noise, prose, and about the venue or a relevant subject."""
    noise = "(?i)" + "|".join(f"(?:{pattern})" for pattern in V.PASSAGE_NOISE)
    prose = F.rlike(block, F.lit("[.!?…]$")) | (F.size(F.split(text.squeeze(block), " ")) > 15)
    about = F.rlike(block, F.lit(V.RELEVANT_PASSAGE)) | F.contains(F.lower(block), F.lower(name))
    return (F.length(block) >= V.PASSAGE_MIN) & ~F.rlike(block, F.lit(noise)) & prose & about


def image_ok(title: Column, width: Column, height: Column) -> Column:
    """Large enough, landscape, and not a logo, map or the like."""
    small = (F.coalesce(width, F.lit(0)) > 0) & (width < 500)
    low = (F.coalesce(height, F.lit(0)) > 0) & (height < 300)
    upright = (F.coalesce(width, F.lit(0)) > 0) & (F.coalesce(height, F.lit(0)) > 0) & (width < height)
    subject = "logo|icon|map|road|street|station|portrait|drawing|diagram|plan"
    return ~(small | low | upright | F.rlike(F.lower(title), F.lit(subject)))


def booking_eligible(explicit: Column, website: Column, details: Column) -> Column:
    """Booking url: the explicit one, else the official site when its features mention booking."""

    def usable(url: Column) -> Column:
        return F.coalesce(
            urls.is_http(url) & ~urls.host_in(urls.site_host(url), V.SOCIAL_HOSTS), F.lit(False)
        )

    denies = r"(?i)no (?:table )?bookings?|does not accept|walk[- ]?in only"
    offers = r"(?i)accepts? table bookings?|reservations?|booking"
    offered = F.rlike(details, F.lit(offers)) & ~F.rlike(details, F.lit(denies))
    return F.when(usable(explicit), explicit).when(usable(website) & offered, website)


# -- polygons ---------------------------------------------------------------------------------


def ring_edges(rings: DataFrame) -> DataFrame:
    """Edges of rings given as (polygonId, ringNo, vertices array<struct<lon,lat>>).

    A ring of fewer than four points is an error. Ring 0 is the outline, others are holes.
    """
    short = F.raise_error(F.lit("a ring needs at least four points")).cast(
        "array<struct<lon:double,lat:double>>"
    )
    vertices = F.when(F.size("vertices") >= 4, F.col("vertices")).otherwise(short)
    pairs = F.transform(
        vertices,
        lambda point, at: F.struct(
            F.get(vertices, F.when(at == 0, F.size(vertices) - 1).otherwise(at - 1)).alias("a"),
            point.alias("b"),
        ),
    )
    edge = rings.select("polygonId", "ringNo", F.explode(pairs).alias("e"))
    return edge.select(
        "polygonId",
        "ringNo",
        F.col("e.a.lon").alias("aLon"),
        F.col("e.a.lat").alias("aLat"),
        F.col("e.b.lon").alias("bLon"),
        F.col("e.b.lat").alias("bLat"),
    )


def in_polygons(
    points: DataFrame,
    rings: DataFrame,
    key: str,
    lon: str = "longitude",
    lat: str = "latitude",
    cell: float = 0.05,
    strip_height: float = 0.01,
) -> DataFrame:
    """(key, polygonId) of every point inside a polygon: outline counts, holes do not.

    First points meet polygons whose bounding box covers them, through grid cells. Then each such
    pair meets the edges of that polygon in the point's horizontal strip (an edge is sent to the
    strips its latitude range touches), so a pair sees only edges that can cross its ray, however
    many the polygon has. Crossings and boundary hits are summed per place and ring. Points of
    equal coordinates are one place: it is tested once, and its polygons meet its points last.
    """
    from taproom.operators.skew import split_join

    known = points.select(key, lon, lat).where(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    inside = _places_in_polygons(known.select(lon, lat).distinct(), rings, lon, lat, cell, strip_height)
    return split_join(known, inside, [lon, lat]).select(key, "polygonId")


def _places_in_polygons(
    places: DataFrame, rings: DataFrame, lon: str, lat: str, cell: float, strip_height: float
) -> DataFrame:
    """(lon, lat, polygonId) of every place inside a polygon."""
    from taproom.operators.skew import split_join

    def at(value: Column, size: float) -> Column:
        return F.floor(value / size).cast("long")

    corners = rings.where("ringNo = 0").select(
        "polygonId",
        *[
            pick(F.transform("vertices", lambda v: v[axis])).alias(name)
            for name, pick, axis in (
                ("west", F.array_min, "lon"), ("east", F.array_max, "lon"),
                ("south", F.array_min, "lat"), ("north", F.array_max, "lat"),
            )
        ],
    )
    boxes = corners.withColumn(
        "_row", F.explode(F.sequence(at(F.col("south"), cell), at(F.col("north"), cell)))
    ).withColumn("_col", F.explode(F.sequence(at(F.col("west"), cell), at(F.col("east"), cell))))
    x, y = F.col(lon), F.col(lat)
    placed = places.select(lon, lat, at(y, cell).alias("_row"), at(x, cell).alias("_col"))
    near = (
        split_join(placed, boxes, ["_row", "_col"])
        .where(x.between(F.col("west"), F.col("east")) & y.between(F.col("south"), F.col("north")))
        .select(lon, lat, "polygonId", at(y, strip_height).alias("_strip"))
    )
    low, high = F.least("aLat", "bLat"), F.greatest("aLat", "bLat")
    edges = ring_edges(rings).withColumn(
        "_strip", F.explode(F.sequence(at(low, strip_height), at(high, strip_height)))
    )
    a_lon, a_lat, b_lon, b_lat = (F.col(name) for name in ("aLon", "aLat", "bLon", "bLat"))
    cross = (y - a_lat) * (b_lon - a_lon) - (x - a_lon) * (b_lat - a_lat)
    on_edge = (
        (F.abs(cross) <= 1e-12)
        & x.between(F.least(a_lon, b_lon), F.greatest(a_lon, b_lon))
        & y.between(low, high)
    )
    crosses = ((b_lat > y) != (a_lat > y)) & (
        x < (a_lon - b_lon) * (y - b_lat) / F.nullif(a_lat - b_lat, F.lit(0.0)) + b_lon
    )
    per_ring = (
        split_join(near, edges, ["polygonId", "_strip"])
        .groupBy(lon, lat, "polygonId", "ringNo")
        .agg(
            F.max(on_edge.cast("int")).alias("edge"),
            F.sum(F.coalesce(crosses, F.lit(False)).cast("int")).alias("crossings"),
        )
        .withColumn("inside", (F.col("edge") == 1) | (F.col("crossings") % 2 == 1))
    )
    return (
        per_ring.groupBy(lon, lat, "polygonId")
        .agg(
            F.bool_or((F.col("ringNo") == 0) & F.col("inside")).alias("outline"),
            F.bool_or((F.col("ringNo") > 0) & F.col("inside")).alias("hole"),
        )
        .where(F.col("outline") & ~F.col("hole"))
        .select(lon, lat, "polygonId")
    )
