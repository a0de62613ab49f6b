"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from taproom import vocab as V
from taproom.catalog.base import Tables, query, sql
from taproom.catalog.filters import AREA_TEXT, SEARCH_INDEX_SQL, YES_NO
from taproom.catalog.joins import (
    BAND, q_directory, q_domain, q_full_postcode, q_haversine, q_match_name, q_path, q_tokens,
)
from taproom.catalog.scans import Q_FACT_COLUMNS, Q_SOURCE_ADDRESS
from taproom.catalog.windows import q_site_name
from taproom.functions import geo, hours, similarity, tags as T, text, urls
from taproom.operators import canonical, filters, matching
from taproom.operators.feedback import label_from_rating


@query(
    "H01_haversine",
    sql(
        "venue place_b",
        f"SELECT v.n, round({q_haversine('v.latitude', 'v.longitude', 'p.latitude', 'p.longitude')}, 4) AS metres, "
        "CASE v.area "
        + " ".join(
            f"WHEN '{area}' THEN round({q_haversine(f'{lat}E0', f'({lon}E0)', 'v.latitude', 'v.longitude', '6371.0E0')}, 2)"
            for area, (lat, lon) in V.AREA_CENTRES.items()
        )
        + " END AS areaKm FROM fx_venue v JOIN fx_place_b p ON p.n = v.n",
    ),
)
def haversine(t: Tables):
    b = t.fx("place_b").select("n", F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"))
    metres = geo.haversine(F.col("latitude"), F.col("longitude"), F.col("lat2"), F.col("lon2"))
    km = geo.area_distance_km(F.col("area"), F.col("latitude"), F.col("longitude"))
    return t.fx("venue").join(b, "n").select("n", F.round(metres, 4).alias("metres"), km.alias("areaKm"))


@query(
    "H03_match_name",
    sql("venue place_b", f"SELECT n, {q_match_name('name')} AS name FROM fx_venue UNION ALL SELECT -n - 1, {q_match_name('name')} FROM fx_place_b"),
)
def match_name(t: Tables):
    one = t.fx("venue").select("n", text.match_name(F.col("name")).alias("name"))
    two = t.fx("place_b").select((-F.col("n") - 1).alias("n"), text.match_name(F.col("name")).alias("name"))
    return one.unionByName(two)


@query("H04_directory_name", sql("listing", f"SELECT listingId, {q_directory('sourceName')} AS name FROM fx_listing"))
def directory_name(t: Tables):
    decoded = text.decode_common_entities(F.col("sourceName"))
    return t.fx("listing").select("listingId", text.directory_name(decoded).alias("name"))


@query("H05_site_name", sql("venue", f"SELECT venueId, {q_site_name('name')} AS name FROM fx_venue"))
def site_name(t: Tables):
    return t.fx("venue").select("venueId", text.site_name(F.col("name")).alias("name"))


@query(
    "H06_names_compatible",
    sql(
        "venue listing",
        "SELECT v.n, a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) AS compatible FROM "
        f"(SELECT n, {q_directory('name')} AS a FROM fx_venue) v JOIN (SELECT n + 1 AS n, {q_directory('sourceName')} AS b FROM fx_listing) l ON l.n = v.n",
    ),
)
def names_compatible(t: Tables):
    one = t.fx("venue").select("n", text.directory_name(F.col("name")).alias("a"))
    decoded = text.decode_common_entities(F.col("sourceName"))
    two = t.fx("listing").select((F.col("n") + 1).alias("n"), text.directory_name(decoded).alias("b"))
    return one.join(two, "n").select("n", text.names_compatible(F.col("a"), F.col("b")).alias("compatible"))


@query(
    "H07_postcode_forms",
    sql(
        "listing",
        f"SELECT listingId, {q_full_postcode('sourceAddress')} AS full, lower(regexp_replace(sourceAddress, '\\s+', '', 'g')) AS squeezed, "
        "nullif(regexp_extract(sourceAddress, '(?i)\\b([A-Z]{1,2}\\d[A-Z]?)\\b', 1), '') AS outward FROM fx_listing",
    ),
)
def postcode_forms(t: Tables):
    address = F.col("sourceAddress")
    outward = F.nullif(F.regexp_extract(address, V.OUTWARD_POSTCODE, 1), F.lit(""))
    return t.fx("listing").select(
        "listingId", text.full_postcode(address).alias("full"), text.postcode_key(address).alias("squeezed"),
        outward.alias("outward"),
    )


@query(
    "H08_website_signature",
    sql("listing", f"SELECT listingId, {q_domain('website')} AS domain, {q_path('website')} AS path FROM fx_listing"),
)
def website_signature(t: Tables):
    return t.fx("listing").select(
        "listingId", urls.domain_key(F.col("website")).alias("domain"), urls.website_path_key(F.col("website")).alias("path")
    )


@query("H09_phone_key", sql("venue", "SELECT venueId, right(regexp_replace(phone, '\\D', '', 'g'), 10) AS phone FROM fx_venue"))
def phone_key(t: Tables):
    return t.fx("venue").select("venueId", text.phone_key(F.col("phone")).alias("phone"))


@query(
    "H10_address_tokens",
    sql("listing", f"SELECT listingId, array_to_string(list_sort({q_tokens('sourceAddress')}), ' ') AS tokens FROM fx_listing"),
)
def address_tokens(t: Tables):
    tokens = F.array_join(F.array_sort(text.address_tokens(F.col("sourceAddress"))), " ")
    return t.fx("listing").select("listingId", tokens.alias("tokens"))


@query(
    "H11_score_class",
    sql("run", "SELECT caseId, docId, CASE WHEN score >= 0.9E0 THEN 'definite' WHEN score >= 0.78E0 THEN 'likely' WHEN score >= 0.6E0 THEN 'review' ELSE 'noMatch' END AS status FROM fx_run"),
)
def score_class(t: Tables):
    return t.fx("run").select("caseId", "docId", matching.status(F.col("score")).alias("status"))


@query(
    "H12_price_band",
    sql("price venue", f"SELECT p.observationId, {BAND.format('p.observedPriceGbp')} AS band, v.priceLevel AS tierLevel FROM fx_price p JOIN fx_venue v ON v.venueId = p.venueId"),
)
def price_band(t: Tables):
    tier = t.fx("venue").select("venueId", canonical.price_level(F.col("priceTier")).alias("tierLevel"))
    rows = t.fx("price").join(tier, "venueId")
    return rows.select("observationId", canonical.price_band(F.col("observedPriceGbp")).alias("band"), "tierLevel")


@query("H13_tag_facts", sql("tagged", f"SELECT id, {Q_FACT_COLUMNS} FROM fx_tagged"))
def tag_facts(t: Tables):
    found = T.source_facts(F.col("tags"))
    return t.tagged().select("id", *[c.alias(name) for name, c in found.items()])


Q_WIFI = "CASE WHEN lower(trim(t_wifi)) IN ('wlan', 'yes', 'free') THEN true WHEN lower(trim(t_wifi)) IN ('no', 'none') THEN false END"
Q_CUISINES = "list_filter(list_transform(string_split(coalesce(t_cuisine, ''), ';'), lambda x: lower(trim(x))), lambda x: x <> '')"


@query(
    "H14_client_tags",
    sql(
        "tagged",
        f"SELECT id, {YES_NO.format('t_food')} AS hasFood, {YES_NO.format('t_outdoor')} AS hasOutdoorSeating, {YES_NO.format('t_sport')} AS hasLiveSport, "
        f"{Q_WIFI} AS hasWifi, {YES_NO.format('t_vegan')} AS hasVeganOptions, array_to_string({Q_CUISINES}, '|') AS cuisines, t_suburb AS area FROM fx_tagged",
    ),
)
def client_tags(t: Tables):
    found = T.client_fields(F.col("tags"))
    names = ("hasFood", "hasOutdoorSeating", "hasLiveSport", "hasWifi", "hasVeganOptions", "area")
    return t.tagged().select(
        "id", *[found[n].alias(n) for n in names], F.array_join(found["cuisines"], "|").alias("cuisines")
    )


Q_STREET = (
    "coalesce(CASE WHEN t_number IS NULL AND t_street IS NULL THEN NULL ELSE concat_ws(' ', t_number, t_street) END, NULL)"
)
Q_CLIENT_ADDRESS = (
    "coalesce(t_full, nullif(trim(address), ''), nullif(array_to_string(list_filter([" + Q_STREET
    + ", t_suburb, t_city, t_postcode], lambda x: x IS NOT NULL), ', '), ''))"
)


@query(
    "H15_address_assembly",
    sql(
        "tagged",
        f"SELECT id, {Q_SOURCE_ADDRESS} AS sourceAddress, {Q_CLIENT_ADDRESS} AS clientAddress, "
        "nullif(concat_ws(', ', t_number, t_street, t_city, t_postcode), '') AS importAddress FROM fx_tagged",
    ),
)
def address_assembly(t: Tables):
    tags = F.col("tags")
    return t.tagged().select(
        "id", T.source_address(tags).alias("sourceAddress"), T.client_address(tags, F.col("address")).alias("clientAddress"),
        T.import_address(tags).alias("importAddress"),
    )


@query(
    "H16_valid_hours",
    sql("tagged", "SELECT id, CASE WHEN t_hours IN ('Mo-Su 25:00-26:00', 'call us') THEN NULL ELSE t_hours END AS validHours FROM fx_tagged"),
)
def valid_hours(t: Tables):
    return t.fx("tagged").select("id", hours.valid(F.col("t_hours")).alias("validHours"))


WEEK = "(VALUES (1, 'Monday'), (2, 'Tuesday'), (3, 'Wednesday'), (4, 'Thursday'), (5, 'Friday'), (6, 'Saturday'), (7, 'Sunday')) d(i, day)"


@query(
    "H17_weekly_hours",
    sql(
        "tagged",
        "SELECT id, day, CASE n % 9 WHEN 0 THEN '11:00–23:00' WHEN 1 THEN 'Open 24 hours' WHEN 2 THEN CASE WHEN i <= 4 THEN '12:00–23:00' "
        "WHEN i <= 6 THEN '12:00–00:00' ELSE '12:00–22:30' END WHEN 5 THEN '25:00–26:00' WHEN 7 THEN '11:00–15:00, 17:00–01:30' END AS hours "
        f"FROM fx_tagged, {WEEK} WHERE n % 9 IN (0, 1, 2, 5, 7)",
    ),
)
def weekly_hours(t: Tables):
    rows = t.fx("tagged").select("id", F.explode(hours.weekly(F.col("t_hours"))).alias("r"))
    return rows.select("id", "r.day", "r.hours")


@query(
    "H18_open_late",
    sql(
        "tagged",
        "SELECT id, CASE n % 9 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true "
        "WHEN 5 THEN true WHEN 7 THEN true ELSE NULL END AS openLate FROM fx_tagged",
    ),
)
def open_late(t: Tables):
    return t.fx("tagged").select("id", hours.open_late(F.col("t_hours")).alias("openLate"))


STOP = ", ".join(f"'{w}'" for w in V.RETRIEVAL_STOP_WORDS)


def q_tokens_of(column: str) -> str:
    return (
        f"list_filter(list_distinct(regexp_extract_all(lower({column}), '[a-z0-9]+')), lambda x: length(x) > 1 AND x NOT IN ({STOP}))"
    )


@query(
    "H19_retrieval_tokens",
    f"SELECT doc_id, array_to_string(list_sort({q_tokens_of('text')}), ' ') AS tokens FROM documents",
)
def retrieval_tokens(t: Tables):
    tokens = F.array_join(F.array_sort(text.retrieval_tokens(F.col("text"))), " ")
    return t.table("documents").select("doc_id", tokens.alias("tokens"))


@query(
    "H20_cosine",
    "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity "
    "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def cosine(t: Tables):
    one = t.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    two = one.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return one.join(two, "vec_id").select(
        "vec_id", F.round(similarity.cosine(F.col("a"), F.col("b")), 6).alias("similarity")
    )


@query(
    "H28_passage_key",
    "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS passageKey FROM documents",
)
def passage_key(t: Tables):
    return t.table("documents").select("doc_id", text.words_only(F.col("text")).alias("passageKey"))


@query(
    "H40_search_index",
    sql("tagged", f"SELECT id, {SEARCH_INDEX_SQL} AS searchIndex FROM fx_tagged"),
)
def search_index(t: Tables):
    return t.tagged().select(
        "id", T.search_index(F.col("name"), F.col("address"), F.col("tags")).alias("searchIndex")
    )


@query(
    "H41_area_from_text",
    sql(
        "tagged",
        f"SELECT id, {AREA_TEXT} AS area, CASE WHEN len(parts) > 1 THEN trim(parts[len(parts) - 1]) ELSE trim(parts[1]) END AS part FROM "
        "(SELECT id, coalesce(address, '') || ' ' || coalesce(t_suburb, '') AS h, list_filter(string_split(coalesce(nullif(address, ''), 'London'), ','), "
        "lambda x: trim(x) <> '') AS parts FROM fx_tagged)",
    ),
)
def area_from_text(t: Tables):
    whole = F.concat_ws(" ", F.coalesce("address", F.lit("")), F.coalesce("t_suburb", F.lit("")))
    address = F.coalesce(F.nullif("address", F.lit("")), F.lit("London"))
    parts = F.filter(F.transform(F.split(address, ","), text.strip), lambda part: part != "")
    part = F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(-2))).otherwise(F.get(parts, F.lit(0)))
    return t.fx("tagged").select("id", filters.text_area(whole).alias("area"), part.alias("part"))


Q_LABELS = ", ".join(
    f"CASE WHEN contains(s, '{needle}')"
    + (" AND NOT contains(s, 'live music')" if label == "Music" else "")
    + (" AND NOT contains(s, 'sunday roast')" if label == "Roast dinners" else "")
    + f" THEN '{label}' END"
    for needle, label in V.CLIENT_LABELS
)


@query(
    "H42_client_labels",
    sql(
        "venue",
        f"SELECT venueId, array_to_string(list_filter([{Q_LABELS}], lambda x: x IS NOT NULL), '|') AS labels FROM "
        "(SELECT venueId, lower(concat(tagsText, CASE n % 4 WHEN 0 THEN ' Sunday roast' WHEN 1 THEN ' roast craft beer' WHEN 2 THEN ' Music, dog' ELSE '' END)) AS s FROM fx_venue)",
    ),
)
def client_labels(t: Tables):
    k = F.col("n") % 4
    extra = F.when(k == 0, " Sunday_roast").when(k == 1, " roast craft_beer").when(k == 2, " Music, dog").otherwise("")
    labels = F.array_join(T.client_labels(F.concat("tagsText", extra)), "|")
    return t.fx("venue").select("venueId", labels.alias("labels"))


@query(
    "H43_feedback_from_rating",
    sql("rating", "SELECT pos, CASE WHEN rating > 4 THEN 'like' WHEN rating < 2 THEN 'dislike' END AS eventType FROM fx_rating"),
)
def feedback_from_rating(t: Tables):
    return t.fx("rating").select("pos", label_from_rating(F.col("rating")).alias("eventType"))


@query(
    "H45_text_trim_and_blank",
    "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'query must not be blank' WHEN length(trim(regexp_replace(text, '\\s+$|^\\s+', '', 'g'))) > 500 "
    "THEN 'query is too long' END AS problem FROM conversations",
)
def trim_and_blank(t: Tables):
    given = F.when(F.col("turn") % 3 == 0, "  \t ").otherwise(F.concat(F.lit("  "), F.col("text"), F.lit(" \n")))
    trimmed = text.strip(given)
    problem = F.when(trimmed == "", "query must not be blank").when(F.length(trimmed) > 500, "query is too long")
    return t.table("conversations").select("conv_id", "turn", problem.alias("problem"))


@query(
    "H46_schema_day_code",
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Mo' WHEN 1 THEN 'Tu' WHEN 2 THEN 'We' WHEN 3 THEN 'Su' END AS code FROM events",
)
def schema_day(t: Tables):
    k = F.col("event_id") % 5
    day = (
        F.when(k == 0, "https://schema.org/Monday").when(k == 1, "tuesday").when(k == 2, "We")
        .when(k == 3, "HTTP://schema.org/SUNDAY").otherwise("someday")
    )
    return t.table("events").select("event_id", hours.day_code(day).alias("code"))


@query(
    "H47_html_strip",
    "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '(?i)&amp;', '&', 'g'), "
    "'(?i)&quot;', '\"', 'g'), '(?i)&#39;', '''', 'g'), '\\s+', ' ', 'g')) AS plain FROM pages",
)
def html_strip(t: Tables):
    return t.table("pages").select("page_id", text.strip_markup(F.col("html")).alias("plain"))


@query(
    "H48_tag_slug",
    sql("venue", "SELECT venueId, array_to_string(list_sort(list_distinct(list_transform(string_split(tagsText, '|'), lambda x: replace(lower(x), ' ', '-')))), '|') AS slugs FROM fx_venue"),
)
def tag_slug(t: Tables):
    slugs = F.array_join(text.tag_slugs(F.split("tagsText", r"\|")), "|")
    return t.fx("venue").select("venueId", slugs.alias("slugs"))


@query(
    "H49_record_date_max",
    sql(
        "venue price",
        "SELECT v.venueId, greatest(v.lastVerifiedDate, max(CAST(p.observedAt AS DATE))) AS latest FROM fx_venue v LEFT JOIN fx_price p "
        "ON p.venueId = v.venueId GROUP BY v.venueId, v.lastVerifiedDate",
    ),
)
def record_date_max(t: Tables):
    seen = t.fx("price").groupBy("venueId").agg(F.max(F.to_date("observedAt")).alias("seen"))
    return t.fx("venue").join(seen, "venueId", "left").select(
        "venueId", F.greatest("lastVerifiedDate", "seen").alias("latest")
    )


@query(
    "H50_tag_value_fallback",
    sql(
        "tagged",
        "SELECT id, trim(t_phone) AS phone, CASE WHEN regexp_matches(w, '(?i)^https?://') THEN w ELSE 'https://' || w END AS website, "
        "coalesce(t_operator, t_brand) AS operator, array_to_string(list_filter(list_transform(string_split_regex(coalesce(nullif(t_cuisine, ''), ''), '[;,]'), "
        "lambda x: trim(x)), lambda x: x <> ''), '|') AS cuisine FROM (SELECT *, coalesce(t_website, t_website2) AS w FROM fx_tagged)",
    ),
)
def tag_fallback(t: Tables):
    tags, none = F.col("tags"), F.lit(None).cast("string")
    site = T.root_or_tag(none, tags, "website", "contact:website")
    cuisine = T.cuisine_list(F.coalesce(T.root_or_tag(none, tags, "cuisine"), F.lit("")))
    return t.tagged().select(
        "id", T.root_or_tag(none, tags, "phone", "contact:phone").alias("phone"), T.web_address(site).alias("website"),
        T.root_or_tag(none, tags, "operator", "brand").alias("operator"), F.array_join(cuisine, "|").alias("cuisine"),
    )


@query(
    "H51_image_source",
    sql(
        "tagged",
        "SELECT id, CASE n % 6 WHEN 0 THEN 'https://commons.wikimedia.org/wiki/Special:FilePath/The%20Old%20Pub.jpg?width=1200' "
        "WHEN 1 THEN 'https://commons.wikimedia.org/wiki/Special:FilePath/Plain%20name.png?width=1200' ELSE "
        "CASE WHEN n % 5 = 0 THEN 'https://img.example/a.jpg' END END AS image, CASE n % 4 WHEN 0 THEN t_wikidata WHEN 1 THEN 'Q77' END AS wikidata FROM fx_tagged",
    ),
)
def image_source(t: Tables):
    tags, none = F.col("tags"), F.lit(None).cast("string")
    commons = T.root_or_tag(none, tags, "wikimedia_commons", "wikimedia")
    direct = T.root_or_tag(none, tags, "image")
    return t.tagged().select(
        "id", T.image_url(commons, direct).alias("image"), T.wikidata_id(T.tag(tags, "wikidata")).alias("wikidata")
    )


@query(
    "H52_detail_labels",
    sql(
        "tagged",
        "SELECT id, CASE n % 4 WHEN 0 THEN 'Hours from manual correction' WHEN 1 THEN 'Hours from official website' WHEN 2 THEN 'Hours from OpenStreetMap' "
        "ELSE CASE WHEN t_hours IS NOT NULL THEN 'Hours from OpenStreetMap' END END AS hoursLabel, "
        "array_to_string(list_filter(["
        f"CASE WHEN {YES_NO.format('t_food')} THEN 'Food' END, CASE WHEN {YES_NO.format('t_outdoor')} THEN 'Outdoor seating' END, "
        f"CASE WHEN {YES_NO.format('t_sport')} THEN 'Live sport' END, CASE WHEN {Q_WIFI} THEN 'Wi-Fi' END, "
        f"CASE WHEN {YES_NO.format('t_vegan')} THEN 'Vegan options' END, "
        "CASE n % 4 WHEN 0 THEN 'Burgers|Thai' WHEN 1 THEN 'British|Fish & Chips' END], lambda x: x IS NOT NULL), '|') AS labels FROM fx_tagged",
    ),
)
def detail_labels(t: Tables):
    tags, none = F.col("tags"), F.lit(None).cast("string")
    k = F.col("n") % 4
    source = F.when(k == 0, "manual").when(k == 1, "official").when(k == 2, "osm")
    cuisine = T.cuisine_list(T.root_or_tag(none, tags, "cuisine"))
    labels = T.detail_labels(T.client_fields(tags), cuisine)
    return t.tagged().select("id", T.hours_label(source, tags).alias("hoursLabel"), F.array_join(labels, "|").alias("labels"))


@query(
    "U02_entity_decode",
    "SELECT page_id, replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'), '&lt;', '<') AS title FROM pages",
)
def entity_decode(t: Tables):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return t.table("pages").select("page_id", similarity.decode_entities(title).alias("title"))


@query(
    "U03_matches_with_offsets",
    "SELECT doc_id, list_sum(list_transform(regexp_extract_all(text, '[A-Za-z]*the[a-z]*'), lambda x: length(x))) AS matchedChars, "
    "len(regexp_extract_all(text, '[A-Za-z]*the[a-z]*')) AS matches, nullif(strpos(text, regexp_extract(text, '[A-Za-z]*the[a-z]*')) - 1, -1) AS firstStart "
    "FROM documents WHERE contains(text, 'the')",
)
def matches_with_offsets(t: Tables):
    rows = t.table("documents").where(F.contains("text", F.lit("the"))).select(
        "doc_id", "text", text.all_matches(F.col("text"), "[A-Za-z]*the[a-z]*").alias("spans")
    )
    exact = F.col("s.text") == F.substr("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    spans = rows.select("doc_id", "text", F.explode("spans").alias("s"))
    return spans.groupBy("doc_id").agg(
        F.sum(F.when(exact, F.col("s.end") - F.col("s.start"))).alias("matchedChars"),
        F.count_if(exact).alias("matches"),
        F.min("s.start").alias("firstStart"),
    )
