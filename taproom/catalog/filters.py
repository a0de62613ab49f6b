"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from taproom import vocab as V
from taproom.catalog.base import Tables, joined, query, sql
from taproom.catalog.requestsql import PREFS, REQUEST_TEXTS, facts_list
from taproom.catalog.scans import SQUARE, boundaries
from taproom.functions import facts, tags as T, text, urls
from taproom.operators import filters, pages
from taproom.plans import recommend
from taproom.sources import payloads

CANDIDATES = (
    "SELECT r.requestId, v.* FROM fx_request r JOIN prefs p ON p.query = r.query JOIN fx_venue v ON "
    "len(p.contradictions) = 0 AND (p.location IS NULL OR v.area = p.location) AND "
    "(p.postcode IS NULL OR starts_with(upper(replace(v.postcode, ' ', '')), p.postcode)) AND "
    "NOT list_contains(p.excludedLocations, v.area) AND (len(p.excludedPriceLevels) = 0 OR "
    "(v.priceLevel IS NOT NULL AND NOT list_contains(p.excludedPriceLevels, v.priceLevel)))"
    + "".join(
        f" AND (NOT list_contains(p.requiredFeatures, '{feature}') OR v.{fact} IS TRUE)"
        f" AND (NOT list_contains(p.excludedFeatures, '{feature}') OR v.{fact} IS FALSE)"
        for feature, fact in V.FEATURE_FACTS.items()
    )
    + "".join(
        f" AND (NOT list_contains(p.excludedFeatures, '{feature}') OR (v.noiseLevel IS NOT NULL AND v.noiseLevel <> '{level}'))"
        for feature, level in V.NOISE_FEATURES.items()
    )
)


@query(
    "P01_hard_candidate_filter",
    sql("request venue", "SELECT requestId, venueId FROM cand", **REQUEST_TEXTS, **PREFS, cand=CANDIDATES),
)
def hard_candidates(t: Tables):
    parsed = recommend.parse(t.requests().drop("vector"))
    return recommend.candidate_pairs(parsed, t.venues())


@query(
    "P01_single_request_filter",
    sql(
        "venue",
        "SELECT venueId FROM fx_venue WHERE area = 'Camden' AND servesFood IS TRUE AND hasDj IS FALSE "
        "AND starts_with(replace(postcode, ' ', ''), 'NW') AND priceLevel IS NOT NULL AND priceLevel <> 'cheap'",
    ),
)
def single_request(t: Tables):
    wanted = {
        "location": "Camden", "postcode": "nw", "requiredFeatures": ["food"], "excludedFeatures": ["dj"],
        "excludedPriceLevels": ["cheap"],
    }
    return t.fx("venue").where(filters.hard_filter(wanted)).select("venueId")


ALL_FEATURES = (*V.FEATURES, *V.NOISE_FEATURES)


@query(
    "P02_feature_lookup",
    sql(
        "venue",
        "SELECT venueId, CASE n % 18 "
        + " ".join(
            f"WHEN {i} THEN '{f}'" for i, f in enumerate(ALL_FEATURES)
        )
        + " ELSE 'noSuchFeature' END AS feature, CASE n % 18 "
        + " ".join(f"WHEN {i} THEN {V.FEATURE_FACTS[f]}" for i, f in enumerate(V.FEATURES))
        + " WHEN 15 THEN noiseLevel = 'quiet' WHEN 16 THEN noiseLevel = 'lively' ELSE NULL END AS value FROM fx_venue",
    ),
)
def feature_lookup(t: Tables):
    names = F.array(*[F.lit(f) for f in (*ALL_FEATURES, "noSuchFeature")])
    feature = F.get(names, (F.col("n") % 18).cast("int"))
    return t.fx("venue").select(
        "venueId", feature.alias("feature"), F.try_element_at(facts.feature_map(), feature).alias("value")
    )


@query(
    "P03_postcode_prefix",
    sql(
        "venue",
        "SELECT venueId FROM fx_venue WHERE starts_with(upper(replace(postcode, ' ', '')), concat('NW', CAST(1 + n % 4 AS STRING)))",
    ),
)
def postcode_prefix(t: Tables):
    wanted = F.concat(F.lit(" nw "), (1 + F.col("n") % 4).cast("string"))
    return t.fx("venue").where(
        F.startswith(text.postcode_prefix_key(F.col("postcode")), text.postcode_prefix_key(wanted))
    ).select("venueId")


@query(
    "P04_point_in_polygon",
    sql(
        "venue",
        "SELECT venueId, concat(CAST(k AS STRING), '#0') AS polygonId FROM fx_venue v JOIN sq ON "
        "v.longitude >= x AND v.longitude <= x + 0.06E0 AND v.latitude >= y AND v.latitude <= y + 0.06E0 "
        "AND NOT (v.longitude >= x + 0.02E0 AND v.longitude <= x + 0.03E0 AND v.latitude >= y + 0.02E0 "
        "AND v.latitude <= y + 0.03E0)",
        sq=SQUARE,
    ),
)
def point_in_polygon(t: Tables):
    rings = payloads.boundary_rings(boundaries(t))
    return filters.in_polygons(t.fx("venue"), rings, "venueId")


@query(
    "P06_public_url",
    "SELECT page_id, NOT (page_id % 5 IN (0, 1, 2) ) AS public FROM pages",
)
def public_url(t: Tables):
    k = F.col("page_id") % 5
    url = (
        F.when(k == 0, F.concat(F.lit("http://192.168.0."), (F.col("page_id") % 200).cast("string"), F.lit("/x")))
        .when(k == 1, F.lit("http://LOCALHOST:8080/"))
        .when(k == 2, F.regexp_replace("url", "^https?:", "ftp:"))
        .when(k == 3, F.concat(F.lit("https://8.8."), (F.col("page_id") % 200).cast("string"), F.lit(".8/")))
        .otherwise(F.col("url"))
    )
    return t.table("pages").select("page_id", urls.is_public(url).alias("public"))


HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"
SITE = f"regexp_replace({HOST}, '^www\\.', '')"


@query(
    "P07_same_site",
    f"SELECT p.page_id, p.site = q.site AS same FROM (SELECT page_id, {SITE} AS site FROM pages) p "
    f"JOIN (SELECT page_id, {SITE} AS site FROM pages) q ON q.page_id = p.page_id + 1",
)
def same_site(t: Tables):
    one = t.table("pages").select("page_id", "url")
    two = one.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("other"))
    return one.join(two, "page_id").select("page_id", urls.same_site(F.col("url"), F.col("other")).alias("same"))


@query(
    "P08_blocked_domain",
    sql("venue", "SELECT venueId FROM fx_venue WHERE n % 4 NOT IN (0, 1)"),
)
def blocked_domain(t: Tables):
    url = (
        F.when(F.col("n") % 4 == 0, F.concat(F.lit("https://www.facebook.com/"), "venueId"))
        .when(F.col("n") % 4 == 1, F.lit("http://Pubs.com/x"))
        .otherwise(F.concat(F.lit("https://sub.facebook.com/"), "venueId"))
    )
    return t.fx("venue").where(~urls.site_host(url).isin(*V.BLOCKED_HOSTS)).select("venueId")


@query(
    "P09_social_or_booking_host",
    f"SELECT page_id, page_id % 3 = 0 OR {SITE} LIKE '%.x.com' AS social, page_id % 3 = 1 AS booking FROM pages",
)
def social_host(t: Tables):
    k = F.col("page_id") % 3
    url = F.when(k == 0, F.lit("https://m.facebook.com/a")).when(
        k == 1, F.lit("https://WWW.opentable.co.uk/r")
    ).otherwise(F.col("url"))
    host = urls.site_host(url)
    return t.table("pages").select(
        "page_id", urls.host_in(host, V.SOCIAL_HOSTS).alias("social"),
        urls.host_in(host, V.BOOKING_HOSTS).alias("booking"),
    )


@query(
    "P10_verified_website",
    sql("venue", "SELECT venueId FROM fx_venue WHERE website IS NOT NULL AND n % 2 = 0"),
)
def verified_website(t: Tables):
    return pages.official_site(t.venues()).select("venueId")


LINES = (
    "SELECT doc_id, unnest(string_split(concat(text, CASE doc_id % 4 WHEN 0 THEN "
    "chr(10) || 'We host a family quiz and serve Sunday food in the garden.' WHEN 1 THEN "
    "chr(10) || 'Accept all cookies to enjoy the garden and the food of our pub.' WHEN 2 THEN "
    "chr(10) || 'Our beer garden is open all year round for everyone who likes it and dogs' ELSE '' END), chr(10))) "
    "AS line FROM documents"
)


@query(
    "P11_passage_keep_rule",
    "WITH l AS (SELECT doc_id, line AS raw, regexp_replace(line, '[À-ÖØ-öø-ÿŒœ]', 'x', 'g') AS line FROM (" + LINES + ")) SELECT doc_id, count(*) AS kept, min(length(line)) AS shortest FROM l WHERE "
    "length(line) >= 40 AND NOT regexp_matches(line, '"
    + ("(?i)" + "|".join(f"(?:{p})" for p in V.PASSAGE_NOISE)).replace("'", "''")
    + "') AND (regexp_matches(line, '[.!?…]$') OR len(string_split(trim(regexp_replace(line, '\\s+', ' ', 'g')), ' ')) > 15) "
    "AND (regexp_matches(line, '" + V.RELEVANT_PASSAGE.replace("'", "''") + "') OR contains(lower(line), 'doc')) GROUP BY doc_id",
)
def passage_keep(t: Tables):
    k = F.col("doc_id") % 4
    extra = (
        F.when(k == 0, "\nWe host a family quiz and serve Sunday food in the garden.")
        .when(k == 1, "\nAccept all cookies to enjoy the garden and the food of our pub.")
        .when(k == 2, "\nOur beer garden is open all year round for everyone who likes it and dogs")
        .otherwise("")
    )
    lines = t.table("documents").select(
        "doc_id", F.explode(F.split(F.concat("text", extra), "\n")).alias("line")
    )
    kept = lines.where(filters.keep_passage(F.col("line"), F.lit("Doc")))
    return kept.groupBy("doc_id").agg(
        F.count("*").alias("kept"), F.min(F.length("line")).alias("shortest")
    )


SEARCH_INDEX_SQL = (
    "trim(regexp_replace(regexp_replace(lower(concat_ws(' ', name, nullif(address, ''), t_postcode, "
    "t_street, t_city, t_suburb, nullif(array_to_string(list_filter(list_transform(string_split("
    "coalesce(t_cuisine, ''), ';'), lambda x: lower(trim(x))), lambda x: x <> ''), ' '), ''))), "
    "'\\bburgers\\b', 'burger', 'g'), '\\s+', ' ', 'g'))"
)
YES_NO = "CASE WHEN lower(trim({0})) IN ('yes', 'true', 'designated') THEN true WHEN lower(trim({0})) IN ('no', 'false') THEN false END"


@query(
    "P12_facet_search",
    sql(
        "tagged feedback",
        f"SELECT id FROM fx_tagged WHERE contains({SEARCH_INDEX_SQL}, 'quay') AND {YES_NO.format('t_sport')} "
        "AND id IN (SELECT concat('node/', CAST(n % 1000 AS STRING)) FROM fx_feedback WHERE eventType = 'save')",
    ),
)
def facet_search(t: Tables):
    rows = t.tagged().withColumn("hasLiveSport", T.yes_no(T.tag(F.col("tags"), "live_sport")))
    index = T.search_index(F.col("name"), F.col("address"), F.col("tags"))
    saved = t.fx("feedback").where("eventType = 'save'").select(
        F.concat(F.lit("node/"), (F.col("n") % 1000).cast("string")).alias("id")
    )
    return filters.facet_search(rows, index, " Quay ", ("hasLiveSport",), saved=saved, key="id").select("id")


NEEDLES = (
    "SELECT s_suppkey AS requestId, CASE s_suppkey % 5 WHEN 0 THEN 'ring arms' WHEN 1 THEN 'quiet pubs in camden' "
    "WHEN 2 THEN 'blue' WHEN 3 THEN 'nothing at all' ELSE 'widget tavern 7' END AS needle FROM supplier"
)
AREA_TEXT = (
    "CASE WHEN regexp_matches(h, '(?i)camden') THEN 'Camden' WHEN regexp_matches(h, "
    "'(?i)westminster|soho|mayfair|pimlico') THEN 'Westminster' ELSE 'London' END"
)


@query(
    "P13_literal_search_with_area",
    sql(
        "tagged",
        "SELECT requestId, id FROM lit UNION ALL SELECT n.requestId, h.id FROM needles n JOIN hay h ON "
        "h.area = CASE WHEN contains(n.needle, 'camden') THEN 'Camden' END WHERE n.requestId NOT IN (SELECT requestId FROM lit)",
        needles=NEEDLES,
        hay=f"SELECT id, h, {AREA_TEXT} AS area FROM (SELECT id, lower(concat_ws(' ', name, coalesce(address, ''), coalesce(t_suburb, ''))) AS h FROM fx_tagged)",
        lit="SELECT n.requestId, h.id FROM needles n JOIN hay h ON contains(h.h, n.needle)",
    ),
)
def literal_search(t: Tables):
    k = F.col("s_suppkey") % 5
    needle = (
        F.when(k == 0, "ring arms").when(k == 1, "quiet pubs in camden").when(k == 2, "blue")
        .when(k == 3, "nothing at all").otherwise("widget tavern 7")
    )
    asked = t.table("supplier").select(F.col("s_suppkey").alias("requestId"), needle.alias("needle"))
    asked = asked.withColumn("namedArea", filters.named_area(F.col("needle")))
    hay = F.lower(F.concat_ws(" ", "name", F.coalesce("address", F.lit("")), F.coalesce("t_suburb", F.lit(""))))
    rows = t.fx("tagged").select("id", hay.alias("hay")).withColumn("area", filters.text_area(F.col("hay")))
    return filters.search_or_area(rows, asked, "hay", "area").select("requestId", "id")


WORDS = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
NAME_QUERIES = (
    "SELECT s_suppkey AS requestId, CASE s_suppkey % 4 WHEN 0 THEN 'Blue  Ring!' WHEN 1 THEN "
    "'is the small ring tavern open' WHEN 2 THEN 'arms' ELSE 'bolt' END AS query FROM supplier"
)


@query(
    "P14_direct_name_match",
    sql(
        "venue",
        f"SELECT q.requestId, v.venueId FROM q JOIN fx_venue v ON contains({WORDS.format('v.name')}, {WORDS.format('q.query')}) "
        f"OR (length({WORDS.format('q.query')}) >= 5 AND contains({WORDS.format('q.query')}, {WORDS.format('v.name')}))",
        q=NAME_QUERIES,
    ),
)
def direct_name(t: Tables):
    k = F.col("s_suppkey") % 4
    asked = t.table("supplier").select(
        F.col("s_suppkey").alias("requestId"),
        F.when(k == 0, "Blue  Ring!").when(k == 1, "is the small ring tavern open").when(k == 2, "arms")
        .otherwise("bolt").alias("query"),
    )
    return filters.direct_name_matches(asked, t.fx("venue")).select("requestId", "venueId")


@query(
    "P15_score_threshold",
    sql(
        "run",
        "SELECT docId, max(score) AS score, CASE WHEN max(score) >= 0.62E0 THEN 'good match' ELSE 'worth a look' END AS label "
        "FROM fx_run WHERE score >= 0.5E0 GROUP BY docId",
    ),
)
def score_threshold(t: Tables):
    best = t.fx("run").where("score >= 0.5E0").groupBy("docId").agg(F.max("score").alias("score"))
    return best.withColumn("label", F.when(F.col("score") >= 0.62, "good match").otherwise("worth a look"))


@query(
    "P16_uncovered_venues",
    sql("venue price", "SELECT venueId, name, area FROM fx_venue WHERE venueId NOT IN (SELECT venueId FROM fx_price)"),
)
def uncovered(t: Tables):
    rest = t.fx("venue").join(t.fx("price").select("venueId"), "venueId", "left_anti")
    return rest.select("venueId", "name", "area").orderBy(F.lower("area"), F.lower("name"), "venueId")


@query(
    "P17_review_queue_page",
    sql(
        "feedback",
        "SELECT n AS reviewId, venueId, eventType AS feature FROM fx_feedback WHERE n % 3 = 0 "
        "ORDER BY lower(venueId), eventType, n LIMIT 50",
    ),
)
def review_page(t: Tables):
    status = F.when(F.col("n") % 3 == 0, "manual_review").otherwise("approved")
    items = t.fx("feedback").select(
        F.col("n").alias("reviewId"), "venueId", F.col("eventType").alias("feature"), status.alias("reviewStatus")
    )
    queue = items.where(F.col("reviewStatus") == "manual_review")
    return queue.orderBy(F.lower("venueId"), "feature", "reviewId").limit(50).drop("reviewStatus")


@query(
    "P18_image_quality",
    "SELECT p_partkey, NOT ((p_size > 0 AND p_size * 20 < 500) OR (p_size % 7 > 0 AND p_size % 7 * 150 < 300) OR "
    "(p_size > 0 AND p_size % 7 > 0 AND p_size * 20 < p_size % 7 * 150) OR regexp_matches(lower(concat(p_name, ' ', p_type)), "
    "'logo|icon|map|road|street|station|portrait|drawing|diagram|plan')) AS ok FROM part",
)
def image_quality(t: Tables):
    return t.table("part").select(
        "p_partkey",
        filters.image_ok(F.concat_ws(" ", "p_name", "p_type"), F.col("p_size") * 20, F.col("p_size") % 7 * 150).alias("ok"),
    )


CASES = (
    "SELECT s_suppkey AS requestId, "
    + facts_list("required", {0: ("servesFood",), 1: ("hasDj", "dogFriendly"), 2: (), 3: ("hostsQuiz",)})
    + ", "
    + facts_list("excluded", {0: (), 1: ("showsSports",), 2: (), 3: ("hasHappyHour",)})
    + " FROM supplier"
)


def cases(t: Tables):
    """Evaluation cases: required and excluded fact lists per request."""
    k = F.col("s_suppkey") % 4
    none = F.array().cast("array<string>")

    def pick(options):
        column = none
        for value, names in options.items():
            if names:
                column = F.when(k == value, F.array(*[F.lit(n) for n in names])).otherwise(column)
        return column

    return t.table("supplier").select(
        F.col("s_suppkey").alias("requestId"),
        pick({0: ("servesFood",), 1: ("hasDj", "dogFriendly"), 3: ("hostsQuiz",)}).alias("required"),
        pick({1: ("showsSports",), 3: ("hasHappyHour",)}).alias("excluded"),
        (F.lit(3) + F.col("s_suppkey") % 5).cast("int").alias("topK"),
    )


TRUTH = (
    "SELECT c.requestId, v.venueId FROM cases c JOIN fx_venue v ON len(c.required) + len(c.excluded) > 0 "
    + "".join(
        f" AND (NOT list_contains(c.required, '{f}') OR v.{f} IS TRUE) AND (NOT list_contains(c.excluded, '{f}') OR v.{f} IS FALSE)"
        for f in ("servesFood", "hasDj", "dogFriendly", "hostsQuiz", "showsSports", "hasHappyHour")
    )
)


@query("P19_evaluation_relevance", sql("venue", "SELECT requestId, venueId FROM truth", cases=CASES, truth=TRUTH))
def evaluation_relevance(t: Tables):
    return recommend.relevant_venues(cases(t), t.venues())



def booking_pages(t: Tables):
    """Stored pages with one more anchor each, some of them usable booking links."""
    k = F.col("page_id") % 6
    anchor = (
        F.when(k == 0, '<a href="/reservations">Visit us</a>')
        .when(k == 1, "<a class='x' href='https://www.opentable.com/pub'>Go</a>")
        .when(k == 2, '<a href="/book?x=1">Book privacy tour</a>')
        .when(k == 3, '<a href="https://facebook.com/book">Book</a><a href="../table"><b>Find</b> us</a>')
        .when(k == 4, '<a href="mailto:book@x.example">Book</a>')
        .otherwise("")
    )
    return t.table("pages").select("page_id", "url", F.concat("html", anchor).alias("html"))


ROOT = "regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)"


@query("P20_booking_link")
def booking_link(t: Tables):
    return payloads.booking_link(booking_pages(t), "page_id")


@query(
    "P21_booking_eligibility",
    sql(
        "venue",
        "SELECT venueId, CASE WHEN n % 7 = 0 THEN concat('https://book.example/', venueId) WHEN website IS NOT NULL "
        "AND n % 5 IN (0, 1) THEN website END AS bookingUrl FROM fx_venue",
    ),
)
def booking_eligibility(t: Tables):
    k = F.col("n") % 5
    explicit = F.when(F.col("n") % 7 == 0, F.concat(F.lit("https://book.example/"), "venueId")).when(
        F.col("n") % 7 == 1, F.lit("https://m.facebook.com/book")
    )
    details = (
        F.when(k == 0, "Accepts table bookings").when(k == 1, "Food, reservation by phone")
        .when(k == 2, "no bookings, booking closed").when(k == 3, "walk-in only, no booking").otherwise("Music")
    )
    return t.fx("venue").select(
        "venueId", filters.booking_eligible(explicit, F.col("website"), details).alias("bookingUrl")
    )


@query(
    "H23_feature_lists",
    sql(
        "venue",
        "SELECT venueId, array_to_string(list_filter(["
        + ", ".join(f"CASE WHEN {V.FEATURE_FACTS[f]} IS TRUE THEN '{label}' END" for f, label in V.FEATURE_REASONS.items())
        + "], lambda x: x IS NOT NULL), '|') AS verified, array_to_string(list_filter(["
        + ", ".join(f"CASE WHEN {V.FEATURE_FACTS[f]} IS NULL THEN '{label}' END" for f, label in V.FEATURE_REASONS.items())
        + "], lambda x: x IS NOT NULL), '|') AS unknown FROM fx_venue",
    ),
)
def feature_lists(t: Tables):
    from taproom.operators import ranking

    rows = t.fx("venue").select(
        "venueId", ranking.verified_features().alias("verified"), ranking.unknown_features().alias("unknown")
    )
    return rows.select("venueId", joined("verified"), joined("unknown"))
