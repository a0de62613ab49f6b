"""Stored web pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from taproom import vocab as V
from taproom.catalog.base import Tables, query, sql
from taproom.functions import text
from taproom.operators import overlay, pages

def parsed(t: Tables):
    return pages.parse_pages(t.table("pages"), "page_id")


@query("U04_page_structure")
def page_structure(t: Tables):
    return parsed(t).select(
        "page_id", F.size("blocks").alias("blocks"), F.length("visibleText").alias("visibleChars"),
        "title", "heading", F.size("links").alias("links"), F.size("bodyLinks").alias("bodyLinks"),
    )


@query(
    "U04_page_titles",
    "SELECT page_id, trim(regexp_replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'), '&lt;', '<'), '\\s+', ' ', 'g')) AS title, "
    "len(list_distinct(regexp_extract_all(html, '<a [^>]*href=\"([^\"]+)\"', 1))) AS links FROM pages",
)
def page_titles(t: Tables):
    return parsed(t).select("page_id", "title", F.size("links").cast("long").alias("links"))


# What each page says of its venue, by its number; {} is the venue's name and number, since names repeat.
PAGE_PROSE = {
    0: "<div><p>{} has a beer garden that is open all year, and dogs are welcome in the bar.</p></div>",
    1: "<p>We do not show live sport here. Accept all cookies to go on reading.</p>"
    "<p>Group bookings and private hire are available upstairs at {}.</p>",
    2: "<p>A pint of draught Guinness is £6.20 in the bar of {}, every day of the week.</p>"
    "<p>Sunday roasts and a weekly pub quiz bring the neighbours to {}.</p>",
    3: "<p>Half of Guinness £3.40, bottle £5. Is {} dog friendly? Ask us at the bar today.</p>",
    4: "<p>There is no wheelchair access to the restaurant of {}, sorry.</p>",
    5: "<nav><p>Live music at {} in the navigation is never read as prose.</p></nav>",
}
# A line that many venues' pages share.
SHARED_PROSE = "<p>Our food menu is the same in all our pubs and changes with the season.</p>"


def venue_pages(t: Tables):
    """Parsed pages, two to a venue, with prose about the venue added to every page."""
    k = F.col("page_id") % 6
    prose = F.lit(None).cast("string")
    for number, line in PAGE_PROSE.items():
        prose = F.when(k == number, F.replace(F.lit(line), F.lit("{}"), F.concat_ws(" ", "name", "n"))).otherwise(prose)
    more = F.when(F.col("page_id") % 4 == 0, F.lit(SHARED_PROSE)).otherwise("")
    raw = t.table("pages").withColumn("n", F.expr("1 + page_id div 2")).join(t.fx("venue").select("n", "name", "venueId"), "n")
    parsed = pages.parse_pages(raw.withColumn("html", F.concat("html", prose, more)), "page_id")
    return parsed.join(raw.select("page_id", "venueId"), "page_id").select(
        "venueId", F.col("page_id").alias("pageNo"), "url", "blocks", "visibleText", "title", "heading", "links"
    )


def _said(number: int, part: str) -> str:
    return "'" + part.replace("'", "''").replace("{}", "' || name || ' ' || n || '") + "'"


KEPT_PROSE = {
    0: ["{} has a beer garden that is open all year, and dogs are welcome in the bar."],
    1: ["Group bookings and private hire are available upstairs at {}."],
    2: ["A pint of draught Guinness is £6.20 in the bar of {}, every day of the week.", "Sunday roasts and a weekly pub quiz bring the neighbours to {}."],
    3: ["Half of Guinness £3.40, bottle £5. Is {} dog friendly? Ask us at the bar today."],
    4: ["There is no wheelchair access to the restaurant of {}, sorry."],
}
# Verified venues' lines in page order; lines that two venues of one name share are boilerplate.
Q_PASSAGES = (
    "SELECT venueId, row_number() OVER (PARTITION BY venueId ORDER BY page_id, line) AS position, url, text FROM (SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT page_id, url, n, name, venueId, {i} AS line, {_said(k, text_)} AS text FROM dealt WHERE page_id % 6 = {k}"
        for k, lines in KEPT_PROSE.items()
        for i, text_ in enumerate(lines)
    )
    + ") WHERE n % 2 = 0 AND n % 3 <> 0 QUALIFY min(venueId) OVER (PARTITION BY text) = max(venueId) OVER (PARTITION BY text))"
)
DEALT = {"dealt": "SELECT p.page_id, p.url, v.n, v.name, v.venueId FROM pages p JOIN fx_venue v ON v.n = 1 + p.page_id // 2"}


def naming(t: Tables):
    """Passages that name their venue: the invented prose of the pages holds a subject by chance only."""
    return pages.passages(venue_pages(t), t.venues()).where(F.contains("text", "name"))


@query("L07_page_passages", sql("venue", Q_PASSAGES, **DEALT))
def page_passages(t: Tables):
    found = naming(t)
    # Positions are numbered before repeated lines go.
    order = Window.partitionBy("venueId").orderBy("position")
    return found.select("venueId", F.row_number().over(order).alias("position"), "url", "text")


@query(
    "L07_passage_failures",
    sql(
        "venue",
        "SELECT reason, count(*) AS venues FROM (SELECT CASE WHEN n % 3 = 0 THEN 'missing or non-public website' WHEN n % 2 = 1 THEN 'website is not verified as official' "
        "WHEN venueId NOT IN (SELECT venueId FROM said) THEN 'no relevant passages found' END AS reason FROM fx_venue) WHERE reason IS NOT NULL GROUP BY reason",
        **DEALT, said=Q_PASSAGES,
    ),
)
def failures(t: Tables):
    found = naming(t)
    return pages.passage_failures(t.venues(), found).groupBy("reason").agg(F.count("*").alias("venues"))


@query(
    "L08_site_links",
    "WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"(/[^\"#]*)', 1)) AS href, url FROM pages), "
    "m AS (SELECT DISTINCT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS link FROM l) "
    "SELECT page_id, link, CASE WHEN regexp_matches(regexp_replace(lower(link), '[^a-z]', '', 'g'), '" + "|".join(V.PRIORITY_LINK_TERMS)
    + "') THEN 0 ELSE 1 END AS priority FROM m",
)
def site_links(t: Tables):
    return pages.site_links(parsed(t), "page_id").select("page_id", "link", "priority")


def passages_with_claims(t: Tables):
    """Short texts with feature phrases, one per document."""
    k = F.col("doc_id") % 9
    claim = (
        F.when(k == 0, "We serve a great lunch menu. ")
        .when(k == 1, "There is no live music, but dogs welcome! ")
        .when(k == 2, "We do not show any live sport here. ")
        .when(k == 3, "Is it dog friendly? Assistance dogs welcome. ")
        .when(k == 4, "Book a table for our Sunday roast and pub quiz night. ")
        .when(k == 5, "DJ nights, happy hour, vegan options and step-free access. ")
        .when(k == 6, "Never any weekly events; private hire only. ")
        .when(k == 7, "An accessible toilet and a wheelchair accessible toilet. ")
        .otherwise("Nothing to claim. ")
    )
    rows = t.table("documents").withColumn("body", F.concat(claim, F.lit("| "), "text"))
    return rows.withColumn("venueId", F.concat(F.lit("v-"), (F.col("doc_id") % 150).cast("string")))


CLAIM_TEXT = (
    "SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'servesFood+' WHEN 1 THEN 'dogFriendly+|hasLiveMusic-' WHEN 2 THEN 'showsSports-' "
    "WHEN 4 THEN 'acceptsReservations+|hostsQuiz+|servesSundayRoast+' WHEN 5 THEN 'hasDj+|hasHappyHour+|hasVeganOptions+|wheelchairAccessible+' "
    "WHEN 6 THEN 'hostsEvents-|suitableForGroups+' WHEN 7 THEN 'hasAccessibleToilet+|wheelchairAccessible+' END AS claims FROM documents "
    "WHERE doc_id % 9 NOT IN (3, 8)"
)


@query("H30_feature_claims", f"SELECT * FROM ({CLAIM_TEXT})")
def feature_claims(t: Tables):
    found = pages.feature_claims(passages_with_claims(t), "body", "doc_id")
    label = F.concat("feature", F.when(F.col("value"), "+").otherwise("-"))
    return found.groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set(label)), "|").alias("claims")
    )


@query(
    "L06_feature_review_queue",
    sql(
        "venue",
        "SELECT DISTINCT venueId, feature, suggestedValue FROM (SELECT 'v-' || CAST(doc_id % 150 AS VARCHAR) AS venueId, "
        "left(c, length(c) - 1) AS feature, right(c, 1) = '+' AS suggestedValue FROM (SELECT doc_id, unnest(string_split(claims, '|')) AS c FROM claimed)) q "
        "JOIN fx_venue v USING (venueId) WHERE (CASE feature "
        + " ".join(f"WHEN '{f}' THEN v.{f}" for f in V.FACT_PATTERNS)
        + " END) IS DISTINCT FROM suggestedValue",
        claimed=CLAIM_TEXT,
    ),
)
def review_queue(t: Tables):
    found = pages.feature_claims(passages_with_claims(t), "body", "venueId", "doc_id").select(
        "venueId", F.col("doc_id").alias("position"), F.lit("https://site.example/").alias("pageUrl"),
        "claimNo", "feature", "value", "matchedPhrase", "evidenceText",
    )
    return pages.review_queue(found, t.venues()).select("venueId", "feature", "suggestedValue")


# The packing rule taken literally, sentence after sentence.
SPLIT = {
    "whole": "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS body FROM documents",
    "cut": "SELECT doc_id, unnest(string_split(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS raw, "
    "generate_subscripts(string_split(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) AS i "
    f"FROM whole WHERE length(body) > {V.PASSAGE_MAX}",
    "sentence": f"SELECT doc_id, i, CASE WHEN length(raw) <= {V.PASSAGE_MAX} THEN raw ELSE regexp_replace(CASE WHEN contains(left(raw, {V.PASSAGE_MAX}), ' ') "
    f"THEN regexp_replace(left(raw, {V.PASSAGE_MAX}), ' [^ ]*$', '') ELSE left(raw, {V.PASSAGE_MAX}) END, '[ ,;:]+$', '') || '…' END AS s FROM cut",
    "walk": "SELECT doc_id, CAST(0 AS BIGINT) AS i, '' AS open, CAST(NULL AS VARCHAR) AS piece FROM (SELECT DISTINCT doc_id FROM cut) "
    f"UNION ALL SELECT w.doc_id, s.i, CASE WHEN open <> '' AND length(trim(open || ' ' || s)) > {V.PASSAGE_MAX} THEN s ELSE trim(open || ' ' || s) END, "
    f"CASE WHEN open <> '' AND length(trim(open || ' ' || s)) > {V.PASSAGE_MAX} THEN open END FROM walk w JOIN sentence s ON s.doc_id = w.doc_id AND s.i = w.i + 1",
    "piece": f"SELECT doc_id, body AS piece FROM whole WHERE length(body) <= {V.PASSAGE_MAX} UNION ALL "
    f"SELECT doc_id, piece FROM walk WHERE length(piece) >= {V.PASSAGE_MIN} UNION ALL "
    f"SELECT doc_id, arg_max(open, i) FROM walk GROUP BY doc_id HAVING length(arg_max(open, i)) >= {V.PASSAGE_MIN}",
}


def split_sql(body: str) -> str:
    return sql("", body, **SPLIT).replace("WITH ", "WITH RECURSIVE ", 1)


def pieces(t: Tables):
    rows = t.table("documents").select("doc_id", text.squeeze(F.col("text")).alias("body"))
    return rows.select("doc_id", F.explode(text.split_passage(F.col("body"))).alias("piece"))


@query("H29_passage_splitting", split_sql("SELECT doc_id, piece FROM piece"))
def passage_splitting(t: Tables):
    return pieces(t)


@query(
    "H29_split_long_texts",
    split_sql("SELECT doc_id, count(*) AS pieces, max(length(piece)) AS longest, min(length(piece)) AS shortest FROM piece GROUP BY doc_id"),
)
def split_long(t: Tables):
    return pieces(t).groupBy("doc_id").agg(
        F.count("*").alias("pieces"), F.max(F.length("piece")).alias("longest"), F.min(F.length("piece")).alias("shortest")
    )


PRICED = (
    "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 5.5E0 WHEN 1 THEN 6.0E0 END AS price FROM documents WHERE doc_id % 7 IN (0, 1)"
)


@query("H31_price_evidence", PRICED)
def price_evidence(t: Tables):
    k = F.col("doc_id") % 7
    line = (
        F.when(k == 0, "Guinness draught, pint £5.50 at the bar")
        .when(k == 1, "A   pint of guinness £ 6 only")
        .when(k == 2, "Guinness half £2.80, pint glass")
        .when(k == 3, "Guinness pint £5.10 / £2.60")
        .when(k == 4, "Guinness pint and many other beers on the long menu here £5.00")
        .when(k == 5, "Guinness pint £25")
        .otherwise("Carling pint £4")
    )
    rows = t.table("documents").select("doc_id", F.concat(line, F.lit("\n | "), "text").alias("body"))
    return rows.select("doc_id", pages.priced_item(F.col("body"))["price"].alias("price")).where(
        F.col("price").isNotNull()
    )


@query(
    "L10_menu_price_scan",
    sql(
        "venue",
        "SELECT venueId, name AS venueName, 'moderate' AS priceLevel, 6.2E0 AS observedPriceGbp, url AS evidenceUrl FROM dealt WHERE page_id % 6 = 2 AND n % 2 = 0",
        **DEALT,
    ),
)
def menu_price_scan(t: Tables):
    found = pages.price_scan(venue_pages(t), t.venues())
    return found.select("venueId", "venueName", "priceLevel", "observedPriceGbp", "evidenceUrl")


def audit_rows(t: Tables):
    """A served page per venue: some name the venue, some are generic, some are elsewhere."""
    k = F.col("n") % 5
    slug = F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-")
    return t.fx("venue").select(
        "venueId", "name", "website", "n",
        F.when(k == 0, F.concat(F.lit("https://www."), slug, F.lit(".example/")))
        .when(k == 1, F.concat(F.lit("https://pubs.example/"), "venueId"))
        .when(k == 2, F.lit("https://facebook.com/x"))
        .when(k == 3, F.lit("https://chain.example/")).alias("url"),
        F.when(k.isin(0, 1), F.concat("name", F.lit(" | Home"))).otherwise("Welcome").alias("title"),
        F.when(k == 0, F.col("name")).otherwise("Drinks").alias("heading"),
        F.when(k != 3, F.concat(F.lit("Come to "), "name", F.lit(" today."))).otherwise("A chain of pubs").alias("visibleText"),
    )


@query("H32_identity_signals")
def identity_signals(t: Tables):
    rows = pages.identity_signals(audit_rows(t).where("url IS NOT NULL"))
    return rows.select("venueId", F.array_join("signals", "|").alias("signals"), "verified")


@query(
    "L09_website_identity_audit",
    sql(
        "venue",
        "SELECT venueId, CASE WHEN website IS NOT NULL AND n % 5 IN (0, 1) THEN 'verified' ELSE 'rejected' END AS status, CASE WHEN website IS NULL THEN "
        "'missing or non-public website' WHEN n % 5 = 4 THEN 'no stored page' WHEN n % 5 = 2 THEN 'redirected to a known third-party domain' WHEN n % 5 IN (0, 1) THEN "
        "'Multiple first-party identity signals verified the venue page' ELSE 'insufficient evidence that the page is specific to this venue' END AS reason FROM fx_venue",
    ),
)
def identity_audit(t: Tables):
    rows = audit_rows(t)
    served = rows.where("url IS NOT NULL").select("venueId", "url", "title", "heading", "visibleText")
    return pages.site_audit(rows.select("venueId", "name", "website"), served).select("venueId", "status", "reason")


@query(
    "L13_site_refresh_overlay",
    sql(
        "tagged",
        "SELECT id, CASE WHEN hs <> 'manual' AND n % 2 = 0 AND n % 3 = 0 THEN 'Mo-Su 10:00-20:00' ELSE t_hours END AS opening_hours, "
        "CASE WHEN hs <> 'manual' AND n % 2 = 0 AND n % 3 = 0 THEN 'official' ELSE hs END AS hours_source, "
        "CASE WHEN hs <> 'manual' AND n % 2 = 0 THEN coalesce(t_phone, 'site phone') ELSE t_phone END AS phone, "
        "CASE WHEN hs <> 'manual' AND n % 2 = 0 AND address IS NULL THEN 'site address' ELSE address END AS address, "
        "CASE WHEN hs <> 'manual' AND n % 2 = 0 AND address IS NULL THEN 'officialWebsite' ELSE 'openStreetMap' END AS address_source "
        "FROM (SELECT *, CASE n % 4 WHEN 0 THEN 'manual' ELSE 'osm' END AS hs FROM fx_tagged)",
    ),
)
def site_refresh(t: Tables):
    rows = t.fx("tagged").select(
        "id", "n", F.col("t_hours").alias("opening_hours"),
        F.when(F.col("n") % 4 == 0, "manual").otherwise("osm").alias("hours_source"),
        F.lit(None).cast("string").alias("hours_confidence"), F.lit(None).cast("timestamp").alias("hours_last_checked"),
        F.col("t_phone").alias("phone"), "address", F.lit("openStreetMap").alias("address_source"),
    )
    extracted = rows.where("n % 2 = 0").select(
        "id", F.when(F.col("n") % 3 == 0, "Mo-Su 10:00-20:00").alias("siteHours"),
        F.lit("site phone").alias("sitePhone"), F.lit("site address").alias("siteAddress"),
    )
    return overlay.refresh_from_site(rows.drop("n"), extracted, F.current_timestamp()).select(
        "id", "opening_hours", "hours_source", "phone", "address", "address_source"
    )
