"""Window functions, sorts and top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from taproom import vocab as V
from taproom.catalog.aggregates import RANKED, run
from taproom.catalog.base import Tables, query, sql
from taproom.functions import geo, text, urls
from taproom.operators import canonical, feedback
from taproom.operators.skew import grid_join
from taproom.sources import payloads

LABELS = (
    "SELECT coalesce(sessionId, 'anonymous') AS sessionId, regexp_replace(trim(lower(query)), '\\s+', ' ', 'g') AS queryKey, venueId, "
    "arg_max(eventId, (recordedAt, eventId)) AS eventId, arg_max(eventType, (recordedAt, eventId)) AS eventType FROM fx_feedback "
    "WHERE eventType IN ('like', 'dislike') AND query IS NOT NULL GROUP BY ALL"
)


@query("W01_latest_explicit_label", sql("feedback", LABELS))
def latest_label(t: Tables):
    return feedback.latest_labels(t.fx("feedback")).select("sessionId", "queryKey", "venueId", "eventId", "eventType")


@query(
    "W02_latest_price",
    sql("price", "SELECT venueId, arg_max(observedPriceGbp, observationId) AS price, arg_max(evidenceUrl, observationId) AS url FROM fx_price GROUP BY venueId"),
)
def latest_price(t: Tables):
    return canonical.latest_prices(t.fx("price")).select(
        "venueId", F.col("guinnessPriceGbp").alias("price"), F.col("priceEvidenceUrl").alias("url")
    )


@query(
    "W04_first_occurrence",
    "SELECT k, min(doc_id) AS doc_id FROM (SELECT doc_id, trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')) AS k FROM "
    "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY k",
)
def first_occurrence(t: Tables):
    lines = t.table("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    keyed = lines.select("doc_id", text.words_only(F.col("line")).alias("k"))
    return keyed.groupBy("k").agg(F.min("doc_id").alias("doc_id"))


@query(
    "W05_rank_and_reciprocal_rank",
    sql(
        "run",
        "SELECT caseId, min(rank) FILTER (grade >= 2) AS firstRank, round(1.0E0 / min(rank) FILTER (grade >= 2), 6) AS reciprocalRank FROM ranked GROUP BY caseId",
        **RANKED,
    ),
)
def reciprocal_rank(t: Tables):
    ranked, _ = run(t)
    first = F.min(F.when(F.col("relevant"), F.col("rank")))
    return ranked.groupBy("caseId").agg(first.alias("firstRank")).withColumn(
        "reciprocalRank", F.round(1.0 / F.col("firstRank"), 6)
    )


@query(
    "W07_per_entity_cap",
    sql(
        "chunk",
        "SELECT venueId, chunkId FROM (SELECT venueId, chunkId, row_number() OVER (PARTITION BY venueId ORDER BY n) AS rn FROM fx_chunk) WHERE rn <= 4",
    ),
)
def per_entity_cap(t: Tables):
    order = Window.partitionBy("venueId").orderBy("n")
    return t.fx("chunk").withColumn("rn", F.row_number().over(order)).where("rn <= 4").select("venueId", "chunkId")


@query(
    "W08_result_page",
    sql(
        "run",
        "SELECT caseId, docId, rank, count(*) OVER (PARTITION BY caseId) AS total FROM ranked QUALIFY rank BETWEEN 6 AND 10",
        ranked=RANKED["ranked"].replace("WHERE caseId % 18 <> 0", ""),
    ),
)
def result_page(t: Tables):
    from taproom.operators.ranking import page

    rows = t.fx("run").select(
        "caseId", "docId", "score", F.lit("").alias("name"), F.col("docId").alias("venueId")
    )
    return page(rows, 5, 5, "caseId").select(
        "caseId", "docId", "rank", F.col("totalAvailable").alias("total")
    )


@query(
    "W09_first_non_null",
    sql(
        "feedback",
        "SELECT venueId, arg_min(sessionId, n) FILTER (sessionId IS NOT NULL) AS sessionId, arg_min(query, n) FILTER (query IS NOT NULL) AS query "
        "FROM fx_feedback GROUP BY venueId",
    ),
)
def first_non_null(t: Tables):
    return payloads.first_over(t.fx("feedback"), "venueId", "n", ["sessionId", "query"])


RANK_VENUES = (
    "SELECT venueId, name, round(coalesce(rating, 0.0E0) / 5.0E0, 3) AS score FROM fx_venue WHERE area = 'Camden' "
    "ORDER BY score DESC, name, venueId LIMIT 25"
)


@query("O01_rank_venues", sql("venue", RANK_VENUES))
def rank_venues(t: Tables):
    score = F.round(F.coalesce(F.col("rating"), F.lit(0.0)) / 5.0, 3)
    rows = t.fx("venue").where("area = 'Camden'").select("venueId", "name", score.alias("score"))
    return rows.orderBy(F.desc("score"), "name", "venueId").limit(25)


@query(
    "O02_canonical_order",
    sql("venue", "SELECT venueId, area, lower(name) AS folded FROM fx_venue"),
)
def canonical_order(t: Tables):
    rows = t.fx("venue").select("venueId", "area", F.lower("name").alias("folded"))
    return rows.orderBy("area", "folded", "venueId")


Q_LETTERS = "regexp_replace(lower(url), '[^a-z]', '', 'g')"


@query(
    "O03_link_priority",
    f"SELECT page_id, CASE WHEN regexp_matches({Q_LETTERS}, '" + "|".join(V.PRIORITY_LINK_TERMS) + "') THEN 0 ELSE 1 END AS priority, "
    f"CASE WHEN regexp_matches({Q_LETTERS}, '" + "|".join(V.MENU_LINK_TERMS) + "') THEN 0 ELSE 1 END AS menuPriority FROM "
    "(SELECT page_id, concat(url, CASE page_id % 5 WHEN 0 THEN '/Whats-On' WHEN 1 THEN '/drink' ELSE '' END) AS url FROM pages)",
)
def link_priority(t: Tables):
    k = F.col("page_id") % 5
    url = F.concat("url", F.when(k == 0, "/Whats-On").when(k == 1, "/drink").otherwise(""))
    rows = t.table("pages").select("page_id", url.alias("url"))
    return rows.select(
        "page_id", urls.link_rank(F.col("url"), V.PRIORITY_LINK_TERMS).alias("priority"),
        urls.link_rank(F.col("url"), V.MENU_LINK_TERMS).alias("menuPriority"),
    ).orderBy("priority", "page_id")


@query(
    "O04_ratings_newest_first",
    sql("rating", "SELECT userId, venueId, rating, updatedAt, pos FROM fx_rating"),
)
def newest_first(t: Tables):
    rows = t.fx("rating").select("userId", "venueId", "rating", "updatedAt", "pos")
    return rows.orderBy("userId", F.desc("updatedAt"), "pos")


def q_site_name(column: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({column}), '\\bthe\\b', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


IMAGES = {
    "img": (
        "SELECT v.venueId, p.p_partkey AS imageId, concat(p.p_name, ' ', p.p_type) AS title, "
        f"list_filter(string_split({q_site_name('v.name')}, ' '), lambda w: length(w) > 2) AS words, "
        f"{q_site_name(chr(112) + '.p_name')} AS plain, "
        "CASE WHEN p.p_partkey % 5 = 0 THEN NULL ELSE CAST(floor(sqrt(pow(((51.28E0 + CAST(p.p_partkey % 4200 AS DOUBLE) / 1.0E4) - v.latitude) * 111000.0E0, 2) "
        "+ pow(((-0.51E0 + CAST(p.p_partkey % 8400 AS DOUBLE) / 1.0E4) - v.longitude) * 111000.0E0 * cos(v.latitude * pi() / 180.0E0), 2)) + 0.5E0) AS BIGINT) END AS distance "
        "FROM fx_venue v JOIN part p ON p.p_partkey % 100 = v.n % 100"
    ),
    "scored": (
        "SELECT venueId, imageId, distance, CASE WHEN len(words) = 0 THEN 0.0E0 ELSE len(list_filter(words, lambda w: contains(plain, w))) / CAST(len(words) AS DOUBLE) END AS nameScore FROM img"
    ),
}


IMAGE_METRES = 1000  # an image farther from its venue is of another place


def image_sides(t: Tables):
    """Venues and images (parts stand in for images), names normalised once a venue and once an image, not once a pair."""
    venue = t.fx("venue").select("venueId", name_words(F.col("name")).alias("words"), "latitude", "longitude", (F.col("n") % 100).alias("k"))
    lat = F.when(F.col("p_partkey") % 5 != 0, 51.28 + (F.col("p_partkey") % 4200).cast("double") / 1.0e4)
    lon = -0.51 + (F.col("p_partkey") % 8400).cast("double") / 1.0e4
    part = t.table("part").select(
        "p_partkey", text.site_name(F.col("p_name")).alias("plain"), lat.alias("lat"), lon.alias("lon"), (F.col("p_partkey") % 100).alias("k")
    )
    return venue, part


def images(t: Tables, named: bool = True):
    """Image candidates per venue with distance and, if `named`, name score."""
    venue, part = image_sides(t)
    distance = geo.flat_metres(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon"))
    score = [name_score(F.col("words"), F.col("plain"), most_words(venue)).alias("nameScore")] if named else []
    return grid_join(venue, part, ["k"], "venueId", "p_partkey").select(
        "venueId", F.col("p_partkey").alias("imageId"), distance.alias("distance"), *score
    )


SPELLED = 32  # words of a name up to which a score is spelled out


def most_words(venue):
    """Words of the longest name."""
    return venue.agg(F.max(F.size("words"))).first()[0] or 0


def name_words(name):
    """The words of a name that are longer than two characters."""
    return F.filter(F.split(text.site_name(name), " "), lambda word: F.length(word) > 2)


def name_score(words, plain, most=None):
    """Share of a name's words found in a normalised text.

    With `most`, the words of the longest name, the sum is spelled out word by word: unlike a filter with a function
    it is compiled with the join that makes the pairs.
    """
    hits = F.size(F.filter(words, lambda word: F.contains(plain, word)))
    if most is not None and most <= SPELLED:
        found = [F.coalesce(F.contains(plain, F.get(words, F.lit(at))), F.lit(False)).cast("int") for at in range(most)]
        hits = reduce(lambda one, two: one + two, found, F.lit(0))
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(hits / F.size(words))


@query(
    "O05_image_pick",
    sql(
        "venue",
        "SELECT venueId, imageId, round(nameScore, 6) AS nameScore FROM (SELECT *, row_number() OVER (PARTITION BY venueId ORDER BY nameScore DESC, "
        "coalesce(distance, 100000), imageId) AS rn FROM scored WHERE nameScore >= 0.66E0 AND (distance IS NULL OR distance <= 1000)) WHERE rn = 1",
        **IMAGES,
    ),
)
def image_pick(t: Tables):
    venue, part = image_sides(t)
    placed, unplaced = part.where("lat IS NOT NULL"), part.where("lat IS NULL").drop("lat", "lon")
    # The cells are a tenth wider than the distance asked, as they count more metres to a degree.
    around = venue.withColumn("cell", F.explode(geo.near_cells(F.col("latitude"), F.col("longitude"), 1.1 * IMAGE_METRES)))
    at = placed.withColumn("cell", geo.home_cell(F.col("lat"), F.col("lon"), 1.1 * IMAGE_METRES))
    distance = geo.flat_metres(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon"))
    near = around.join(at, ["k", "cell"]).withColumn("distance", distance).where(F.col("distance") <= IMAGE_METRES)
    near = near.withColumn("nameScore", name_score(F.col("words"), F.col("plain")))
    # Without a place only names count: names are compared once, each with the first image of its name.
    first = unplaced.groupBy("plain", "k").agg(F.min("p_partkey").alias("p_partkey"))
    alike = venue.select("words", "k").distinct().join(first, "k").withColumn("nameScore", name_score(F.col("words"), F.col("plain")))
    ranked = F.struct((-F.col("nameScore")).alias("down"), "p_partkey")
    best = alike.where(F.col("nameScore") >= 0.66).groupBy("words", "k").agg(F.min(ranked).alias("b"))
    named = venue.join(best, ["words", "k"]).select(
        "venueId", F.col("b.p_partkey").alias("imageId"), F.lit(None).cast("long").alias("distance"), (-F.col("b.down")).alias("nameScore")
    )
    sure = near.where("nameScore >= 0.66").select("venueId", F.col("p_partkey").alias("imageId"), "distance", "nameScore").unionByName(named)
    order = [F.desc("nameScore"), F.coalesce("distance", F.lit(100000)), F.col("imageId")]
    return payloads.newest_per_key(sure, ["venueId"], order).select(
        "venueId", "imageId", F.round("nameScore", 6).alias("nameScore")
    )


@query(
    "H44_image_name_score",
    sql(
        "venue",
        "SELECT venueId, imageId, round(nameScore, 6) AS nameScore, CASE WHEN nameScore >= 0.66E0 AND (distance IS NULL OR distance <= 1000) "
        "THEN 'high' ELSE 'medium' END AS confidence FROM scored",
        **IMAGES,
    ),
)
def image_scores(t: Tables):
    good = (F.col("nameScore") >= 0.66) & (F.col("distance").isNull() | (F.col("distance") <= 1000))
    return images(t).select(
        "venueId", "imageId", F.round("nameScore", 6).alias("nameScore"),
        F.when(good, "high").otherwise("medium").alias("confidence"),
    )


@query(
    "H02_flat_metres",
    sql("venue", "SELECT venueId, imageId, distance FROM img", img=IMAGES["img"]),
)
def flat_metres(t: Tables):
    return images(t, named=False)


