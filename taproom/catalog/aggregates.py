"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from taproom import vocab as V
from taproom.catalog.base import Tables, query, sql
from taproom.catalog.requestsql import PREFS, REQUEST_TEXTS
from taproom.operators import evaluation, explain, feedback, pages, quality
from taproom.plans import recommend
from taproom.operators.skew import with_row


@query(
    "A01_fact_coverage",
    sql(
        "venue",
        " UNION ALL ".join(
            f"SELECT '{f}' AS fact, count({f}) AS known, count(*) FILTER ({f}) AS positive, "
            f"round(count({f}) / CAST(count(*) AS DOUBLE), 4) AS knownShare FROM fx_venue"
            for f in V.FACTS
        ),
    ),
)
def fact_coverage(t: Tables):
    return quality.coverage(t.fx("venue"))


RANKED = {
    "ranked": "SELECT *, row_number() OVER (PARTITION BY caseId ORDER BY score DESC, docId) AS rank FROM fx_run WHERE caseId % 18 <> 0",
    "casus": "SELECT caseId, min(topK) AS topK, count(*) FILTER (grade >= 2) AS relevantCount, caseId % 9 = 0 AS expectedEmpty, "
    "caseId % 5 <> 0 OR caseId % 9 = 0 AS hasCriteria FROM fx_run GROUP BY caseId",
}


def run(t: Tables):
    """Ranked results with grades, and their cases."""
    rows = t.fx("run")
    # Some of the cases that expect no answer got none.
    given = rows.where("caseId % 18 <> 0")
    ranked = evaluation.ranked(given, "caseId", "score", "docId").withColumn("relevant", F.col("grade") >= 2)
    cases = rows.groupBy("caseId").agg(
        F.min("topK").alias("topK"), F.count_if(F.col("grade") >= 2).alias("relevantCount")
    )
    empty = F.col("caseId") % 9 == 0
    return ranked, cases.withColumn("expectedEmpty", empty).withColumn(
        "hasCriteria", (F.col("caseId") % 5 != 0) | empty
    )


PER_CASE = (
    "SELECT c.caseId, CASE WHEN hasCriteria THEN CASE WHEN expectedEmpty THEN CASE WHEN shown = 0 THEN 1.0E0 ELSE 0.0E0 END "
    "WHEN shown > 0 THEN hits / CAST(shown AS DOUBLE) ELSE 0.0E0 END END AS precision, "
    "CASE WHEN hasCriteria THEN CASE WHEN expectedEmpty THEN CASE WHEN shown = 0 THEN 1.0E0 ELSE 0.0E0 END "
    "WHEN relevantCount > 0 THEN hits / CAST(relevantCount AS DOUBLE) ELSE 0.0E0 END END AS recall, "
    "CASE WHEN hasCriteria THEN CASE WHEN expectedEmpty THEN CASE WHEN shown = 0 THEN 1.0E0 ELSE 0.0E0 END "
    "ELSE coalesce(1.0E0 / first, 0.0E0) END END AS reciprocalRank, "
    "CASE WHEN hasCriteria THEN CASE WHEN expectedEmpty THEN CASE WHEN shown = 0 THEN 1.0E0 ELSE 0.0E0 END "
    "WHEN first <= topK THEN 1.0E0 ELSE 0.0E0 END END AS hit, shown AS returned FROM casus c JOIN ("
    "SELECT c.caseId, count(*) FILTER (rank <= c.topK) AS shown, count(*) FILTER (rank <= c.topK AND grade >= 2) AS hits, "
    "min(CASE WHEN grade >= 2 THEN rank END) AS first FROM casus c LEFT JOIN ranked r ON c.caseId = r.caseId GROUP BY c.caseId) s ON s.caseId = c.caseId"
)
# A case that expects no answer: one for silence, zero otherwise. Else discounted gains of the ranking
# over those of the best order of all judged documents, both within topK.
Q_NDCG = (
    "SELECT c.caseId, CASE WHEN c.expectedEmpty THEN CASE WHEN g.shown > 0 THEN 0.0E0 ELSE 1.0E0 END "
    "WHEN i.best > 0 THEN coalesce(g.got, 0) / i.best ELSE 0.0E0 END AS ndcg FROM casus c LEFT JOIN ("
    "SELECT caseId, count(*) FILTER (rank <= topK) AS shown, sum(CASE WHEN rank <= topK THEN (pow(2, grade) - 1) / log2(rank + 1) END) AS got "
    "FROM ranked GROUP BY caseId) g ON g.caseId = c.caseId LEFT JOIN (SELECT caseId, sum((pow(2, grade) - 1) / log2(ideal + 1)) AS best FROM ("
    "SELECT *, row_number() OVER (PARTITION BY caseId ORDER BY grade DESC, docId) AS ideal FROM fx_run) WHERE ideal <= topK GROUP BY caseId) i ON i.caseId = c.caseId"
)


@query(
    "A05_evaluation_aggregate",
    sql(
        "run",
        "SELECT round(avg(precision), 4) AS meanPrecisionAtK, round(avg(recall), 4) AS meanRecallAtK, round(avg(hit), 4) AS hitRateAtK, "
        "round(avg(reciprocalRank), 4) AS meanReciprocalRank, round(avg(ndcg), 4) AS meanNdcgAtK, "
        "round(avg(returned), 4) AS meanReturnedResultsAtK FROM pc JOIN nd USING (caseId)",
        **RANKED, pc=PER_CASE, nd=Q_NDCG,
    ),
)
def evaluation_aggregate(t: Tables):
    ranked, cases = run(t)
    per_case = evaluation.case_metrics(ranked, cases, "caseId")
    gains = evaluation.case_ndcg(ranked, judgments(t), cases, "caseId", "docId")
    return evaluation.aggregate(per_case.join(gains, "caseId"))


def judgments(t: Tables):
    return t.fx("run").select("caseId", "docId", "grade")


@query(
    "A06_cutoff_metrics",
    sql(
        "run",
        "SELECT k AS cutoff, round(avg(CASE WHEN expectedEmpty THEN CASE WHEN shown = 0 THEN 1.0E0 ELSE 0.0E0 END WHEN shown > 0 "
        "THEN hits / CAST(shown AS DOUBLE) ELSE 0.0E0 END), 4) AS precision, round(avg(CASE WHEN expectedEmpty THEN CASE WHEN shown = 0 "
        "THEN 1.0E0 ELSE 0.0E0 END WHEN relevantCount > 0 THEN hits / CAST(relevantCount AS DOUBLE) ELSE 0.0E0 END), 4) AS recall, "
        "round(avg(CASE WHEN expectedEmpty THEN CASE WHEN shown = 0 THEN 1.0E0 ELSE 0.0E0 END WHEN least(k, relevantCount) > 0 "
        "THEN hits / CAST(least(k, relevantCount) AS DOUBLE) ELSE 0.0E0 END), 4) AS capacityAdjustedRecall FROM ("
        "SELECT c.caseId, k, relevantCount, expectedEmpty, count(*) FILTER (rank <= k) AS shown, "
        "count(*) FILTER (rank <= k AND grade >= 2) AS hits FROM casus c CROSS JOIN (VALUES (1), (3), (5), (10), (20)) ks(k) "
        "LEFT JOIN ranked r ON r.caseId = c.caseId GROUP BY ALL) GROUP BY k",
        **RANKED,
    ),
)
def cutoff_metrics(t: Tables):
    ranked, cases = run(t)
    return evaluation.mean_by_cutoff(evaluation.cutoff_metrics(ranked, cases, "caseId"))


@query("A07_ndcg", sql("run", "SELECT caseId, round(ndcg, 6) AS ndcg FROM nd", **RANKED, nd=Q_NDCG))
def ndcg_per_case(t: Tables):
    ranked, cases = run(t)
    return evaluation.case_ndcg(ranked, judgments(t), cases, "caseId", "docId").select(
        "caseId", F.round("ndcg", 6).alias("ndcg")
    )


@query(
    "A08_context_scores",
    sql(
        "run",
        "SELECT caseId, CASE WHEN len(ref) > 0 THEN CASE WHEN len(got) > 0 THEN round(len(list_intersect(got, ref)) / CAST(len(got) AS DOUBLE), 6) "
        "ELSE 0.0E0 END END AS contextPrecision, CASE WHEN len(ref) > 0 THEN round(len(list_intersect(got, ref)) / CAST(len(ref) AS DOUBLE), 6) END "
        "AS contextRecall FROM (SELECT c.caseId, coalesce(list(docId) FILTER (rank <= c.topK), CAST([] AS BIGINT[])) AS got, "
        "coalesce(list(docId) FILTER (grade = 3 AND c.caseId % 4 > 0), CAST([] AS BIGINT[])) AS ref FROM casus c LEFT JOIN ranked r ON r.caseId = c.caseId GROUP BY c.caseId)",
        **RANKED,
    ),
)
def context_scores(t: Tables):
    ranked, cases = run(t)
    got = ranked.where(F.col("rank") <= F.col("topK"))
    wanted = ranked.where("grade = 3 AND caseId % 4 > 0")
    rows = evaluation.context_scores(got, wanted, cases, "caseId", "docId")
    names = ("contextPrecision", "contextRecall")
    return rows.select("caseId", *[F.round(n, 6).alias(n) for n in names])


@query(
    "A09_evidence_term_coverage",
    "SELECT doc_id, round((CAST(contains(lower(text), 'the ') OR contains(lower(text), 'les ') AS INT) + "
    "CAST(contains(lower(text), 'garden') OR contains(lower(text), 'und ') AS INT) + CAST(contains(lower(text), 'able') AS INT)) / 3.0E0, 6) "
    "AS termCoverage FROM documents",
)
def term_coverage(t: Tables):
    groups = F.array(
        F.array(F.lit("The "), F.lit("les ")), F.array(F.lit("garden"), F.lit("UND ")), F.array(F.lit("able"))
    )
    return t.table("documents").select(
        "doc_id", F.round(evaluation.term_coverage(groups, F.array("text")), 6).alias("termCoverage")
    )


@query(
    "A11_binary_metrics",
    "WITH s AS (SELECT l.quality AS label, CAST(n_chars % 997 AS DOUBLE) / 9.97E2 AS p FROM labels l JOIN documents d ON d.doc_id = l.doc_id), "
    "r AS (SELECT label, p, (rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0E0) AS ar FROM s) "
    "SELECT round((sum(CASE WHEN label = 1 THEN ar END) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0E0) / "
    "(count(*) FILTER (label = 1) * CAST(count(*) FILTER (label = 0) AS DOUBLE)), 4) AS rocAuc, "
    "round(-avg(ln(CASE WHEN label = 1 THEN least(greatest(p, 1E-15), 1 - 1E-15) ELSE 1 - least(greatest(p, 1E-15), 1 - 1E-15) END)), 4) AS logLoss, "
    "round(avg(CASE WHEN (p >= 0.5E0) = (label = 1) THEN 1.0E0 ELSE 0.0E0 END), 4) AS accuracy FROM r",
)
def binary_metrics(t: Tables):
    scored = t.table("labels").join(t.table("documents"), "doc_id").select(
        F.col("quality").alias("label"), ((F.col("n_chars") % 997).cast("double") / 997.0).alias("p")
    )
    return evaluation.binary_metrics(scored, "label", "p")


@query(
    "A12_diary_statistics",
    sql(
        "rating venue",
        "SELECT userId, count(*) AS visitedTotal, count(*) FILTER (updatedAt >= date_trunc('week', TIMESTAMP '2024-01-20 10:00:00')) AS visitedThisWeek, "
        "count(rating) AS ratedTotal, round(avg(rating), 1) AS averageRating, count(DISTINCT CASE WHEN venueId IN (SELECT venueId FROM fx_venue) "
        "THEN venueId END) AS venuesVisited, (SELECT count(*) FROM fx_venue) AS venueTotal, round(100.0E0 * count(DISTINCT CASE WHEN venueId IN "
        "(SELECT venueId FROM fx_venue) THEN venueId END) / (SELECT count(*) FROM fx_venue), 1) AS venuePercent FROM fx_rating WHERE beenHere GROUP BY userId",
    ),
)
def diary_statistics(t: Tables):
    ratings = t.fx("rating").withColumn("visitedAt", F.col("updatedAt"))
    now = F.lit("2024-01-20 10:00:00").cast("timestamp")
    return feedback.diary_stats(ratings, t.fx("venue"), now)


@query(
    "A13_cross_entity_boilerplate",
    "WITH l AS (SELECT doc_id, source, trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')) AS k FROM (SELECT doc_id, source, "
    "unnest(string_split(text, chr(10))) AS line FROM documents)) SELECT doc_id, count(*) AS kept FROM l WHERE k NOT IN "
    "(SELECT k FROM l GROUP BY k HAVING count(DISTINCT source) >= 2) GROUP BY doc_id",
)
def boilerplate(t: Tables):
    from taproom.functions.text import words_only

    lines = t.table("documents").select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line"))
    kept = pages.drop_boilerplate(lines.withColumn("k", words_only(F.col("line"))), "k", "source")
    return kept.groupBy("doc_id").agg(F.count("*").alias("kept"))


@query(
    "A15_latency_summary",
    "SELECT event_type, count(value) AS requests, round(quantile_cont(value, 0.5), 2) AS median, round(quantile_cont(value, 0.95), 2) AS p95, "
    "round(max(value), 2) AS maximum FROM events GROUP BY event_type",
)
def latency(t: Tables):
    return evaluation.latency_summary(t.table("events"), "value", "event_type")


@query(
    "A16_report_combination",
    sql(
        "chunk",
        "SELECT count(*) AS reports, sum(requested) AS requested, CAST(max(scanned) AS STRING) AS scannedAt, (SELECT count(*) FROM (SELECT DISTINCT venueId, sourceUrl, text "
        "FROM fx_chunk)) AS passages FROM (SELECT source, CAST(count(DISTINCT venueId) AS BIGINT) AS requested, max(n) AS scanned FROM fx_chunk GROUP BY source)",
    ),
)
def report_combination(t: Tables):
    chunks = t.fx("chunk")
    reports = chunks.groupBy("source").agg(
        F.countDistinct("venueId").alias("requested"), F.max("n").alias("scanned")
    )
    totals = reports.agg(
        F.count("*").alias("reports"), F.sum("requested").alias("requested"),
        F.max("scanned").cast("string").alias("scannedAt"),
    )
    unique = chunks.dropDuplicates(["venueId", "sourceUrl", "text"]).agg(F.count("*").alias("passages"))
    return totals.transform(with_row, unique)


@query(
    "A17_link_audit_counts",
    sql("venue", "SELECT count(*) AS requested, count(*) FILTER (n % 2 = 0 AND website IS NOT NULL) AS verified, "
        "count(*) FILTER (NOT (n % 2 = 0 AND website IS NOT NULL)) AS rejected FROM fx_venue"),
)
def link_audit(t: Tables):
    source = F.try_element_at("attributeProvenance", F.lit("website"))["source"]
    good = F.coalesce(source == V.OFFICIAL_SOURCE, F.lit(False))
    return t.venues().agg(
        F.count("*").alias("requested"), F.count_if(good).alias("verified"), F.count_if(~good).alias("rejected")
    )


ACTIVE = (
    "SELECT r.requestId, list_sort(list_distinct(list_concat(list_concat(list_filter(["
    "'location:' || location, 'postcode:' || postcode, 'priceLevel:' || p.priceLevel, 'noiseLevel:' || noiseLevel], "
    "lambda x: x IS NOT NULL), list_filter(requiredFeatures, lambda x: x <> 'groups')), list_concat(list_concat("
    "list_transform(preferredFeatures, lambda x: 'prefer:' || x), list_transform(excludedFeatures, lambda x: 'exclude:' || x)), "
    "list_concat(list_concat(list_transform(excludedLocations, lambda x: 'exclude:location:' || x), "
    "list_transform(excludedPriceLevels, lambda x: 'exclude:priceLevel:' || x)), CASE WHEN list_contains(requiredFeatures, 'groups') "
    "THEN ['groupSuitability'] ELSE CAST([] AS VARCHAR[]) END))))) AS active FROM fx_request r JOIN prefs p ON p.query = r.query"
)


@query(
    "A18_preference_explainability",
    sql(
        "request",
        "SELECT requestId, array_to_string(active, '|') AS activePreferences FROM act",
        **REQUEST_TEXTS, **PREFS, act=ACTIVE,
    ),
)
def explainability(t: Tables):
    rows = explain.describe(recommend.parse(t.fx("request").drop("vector")), t.fx("venue"))
    return rows.select("requestId", F.array_join("activePreferences", "|").alias("activePreferences"))


@query("A18_ignored_and_warnings")
def ignored(t: Tables):
    rows = explain.describe(recommend.parse(t.fx("request").drop("vector")), t.fx("venue"))
    return rows.select(
        "requestId", F.array_join("ignoredPreferences", "|").alias("ignoredPreferences"),
        F.array_join("warnings", "|").alias("warnings"),
    )


FLAGGED = [f for f in V.FEATURES if f != "groups"]
NO_RESULT = (
    "SELECT r.requestId, CASE WHEN len(contradictions) > 0 THEN ['Conflicting requirements must be resolved before matching venues.'] "
    "WHEN len(reasons) = 0 THEN ['No venue satisfies all verified requirements together.'] ELSE reasons END AS reasons FROM ("
    "SELECT r.requestId, p.contradictions, list_filter(["
    "CASE WHEN postcode IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sub v WHERE starts_with(replace(v.postcode, ' ', ''), p.postcode)) "
    "THEN 'No venues are available in postcode ' || postcode || '.' END, "
    "CASE WHEN location IS NOT NULL AND location NOT IN (SELECT area FROM sub) THEN 'No venues are available in ' || location || '.' END, "
    + ", ".join(
        f"CASE WHEN list_contains(requiredFeatures, '{f}') AND NOT EXISTS (SELECT 1 FROM sub WHERE {V.FEATURE_FACTS[f]}) "
        f"THEN 'No venues have verified {f} data matching the request.' END"
        for f in FLAGGED
    )
    + ", "
    + ", ".join(
        f"CASE WHEN list_contains(excludedFeatures, '{f}') AND NOT EXISTS (SELECT 1 FROM sub WHERE {V.FEATURE_FACTS[f]} IS FALSE) "
        f"THEN 'No venues have verified evidence excluding {f}.' END"
        for f in sorted(V.FEATURES)
    )
    + "], lambda x: x IS NOT NULL) AS reasons FROM fx_request r JOIN prefs p ON p.query = r.query) r"
)


@query(
    "A19_no_result_diagnosis",
    sql(
        "request venue",
        "SELECT requestId, array_to_string(reasons, '|') AS noResultReasons FROM diag",
        **REQUEST_TEXTS, **PREFS,
        sub="SELECT * FROM fx_venue WHERE area IN ('Brixton', 'Waterloo') AND servesFood IS NOT TRUE AND dogFriendly IS NOT FALSE",
        diag=NO_RESULT,
    ),
)
def no_result(t: Tables):
    few = t.fx("venue").where(
        "area IN ('Brixton', 'Waterloo') AND NOT (servesFood <=> true) AND NOT (dogFriendly <=> false)"
    )
    rows = explain.no_result_reasons(recommend.parse(t.fx("request").drop("vector")), few)
    return rows.select("requestId", F.array_join("noResultReasons", "|").alias("noResultReasons"))


@query(
    "A20_visit_percentage",
    sql(
        "rating venue",
        "SELECT CAST(round(100.0E0 * count(*) FILTER (venueId IN (SELECT venueId FROM fx_rating WHERE beenHere)) / count(*)) AS BIGINT) AS percentage FROM fx_venue",
    ),
)
def visit_percentage(t: Tables):
    seen = t.fx("rating").where("beenHere").select("venueId").distinct().withColumn("seen", F.lit(1))
    return t.fx("venue").join(seen, "venueId", "left").agg(
        F.round(100.0 * F.count("seen") / F.count("*")).cast("long").alias("percentage")
    )


@query(
    "A21_hours_by_weekday",
    sql(
        "tagged",
        "SELECT id, CASE WHEN n % 4 = 3 THEN NULL ELSE concat_ws('; ', 'Mo 11:00-23:00' || CASE WHEN n % 2 = 0 THEN ',09:00-10:00' ELSE '' END, "
        "CASE WHEN n % 3 = 0 THEN 'Fr 12:00-01:00' END) END AS openingHours FROM fx_tagged",
    ),
)
def hours_by_weekday(t: Tables):
    from taproom.functions import hours

    def spec(day, opens, closes):
        return F.struct(hours.day_code(F.lit(day)).alias("day"), F.lit(opens).alias("opens"), F.lit(closes).alias("closes"))

    specs = F.array_compact(
        F.array(
            F.when((F.col("n") % 3 == 0) & (F.col("n") % 4 != 3), spec("https://schema.org/Friday", "12:00", "01:00")),
            F.when(F.col("n") % 4 != 3, spec("Monday", "11:00", "23:00")),
            F.when((F.col("n") % 2 == 0) & (F.col("n") % 4 != 3), spec("Mo", "09:00", "10:00")),
        )
    )
    return t.fx("tagged").select("id", hours.from_specifications(specs).alias("openingHours"))


@query(
    "A22_suite_composition",
    sql(
        "request",
        "SELECT category, count(*) AS cases FROM (SELECT CASE WHEN len(contradictions) > 0 THEN 'contradiction' WHEN len(requiredFeatures) > 0 "
        "AND len(excludedFeatures) > 0 THEN 'mixed' WHEN len(excludedFeatures) > 0 THEN 'negative' WHEN len(requiredFeatures) > 1 THEN 'multi' "
        "ELSE 'positive' END AS category FROM fx_request r JOIN prefs p ON p.query = r.query) GROUP BY category",
        **REQUEST_TEXTS, **PREFS,
    ),
)
def suite_composition(t: Tables):
    p = F.col("prefs")
    need, avoid = F.size(p["requiredFeatures"]), F.size(p["excludedFeatures"])
    category = (
        F.when(F.size(p["contradictions"]) > 0, "contradiction").when((need > 0) & (avoid > 0), "mixed")
        .when(avoid > 0, "negative").when(need > 1, "multi").otherwise("positive")
    )
    return recommend.parse(t.fx("request").drop("vector")).groupBy(category.alias("category")).agg(
        F.count("*").alias("cases")
    )


