"""Request parsing, intents and preference algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from taproom import vocab as V
from taproom.catalog.base import Tables, joined, query, sql
from taproom.catalog.requestsql import FEEDBACK_TEXTS, PREFS, REQUEST_TEXTS, q
from taproom.functions import requests as R, text
from taproom.operators import intents, ranking
from taproom.plans import recommend
from taproom.operators.skew import with_row

LISTS = ("excludedLocations", "excludedPriceLevels", "requiredFeatures", "preferredFeatures", "excludedFeatures", "contradictions")


@query(
    "H33_preference_extraction",
    sql(
        "request",
        "SELECT r.requestId, location, postcode, priceLevel, noiseLevel, groupSize, "
        + ", ".join(f"array_to_string({n}, '|') AS {n}" for n in LISTS)
        + " FROM fx_request r JOIN prefs p ON p.query = r.query",
        **REQUEST_TEXTS, **PREFS,
    ),
)
def preference_extraction(t: Tables):
    p = F.col("prefs")
    return recommend.parse(t.fx("request").drop("vector")).select(
        "requestId", *[p[n].alias(n) for n in ("location", "postcode", "priceLevel", "noiseLevel", "groupSize")],
        *[F.array_join(p[n], "|").alias(n) for n in LISTS],
    )


def _leftover_sql() -> str:
    import re

    phrases = {p for _, _, p in R.phrase_table()} | set(V.NEGATIVE_PREFIXES) | set(V.SOFT_PREFIXES)
    body = f"regexp_replace(lower(query), {q(V.GROUP_SIZE)}, ' ', 'g')"
    postcode = (
        f"CASE WHEN regexp_extract(query, {q(V.FULL_POSTCODE)}, 1) <> '' THEN lower(regexp_extract(query, {q(V.FULL_POSTCODE)}, 1)) "
        f"ELSE lower(regexp_extract(query, {q(V.OUTWARD_POSTCODE)}, 1)) END"
    )
    body = f"CASE WHEN {postcode} <> '' THEN replace({body}, {postcode}, ' ') ELSE {body} END"
    by_length: dict[int, list[str]] = {}
    for p in phrases:
        by_length.setdefault(len(p), []).append(re.escape(p).replace("\\ ", " ").replace("\\-", "-"))
    for length in sorted(by_length, reverse=True):
        pattern = r"\b(?:" + "|".join(sorted(by_length[length])) + r")\b"
        body = f"regexp_replace({body}, {q(pattern)}, ' ', 'g')"
    filler = ", ".join(q(w) for w in V.FILLER_WORDS)
    return (
        f"SELECT query, array_to_string(list_filter(regexp_extract_all({body}, '[a-z0-9''-]+'), "
        f"lambda x: x NOT IN ({filler})), ' ') AS leftover FROM texts"
    )


@query(
    "H33_leftover_terms",
    sql("request", "SELECT r.requestId, l.leftover FROM fx_request r JOIN l ON l.query = r.query", **REQUEST_TEXTS, l=_leftover_sql()),
)
def leftover(t: Tables):
    texts = t.fx("request").select("query").distinct()
    words = texts.select("query", F.array_join(R.leftover_terms(F.col("query")), " ").alias("leftover"))
    return t.fx("request").select("requestId", "query").join(words, "query").drop("query")


SPLIT = V.CLAUSE_BREAK


@query(
    "H34_clauses",
    sql(
        "request",
        "SELECT requestId, array_to_string(c, '|') AS clauses, len(list_filter(c, lambda x: "
        f"NOT (regexp_matches(x, {q(V.POSITIVE_ACCESS)}) AND NOT regexp_matches(x, {q(V.NEGATED_ACCESS)})) AND regexp_matches(x, {q(V.CLAUSE_NEGATIVE)}))) AS negative, "
        f"len(list_filter(c, lambda x: regexp_matches(x, {q(V.SOFT_CLAUSE)}))) AS soft, regexp_matches(query, {q(V.GLOBAL_NEGATIVE)}) AND NOT "
        f"regexp_matches(query, {q(V.CONTRAST)}) AND NOT regexp_matches(query, {q(V.POSITIVE_ACCESS)}) AS globalNegative FROM ("
        f"SELECT requestId, query, list_filter(list_transform(string_split_regex(query, {q(SPLIT)}), lambda x: trim(x)), lambda x: length(x) >= 3) AS c FROM fx_request)",
    ),
)
def clause_table(t: Tables):
    rows = t.fx("request").select("requestId", "query", R.clauses(F.col("query")).alias("clauses"))
    return rows.select(
        "requestId", joined("clauses"),
        F.size(F.filter("clauses", R.is_negative_clause)).alias("negative"),
        F.size(F.filter("clauses", R.is_soft_clause)).alias("soft"),
        R.is_global_negative(F.col("query")).alias("globalNegative"),
    )


LABEL_CASE = " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate((*V.INTENT_FEATURES, "none")))


def label_of(column):
    names = F.array(*[F.lit(n) for n in (*V.INTENT_FEATURES, "none")])
    return F.get(names, (column % 15).cast("int"))


def prototypes(t: Tables):
    """Labelled vectors: the first thirty given vectors, two per label."""
    return t.table("embeddings").where("vec_id < 30").select(
        label_of(F.col("vec_id")).alias("label"), F.col("embedding").cast("array<double>").alias("vector")
    )


PROTO = {
    "proto": f"SELECT CASE vec_id % 15 {LABEL_CASE} END AS label, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings WHERE vec_id < 30",
    "sims": "SELECT r.requestId, p.label, max(list_cosine_similarity(CAST(r.vector AS DOUBLE[]), p.vector)) AS score FROM fx_request r, proto p GROUP BY ALL",
}


@query(
    "J19_prototype_similarity",
    sql("request", "SELECT requestId, label, round(score, 6) AS score FROM sims", **PROTO),
)
def prototype_similarity(t: Tables):
    scores = intents.label_scores(t.requests().select("requestId", "vector"), prototypes(t), "requestId")
    return scores.select("requestId", "label", F.round("score", 6).alias("score"))


@query(
    "W11_top_intents",
    sql(
        "request",
        "SELECT requestId, label AS topLabel, round(score, 6) AS topScore, round(score - nx, 6) AS margin FROM (SELECT *, lead(score) OVER w AS nx, "
        "row_number() OVER w AS rn FROM sims WHERE label <> 'none' WINDOW w AS (PARTITION BY requestId ORDER BY score DESC)) WHERE rn = 1",
        **PROTO,
    ),
)
def top_intents(t: Tables):
    scores = intents.label_scores(t.requests().select("requestId", "vector"), prototypes(t), "requestId")
    return intents.top_two(scores, "requestId").select(
        "requestId", "topLabel", F.round("topScore", 6).alias("topScore"), F.round("margin", 6).alias("margin")
    )


def clause_decisions(t: Tables):
    """Clause-level decisions of every distinct request text with the request's vector."""
    asked = t.requests().select("requestId", "query", "vector")
    scores = intents.label_scores(asked.select("requestId", "vector"), prototypes(t), "requestId")
    top = intents.top_two(scores, "requestId")
    rows = asked.join(top, "requestId").withColumn("globalNegative", R.is_global_negative(F.col("query")))
    split = rows.select(
        "requestId", "query", "globalNegative", "topLabel", "topScore", "secondScore", "noneScore", "scores",
        F.posexplode(R.clauses(F.col("query"))).alias("clauseNo", "clause"),
    )
    return intents.decide(split), rows


@query("H35_intent_decision")
def intent_decision(t: Tables):
    decided, rows = clause_decisions(t)
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    per_request = decided.groupBy("requestId").agg(
        flat("clauseRequired").alias("required"), flat("clausePreferred").alias("preferred"),
        flat("clauseExcluded").alias("excluded"), flat("clausePositive").alias("positive"),
    )
    whole = intents.whole_request(rows.select("requestId", "query", "scores", "noneScore")).select(
        "requestId", "wholeRequired"
    )
    parsed = recommend.parse(t.fx("request").select("requestId", "query"))
    merged = intents.combine(parsed.join(per_request, "requestId").join(whole, "requestId"))
    names = ("requiredFeatures", "preferredFeatures", "excludedFeatures", "contradictions")
    return merged.select("requestId", *[joined(n) for n in names])


@query("H36_model_label_merge")
def model_merge(t: Tables):
    k = F.col("requestId") % 4
    none = F.array().cast("array<string>")

    def labels(*names):
        return F.array(*[F.lit(n) for n in names])

    rows = recommend.parse(t.fx("request").select("requestId", "query")).select(
        "*",
        F.when(k == 0, labels("food", "dj")).when(k == 1, labels("dogFriendly")).otherwise(none).alias("modelRequired"),
        F.when(k == 2, labels("outdoorSeating", "liveMusic")).otherwise(none).alias("modelPreferred"),
        F.when(k == 3, labels("sports", "dogFriendly")).otherwise(none).alias("modelExcluded"),
        F.when(k == 1, labels("food")).otherwise(none).alias("modelContradictions"),
    )
    names = ("requiredFeatures", "preferredFeatures", "excludedFeatures", "contradictions")
    return intents.merge_labels(rows).select("requestId", *[joined(n) for n in names])


@query(
    "X04_preference_algebra",
    sql(
        "request",
        "SELECT requestId, array_to_string(list_sort(list_filter(requiredFeatures, lambda x: NOT list_contains(excludedFeatures, x))), '|') AS kept, "
        "array_to_string(list_sort(list_filter(excludedFeatures, lambda x: list_contains(requiredFeatures, x) OR list_contains(preferredFeatures, x))), '|') AS clash, "
        "array_to_string(list_sort(list_distinct(list_concat(requiredFeatures, preferredFeatures))), '|') AS positive "
        "FROM fx_request r JOIN prefs p ON p.query = r.query",
        **REQUEST_TEXTS, **PREFS,
    ),
)
def preference_algebra(t: Tables):
    p = F.col("prefs")
    need, want, avoid = p["requiredFeatures"], p["preferredFeatures"], p["excludedFeatures"]
    return recommend.parse(t.fx("request").drop("vector")).select(
        "requestId",
        F.array_join(F.array_sort(F.array_except(need, avoid)), "|").alias("kept"),
        F.array_join(F.array_sort(F.array_intersect(avoid, F.array_union(need, want))), "|").alias("clash"),
        F.array_join(F.array_sort(F.array_union(need, want)), "|").alias("positive"),
    )


Q_ATTRIBUTES = (
    "array_to_string(list_sort(list_filter(list_transform(list_distinct(list_concat(requiredFeatures, excludedFeatures)), lambda x: CASE x "
    + " ".join(f"WHEN '{f}' THEN '{fact}'" for f, fact in V.FEATURE_FACTS.items())
    + " END), lambda x: x IS NOT NULL)), '|')"
)


@query(
    "H37_evidence_attributes",
    sql(
        "request", f"SELECT requestId, {Q_ATTRIBUTES} AS attributes FROM fx_request r JOIN prefs p ON p.query = r.query",
        **REQUEST_TEXTS, **PREFS,
    ),
)
def evidence_attributes(t: Tables):
    return recommend.parse(t.fx("request").drop("vector")).select(
        "requestId", F.array_join(ranking.evidence_attributes(F.col("prefs")), "|").alias("attributes")
    )


@query(
    "H38_query_key_and_signature",
    sql(
        "feedback",
        "SELECT queryKey, count(*) AS events, min(grp) AS groups FROM (SELECT f.n, regexp_replace(trim(lower(f.query)), '\\s+', ' ', 'g') AS queryKey, "
        "g.grp FROM fx_feedback f JOIN prefs p ON p.query = f.query, (SELECT count(*) AS grp FROM (SELECT DISTINCT location, postcode, excludedLocations, "
        "priceLevel, excludedPriceLevels, noiseLevel, groupSize, requiredFeatures, preferredFeatures, excludedFeatures, contradictions FROM prefs)) g) GROUP BY queryKey",
        **FEEDBACK_TEXTS, **PREFS,
    ),
)
def signatures(t: Tables):
    events = t.fx("feedback").where("query IS NOT NULL")
    parsed = R.parsed_texts(events).withColumn("signature", R.signature(F.col("prefs")))
    groups = parsed.agg(F.countDistinct("signature").alias("groups"))
    keyed = events.groupBy(text.query_key(F.col("query")).alias("queryKey")).agg(F.count("*").alias("events"))
    return keyed.transform(with_row, groups)
