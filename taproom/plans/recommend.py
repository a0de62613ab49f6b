"""End-to-end jobs: recommend for a table of requests, evaluate cases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taproom.functions import requests as R
from taproom.functions.text import retrieval_tokens
from taproom.operators import evaluation, evidence, filters, ranking
from taproom.operators.skew import packed_join
from taproom.session import cut, sized, spread

Parser = Callable[[DataFrame], DataFrame]
PREFS_KEY = "prefsKey"


def parse(requests: DataFrame, parser: Parser | None = None) -> DataFrame:
    """Requests with `prefs`; each distinct text is parsed once.

    `parser` may enhance the preferences of a table of distinct texts (query, prefs) before anything is
    filtered by them.
    """
    texts = R.parsed_texts(requests)
    return requests.join(parser(texts) if parser else texts, "query")


def distinct_preferences(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with a key of their preferences, one row per key with `prefs`).

    Requests are many and preferences few, so filters and scores are computed per distinct set. The key goes
    with every candidate, so it is a digest of 32 bytes and not the text of the preferences.
    """
    told = F.to_json("prefs", {"ignoreNullFields": "false"})
    keyed = parsed.withColumn(PREFS_KEY, F.unhex(F.sha2(told, 256)))
    return keyed, keyed.groupBy(PREFS_KEY).agg(F.first("prefs").alias("prefs"))


def per_request(rows: DataFrame, keyed: DataFrame, each: list[Column | str] | None = None) -> DataFrame:
    """Rows (key of preferences, venueId, ...) for every request of these preferences; `each` as in `packed_join`."""
    return packed_join(rows, keyed, [PREFS_KEY], "venueId", each)


def candidate_pairs(parsed: DataFrame, venues: DataFrame) -> DataFrame:
    """(requestId, venueId) of all candidates, found once per distinct preferences."""
    keyed, distinct = distinct_preferences(parsed)
    met = filters.candidates(distinct, venues).select(PREFS_KEY, "venueId")
    return per_request(met, keyed.select(PREFS_KEY, "requestId")).select("requestId", "venueId")


def with_passages(venues: DataFrame, chunks: DataFrame) -> DataFrame:
    """The venues that have a passage; pairs with any other hold no evidence, so they need not be formed."""
    return venues.join(chunks.select("venueId").distinct(), "venueId", "left_semi")


def rank(
    requests: DataFrame, venues: DataFrame, carried: tuple[str, ...] | None = None, each: list[Column | str] | None = None,
    **told: Column,
) -> DataFrame:
    """All candidates of every request with score and explanation (no evidence).

    `told` are further columns over preferences, venue and score, computed once per distinct preferences
    and venue, before the rows go to the requests. `carried` names the columns of the requests that go with their
    rows, all of them if none are named; `each` are the columns wanted of preferences and venue, one of which may be
    an `explode`.
    """
    keyed, distinct = distinct_preferences(parse(requests))
    scored = ranking.with_score(filters.candidates(distinct, venues)).withColumns(told)
    asked = keyed.select(PREFS_KEY, *carried) if carried else keyed.drop("prefs")
    return per_request(scored, asked, each).drop(PREFS_KEY)


def request_side(parsed: DataFrame) -> DataFrame:
    """What evidence retrieval needs to know of a request."""
    return parsed.select(
        "requestId",
        retrieval_tokens(F.col("query")).alias("queryTokens"),
        F.col("vector").alias("queryVector"),
        ranking.evidence_attributes(F.col("prefs")).alias("wanted"),
    )


def retrieve(
    parsed: DataFrame, candidates: DataFrame, chunks: DataFrame, texts: bool = True
) -> DataFrame:
    """Pooled evidence per (requestId, venueId); without `texts` the score alone."""
    asked = request_side(parsed)
    held = spread(chunks).withColumn("tokens", retrieval_tokens(F.col("text")))
    return evidence.pooled_evidence(candidates, asked, held, chunks if texts else None)


def ranking_table(
    parsed: DataFrame, venues: DataFrame, chunks: DataFrame | None = None
) -> DataFrame:
    """Candidates of every request with their weighted score.

    The score is computed once per distinct preferences. `anyScore` tells whether some candidate scored
    above zero, over all of them; with `chunks` only venues that have a passage are paired and written,
    since rows without evidence drop out: of all others nothing but that signal is kept.
    """
    keyed, distinct = distinct_preferences(parsed)
    distinct = cut(distinct)
    scored = ranking.with_score(filters.candidates(distinct, venues))
    signal = cut(scored.groupBy(PREFS_KEY).agg(F.bool_or(F.col("score") > 0).alias("anyScore")))
    if chunks is not None:
        scored = ranking.with_score(filters.candidates(distinct, with_passages(venues, chunks)))
    kept = cut(scored.select(PREFS_KEY, "venueId", "name", "score"))
    extra = [name for name in ("userId",) if name in parsed.columns]
    asked = keyed.select(
        PREFS_KEY, "requestId", *extra, ranking.structured(F.col("prefs")).alias("structured")
    ).join(signal, PREFS_KEY)
    return kept.join(asked, PREFS_KEY).select(
        "requestId", *extra, "venueId", "name", "score", "structured", "anyScore"
    )


def recommend(
    requests: DataFrame,
    venues: DataFrame,
    chunks: DataFrame | None = None,
    ratings: DataFrame | None = None,
    limit: int = 20,
    offset: int = 0,
    parser: Parser | None = None,
) -> DataFrame:
    """Ranked and paged venues for every request of a table.

    `requests`: requestId, query, and vector/userId where evidence and ratings are used. `parser`
    enhances the preferences of the texts. Where nothing depends on the single request, a page is
    found per distinct preferences and only then dealt to the requests.
    """
    parsed = parse(requests, parser)
    if chunks is None and ratings is None:
        keyed, distinct = distinct_preferences(parsed)
        scored = ranking.with_score(filters.candidates(distinct, venues))
        top = ranking.page(scored.select(PREFS_KEY, "venueId", "name", "score"), limit, offset, PREFS_KEY)
        return top.join(keyed.select(PREFS_KEY, "requestId"), PREFS_KEY).drop(PREFS_KEY)
    scored = ranking_table(parsed, venues, chunks)
    if chunks is not None:
        scored = ranking.blend(scored, retrieve(parsed, scored, chunks, texts=False))
    if ratings is not None:
        scored = ranking.personalise(cut(scored), ratings, venues)
    return ranking.page(scored, limit, offset)


def explained(
    page: DataFrame, requests: DataFrame, venues: DataFrame, parser: Parser | None = None
) -> DataFrame:
    """Add reasons, verified and unknown features, distance and breakdown to result rows.

    A venue is explained once for all requests of equal preferences.
    """
    shown = page.select("requestId", "venueId", F.col("rank"), F.col("score").alias("finalScore"))
    keyed, distinct = distinct_preferences(parse(requests, parser).select("requestId", "prefs"))
    dealt = shown.join(keyed.select("requestId", PREFS_KEY), "requestId")
    pairs = dealt.select(PREFS_KEY, "venueId").distinct()
    facts = venues.join(pairs.select("venueId").distinct(), "venueId", "left_semi")
    told = (
        ranking.with_score(pairs.join(distinct, PREFS_KEY).join(facts, "venueId"))
        .withColumn("reasons", ranking.reasons())
        .withColumn("verifiedFeatures", ranking.verified_features())
        .withColumn("unknownFeatures", ranking.unknown_features())
    )
    rest = [name for name in told.columns if name not in (PREFS_KEY, "venueId")]
    return dealt.join(told, [PREFS_KEY, "venueId"]).select("venueId", "requestId", "rank", "finalScore", *rest)


def evaluate(
    cases: DataFrame,
    requests: DataFrame,
    venues: DataFrame,
    chunks: DataFrame,
    judgments: DataFrame | None = None,
    parser: Parser | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(metrics per case, metrics per case and cutoff) of evidence ranking against judged truth.

    `cases`: requestId, topK, required and excluded fact lists, and where used expectNoResults and
    termGroups (lists of terms of which the shown passages should hold one each). `judgments`
    (requestId, venueId, grade) replace the truth of the cases they name; else every venue whose
    facts satisfy a case has grade three. Grades from two up are relevant. A case expects an empty
    answer when it says so or when its facts satisfy no venue. Passages are shown for the facts of the
    case. Truth is computed per distinct criterion, not per case.
    """
    none = F.array().cast("array<array<string>>")
    named = cases if "termGroups" in cases.columns else cases.withColumn("termGroups", none)
    if "expectNoResults" not in named.columns:
        named = named.withColumn("expectNoResults", F.lit(False))
    named = named.withColumn("targetAttributes", F.array_union("required", "excluded"))
    parsed = parse(requests, parser)
    reachable = with_passages(venues, chunks)
    pairs = sized(candidate_pairs(parsed.drop("vector"), reachable))
    asked = request_side(parsed).drop("wanted").join(
        named.select("requestId", F.col("targetAttributes").alias("wanted")), "requestId"
    )
    held = spread(chunks).withColumn("tokens", retrieval_tokens(F.col("text")))
    # What pooling reads of the passages, as Parquet: these rows are the most that evaluation writes.
    top = sized(evidence.top_evidence(pairs, asked, held).drop("hybrid", "preferred", "scoreRank"))
    found = evidence.pool(top, asked, None)
    ranked = sized(evaluation.ranked(found, "requestId", "semanticScore", "venueId"))

    met, grades = _truth(named, venues, reachable)
    met = cut(met)
    of_case = met.withColumnRenamed("_met", "relevantCount")
    if judgments is not None:
        judged = judgments.select("requestId", "venueId", F.col("grade").cast("int").alias("grade"))
        told = judged.select("requestId").distinct()
        grades = grades.join(told, "requestId", "left_anti").unionByName(judged)
        of_judged = judged.groupBy("requestId").agg(F.count_if(F.col("grade") >= 2).alias("relevantCount"))
        of_case = of_case.join(told, "requestId", "left_anti").unionByName(of_judged)
    grades = cut(grades)
    criteria = F.size("targetAttributes") > 0
    full = named.join(of_case, "requestId", "left").join(met, "requestId", "left")
    if judgments is not None:
        full = full.join(judged.select("requestId").distinct().withColumn("_judged", F.lit(True)), "requestId", "left")
    else:
        full = full.withColumn("_judged", F.lit(None).cast("boolean"))
    full = cut(
        full.withColumn("relevantCount", F.coalesce("relevantCount", F.lit(0)))
        .withColumn("hasCriteria", criteria | F.col("_judged").isNotNull() | F.col("expectNoResults"))
        .withColumn("expectedEmpty", F.col("expectNoResults") | criteria & F.col("_met").isNull())
        .drop("_met", "_judged")
    )
    marked = ranked.join(grades, ["requestId", "venueId"], "left").withColumn(
        "relevant", F.coalesce(F.col("grade") >= 2, F.lit(False))
    )
    per_case = evaluation.case_metrics(marked, full, "requestId")
    gains = evaluation.case_ndcg(ranked, grades, full, "requestId", "venueId")

    shown = marked.join(full.select("requestId", "topK"), "requestId").where(F.col("rank") <= F.col("topK"))
    shown = cut(shown.select("requestId", "venueId", "relevant"))
    of_shown = top.join(shown, ["requestId", "venueId"], "left_semi")
    displayed = sized(of_shown.where("displayed AND chunkId IS NOT NULL").select("requestId", "chunkId").distinct())
    covered = _covered(full, of_shown, displayed, asked, chunks)
    contexts = _contexts(full, grades, shown, displayed, chunks)
    for part in (gains, covered, contexts):
        per_case = per_case.join(part, "requestId", "left")
    return per_case, evaluation.cutoff_metrics(marked, full, "requestId")


def _truth(cases: DataFrame, venues: DataFrame, reachable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(how many venues satisfy a case, `_met`, of cases that any does; the graded venues that its measures look at).

    Truth itself, cases times venues, is never formed. It is counted per distinct criterion, and of its rows measures
    look at two kinds: those of venues that can be returned, and the first topK by id, of which the ideal order and
    the reference of a missed case are made, as all true venues have one grade.
    """
    keyed, distinct = distinct_preferences(_criteria(cases))
    keyed, distinct = keyed.select("requestId", PREFS_KEY), cut(distinct)
    counts = filters.candidates(distinct, venues).groupBy(PREFS_KEY).agg(F.count("*").alias("_met"))
    met = keyed.join(counts, PREFS_KEY).groupBy("requestId").agg(F.sum("_met").alias("_met"))
    most = cases.groupBy("requestId").agg(F.max("topK").alias("_k"))
    limited = cut(keyed.join(most, "requestId"))
    depth = limited.groupBy(PREFS_KEY).agg(F.max("_k").alias("_k"))
    order = Window.partitionBy(PREFS_KEY).orderBy("venueId")
    bound = limited.agg(F.max("_k")).first()[0] or 0
    every = filters.candidates(distinct, venues).select(PREFS_KEY, "venueId")
    first = every.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= bound)
    first = first.join(depth, PREFS_KEY).where(F.col("_n") <= F.col("_k")).drop("_k")
    beyond = first.join(reachable.select("venueId").distinct(), "venueId", "left_anti")
    early = beyond.join(limited, PREFS_KEY).where(F.col("_n") <= F.col("_k")).select("requestId", "venueId")
    held = filters.candidates(distinct, reachable).select(PREFS_KEY, "venueId")
    grades = per_request(held, keyed).select("requestId", "venueId").unionByName(early)
    return met, grades.withColumn("grade", F.lit(3))


def _covered(
    cases: DataFrame, of_shown: DataFrame, displayed: DataFrame, asked: DataFrame, chunks: DataFrame
) -> DataFrame:
    """(requestId, termCoverage) of every case.

    Terms are looked for once a passage and set of term groups, so texts don't go to their cases. A term of several
    words may span two passages (and an empty one is in no passage too): such cases are told by their joined texts.
    """
    told = F.sha2(F.to_json(F.struct("termGroups"), {"ignoreNullFields": "false"}), 256)
    rows = cases.select("requestId", "termGroups", F.unhex(told).alias("_terms"))
    joined = F.exists(F.flatten("termGroups"), lambda term: (term == "") | F.contains(term, F.lit(" ")))
    joined = F.coalesce(joined, F.exists("termGroups", lambda group: group.isNull()), F.lit(False))
    apart, whole = rows.where(~joined), rows.where(joined)

    asks = apart.where(F.size("termGroups") > 0).distinct()
    met = displayed.join(asks, "requestId")
    pairs = met.groupBy("_terms", "chunkId").agg(F.first("termGroups").alias("termGroups"))
    lowered = F.lower("text")
    hit = F.transform(
        "termGroups", lambda group, at: F.when(F.exists(group, lambda term: F.contains(lowered, F.lower(term))), at)
    )
    said = pairs.join(chunks.select("chunkId", "text"), "chunkId")
    hits = said.select("_terms", "chunkId", F.explode(F.array_compact(hit)).alias("_group")).distinct()
    counts = (
        met.drop("termGroups").join(hits, ["_terms", "chunkId"]).groupBy("requestId", "_terms")
        .agg(F.count_distinct("_group").alias("_hits"))
    )
    share = F.when(F.size("termGroups") > 0, F.coalesce("_hits", F.lit(0)) / F.size("termGroups"))
    short = apart.join(counts, ["requestId", "_terms"], "left").select("requestId", share.alias("termCoverage"))

    if whole.isEmpty():  # or the texts of all passages would be shuffled for none
        return short
    own = of_shown.join(whole.select("requestId").distinct(), "requestId", "left_semi")
    texts = evidence.pool(own, asked, chunks).groupBy("requestId").agg(F.flatten(F.collect_list("texts")).alias("_said"))
    empty = F.array().cast("array<string>")
    long = whole.join(texts, "requestId", "left").select(
        "requestId", evaluation.term_coverage(F.col("termGroups"), F.coalesce("_said", empty)).alias("termCoverage")
    )
    return short.unionByName(long)


def _contexts(
    cases: DataFrame, grades: DataFrame, shown: DataFrame, displayed: DataFrame, chunks: DataFrame
) -> DataFrame:
    """Context precision and recall: shown passages against those of the relevant venues that were shown.

    A case that showed none of its relevant venues is measured against the first topK of them by id,
    so that a miss counts. Cases that expect no answer have no score.
    """
    open_cases = cases.where(~F.col("expectedEmpty")).select("requestId", "topK", "targetAttributes", "termGroups")
    hit = shown.where("relevant").select("requestId", "venueId")
    first = Window.partitionBy("requestId").orderBy("venueId")
    missed = (
        grades.where("grade >= 2").join(hit.select("requestId").distinct(), "requestId", "left_anti")
        .withColumn("_n", F.row_number().over(first)).join(open_cases.select("requestId", "topK"), "requestId")
        .where(F.col("_n") <= F.col("topK")).select("requestId", "venueId")
    )
    wanted = hit.unionByName(missed).join(open_cases.drop("topK"), "requestId")
    return evaluation.reference_scores(
        displayed.join(open_cases.select("requestId"), "requestId"), chunks, wanted, open_cases, "requestId"
    )


def _criteria(cases: DataFrame) -> DataFrame:
    """(requestId, prefs) of the cases that name facts: their facts as preferences."""
    from taproom import vocab as V

    names = F.map_from_arrays(
        F.array(*[F.lit(f) for f in V.FACT_FEATURES]),
        F.array(*[F.lit(n) for n in V.FACT_FEATURES.values()]),
    )
    features = lambda c: F.transform(c, lambda fact: F.try_element_at(names, fact))
    none = F.array().cast("array<string>")
    text = F.lit(None).cast("string")
    prefs = F.struct(
        text.alias("location"), text.alias("postcode"), none.alias("excludedLocations"),
        text.alias("priceLevel"), none.alias("excludedPriceLevels"), text.alias("noiseLevel"),
        F.lit(None).cast("int").alias("groupSize"),
        features("required").alias("requiredFeatures"), none.alias("preferredFeatures"),
        features("excluded").alias("excludedFeatures"), none.alias("contradictions"),
    )
    return cases.where(F.size("required") + F.size("excluded") > 0).select(
        "requestId", prefs.alias("prefs")
    )


def relevant_venues(cases: DataFrame, venues: DataFrame) -> DataFrame:
    """(requestId, venueId) of venues whose facts satisfy the case, via the routed candidate join, once per criterion."""
    return candidate_pairs(_criteria(cases), venues)


def case_references(cases: DataFrame, targets: DataFrame, venues: DataFrame, chunks: DataFrame) -> DataFrame:
    """(requestId, chunkId) of the reference passages of all venues that satisfy a case.

    `targets`: requestId, targetAttributes, termGroups. References are found once for cases of the same criteria and
    targets and go to the cases last; an id with several cases has the references of all of them, each once.
    """
    keyed, distinct = distinct_preferences(_criteria(cases))
    told = F.sha2(F.to_json(F.struct("targetAttributes", "termGroups"), {"ignoreNullFields": "false"}), 256)
    asked = targets.withColumn("_target", F.unhex(told))
    both = keyed.select("requestId", PREFS_KEY).join(asked.select("requestId", "_target"), "requestId")
    sets = both.groupBy("requestId").agg(F.array_sort(F.collect_set(F.struct(PREFS_KEY, "_target"))).alias("_all"))
    sets = sets.withColumn("_set", F.unhex(F.sha2(F.to_json("_all"), 256)))
    members = sets.groupBy("_set").agg(F.first("_all").alias("_all")).select("_set", F.inline("_all"))
    what = asked.groupBy("_target").agg(F.first("targetAttributes").alias("targetAttributes"), F.first("termGroups").alias("termGroups"))
    met = filters.candidates(distinct, with_passages(venues, chunks)).select(PREFS_KEY, "venueId").distinct()
    wanted = met.join(members, PREFS_KEY).join(what, "_target").drop(PREFS_KEY, "_target")
    refs = evaluation.reference_chunks(chunks, wanted, "_set")
    return packed_join(refs, sets.select("_set", "requestId"), ["_set"], "chunkId").select("requestId", "chunkId")
