"""Ranked-retrieval metrics over tables of cases and ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taproom.operators.skew import with_row
from taproom.session import cut, sized

CUTOFFS = (1, 3, 5, 10, 20)


PIECES = 64


def ranked(frame: DataFrame, key: str, score: str, tie: str, pieces: int = PIECES) -> DataFrame:
    """Add rank 1.. by score desc within a case, for scores between 0 and 1.

    A case is ranked in score ranges: rows per (case, range) come from a partial aggregate, the
    rows above a range from a running sum over at most `pieces` lines, and only the order inside a
    range from a window. A case with very many results is spread over its ranges.
    """
    part = F.least(F.greatest(F.floor(F.col(score) * pieces), F.lit(0)), F.lit(pieces)).cast("int")
    placed = frame.withColumn("_part", part)
    counts = placed.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    higher = Window.partitionBy(key).orderBy(F.desc("_part"))
    above = counts.select(key, "_part", (F.sum("_n").over(higher) - F.col("_n")).alias("_above"))
    order = Window.partitionBy(key, "_part").orderBy(F.desc(score), tie)
    return (
        placed.withColumn("_in", F.row_number().over(order))
        .join(above, [key, "_part"])
        .withColumn("rank", (F.col("_above") + F.col("_in")).cast("int"))
        .drop("_part", "_in", "_above")
    )


def gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / (F.log2(rank + 1))


def case_ndcg(
    results: DataFrame, judgments: DataFrame, cases: DataFrame, key: str, item: str
) -> DataFrame:
    """NDCG of every case: `cases` has key, topK and expectedEmpty.

    A case that expects no answer scores one if none was given within topK and zero otherwise,
    whatever its judgments; of the others those without a judgment have no score.
    """
    limits = cases.select(key, "topK")
    of_results = results.drop("topK", "grade").join(limits, key)
    graded = ndcg(of_results, judgments.drop("topK").join(limits, key), key, item, F.col("topK"))
    shown = of_results.where(F.col("rank") <= F.col("topK")).select(key).distinct().withColumn("_shown", F.lit(True))
    rows = cases.select(key, "expectedEmpty").join(graded, key, "left").join(shown, key, "left")
    abstained = F.when(F.col("_shown").isNull(), 1.0).otherwise(0.0)
    return rows.select(key, F.when(F.col("expectedEmpty"), abstained).otherwise(F.col("ndcg")).alias("ndcg"))


def ndcg(results: DataFrame, judgments: DataFrame, key: str, item: str, k: Column) -> DataFrame:
    """NDCG per judged case. `results` has rank; `judgments` grade per (case, item); `k` a case column.

    The ideal order ranks all judged grades of the case, cut at k.
    """
    actual = (
        results.join(judgments.select(key, item, "grade"), [key, item])
        .where(F.col("rank") <= k)
        .groupBy(key)
        .agg(F.sum(gain(F.col("grade"), F.col("rank"))).alias("_actual"))
    )
    order = Window.partitionBy(key).orderBy(F.desc("grade"), item)
    ideal = (
        judgments.withColumn("_ideal", F.row_number().over(order))
        .where(F.col("_ideal") <= k)
        .groupBy(key)
        .agg(F.sum(gain(F.col("grade"), F.col("_ideal"))).alias("_best"))
    )
    ratio = F.when(F.col("_best") > 0, F.coalesce("_actual", F.lit(0.0)) / F.col("_best"))
    return ideal.join(actual, key, "left").select(
        key, F.coalesce(ratio, F.lit(0.0)).alias("ndcg")
    )


def cutoff_metrics(
    results: DataFrame, cases: DataFrame, key: str, cutoffs: tuple[int, ...] = CUTOFFS
) -> DataFrame:
    """precision, recall, capacity-adjusted recall per case and cutoff.

    `results`: case key, rank, relevant. `cases`: case key, relevantCount, expectedEmpty. All
    cutoffs come from one pass of conditional counts; nothing is repeated per cutoff.
    """
    counts = results.groupBy(key).agg(
        *[
            F.count_if((F.col("rank") <= k) & F.col("relevant")).alias(f"_hit{k}")
            for k in cutoffs
        ],
        F.max("rank").alias("_n"),
    )
    joined = cases.join(counts, key, "left")
    returned = F.coalesce(F.col("_n"), F.lit(0))
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("cutoff"),
                F.coalesce(F.col(f"_hit{k}"), F.lit(0)).alias("hits"),
                F.least(returned, F.lit(k)).alias("shown"),
            )
            for k in cutoffs
        ]
    )
    long = joined.select(key, "relevantCount", "expectedEmpty", F.explode(rows).alias("r"))
    hits, shown, total = F.col("r.hits"), F.col("r.shown"), F.col("relevantCount")
    abstained = (shown == 0).cast("double")
    capacity = F.least(F.col("r.cutoff"), total)

    def share(of: Column) -> Column:
        return F.when(F.col("expectedEmpty"), abstained).otherwise(
            F.when(of > 0, hits / of).otherwise(0.0)
        )

    return long.select(
        key,
        F.col("r.cutoff").alias("cutoff"),
        share(shown).alias("precision"),
        share(total).alias("recall"),
        share(capacity).alias("capacityAdjustedRecall"),
    )


def mean_by_cutoff(metrics: DataFrame) -> DataFrame:
    """Means over all cases, four decimals."""
    names = ("precision", "recall", "capacityAdjustedRecall")
    return metrics.groupBy("cutoff").agg(*[F.round(F.avg(n), 4).alias(n) for n in names])


def case_metrics(results: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """precision, recall, reciprocal rank and hit per case; null where a case has no criteria.

    `cases`: key, topK, relevantCount, expectedEmpty, hasCriteria. The reciprocal rank looks at
    the whole list, the others at the first topK.
    """
    joined = results.drop("topK").join(cases.select(key, "topK"), key)
    per_case = joined.groupBy(key).agg(
        F.count_if(F.col("rank") <= F.col("topK")).alias("_shown"),
        F.count_if((F.col("rank") <= F.col("topK")) & F.col("relevant")).alias("_hits"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("_first"),
    )
    rows = cases.join(per_case, key, "left")
    shown = F.coalesce("_shown", F.lit(0))
    hits = F.coalesce("_hits", F.lit(0))
    abstained = (shown == 0).cast("double")

    def metric(value: Column) -> Column:
        chosen = F.when(F.col("expectedEmpty"), abstained).otherwise(value)
        return F.when(F.col("hasCriteria"), chosen)

    return rows.select(
        key,
        shown.alias("returned"),
        metric(F.when(shown > 0, hits / shown).otherwise(0.0)).alias("precision"),
        metric(
            F.when(F.col("relevantCount") > 0, hits / F.col("relevantCount")).otherwise(0.0)
        ).alias("recall"),
        metric(F.coalesce(1.0 / F.col("_first"), F.lit(0.0))).alias("reciprocalRank"),
        metric((F.col("_first") <= F.col("topK")).cast("double")).alias("_h"),
    ).withColumn("hit", F.when(F.col("precision").isNotNull(), F.coalesce("_h", F.lit(0.0)))).drop(
        "_h"
    )


def aggregate(per_case: DataFrame) -> DataFrame:
    """Mean of every metric over the cases it applies to, four decimals."""
    names = {
        "precision": "meanPrecisionAtK",
        "recall": "meanRecallAtK",
        "hit": "hitRateAtK",
        "reciprocalRank": "meanReciprocalRank",
        "termCoverage": "meanEvidenceTermCoverage",
        "ndcg": "meanNdcgAtK",
        "returned": "meanReturnedResultsAtK",
        "contextPrecision": "idContextPrecision",
        "contextRecall": "idContextRecall",
    }
    return per_case.agg(
        *[
            F.round(F.avg(name), 4).alias(label)
            for name, label in names.items()
            if name in per_case.columns
        ]
    )


def context_scores(
    retrieved: DataFrame, reference: DataFrame, cases: DataFrame, key: str, item: str
) -> DataFrame:
    """Share of retrieved ids that are references and of references that were retrieved.

    Nothing retrieved gives (0, 0); a case without references has no score. Sets are compared by a
    join on (case, id) and counted, never gathered.
    """
    found = retrieved.select(key, item).distinct()
    wanted = reference.select(key, item).distinct()

    def size(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy(key).agg(F.count("*").alias(name))

    both = size(found.join(wanted, [key, item]), "_both")
    return _context_shares(cases, size(found, "_found"), size(wanted, "_wanted"), both, key)


def _context_shares(cases: DataFrame, found: DataFrame, wanted: DataFrame, both: DataFrame, key: str) -> DataFrame:
    """The scores from the counts _found, _wanted and _both of each case."""
    rows = cases.select(key).distinct()
    for part in (found, wanted, both):
        rows = rows.join(part, key, "left")
    hits = F.coalesce("_both", F.lit(0))
    applies = F.col("_wanted") > 0
    return rows.select(
        key,
        F.when(applies, F.coalesce(hits / F.col("_found"), F.lit(0.0))).alias("contextPrecision"),
        F.when(applies, hits / F.col("_wanted")).alias("contextRecall"),
    )


def reference_scores(
    retrieved: DataFrame, chunks: DataFrame, wanted: DataFrame, cases: DataFrame, key: str
) -> DataFrame:
    """`context_scores` of retrieved (key, chunkId) against the `reference_chunks` of `wanted`.

    References are found once for cases of equal targets and a venue, and counted there. They stand next to a case
    only where they were retrieved, or where a chunk id is of several venues and so can't be counted by venue.
    """
    target = F.array_sort(F.collect_set(F.struct("targetAttributes", "termGroups")))
    told = F.to_json(F.struct("_targets"), {"ignoreNullFields": "false"})
    of_case = wanted.groupBy(key).agg(target.alias("_targets")).withColumn("_target", F.unhex(F.sha2(told, 256)))
    venues = cut(wanted.select(key, "venueId").distinct().join(of_case, key).select(key, "venueId", "_target"))
    asked = of_case.groupBy("_target").agg(F.first("_targets").alias("_targets"))
    apart = asked.select("_target", F.inline("_targets"))
    reached = venues.select("_target", "venueId").distinct().join(apart, "_target")
    refs = reference_chunks(chunks, reached, "_target", "venueId")
    of_chunk = sized(refs.groupBy("_target", "chunkId").agg(F.collect_set("venueId").alias("_venues")))
    alone = of_chunk.where(F.size("_venues") == 1).select("_target", F.get("_venues", F.lit(0)).alias("venueId"), "chunkId")
    several = of_chunk.where(F.size("_venues") > 1).select("_target", F.explode("_venues").alias("venueId"), "chunkId")
    counted = alone.groupBy("_target", "venueId").agg(F.count("*").alias("_n"))
    by_venue = venues.join(counted, ["_target", "venueId"]).select(key, "_n")
    spelled = venues.join(several, ["_target", "venueId"]).select(key, "chunkId").distinct()
    sizes = by_venue.unionByName(spelled.select(key, F.lit(1).cast("long").alias("_n")))
    found = retrieved.select(key, "chunkId").distinct()
    both = (
        found.join(of_case.select(key, "_target"), key).join(of_chunk, ["_target", "chunkId"])
        .select(key, "chunkId", F.explode("_venues").alias("venueId"))
        .join(venues.select(key, "venueId"), [key, "venueId"], "left_semi").select(key, "chunkId").distinct()
    )
    return _context_shares(
        cases, found.groupBy(key).agg(F.count("*").alias("_found")), sizes.groupBy(key).agg(F.sum("_n").alias("_wanted")),
        both.groupBy(key).agg(F.count("*").alias("_both")), key,
    )


def term_coverage(groups: Column, texts: Column) -> Column:
    """Share of term groups with a term in the joined texts; null without groups."""
    joined = F.lower(F.array_join(texts, " "))
    matched = F.filter(
        groups, lambda group: F.exists(group, lambda term: F.contains(joined, F.lower(term)))
    )
    return F.when(F.size(groups) > 0, F.size(matched) / F.size(groups))


def reference_chunks(
    chunks: DataFrame, wanted: DataFrame, *key: str
) -> DataFrame:
    """Reference passages per case: of the wanted venues, on target attributes or expected terms.

    `wanted`: case key (one column or more), venueId, targetAttributes, termGroups.
    """
    from taproom.operators.skew import split_join

    # Texts go only where a case names no attribute.
    named = wanted.where(F.size("targetAttributes") > 0)
    on_target = split_join(chunks.select("chunkId", "venueId", "attributes"), named, ["venueId"]).where(
        F.arrays_overlap("targetAttributes", "attributes")
    )
    lowered = F.lower("text")
    by_term = F.exists(
        "termGroups", lambda group: F.exists(group, lambda term: F.contains(lowered, F.lower(term)))
    )
    rest = wanted.where(F.coalesce(F.size("targetAttributes"), F.lit(0)) <= 0)
    on_term = split_join(chunks.select("chunkId", "venueId", "text"), rest, ["venueId"]).where(by_term)
    found = on_target.select(*key, "chunkId").unionByName(on_term.select(*key, "chunkId"))
    return found.distinct()


def auc(frame: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve from pair counts per distinct score.

    Scores are first reduced to one row each with positive and negative counts (a partial
    aggregate). The running count of negatives below each score comes from a two-level sum: totals
    per score range, then a running sum inside each range, so no task sees all scores.
    """
    per_score = frame.groupBy(F.col(score).alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")
    )
    part = F.least(F.greatest(F.floor(F.col("s") * 1024), F.lit(0)), F.lit(1024))
    ranges = per_score.withColumn("bucket", part)
    totals = ranges.groupBy("bucket").agg(F.sum("n").alias("bn"))
    before = totals.select(
        "bucket",
        (F.sum("bn").over(Window.orderBy("bucket")) - F.col("bn")).alias("base"),
    )
    inside = Window.partitionBy("bucket").orderBy("s")
    below = ranges.withColumn("lower", F.sum("n").over(inside) - F.col("n")).join(before, "bucket")
    wins = F.sum(F.col("p") * (F.col("base") + F.col("lower") + F.col("n") / 2.0))
    return below.agg((wins / (F.sum("p") * F.sum("n"))).alias("rocAuc"))


def binary_metrics(frame: DataFrame, label: str, score: str) -> DataFrame:
    """One row: rocAuc, logLoss, accuracy at one half (four decimals)."""
    clipped = F.least(F.greatest(F.col(score), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -F.avg(F.log(F.when(F.col(label) == 1, clipped).otherwise(1 - clipped)))
    right = ((F.col(score) >= 0.5).cast("int") == F.col(label)).cast("double")
    simple = frame.agg(
        F.round(loss, 4).alias("logLoss"), F.round(F.avg(right), 4).alias("accuracy")
    )
    area = auc(frame, label, score).select(F.round("rocAuc", 4).alias("rocAuc"))
    return area.transform(with_row, simple)


LINES = 1024  # value ranges a group is counted in, and rows of a range that are put in order


def order_statistics(rows: DataFrame, wanted: DataFrame, lines: int = LINES) -> DataFrame:
    """(g, rank, v): the value of each wanted rank (from 0) of a group, exact, for rows (g, v) with finite v.

    `wanted` has g, rank, and n, lo, hi: rows, least and greatest value of the group. Each round counts the rows
    of the open ranges in `lines` parts and goes on with the part that holds the rank, so a task holds that many
    lines a group, however many rows the group has. A part of few rows is put in order, one of equal values is done.
    """
    open_ = wanted.select("g", "rank", F.col("rank").alias("place"), "n", "lo", "hi")
    found = None

    def within(ranges: DataFrame) -> DataFrame:
        named = ranges.withColumnRenamed("g", "_g")
        return rows.join(named, F.col("g").eqNullSafe(F.col("_g")) & F.col("v").between(F.col("lo"), F.col("hi")))

    while True:
        open_ = cut(open_)
        small = within(open_.where((F.col("lo") < F.col("hi")) & (F.col("n") <= lines)))
        order = Window.partitionBy("g", "rank").orderBy("v")
        placed = small.withColumn("_at", F.row_number().over(order) - 1).where("_at = place").select("g", "rank", "v")
        done = open_.where("lo = hi").select("g", "rank", F.col("lo").alias("v")).unionByName(placed)
        found = done if found is None else found.unionByName(done)
        large = open_.where((F.col("lo") < F.col("hi")) & (F.col("n") > lines))
        if large.isEmpty():
            return found
        # Halved, so that no difference overflows; the part rises with the value, from the first to the last.
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        parts = within(large).withColumn("part", F.least(F.floor(share * lines), F.lit(lines - 1)))
        counts = parts.groupBy("g", "rank", "place", "part").agg(
            F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
        )
        below = F.sum("n").over(Window.partitionBy("g", "rank").orderBy("part")) - F.col("n")
        inside = counts.withColumn("_below", below).where("_below <= place AND place < _below + n")
        open_ = inside.select("g", "rank", (F.col("place") - F.col("_below")).alias("place"), "n", "lo", "hi")


def percentiles(frame: DataFrame, value: str, group: str | None, shares: dict[str, float], lines: int = LINES) -> DataFrame:
    """g and one column per share: exact percentiles, linear between neighbours; null values are left out."""
    key = F.col(group) if group else F.lit(0)
    rows = frame.select(key.alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    sizes = cut(rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))

    def place(p: float) -> Column:
        return (F.col("n") - 1) * F.lit(p)

    ranks = F.array_distinct(F.concat(*[F.array(F.floor(place(p)), F.ceil(place(p))) for p in shares.values()]))
    found = order_statistics(rows, sizes.select("*", F.explode(ranks).alias("rank")), lines)
    values = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))

    def between(p: float) -> Column:
        low, high = F.floor(place(p)), F.ceil(place(p))
        a, b = F.try_element_at("at", low), F.try_element_at("at", high)
        return F.when(low == high, a).otherwise((high - place(p)) * a + (place(p) - low) * b)

    named = values.withColumnRenamed("g", "_g")
    both = sizes.join(named, F.col("g").eqNullSafe(F.col("_g")))
    return both.select("g", *[between(p).alias(name) for name, p in shares.items()])


def latency_summary(frame: DataFrame, value: str, group: str | None = None, lines: int = LINES) -> DataFrame:
    """count, median, 95th percentile (linear between neighbours) and maximum."""
    keys = [F.col(group).alias("g")] if group else [F.lit(0).alias("g")]
    simple = frame.select(*keys, F.col(value).alias("v")).groupBy("g").agg(
        F.count("v").alias("requests"), F.round(F.max("v"), 2).alias("maximum")
    )
    if not group:
        empty = frame.agg(F.count(value).alias("requests"), F.round(F.max(value), 2).alias("maximum"))
        simple = empty.withColumn("g", F.lit(0))
    inner = percentiles(frame, value, group, {"median": 0.5, "p95": 0.95}, lines).withColumnRenamed("g", "_g")
    joined = simple.join(inner, F.col("g").eqNullSafe(F.col("_g")), "left")
    named = [F.col("g").alias(group)] if group else []
    return joined.select(*named, "requests", F.round("median", 2).alias("median"), F.round("p95", 2).alias("p95"), "maximum")
