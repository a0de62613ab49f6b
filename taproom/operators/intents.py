"""Feature intents of request clauses from vectors, and merging of model labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taproom import vocab as V
from taproom.functions import requests as R
from taproom.functions.similarity import cosine
from taproom.operators.skew import with_row


BLOCK = 2000  # prototypes that every clause is compared with in one pass


def label_scores(
    clauses: DataFrame, prototypes: DataFrame, key: str = "clauseId", vector: str = "vector", block: int = BLOCK
) -> DataFrame:
    """Best similarity of each clause to the prototypes of each label.

    `prototypes` (label, vector) is a vocabulary, usually of a few dozen rows. It is dealt into blocks
    of about `block` rows; each becomes one row that every clause is paired with, so the requests are
    never shuffled, and the best of the blocks stays. Any number of prototypes works.
    """
    blocks = 1 + (prototypes.count() - 1) // block
    if blocks <= 1:
        return _block_scores(clauses, prototypes, key, vector)
    deal = F.pmod(F.xxhash64("label", "vector"), F.lit(blocks))
    parts = [_block_scores(clauses, prototypes.where(deal == b), key, vector) for b in range(blocks)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(key, "label").agg(F.max("score").alias("score"))


def _block_scores(clauses: DataFrame, prototypes: DataFrame, key: str, vector: str) -> DataFrame:
    rows = prototypes.groupBy("label").agg(
        F.collect_list("vector").alias("examples")
    )
    table = rows.agg(F.collect_list(F.struct("label", "examples")).alias("table"))
    joined = clauses.select(key, F.col(vector).alias("_v")).transform(with_row, table)
    scores = F.transform(
        "table",
        lambda row: F.struct(
            row["label"].alias("label"),
            F.array_max(
                F.transform(row["examples"], lambda example: cosine(F.col("_v"), example))
            ).alias("score"),
        ),
    )
    return joined.select(key, F.explode(scores).alias("s")).select(key, "s.label", "s.score")


def top_two(scores: DataFrame, key: str = "clauseId") -> DataFrame:
    """Best and second-best label per clause, the margin, and the score of "none"."""
    order = F.struct(F.col("score"), F.col("label"))
    per = scores.groupBy(key).agg(
        F.slice(
            F.sort_array(F.collect_list(F.when(F.col("label") != "none", order)), asc=False), 1, 2
        ).alias("t"),
        F.max(F.when(F.col("label") == "none", F.col("score"))).alias("noneScore"),
        F.map_from_entries(F.collect_list(F.struct("label", "score"))).alias("scores"),
    )
    first, second = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    return per.select(
        key,
        first["label"].alias("topLabel"),
        first["score"].alias("topScore"),
        second["score"].alias("secondScore"),
        (first["score"] - second["score"]).alias("margin"),
        "noneScore",
        "scores",
    )


def _minimum(feature: Column) -> Column:
    table = F.map_from_arrays(
        F.array(*[F.lit(name) for name in V.INTENT_MINIMUM]),
        F.array(*[F.lit(value) for value in V.INTENT_MINIMUM.values()]),
    )
    return F.try_element_at(table, feature)


def _without(features: Column, name: str, when: Column) -> Column:
    return F.when(when, F.array_remove(features, name)).otherwise(features)


def _holds(features: Column, name: str) -> Column:
    return F.array_contains(features, name)


def decide(clauses: DataFrame) -> DataFrame:
    """Per clause: features it requires, prefers, excludes, and those it states positively.

    `clauses`: clause, globalNegative, topLabel, topScore, secondScore, noneScore, scores.
    """
    clause = F.col("clause")
    parsed = R.with_preferences(clauses, "clause", "_prefs")
    intent_names = F.array(*[F.lit(name) for name in V.INTENT_FEATURES])
    stated = F.array_intersect(F.col("_prefs.requiredFeatures"), intent_names)
    staged = (
        parsed.withColumn("_stated", stated)
        .withColumn("_anchored", R.anchored_features(clause))
        .withColumn("_negative", F.col("globalNegative") | R.is_negative_clause(clause))
        .withColumn("_soft", R.is_soft_clause(clause))
    )
    clear = (
        ~F.col("globalNegative")
        & (F.col("topScore") >= _minimum(F.col("topLabel")))
        & (F.col("topScore") >= F.coalesce(F.col("noneScore"), F.lit(-1.0)) + V.INTENT_MARGIN)
        & (F.col("topScore") >= F.col("secondScore") + V.INTENT_MARGIN)
    )
    none = F.array().cast("array<string>")
    top = F.when(clear, F.array("topLabel")).otherwise(none)
    options = F.array_union("_anchored", top)
    options = _without(
        options,
        "wheelchairAccess",
        _holds(F.col("_anchored"), "accessibleToilet") & ~_holds(F.col("_anchored"), "wheelchairAccess"),
    )
    options = _without(
        options, "food", _holds(F.col("_anchored"), "sundayRoast") & ~_holds(F.col("_stated"), "food")
    )
    staged = staged.withColumn("_options", options)
    narrowed = F.when(
        F.col("_negative") | F.col("_soft"),
        F.when(F.size("_anchored") > 0, F.col("_anchored")).otherwise(
            F.filter("_options", lambda name: name == F.col("topLabel"))
        ),
    ).otherwise(F.col("_options"))
    staged = staged.withColumn("_options", narrowed)
    both = _holds(F.col("_options"), "dj") & _holds(F.col("_options"), "liveMusic")
    kept_dj = _holds(F.col("_stated"), "dj")
    kept_music = _holds(F.col("_stated"), "liveMusic")
    weaker_dj = F.try_element_at("scores", F.lit("dj")) <= F.try_element_at("scores", F.lit("liveMusic"))
    drop_dj = F.when(kept_dj & ~kept_music, F.lit(False)).when(
        kept_music & ~kept_dj, F.lit(True)
    ).otherwise(weaker_dj)
    single = F.when(
        both,
        F.when(drop_dj, F.array_remove("_options", "dj")).otherwise(
            F.array_remove("_options", "liveMusic")
        ),
    ).otherwise(F.col("_options"))
    sure = F.filter(
        single,
        lambda name: (F.try_element_at("scores", name) >= _minimum(name))
        | (F.col("_negative") & F.array_contains("_anchored", name)),
    )
    staged = staged.withColumn("_sure", sure)
    indoors = F.rlike(clause, F.lit(V.INDOOR)) & ~F.rlike(clause, F.lit(V.PAST_INDOOR))

    def part(test) -> Column:
        return F.filter("_sure", test)

    against = lambda name: F.col("_negative") | ((name == "outdoorSeating") & indoors)
    positive = part(lambda name: ~F.col("_soft") & ~against(name))
    rejected = part(lambda name: ~F.col("_soft") & against(name))
    return staged.select(
        *clauses.columns,
        part(lambda name: F.col("_soft")).alias("clausePreferred"),
        F.array_union(rejected, F.when(F.col("_negative"), F.col("_stated")).otherwise(none)).alias(
            "clauseExcluded"
        ),
        positive.alias("clauseRequired"),
        F.array_union(positive, F.when(F.col("_negative"), none).otherwise(F.col("_stated"))).alias(
            "clausePositive"
        ),
    )


def whole_request(top: DataFrame) -> DataFrame:
    """Up to two features the complete request means when no clause rule can apply.

    `top`: query, scores, noneScore (from the request's own vector).
    """
    query = F.col("query")
    quiet = ~(
        R.is_global_negative(query)
        | F.rlike(query, F.lit(V.CONTRAST))
        | F.rlike(query, F.lit(V.CLAUSE_NEGATIVE))
        | F.rlike(query, F.lit(V.INDOOR))
        | R.is_soft_clause(query)
        | (F.size(R.anchored_features(query)) > 0)
    )
    ranked = F.slice(
        F.sort_array(
            F.transform(
                F.filter(F.map_entries("scores"), lambda e: e["key"] != "none"),
                lambda e: F.struct(e["value"].alias("s"), e["key"].alias("f")),
            ),
            asc=False,
        ),
        1,
        2,
    )
    best = F.get(ranked, F.lit(0))["s"]
    good = F.filter(
        ranked,
        lambda e: (e["s"] >= _minimum(e["f"]))
        & (e["s"] >= F.coalesce(F.col("noneScore"), F.lit(-1.0)) + V.INTENT_MARGIN)
        & (e["s"] >= best - 0.02),
    )
    none = F.array().cast("array<string>")
    return top.withColumn(
        "wholeRequired",
        F.when(quiet, F.transform(good, lambda e: e["f"])).otherwise(none),
    )


def combine(rows: DataFrame) -> DataFrame:
    """Set algebra over a request: rule preferences and clause decisions to final lists.

    `rows`: prefs, required, preferred, excluded, positive (arrays over all clauses) and
    wholeRequired.
    """
    prefs = F.col("prefs")
    names = F.array(*[F.lit(name) for name in V.INTENT_FEATURES])
    required = F.array_union(
        F.array_union(F.array_intersect(prefs["requiredFeatures"], names), F.col("required")),
        F.col("wholeRequired"),
    )
    positive = F.array_union("positive", "wholeRequired")
    excluded = F.array_union(prefs["excludedFeatures"], F.col("excluded"))
    dropped = F.array_except("excluded", positive)
    clashes = F.array_union(prefs["contradictions"], F.array_intersect(positive, excluded))
    # Features outside the intent vocabulary keep what the rules said.
    untouched = F.array_except(prefs["requiredFeatures"], names)
    final = F.array_except(F.array_except(required, dropped), clashes)
    return rows.select(
        *[c for c in rows.columns if c not in ("required", "preferred", "excluded", "positive", "wholeRequired")],
        F.array_sort(F.array_union(final, untouched)).alias("requiredFeatures"),
        F.array_sort(F.array_union(prefs["preferredFeatures"], F.col("preferred"))).alias(
            "preferredFeatures"
        ),
        F.array_sort(excluded).alias("excludedFeatures"),
        F.array_sort(clashes).alias("contradictions"),
    )


def merge_labels(rows: DataFrame, query: str = "query") -> DataFrame:
    """Rule preferences plus labels a model supplied, under anchor and negation guards.

    `rows`: prefs and modelRequired, modelPreferred, modelExcluded, modelContradictions.
    """
    text, prefs = F.col(query), F.col("prefs")
    names = F.array(*[F.lit(name) for name in V.INTENT_FEATURES])
    none = F.array().cast("array<string>")
    staged = rows.withColumn("_anchored", R.anchored_features(text))
    anchored = F.col("_anchored")
    says_no = F.rlike(text, F.lit(V.MODEL_NEGATIVE))
    contrast = F.rlike(text, F.lit(V.MODEL_CONTRAST))
    access = F.rlike(text, F.lit(V.POSITIVE_ACCESS))
    soft = R.is_soft_clause(text)
    rest = F.regexp_replace(text, f"^(.*?)(?:{V.POSITIVE_ACCESS})", "$1")
    rest_says_no = F.rlike(rest, F.lit(V.MODEL_NEGATIVE))
    unsafe = says_no & ~contrast & ~access

    def model(column: str) -> Column:
        return F.array_intersect(F.col(column), anchored)

    asked = F.when(unsafe, none).otherwise(model("modelRequired"))
    liked = F.when(unsafe, none).otherwise(model("modelPreferred"))
    required = F.array_union(F.array_intersect(prefs["requiredFeatures"], names), asked)
    preferred = F.array_union(prefs["preferredFeatures"], liked)
    hard = F.when(soft, required).otherwise(F.array_union(required, preferred))
    kept = F.when(soft, preferred).otherwise(none)
    refused = F.when(says_no & ~(access & ~rest_says_no), model("modelExcluded")).otherwise(none)
    global_no = F.rlike(text, F.lit(V.GLOBAL_NEGATIVE)) & ~contrast & ~access
    staged = (
        staged.withColumn("_hard", F.when(global_no, F.array_except(hard, anchored)).otherwise(hard))
        .withColumn("_kept", kept)
        .withColumn(
            "_out",
            F.array_union(
                F.array_union(prefs["excludedFeatures"], refused),
                F.when(global_no, anchored).otherwise(none),
            ),
        )
    )
    clashes = F.array_union(
        F.array_union(
            prefs["contradictions"],
            F.when(says_no, model("modelContradictions")).otherwise(none),
        ),
        F.array_intersect("_hard", "_out"),
    )
    staged = staged.withColumn("_clash", clashes)
    final = F.array_except("_hard", "_clash")
    remaining = F.array_except(F.array_except(F.array_except("_kept", "_out"), final), F.col("_clash"))
    untouched = F.array_except(prefs["requiredFeatures"], names)
    intents = F.array_intersect(F.array_union(final, untouched), F.array_union(names, untouched))
    return staged.select(
        *rows.columns,
        F.array_sort(intents).alias("requiredFeatures"),
        F.array_sort(remaining).alias("preferredFeatures"),
        F.array_sort("_out").alias("excludedFeatures"),
        F.array_sort("_clash").alias("contradictions"),
    )
