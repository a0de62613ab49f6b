"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

P(grade > k) = sigma(w.x - t_k): one weight vector for all grades and ascending thresholds t. Features are
the words of a text and the beginnings of its longer words, each as 1 + log(count); those that go with
the grade by the likelihood ratio are kept. The model is fitted on a bounded sample of labelled rows.
Where labels only tell toxic from not, the severity of the toxic rows is graded by how much of what goes
with the label their texts hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taproom.llm.common import stored, table

MAX_ROWS = 12_000  # labelled documents the model is fitted on, by the hash of their id
MAX_FEATURES = 4_000
LEAST_RATIO = 12.0  # likelihood ratio a feature must reach
BEGINNINGS = (4, 5, 6, 7, 8)


def word_features(word: str, beginnings=BEGINNINGS) -> list[str]:
    """The word itself and, marked, each beginning that is shorter than the word."""
    return [word, *(word[:k] + "+" for k in beginnings if k < len(word))]


def words_of(text: str) -> list[str]:
    import re

    return re.findall(r"[^\W\d_]+", text.lower())


def _presence(beginnings):
    features, words = word_features, words_of

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        counts = Counter()

        def flush():
            rows = list(counts.items())
            return pa.RecordBatch.from_pydict(
                {
                    "feature": pa.array([k[0] for k, _ in rows], pa.string()),
                    "marked": pa.array([k[1] for k, _ in rows], pa.bool_()),
                    "n": pa.array([n for _, n in rows], pa.int64()),
                }
            )

        for batch in batches:
            for text, grade in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                mine = {f for w in set(words(text or "")) for f in features(w, beginnings)}
                counts.update((f, grade > 0) for f in mine)
            if len(counts) > 300_000:
                yield flush()
                counts.clear()
        if counts:
            yield flush()

    return run


def _rows(numbers: dict[str, int], beginnings):
    """Per text the numbers and values of the model's features."""
    features, words = word_features, words_of
    words_kept = 200_000

    def vectors(texts):
        import math
        from collections import Counter

        seen = {}
        for text in texts:
            counts = Counter()
            for word, n in Counter(words(text or "")).items():
                found = seen.get(word)
                if found is None:
                    found = [numbers[f] for f in features(word, beginnings) if f in numbers]
                    if len(seen) > words_kept:
                        seen.clear()
                    seen[word] = found
                for f in found:
                    counts[f] += n
            yield {f: 1 + math.log(n) for f, n in counts.items()}

    return vectors


def _vectors(numbers, beginnings):
    vectors = _rows(numbers, beginnings)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = list(vectors(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([list(v) for v in got], pa.list_(pa.int32())),
                    pa.array([list(v.values()) for v in got], pa.list_(pa.float64())),
                    batch.column(2),
                ],
                ["features", "amounts", "grade"],
            )

    return run


def ordinal_fit(rows, columns, amounts, grades, n_features: int, l2: float = 0.3, steps: int = 400, rate: float = 0.05):
    """Weights and ascending thresholds of the cumulative-link model, by full-batch Adam.

    Entry i of the sparse matrix is amounts[i] at (rows[i], columns[i]); grades are 0..K.
    """
    import numpy as np

    top, n = int(grades.max()), len(grades)
    above = np.array([(grades > k).mean() for k in range(top)])
    start = np.log((1 - above + 1e-4) / (above + 1e-4))
    # t_0, then the logarithms of the steps between thresholds, so that they ascend.
    free = np.r_[np.zeros(n_features), start[:1], np.log(np.maximum(np.diff(start), 1e-2))]
    first, second = np.zeros_like(free), np.zeros_like(free)

    def sigma(x):
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    for step in range(1, steps + 1):
        weights, gaps = free[:n_features], np.exp(free[n_features + 1 :])
        limits = free[n_features] + np.r_[0, np.cumsum(gaps)]
        score = np.bincount(rows, amounts * weights[columns], minlength=n)
        # a and b: the score against the limits below and above the grade; without one they are sure.
        a = score - np.where(grades > 0, limits[np.maximum(grades - 1, 0)], 0)
        b = score - np.where(grades < top, limits[np.minimum(grades, top - 1)], 0)
        lowest, highest = grades == 0, grades == top
        up, not_up = np.where(lowest, 1, sigma(a)), np.where(lowest, 0, sigma(-a))
        over, not_over = np.where(highest, 0, sigma(b)), np.where(highest, 1, sigma(-b))
        inner = ~lowest & ~highest
        width = np.where(inner, -np.expm1(-np.maximum(np.where(inner, a - b, 1), 1e-9)), 1)
        # Derivatives of the log of up - over, which stay exact where both are close to 0 or 1.
        d_score = up + over - 1
        d_upper, d_lower = not_up / (not_over * width), over / (up * width)
        d_limit = (
            np.bincount(grades, d_upper, minlength=top + 2)[1 : top + 1]
            - np.bincount(grades + 1, d_lower, minlength=top + 2)[1 : top + 1]
        )
        grad = np.empty_like(free)
        grad[:n_features] = np.bincount(columns, amounts * d_score[rows], minlength=n_features) + l2 * weights
        grad[n_features] = d_limit.sum()
        grad[n_features + 1 :] = gaps * np.cumsum(d_limit[::-1])[::-1][1:]
        grad /= n
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        free = free - pace * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return free[:n_features], free[n_features] + np.r_[0, np.cumsum(np.exp(free[n_features + 1 :]))]


def fit(
    docs: DataFrame,
    grades: DataFrame,
    max_rows: int = MAX_ROWS,
    max_features: int = MAX_FEATURES,
    least_ratio: float = LEAST_RATIO,
    beginnings: tuple[int, ...] = BEGINNINGS,
    levels: int = 1,
) -> dict | None:
    """Fit on documents with a grade: {numbers, weights, thresholds, beginnings}; None without any.

    `grades` has doc_id and grade (whole numbers from 0); null grades and ids are left out, of several
    grades of one document the highest counts. At most `max_rows` graded ids are used, by the hash of the
    id; the table of them is broadcast, its size is bounded by that. With `levels` over one, rows above
    grade zero are graded anew, from 1 to `levels`, by equal parts of what marks them in their texts.
    """
    import numpy as np

    graded = grades.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade"))
    graded = graded.dropna().groupBy("doc_id").agg(F.max("grade").alias("grade"))
    sample = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(texts.join(F.broadcast(sample), "doc_id"), "graded")
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col("grade") > 0).count().collect()}
    if not sizes:
        return None
    counts = rows.mapInArrow(_presence(beginnings), "feature string, marked boolean, n long")
    counts = counts.groupBy("feature").agg(
        F.sum(F.when(F.col("marked"), F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(~F.col("marked"), F.col("n")).otherwise(0)).alias("b"),
    )
    one, none = float(sizes.get(True, 0)), float(sizes.get(False, 0))
    both = one + none

    def part(seen, size, among):
        return F.when(seen > 0, 2 * seen * F.log(seen * both / (size * among))).otherwise(0.0)

    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    with_, without = a + b, F.lit(both) - a - b
    if one and none:
        ratio = part(a, F.lit(one), with_) + part(b, F.lit(none), with_) + part(one - a, F.lit(one), without) + part(none - b, F.lit(none), without)
    else:
        ratio = F.lit(0.0)
    kept = counts.where(F.col("a") + F.col("b") >= 5).withColumn("ratio", F.round(ratio, 9)).where(F.col("ratio") >= least_ratio)
    kept = kept.withColumn("marks", F.col("a") * none > F.col("b") * one)
    kept = kept.orderBy(F.desc("ratio"), "feature").limit(max_features).select("feature", "marks").collect()
    names, marking = [r["feature"] for r in kept], np.array([r["marks"] for r in kept], bool)
    numbers = {f: i for i, f in enumerate(names)}
    got = rows.mapInArrow(_vectors(numbers, beginnings), "features array<int>, amounts array<double>, grade int").collect()
    marks = np.array([r["grade"] for r in got])
    if marks.max() == 0:
        return {"numbers": {}, "weights": np.zeros(0), "thresholds": np.zeros(0), "beginnings": beginnings}
    row = np.repeat(np.arange(len(got)), [len(r["features"]) for r in got])
    column = np.array([f for r in got for f in r["features"]], np.int64)
    amount = np.array([x for r in got for x in r["amounts"]], float)
    if levels > 1:
        held = np.bincount(row, amount * marking[column], minlength=len(got))
        some = held[(marks > 0) & (held > 0)]
        edges = np.quantile(some, np.arange(1, levels) / levels) if len(some) else np.zeros(0)
        marks = np.where(marks > 0, 1 + np.searchsorted(edges, held), 0)
    weights, thresholds = ordinal_fit(row, column, amount, marks, len(names))
    return {"numbers": numbers, "weights": weights, "thresholds": thresholds, "beginnings": beginnings}


def _score(shared):
    rows = _rows

    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = shared.value
        weights, limits = model["weights"], model["thresholds"]
        vectors = rows(model["numbers"], model["beginnings"])
        for batch in batches:
            scores = np.array([sum(weights[f] * x for f, x in v.items()) for v in vectors(batch.column(1).to_pylist())], float)
            above = 1 / (1 + np.exp(-np.clip(scores[:, None] - limits[None, :], -40, 40)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(above.sum(axis=1)),
                    pa.array(above.tolist(), pa.list_(pa.float64())),
                    pa.array((above >= 0.5).sum(axis=1).astype(np.int32)),
                ],
                ["doc_id", "severity", "above", "grade"],
            )

    return run


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, severity (expected grade), above (P(grade > k) for each k) and grade of every row.

    Null and empty texts have no feature and get the model's base rate. Without a model all but the id
    is null. Repeated rows are all scored; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    if model is None:
        return rows.selectExpr(
            "doc_id", "cast(null as double) severity", "cast(null as array<double>) above", "cast(null as int) grade"
        )
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_score(shared), "doc_id long, severity double, above array<double>, grade int")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents graded 0 (not toxic), 1 (toxic) or 2 (severely), from the toxic mark of `labels`."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, fit(docs, labels.select("doc_id", F.col("toxic").alias("grade")), levels=2)).select(
        "doc_id", "severity", F.coalesce(F.get("above", F.lit(0)), F.lit(0.0)).alias("p_toxic"), "grade", (F.col("grade") > 0).alias("toxic")
    )
