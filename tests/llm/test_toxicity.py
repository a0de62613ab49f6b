import numpy as np
from pyspark.sql import functions as F

from taproom.llm import toxicity as T

DOCS = "doc_id long, text string, grade string, above int"


def test_fit_finds_weights_and_ordered_thresholds():
    draw = np.random.default_rng(1)
    n, d = 4000, 6
    x = (draw.random((n, d)) < 0.4).astype(float)
    w, t = np.array([2.0, -1.0, 0.0, 1.5, 0.5, -2.0]), np.array([0.5, 2.0])
    z = x @ w + draw.logistic(size=n)
    grades = (z[:, None] > t[None, :]).sum(axis=1)
    r, c = np.nonzero(x)
    got, limits = T.ordinal_fit(r, c, x[r, c], grades, d, l2=0.01)
    assert np.abs(got - w).max() < 0.35 and np.abs(limits - t).max() < 0.35 and limits[0] < limits[1]

    def loss(weights, limits):
        p = np.c_[np.ones(n), 1 / (1 + np.exp(-(x @ weights)[:, None] + limits)), np.zeros(n)]
        return -np.log(p[np.arange(n), grades] - p[np.arange(n), grades + 1]).mean()

    # A stationary point: no small step in any direction is better.
    for k in range(d):
        for e in (-0.05, 0.05):
            assert loss(got, limits) < loss(got + e * np.eye(d)[k], limits) + 2e-4


def tables(spark):
    rows, marks = [], []
    for i in range(300):
        bad = i % 3 == 0
        rows.append((i, f"plain words number{i % 7} " + ("grimbly" + "abcdefg"[i % 7] * 3 + " rude" if bad else "nice day") + " end", "x", 1))
        marks.append((i, 2 if i % 6 == 0 else 1 if bad else 0))
    rows += [(900, None, "x", 1), (901, "", "x", 1), (902, "rude " * 20000, "x", 1), (None, "rude grimblyzzz", "x", 1), (903, "grimblyqqq", "x", 1), (903, "grimblyqqq", "x", 1)]
    marks += [(0, 0), (None, 2), (5, None), (7777, 2)]
    return spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(marks, "doc_id long, grade int")


def test_catches_marked_words_and_defines_every_case(spark):
    docs, marks = tables(spark)
    got = T.score(docs, T.fit(docs, marks)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 306
    assert all((by[i].grade > 0) == (i % 3 == 0) for i in range(300))
    assert all(abs(r.severity - sum(r.above)) < 1e-9 and r.above == sorted(r.above, reverse=True) for r in got)
    assert by[900].grade == by[901].grade == 0 and by[902].grade > 0 and by[903].grade > 0 and by[None].grade > 0
    # Rows that are not in the bounded sample are scored all the same.
    assert len(T.score(docs, T.fit(docs, marks, max_rows=50)).collect()) == 306


def test_no_labels_one_label_and_empty_tables(spark):
    docs, marks = tables(spark)
    assert T.fit(docs, marks.limit(0)) is None
    assert {r.severity for r in T.score(docs, None).collect()} == {None}
    same = T.fit(docs, marks.withColumn("grade", F.lit(0)))
    assert {(r.severity, r.grade) for r in T.score(docs, same).collect()} == {(0.0, 0)}
    assert T.score(docs.limit(0), T.fit(docs, marks)).count() == 0


def test_given_labels(spark):
    got = T.op1(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("toxic").alias("truth"))
    rows = got.join(labels, "doc_id").collect()
    assert np.mean([r.toxic == (r.truth == 1) for r in rows]) > 0.9
    assert np.mean([r.truth == 1 for r in rows if r.toxic]) > 0.85
