"""Queries whose pairs are far more than their rows: what is formed, copied and written on the way to them."""

import pytest
from pyspark.sql import functions as F

from taproom.catalog import windows
from taproom.catalog.base import Tables
from taproom.operators import evaluation, evidence, filters, skew
from taproom.plans import recommend

FACTS = "requestId bigint, required array<string>, excluded array<string>, topK int"
PASSAGE = "chunkId string, venueId string, text string, source string, sourceUrl string, attributes array<string>, vector array<double>"


@pytest.fixture
def small(spark):
    return Tables(spark, "/root/testdata/sf0.001")


def rows_of(frame, *names):
    return sorted(tuple(row[name] for name in names) for row in frame.collect())


def test_truth_is_not_formed_a_case(spark, small, monkeypatch):
    venues = small.venues()
    cases = spark.createDataFrame([(n, ["servesFood"], [], 2) for n in range(40)], FACTS)
    requests = cases.select("requestId", F.lit("pub with food").alias("query"), F.array(F.lit(1.0), F.lit(0.5)).alias("vector"))
    chunks = spark.createDataFrame(
        [(f"c{v}{n}", f"v-{v}", "Food here", "site", None, ["servesFood"], [1.0, float(n)]) for v in (1, 2, 3) for n in range(3)], PASSAGE
    )
    written = []
    for name in ("cut", "sized"):
        keep = getattr(recommend, name)
        monkeypatch.setattr(recommend, name, lambda frame, keep=keep: written.append(keep(frame)) or written[-1])
    per_case, _ = recommend.evaluate(cases, requests, venues, chunks)
    found = per_case.collect()
    served = [row.venueId for row in venues.where("servesFood").select("venueId").collect()]
    shown = min(2, len({"v-1", "v-2", "v-3"} & set(served)))
    assert len(served) > 20 and len(found) == 40
    assert all(round(row.recall, 9) == round(shown / len(served), 9) for row in found)
    assert max(frame.count() for frame in written) < 40 * len(served)


def test_reference_scores_against_whole_sets(spark):
    chunk = "chunkId string, venueId string, text string, attributes array<string>"
    chunks = spark.createDataFrame(
        [("c1", "v1", "Food", ["a"]), ("c2", "v1", "none", ["b"]), ("c3", "v2", "a quiz", ["a"]), ("both", "v1", "x", ["a"]), ("both", "v2", "x", ["a"])],
        chunk,
    )
    wanted = spark.createDataFrame(
        [(1, "v1", ["a"], []), (1, "v2", ["a"], []), (2, "v1", [], [["food"]]), (2, "v2", [], [["food"]]), (3, "v1", ["a"], []), (3, "v1", ["b"], [])],
        "requestId bigint, venueId string, targetAttributes array<string>, termGroups array<array<string>>",
    )
    got = spark.createDataFrame([(1, "c1"), (1, "c2"), (1, "both"), (2, "c3"), (3, "c2"), (4, "c1")], "requestId bigint, chunkId string")
    cases = spark.createDataFrame([(n,) for n in range(1, 5)], "requestId bigint")
    whole = evaluation.context_scores(got, evaluation.reference_chunks(chunks, wanted, "requestId"), cases, "requestId", "chunkId")
    names = ("requestId", "contextPrecision", "contextRecall")
    few = evaluation.reference_scores(got, chunks, wanted, cases, "requestId")
    assert {tuple(r[n] for n in names) for r in few.collect()} == {tuple(r[n] for n in names) for r in whole.collect()}


def test_references_meet_their_cases_last(spark, small, monkeypatch):
    cases = spark.createDataFrame([(n, ["servesFood"], [], 2) for n in range(40)] + [(0, ["hasDj"], [], 2)], FACTS)
    none = F.array().cast("array<array<string>>")
    targets = cases.select("requestId", F.array_union("required", "excluded").alias("targetAttributes"), none.alias("termGroups"))
    chunks = small.chunks()
    wanted = recommend.relevant_venues(cases, recommend.with_passages(small.venues(), chunks)).join(targets, "requestId")
    every = rows_of(evaluation.reference_chunks(chunks, wanted, "requestId"), "requestId", "chunkId")
    asked = []
    find = evaluation.reference_chunks
    monkeypatch.setattr(evaluation, "reference_chunks", lambda held, met, *key: asked.append(met) or find(held, met, *key))
    assert rows_of(recommend.case_references(cases, targets, small.venues(), chunks), "requestId", "chunkId") == every
    assert len(every) > 40 and asked[0].count() < wanted.count() / 5


def test_joins_of_lists_make_every_pair_once(spark):
    many = spark.createDataFrame([(k, f"m{n}") for k in (1, 2, None) for n in range(30)] + [(1, "m0"), (2, None)], "k int, m string")
    few = spark.createDataFrame([(1, n, "a") for n in range(1500)] + [(2, None, None), (2, 5, "b"), (2, 5, "b"), (3, 1, "c")], "k int, f int, g string")
    for right in (few, few.drop("g")):
        expected = many.join(right, "k").groupBy(*right.columns, "m").count()
        names = [*right.columns, "m", "count"]
        for found in (skew.packed_join(many, right, ["k"], "m"), skew.pairs_join(many, right, ["k"], piece_pairs=500)):
            got = found.groupBy(*right.columns, "m").count()
            assert got.select(names).exceptAll(expected.select(names)).isEmpty() and expected.select(names).exceptAll(got.select(names)).isEmpty()
    found = skew.grid_join(many, few.withColumnRenamed("g", "h"), ["k"], "m", "f")
    assert found.count() == many.join(few, "k").count()


def test_requests_are_copied_in_lists(spark, small, monkeypatch):
    joined = []
    unpack = skew._unpacked
    monkeypatch.setattr(skew, "_unpacked", lambda rows, columns, rest: joined.append(rows) or unpack(rows, columns, rest))
    asked = spark.createDataFrame([(n, "pub in Camden with food") for n in range(500)], "requestId bigint, query string")
    pairs = recommend.candidate_pairs(recommend.parse(asked), small.venues())
    assert joined[0].count() * 500 == pairs.count() > 0


def test_one_needle_and_one_area_go_to_many_tasks(spark, monkeypatch):
    needles = spark.createDataFrame([(n, "ale", None) for n in range(60)] + [(n, "xyz", "Camden") for n in range(60, 120)], "r int, needle string, namedArea string")
    texts = spark.createDataFrame([(n, f"real ale {n}", "camden") for n in range(80)], "id int, hay string, area string")
    monkeypatch.setattr(skew.pairs_join, "__defaults__", (None, 300))
    found = filters.search_or_area(texts, needles, "hay", "area")
    assert rows_of(found, "r", "id") == [(r, i) for r in range(120) for i in range(80)]
    for low, high in ((0, 60), (60, 120)):
        part = found.where((F.col("r") >= low) & (F.col("r") < high))
        assert part.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_name_scores_are_compiled_with_the_pairs(spark, small):
    names = [(["blue", "ring", "blue"], "the blue one"), (["ox"], None), ([], "x"), (None, "x"), (["ale", "pub"], "pubs and ales")]
    rows = spark.createDataFrame(names, "words array<string>, plain string")
    one, two = (windows.name_score(F.col("words"), F.col("plain"), most) for most in (None, 3))
    both = rows.select(one.alias("a"), two.alias("b")).collect()
    assert [r.a for r in both] == [r.b for r in both] == [2 / 3, 0.0, 0.0, None, 1.0]
    plan = windows.image_scores(small)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan[: plan.index("SortMergeJoin")] if "SortMergeJoin" in plan else "lambda" not in plan.split("Join")[0]


def test_images_and_venues_are_copied_to_a_side_of_the_square(spark, small):
    venue, part = windows.image_sides(small)
    found = skew.grid_join(venue, part, ["k"], "venueId", "p_partkey")
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "sequence(0, 3" in plan and found.count() == venue.join(part, "k").count() > 0


def test_lengths_of_vectors_are_made_once_a_row(spark):
    rows = spark.createDataFrame([(["a"], [3.0, 4.0], ["a", "b"], [4.0, 3.0])], "queryTokens array<string>, queryVector array<double>, tokens array<string>, vector array<double>")
    plain = evidence.direct_scores(rows).select("dense", "lexical", "hybrid").first()
    given = rows.withColumns({"queryNorm": F.lit(10.0), "norm": F.lit(5.0)})
    assert (plain.dense, plain.lexical) == (0.96, 1.0)
    assert evidence.direct_scores(given).first().dense == 0.48


def test_factors_are_spread_before_their_requests(spark, small, monkeypatch):
    from taproom.catalog import evidence as queries

    made = []
    unpack = skew._unpacked
    monkeypatch.setattr(skew, "_unpacked", lambda rows, columns, rest: made.append(rows) or unpack(rows, columns, rest))
    found = queries.score_breakdown(small)
    assert "factor" in made[0].columns and "scoreBreakdown" not in made[0].columns
    assert made[0].select(F.sum(F.size("_rows"))).first()[0] == found.count() > 0
