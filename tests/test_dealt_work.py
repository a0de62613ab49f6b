"""Few keys with many rows: their work goes to all tasks, and what all rows of a key share is made once."""

from pyspark.sql import functions as F

from taproom.catalog.base import Tables
from taproom.operators import evidence, filters
from taproom.plans import recommend

SMALL = "/root/testdata/sf0.001"
TEXTS = ["pub in Camden with food"] * 30 + ["quiet pub with no sports"] * 3


def asked(spark, texts=TEXTS):
    return spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "requestId bigint, query string")


def tasks_with_rows(frame):
    return frame.select(F.spark_partition_id().alias("p")).distinct().count()


def test_only_candidates_with_passages_are_written(spark, monkeypatch):
    t = Tables(spark, SMALL)
    chunks = t.chunks().where("venueId IN ('v-1', 'v-2', 'v-3', 'v-4')")
    parsed = recommend.parse(asked(spark))
    everything = recommend.ranking_table(parsed, t.venues()).groupBy("requestId").agg(F.bool_or(F.col("score") > 0).alias("any"))
    written, cut = [], recommend.cut
    monkeypatch.setattr(recommend, "cut", lambda frame: written.append(cut(frame)) or written[-1])
    kept = recommend.ranking_table(parsed, t.venues(), chunks)
    assert all(frame.count() <= 4 * 2 for frame in written)
    full = recommend.ranking_table(parsed, t.venues()).where("venueId IN ('v-1', 'v-2', 'v-3', 'v-4')")
    assert sorted(kept.collect()) == sorted(full.collect()) and kept.count() > 0
    assert kept.join(everything, "requestId").where("anyScore <> any").count() == 0


def test_words_that_none_asks_for_are_not_shuffled(spark):
    requests = spark.createDataFrame([(1, ["beer"])], "requestId long, queryTokens array<string>")
    chunks = spark.createDataFrame([("c1", ["beer", "garden"]), ("c2", ["dogs"])], "chunkId string, tokens array<string>")
    words = evidence._asked_words(chunks, requests)
    assert "BroadcastHashJoin" in words._jdf.queryExecution().sparkPlan().toString()
    assert [(r.chunkId, r.tokens) for r in words.collect()] == [("c1", ["beer"])]


def test_venues_of_one_partition_are_paired_by_all_tasks(spark):
    venues = Tables(spark, SMALL).venues().coalesce(1)
    parsed = recommend.parse(asked(spark))
    assert tasks_with_rows(filters.candidates(parsed.select("requestId", "prefs"), venues)) > 1


def test_one_set_of_preferences_goes_to_its_requests_in_all_tasks(spark):
    keyed, distinct = recommend.distinct_preferences(recommend.parse(asked(spark, TEXTS[:30])))
    rows = distinct.select(recommend.PREFS_KEY, F.explode(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda n: n.cast("string"))).alias("venueId"))
    pairs = recommend.per_request(rows.coalesce(1), keyed.select(recommend.PREFS_KEY, "requestId"))
    assert pairs.count() == 30 * 60 == pairs.select("requestId", "venueId").distinct().count()
    assert tasks_with_rows(pairs) > 1


def test_what_is_told_is_made_once_for_equal_preferences(spark):
    rows = recommend.rank(asked(spark), Tables(spark, SMALL).venues(), told=F.rand())
    each = rows.groupBy("venueId", "prefs.location").agg(F.count("*").alias("n"), F.countDistinct("told").alias("made")).collect()
    assert each and all(r.made == 1 for r in each) and {r.n for r in each} == {3, 30}


def test_equal_texts_are_matched_once(spark, monkeypatch, tmp_path):
    from taproom.sources import postings

    requests = asked(spark, ["beer garden"] * 40 + ["dogs"])
    chunks = spark.createDataFrame(
        [(f"c{i}", "v", "Beer in the garden" if i % 2 else "no dogs", ["hasDj"]) for i in range(10)],
        "chunkId string, venueId string, text string, attributes array<string>",
    )
    pairs = requests.select("requestId", F.lit("v").alias("venueId"))
    sizes = []
    for module in (evidence, postings):
        join = module.split_join
        monkeypatch.setattr(
            module, "split_join",
            lambda big, small, keys, join=join, **more: sizes.append((keys, big.count(), small.count())) or join(big, small, keys, **more),
        )
    expected = sorted([(i, f"c{n}") for i in range(40) for n in range(1, 10, 2)] + [(40, f"c{n}") for n in range(0, 10, 2)])
    assert sorted((r.requestId, r.chunkId) for r in evidence.lexical_matches(requests, chunks, pairs).collect()) == expected
    path = str(tmp_path / "store")
    postings.write_store(chunks, path)
    found = postings.lexical_matches(spark, path, requests, pairs)
    assert sorted((r.requestId, r.chunkId, r.matched, r.occurrences) for r in found.collect()) == [
        (i, c, 2 if i < 40 else 1, 2 if i < 40 else 1) for i, c in expected
    ]
    # Words of the two texts meet words of passages; then ten matches meet all requests.
    assert sizes == [(["venueId", "token"], 15, 3), (["_first", "venueId"], 10, 41), (["venueId", "token"], 3, 3), (["_first", "venueId"], 10, 41)]


def test_images_of_one_class_are_measured_by_all_tasks(spark):
    from taproom.catalog import windows

    t = Tables(spark, SMALL)
    found = windows.images(t)
    assert tasks_with_rows(found) > 1
    venue, part = windows.image_sides(t)
    assert found.count() == venue.join(part, "k").count() > 0


def test_equal_requests_of_a_class_are_scored_once(spark, monkeypatch):
    from taproom.catalog import evidence as queries

    t = Tables(spark, SMALL)
    same = spark.createDataFrame([(1 + 100 * i, "quiet beer garden", [1.0] * 4) for i in range(20)], "requestId bigint, query string, vector array<double>")
    held = spark.createDataFrame([("c1", 1, "beer", [1.0] * 4), ("c2", 1, "dogs", [0.0] * 4), ("c3", 2, "beer", [1.0] * 4)], "chunkId string, n long, text string, vector array<double>")
    monkeypatch.setattr(t, "requests", lambda: same, raising=False)
    monkeypatch.setattr(t, "chunks", lambda: held, raising=False)
    pairs, scores = [], evidence.direct_scores
    monkeypatch.setattr(evidence, "direct_scores", lambda rows: pairs.append(rows.count()) or scores(rows))
    rows = queries.side_by_side(t).collect()
    assert pairs == [2]
    assert sorted((r.requestId, r.chunkId, round(r.dense, 6)) for r in rows) == sorted(
        (1 + 100 * i, c, d) for i in range(20) for c, d in (("c1", 1.0), ("c2", 0.0))
    )
