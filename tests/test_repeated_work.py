"""Work that grows with the distinct things asked, not with the rows that ask them."""

from pyspark.sql import functions as F

from taproom.catalog import evidence as queries
from taproom.catalog import joins, windows
from taproom.catalog.base import Tables
from taproom.functions.text import one_decimal
from taproom.operators import evidence, filters, ranking

SMALL = "/root/testdata/sf0.001"
best = ranking.best_similar


def test_equal_requests_are_scored_once(spark, monkeypatch):
    kernel = evidence._top_of_block

    def strict(limit, weight):
        score = kernel(limit, weight)

        def once(asked, held):
            if asked.num_rows > 2:
                raise ValueError("equal requests in one block")
            return score(asked, held)

        return once

    monkeypatch.setattr(evidence, "_top_of_block", strict)
    asked = [(n, ["beer"] if n % 2 else [], [1.0, 0.0], ["servesFood"]) for n in range(40)]
    chunks = [("c1", "v", ["beer", "garden"], [1.0, 0.0], ["hasDj"]), ("c2", "v", ["dogs"], [0.0, 1.0], ["servesFood"])]
    top = evidence.top_evidence(
        spark.createDataFrame([(n, v) for n in range(40) for v in ("v", "none")], "requestId long, venueId string"),
        spark.createDataFrame(asked, "requestId long, queryTokens array<string>, queryVector array<double>, wanted array<string>"),
        spark.createDataFrame(chunks, "chunkId string, venueId string, tokens array<string>, vector array<double>, attributes array<string>"),
    )
    got = sorted((r.requestId, r.venueId, r.chunkId, round(r.hybrid, 6), r.matched, r.displayed) for r in top.collect())
    assert got == [
        row for n in range(40)
        for row in ((n, "v", "c1", 1.0 if n % 2 else 0.9, ["beer"] if n % 2 else [], False), (n, "v", "c2", 0.0, [], True))
    ]


def test_a_user_and_venue_are_compared_once(spark, monkeypatch):
    sizes = []
    join = ranking.split_join

    def counted(big, small, keys):
        sizes.append(big.count())
        return join(big, small, keys)

    monkeypatch.setattr(ranking, "split_join", counted)
    t = Tables(spark, SMALL)
    venues = t.fx("venue").limit(3)
    ranked = spark.range(50).select(F.col("id").alias("requestId"), (F.col("id") % 2).alias("userId")).join(venues.select("venueId"))
    ratings = venues.select(F.lit(1).alias("userId"), "venueId", F.lit(5.0).alias("rating"), F.col("n").alias("pos"))
    rows = best(ranked, ratings, venues).collect()
    assert sizes == [6]
    assert {(r.requestId % 2, r.bestLiked.rating) for r in rows} == {(1, 5.0)} and len(rows) == 75


def test_similar_rated_venues_form_users_not_requests(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(joins.ranking, "best_similar", lambda ranked, *rest: seen.append(ranked.count()) or best(ranked, *rest))
    t = Tables(spark, SMALL)
    requests = t.fx("request").select("requestId", "userId")
    # Ten more rounds of requests by the same users.
    more = requests.crossJoin(spark.range(10)).select((F.col("requestId") + F.col("id") * 300).alias("requestId"), "userId")
    old = Tables.fx
    monkeypatch.setattr(Tables, "fx", lambda self, name: more if name == "request" else old(self, name))
    got = joins.similar_rated(t).count()
    few = seen.pop()
    monkeypatch.setattr(Tables, "fx", old)
    assert got == 10 * joins.similar_rated(t).count() and few == seen.pop()


def test_image_names_are_normalised_before_the_join(spark):
    t = Tables(spark, SMALL)
    for build in (windows.image_scores, windows.image_pick):
        plan = build(t)._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_replace" not in plan[: plan.index("Join Inner")]


def test_one_decimal_as_python_writes_it(spark):
    values = [n / 20 for n in range(0, 101)] + [0.04999999999999999, 4.949999999999999, -0.15, -0.04, 2.675, 123456.75, 1e15]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", one_decimal(F.col("x")).alias("t")).collect()
    assert [r.t for r in rows] == [f"{r.x:.1f}" for r in rows]


def test_only_venues_with_passages_are_paired(spark, monkeypatch):
    few = Tables(spark, SMALL).chunks().where("venueId IN ('v-1', 'v-2')")
    seen = []
    pairs = filters.candidates
    monkeypatch.setattr(Tables, "chunks", lambda self: few)
    monkeypatch.setattr(filters, "candidates", lambda asked, venues, *rest: seen.append(venues.count()) or pairs(asked, venues, *rest))
    t = Tables(spark, SMALL)
    for build in (queries.evidence_inputs, queries.lexical_matches, queries.evidence_store, queries.reference_chunks):
        build(t)
        assert seen.pop() == 2 and not seen


def test_a_venue_is_explained_once_for_equal_preferences(spark, monkeypatch):
    from taproom.catalog.base import Tables
    from taproom.operators import ranking
    from taproom.plans import recommend

    venues = Tables(spark, "/root/testdata/sf0.001").venues()
    texts = ["pub in Camden with food"] * 5 + ["quiet pub with no sports"]
    asked = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "requestId bigint, query string")
    page = recommend.recommend(asked, venues, limit=2)
    scored = []
    with_score = ranking.with_score
    monkeypatch.setattr(ranking, "with_score", lambda rows: scored.append(rows) or with_score(rows))
    rows = recommend.explained(page, asked, venues).select("requestId", "venueId", "finalScore", "score", "reasons").collect()
    assert scored[-1].count() == 4 and len(rows) == 12
    assert all(row.finalScore == row.score for row in rows)
    said = {}
    for row in rows:
        said.setdefault((texts[row.requestId], row.venueId), []).append(row.reasons)
    assert sorted(len(reasons) for reasons in said.values()) == [1, 1, 5, 5]
    assert all(reasons == reasons[:1] * len(reasons) for reasons in said.values())


def test_truth_is_found_once_a_criterion(spark, monkeypatch):
    from taproom.plans import recommend

    met = []
    candidates = filters.candidates
    monkeypatch.setattr(filters, "candidates", lambda asked, venues: met.append(asked) or candidates(asked, venues))
    venues = Tables(spark, SMALL).venues()
    rows = [(n, ["servesFood"] if n % 2 else [], ["hasDj"] if n % 3 else []) for n in range(30)]
    cases = spark.createDataFrame(rows, "requestId bigint, required array<string>, excluded array<string>")
    found = {(r.requestId, r.venueId) for r in recommend.relevant_venues(cases, venues).collect()}
    assert met[0].count() == 3
    facts = venues.select("venueId", "servesFood", "hasDj").collect()
    assert found == {
        (n, v.venueId) for n, need, avoid in rows for v in facts
        if (need or avoid) and (not need or v.servesFood is True) and (not avoid or v.hasDj is False)
    }


def test_evidence_rows_are_made_once(spark, tmp_path):
    from taproom.sources import tables

    made = spark.sparkContext.accumulator(0)

    def seen(value):
        made.add(1)
        return value is not None

    rows = spark.createDataFrame([(f"c{n}", f"v{n % 3}", f"t{n}") for n in range(40)], "chunkId string, venueId string, text string")
    table = rows.where(F.udf(seen, "boolean")("chunkId"))
    tables.write_evidence(table, str(tmp_path), "f", "m", bucket_rows=15)
    assert made.value == 40
    assert sorted(r.chunkId for r in tables.read_evidence(spark, str(tmp_path), "f").collect()) == sorted(f"c{n}" for n in range(40))
    meta = spark.read.json(f"{tmp_path}/metadata").first()
    assert (meta.chunkCount, meta.venueCount, meta.buckets) == (40, 3, 3)


def test_ids_are_dealt_before_they_are_gathered(spark, capsys):
    ids = spark.createDataFrame([("a",), ("bb",), ("a",)], "chunkId string")
    assert tuple(queries.id_counts(ids).first()) == (3, 2, 2)
    assert tuple(queries.id_counts(ids.limit(0)).first()) == (0, 0, None)
    queries.chunk_ids(Tables(spark, SMALL)).explain()
    plan = capsys.readouterr().out.split("== Physical Plan ==")[1].splitlines()
    gathers = [at for at, line in enumerate(plan) if "Aggregate(keys=[chunkId" in line]
    assert gathers and max(gathers) < next(at for at, line in enumerate(plan) if "REPARTITION_BY_COL" in line)


def test_images_are_picked_by_place_and_by_distinct_names(spark, capsys):
    import random

    draw = random.Random(3)
    names = ["red plate", "hot bolt", "old ring arms", "the gear"]
    parts = [(p, draw.choice(names)) for p in range(1, 9000, 7)]
    venues = []
    for n in range(400):
        p = draw.choice(parts)[0]
        off = lambda: draw.uniform(-0.012, 0.012)
        venues.append((100 * n + p % 100, f"v{n}", f"The {draw.choice(names)}", 51.28 + p % 4200 / 1e4 + off(), -0.51 + p % 8400 / 1e4 + off()))

    class Made:
        def fx(self, name):
            return spark.createDataFrame(venues, "n bigint, venueId string, name string, latitude double, longitude double")

        def table(self, name):
            return spark.createDataFrame(parts, "p_partkey bigint, p_name string")

    want = {}
    for r in windows.images(Made()).collect():
        if r.nameScore >= 0.66 and (r.distance is None or r.distance <= 1000):
            rank = (-r.nameScore, 100000 if r.distance is None else r.distance, r.imageId)
            want[r.venueId] = min(want.get(r.venueId, rank), rank)
    picked = windows.image_pick(Made())
    assert {r.venueId: (r.imageId, r.nameScore) for r in picked.collect()} == {v: (w[2], round(-w[0], 6)) for v, w in want.items()}
    assert any(w[1] < 100000 for w in want.values()) and any(w[1] == 100000 for w in want.values())
    picked.explain()
    assert "cell" in capsys.readouterr().out
