import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from taproom.functions import geo, text
from taproom.operators import filters, identity, matching, quality
from taproom.operators.skew import split_join
from taproom.sources import payloads

A = "fsqPlaceId string, name string, latitude double, longitude double, postcode string, website string, phone string"
B = A.replace("fsqPlaceId", "osmElementId")


def report(spark, a_rows, b_rows):
    return matching.match_sources(
        spark.createDataFrame(a_rows, A), spark.createDataFrame(b_rows, B), "fsqPlaceId", "osmElementId"
    )


def ids(frame, *columns):
    return sorted(tuple(row[c] for c in columns) for row in frame.collect())


PLACE = ("The Green Man", 51.4821, -0.2034, "W6 9QL", "https://www.greenman.example/hammersmith", "+44 20 8111 2233")


def test_links_same_place_with_all_signals(spark):
    out = report(spark, [("a1", *PLACE)], [("node/1", "Green Man", 51.4822, -0.2034, "w69ql", "greenman.example", "020 8111 2233")])
    row = out["accepted"].collect()[0]
    assert row.matchStatus == "definite" and row.aId == "a1"
    assert {"postcode match", "website match", "phone match"} <= set(row.signals)
    assert out["review"].count() == 0


def test_two_records_near_one_link_once(spark):
    out = report(
        spark,
        [("a1", *PLACE), ("a2", "Green Man Pub", *PLACE[1:])],
        [("node/1", "Green Man", 51.4821, -0.2034, "W6 9QL", "greenman.example", "020 8111 2233")],
    )
    assert out["accepted"].count() == 1


def test_distant_pair_stays_unmatched(spark):
    out = report(spark, [("a1", *PLACE)], [("node/1", "Green Man", 51.5017, -0.1834, None, None, None)])
    assert out["accepted"].count() == 0 and out["review"].count() == 0
    assert ids(out["unmatchedA"], "aId") == [("a1",)] and ids(out["unmatchedB"], "bId") == [("node/1",)]


def test_ambiguous_pair_goes_to_review(spark):
    out = report(
        spark, [("a1", "Mitre Tavern", 51.4901, -0.1502, None, None, None)],
        [("node/1", "Mitre Arms", 51.4902, -0.1502, None, None, None)],
    )
    assert out["accepted"].count() == 0
    assert out["review"].collect()[0].matchStatus in {"likely", "review"}


def test_linkable_pairs_lose_nothing_against_all_pairs(spark):
    rng = random.Random(7)
    names = ["Crown", "Crown Arms", "Royal Oak", "Oak", "Red Lion"]

    def place(i):
        return (
            rng.choice(names), 51.5 + rng.random() / 100, -0.1 + rng.random() / 100,
            rng.choice([None, "SE1 7AB", "SE1 7AC"]), rng.choice([None, "https://x.example", "https://y.example/p"]),
            rng.choice([None, "0201112222", "0203334444"]),
        )

    a = spark.createDataFrame([(f"a{i}", *place(i)) for i in range(60)], A)
    b = spark.createDataFrame([(f"b{i}", *place(i)) for i in range(60)], B)
    ka, kb = matching.place_keys(a, "fsqPlaceId", "a"), matching.place_keys(b, "osmElementId", "b")
    some = matching.score_pairs(matching.linkable_pairs(ka, kb)).where("matchStatus <> 'noMatch'")
    every = matching.score_pairs(matching.candidate_pairs(ka, kb)).where("matchStatus <> 'noMatch'")
    assert ids(some, "aId", "bId", "matchScore") == ids(every, "aId", "bId", "matchScore")
    assert some.count() == some.select("aId", "bId").distinct().count()


@pytest.mark.parametrize("seed", [1, 2])
def test_links_in_two_steps_equal_those_of_all_pairs(spark, seed):
    rng = random.Random(seed)

    def side(letter):
        return [
            (
                f"{letter}{i}", rng.choice(["Crown", "The Crown Arms", "Royal Oak", "Oak", "Élite 🍺 Bar", None]),
                51.5 + rng.randrange(40) / 10000, -0.1 + rng.randrange(40) / 10000, rng.choice([None, "SE1 7AB", "SE1 7AC"]),
                rng.choice([None, "", "https://x.example", "https://y.example/p"]), rng.choice([None, "0201112222", "0203334444"]),
            )
            for i in range(50)
        ]

    ka = matching.place_keys(spark.createDataFrame(side("a"), A), "fsqPlaceId", "a")
    kb = matching.place_keys(spark.createDataFrame(side("b"), B), "osmElementId", "b")
    every = matching.resolve(matching.score_pairs(matching.candidate_pairs(ka, kb)))
    for got, wanted in zip(matching.link(ka, kb), every):
        assert ids(got, "aId", "bId", "matchScore") == ids(wanted, "aId", "bId", "matchScore")


def test_crowded_places_meet_only_where_the_threshold_can_be_reached(spark):
    def side(letter, name, phone):
        return [
            (f"{letter}{i}", name, 51.5, -0.1, f"SE{letter == 'a':d} {i % 9}AB", f"https://{letter}{i}.example", f"{phone}{1000000 + i}")
            for i in range(40)
        ]

    a, b = side("a", "The Royal Oak of Bermondsey Village", "0207"), side("b", "Crown", "0208")
    ka = matching.place_keys(spark.createDataFrame(a, A), "fsqPlaceId", "a")
    kb = matching.place_keys(spark.createDataFrame(b, B), "osmElementId", "b")
    assert matching.linkable_pairs(ka, kb).count() == 0
    assert matching.score_pairs(matching.candidate_pairs(ka, kb)).where("matchStatus <> 'noMatch'").count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rounds_equal_greedy(spark, seed):
    rng = random.Random(seed)
    pairs = {(f"a{rng.randrange(15)}", f"b{rng.randrange(15)}"): rng.randrange(5) / 10 + 0.5 for _ in range(70)}
    rows = [(a, b, s) for (a, b), s in pairs.items()]
    taken, used = [], set()
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a not in used and b not in used:
            taken.append((a, b))
            used |= {a, b}
    frame = spark.createDataFrame(rows, "aId string, bId string, matchScore double")
    assert ids(matching.one_to_one(frame), "aId", "bId") == sorted(taken)


def test_decisions_must_cover_the_queue(spark):
    schema = "aId string, bId string, matchScore double"
    review = spark.createDataFrame([("a1", "b1", 0.7), ("a2", "b2", 0.7)], schema)
    accepted = spark.createDataFrame([], schema)
    good = spark.createDataFrame([("a1", "b1", "approve"), ("a2", "b2", "reject")], "aId string, bId string, decision string")
    links, a_out, b_out = matching.apply_decisions(accepted, review, good)
    assert ids(links, "aId", "bId") == [("a1", "b1")] and ids(a_out, "aId") == [("a2",)] and ids(b_out, "bId") == [("b2",)]
    with pytest.raises(Exception, match="exactly once"):
        matching.apply_decisions(accepted, review, good.where("aId = 'a1'"))[0].collect()


def test_text_ratio_is_directed(spark):
    from taproom.functions.similarity import text_ratio

    rows = [("tide", "diet"), ("diet", "tide"), ("crown", "crown arms"), ("", "")]
    frame = spark.createDataFrame(rows, "a string, b string").withColumn("r", text_ratio("a", "b"))
    for row in frame.collect():
        assert row.r == SequenceMatcher(None, row.a, row.b).ratio()


def test_grid_join_equals_brute_force(spark):
    rng = random.Random(3)
    for lat0 in (51.5, -70.0, 0.0):
        pts = [(f"p{i}", lat0 + rng.random() / 50, 10 + rng.random() / 50) for i in range(80)]
        a = spark.createDataFrame(pts, "aId string, aLat double, aLon double")
        b = spark.createDataFrame(pts, "bId string, bLat double, bLon double")
        far = geo.haversine(F.col("aLat"), F.col("aLon"), F.col("bLat"), F.col("bLon"))
        brute = a.crossJoin(b).where(far <= 300)
        assert ids(matching.near_pairs(a, b, 300.0), "aId", "bId") == ids(brute, "aId", "bId")


def test_split_join_cuts_hot_keys_without_loss(spark):
    big = spark.range(1000).selectExpr("id", "IF(id < 700, 'hot', CAST(id % 50 AS STRING)) AS k")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("7", 3)], "k string, v int")
    assert ids(split_join(big, small, ["k"], hot_rows=50), "id", "v") == ids(big.join(small, "k"), "id", "v")


def test_polygon_with_hole(spark):
    # An L with a triangular hole in its lower arm.
    body = (
        '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":'
        "[[[1,1],[16,1],[16,6],[7,6],[7,13],[1,13],[1,1]],[[10,2],[14,2],[12,5],[10,2]]]}}]}"
    )
    rings = payloads.boundary_rings(spark.createDataFrame([("l", body)], "boundaryId string, body string"))
    points = spark.createDataFrame(
        [
            ("upper arm", 3.5, 11.0), ("lower arm", 15.5, 5.5), ("notch", 9.0, 9.0), ("hole", 12.0, 3.0), ("beside hole", 10.5, 4.0),
            ("side", 1.0, 7.5), ("far", 20.0, 3.0),
        ],
        "id string, longitude double, latitude double",
    )
    assert ids(filters.in_polygons(points, rings, "id"), "id") == [("beside hole",), ("lower arm",), ("side",), ("upper arm",)]


def test_points_of_one_place_are_tested_once_and_places_apart(spark):
    body = '{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]]]}'
    rings = payloads.boundary_rings(spark.createDataFrame([("s", body)], "boundaryId string, body string"))
    points = spark.createDataFrame(
        [("a", 1.0, 1.5), ("b", 1.0, 1.5), ("b", 2.0, 2.5), ("c", 5.0, 1.0), ("c", -0.0, 2.0), ("d", 0.0, 2.0), ("e", None, 1.0)],
        "id string, longitude double, latitude double",
    )
    # A point that stands in two places is inside by each of them.
    assert ids(filters.in_polygons(points, rings, "id"), "id") == [("a",), ("b",), ("b",), ("c",), ("d",)]


def test_short_ring_and_wrong_shape_are_errors(spark):
    def rings(body):
        return payloads.boundary_rings(spark.createDataFrame([("x", body)], "boundaryId string, body string"))

    with pytest.raises(Exception, match="four points"):
        filters.ring_edges(rings('{"type":"Polygon","coordinates":[[[0,0],[1,1],[0,0]]]}')).collect()
    with pytest.raises(Exception, match="Polygon"):
        rings('{"type":"Point","coordinates":[1,2]}').collect()


@pytest.mark.parametrize("seed", [5, 6])
def test_duplicate_rule_equals_row_by_row(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"id{rng.randrange(25)}", f"name{rng.randrange(25)}") for i in range(80)]
    seen, expected = (set(), set()), {}
    for i, one, two in rows:
        expected[i] = one in seen[0] or two in seen[1]
        if not expected[i]:
            seen[0].add(one)
            seen[1].add(two)
    frame = spark.createDataFrame(rows, "row long, a string, b string")
    got = {r.row: r.duplicate for r in quality.first_accepted(frame, "row", ["a", "b"]).collect()}
    assert got == expected


LISTING = (
    "listingId string, sourceName string, sourceAddress string, sourcePostcode string, latitude double, "
    "longitude double, website string, pints array<struct<name:string,price:double>>"
)
VENUE = "venueId string, name string, latitude double, longitude double, postcode string, website string, address string"


def test_directory_listing_methods(spark):
    venues = spark.createDataFrame(
        [
            ("v1", "The Crown", 51.50, -0.10, "NW1 7BY", None, None),
            ("v2", "Red Lion", 51.60, -0.20, None, None, None),
            ("v3", "Oak", 51.70, -0.30, None, "https://oak.example/camden", None),
            ("v4", "Swan", 51.80, -0.40, None, None, "12 High Street, London"),
        ],
        VENUE,
    )
    pint = [("Guiness", 5.07)]
    listings = spark.createDataFrame(
        [
            ("l1", "Crown", "x NW1 7BY", "NW17BY", 50.0, 0.0, None, pint),
            ("l2", "Red Lion", "", None, 51.6001, -0.20, None, pint),
            ("l3", "The Oak", "", None, 50.0, 0.0, "http://www.oak.example/camden/book", pint),
            ("l4", "Swan", "12 High St, London", None, 50.0, 0.0, None, pint),
            ("l5", "Crown", "", "SW1A1AA", 50.0, 0.0, None, pint),
            ("l6", "Swan", "12 High St", None, 50.0, 0.0, None, [("Carling", 4.0)]),
        ],
        LISTING,
    )
    got = ids(identity.match_listings(listings, venues), "listingId", "venueId", "matchMethod")
    assert got == [
        ("l1", "v1", "name+postcode"), ("l2", "v2", "name+coordinates"), ("l3", "v3", "name+website"),
        ("l4", "v4", "name+address"), ("l6", "v4", "name+address"),
    ]
    assert ids(identity.directory_prices(listings, venues), "venueId", "priceGbp")[0] == ("v1", 5.07)


def test_name_forms(spark):
    frame = spark.createDataFrame([("The King’s Head (Soho) and Pub",), ("The Pub",)], "n string")
    rows = frame.select(text.directory_name(F.col("n")).alias("d"), text.match_name(F.col("n")).alias("m")).collect()
    assert rows[0].d == "kingshead" and rows[0].m == "king s head soho and pub"
    assert rows[1].d == ""


def test_long_chains_end_in_few_rounds(spark, monkeypatch):
    calls = []
    plain = matching.cut
    monkeypatch.setattr(matching, "cut", lambda frame: calls.append(1) or plain(frame))
    # Each pair is better than the next and shares an end with it: the pass takes every second one.
    n = 3000
    pairs = spark.range(n).selectExpr(
        f"1.0 - id / {2 * n} AS matchScore", "concat('a', cast((id + 1) div 2 as string)) AS aId", "concat('b', cast(id div 2 as string)) AS bId"
    )
    got = {(r.aId, r.bId) for r in matching.one_to_one(pairs).collect()}
    assert got == {(f"a{i}", f"b{i}") for i in range(n // 2)}
    assert len(calls) < 10
    # A component too large for one task goes on in rounds and ends the same.
    few = pairs.where("matchScore > 0.997")
    assert {(r.aId, r.bId) for r in matching.one_to_one(few, local_rows=2).collect()} == {(f"a{i}", f"b{i}") for i in range(9)}


def test_long_chains_of_duplicates(spark):
    rows = spark.range(600).selectExpr("id AS row", "(id + 1) div 2 AS a", "id div 2 AS b")
    got = {r.row: r.duplicate for r in quality.first_accepted(rows, "row", ["a", "b"]).collect()}
    assert got == {i: i % 2 == 1 for i in range(600)}


def test_equal_names_and_points_meet_once(spark):
    known = spark.createDataFrame([(f"v{i:02}", "crown", "SE1", 51.5, -0.1) for i in range(30)] + [("w", "oak", "SE1", 51.6, -0.1)], "venueId string, vName string, _k string, vLat double, vLon double")
    seen = spark.createDataFrame([(f"l{i:02}", "crownarms", "SE1", 51.5, -0.1) for i in range(30)] + [("m", "royaloak", "SE1", 51.6, -0.1)], "listingId string, lName string, _k string, lLat double, lLon double")
    assert ids(identity._only_named(known, seen, 0), "listingId", "venueId") == [("m", "w")]
    two = {r.listingId: (r.venueId, r.nextDistance) for r in identity.nearest_two(seen, known).collect()}
    assert two == {f"l{i:02}": ("v00", 0.0) for i in range(30)} | {"m": ("w", None)}
