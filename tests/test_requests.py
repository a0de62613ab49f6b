import pytest
from pyspark.sql import functions as F

from taproom import vocab as V
from taproom.functions import requests as R
from taproom.operators import filters, intents, ranking
from taproom.plans import recommend


def parse(spark, *texts):
    frame = spark.createDataFrame([(t,) for t in texts], "query string")
    return {r.query: r.prefs for r in R.parsed_texts(frame).collect()}


CASES = {
    "pub in Camden with food": {"location": "Camden", "requiredFeatures": ["food"]},
    "quiet pub with no sports": {"noiseLevel": "quiet", "excludedFeatures": ["sports"], "requiredFeatures": []},
    "prefer live music": {"preferredFeatures": ["liveMusic"], "requiredFeatures": []},
    "cheap pub for 6 people": {"priceLevel": "cheap", "groupSize": 6, "requiredFeatures": ["groups"]},
    "party of 60 people": {"groupSize": None, "requiredFeatures": []},
    "pub near NW1 7BY": {"postcode": "NW17BY"},
    "pub in sw1a": {"postcode": "SW1A"},
    "food but no food": {"contradictions": ["food"], "excludedFeatures": ["food"], "requiredFeatures": []},
    "not in Camden": {"location": None, "excludedLocations": ["Camden"]},
    "Camden but avoid Camden": {"contradictions": ["location"]},
    "no quiet pub": {"excludedFeatures": ["quietAtmosphere"], "noiseLevel": None},
    "quiet and lively": {"noiseLevel": None, "contradictions": ["noiseLevel"]},
    "without entrance steps": {"requiredFeatures": ["wheelchairAccess"]},
    "no outdoor seating": {"excludedFeatures": ["outdoorSeating"]},
    "ideally a beer garden": {"preferredFeatures": ["outdoorSeating"]},
}


def test_preferences(spark):
    got = parse(spark, *CASES)
    for text, expected in CASES.items():
        for name, value in expected.items():
            assert got[text][name] == value, (text, name, got[text])


def test_leftover_terms(spark):
    frame = spark.createDataFrame([("Camden pub with odd carpets for 6 people",)], "q string")
    assert frame.select(R.leftover_terms(F.col("q")).alias("t")).first().t == ["odd", "carpets"]


VENUE = (
    "venueId string, name string, latitude double, longitude double, area string, postcode string, priceLevel string, "
    + ", ".join(f"{f} boolean" for f in V.FACTS)
    + ", noiseLevel string, rating double, popularityScore double"
)


def venue(key, **values):
    row = {"venueId": key, "name": key, "latitude": 51.539, "longitude": -0.1426, "area": "Camden", **values}
    names = [part.split()[0] for part in VENUE.split(", ")]
    return tuple(row.get(name) for name in names)


def found(spark, query, venues):
    requests = spark.createDataFrame([(1, query)], "requestId long, query string")
    rows = filters.candidates(recommend.parse(requests), spark.createDataFrame(venues, VENUE))
    return sorted(r.venueId for r in rows.collect())


@pytest.mark.parametrize(
    "query, expected",
    [
        ("food", ["yes"]),
        ("no food", ["no"]),
        ("food but no food", []),
        ("pub", ["no", "unknown", "yes"]),
        ("food in Brixton", []),
    ],
)
def test_unknown_is_neither_required_nor_excluded(spark, query, expected):
    venues = [venue("yes", servesFood=True), venue("no", servesFood=False), venue("unknown")]
    assert found(spark, query, venues) == expected


def test_excluded_price_needs_a_known_price(spark):
    venues = [venue("cheap", priceLevel="cheap"), venue("dear", priceLevel="expensive"), venue("unknown")]
    assert found(spark, "not cheap", venues) == ["dear"]


def test_single_filter_agrees_with_the_join(spark):
    venues = spark.createDataFrame([venue("a", servesFood=True), venue("b", servesFood=False, hasDj=False)], VENUE)
    wanted = {"location": "Camden", "requiredFeatures": ["food"]}
    assert [r.venueId for r in venues.where(filters.hard_filter(wanted)).collect()] == ["a"]
    assert venues.where(filters.hard_filter({"contradictions": ["food"]})).count() == 0


def scored(spark, query, *venues):
    requests = spark.createDataFrame([(1, query)], "requestId long, query string")
    rows = recommend.rank(requests, spark.createDataFrame(venues, VENUE)).withColumn("reasons", ranking.reasons())
    return {r.venueId: r for r in rows.collect()}


def test_score_counts_only_known_factors(spark):
    rows = scored(spark, "pub in Camden with food", venue("a", servesFood=True, rating=4.0), venue("b", servesFood=True))
    # rating .2*.8 + location .25*1 + features .2*1 over .65
    assert rows["a"].score == round((0.2 * 0.8 + 0.25 + 0.2) / 0.65, 3)
    assert rows["b"].score == 1.0 and "rating" not in rows["b"].scoreBreakdown
    assert rows["a"].reasons == ["Located in Camden", "Serves food", "Rated 4.0 out of 5"]


def test_no_factor_scores_zero(spark):
    assert scored(spark, "pub", venue("a"))["a"].score == 0.0


def test_personal_similarity(spark):
    traits = {"servesFood": True, "hasDj": True, "priceLevel": "cheap", "noiseLevel": "quiet"}
    venues = spark.createDataFrame(
        [venue("same", **traits), venue("loved", **traits), venue("other", showsSports=True, area="Brixton")], VENUE
    )
    ranked = spark.createDataFrame(
        [(1, 9, "same", "same", 0.5), (1, 9, "loved", "loved", 0.5), (1, 9, "other", "other", 0.5)],
        "requestId long, userId long, venueId string, name string, score double",
    )
    ratings = spark.createDataFrame([(9, "loved", 5.0, 1)], "userId long, venueId string, rating double, pos long")
    rows = {r.venueId: r for r in ranking.personalise(ranked, ratings, venues).collect()}
    assert rows["same"].score == 0.7 and rows["same"].personalReason == "Similar to loved · 5★"
    assert rows["loved"].score == 0.5 and rows["other"].personalReason is None
    hated = spark.createDataFrame([(9, "loved", 1.0, 1)], "userId long, venueId string, rating double, pos long")
    rows = {r.venueId: r for r in ranking.personalise(ranked, hated, venues).collect()}
    assert rows["same"].score == 0.15 and rows["same"].personalReason == "Less like loved · 1★"


def merged(spark, query, **labels):
    requests = spark.createDataFrame([(1, query)], "requestId long, query string")
    rows = recommend.parse(requests)
    for name in ("modelRequired", "modelPreferred", "modelExcluded", "modelContradictions"):
        rows = rows.withColumn(name, F.array(*[F.lit(v) for v in labels.get(name, [])]).cast("array<string>"))
    return intents.merge_labels(rows).drop("prefs").first()


def test_model_labels_need_an_anchor(spark):
    row = merged(spark, "external deck that admits our spaniel", modelRequired=["outdoorSeating", "dogFriendly", "food"])
    assert row.requiredFeatures == ["dogFriendly", "outdoorSeating"]


def test_model_exclusion_needs_negative_words(spark):
    assert merged(spark, "pets accepted", modelExcluded=["dogFriendly"]).excludedFeatures == []
    assert merged(spark, "never any pets", modelExcluded=["dogFriendly"]).excludedFeatures == ["dogFriendly"]


def test_soft_words_keep_a_preference(spark):
    assert merged(spark, "ideally a gig", modelPreferred=["liveMusic"]).preferredFeatures == ["liveMusic"]
    row = merged(spark, "a gig", modelPreferred=["liveMusic"])
    assert row.preferredFeatures == [] and row.requiredFeatures == ["liveMusic"]


def decide(spark, clause, scores, none=0.1, global_negative=False):
    top = sorted(((v, k) for k, v in scores.items()), reverse=True)
    full = {**{f: 0.0 for f in V.INTENT_FEATURES}, **scores}
    row = [(clause, global_negative, top[0][1], top[0][0], top[1][0] if len(top) > 1 else 0.0, none, full)]
    schema = (
        "clause string, globalNegative boolean, topLabel string, topScore double, secondScore double, noneScore double, "
        "scores map<string,double>"
    )
    return intents.decide(spark.createDataFrame(row, schema)).first()


def test_clause_decisions(spark):
    assert decide(spark, "somewhere with pooches", {"dogFriendly": 0.9}).clauseRequired == ["dogFriendly"]
    assert decide(spark, "no gigs", {"liveMusic": 0.2}).clauseExcluded == ["liveMusic"]
    assert decide(spark, "a vague mood", {"food": 0.61}, none=0.6).clauseRequired == []
    assert decide(spark, "preferably a gig", {"liveMusic": 0.8}).clausePreferred == ["liveMusic"]
    assert decide(spark, "strictly indoors", {"outdoorSeating": 0.7}).clauseExcluded == ["outdoorSeating"]
    assert decide(spark, "a dj and a band act", {"dj": 0.9, "liveMusic": 0.7}).clauseRequired == ["dj"]
