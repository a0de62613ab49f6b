"""Substring search by the rarest run of each needle, against comparing every pair."""

import random

import pytest
from pyspark.sql import functions as F

from taproom.operators import filters


def frames(spark, needles, texts):
    asked = spark.createDataFrame(list(enumerate(needles)), "requestId long, needle string")
    hay = spark.createDataFrame(list(enumerate(texts)), "id long, hay string")
    return asked, hay


def brute(needles, texts):
    return sorted(
        (i, j) for i, n in enumerate(needles) for j, t in enumerate(texts) if n is not None and t is not None and n in t
    )


def found(joined):
    return sorted((r.requestId, r.id) for r in joined.select("requestId", "id").collect())


def made(pick, count, words):
    return [" ".join(pick.choice(words) for _ in range(pick.randrange(1, 5))) for _ in range(count)]


@pytest.mark.parametrize("cell_rows", [3, 20_000])
def test_against_every_pair(spark, cell_rows):
    pick = random.Random(cell_rows)
    words = ["the", "crown", "ro", "row", "arms", "é", "日本酒", "a", "old  oak"]
    texts = made(pick, 120, words) + ["", None, "the", "a" * 400, "x"] + made(pick, 10, words) * 3
    needles = made(pick, 40, words) + ["", None, "th", "t", "the", "the ", "zzz", "aaa", "日", "本酒", "the crown"] * 2
    asked, hay = frames(spark, needles, texts)
    assert found(filters.substring_join(asked, hay, "needle", "hay", cell_rows)) == brute(needles, texts)


def test_needles_that_all_begin_with_the_same_word(spark):
    # Every needle and every text begins with "the": by its rarest run a needle meets few texts.
    texts = [f"the {i:04d} arms" for i in range(1500)]
    needles = [f"the {i:04d}" for i in range(0, 1500, 3)] + ["the 00", "the arms"]
    asked, hay = frames(spark, needles, texts)
    joined = filters.substring_join(asked, hay, "needle", "hay")
    assert found(joined) == brute(needles, texts)


def test_rows_keep_their_columns_and_empty_tables_meet_nothing(spark):
    asked, hay = frames(spark, ["oak", "oak"], ["old oak", "old oak"])
    both = filters.substring_join(asked.withColumn("x", F.lit(1)), hay.withColumn("y", F.lit(2)), "needle", "hay")
    assert sorted(both.columns) == ["hay", "id", "needle", "requestId", "x", "y"] and both.count() == 4
    assert filters.substring_join(asked.limit(0), hay, "needle", "hay").count() == 0
    assert filters.substring_join(asked, hay.limit(0), "needle", "hay").count() == 0


def test_requests_without_a_hit_get_their_area(spark):
    asked = spark.createDataFrame(
        [(1, "oak", "Soho"), (2, "elm", "Soho"), (3, None, "soho"), (4, "elm", None), (5, "elm", "Soho")],
        "requestId long, needle string, namedArea string",
    )
    hay = spark.createDataFrame([(1, "old oak", "Soho"), (2, None, "SOHO"), (3, "ash", "Kew")], "id long, hay string, area string")
    joined = filters.search_or_area(hay, asked, "hay", "area")
    assert found(joined) == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (5, 1), (5, 2)]
