"""Current labels as a table without stream state: late, repeated and shuffled events, bounded rewrites."""

import random
from datetime import datetime, timedelta

from taproom.sources import hash_table
from taproom.streaming import feedback

SCHEMA = (
    "eventId string, sessionId string, venueId string, eventType string, query string, "
    "recommendationRank int, recordedAt timestamp"
)
START = datetime(2026, 1, 1)


def event(n, session, venue, kind, query, minute):
    return (f"e{n:05d}", session, venue, kind, query, 1, START + timedelta(minutes=minute))


def written(spark, path, events):
    spark.createDataFrame(events, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def fold(spark, path, table, state, capacity):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    running = feedback.upsert_labels_stream(source, table, state, capacity)
    running.awaitTermination()
    return running


def content(spark, table):
    rows = feedback.label_table(spark, table).collect()
    found = {(r.sessionId, r.queryKey, r.venueId): (r.eventId, r.eventType) for r in rows}
    assert len(found) == len(rows)
    return found


def expected(events):
    last = {}
    for n, session, venue, kind, query, _, at in events:
        if kind not in ("like", "dislike") or not (query or ""):
            continue
        key = (session or "anonymous", " ".join(query.lower().split()), venue)
        last[key] = max(last.get(key, (START - timedelta(1), "", "")), (at, n, kind))
    return {key: (n, kind) for key, (_, n, kind) in last.items()}


def test_shuffled_late_and_repeated_events(spark, tmp_path):
    pick = random.Random(3)
    kinds, asked = ("like", "dislike", "click", "save"), ("Quiet pub", "quiet  PUB ", "food", "", None)
    events = [
        event(n, pick.choice(("s1", "s2", "", None)), f"v-{pick.randrange(40)}", pick.choice(kinds), pick.choice(asked), pick.randrange(50))
        for n in range(900)
    ]
    order = events + pick.sample(events, 200)
    pick.shuffle(order)
    path, table = str(tmp_path / "in"), str(tmp_path / "t")
    for part in range(4):
        written(spark, path, order[part::4])
    running = fold(spark, path, table, str(tmp_path / "s"), 20)
    assert all(not progress["stateOperators"] for progress in running.recentProgress)
    assert content(spark, table) == expected(events)
    # One event a year late, older than what is held, and one that replaces it; another checkpoint goes on from the table.
    late = [event(9001, "s1", "v-1", "like", "food", -500_000), event(9002, "s1", "v-1", "dislike", "food", 500_000)]
    written(spark, str(tmp_path / "in2"), late)
    fold(spark, str(tmp_path / "in2"), table, str(tmp_path / "s2"), 20)
    assert content(spark, table) == expected(events + late)


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    path, table, state = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "s")
    written(spark, path, [event(n, f"s{n}", "v-1", "like", "food", 0) for n in range(600)])
    fold(spark, path, table, state, 30)
    _, before = hash_table.directory(spark, table)
    assert len(before) >= 600 / 30 and all(b["n"] <= 30 for b in before)
    written(spark, path, [event(7000 + n, f"s{n}", "v-1", "dislike", "food", 9) for n in range(3)])
    fold(spark, path, table, state, 30)
    _, after = hash_table.directory(spark, table)
    assert 0 < len({b["part"] for b in after} - {b["part"] for b in before}) <= 3
    found = content(spark, table)
    assert len(found) == 600 and found["s2", "food", "v-1"] == ("e07002", "dislike")


def test_batches_without_labels_write_nothing(spark, tmp_path):
    path, table = str(tmp_path / "in"), str(tmp_path / "t")
    written(spark, path, [event(1, "s", "v", "click", "food", 0), event(2, "s", "v", "like", None, 0)])
    fold(spark, path, table, str(tmp_path / "s"), 30)
    assert feedback.label_table(spark, table) is None
