import hashlib
import re
from collections import defaultdict

from taproom.llm import exact_dedup

SCHEMA = "doc_id long, text string, digest int, best string"
ROWS = [
    (5, "a b"), (3, "ab"), (4, "a\tb "), (9, None), (8, ""), (7, " \n"), (1, "é"), (2, "é"),
    (10, "same"), (10, "same"), (11, "x y"), (12, "xy"), (None, "a b"), (None, "only"), (13, "k " * 5000),
    (14, "k " * 5000), (15, "A b"),
]


def brute(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", text or "")].append((doc, text or ""))
    out = []
    for norm, members in groups.items():
        n, keep = min(((-len(t), d is None, d or 0) for d, t in members))[0], None
        keep = min((d for d, t in members if len(t) == -n and d is not None), default=None)
        for d, t in members:
            out.append((d, keep, len(members), d == keep and len(t) == -n, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def groups(docs, **options):
    return sorted(
        ((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in exact_dedup.exact_groups(docs, **options).collect()),
        key=repr,
    )


def test_matches_brute_force(spark):
    assert groups(frame(spark, ROWS).repartition(4)) == brute(ROWS)


def test_tiny_blocks_and_salts_change_nothing(spark):
    rows = ROWS + [(100 + i, "hot text") for i in range(500)]
    assert groups(frame(spark, rows).repartition(5), salts=3, block_bytes=1) == brute(rows)


def test_drop_copies_keeps_columns_and_one_row(spark):
    left = exact_dedup.drop_copies(frame(spark, ROWS))
    assert left.columns == ["doc_id", "text", "digest", "best"]
    assert left.groupBy("doc_id", "text").count().where("count > 1").count() == 0
    assert left.count() == len({re.sub("[\x20\x09-\x0d]", "", t or "") for _, t in ROWS})


def test_drop_copies_keeps_the_row_that_wins(spark):
    rows = [(3, "ab"), (3, "a  b"), (4, "a b"), (None, "a   b"), (None, "x"), (5, "x"), (None, "lone"), (None, "other"), (7, None), (6, " ")]
    best = {}
    for doc, text in rows:
        key = re.sub("[\x20\x09-\x0d]", "", text or "")
        rank = (-len(text or ""), doc is None, doc or 0)
        best[key] = min(best.get(key, (rank, doc, text)), (rank, doc, text), key=lambda x: x[0])
    want = sorted(((d, t) for _, d, t in best.values()), key=repr)
    names = "doc_id long, text string, _digest string, _keep_id long, key string, row int, n_points int"
    docs = spark.createDataFrame([(*r, "mine", 9, "k", 1, 2) for r in rows + rows], names).repartition(3)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    got = left.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == want
    assert {(r._digest, r._keep_id, r.key, r.row, r.n_points) for r in got} == {("mine", 9, "k", 1, 2)}
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0


def test_empty_table(spark):
    assert groups(frame(spark, [])) == []
