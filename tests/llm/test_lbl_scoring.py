import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from taproom.llm import lbl_scoring as L

SCHEMA = "doc_id long, text string, row long, c int"


def rows():
    out = [(i, ("The cat sat on the mat . " if i % 3 else "a Dog ran\x0bhome . ") * (i % 4 + 1) + f"rare{i}", 1, 1) for i in range(80)]
    return out + [(200, None, 1, 1), (201, " \n", 1, 1), (202, "zzz " * 5000, 1, 1), (None, "the cat", 1, 1), (203, "é É the", 1, 1), (203, "é É the", 1, 1)]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def tokens(text):
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lower(text)).split(" ") if w] + [""]


def out_of_training(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def test_base_scores_match_brute_force(spark):
    frame = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    counts = Counter(t for doc, text, *_ in rows() if not out_of_training(doc) for t in tokens(text))
    total, kinds = sum(counts.values()), len(counts)
    for known in (5, 50_000):
        got = L.lm_scores(frame, frame.where(~L.held_out()), classes=6, known=known).withColumn("held_out", L.held_out()).collect()
        want = sorted(
            (repr(d), len(tokens(t)), sum(x in counts for x in tokens(t)), total, out_of_training(d),
             round(sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in tokens(t)), 6))
            for d, t, *_ in rows()
        )
        mine = sorted((repr(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.held_out, round(r.base_score, 6)) for r in got)
        assert mine == want
        assert all(r.score < 0 for r in got)


def test_probabilities_sum_to_one():
    shares = np.array([0.5, 0.3, 0.2])
    p = L.start_parameters(shares, 4)
    norms = np.full(16, np.nan)
    near, far, target = (x.ravel() for x in np.meshgrid(np.arange(4), np.arange(4), np.arange(3), indexing="ij"))
    chance = np.exp(L.log_chances(p, near, far, target, norms)).reshape(16, 3).sum(axis=1)
    assert np.allclose(chance, 1, atol=1e-5)


def test_training_learns_what_follows_what():
    draw = np.random.default_rng(0)
    chain = [0]
    for _ in range(60_000):
        chain.append((chain[-1] + 1) % 4 if draw.random() < 0.9 else int(draw.integers(0, 4)))
    classes = np.array(chain)
    shares = np.bincount(classes, minlength=4) / len(classes)
    near, far = L.contexts(classes, np.array([len(classes)]), 4)
    p = L.start_parameters(shares, 8)
    state = {k: np.zeros_like(v) for k, v in p.items()}
    log_noise = np.log(16 * shares).astype(np.float32)
    for at in range(0, len(classes) - 512, 512):
        to = slice(at, at + 512)
        L.nce_step(p, state, near[to], far[to], classes[to], draw.choice(4, 16, p=shares), log_noise)
    mean = L.log_chances(p, near, far, classes, np.full(25, np.nan)).mean()
    assert mean > np.log(shares).mean() + 0.5


def test_scores_of_held_out_documents_beat_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.lm_scores(docs, docs.where(~L.held_out())).withColumn("held_out", L.held_out()).where("held_out")
    row = got.agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert row[0] > row[1]


def test_empty_tables(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    assert L.lm_scores(frame.limit(0), frame).count() == 0
    got = L.lm_scores(frame, frame.limit(0)).collect()
    assert len(got) == len(rows()) and {(r.train_tokens, r.n_known, r.base_score) for r in got} == {(0, 0, 0.0)}
