"""The pipeline against a brute-force version of its first four stages and the rules of the last."""

import random
import re
from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from taproom.llm import decontaminate, langid, packing, registry, simhash
from test_simhash import plain_similar

SF = "/root/testdata/sf0.001"


def survivors(docs, languages, items, groups_of, window=13):
    """doc_ids that should be left; `languages` maps doc_id to (lang_pred, score), `groups_of` doc_ids to
    their group among the texts it is given."""
    left = {d: t for d, t in docs.items() if languages[d][0] != "und" and languages[d][1] >= 0.5}
    groups = defaultdict(list)
    for d, t in left.items():
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append(d)
    left = {min(g, key=lambda d: (-len(left[d]), d)): None for g in groups.values()}
    left = {d: docs[d] for d in sorted(left)}
    first = {}
    for d, group in sorted(groups_of(left).items()):
        first.setdefault(group, d)
    left = {d: docs[d] for d in first.values()}
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    phrases = set()
    for t in items:
        w = split(t)
        phrases |= {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1) if w else 0)}
    sizes = {len(p) for p in phrases}
    out = []
    for d, t in left.items():
        w = split(t)
        hit = {j for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in phrases for j in range(i, i + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            out.append(d)
    return sorted(out)


def test_pipeline_matches_brute_force(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    languages = {r.doc_id: (r.lang_pred, r.score) for r in langid.identified(docs).collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def groups_of(left):
        frame = spark.createDataFrame(list(left.items()), "doc_id long, text string")
        return {r.doc_id: r.component_id for r in simhash.similar_groups(frame).collect()}

    assert sorted({r.doc_id for r in rows}) == survivors(texts, languages, items, groups_of)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY


def test_every_stage_keeps_columns_and_handles_odd_tables(spark, tmp_path):
    draw = random.Random(2)
    say = lambda n: " ".join(draw.choice(["the", "cat", "sees", "nine", "old", "ships"]) + str(i) for i in range(n))
    rows = [(i, say(30), "en", "s", 1) for i in range(30)]
    rows += [(40, None, None, None, None), (41, "", "en", "s", 0), (42, "12 34", "en", "s", 0), (43, rows[0][1], "en", "s", 1), (43, rows[0][1], "en", "s", 1), (None, rows[1][1], "en", None, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(*r, "x", 1.0) for r in rows], schema + ", _digest string, score double").repartition(3)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            path = str(tmp_path / f"{name}-{docs is odd}-{draw.random()}".replace(" ", "-"))
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        left = docs
        assert corpus_pipeline.STAGES[-1][1](spark, left, SF).where("doc_id is null").count() == left.where("doc_id is null").count()
    assert {n for n, _ in corpus_pipeline.STAGES} and corpus_pipeline.ORACLE_SQL is None


def test_similar_groups_against_all_pairs_of_shingles(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    assert got == {d: texts[r][0] for (d, _), r in zip(texts, plain_similar(texts))}


def test_stages_reuse_the_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    near = simhash.near_groups(docs).select(F.countDistinct("component_id")).first()[0]
    assert simhash.drop_near_copies(docs).select("doc_id").distinct().count() == near
    found = decontaminate.judged(decontaminate.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")))
    assert decontaminate.drop_contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == found.where("not contaminated").count()


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{i}" for i in range(1, 14)]
