from pyspark.sql import functions as F

from taproom.llm import langid

SCHEMA = "doc_id long, text string, lang string, score int, word string"
EN = ["the cat sat on the mat with another cat", "these things are what they seem to be", "weather in the north is colder than the south"]
DE = ["der hund und die katze sind nicht hier", "das wetter ist heute schön und warm", "wir gehen nach hause über die brücke"]


def rows():
    out = []
    for i in range(60):
        text, lang = (EN[i % 3], "en") if i % 2 else (DE[i % 3], "de")
        out.append((i, f"{text} {i}", lang, 1, "x"))
    return out + [(100, None, "en", 1, "x"), (101, "123 -- _", "de", 1, "x"), (102, "", None, 1, "x"), (103, "der hund " * 9000, None, 1, "x"),
                  (None, "the cat", "en", 1, "x"), (104, "whether thereon", None, 1, "x"), (104, "whether thereon", None, 1, "x"), (105, "鑑", None, 1, "x")]


def test_learns_and_defines_every_case(spark):
    frame = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = langid.identified(frame).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    for doc, _, lang, *_ in rows()[:60]:
        assert by[doc].lang_pred == lang and by[doc].score > 0.9
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by[100].score == 0
    assert by[103].lang_pred == "de" and by[104].lang_pred == "en" and by[None].lang_pred == "en"
    assert 0 <= by[105].score <= 1 and by[105].lang_pred in ("de", "en")
    left = langid.drop_unidentified(frame)
    assert left.columns == frame.columns
    assert {100, 101, 102}.isdisjoint(r.doc_id for r in left.collect())


def test_words_come_before_shorter_and_shorter_grams(spark):
    frame = spark.createDataFrame([(1, "abcd abcd abcd", "x", 1, ""), (3, "abzz abzz qqqq qqqq", "y", 1, "")], SCHEMA)
    model = langid.fit(frame)
    assert model["languages"] == ["x", "y"]
    assert set(model["tables"][0]) == {"abcd", "abzz", "qqqq"}
    assert "<ab" in model["tables"][3] and "a" in model["tables"][1]
    ask = spark.createDataFrame([(1, "abcd", None, 1, ""), (2, "xabc", None, 1, ""), (3, "q", None, 1, "")], SCHEMA)
    got = {r.doc_id: r.lang_pred for r in langid.predict(ask, model).collect()}
    assert got == {1: "x", 2: "x", 3: "y"}


def test_labels_ids_and_empty_tables(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    a = {r.doc_id: (r.lang_pred, r.score) for r in langid.identified(frame).collect()}
    # What a held-out row says of itself changes nothing.
    lied = frame.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert {r.doc_id: (r.lang_pred, r.score) for r in langid.identified(lied).collect()} == a
    assert langid.identified(frame.limit(0)).count() == 0
    none = langid.identified(frame.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {None, "und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.95


def test_a_bad_text_does_not_take_others_of_its_doc_id(spark):
    frame = spark.createDataFrame([*rows(), (None, "--", "en", 1, "x"), (None, None, "en", 1, "x"), (7, "12", "en", 1, "x")], SCHEMA).repartition(3)
    left = [(r.doc_id, r.text) for r in langid.drop_unidentified(frame).collect()]
    kept = [(d, t) for d, t, *_ in rows() if d is None or d < 60]
    assert set(kept) <= set(left) and not {(None, "--"), (None, None), (7, "12")} & set(left)


def test_a_worker_holds_arrays_and_few_words_at_a_time():
    import numpy as np
    import pyarrow as pa

    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c for a in letters for b in letters for c in letters]
    table = {w: np.full(2, -1.0, np.float32) + np.arange(2, dtype=np.float32) * (i % 2) for i, w in enumerate(words)}
    model = langid.packed({"languages": ["x", "y"], "orders": (1,), "tables": {0: table, 1: {}}})
    terms, scores = model["tables"][0]
    assert isinstance(terms, str) and terms.split("\n") == words and scores.shape == (len(words), 2)

    class Shared:
        value, id = model, "packed"

    texts = [" ".join(words[i : i + 9]) for i in range(200)] + [None, "12"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    once, grouped = (list(langid._predict(Shared, 100, n)([batch])) for n in (10**9, 20))
    assert once == grouped and once[0].num_rows == len(texts)
    assert set(once[0].column(1).to_pylist()) == {"y", "und"}
