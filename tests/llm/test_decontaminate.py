import hashlib
import random
import re

from taproom.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, window):
    phrases = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + window]), set()).add(str(item) if item is not None else "")
    sizes = {len(p) for p in phrases}
    out = []
    for doc, text in docs:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                own = phrases.get(tuple(w[i : i + n]))
                if own:
                    hit.update(range(i, i + n))
                    found |= own
        out.append((doc, len(w), sorted(hit), sorted(found)))
    return sorted(out, key=repr)


def run(spark, docs, items, window, **options):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string").repartition(3)
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = D.contamination(d, b, window, **options).collect()
    return sorted(((r.doc_id, r.n_words, [i for s in r.spans for i in range(s.start, s.end)], list(r.item_ids)) for r in got), key=repr)


def test_matches_brute_force_on_random_texts(spark):
    draw = random.Random(3)
    for window, words in ((3, 4), (5, 3), (13, 2)):
        say = lambda n: " ".join(draw.choice("abcdefgh"[:words]) for _ in range(n))
        items = [(i, say(draw.choice([1, 2, 4, 9, 20]) + window // 4)) for i in range(12)] + [(7, "A, b")]
        docs = [(i, say(draw.choice([0, 1, 5, 60])) + draw.choice(["", " zz ", " zz " + items[i % 9][1]])) for i in range(60)]
        want = brute(docs, items, window)
        assert run(spark, docs, items, window) == want
        assert run(spark, docs, items, window, shard_words=1, block_words=1, sample=3) == want


def test_nulls_empties_ties_and_long_texts(spark):
    phrase = "É1 two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    items = [(1, phrase), (1, phrase), (2, None), (3, ""), (None, "--"), (4, "LONE word"), (5, "x" * 2000)]
    docs = [(1, None), (2, ""), (3, phrase.upper().replace("É", "é")), (None, "a lone-word"), (4, ("pad " * 3000 + phrase) * 2), (4, "lone"), (5, "x" * 2000)]
    docs = [(d, t.replace("é", "É") if t else t) for d, t in docs]
    assert run(spark, docs, items, 13) == brute(docs, items, 13)
    assert run(spark, [], items, 13) == []
    assert all(r[2] == [] for r in run(spark, docs, [], 13))


def test_rule_and_digest(spark):
    w = " ".join(f"w{i}" for i in range(13))
    d = spark.createDataFrame([(1, w + " x" * 247), (2, w + " x" * 248), (3, "clean")], "doc_id long, text string")
    b = spark.createDataFrame([(10, w), (9, "zz " + w)], "item_id long, text string")
    got = {r.doc_id: r for r in D.judged(D.contamination(d, b)).collect()}
    assert (got[1].n_hit, got[1].contaminated, got[2].contaminated, got[3].contaminated) == (13, True, False, False)
    assert list(got[1].item_ids) == ["10", "9"]
    assert [r.doc_id for r in D.drop_contaminated(d, b).orderBy("doc_id").collect()] == [2, 3]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_a_contaminated_text_does_not_take_others_of_its_doc_id(spark):
    w = " ".join(f"w{i}" for i in range(13))
    docs = [(None, w), (None, "clean"), (None, None), (7, "also clean"), (7, w + " x"), (8, w + " x" * 248)]
    d = spark.createDataFrame([(*x, 1.5) for x in docs], "doc_id long, text string, more double").repartition(2)
    left = D.drop_contaminated(d, spark.createDataFrame([(10, w)], "item_id long, text string"))
    assert left.columns == d.columns
    assert {(r.doc_id, r.text) for r in left.collect()} == {x for x in docs if x not in {(None, w), (7, w + " x")}}
