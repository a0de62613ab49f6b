import random
import re
from collections import Counter, defaultdict
from functools import reduce

import pytest
from pyspark.sql import functions as F

from taproom.llm import collocations

SCHEMA = "doc_id long, text string, lang string, n long, phrase string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def counted(rows, longest):
    found, words = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            w = [x for x in re.split("[ \t]", piece) if x]
            words[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    found[lang or "und"][tuple(w[i : i + k])] += 1
    return found, words


def inside(short, long):
    return any(long[i : i + len(short)] == short for i in range(len(long) - len(short) + 1))


def brute(rows, least, longest=5, top=2000, covered=100):
    found, words = counted(rows, longest)
    out = []
    for lang, f in found.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and inside(p, q) for q, b in candidates.items()):
                continue
            score, k = min((1000 * a * words[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(1, t, g, 2, "x") for t, g in rows], SCHEMA)


def made_up(seed, n=160):
    rand = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["É", "ZebrA", "<b>", "\x00", "x\x1cy", "😀"]
    fixed = [" ".join(rand.choices(words, k=rand.randint(2, 7))) for _ in range(12)]
    rows = []
    for _ in range(n):
        parts = [rand.choice(fixed) if rand.random() < 0.5 else " ".join(rand.choices(words, k=rand.randint(1, 9))) for _ in range(rand.randint(0, 12))]
        rows.append((reduce(lambda a, b: a + rand.choice([". ", " ", "\t", "\n", ", "]) + b, parts, ""), rand.choice(["en", "en", "en", "de", None])))
    return rows + [(None, "en"), ("", "xx"), (" ,. ", "xx"), ("one", "xx"), (rows[0][0], rows[0][1])]


def result(docs, **options):
    return sorted(map(tuple, collocations.collocations(docs, **options).collect()))


@pytest.mark.parametrize("shards,parts,block", [(1, 1, 1 << 19), (3, 5, 40)])
def test_matches_brute_force(spark, shards, parts, block):
    rows = made_up(shards)
    got = result(frame(spark, rows).repartition(parts), least=8, shards=shards, slots=1 << 15, block_words=block)
    assert got and got == brute(rows, 8)


def test_full_slot_table_changes_nothing(spark, monkeypatch):
    rows = made_up(7, 60)
    taken = []
    old = collocations._take

    def crowded(table, fresh, step, slots):
        if not taken:
            table[:] = 0  # every slot is taken from the first step on
        taken.append(step)
        return old(table, fresh, step, slots) or step == 0

    monkeypatch.setattr(collocations, "_take", crowded)
    docs = frame(spark, rows).repartition(3)
    assert result(docs, least=5, shards=2, slots=1 << 15, block_words=100) == brute(rows, 5)


def test_half_full_slot_table_changes_nothing(spark):
    rand = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    lines = [" ".join(rand.choices(words, k=5)) for _ in range(2500)]
    rows = [(" ".join(rand.choices(words, k=60)), "en") for _ in range(1500)]
    rows += [(". ".join(rand.choices(lines, k=12)), "en") for _ in range(1500)]
    docs = frame(spark, rows).repartition(6)
    # Some 22 000 frequent phrases in 32 768 slots: many are taken before the words of a phrase are frequent.
    assert result(docs, least=3, shards=2, slots=1 << 15, block_words=5000) == brute(rows, 3)


def test_limits_lengths_and_cover(spark):
    rows = made_up(3, 80)
    got = result(frame(spark, rows), least=4, longest=3, top=5, covered=60, shards=2, slots=1 << 15)
    assert got == brute(rows, 4, 3, 5, 60)


def test_a_hot_long_text_and_ties(spark):
    rows = [("a b " * 30_000, "en"), ("c d. " * 50 + "e f. " * 50, "en")]
    assert result(frame(spark, rows), least=50, shards=2, slots=1 << 15) == brute(rows, 50)


def test_scores_are_exact_past_64_bits(spark):
    row = (9 * 10**15, 3 * 10**12 + 7, 10**13 + 11, 16 * 10**17 + 3)
    data = spark.createDataFrame([row], "a long, l long, r long, n long")
    got = data.select(collocations.floor_score(*[F.col(c) for c in ("a", "l", "r", "n")])).first()[0]
    assert got == 1000 * row[0] * row[3] // (row[1] * row[2])


def test_empty_tables(spark):
    assert result(frame(spark, [])) == []
    assert result(frame(spark, [(None, None), ("", "en")])) == []
