import random
from itertools import combinations

import numpy as np
import pytest

from taproom.llm import minhash

SCHEMA = "doc_id long, text string, key long, words string, id int"


def shingles(text, size=3):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def brute(rows, size=3, percent=85):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        small = min(group, default=None)
        out.append((doc, len(sets[i]), small, doc == small))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 5, "x", 1) for d, t in rows], SCHEMA)


def result(docs, **options):
    return sorted(map(tuple, minhash.similar_sets(docs, **options).collect()), key=repr)


def edited(rand, words, share):
    return " ".join(w if rand.random() > share else rand.choice(words) for w in words)


def made_up(seed):
    rand = random.Random(seed)
    vocabulary = [f"Wort{i}" for i in range(400)] + ["É", "\x1c", "x\x00y", "😀"]
    rows, n = [], 0
    for _ in range(25):
        base = rand.choices(vocabulary, k=rand.choice([4, 12, 60, 200]))
        for _ in range(rand.randint(1, 8)):
            rows.append((n, edited(rand, base, rand.choice([0, 0.005, 0.02, 0.05]))))
            n += rand.randint(1, 3)
    chain = rand.choices(vocabulary, k=100)  # every text is close to the next only
    for i in range(30):
        rows.append((1000 - i, " ".join(chain)))
        chain = chain[3:] + rand.choices(vocabulary, k=3)
    same = rows[0][1]
    return rows + [
        (2000, same), (2001, same.upper().replace("É", "É")), (2001, " \t" + same + "\n"), (2002, "one"), (2003, "ONE\x0b"), (2004, "one two"),
        (2005, "two one"), (2006, None), (2007, ""), (2008, " \n"), (None, same), (None, "nobody at all here"), (None, "nobody at all here"),
        (3000, "long " * 5000 + "tail"), (3001, "long " * 4000 + "tail"), (3002, "one"), (3002, "one"),
    ]


def test_matches_all_pairs(spark):
    rows = made_up(1)
    assert result(frame(spark, rows).repartition(4)) == brute(rows)


@pytest.mark.parametrize("leaders,tile,small", [(0, 7, 3), (1, 5, 2)])
def test_tiles_and_leaders_change_nothing(spark, leaders, tile, small):
    rows = made_up(2)
    assert result(frame(spark, rows), leaders=leaders, tile=tile, small=small) == brute(rows)


def test_other_shingles_and_threshold(spark):
    rows = made_up(3)
    assert result(frame(spark, rows), size=5, percent=70, width=3, bands=48) == brute(rows, 5, 70)


def test_a_hot_group_of_near_copies(spark):
    rand = random.Random(9)
    base = [f"w{rand.randrange(500)}" for _ in range(80)]
    rows = [(i, edited(rand, base, 0.02)) for i in range(400)]
    assert result(frame(spark, rows).repartition(3), tile=64) == brute(rows)


def test_sketches_are_full_and_estimate_similarity():
    rand = np.random.default_rng(3)
    for n, shared in ((1, 1), (7, 4), (300, 200), (5000, 4000)):
        pool = rand.integers(0, 2**63, 2 * n, dtype=np.int64).astype(np.uint64)
        one, two = pool[:n], pool[n - shared : 2 * n - shared]
        doc = np.repeat([0, 1], n)
        out = minhash.sketches(doc, np.concatenate([one, two]), 2, 1024)
        assert out.max() < np.uint64(2 * 1024 << 32)
        alone = minhash.sketches(np.zeros(n, np.int64), rand.permutation(one), 1, 1024)
        assert (alone[0] == out[0]).all()
        assert abs((out[0] == out[1]).mean() - shared / (2 * n - shared)) < 0.09


def test_bound_of_equal_coordinates():
    assert minhash.least_equal(85, 160) == max(
        c for c in range(1, 161) if c < 136 and 160 * (c / 160 * np.log(c / 136) + (160 - c) / 160 * np.log((160 - c) / 24)) >= 27.7
    )
    assert minhash.least_equal(100, 160) == 159


def test_empty_table(spark):
    assert result(frame(spark, [])) == []
    assert result(frame(spark, [(1, None), (2, "")])) == [(1, 0, 1, True), (2, 0, 2, True)]
