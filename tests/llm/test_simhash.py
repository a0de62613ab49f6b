import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from taproom.llm import simhash

SCHEMA = "doc_id long, text string, fp int, root string"


def plain_print(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=3):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def texts():
    draw = random.Random(11)
    out = []
    for i in range(60):
        words = [draw.choice("the of to Än x1 erly tion\x0b").strip() + str(draw.randint(0, 40)) for _ in range(draw.choice([0, 1, 2, 3, 50, 400]))]
        out.append(" ".join(words))
        if words:
            words[0] += "x"
            out.append("\n".join(words))
            out.append(out[-2].upper())
    return out + [None, "", " \t", "a", "A", "word " * 4000]


def test_groups_match_brute_force(spark):
    rows = [(1000 - i, t) for i, t in enumerate(texts())]
    rows += [rows[4], (None, rows[7][1]), (None, "alone with no id here")]
    prints = [plain_print(t) for _, t in rows]
    root = plain_groups(prints)
    ids = {}
    for (doc, _), r in zip(rows, root):
        ids[r] = min((x for x in (ids.get(r), doc) if x is not None), default=None)
    want = sorted(((d, p, ids[r]) for (d, _), p, r in zip(rows, prints, root)), key=repr)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)
    got = simhash.near_groups(frame).collect()
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got), key=repr) == want
    left = simhash.drop_near_copies(frame)
    assert left.columns == ["doc_id", "text", "fp", "root"]
    assert {r.doc_id for r in left.collect()} == set(ids.values())
    assert simhash.near_groups(frame.limit(0)).count() == 0


def spread(n, centres, seed):
    draw = np.random.default_rng(seed)
    base = draw.integers(0, 2**63, centres, dtype=np.uint64)
    out = base[draw.integers(0, centres, n)]
    for _ in range(5):
        out ^= np.uint64(1) << draw.integers(0, 64, n, dtype=np.uint64)
    return np.unique(out)


def test_bit_planes_give_all_pairs_within_the_radius():
    prints = spread(700, 9, 2)
    for radius in (0, 1, 2, 3, 5, 7):
        got = set()
        for i, j in simhash.near_pairs(prints.reshape(-1, 1), rows=50, radius=radius):
            got |= set(zip(i.tolist(), j.tolist()))
        apart = np.bitwise_count(prints[:, None] ^ prints[None, :])
        i, j = np.nonzero(apart <= radius)
        assert got == {(a, b) for a, b in zip(i.tolist(), j.tolist()) if a < b}


def test_keys_tiles_and_components_lose_no_link(spark):
    prints = spread(900, 5, 7)
    frame = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    want = plain_groups(prints.tolist())
    for tile in (20, 4096):
        links = simhash.close_links(frame, tile=tile, block=200)
        found = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in simhash.components(links).collect()}
        mine = [found.get(p, p) for p in prints.tolist()]
        same = {}
        for a, b in zip(mine, want):
            assert same.setdefault(a, b) == b
        assert len(same) == len(set(want))


def test_long_chain_of_links(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = simhash.components(chain).agg(F.count("*"), F.max("root"), F.min("root")).first()
    assert tuple(got) == (300, 0, 0)


def test_bit_planes_of_several_lanes():
    draw = np.random.default_rng(3)
    prints = draw.integers(0, 2**63, (300, 4), dtype=np.uint64)
    for i in range(0, 300, 3):
        prints[i + 1] = prints[i]
        for _ in range(int(draw.integers(0, 120))):
            prints[i + 1, draw.integers(0, 4)] ^= np.uint64(1) << np.uint64(draw.integers(0, 64))
    apart = np.bitwise_count(prints[:, None, :] ^ prints[None, :, :]).sum(axis=2)
    for radius in (0, 20, 31, 48, 63):
        got = set()
        for i, j in simhash.near_pairs(prints, rows=70, radius=radius):
            got |= set(zip(i.tolist(), j.tolist()))
        i, j = np.nonzero(apart <= radius)
        assert got == {(a, b) for a, b in zip(i.tolist(), j.tolist()) if a < b}


def jaccard(a, b):
    cut = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    return len(cut(a) & cut(b)) / len(cut(a) | cut(b))


def test_similar_texts_are_joined_and_others_stay(spark):
    draw = random.Random(4)
    say = lambda n: [f"w{draw.randint(0, 5000)}" for _ in range(n)]
    rows, pairs = [], []
    for k in range(120):
        one = say(200)
        two = list(one)
        for at in draw.sample(range(200), 3):
            two[at] = "changed"
        rows += [(10 * k, " ".join(one)), (10 * k + 1, " ".join(two)), (10 * k + 2, " ".join(one[:60] + say(140)))]
        pairs.append((10 * k, 10 * k + 1))
    by = dict(rows)
    assert min(jaccard(by[a], by[b]) for a, b in pairs) >= 0.8
    rows += [(5000, None), (5001, ""), (5002, "two words"), (5003, "TWO words"), (None, rows[0][1]), (0, rows[0][1])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)
    got = {}
    for r in simhash.similar_groups(frame, tile=64).collect():
        got.setdefault(r.doc_id, r.component_id)
    joined = sum(got[a] == got[b] for a, b in pairs)
    assert joined >= 0.97 * len(pairs)
    assert len({got[10 * k + 2] for k in range(120)} - {got[10 * k] for k in range(120)}) == 120
    assert got[5000] == got[5001] == 5000 and got[5002] == got[5003] == 5002 and got[None] == 0
    left = simhash.drop_similar(frame)
    assert left.columns == frame.columns and {r.doc_id for r in left.select("doc_id").collect()} == set(got.values())
    assert simhash.similar_groups(frame.limit(0)).count() == 0


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_similar(rows):
    """The group of each row: pairs of a Jaccard similarity of 0.8, over all pairs of shingle sets."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and root[i] != root[j]:
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_similar_groups_are_those_of_all_pairs_of_shingles(spark):
    draw = random.Random(9)
    say = lambda n: [f"w{draw.randint(0, 9000)}" for _ in range(n)]
    rows = []
    for k in range(100):
        n = draw.choice([8, 9, 12, 30, 104, 204, 404])
        one = say(n)
        rows.append(" ".join(one))
        # Cut or replaced endings and middles: similarities from 0.55 to 0.95, many close to 0.8 on both sides.
        for _ in range(3):
            cut = max(1, round(n * draw.uniform(0.02, 0.3)))
            rows.append(" ".join(one[:-cut] + say(draw.choice([0, cut // 2]))))
    chain = say(240)  # each like the next, the ends unlike
    rows += [" ".join(chain[k : k + 100]) for k in range(0, 140, 10)]
    large = say(60)  # a group larger than a block
    rows += [" ".join([*large, f"end{k}"]) for k in range(50)] + [" ".join(large[: 60 - k]) for k in range(1, 20)]
    rows = [(3 * k, t) for k, t in enumerate(rows)] + [(9001, None), (9002, ""), (9003, " \t")]
    root = plain_similar(rows)
    want = {d: rows[r][0] for (d, _), r in zip(rows, root)}
    sets = [shingles(t) for _, t in rows]
    near = [5 * len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) for i in range(400) for j in range(i)]
    assert sum(4 <= x < 4.3 for x in near) > 20 and sum(3.5 < x < 4 for x in near) > 20
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)
    for checked in (512, 8):
        got = {r.doc_id: r.component_id for r in simhash.similar_groups(frame, tile=64, checked=checked).collect()}
        assert got == want


def test_one_row_of_each_group_is_left_whatever_its_id(spark):
    draw = random.Random(5)
    say = lambda n: [f"w{draw.randint(0, 9000)}" for _ in range(n)]
    one, two, lone, pair = say(200), say(200), say(200), say(200)
    near = lambda words, k: " ".join([*words[:-1], f"end{k}"])
    rows = [(1, near(one, 0)), (None, near(one, 1)), (5, near(one, 2)), (7, near(two, 0)), (None, near(two, 1)), (None, near(two, 2))]
    rows += [(None, " ".join(lone)), (5, " ".join(say(50))), (None, near(pair, 1)), (None, near(pair, 2)), (9, None), (None, ""), (9, "")]
    names = "doc_id long, text string, _keep long, key string, row int, fp string, root int, digest int"
    docs = spark.createDataFrame([(*r, 3, "k", 1, "f", 2, 4) for r in rows + rows[:8]], names).repartition(3)
    mark = lambda doc, text: (doc is None, doc or 0, hashlib.sha256((text or "").encode()).digest())
    for drop, group in ((simhash.drop_similar, plain_similar(rows)), (simhash.drop_near_copies, plain_groups([plain_print(t) for _, t in rows]))):
        best = {}
        for row, g in zip(rows, group):
            best[g] = min(best.get(g, mark(*row)), mark(*row))
        left = drop(docs)
        assert left.columns == docs.columns
        got = left.collect()
        assert sorted(mark(r.doc_id, r.text) for r in got) == sorted(best.values())
        assert {(r._keep, r.key, r.row, r.fp, r.root, r.digest) for r in got} == {(3, "k", 1, "f", 2, 4)}
    assert simhash.drop_similar(docs.limit(0)).count() == simhash.drop_near_copies(docs.limit(0)).count() == 0
