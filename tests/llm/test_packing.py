import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from taproom.llm import packing
from taproom.llm.common import stored

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, part int, length string"
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b c", "a \n b", "a  \nb", "x\n\n y", "it's  John's",
    "tab\tand nbsp  there", "　wide 　 space", "ends in line\n", "\n \n", "word " * 3000,
    "<|endoftext|> stays text", "1 2  3", "été  für\r\n\r\nñ", "word " * 3000, "z" * 5000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", 2, None), (3, "  ", 3, "x")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_pieces_hold_the_ids_of_the_whole_document(spark, docs):
    model = Tokenizer.from_file(PATH)
    model.encode_special_tokens = True
    got = defaultdict(list)
    for r in packing.pieces(docs, PATH).where("doc_id is not null and doc_id <> 3").collect():
        got[r.doc_id].append((r.piece, r.start, r.length, bytes(r.ids)))
    for doc, text in enumerate(TEXTS):
        if doc == 3:
            continue
        want = array("I", [*model.encode(text or "", add_special_tokens=False).ids, 2]).tobytes()
        mine = sorted(got[doc])
        assert b"".join(x[3] for x in mine) == want, text
        assert [x[1] for x in mine] == [sum(y[2] for y in mine[:i]) for i in range(len(mine))]
        assert all(x[2] == 1024 for x in mine[1:])


def test_sequences_are_gapless_and_whole(spark, docs):
    rows = stored(packing.pieces(docs, PATH, 64), "test-pieces")
    packed = packing.pack(rows, 64).collect()
    assert len(packed) == rows.count()
    by = defaultdict(list)
    for r in packed:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    whole = packing.sequences(packing.pack(rows, 64)).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(r.length for r in packed)
    sums = {(r.doc_id, r.piece, r.start): zlib.crc32(r.ids) for r in rows.collect()}
    assert len(sums) == len({(r.doc_id, r.piece, r.start) for r in packed})


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert packing.packed_documents(empty).count() == 0


def test_plan_uses_every_piece_and_few_sequences():
    draw = random.Random(5)
    for capacity in (7, 30, 100):
        for _ in range(30):
            counts = [0] + [draw.choice([0, 0, 1, 5, 40]) for _ in range(capacity)]
            plan = packing.plan_sequences(counts, capacity)
            used = [0] * (capacity + 1)
            for filling, bins in plan:
                assert bins > 0 and sum(a * b for a, b in filling) <= capacity
                assert sum(t for size, t in filling if 3 * size > capacity) <= 2
                for size, times in filling:
                    used[size] += times * bins
            assert used == counts
            least = -(-sum(i * c for i, c in enumerate(counts)) // capacity)
            large = sum(c for i, c in enumerate(counts) if 2 * i > capacity)
            assert sum(b for _, b in plan) <= 1.25 * max(least, large) + 2


def test_large_pieces_are_matched_as_well_as_can_be():
    # 6+4, 5+5 fill sequences of ten exactly.
    assert sum(b for _, b in packing.plan_sequences([0, 0, 0, 0, 3, 4, 3, 0, 0, 0, 0], 10)) == 5
