r"""MinHash near-dedup by fast similarity sketching.

A sketch has t coordinates. In each of the first t rounds every element falls into one hashed coordinate, in
round t + i all elements fall into coordinate i; a coordinate keeps the smallest (round, value) it got, and rounds
end when every coordinate is full. So all are full, whatever the size of the set, and the share of equal
coordinates of two sets keeps the concentration of t independent draws around their Jaccard similarity.

Bands of coordinates bring candidates together. A bucket's rows are compared with a leader, those that are still apart
with further leaders and in the end with each other, and every link is confirmed on the whole shingle sets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taproom.llm.common import stored, table
from taproom.operators.components import components

SHINGLE = 3
PERCENT = 85
BANDS, WIDTH = 32, 5  # a pair at 0.85 shares none of 32 bands of five coordinates with a chance of 7 in 10^9
LEADERS = 3  # rounds in which a bucket is compared with one of its rows
TILE = 512  # rows of a side of a tile
TILE_SHINGLES = 4000  # shingles of a row that a tile of so many rows is made for; longer rows lie in smaller tiles
COLUMNS = 8192  # columns of an incidence matrix
SMALL = 8  # rows of a bucket whose remaining pairs are formed by a join
GROUP_WORDS = 1 << 20  # words sketched at a time; a longer text is a group of its own


def least_equal(percent: int, coordinates: int) -> int:
    """Equal coordinates that a pair at the threshold has, but for a chance of 10^-12 (Chernoff's bound)."""
    p = percent / 100
    for equal in range(coordinates, 0, -1):
        q = equal / coordinates
        if q < p:
            apart = q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if p < 1 else 99)
            if apart * coordinates >= 27.7:
                return equal
    return 0


def words_of(text: bytes) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at the six ASCII white-space characters."""
    return text.lower().split()  # for bytes both touch ASCII alone


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(doc, hashes, docs: int, coordinates: int):
    """Sketches (docs x coordinates) of sets: element i, of hash hashes[i], belongs to set doc[i]; no set is empty.

    A value is round * 2^32 + draw.
    """
    import numpy as np

    t, low = np.uint64(coordinates), np.uint64(0xFFFFFFFF)
    empty = np.uint64(2**64 - 1)
    out = np.full(docs * coordinates, empty, np.uint64)
    doc = doc.astype(np.uint64)
    for turn in range(2 * coordinates):
        drawn = _mix(hashes ^ _mix(np.array([turn + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        if turn < coordinates:
            place = ((drawn >> np.uint64(32)) * t) >> np.uint64(32)
        else:
            place = np.uint64(turn - coordinates)
        both = ((doc * t + place) << np.uint64(32)) | (drawn & low)
        both.sort()
        slot = both >> np.uint64(32)
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        slot = slot[first].astype(np.int64)
        out[slot] = np.minimum(out[slot], np.uint64(turn << 32) | (both[first] & low))
        unfilled = (out.reshape(docs, coordinates) == empty).any(axis=1)
        left = unfilled[doc.astype(np.int64)]
        if not left.any():
            break
        doc, hashes = doc[left], hashes[left]
    return out.reshape(docs, coordinates)


def shingle_codes(ids, lengths, size: int):
    """Places of first words and (place, distinct code) of the shingles of texts given as runs of word numbers from 1.

    Returns (owner, start, code, n_distinct): the text and first word of each shingle, its exact code and the
    number of distinct ones of each text. A text of fewer words is one shingle.
    """
    import numpy as np

    ends = np.cumsum(lengths)
    owner_of = np.repeat(np.arange(len(lengths)), lengths)
    reach = np.arange(len(ids)) + size <= ends[owner_of]
    short = np.nonzero((lengths > 0) & (lengths < size))[0]
    start = np.sort(np.concatenate([np.nonzero(reach)[0], (ends - lengths)[short]]))
    owner = owner_of[start]
    padded = np.concatenate([ids, np.zeros(size, np.int64)])
    code = padded[start]
    for i in range(1, size):
        following = np.where(i < lengths[owner], padded[start + i], 0)
        _, code = np.unique(code, return_inverse=True)  # keeps code * V within 64 bits
        code = code * (int(ids.max(initial=0)) + 1) + following
    bounds = np.searchsorted(owner, np.arange(len(lengths) + 1))
    distinct = np.array([len(np.unique(code[bounds[i] : bounds[i + 1]])) for i in range(len(lengths))], np.int64)
    return owner, start, code, distinct


def _sketch(size: int, bands: int, width: int):
    """Batches of (doc_id, text) into doc_id, digest of the words, n_shingles, band keys and a byte a coordinate."""

    def run(batches):
        import hashlib
        from collections import defaultdict

        import numpy as np
        import pyarrow as pa
        import xxhash

        from taproom.llm.common import texts

        coordinates = bands * width

        def made(docs, words):
            known = defaultdict()
            known.default_factory = lambda: len(known) + 1
            lengths = np.array([len(w) for w in words], np.int64)
            ids = np.fromiter((known[x] for w in words for x in w), np.int64, int(lengths.sum()))
            owner, start, _, distinct = shingle_codes(ids, lengths, size)
            hashes = np.array([0, *(xxhash.xxh64_intdigest(x) for x in known)], np.uint64)
            padded = np.concatenate([ids, np.zeros(size, np.int64)])
            mixed = hashes[padded[start]]
            for i in range(1, size):
                mixed = _mix(mixed) + hashes[np.where(i < lengths[owner], padded[start + i], 0)]
            filled = np.nonzero(lengths)[0]
            number = np.zeros(len(words), np.int64)
            number[filled] = np.arange(len(filled))
            values = sketches(number[owner], _mix(mixed), len(filled), coordinates)
            keys = values.reshape(len(filled), bands, width)
            key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(filled), bands)).copy()
            for i in range(width):
                key = _mix(key + keys[:, :, i])
            marks = (values & np.uint64(255)).astype(np.uint8)
            rows = [None if not n else number[i] for i, n in enumerate(lengths)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(docs, pa.int64()),
                    pa.array([hashlib.sha256(b" ".join(w)).digest() for w in words], pa.binary()),
                    pa.array(distinct, pa.int64()),
                    pa.array([None if r is None else key[r].view(np.int64) for r in rows], pa.list_(pa.int64())),
                    pa.array([None if r is None else marks[r].tobytes() for r in rows], pa.binary()),
                ],
                ["doc_id", "digest", "n_shingles", "keys", "marks"],
            )

        for batch in batches:
            docs, words, held = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                docs.append(doc)
                words.append(words_of(text))
                held += len(words[-1])
                if held >= GROUP_WORDS:
                    yield made(docs, words)
                    docs, words, held = [], [], 0
            if docs:
                yield made(docs, words)

    return run


def _normal(batches):
    import hashlib

    import pyarrow as pa

    from taproom.llm.common import texts

    for batch in batches:
        normal = [b" ".join(words_of(t)) for t in texts(batch.column(0))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([hashlib.sha256(t).digest() for t in normal], pa.binary()), pa.array(normal, pa.binary())],
            ["digest", "words"],
        )


def _alike(least: int):
    """Of (a, b, marks of a, marks of b) the pairs with enough equal coordinates."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                one, two = (
                    np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3)
                )
                keep = (one == two).sum(axis=1) >= least
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _confirmed(size: int, percent: int):
    """Of (a, b, words of a, words of b) the pairs whose whole shingle sets are similar."""

    def run(batches):
        import pyarrow as pa

        def shingles(words):
            words = words.split(b" ")
            return set(zip(*[words[i:] for i in range(size)])) if len(words) >= size else {tuple(words)}

        last, held = None, None
        for batch in batches:
            keep = []
            for a, one, two in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if a != last:
                    last, held = a, shingles(one)
                other = shingles(two)
                both = len(held & other)
                keep.append(100 * both >= percent * (len(held) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _common(one, two, owner, code):
    """Numbers of common codes (one x two) of sets given as pairs (owner, code), by products of incidence matrices."""
    import numpy as np

    _, code, held = np.unique(code, return_inverse=True, return_counts=True)
    shared = held[code] > 1
    _, code = np.unique(code[shared], return_inverse=True)
    owner, order = owner[shared], np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    row = np.full((2, max(one.max(), two.max()) + 1), -1)
    row[0, one], row[1, two] = np.arange(len(one)), np.arange(len(two))
    out = np.zeros((len(one), len(two)), np.int64)
    for begin in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        part = slice(*np.searchsorted(code, [begin, begin + COLUMNS]))
        found = []
        for side, n in ((0, len(one)), (1, len(two))):
            at = row[side, owner[part]]
            matrix = np.zeros((n, COLUMNS), np.float32)
            matrix[at[at >= 0], code[part][at >= 0] - begin] = 1
            found.append(matrix)
        out += np.rint(found[0] @ found[1].T).astype(np.int64)
    return out


def _tile(least: int, size: int, percent: int):
    """Links of a tile, (id, comp, marks, words, left), that join different components, confirmed on the whole sets.

    Rows of the left side meet the others; links within what these links have joined already are left out.
    """

    def run(rows):
        from collections import defaultdict

        import numpy as np
        import pyarrow as pa

        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        left = np.array(rows.column("left").to_pylist(), bool)
        ids, comp = (rows.column(c).to_numpy() for c in ("id", "comp"))
        marks = np.frombuffer(b"".join(rows.column("marks").to_pylist()), np.uint8).reshape(len(ids), -1)
        one, two = np.nonzero(left)[0], np.nonzero(~left)[0]
        equal = np.zeros((len(one), len(two)), np.int16)
        for i in range(marks.shape[1]):
            equal += marks[one, i][:, None] == marks[two, i][None, :]
        near = (equal >= least) & (comp[one][:, None] != comp[two][None, :])
        rows_, columns = near.any(axis=1), near.any(axis=0)
        if not rows_.any():
            return none
        one, two, near = one[rows_], two[columns], near[rows_][:, columns]
        needed = np.zeros(len(ids), bool)
        needed[one] = needed[two] = True
        words = [w.split(b" ") if n else [] for w, n in zip(rows.column("words").to_pylist(), needed)]
        known = defaultdict()
        known.default_factory = lambda: len(known) + 1
        lengths = np.array([len(w) for w in words], np.int64)
        owner, _, code, sizes = shingle_codes(
            np.fromiter((known[x] for w in words for x in w), np.int64, int(lengths.sum())), lengths, size
        )
        order = np.lexsort((code, owner))
        owner, code = owner[order], code[order]
        first = np.ones(len(code), bool)
        first[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
        both = _common(one, two, owner[first], code[first])
        near &= 100 * both >= percent * (sizes[one][:, None] + sizes[two][None, :] - both)
        root, out = {}, []

        def find(x):
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        for x, y in zip(*(v.tolist() for v in np.nonzero(near))):
            x, y = one[x], two[y]
            a, b = find(int(comp[x])), find(int(comp[y]))
            if a != b:
                root[a] = b
                out.append((int(ids[x]), int(ids[y])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _pairs(first: str, second: str) -> list:
    return [F.least(first, second).alias("a"), F.greatest(first, second).alias("b")]


def _sided(pairs: DataFrame, found: DataFrame, what: str) -> DataFrame:
    """(a, b, what of a, what of b)."""
    one = found.select(F.col("id").alias("a"), F.col(what).alias("of_a"))
    two = found.select(F.col("id").alias("b"), F.col(what).alias("of_b"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "of_a", "of_b")


def _open(near: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows (key, id, comp) of the buckets that still hold several components."""
    if labels is None:
        return near.withColumn("comp", F.col("id"))
    named = near.join(labels, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    open_ = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"))
    # Of two rows each has been compared with the other.
    return named.join(open_.where("lo < hi AND n > 2").select("key"), "key")


def _rest(rows: DataFrame, classes: DataFrame, normal: DataFrame, linked, least: int, size: int, percent: int, tile: int, small: int) -> DataFrame:
    """Links (a, b) that join what is still apart, out of all pairs of the buckets.

    Small buckets are joined with themselves. Large ones that share rows form a group; all its rows outside
    the group's largest component meet all its rows once, tile by tile, and only links leave a tile.
    """
    sized = stored(rows.join(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("head")), "key"), "open")
    few = sized.where(F.col("n") <= small)
    pairs = few.select("key", F.col("id").alias("x"), F.col("comp").alias("cx")).join(
        few.select("key", F.col("id").alias("y"), F.col("comp").alias("cy")), "key"
    ).where("x < y AND cx <> cy").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    met = linked(_sided(pairs, classes, "marks").mapInArrow(_alike(least), "a long, b long"))
    many = sized.where(F.col("n") > small)
    groups = components(many.select(F.col("id").alias("a"), F.col("head").alias("b")))
    held = many.select("id", "comp").distinct().join(groups.select(F.col("node").alias("id"), F.col("root").alias("grp")), "id")
    held = stored(held.join(classes.select("id", "n_shingles"), "id"), "groups")
    sizes = held.groupBy("grp", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    sizes = sizes.groupBy("grp").agg(
        F.max_by("comp", F.struct("n", "comp")).alias("top"),
        *[(F.sum(c) - F.max_by(c, F.struct("n", "comp"))).alias(f"rest_{c}") for c in ("n", "w")],
        *[F.sum(c).alias(f"all_{c}") for c in ("n", "w")],
    ).where("rest_n > 0")
    lefts, rights = (
        F.greatest(F.ceil(F.col(f"{side}_n") / tile), F.ceil(F.col(f"{side}_w") / (tile * TILE_SHINGLES))).cast("int")
        for side in ("rest", "all")
    )
    sizes = sizes.select("grp", "top", lefts.alias("lefts"), rights.alias("rights"))
    held = held.join(sizes, "grp").join(classes.select("id", "marks"), "id").join(normal, "id")

    def dealt(seed, pieces):
        return F.pmod(F.xxhash64("id", F.lit(seed)), pieces).cast("int")

    left = held.where("comp <> top").select(
        "grp", "id", "comp", "marks", "words", F.lit(True).alias("left"),
        dealt(1, F.col("lefts")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("j"),
    )
    right = held.select(
        "grp", "id", "comp", "marks", "words", F.lit(False).alias("left"),
        F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"), dealt(2, F.col("rights")).alias("j"),
    )
    tiles = left.unionByName(right).groupBy("grp", "i", "j").applyInArrow(_tile(least, size, percent), "a long, b long")
    return met.unionByName(stored(tiles, "links"))


def similar_sets(
    docs: DataFrame,
    size: int = SHINGLE,
    percent: int = PERCENT,
    bands: int = BANDS,
    width: int = WIDTH,
    leaders: int = LEADERS,
    tile: int = TILE,
    small: int = SMALL,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents whose sets of distinct `size`-word shingles have a Jaccard similarity of `percent` hundredths or more
    are linked. Null text counts as empty; a text without words has no shingles and is linked with nothing.
    Every row is judged by its own text: rows that repeat a doc_id may lie in different components. A null
    doc_id is never the one that stays unless no row of its component has an id; then all its rows stay. Other columns
    are ignored; an empty table gives an empty result. Texts of equal words are one row while links are sought.
    """
    least = least_equal(percent, bands * width)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = rows.mapInArrow(
        _sketch(size, bands, width), "doc_id long, digest binary, n_shingles long, keys array<long>, marks binary"
    )
    sketched = stored(sketched, "sketches")
    # The ids are those of the written table, so they hold for all that reads it.
    classes = stored(
        sketched.where("n_shingles > 0").groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("keys").alias("keys"), F.any_value("marks").alias("marks"))
        .withColumn("id", F.monotonically_increasing_id()),
        "classes",
    )
    members = classes.select("id", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    near = stored(members.join(shared, "key"), "buckets")
    wanted = near.select("id").distinct().join(classes.select("id", "digest"), "id")
    normal = docs.select(F.col("text").cast("string")).mapInArrow(_normal, "digest binary, words binary")
    normal = stored(
        normal.join(wanted, "digest").groupBy("id").agg(F.any_value("words").alias("words")), "words"
    )

    def linked(pairs: DataFrame) -> DataFrame:
        return stored(_sided(pairs, normal, "words").mapInArrow(_confirmed(size, percent), "a long, b long"), "links")

    labels = None

    def joined(links: DataFrame) -> DataFrame:
        edges = links if labels is None else links.unionByName(labels.select(F.col("id").alias("a"), F.col("comp").alias("b")))
        return components(edges).select(F.col("node").alias("id"), F.col("root").alias("comp"))

    for turn in range(leaders):
        rows_ = _open(near, labels)
        order = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
        if labels is not None:
            rows_ = stored(rows_, "open")
            near = rows_.select("key", "id")
        leader = rows_.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("id"), F.col("comp"))).alias("l"))
        leader = leader.select("key", F.col("l.id").alias("leader"), F.col("l.comp").alias("leads"))
        pairs = rows_.join(leader, "key").where("comp <> leads").select(*_pairs("id", "leader")).distinct()
        passed = _sided(pairs, classes, "marks").mapInArrow(_alike(least), "a long, b long")
        links = linked(passed)
        if not links.isEmpty():
            labels = joined(links)
    rest = _open(near, labels) if labels is not None else near.withColumn("comp", F.col("id"))
    links = _rest(rest, classes, normal, linked, least, size, percent, tile, small)
    if not links.isEmpty():
        labels = joined(links)
    named = classes.select("id", "digest", "rep")
    if labels is not None:
        named = named.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        smallest = named.groupBy("comp").agg(F.min("rep").alias("component"))
        named = named.join(smallest, "comp")
    else:
        named = named.withColumn("component", F.col("rep"))
    named = stored(named.select("digest", "component"), "components")
    found = sketched.where("n_shingles > 0").select("doc_id", "digest", "n_shingles").join(named, "digest")
    alone = sketched.where("n_shingles = 0").withColumn("component", F.col("doc_id"))
    both = found.select("doc_id", "n_shingles", "component").unionByName(alone.select("doc_id", "n_shingles", "component"))
    return both.select(
        "doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept")
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return similar_sets(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]'),
         lambda x: x <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM texts WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT p.x, p.y
  FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL) p
  JOIN sizes s ON s.doc_id = p.x JOIN sizes t ON t.doc_id = p.y
  WHERE 100 * shared >= 85 * (s.n + t.n - shared)
), reach AS (
  SELECT doc_id, doc_id AS root FROM texts
  UNION
  SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.root
)
SELECT r.doc_id, any_value(coalesce(s.n, 0)) AS n_shingles, min(r.root) AS component_id, r.doc_id = min(r.root) AS kept
FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id
GROUP BY r.doc_id
"""
