"""SimHash near-duplicates: bit planes, carry-save counters and exact candidate keys.

Two fingerprints of 64 bits that differ in at most three bits agree on one of four bands of sixteen, and
on one of four bands of twelve among the other 48 bits. So the sixteen (band, band) keys bring every
pair within the radius together. Rows of equal key are compared in blocks of vertical bit planes; a
block of pairs is given up as soon as every counter has passed the radius.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taproom.llm.common import stored, table, texts

SHINGLE = 3
SEED = 42
RADIUS = 3
TILE = 4096  # rows of one key compared in one block; larger keys are compared tile by tile
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _fingerprints(shingle: int, seed: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh64_intdigest
        byte_bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for row, text in enumerate(texts(batch.column(1))):
                words = text.translate(LOWER).split()
                n = len(words)
                if not n:
                    continue
                joined = b" ".join(words)
                if n <= shingle:
                    out[row] = digest(joined, seed)
                    continue
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
                first = np.r_[0, ends[: n - shingle]].tolist()
                hashes = np.fromiter(
                    (digest(joined[a:b], seed) for a, b in zip(first, (ends[shingle - 1 :] - 1).tolist())),
                    np.uint64, n - shingle + 1,
                )
                lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
                votes = np.stack([np.bincount(lanes[:, k], minlength=256) @ byte_bits for k in range(8)])
                set_ = (2 * votes > len(hashes)).astype(np.uint8).reshape(-1)
                out[row] = np.packbits(set_, bitorder="little").view("<u8")[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp, the 64-bit SimHash of the word shingles, repeats included, as a signed long.

    A-Z are lower-cased, words end at ASCII white space; fewer words than a shingle count as one
    shingle, a text without words or null has fingerprint zero. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(_fingerprints(shingle, seed), "doc_id long, fp long")


def _keys(fp):
    """The sixteen keys of a fingerprint, each telling its bands and their values."""
    out = []
    for band in range(4):
        value = F.shiftrightunsigned(fp, 16 * band).bitwiseAND(F.lit(0xFFFF).cast("long"))
        low = fp.bitwiseAND(F.lit((1 << 16 * band) - 1).cast("long"))
        if band < 3:
            high = F.shiftleft(F.shiftrightunsigned(fp, 16 * (band + 1)), 16 * band)
            rest = low.bitwiseOR(high)
        else:
            rest = low
        for inner in range(4):
            part = F.shiftrightunsigned(rest, 12 * inner).bitwiseAND(F.lit(0xFFF).cast("long"))
            key = F.shiftleft(value, 12).bitwiseOR(part)
            out.append(key.bitwiseOR(F.lit((4 * band + inner) << 28).cast("long")))
    return F.array(*out)


def near_pairs(prints, rows: int = 128, radius: int = RADIUS):
    """Blocks of index pairs (i < j) of fingerprints that differ in at most `radius` bits.

    `prints` has a row for each fingerprint and a column of 64 bits for each of its lanes.
    """
    import numpy as np

    n, lanes = prints.shape
    width, size = -(-n // 64) * 64, 64 * lanes
    bits = np.zeros((width, size), np.uint8)
    bits[:n] = np.unpackbits(
        np.ascontiguousarray(prints).astype("<u8").view(np.uint8).reshape(n, -1), axis=1, bitorder="little"
    )
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")  # a row of words per bit
    padding = np.packbits(np.arange(width) >= n, bitorder="little").view("<u8")
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    digits = radius.bit_length()
    for at in range(0, n, rows):
        asked = bits[at : min(at + rows, n)]
        from_word = at // 64  # pairs of a row with earlier rows were met before
        here = planes[:, from_word:]
        shape = (len(asked), here.shape[1])
        counters = [np.zeros(shape, np.uint64) for _ in range(digits)]
        over = np.repeat(padding[None, from_word:], len(asked), axis=0)
        for plane in range(size):
            flip = (0 - asked[:, plane].astype(np.int64)).view(np.uint64)[:, None]
            carry = here[plane][None, :] ^ flip
            for digit in range(digits):  # carry-save: add one bit to every counter at once
                counters[digit], carry = counters[digit] ^ carry, counters[digit] & carry
            over |= carry
            if plane % 8 == 7 and plane >= radius:
                if radius + 1 < 1 << digits and plane % 32 == 31:
                    over |= _above(counters, radius)
                if (over == full).all():
                    break
        else:
            if radius + 1 < 1 << digits:  # counters that passed the radius without a last carry
                over |= _above(counters, radius)
            close = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")
            i, j = np.nonzero(close)
            i, j = i + at, j + 64 * from_word
            good = (i < j) & (j < n)
            if good.any():
                yield i[good], j[good]


def _above(counters, radius: int):
    """Words whose counters, given digit by digit, are larger than the radius."""
    import numpy as np

    more = np.zeros_like(counters[0])
    same = ~np.zeros_like(counters[0])
    for digit in reversed(range(len(counters))):
        if radius >> digit & 1:
            same &= counters[digit]
        else:
            more |= same & counters[digit]
            same &= ~counters[digit]
    return more


def joined_roots(n: int, pairs):
    """For each of n rows the smallest row it is joined with by blocks of pairs."""
    import numpy as np

    root = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = root[a], root[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            if (low == high).all():
                break
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
    return root


def _compare(radius: int, block: int, lanes: int):
    pairs_of, roots_of = near_pairs, joined_roots

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def read(column):
            if lanes == 1:
                return column.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)
            return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, lanes)

        def write(prints):
            if lanes == 1:
                return pa.array(np.ascontiguousarray(prints).view(np.int64).reshape(-1))
            return pa.array([x.tobytes() for x in prints], pa.binary())

        def links(prints):
            prints = np.unique(prints, axis=0)
            root = roots_of(len(prints), pairs_of(prints, radius=radius))
            child = np.flatnonzero(root != np.arange(len(prints)))
            return pa.RecordBatch.from_arrays([write(prints[child]), write(prints[root[child]])], ["a", "b"])

        def shared(keys, prints):
            """Rows whose key occurs more than once; keys are in order."""
            twice = np.flatnonzero(keys[1:] == keys[:-1])
            keep = np.zeros(len(keys), bool)
            keep[twice] = keep[twice + 1] = True
            return keys[keep], prints[keep]

        def blocks(keys, prints):
            """Whole keys together, about a block of rows at a time."""
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            at = 0
            while at < len(keys):
                stop = starts[np.searchsorted(starts, at + block) :]
                end = int(stop[0]) if len(stop) else len(keys)
                yield prints[at:end]
                at = end

        held_k, held_p, ready = np.zeros(0, np.int64), np.zeros((0, lanes), np.uint64), []
        for batch in batches:
            keys = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False)])
            prints = np.concatenate([held_p, read(batch.column(1))])
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last key may go on
            ready.append(shared(keys[:cut], prints[:cut]))
            held_k, held_p = keys[cut:], prints[cut:]
            if sum(len(k) for k, _ in ready) >= 4 * block:
                for part in blocks(*map(np.concatenate, zip(*ready))):
                    yield links(part)
                ready = []
        ready.append(shared(held_k, held_p))
        for part in blocks(*map(np.concatenate, zip(*ready))):
            yield links(part)

    return run


def close_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE, block: int = 1024) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join all that are within the radius."""
    return _links(prints.select(F.explode(_keys(F.col("fp"))).alias("key"), "fp"), "long", 1, radius, tile, block)


def _links(keyed: DataFrame, kind: str, lanes: int, radius: int, tile: int, block: int) -> DataFrame:
    """Links between the fingerprints that share a key and lie within the radius.

    Within a block of comparisons only a spanning forest leaves the task: every pair within the radius
    is joined by links, while their number stays below the rows compared. A key with more than `tile`
    rows is dealt into tiles and each pair of tiles is a block of its own.
    """
    large = keyed.groupBy("key").count().where(F.col("count") > tile)
    large = large.select("key", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    dealt = keyed.join(large, "key", "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("tiles"), F.lit(1)) - 1))
    pairs = dealt.withColumn("other", other).select(
        F.when(F.col("tiles").isNull(), F.col("key")).otherwise(
            F.xxhash64("key", F.least(mine, "other"), F.greatest(mine, "other"))
        ).alias("key"),
        "fp",
    )
    return pairs.repartition("key").sortWithinPartitions("key").mapInArrow(
        _compare(radius, block, lanes), f"a {kind}, b {kind}"
    ).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node it is joined with, for every node of links (a, b).

    Rounds of large and small stars: every node is tied to the smallest of its neighbours until nothing
    changes. Each round is a written table.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )

    def state(frame):
        row = frame.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    seen = state(edges)
    while seen[0]:
        both = edges.union(edges.select("v", "u"))
        # The minima are written, so that the joins read plain shuffles and a hot node can be split.
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = stored(large.where("u <> v").distinct(), "large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("low")), "low")
        small = large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        small = small.union(low.select("u", "low")).distinct()
        edges = stored(small, "links")
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_groups(
    docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS, tile: int = TILE
) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest doc_id joined with it).

    Documents of one fingerprint are one class whatever their number; null doc_ids never name a group
    unless it has no other. Repeated rows are all returned; an empty table gives an empty result.
    The keys are exact for a radius of at most three.
    """
    _exact_radius(radius)
    rows = stored(fingerprints(docs, shingle, seed), "fingerprints")
    return rows.join(_classes(rows, lambda prints: close_links(prints, radius, tile)).drop("root"), "fp").select(
        "doc_id", "fp", "component_id"
    )


def _exact_radius(radius: int) -> None:
    if radius > 3:
        raise ValueError("the candidate keys are exact up to a radius of three")


def _classes(rows: DataFrame, links_of) -> DataFrame:
    """fp, root (a print that names its group) and component_id of stored rows doc_id, fp, with the links
    between distinct prints."""
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    found = components(links_of(prints.select("fp"))).withColumnRenamed("node", "fp")
    tied = prints.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = stored(tied.groupBy("root").agg(F.min("first").alias("component_id")), "names")
    return stored(tied.join(named, "root").select("fp", "root", "component_id"), "classes")


# Similar texts: their distinct shingles have a Jaccard similarity of four fifths or more. Candidates share a
# band of MinHash values and lie within the radius on four lanes of 64 bits; links are checked on the shingles.
SIMILAR = (4, 5)  # numerator and denominator of the least similarity
LANES = 4
SIMILAR_RADIUS = 80  # texts at four fifths differ in 39 of 256 bits, six more or less; in 48 with four or five shingles
BANDS = 32
BAND_ROWS = 4
CHECKED = 512  # texts of one group checked in one block; larger groups are checked block by block


def _shingle_hashes(shingle: int, seed: int):
    """A function from a text (bytes) to the sorted hashes of its distinct shingles."""
    lower = LOWER

    def hashes(text):
        import numpy as np
        import xxhash

        digest = xxhash.xxh64_intdigest
        words = text.translate(lower).split()
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        first = np.r_[0, ends[: max(0, n - shingle)]].tolist()
        last = (ends[min(shingle, n) - 1 :] - 1).tolist()
        return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip(first, last)), np.uint64, len(last)))

    return hashes


def _wide_prints(shingle: int, seed: int, lanes: int, bands: int, band_rows: int):
    hashes_of, text_bytes = _shingle_hashes(shingle, seed), texts

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa
        import xxhash

        byte_bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
        step = (np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        draw = np.random.default_rng(7)
        odd = draw.integers(0, 2**64, bands * band_rows, dtype=np.uint64) | np.uint64(1)
        plus = draw.integers(0, 2**64, bands * band_rows, dtype=np.uint64)

        def mixed(hashes):
            """Further lanes from one hash, by a bijective mixing of its bits."""
            z = hashes[:, None] + step
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return z ^ (z >> np.uint64(31))

        def keys_of(hashes):
            """A key per band, of the least values of the shingles in its orders."""
            least = np.full(bands * band_rows, 2**64 - 1, np.uint64)
            for at in range(0, len(hashes), 512):
                z = hashes[at : at + 512, None] * odd + plus
                least = np.minimum(least, (z ^ (z >> np.uint64(32))).min(axis=0))
            raw, size = least.tobytes(), 8 * band_rows
            return np.array([xxhash.xxh64_intdigest(raw[k * size : (k + 1) * size], k) for k in range(bands)], np.uint64)

        for batch in batches:
            prints, digests, keys = [], [], []
            for text in text_bytes(batch.column(1)):
                digests.append(hashlib.sha256(text).digest())
                hashes = hashes_of(text)
                keys.append(keys_of(hashes))
                if not len(hashes):
                    prints.append(bytes(8 * lanes))
                    continue
                view = np.ascontiguousarray(mixed(hashes)).astype("<u8").view(np.uint8).reshape(len(hashes), -1)
                votes = np.stack([np.bincount(view[:, k], minlength=256) @ byte_bits for k in range(8 * lanes)])
                prints.append(np.packbits((2 * votes > len(hashes)).astype(np.uint8).reshape(-1), bitorder="little").tobytes())
            flat = np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(digests) + 1, dtype=np.int32) * bands), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(prints, pa.binary()), keys],
                ["doc_id", "digest", "fp", "keys"],
            )

    return run


def similar_roots(sets, least=SIMILAR):
    """For each set of hashes the smallest row it is joined with by pairs of the least similarity."""
    import numpy as np

    n, (over, under) = len(sets), least
    root = np.arange(n)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    kinds, flat = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    ends = np.cumsum(sizes)
    marked = np.zeros(len(kinds), bool)
    for i in range(n - 1):
        if (root == root[i]).all():
            break
        mine = flat[ends[i] - sizes[i] : ends[i]]
        marked[mine] = True
        shared = np.bincount(owner, marked[flat], minlength=n).astype(np.int64)
        marked[mine] = False
        close = under * shared >= over * (sizes + sizes[i] - shared)
        joined = np.unique(root[close])
        root[np.isin(root, joined)] = joined[0]
    return root


def _check(shingle: int, seed: int, least):
    """Links between the texts of equal block that join all pairs of the least similarity."""
    hashes_of, roots_of, text_bytes = _shingle_hashes(shingle, seed), similar_roots, texts

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def links(digests, sets):
            root = roots_of(sets, least)
            child = np.flatnonzero(root != np.arange(len(sets)))
            return pa.RecordBatch.from_arrays(
                [pa.array([digests[k] for k in child], pa.binary()), pa.array([digests[root[k]] for k in child], pa.binary())],
                ["a", "b"],
            )

        block, digests, sets = None, [], []
        for batch in batches:
            for mine, digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))):
                if mine != block:
                    if len(sets) > 1:
                        yield links(digests, sets)
                    block, digests, sets = mine, [], []
                digests.append(digest)
                sets.append(hashes_of(text))
        if len(sets) > 1:
            yield links(digests, sets)

    return run


def _near_first(shingle: int, seed: int, least):
    """Whether each text has the least similarity with the first of its group."""
    hashes_of, roots_of, text_bytes = _shingle_hashes(shingle, seed), similar_roots, texts

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            pairs = zip(text_bytes(batch.column(2)), text_bytes(batch.column(4)))
            near = [bool(roots_of([hashes_of(a), hashes_of(b)], least)[1] == 0) for a, b in pairs]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(near, pa.bool_())],
                ["root", "digest", "text", "first", "near"],
            )

    return run


def _checked_links(members: DataFrame, shingle: int, seed: int, least, tile: int) -> DataFrame:
    """Links (a, b) of digests that join all pairs of the least similarity within each root's texts.

    `members` are stored rows root, digest, text, one of each digest. A root with more than `tile` texts is
    first compared with one of them; texts that are near it are joined by it and need not be compared with
    each other, so only blocks with a text that is not near are left.
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.min("digest").alias("first"))
    sizes = stored(sizes.where("n > 1"), "sizes")
    check = _check(shingle, seed, least)
    block = F.sha2(F.concat("root", F.lit("/").cast("binary"), F.encode(F.concat_ws(",", "low", "high"), "utf-8")), 256)

    def blocks(rows):
        rows = rows.repartition("block").sortWithinPartitions("block")
        return rows.select("block", "digest", "text").mapInArrow(check, "a binary, b binary")

    small = members.join(sizes.where(F.col("n") <= tile), "root").select(F.hex("root").alias("block"), "digest", "text")
    large = stored(sizes.where(F.col("n") > tile), "large")
    found = blocks(small)
    if not large.take(1):
        return found.distinct()
    first = members.join(large.select(F.col("first").alias("digest")), "digest").select("root", F.col("text").alias("other"))
    first = stored(large.select("root", "first").join(first, "root"), "first")
    # Both sides are written, so that the join reads plain shuffles and a large root can be split.
    compared = members.join(first, "root").select("root", "digest", "text", "first", "other")
    compared = stored(
        compared.mapInArrow(_near_first(shingle, seed, least), "root binary, digest binary, text string, first binary, near boolean"),
        "near",
    )
    near = compared.where("near and digest <> first").select(F.col("digest").alias("a"), F.col("first").alias("b"))
    tiles = compared.groupBy("root").agg(
        F.ceil(F.count_if("near") / tile).cast("int").alias("inner"), F.ceil(F.count_if(~F.col("near")) / tile).cast("int").alias("outer")
    )
    tiles = stored(tiles.where("outer > 0"), "tiles")
    dealt = F.xxhash64("digest")
    mine = F.when(F.col("near"), F.pmod(dealt, F.col("inner"))).otherwise(F.col("inner") + F.pmod(dealt, F.col("outer")))
    begin = F.when(F.col("near"), F.col("inner")).otherwise(0)
    rows = compared.join(tiles, "root").withColumn("mine", mine.cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(begin, F.col("inner") + F.col("outer") - 1)))
    rows = rows.withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))
    return found.union(near).union(blocks(rows.withColumn("block", block))).distinct()


def similar_groups(
    docs: DataFrame,
    shingle: int = 5,
    seed: int = SEED,
    least: tuple = SIMILAR,
    radius: int = SIMILAR_RADIUS,
    lanes: int = LANES,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
    tile: int = TILE,
    checked: int = CHECKED,
) -> DataFrame:
    """One row per document: doc_id, digest (of its text), component_id, for texts joined by similar pairs.

    Two texts are a pair when their distinct word shingles have a Jaccard similarity of `least` or more,
    which is counted for every pair of a candidate group; shingles are compared by 64-bit hashes. Candidate
    groups are joined by SimHash within the radius among texts that share a MinHash band: a pair at 0.8
    shares none of 32 bands of four with a chance of 5 in 10^8, whatever its length, and lies beyond the
    radius with 6 in 10^7 at most (bits taken as independent). Texts without words are one group. Cases are defined as for `near_groups`.
    """
    rows, classes = _similar_classes(docs, shingle, seed, least, radius, lanes, bands, band_rows, tile, checked)
    return rows.join(classes, F.col("digest") == F.col("fp")).select("doc_id", "digest", "component_id")


def _similar_classes(docs, shingle, seed, least, radius, lanes, bands, band_rows, tile, checked):
    """Stored rows doc_id, digest, and the classes of these digests (as fp)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    rows = stored(
        source.mapInArrow(
            _wide_prints(shingle, seed, lanes, bands, band_rows), "doc_id long, digest binary, fp binary, keys array<long>"
        ),
        "fingerprints",
    )

    def links_of(_):
        keyed = rows.select(F.explode("keys").alias("key"), "fp").distinct()
        groups = components(_links(stored(keyed, "keys"), "binary", lanes, radius, tile, 256)).withColumnRenamed("node", "fp")
        nodes = rows.select("digest", "fp").distinct().join(groups, "fp", "left")
        nodes = stored(nodes.select("digest", F.coalesce("root", "fp").alias("root")), "nodes")
        several = stored(nodes.groupBy("root").count().where("count > 1").select("root"), "several")
        nodes = stored(nodes.join(several, "root", "left_semi"), "candidates")
        digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
        members = source.select(digest.alias("digest"), F.coalesce("text", F.lit("")).alias("text")).join(nodes, "digest")
        # Written before repeats are dropped, so that a text of many rows is split by the join and merged by every task.
        members = stored(stored(members, "texts").dropDuplicates(["digest"]).select("root", "digest", "text"), "members")
        return _checked_links(members, shingle, seed, least, checked)

    texts_of = rows.select("doc_id", "digest")
    return texts_of, _classes(texts_of.withColumnRenamed("digest", "fp"), links_of)


def drop_similar(
    docs: DataFrame,
    shingle: int = 5,
    seed: int = SEED,
    least: tuple = SIMILAR,
    radius: int = SIMILAR_RADIUS,
    lanes: int = LANES,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
    tile: int = TILE,
    checked: int = CHECKED,
) -> DataFrame:
    """One row of each group of similar texts, with all its columns: see `_first_of`."""
    rows, classes = _similar_classes(docs, shingle, seed, least, radius, lanes, bands, band_rows, tile, checked)
    return _first_of(docs, rows.withColumn("fp", F.col("digest")), classes)


def drop_near_copies(
    docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS, tile: int = TILE
) -> DataFrame:
    """One row of each group of near copies, with all its columns: see `_first_of`."""
    _exact_radius(radius)
    source = docs.select(_digest().alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = source.select(F.struct("doc_id", "digest").alias("who"), "text")
    rows = named.mapInArrow(_fingerprints(shingle, seed), "doc_id struct<doc_id: bigint, digest: binary>, fp long")
    rows = stored(rows.select("doc_id.doc_id", "doc_id.digest", "fp"), "fingerprints")
    return _first_of(docs, rows, _classes(rows.select("doc_id", "fp"), lambda prints: close_links(prints, radius, tile)))


def _digest():
    return F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))


def _first_of(docs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Of each group one row: that of the smallest doc_id, then of the smallest SHA-256 of its text.

    Every row is judged by its id and its own text, so rows that share a doc_id, or have none, may lie in
    different groups. A null doc_id stays only if no row of its group has one. Rows alike in id and text are
    one. `rows` are doc_id, digest and fp; the columns of `docs` may have any names.
    """
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    # Equal keys are merged by every task before they meet their group, so hot texts stay small.
    distinct = rows.groupBy("fp").agg(F.min(order).alias("best"))
    best = distinct.join(classes, "fp").groupBy("root").agg(F.min("best").alias("best"))
    kept = best.select(F.struct("best.doc_id", "best.digest").alias("key"))
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"))
    return (
        docs.select(key.alias("key"), F.struct("*").alias("row"))
        .join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
