r"""Phrase collocations by dynamic itemset counting over cyclic shard scans.

Texts become blocks of word numbers, dealt over shards. Every step scans one shard, round and round, and counts
phrases of all lengths at once: words from the first step on, a longer phrase from the step after both its
subphrases (all words but the last, all but the first) have reached the threshold, until it has been counted over
one full cycle. A phrase that reaches the threshold contains only phrases that reach it, so none is missed.

Which phrases have reached the threshold, and in which step, is told to the scans by a table of a fixed number of
slots. A slot is written once, with the step. Two slots that happen to be taken let a phrase be counted that
needn't be, never the other way round; a phrase starts in the step after the last of the slots of all phrases it
contains was taken. These no longer change, so it is counted in each shard exactly once all the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from taproom.llm.common import stored, table

LONGEST = 5
SHARDS = 2  # of more shards a phrase is carried on through more steps before its cycle is over
SLOTS = 1 << 24  # bytes of the slot table that every scan gets, whatever the size of the corpus
BLOCK_WORDS = 1 << 19  # words of one language that a task encodes and counts at a time; a longer text is one block
SALTS = 16
NEVER = 255  # in the slot table: not reached. Steps over 254 do not occur: a cycle a length at most
BITMAP = 1 << 15  # slots of one bitmap of Spark's


def _encode(shards: int, block_words: int):
    """Batches of (lang, text) into blocks: the distinct words, and their numbers with -1 between pieces."""
    upper = bytes(range(65, 91))
    folded = bytes.maketrans(upper + b".,;:!?\x0b\x0c\r\t", upper.lower() + b"\n" * 9 + b" ")

    def run(batches):
        from collections import defaultdict

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from taproom.llm.common import texts

        made = TaskContext.get().partitionId()
        numbers, runs, sizes = {}, defaultdict(list), defaultdict(int)

        def block(lang):
            nonlocal made
            ids = np.concatenate(runs.pop(lang))
            known = numbers.pop(lang)
            del known[b"\n"]
            row = {
                "shard": [made % shards], "lang": [lang], "words": [b" ".join(known)],
                "ids": [ids.tobytes()], "n": [int((ids >= 0).sum())],
            }
            made += 1
            del sizes[lang]
            return pa.RecordBatch.from_pydict(row, SCHEMA)

        SCHEMA = pa.schema(
            [("shard", pa.int32()), ("lang", pa.string()), ("words", pa.binary()), ("ids", pa.binary()), ("n", pa.int64())]
        )
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                known = numbers.get(lang)
                if known is None:
                    known = numbers[lang] = defaultdict()
                    known.default_factory = lambda known=known: len(known) - 1
                    known[b"\n"]  # noqa: B018 - the boundary gets the number -1
                words = text.translate(folded).replace(b"\n", b" \n ").split(b" ")
                runs[lang].append(np.fromiter((known[w] for w in words if w), np.int32))
                runs[lang].append(np.full(1, -1, np.int32))
                sizes[lang] += len(runs[lang][-2])
                if sizes[lang] >= block_words:
                    yield block(lang)
        for lang in list(runs):
            yield block(lang)

    return run


def _word_hashes(lang, words):
    import numpy as np
    import xxhash

    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def _longer(head, last):
    """Hashes of phrases one word longer: those of all words but the last, and those of the last words."""
    import numpy as np

    mixed = head * np.uint64(0x9E3779B97F4A7C15) + last
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _slots(hashes, slots: int):
    import numpy as np

    mask = np.uint64(slots - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


def _count(step: int, shards: int, longest: int, shared, slots: int):
    """Counts of a block's phrases that are under way in this step, with the step they started in."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        taken = shared.value if shared is not None else None

        def reached(hashes):
            if taken is None:
                return np.full(len(hashes), NEVER, np.int32)
            one, two = _slots(hashes, slots)
            return np.maximum(taken[one], taken[two]).astype(np.int32)

        def rows(lang, names, size, start, counts):
            n = len(counts)
            for at in range(0, n, 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(counts[part]), pa.string()),
                        names[part].cast(pa.string()),
                        pa.array(np.full(len(counts[part]), size, np.int32)),
                        pa.array(start[part].astype(np.int32)),
                        pa.array(counts[part].astype(np.int64)),
                    ],
                    ["lang", "phrase", "size", "start", "n"],
                )

        def block(lang, words, ids):
            vocabulary = words.split(b" ") if words else []
            if not vocabulary:
                return
            names = pa.array(vocabulary, pa.binary())
            hashes = _word_hashes(lang, vocabulary)
            if step < shards:
                counts = np.bincount(ids[ids >= 0], minlength=len(vocabulary))
                yield from rows(lang, names, 1, np.zeros(len(counts)), counts)
            since = reached(hashes)
            # Of every phrase that has reached the threshold: place of its first word, hash, step.
            at = np.nonzero((ids >= 0) & (since[ids] < NEVER))[0]
            mixed, since = hashes[ids[at]], since[ids[at]]
            for size in range(2, longest + 1):
                follows = np.nonzero(np.diff(at) == 1)[0]
                start = np.maximum(since[follows], since[follows + 1]) + 1
                begun = start <= step
                follows, start = follows[begun], start[begun]
                if not len(follows):
                    return
                head, at = mixed[follows], at[follows]
                under_way = start > step - shards
                if under_way.any():
                    places, code = at[under_way], ids[at[under_way]].astype(np.int64)
                    for i in range(1, size):
                        if i > 1:
                            _, code = np.unique(code, return_inverse=True)  # keeps the product within 64 bits
                        code = code * len(vocabulary) + ids[places + i]
                    _, first, counts = np.unique(code, return_index=True, return_counts=True)
                    phrase = pc.binary_join_element_wise(*[names.take(pa.array(ids[places[first] + i])) for i in range(size)], b" ")
                    yield from rows(lang, phrase, size, start[under_way][first], counts)
                if size < longest:
                    mixed = _longer(head, hashes[ids[at + size - 1]])
                    # Its slots may be taken before its words have reached it: it counts as reached when all of it has.
                    since = np.maximum(reached(mixed), start - 1)
                    known = since < NEVER
                    at, mixed, since = at[known], mixed[known], since[known]

        for batch in batches:
            for lang, words, ids in zip(*(c.to_pylist() for c in batch.columns)):
                yield from block(lang, words, np.frombuffer(ids, np.int32))

    return run


def _phrase_slots(slots: int):
    """The slots of phrases (lang, phrase)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _word_hashes(lang, phrase.encode().split(b" "))
                mixed = words[:1]
                for i in range(1, len(words)):
                    mixed = _longer(mixed, words[i : i + 1])
                found += _slots(mixed, slots)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.empty(0, np.int64))], ["slot"])

    return run


def _take(taken, fresh: DataFrame, step: int, slots: int) -> bool:
    """Write the step into all free slots of the phrases, at most one bit a slot comes to the driver; if any was free."""
    import numpy as np

    bits = fresh.select("lang", "phrase").mapInArrow(_phrase_slots(slots), "slot long")
    maps = bits.groupBy(F.expr("slot div 32768").alias("part")).agg(
        F.bitmap_construct_agg(F.expr("slot % 32768")).alias("bits")
    )
    for row in maps.toLocalIterator():
        begin = row["part"] * BITMAP
        hit = np.nonzero(np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little"))[0] + begin
        taken[hit[taken[hit] == NEVER]] = step
    return bool((taken == step).any())


def blocks_of(docs: DataFrame, shards: int = SHARDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The texts as blocks of word numbers, written by shard: shard, lang, words, ids, n (its words)."""
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")
    )
    return stored(rows.mapInArrow(_encode(shards, block_words), "shard int, lang string, words binary, ids binary, n long"), "blocks")


def frequent_phrases(
    blocks: DataFrame, least: int, longest: int = LONGEST, shards: int = SHARDS, slots: int = SLOTS
) -> DataFrame:
    """lang, phrase, size, n of every phrase of at most `longest` words with n >= least occurrences.

    `slots` is a power of two. A full slot table costs time alone: more phrases are counted than need be.
    """
    import numpy as np

    if slots % BITMAP or slots & (slots - 1):
        raise ValueError("slots is a power of two from 32768 up")
    context = blocks.sparkSession.sparkContext
    taken = np.full(slots, NEVER, np.uint8)
    shared, totals, last, step = None, None, 0, 0
    while step < shards or step <= last + shards:
        shard = blocks.where(F.col("shard") == step % shards).select("lang", "words", "ids")
        counted = shard.mapInArrow(
            _count(step, shards, longest, shared, slots), "lang string, phrase string, size int, start int, n long"
        ).withColumn("reached", F.lit(None).cast("int"))
        if totals is not None:
            counted = counted.unionByName(totals)
        summed = counted.groupBy("lang", "phrase").agg(
            F.min("size").alias("size"), F.min("start").alias("start"), F.sum("n").alias("n"), F.min("reached").alias("reached")
        )
        here = F.coalesce("reached", F.when(F.col("n") >= least, F.lit(step)))
        done = F.col("start") + (shards - 1) <= step
        totals = stored(summed.withColumn("reached", here).where(F.col("reached").isNotNull() | ~done), "phrases")
        fresh = totals.where((F.col("reached") == step) & (F.col("size") < longest))
        if _take(taken, fresh, step, slots):  # else nothing new can start: phrases start by slots alone
            last = step
            if shared is not None:
                shared.unpersist()
            shared = context.broadcast(taken.copy())
        step += 1
    return totals.where("reached IS NOT NULL").select("lang", "phrase", "size", "n")


def floor_score(a: Column, left: Column, right: Column, n: Column) -> Column:
    """floor(1000 a n / (l r)), exact: products are decimals of 38 digits."""
    wide = [c.cast("decimal(19,0)") for c in (a, n, left, right)]
    top = (wide[0] * F.lit(1000).cast("decimal(4,0)")).cast("decimal(19,0)") * wide[1]
    return F.call_function("div", top.cast("decimal(38,0)"), (wide[2] * wide[3]).cast("decimal(38,0)"))


def collocations(
    docs: DataFrame,
    least: int = 100,
    longest: int = LONGEST,
    top: int = 2000,
    covered: int = 100,
    shards: int = SHARDS,
    slots: int = SLOTS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language.

    Everything is counted within a language; a null lang is `und`, null text is empty and holds no words. Rows
    that repeat count as often as they come. A phrase is dropped if a longer one that holds it has at least
    `covered` hundredths of its occurrences. A phrase scores by its worst cut, the first of them in a tie. Other columns
    of `docs` are ignored; an empty table, or one without frequent phrases, gives an empty result.
    """
    blocks = blocks_of(docs, shards, block_words)
    counts = stored(frequent_phrases(blocks, least, longest, shards, slots), "frequent")
    words = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    candidates = counts.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    parts = F.split("phrase", " ")

    def joined(begin, length):
        return F.array_join(F.slice(parts, begin, length), " ")

    lengths = F.sequence(F.lit(2), F.col("size") - 1)
    inner = candidates.where("size > 2").select("lang", "phrase", "size", "a", F.explode(lengths).alias("k"))
    inner = inner.select("lang", "phrase", "a", "k", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)).alias("i"))
    holders = inner.select("lang", joined(F.col("i"), F.col("k")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = candidates.join(holders, ["lang", "phrase"], "left").where(
        F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * covered)
    )
    cuts = kept.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"),
    )
    heads = counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    scored = cuts.join(heads, ["lang", "first"]).join(tails, ["lang", "rest"]).join(words, "lang")
    scored = scored.withColumn("score", floor_score(F.col("a"), F.col("l"), F.col("r"), F.col("n")))
    worst = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    flat = worst.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = flat.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of every language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\n\x0B\f\r]')) AS piece FROM docs)
), words AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang
), grams AS (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM pieces, range(1, 6) AS s(size) WHERE len(w) >= size)
), f AS (
  SELECT lang, phrase, any_value(size) AS size, count(*) AS a FROM grams GROUP BY lang, phrase HAVING count(*) >= 100
), held AS (
  SELECT lang, array_to_string(p[i : i + k - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, a, k, p, unnest(range(1, len(p) - k + 2)) AS i
        FROM (SELECT lang, a, string_split(phrase, ' ') AS p, unnest(range(2, size)) AS k FROM f WHERE size > 2))
  GROUP BY ALL
), kept AS (
  SELECT f.lang, f.phrase, f.size, f.a, string_split(f.phrase, ' ') AS p
  FROM f LEFT JOIN held USING (lang, phrase) WHERE f.size > 1 AND (most IS NULL OR 100 * most < 100 * f.a)
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(p[1 : k], ' ') AS head, array_to_string(p[k + 1 :], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, h.a AS l, t.a AS r, words.n,
         CAST(1000 * c.a::HUGEINT * words.n::HUGEINT // (h.a::HUGEINT * t.a::HUGEINT) AS BIGINT) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail
  JOIN words ON words.lang = c.lang
), worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM worst QUALIFY rank <= 2000
"""
