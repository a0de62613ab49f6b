"""Benchmark decontamination with an FM-index over each shard of the corpus.

A shard is a bounded run of documents. Its words become numbers: the test words' own, and zero for every
word that no test item uses. A stretch between zeros that is shorter than the shortest phrase can hold
none, so only the other stretches are indexed. The index is a suffix array in numpy, its last column in
a wavelet matrix, and every sixteenth text position. All phrases are searched backward at once,
their places are found by walking to the next sampled position, and the spans are merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taproom.llm.common import rows_kept, table, texts

WINDOW = 13
SHARD_WORDS = 1_000_000
BLOCK_WORDS = 250_000  # test words searched at once
SAMPLE = 16

# Lower-case A-Z; all ASCII but letters and digits is a gap; bytes above stay.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def phrase_blocks(items, window: int = WINDOW, block_words: int = BLOCK_WORDS):
    """Blocks of test items as (words, phrases, owners): bounded, whatever the number of items.

    `words` numbers the block's words from 1, `phrases` is a list of number tuples, `owners` the item ids
    of each phrase. An item without words has no phrase; one shorter than the window is one phrase.
    """
    words, phrases, held = {}, {}, 0

    def block():
        return words, list(phrases), [sorted(x) for x in phrases.values()]

    for item_id, text in items:
        got = (text or "").encode().translate(WORD_BYTES).split()
        codes = [words.setdefault(w, len(words) + 1) for w in got]
        for at in range(max(1, len(codes) - window + 1) if codes else 0):
            phrases.setdefault(tuple(codes[at : at + window]), set()).add(item_id)
        held += len(got)
        if held >= block_words:
            yield block()
            words, phrases, held = {}, {}, 0
    if phrases:
        yield block()


def fm_index(text, runs_start, sample: int = SAMPLE):
    """Index a sequence of numbers in which 0 ends every stretch: (find, locate)."""
    import numpy as np

    n = len(text)
    ends = text == 0
    # Each end gets its own rank, so no comparison runs beyond a stretch.
    rank = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + int(ends.sum()))
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.r_[False, key[order][1:] != key[order][:-1]])
        rank = fresh
        step *= 2
        if int(rank.max()) == n - 1 or step >= n:
            break
    last = text[order - 1]  # of the first suffix: the final end mark
    top = int(text.max())
    before = np.r_[0, np.cumsum(np.bincount(text, minlength=top + 1))]
    levels = []
    column = last.copy()
    for bit in range(max(1, top.bit_length()) - 1, -1, -1):
        ones = (column >> bit) & 1
        levels.append((bit, np.r_[0, np.cumsum(ones)].astype(np.int64), n - int(ones.sum())))
        column = np.r_[column[ones == 0], column[ones == 1]]

    def ranked(symbol, at):
        """How often each symbol occurs in the last column before a row."""
        low = np.zeros_like(at)
        for bit, ones, zeros in levels:
            up = ((symbol >> bit) & 1).astype(bool)
            at = np.where(up, zeros + ones[at], at - ones[at])
            low = np.where(up, zeros + ones[low], low - ones[low])
        return at - low

    def find(phrases, lengths):
        """First and end row of every phrase, by backward search."""
        low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), n, np.int64)
        for back in range(int(lengths.max())):
            live = np.flatnonzero((lengths > back) & (low < high))
            symbol = phrases[live, lengths[live] - 1 - back]
            known = symbol <= top
            symbol = np.where(known, symbol, 0)
            low[live] = np.where(known, before[symbol] + ranked(symbol, low[live]), 0)
            high[live] = np.where(known, before[symbol] + ranked(symbol, high[live]), 0)
        return low, high

    kept = np.zeros(n, bool)
    kept[::sample] = True
    kept[runs_start] = True  # no walk leaves its stretch
    sampled = kept[order]
    place = np.cumsum(sampled) - 1
    values = order[sampled]

    def locate(rows):
        rows, out, walked = rows.copy(), np.zeros(len(rows), np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            here = rows[open_]
            hit = sampled[here]
            out[open_[hit]] = values[place[here[hit]]] + walked
            open_ = open_[~hit]
            here = rows[open_]
            rows[open_] = before[last[here]] + ranked(last[here], here)
            walked += 1
        return out

    return find, locate


def shard_hits(words, lengths, blocks, sample: int = SAMPLE):
    """Which words of a shard some phrase covers, and each document's item ids.

    `words` is the shard's words in one list, `lengths` the words of each document.
    """
    import numpy as np

    total = len(words)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    covered = np.zeros(total, bool)
    found = [set() for _ in lengths]
    for numbers, phrases, owners in blocks:
        get = numbers.get
        codes = np.fromiter((get(w, 0) for w in words), np.int64, total)
        sizes = np.array([len(p) for p in phrases])
        table = np.zeros((len(phrases), sizes.max()), np.int64)
        for i, p in enumerate(phrases):
            table[i, : len(p)] = p
        # Stretches of test words within a document, long enough for the shortest phrase.
        new = np.r_[True, owner[1:] != owner[:-1]] if total else np.zeros(0, bool)
        inside = codes > 0
        start = np.flatnonzero(inside & (new | ~np.r_[False, inside[:-1]]))
        end = np.flatnonzero(inside & np.r_[new[1:] | ~inside[1:], True][:total]) + 1
        long = end - start >= sizes.min()
        start, end = start[long], end[long]
        if not len(start):
            continue
        size = end - start
        first = np.cumsum(size + 1) - size - 1
        text = np.zeros(int((size + 1).sum()), np.int64)
        origin = np.full(len(text), -1, np.int64)
        spot = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
        origin[spot] = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
        text[spot] = codes[origin[spot]]
        find, locate = fm_index(text, first, sample)
        low, high = find(table, sizes)
        times = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(times)), times)
        rows = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
        at = locate(rows)
        change = np.zeros(len(text) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + sizes[which], -1)
        marked = np.cumsum(change[:-1]) > 0
        covered[origin[marked]] = True
        pairs = np.unique(owner[origin[at]] * len(phrases) + which)
        for pair in pairs.tolist():
            found[pair // len(phrases)].update(owners[pair % len(phrases)])
    return covered, found


def _search(blocks, shard_words: int, sample: int):
    hits = shard_hits

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def flush(ids, words, lengths):
            covered, found = hits(words, np.array(lengths, np.int64), (b.value for b in blocks), sample)
            spans, at = [], 0
            for n in lengths:
                mine = covered[at : at + n]
                if mine.any():
                    edge = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8)))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
                else:
                    spans.append([])
                at += n
            return pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(ids, pa.int64()),
                    "n_words": pa.array(lengths, pa.int64()),
                    "spans": pa.array(spans, kind),
                    "item_ids": pa.array([sorted(f) for f in found], pa.list_(pa.string())),
                }
            )

        ids, words, lengths = [], [], []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                got = text.translate(WORD_BYTES).split()
                ids.append(doc)
                lengths.append(len(got))
                words += got
                if len(words) >= shard_words:
                    yield flush(ids, words, lengths)
                    ids, words, lengths = [], [], []
        if ids:
            yield flush(ids, words, lengths)

    return run


def _phrases(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> list:
    context = docs.sparkSession.sparkContext
    asked = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text").cast("string"))
    return [
        context.broadcast(b)
        for b in phrase_blocks(((r[0], r[1]) for r in asked.toLocalIterator()), window, block_words)
    ]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    block_words: int = BLOCK_WORDS,
    sample: int = SAMPLE,
) -> DataFrame:
    """One row per document: doc_id, n_words, spans (word ranges to remove), item_ids (as strings).

    Null text has no words; a null item id counts as the empty string; repeated items and rows are
    searched once and reported for every row. The test items are read through the driver in blocks of
    `block_words` words, each broadcast on its own. Other columns are ignored; without items or
    documents nothing is hit.
    """
    blocks = _phrases(docs, benchmark, window, block_words)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(
        _search(blocks, shard_words, sample),
        "doc_id long, n_words long, spans array<struct<start:long,end:long>>, item_ids array<string>",
    )


def judged(found: DataFrame) -> DataFrame:
    """Add n_hit and contaminated: a twentieth of the words or more is hit."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.withColumn("n_hit", hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns. Every row is decided by its own
    text, whatever other rows carry its doc_id."""

    def keeps(found):  # as in judged()
        hit = [sum(s["end"] - s["start"] for s in spans) for spans in found.column("spans").to_pylist()]
        return [not (h > 0 and 20 * h >= n) for h, n in zip(hit, found.column("n_words").to_pylist())]

    return rows_kept(docs, _search(_phrases(docs, benchmark, WINDOW, BLOCK_WORDS), SHARD_WORDS, SAMPLE), keeps)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged(found).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"), "contaminated",
    )
