"""Language identification by words first, then by ever shorter character n-grams.

A known word is scored by its log frequency in each language. An unseen word falls back to its longest
n-grams that are known, then to shorter ones. The model is fitted on a bounded share of the labelled
documents and is bounded itself; every document is then scored in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taproom.llm.common import most_frequent, rows_kept, stored, table, worker_cache

PER_LANGUAGE = 4000  # documents of each language that the model is fitted on, about
MAX_WORDS = 40_000  # words and n-grams the model keeps, the most frequent ones
MAX_GRAMS = 20_000
ORDERS = (5, 4, 3, 2, 1)
SMOOTH = 0.5
UNKNOWN = "und"
GROUP_WORDS = 1 << 16  # words looked up at a time, about; a longer text is a group of its own


def letters_of(text: str) -> list[str]:
    """Runs of letters in lower case; digits, marks and underscores end a run."""
    import re

    return re.findall(r"[^\W\d_]+", text.lower())


def grams_of(word: str, order: int) -> list[str]:
    """Character n-grams of a word between two marks of its ends; single letters stand alone."""
    if order == 1:
        return list(word)
    edged = f"<{word}>"
    return [edged[i : i + order] for i in range(len(edged) - order + 1)]


def _word_counts(batches):
    from collections import Counter

    import pyarrow as pa

    words_of = letters_of
    counts = Counter()

    def flush():
        rows = list(counts.items())
        return pa.RecordBatch.from_pydict(
            {
                "word": pa.array([k[1] for k, _ in rows], pa.string()),
                "lang": pa.array([k[0] for k, _ in rows], pa.string()),
                "n": pa.array([n for _, n in rows], pa.int64()),
            }
        )

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for word, n in Counter(words_of(text or "")).items():
                counts[lang, word] += n
        if len(counts) > 200_000:
            yield flush()
            counts.clear()
    if counts:
        yield flush()


def _gram_counts(orders):
    def run(batches):
        from collections import Counter

        import pyarrow as pa

        make = grams_of
        counts = Counter()

        def flush():
            rows = list(counts.items())
            return pa.RecordBatch.from_pydict(
                {
                    "order_": pa.array([k[0] for k, _ in rows], pa.int32()),
                    "term": pa.array([k[2] for k, _ in rows], pa.string()),
                    "lang": pa.array([k[1] for k, _ in rows], pa.string()),
                    "n": pa.array([n for _, n in rows], pa.int64()),
                }
            )

        for batch in batches:
            for word, lang, n in zip(*(c.to_pylist() for c in batch.columns)):
                for order in orders:
                    for gram in make(word, order):
                        counts[order, lang, gram] += n
            if len(counts) > 200_000:
                yield flush()
                counts.clear()
        if counts:
            yield flush()

    return run


def fit(
    labelled: DataFrame,
    per_language: int = PER_LANGUAGE,
    max_words: int = MAX_WORDS,
    max_grams: int = MAX_GRAMS,
    orders: tuple[int, ...] = ORDERS,
    smooth: float = SMOOTH,
) -> dict:
    """Fit on (doc_id, text, lang): {languages, orders, tables}; rows of null lang are left out.

    From every language about `per_language` documents are taken by the hash of their id, all if there
    are fewer. Words are counted over them whole; of words and of each n-gram order the `max_words` and
    `max_grams` most frequent stay (ties by spelling). tables[0] maps words, tables[k] the n-grams of
    length k, to one log frequency per language.
    """
    import numpy as np

    rows = labelled.where("lang is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    if not sizes:
        return {"languages": [], "orders": tuple(orders), "tables": {}}
    languages = sorted(sizes)
    parts = F.create_map(*[F.lit(x) for lang in languages for x in (lang, per_language / sizes[lang])])
    share = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    taken = rows.where(share < F.element_at(parts, F.col("lang"))).select("lang", "text")
    words = taken.mapInArrow(_word_counts, "word string, lang string, n long").groupBy("word", "lang")
    words = stored(words.agg(F.sum("n").alias("n")), "words")
    column = {lang: i for i, lang in enumerate(languages)}
    grams = words.mapInArrow(_gram_counts(orders), "order_ int, term string, lang string, n long")
    grams = grams.groupBy("order_", "term", "lang").agg(F.sum("n").alias("n"))
    both = words.select(F.lit(0).alias("order_"), F.col("word").alias("term"), "lang", "n").union(grams)
    terms = stored(
        both.groupBy("order_", "term").agg(
            F.sum("n").alias("n"), F.collect_list(F.struct("lang", "n")).alias("by")  # one entry a language
        ),
        "terms",
    )
    each = terms.select("order_", F.explode("by").alias("b"))
    totals = {(r[0], r[1]): r[2] for r in each.groupBy("order_", "b.lang").agg(F.sum("b.n")).collect()}
    tables = {}
    for order in (0, *orders):
        top = terms.where((F.col("order_") == order) & ((F.col("order_") > 0) | (F.col("n") > 1)))
        kept = most_frequent(top, max_grams if order else max_words, "n", "term")
        sums = np.array([totals.get((order, lang), 0) for lang in languages], float)
        floor = np.log(sums + smooth * (len(kept) + 1))
        scores = {}
        for row in kept:
            counts = np.full(len(languages), smooth)
            for lang, n in row["by"]:
                counts[column[lang]] += n
            scores[row["term"]] = (np.log(counts) - floor).astype(np.float32)
        tables[order] = scores
    return {"languages": languages, "orders": tuple(orders), "tables": tables}


def packed(model: dict) -> dict:
    """The model with one text of terms and one matrix a table: every worker keeps what it is sent."""
    import numpy as np

    width = len(model["languages"])
    tables = {
        order: ("\n".join(table), np.array(list(table.values()), np.float32).reshape(len(table), width))
        for order, table in model["tables"].items()
    }
    return {"languages": model["languages"], "orders": model["orders"], "tables": tables}


def _predict(shared, cache_words: int, group_words: int = GROUP_WORDS):
    cache, words_of, make = worker_cache, letters_of, grams_of
    unknown = UNKNOWN

    def run(batches):
        from itertools import chain

        import numpy as np
        import pyarrow as pa

        model = shared.value
        languages, orders, tables = model["languages"], model["orders"], model["tables"]
        state = cache()
        if state.get("langid") != shared.id:

            def numbered(table):
                terms, scores = table
                return {term: i for i, term in enumerate(terms.split("\n") if len(scores) else ())}, scores.astype(float)

            known, scores = numbered(tables.get(0, ("", np.zeros((0, len(languages))))))
            state.update(
                langid=shared.id, langid_known=known, langid_base=scores, langid_seen=dict(known), langid_scores=scores,
                langid_grams={k: numbered(tables[k]) for k in orders if k in tables},
            )
        grams = state["langid_grams"]

        def backoff(words):
            """Scores of unseen words: the mean over their longest n-grams that are known."""
            out = np.zeros((len(words), len(languages)))
            left = list(range(len(words)))
            for order in orders:
                numbers, scores = grams[order]
                find = numbers.get
                found, sizes, mine, rest = [], [], [], []
                for i in left:
                    hits = [h for h in map(find, make(words[i], order)) if h is not None]
                    if hits:
                        found += hits
                        sizes.append(len(hits))
                        mine.append(i)
                    else:
                        rest.append(i)
                if mine:
                    sizes = np.array(sizes)
                    out[mine] = np.add.reduceat(scores[found], np.cumsum(sizes) - sizes) / sizes[:, None]
                left = rest
            return out

        def numbers_of(words):
            """The row of each word in the scores, which learn the unseen ones."""
            seen = state["langid_seen"]
            fresh = list(set(words) - seen.keys())
            if fresh and len(seen) + len(fresh) > len(state["langid_known"]) + cache_words:
                seen = state["langid_seen"] = dict(state["langid_known"])
                state["langid_scores"] = state["langid_base"]
                fresh = list(set(words) - seen.keys())
            if fresh:
                first = len(seen)
                seen.update(zip(fresh, range(first, first + len(fresh))))
                state["langid_scores"] = np.concatenate([state["langid_scores"], backoff(fresh)])
            return np.fromiter(map(seen.__getitem__, words), np.int64, len(words))

        def judged(texts):
            """Language and posterior of each text, given as its words."""
            names = [unknown if not words else None for words in texts]
            chances = [0.0] * len(texts)
            full = [i for i, words in enumerate(texts) if words]
            if full and languages:
                sizes = np.array([len(texts[i]) for i in full])
                numbers = numbers_of(list(chain.from_iterable(texts[i] for i in full)))
                total = np.add.reduceat(state["langid_scores"][numbers], np.cumsum(sizes) - sizes)
                likely = np.exp(total - total.max(axis=1)[:, None])
                best = likely.argmax(axis=1)
                posterior = likely[np.arange(len(full)), best] / likely.sum(axis=1)
                for i, k, p in zip(full, best.tolist(), posterior.tolist()):
                    names[i], chances[i] = languages[k], p
            return names, chances

        for batch in batches:
            names, chances, group, held = [], [], [], 0
            for i in range(batch.num_rows):
                group.append(words_of(batch.column(1)[i].as_py() or ""))
                held += len(group[-1])
                if held >= group_words or i + 1 == batch.num_rows:
                    for all_, found in zip((names, chances), judged(group)):
                        all_ += found
                    group, held = [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(chances, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, model: dict, cache_words: int = 200_000) -> DataFrame:
    """doc_id, lang_pred, score (posterior of the language) for every row; only the text is read.

    Null texts and texts without a letter are `und` with score zero. Ties go to the first language in
    order. Repeated rows are all scored; a model of no language predicts null.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(_predict(_Shared(context.broadcast(packed(model))), cache_words), "doc_id long, lang_pred string, score double")


class _Shared:
    """A broadcast model with a name that no other has."""

    def __init__(self, broadcast):
        import uuid

        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def _fitted(docs: DataFrame) -> dict:
    return fit(docs.where(~held_out() & F.col("doc_id").isNotNull()))


def identified(docs: DataFrame) -> DataFrame:
    """Fit on the documents that are not held out and predict all."""
    return predict(docs, _fitted(docs)).withColumn("held_out", held_out())


def drop_unidentified(docs: DataFrame, least: float = 0.5, cache_words: int = 200_000) -> DataFrame:
    """The documents whose language is found with a posterior of at least `least`, with all columns.

    Every row is decided by its own text, whatever other rows carry its doc_id.
    """
    unknown = UNKNOWN

    def keeps(found):
        return [name != unknown and score >= least for name, score in zip(found.column(1).to_pylist(), found.column(2).to_pylist())]

    shared = _Shared(docs.sparkSession.sparkContext.broadcast(packed(_fitted(docs))))
    return rows_kept(docs, _predict(shared, cache_words), keeps)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return identified(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")
