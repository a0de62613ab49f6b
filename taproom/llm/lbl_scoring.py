"""Scores by a log-bilinear language model trained with noise-contrastive estimation.

Every token of the training documents is counted. The most frequent tokens are the model's classes; all
others share one class, within which a token has its smoothed share of the counts. The two words
before a position are mapped to a predicted vector, whose products with the class vectors give the class
scores. Each task trains on all its tokens from the same start, and the parameters are averaged by tokens
read. For scoring, batched matrix products normalise the classes for each pair of words before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taproom.llm.common import most_frequent, stored, table, texts

CLASSES = 1000
DIMENSIONS = 16
NOISE = 32
KNOWN = 50_000  # most frequent tokens, whose counts every task holds
STEP = 4096  # tokens of one gradient step
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
END = b""  # the token that closes a document; no word is empty


def tokens_of(text: bytes) -> list[bytes]:
    return [*text.translate(LOWER).split(), END]


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(7)) == 2, F.lit(False))


def _counts(batches):
    from collections import Counter

    import pyarrow as pa

    split = tokens_of
    counts = Counter()

    def flush():
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "c"]
        )

    for batch in batches:
        for text in texts(batch.column(0)):
            counts.update(split(text))
        if len(counts) > 400_000:
            yield flush()
            counts.clear()
    if counts:
        yield flush()


def token_counts(docs: DataFrame) -> DataFrame:
    """token (bytes) and c, its count over all texts; a null text is only its end."""
    rows = docs.select(F.col("text").cast("string"))
    return rows.mapInArrow(_counts, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def start_parameters(shares, dimensions: int, seed: int = 0) -> dict:
    """Context vectors, their two position matrices, class vectors and biases at the class shares."""
    import numpy as np

    draw, n = np.random.default_rng(seed), len(shares)
    small = lambda *shape: draw.normal(0, 0.1, shape).astype(np.float32)
    eye = np.eye(dimensions, dtype=np.float32)
    return {
        "context": small(n + 1, dimensions), "near": eye.copy(), "far": eye / 2,
        "target": small(n, dimensions), "bias": np.log(shares).astype(np.float32),
    }


def contexts(classes, lengths, before: int):
    """The classes of the one and two tokens before each position of documents laid end to end."""
    import numpy as np

    near, far = np.empty_like(classes), np.empty_like(classes)
    near[1:], far[2:] = classes[:-1], classes[:-2]
    first = np.cumsum(lengths) - lengths
    near[first] = far[first] = before
    second = first[lengths > 1] + 1
    far[second] = before
    return near, far


def nce_step(p: dict, state: dict, near, far, target, noise, log_noise, rate: float = 0.1) -> None:
    """One step of noise-contrastive estimation with adaptive rates, in place.

    `noise` are class numbers drawn from the shares, shared by the step; `log_noise` is the logarithm of
    the number drawn times the share of each class.
    """
    import numpy as np

    a, b = p["context"][near], p["context"][far]
    predicted = a @ p["near"] + b @ p["far"]
    out = p["target"][target]
    real = np.einsum("ij,ij->i", predicted, out) + p["bias"][target] - log_noise[target]
    vectors = p["target"][noise]
    false = predicted @ vectors.T + (p["bias"][noise] - log_noise[noise])[None, :]
    g_real = -1 / (1 + np.exp(np.clip(real, -30, 30)))
    g_false = 1 / (1 + np.exp(-np.clip(false, -30, 30)))
    back = g_real[:, None] * out + g_false @ vectors

    def move(name, rows, grad):
        if rows is not None:
            order = np.argsort(rows, kind="stable")
            rows = rows[order]
            first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            rows, grad = rows[first], np.add.reduceat(grad[order], first, axis=0)
        else:
            rows = slice(None)
        state[name][rows] += grad * grad
        p[name][rows] -= rate * grad / np.sqrt(state[name][rows] + 1e-6)

    back_near, back_far = back @ p["near"].T, back @ p["far"].T
    every = np.concatenate([target, noise])
    move("target", every, np.concatenate([g_real[:, None] * predicted, g_false.T @ predicted]))
    move("bias", every, np.concatenate([g_real, g_false.sum(axis=0)]))
    move("near", None, a.T @ back)
    move("far", None, b.T @ back)
    move("context", np.concatenate([near, far]), np.concatenate([back_near, back_far]))


NAMES = ("context", "near", "far", "target", "bias")


def _train(numbers, shares, dimensions: int, noise: int, step: int):
    split, place, begin, learn, names = tokens_of, contexts, start_parameters, nce_step, NAMES

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        other, before = len(shares) - 1, len(shares)
        p = begin(shares, dimensions)
        state = {k: np.zeros_like(v) for k, v in p.items()}
        draw = np.random.default_rng(TaskContext.get().partitionId() + 1)
        cumulative = np.cumsum(shares)
        log_noise = np.log(noise * shares).astype(np.float32)
        seen = 0
        for batch in batches:
            words = [split(t) for t in texts(batch.column(0))]
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            if not len(lengths):
                continue
            get = numbers.get
            classes = np.fromiter((get(w, other) for ws in words for w in ws), np.int64, int(lengths.sum()))
            near, far = place(classes, lengths, before)
            order = draw.permutation(len(classes))
            for at in range(0, len(order), step):
                mine = order[at : at + step]
                false = np.minimum(np.searchsorted(cumulative, draw.random(noise)), other)
                learn(p, state, near[mine], far[mine], classes[mine], false, log_noise)
            seen += len(classes)
        if seen:
            flat = np.concatenate([p[k].reshape(-1) for k in names]).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat))), pa.array(flat * seen), pa.array(np.full(len(flat), float(seen)))],
                ["i", "total", "weight"],
            )

    return run


def train(docs: DataFrame, numbers: dict, shares, dimensions: int = DIMENSIONS, noise: int = NOISE, step: int = STEP) -> dict:
    """Parameters after every task's pass over its part of the documents, averaged by tokens."""
    import numpy as np

    start = start_parameters(shares, dimensions)
    trained = docs.select(F.col("text").cast("string")).mapInArrow(
        _train(numbers, shares, dimensions, noise, step), "i long, total double, weight double"
    )
    means = trained.groupBy("i").agg((F.sum("total") / F.sum("weight")).alias("mean")).collect()
    if not means:
        return start
    flat = np.zeros(len(means))
    for i, mean in means:
        flat[i] = mean
    out, at = {}, 0
    for name in NAMES:
        size = start[name].size
        out[name] = flat[at : at + size].reshape(start[name].shape).astype(np.float32)
        at += size
    return out


def log_chances(p: dict, near, far, target, norms):
    """Natural logarithm of each class's normalised probability after its two classes before.

    `norms` keeps the normaliser of each pair of classes (nan: not yet computed).
    """
    import numpy as np

    width = len(p["context"])
    pair = near * width + far
    unknown = np.unique(pair[np.isnan(norms[pair])])
    for at in range(0, len(unknown), 4096):
        some = unknown[at : at + 4096]
        predicted = p["context"][some // width] @ p["near"] + p["context"][some % width] @ p["far"]
        scores = predicted @ p["target"].T + p["bias"][None, :]
        top = scores.max(axis=1)
        norms[some] = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
    out = np.empty(len(target))
    one, two = p["context"] @ p["near"], p["context"] @ p["far"]
    for at in range(0, len(target), 200_000):
        to = slice(at, at + 200_000)
        predicted = one[near[to]] + two[far[to]]
        out[to] = np.einsum("ij,ij->i", predicted, p["target"][target[to]]) + p["bias"][target[to]]
    return out - norms[pair]


def _score(shared):
    split, place, chances = tokens_of, contexts, log_chances

    def run(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        model = shared.value
        known, classes_n, log_c, p = model["known"], model["classes"], model["log_c"], model["parameters"]
        seen_c = model["seen"]
        width = len(p["context"])
        norms = np.full(width * width, np.nan)
        row = TaskContext.get().partitionId() << 33
        rare_kind = pa.list_(pa.struct([("token", pa.binary()), ("times", pa.int32())]))
        for batch in batches:
            words = [split(t) for t in texts(batch.column(1))]
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            if not len(lengths):
                continue
            get, last = known.get, len(known)
            numbers = np.fromiter((get(w, last) for ws in words for w in ws), np.int64, int(lengths.sum()))
            classes = np.minimum(numbers, classes_n)
            near, far = place(classes, lengths, classes_n + 1)
            first = np.cumsum(lengths) - lengths
            model_part = np.add.reduceat(chances(p, near, far, classes, norms), first)
            own = np.append(log_c, 0.0)[numbers]
            counted = np.add.reduceat(own, first)
            shared_part = np.add.reduceat(np.where(classes == classes_n, own, 0.0), first)
            others = np.add.reduceat((classes == classes_n).astype(np.int64), first)
            found = np.add.reduceat(np.append(seen_c, 0)[numbers], first)
            rare = [
                [{"token": w, "times": n} for w, n in Counter(w for w in ws if w not in known).items()] for ws in words
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + len(words))), batch.column(0), pa.array(lengths), pa.array(model_part),
                    pa.array(counted), pa.array(shared_part), pa.array(others), pa.array(found), pa.array(rare, rare_kind),
                ],
                ["row", "doc_id", "n_tokens", "model_part", "counted", "shared_part", "others", "found", "rare"],
            )
            row += len(words)

    return run


def lm_scores(
    docs: DataFrame, learned: DataFrame, classes: int = CLASSES, dimensions: int = DIMENSIONS, known: int = KNOWN
) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    `learned` are the documents to learn from. Counts cover all their tokens; those of the `known` most
    frequent tokens are broadcast, a table bounded by that number, those of all others are joined. Null
    texts count as empty. With nothing to learn from every class is equally likely. Repeated rows are
    all scored; other columns are ignored.
    """
    import numpy as np

    counts = stored(token_counts(learned), "token-counts")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = [(bytes(r["token"]), r["c"]) for r in most_frequent(counts, known, "c", "token")]
    # The end of a document is always a class.
    end = next((x for x in top if x[0] == END), (END, 0 if not total else None))
    if end[1] is None:
        end = (END, counts.where(F.col("token") == F.lit(END)).first()["c"])
    top = [end, *(x for x in top if x[0] != END)]
    n_classes = min(classes, len(top))
    class_tokens = sum(c for _, c in top[:n_classes])
    other_tokens, other_kinds = total - class_tokens, kinds - sum(1 for _, c in top[:n_classes] if c)
    shares = np.array([c + 1 for _, c in top[:n_classes]] + [other_tokens + other_kinds + 1], float)
    shares /= shares.sum()
    parameters = train(learned, {w: i for i, (w, _) in enumerate(top[:n_classes])}, shares, dimensions)
    shared = docs.sparkSession.sparkContext.broadcast(
        {
            "known": {w: i for i, (w, _) in enumerate(top)}, "classes": n_classes, "parameters": parameters,
            "log_c": np.log10(np.array([c for _, c in top], float) + 1), "seen": np.array([int(c > 0) for _, c in top]),
        }
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    scored = stored(
        rows.mapInArrow(
            _score(shared),
            "row long, doc_id long, n_tokens long, model_part double, counted double, shared_part double, "
            "others long, found long, rare array<struct<token:binary,times:int>>",
        ),
        "scored",
    )
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.times")
    log_c = F.log10(F.coalesce(F.col("c"), F.lit(0)).cast("double") + 1)
    rest = rare.join(counts, "token", "left").groupBy("row").agg(
        F.sum(F.col("times") * log_c).alias("rare_part"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("rare_found"),
    )
    base_norm = float(np.log10(total + kinds + 1))
    other_norm = float(np.log10(other_tokens + other_kinds + 1))
    part = F.coalesce("rare_part", F.lit(0.0))
    return scored.drop("rare").join(rest, "row", "left").select(
        "doc_id", "n_tokens",
        (F.col("found") + F.coalesce("rare_found", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("counted") + part - F.col("n_tokens") * base_norm).alias("base_score"),
        (F.col("model_part") / float(np.log(10)) + F.col("shared_part") + part - F.col("others") * other_norm).alias("score"),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learning from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return lm_scores(docs, docs.where(~held_out())).withColumn("held_out", held_out())
