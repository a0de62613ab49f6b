"""Best-fit packing of tokenised documents with matching of the large pieces.

Pieces above one third of the capacity go at most two to a sequence: from the largest down, each is
matched with the largest other that still fits. Smaller pieces then go, largest first, into the
tightest gap that holds them. Both steps depend on lengths alone, so they run on the histogram of
lengths (one count per length up to the capacity), and the plan they give is applied to all pieces by
their rank within their length. No task sees more than its own pieces.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taproom.llm.common import stored, table, worker_cache

CAPACITY = 1024
END_ID = 2
CACHE_WORDS = 600_000  # in each of two generations, about 250 bytes each

PIECES = "doc_id long, piece int, start long, length long, {}, part int, rank_in_part long"


def _tokenise(tokenizer: str, pattern: str, end_id: int, capacity: int, cache_words: int, checksums: bool):
    cache = worker_cache  # travels by value

    def run(batches):
        import re
        import zlib
        from array import array
        from itertools import chain

        import numpy as np
        import pyarrow as pa
        import regex
        from pyspark import TaskContext
        from tokenizers import Tokenizer

        state = cache()
        if state.get("tokenizer_path") != tokenizer:
            loaded = Tokenizer.from_file(tokenizer)
            loaded.encode_special_tokens = True
            loaded.model._resize_cache(0)  # every word is encoded once; what comes again is remembered here
            mark = loaded.pre_tokenizer.pre_tokenize_str(" ")[0][0] if loaded.pre_tokenizer else " "
            spaced_id = np.zeros(loaded.get_vocab_size(), bool)
            spaced_id[[i for token, i in loaded.get_vocab().items() if token.startswith(mark)]] = True
            line = loaded.encode("\n", add_special_tokens=False).ids
            cut = [t for t, _ in loaded.pre_tokenizer.pre_tokenize_str("a.\nb")] if loaded.pre_tokenizer else []
            alone = cut[2:3] == [t for t, _ in loaded.pre_tokenizer.pre_tokenize_str("\n")] if len(cut) == 4 else False
            line = line[0] if alone and len(line) == 1 else None
            state.update(tokenizer_path=tokenizer, tokenizer=loaded, words={}, older={}, pre_tokens={}, spaced_id=spaced_id, line=line)
        model, words, pre_tokens = state["tokenizer"], state["words"], state["pre_tokens"]
        spaced_id, line = state["spaced_id"], state["line"]
        # A single space between two other characters always starts a new pre-token, so the stretches
        # between such spaces can be encoded on their own, each with its space, and remembered. Where a line
        # end before another character is a pre-token of its own, stretches also end there; the next one
        # starts with it.
        by_line = line is not None
        space = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)" if by_line else r"(?<=\S) (?=\S)")
        wide = re.compile(r"\s\s")
        split = regex.compile(pattern).findall
        plain = frozenset(",.;:!?")

        def encode(texts, keys, into):
            for at in range(0, len(texts), 5000):
                codes = model.encode_batch_fast(texts[at : at + 5000], add_special_tokens=False)
                for key, code in zip(keys[at : at + 5000], codes):
                    into[key] = array("I", code.ids).tobytes()

        def joined(some, sep, starts):
            """The ids of words of letters, encoded in one text; none if they can't be told apart."""
            text = sep + sep.join(some)
            ids = np.array(model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(starts(ids))
            if len(at) != len(some):
                return None
            raw, first, after = ids.tobytes(), (at * 4).tolist(), (np.append(at[1:], len(ids)) * 4).tolist()
            return map(raw.__getitem__, map(slice, first, after))

        def learn(unseen):
            """Remember the ids of stretches that follow a space or start with a line end.

            Letters alone are one pre-token, letters and a stop are two; the rest is split by the pattern.
            """
            stopped, lined, rest, bases, heads, pieces = [], [], [], set(), set(), set()
            for x in unseen:
                if x.isalpha():
                    bases.add(x)
                    continue
                y = x[1:] if x[:1] == "\n" else x
                stop = y[-1:] if y[-1:] in plain else ""
                word = y[:-1] if stop else y
                if not word.isalpha():
                    cut = split(x if y is not x else " " + x)
                    rest.append((x, cut))
                    pieces.update(cut)
                    continue
                if stop:
                    pieces.add(stop)
                if y is x:
                    stopped.append(x)
                    bases.add(word)
                else:
                    lined.append((x, "\n" + word, stop))
                    heads.add(word)
            bases = list(bases - words.keys())
            for at in range(0, len(bases), 2000):
                # Letters after single spaces: each word is a pre-token and its first id alone has the space.
                some = bases[at : at + 2000]
                found = joined(some, " ", spaced_id.__getitem__)
                if found is None:
                    encode([" " + x for x in some], some, words)
                else:
                    words.update(zip(some, found))
            heads = [x for x in heads if "\n" + x not in words]
            for at in range(0, len(heads), 2000):
                some = heads[at : at + 2000]
                lines = ["\n" + x for x in some]
                found = joined(some, "\n", lambda ids: ids == line)
                if found is None:
                    encode(lines, lines, words)
                else:
                    words.update(zip(lines, found))
            pieces = list(pieces - pre_tokens.keys())
            encode(pieces, pieces, pre_tokens)
            for x in stopped:
                words[x] = words[x[:-1]] + pre_tokens[x[-1]]
            for x, word, stop in lined:
                words[x] = words[word] + pre_tokens[stop] if stop else words[word]
            for x, cut in rest:
                words[x] = b"".join(map(pre_tokens.__getitem__, cut))

        part, ranks = TaskContext.get().partitionId(), [0] * (capacity + 1)
        last = array("I", [end_id]).tobytes()
        for batch in batches:
            stretches = [
                space.split(text) if wide.search(text) else (text.replace("\n", " \n") if by_line else text).split(" ")
                for text in (t or "" for t in batch.column(1).to_pylist())
            ]
            spaced = [x[1:] for x in stretches]
            if len(words) > cache_words:
                # The words in use come back from the older generation; the others go with it.
                state["older"], state["words"] = words, {}
                words = state["words"]
            if len(pre_tokens) > cache_words:
                pre_tokens.clear()
            unseen, older = set().union(*spaced) - words.keys(), state["older"]
            again = unseen & older.keys()
            words.update(zip(again, map(older.__getitem__, again)))
            learn(unseen - again)
            heads = [
                array("I", code.ids).tobytes()
                for code in model.encode_batch_fast([x[0] for x in stretches], add_special_tokens=False)
            ]
            out = [[] for _ in range(7)]
            for doc, head, got in zip(batch.column(0).to_pylist(), heads, spaced):
                ids = head + b"".join(map(words.__getitem__, got)) + last
                n = len(ids) // 4
                first = n % capacity or capacity
                edges = [0, *range(first, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                    length = b - a
                    own = ids[4 * a : 4 * b]
                    row = (doc, piece, a, length, zlib.crc32(own) if checksums else own, part, ranks[length])
                    ranks[length] += 1
                    for column, value in zip(out, row):
                        column.append(value)
                if len(out[0]) >= 4000:
                    yield _rows(pa, out)
                    out = [[] for _ in range(7)]
            if out[0]:
                yield _rows(pa, out)

    def _rows(pa, out):
        ids = ("ids_crc32", pa.int64()) if checksums else ("ids", pa.binary())
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), ids[1], pa.int32(), pa.int64())
        names = ("doc_id", "piece", "start", "length", ids[0], "part", "rank_in_part")
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return run


def pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    cache_words: int = CACHE_WORDS,
    pattern: str | None = None,
    checksums: bool = False,
) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids (little-endian uint32).

    A document is its token ids and then `end_id`; null text counts as empty, so every row has at least
    one piece. Only documents longer than `capacity` are cut; their first piece may be shorter. `part`
    and `rank_in_part` number the pieces of one length within one task. Repeated rows are packed as
    often as they occur; other columns of `docs` are ignored. `pattern` is the tokenizer's pre-token
    pattern (default: that of the given byte-level vocabularies). With `checksums` the ids stay in their
    task and ids_crc32 is returned in their place.
    """
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = PIECES.format("ids_crc32 long" if checksums else "ids binary")
    return rows.mapInArrow(_tokenise(tokenizer, pattern, end_id, capacity, cache_words, checksums), schema)


def plan_sequences(counts, capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Fillings and how many sequences take each: [([(length, times), ...], sequences), ...].

    counts[k] is the number of pieces of length k, 1 <= k <= capacity.
    """
    left = [int(x) for x in counts]
    done: list[tuple[list[tuple[int, int]], int]] = []
    gaps: list[list[tuple[list[tuple[int, int]], int]]] = [[] for _ in range(capacity + 1)]
    third = capacity // 3
    for size in range(capacity, third, -1):
        while left[size]:
            other = min(size, capacity - size)
            while other > third and (left[other] == 0 or other == size and left[size] < 2):
                other -= 1
            if other <= third:
                gaps[capacity - size].append(([(size, 1)], left[size]))
                left[size] = 0
            elif other == size:
                gaps[capacity - 2 * size].append(([(size, 2)], left[size] // 2))
                left[size] %= 2
            else:
                times = min(left[size], left[other])
                gaps[capacity - size - other].append(([(size, 1), (other, 1)], times))
                left[size] -= times
                left[other] -= times
    for size in range(third, 0, -1):
        gap = size
        while left[size] and gap <= capacity:
            if not gaps[gap]:
                gap += 1
                continue
            filling, bins = gaps[gap].pop()
            each = min(gap // size, left[size])
            full = min(bins, left[size] // each)
            if bins > full:
                gaps[gap].append((filling, bins - full))
            gaps[gap - each * size].append(([*filling, (size, each)], full))
            left[size] -= each * full
        each = capacity // size
        if left[size] >= each:
            gaps[capacity - each * size].append(([(size, each)], left[size] // each))
            left[size] %= each
        if left[size]:
            gaps[capacity - left[size] * size].append(([(size, left[size])], 1))
            left[size] = 0
    for group in gaps:
        done.extend(group)
    return done


def _slots(fillings, capacity: int):
    """Per length, ascending ranges of ranks and where they go: arrays sorted by (length, first rank)."""
    taken, rows, sequence = [0] * (capacity + 1), [], 0
    for filling, bins in fillings:
        offset = 0
        for size, times in filling:
            rows.append((size, taken[size], sequence, times, offset))
            taken[size] += times * bins
            offset += size * times
        sequence += bins
    rows.sort()
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def _place(slots):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        starts = np.searchsorted(slots[:, 0], np.arange(slots[:, 0].max() + 2 if len(slots) else 1))
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            length = batch.column(at["length"]).to_numpy(zero_copy_only=False)
            rank = batch.column(at["rank"]).to_numpy(zero_copy_only=False)
            row = np.empty(len(length), np.int64)
            for size in np.unique(length):
                mine = length == size
                a, b = starts[size], starts[size + 1]
                row[mine] = a + np.searchsorted(slots[a:b, 1], rank[mine], side="right") - 1
            _, first, sequence, times, offset = slots[row].T
            step = rank - first
            columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != "rank"]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence + step // times), pa.array(offset + step % times * length)],
                [*names, "sequence_id", "offset"],
            )

    return run


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces that `pieces` made and that were stored since.

    The histogram has at most `capacity` rows whatever the data; it and the plan are all that the
    driver holds. An empty table gives an empty result.
    """
    counts = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    histogram = np.zeros(capacity + 1, np.int64)
    for row in rows.groupBy("length").agg(F.count("*").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    slots = _slots(plan_sequences(histogram, capacity), capacity)
    kept = [c for c in rows.columns if c not in ("part", "rank_in_part")]
    ranked = rows.join(offsets, ["length", "part"]).select(
        *kept, (F.col("before") + F.col("rank_in_part")).alias("rank")
    )
    schema = ", ".join(f"`{n}` {t}" for n, t in ranked.drop("rank").dtypes)
    return ranked.mapInArrow(_place(slots), f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and the documents in order.

    `packed` must carry `ids`. A sequence has at most `capacity` tokens, so its group is bounded.
    """
    part = F.struct("offset", "doc_id", "piece", "ids")
    return packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("p")).select(
        "sequence_id",
        F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.col("p.doc_id").alias("doc_ids"),
        F.col("p.piece").alias("pieces"),
        F.col("p.offset").alias("offsets"),
    )


def packed_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack a table of documents and give each piece's place with a checksum of its ids."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    cut = pieces(docs, tokenizer, capacity, checksums=True)
    return pack(stored(cut, "pieces"), capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return packed_documents(table(spark, sf_dir, "documents"))
