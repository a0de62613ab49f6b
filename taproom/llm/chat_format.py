"""Preference examples from chosen and rejected conversations, in DataFrame functions alone.

The longest common prefix of turns is rendered once as the prompt; what follows on each side becomes a
completion with a mask that leaves only the assistant's words and end marks to train on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taproom.llm.common import table

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation: key and `turns`, an ordered array of struct(turn, role, text).

    Null role and text count as empty. Turns that share a number are ordered by role and text; repeated
    rows stay. Other columns are ignored. A null key is a conversation of its own. The turns of one
    conversation form one training example, so they are gathered in one row.
    """
    one = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return turns.groupBy(F.col(key)).agg(F.array_sort(F.collect_list(one)).alias("turns"))


def echoed(turns: Column) -> Column:
    """A rejected side: the last assistant reply only repeats the turn before it (nothing if none)."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(turns), F.lit(1))), lambda i: (
        (i <= F.size(turns)) & (F.get(turns, i - 1)["role"] == TRAINED)
    ))
    last = F.coalesce(F.array_max(places), F.lit(0)) - 1
    return F.transform(turns, lambda t, i: F.when(
        i == last,
        F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.coalesce(F.get(turns, i - 1)["text"], F.lit("")).alias("text")),
    ).otherwise(t))


def _header(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def mask(turns: Column) -> Column:
    """Runs of code points over the rendered turns: -n is not trained on, +n is."""
    def runs(t):
        head, body = F.length(_header(t)), F.length(_body(t))
        return F.when(
            t["role"] == TRAINED, F.concat(F.lit("-"), head, F.lit(" +"), body)
        ).otherwise(F.concat(F.lit("-"), head + body))

    return F.array_join(F.transform(turns, runs), " ")


def preference_examples(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Replace two arrays of turns by prompt, completions and masks; other columns stay.

    Turns are equal when role and text are. Equal conversations give two empty completions; an empty
    side gives an empty prompt. A null side counts as empty.
    """
    both = {c: F.coalesce(F.col(c), F.array().cast(pairs.schema[c].dataType)) for c in (chosen, rejected)}
    same = F.zip_with(
        "_c", "_r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False))
    )
    # The longer side is padded with nulls, so the shorter one ends the prefix.
    differs = F.array_position("_same", False).cast("int")
    rest = [c for c in pairs.columns if c not in (chosen, rejected)]
    cut = (
        pairs.select(*rest, both[chosen].alias("_c"), both[rejected].alias("_r"))
        .withColumn("_same", same)
        .withColumn("n_prefix", F.when(differs == 0, F.size("_c")).otherwise(differs - 1))
    )
    after = {side: F.slice(side, F.col("n_prefix") + 1, F.greatest(F.size(side) - F.col("n_prefix"), F.lit(0))) for side in ("_c", "_r")}
    return cut.select(
        *rest, "n_prefix",
        rendered(F.slice("_c", F.lit(1), F.col("n_prefix"))).alias("prompt"),
        rendered(after["_c"]).alias("chosen"), mask(after["_c"]).alias("chosen_mask"),
        rendered(after["_r"]).alias("rejected"), mask(after["_r"]).alias("rejected_mask"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against the same one whose last reply only echoes what came before."""
    whole = conversations(table(spark, sf_dir, "conversations"))
    pairs = whole.select("conv_id", F.col("turns").alias("chosen"), echoed(F.col("turns")).alias("rejected"))
    return preference_examples(pairs)


SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations
), u AS (
  SELECT *, max(CASE WHEN role = 'assistant' THEN i END) OVER (PARTITION BY conv_id) AS last,
         coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY i), '') AS prior
  FROM t
), v AS (
  SELECT *, CASE WHEN i = last THEN prior ELSE text END AS other,
         min(CASE WHEN i = last AND prior <> text THEN i END) OVER (PARTITION BY conv_id) AS cut
  FROM u
), w AS (
  SELECT *, i < coalesce(cut, 1000000000) AS shared,
         '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body,
         other || '<|end|>' || chr(10) AS echo
  FROM v
), m AS (
  SELECT *, CASE WHEN role = 'assistant' THEN '-' || length(head) || ' +' || length(body)
                 ELSE '-' || (length(head) + length(body)) END AS c_mask,
         CASE WHEN role = 'assistant' THEN '-' || length(head) || ' +' || length(echo)
              ELSE '-' || (length(head) + length(echo)) END AS r_mask
  FROM w
)
SELECT conv_id, CAST(count(*) FILTER (WHERE shared) AS INTEGER) AS n_prefix,
       coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE shared), '') AS prompt,
       coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE NOT shared), '') AS chosen,
       coalesce(string_agg(c_mask, ' ' ORDER BY i) FILTER (WHERE NOT shared), '') AS chosen_mask,
       coalesce(string_agg(head || echo, '' ORDER BY i) FILTER (WHERE NOT shared), '') AS rejected,
       coalesce(string_agg(r_mask, ' ' ORDER BY i) FILTER (WHERE NOT shared), '') AS rejected_mask
FROM m GROUP BY conv_id
"""
