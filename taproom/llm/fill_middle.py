r"""Fill-in-middle examples by a counted-quantifier regular expression.

`regexp_count` gives the number n of units of a text. Two cuts a <= b are drawn for the row, and a pattern
made for that row, with possessive groups unit{a}+ and unit{b-a}+, takes prefix, middle and suffix in one
match, whose groups a replacement puts in the order of the form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taproom.llm.common import table

CODE_POINT = "(?s:.)"
SENTINELS = ("<P>", "<S>", "<M>")  # prefix, suffix, middle
COUNTED = 256  # units counted at a time, so that a count holds few matches of a long text


def unit_count(text: Column, unit: str = CODE_POINT) -> Column:
    """Units of a text, matched left to right: whole blocks of them first, then those of the rest."""
    block = f"(?:{unit}){{{COUNTED}}}+"
    rest = F.regexp_replace(text, f"^(?:{block})*+", "")
    return (F.regexp_count(text, F.lit(block)) * COUNTED + F.regexp_count(rest, F.lit(unit))).cast("long")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four whole numbers of a row: the first 8-digit groups of the SHA-256 of seed and id, from 0 to 2^32 - 1."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("long").cast("string"), F.lit("")))
    digest = F.sha2(name, 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _literal(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text an output was made of, read from output and form alone."""
    p, s, m = (_quoted(x) for x in sentinels)
    psm = F.regexp_replace(output, f"(?s)^{p}(.*?){s}(.*?){m}(.*+)", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)^{s}(.*?){p}(.*?){m}(.*+)", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(
    docs: DataFrame,
    unit: str = CODE_POINT,
    seed: int = 1,
    rate: int = 90,
    suffix_first: int = 20,
    sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """doc_id, n, form, prefix_units, middle_units, output: one row per document, in no order.

    `unit` is a pattern that matches at the start of any text that is not empty. Of a hundred texts about
    `rate` are cut, `suffix_first` of a hundred of these with the suffix first (form spm, else psm); empty
    texts, those that hold a sentinel and the others stay as they are (plain). Null text counts as empty. The cuts
    depend on the doc_id alone, so repeated rows give equal rows; rows of null doc_id are drawn as one id.
    Cuts may coincide: prefix, middle or suffix may be empty. Other columns are ignored; an empty table gives
    an empty result. Nothing is shuffled.
    """
    p, s, m = (_literal(x) for x in sentinels)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    counted = rows.select("doc_id", "text", unit_count(F.col("text"), unit).alias("n"), *[
        h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed), 1)
    ])
    marked = [F.contains("text", F.lit(x)) for x in sentinels]
    plain = (F.col("text") == "") | marked[0] | marked[1] | marked[2] | (F.col("h3") % 100 >= rate)
    first, second = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    formed = counted.select(
        "doc_id", "text", "n",
        F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm").alias("form"),
        F.least(first, second).alias("a"), F.greatest(first, second).alias("b"),
    )
    cut = F.concat(
        F.lit(f"^((?:{unit}){{"), F.col("a"), F.lit(f"}}+)((?:{unit}){{"), F.col("b") - F.col("a"), F.lit(f"}}+)((?:{unit})*+)")
    )
    order = F.when(F.col("form") == "psm", f"{p}$1{s}$3{m}$2").otherwise(f"{s}$3{p}$1{m}$2")
    is_cut = F.col("form") != "plain"
    return formed.select(
        "doc_id", "n", "form",
        F.when(is_cut, F.col("a")).alias("prefix_units"),
        F.when(is_cut, F.col("b") - F.col("a")).alias("middle_units"),
        F.when(is_cut, F.regexp_replace("text", cut, order)).otherwise(F.col("text")).alias("output"),
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut at code points, with digests of the outputs and of the texts rebuilt from them."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s
  FROM documents
), h AS (
  SELECT doc_id, t, n, CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4
  FROM d
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), c AS (
  SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS x FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m
              ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""
