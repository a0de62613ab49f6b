"""Text normalisers as column expressions. `lower` stands in for full case folding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from taproom import vocab as V

EDGE_SPACE = r"^\s+|\s+$"


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def squeeze(text: Column) -> Column:
    """Turn every run of white space into one blank and trim."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def blank_to_null(text: Column) -> Column:
    """Null for missing or white-space-only text, else the trimmed text."""
    return F.nullif(strip(text), F.lit(""))


def words_only(text: Column) -> Column:
    """Lower-case letters and digits, one blank between words."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def match_name(text: Column) -> Column:
    """Name used to compare two sources: words only, one leading article dropped."""
    return F.regexp_replace(words_only(text), "^the ", "")


def directory_name(text: Column) -> Column:
    """Name used to compare with directory listings (entities already decoded)."""
    folded = F.replace(F.lower(text), F.lit("’"), F.lit("'"))
    for pattern in (r"\([^)]*\)", r"\band\b", r"\b(?:the|jd wetherspoon|pub|kentish town)\b"):
        folded = F.regexp_replace(folded, pattern, " ")
    return F.regexp_replace(folded, "[^a-z0-9]+", "")


def site_name(text: Column) -> Column:
    """Name used on venue web sites: the word "the" goes wherever it stands."""
    return words_only(F.regexp_replace(F.lower(text), r"\bthe\b", ""))


def names_compatible(left: Column, right: Column) -> Column:
    """Equal, or one contains the other; an empty name is compatible with nothing."""
    known = (F.length(left) > 0) & (F.length(right) > 0)
    return known & (F.contains(left, right) | F.contains(right, left))


def postcode_key(text: Column) -> Column:
    """Postcode without blanks, lower case (source matching)."""
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def postcode_prefix_key(text: Column) -> Column:
    """Postcode without blanks, upper case, never null (prefix filter)."""
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""))


def full_postcode(text: Column) -> Column:
    """First complete postcode in a text, upper case without blanks, else null."""
    found = F.regexp_extract(text, V.FULL_POSTCODE, 1)
    return F.nullif(F.upper(F.regexp_replace(found, r"\s+", "")), F.lit(""))


def phone_key(text: Column) -> Column:
    """Last ten digits."""
    return F.right(F.regexp_replace(text, r"\D", ""), F.lit(10))


def decode_common_entities(text: Column) -> Column:
    """The handful of entities that fixed page templates use, decoded without Python."""
    for source, target in (
        ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "),
        ("&amp;", "&"),
    ):
        text = F.replace(text, F.lit(source), F.lit(target))
    return text


# Street words and place words of addresses.
STREET_WORDS = {
    "street": "st", "road": "rd", "avenue": "ave", "terrace": "ter", "lane": "ln",
    "place": "pl", "square": "sq",
}
PLACE_WORDS = ("london", "uk", "greater", "england")


def address_tokens(text: Column) -> Column:
    """Distinct address words with street words shortened and place words dropped."""
    folded = reduce(
        lambda column, pair: F.replace(column, F.lit(pair[0]), F.lit(pair[1])),
        STREET_WORDS.items(),
        F.lower(F.coalesce(text, F.lit(""))),
    )
    tokens = F.regexp_extract_all(folded, F.lit("([a-z0-9]+)"), 1)
    return F.array_except(tokens, F.array(*[F.lit(word) for word in PLACE_WORDS]))


def retrieval_tokens(text: Column) -> Column:
    """Distinct words longer than one character that are not stop words."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)
    stop = F.array(*[F.lit(word) for word in V.RETRIEVAL_STOP_WORDS])
    return F.filter(F.array_except(tokens, stop), lambda token: F.length(token) > 1)


def tag_slugs(values: Column) -> Column:
    """Distinct sorted lower-case labels with blanks turned into hyphens."""
    slug = F.transform(values, lambda value: F.replace(F.lower(value), F.lit(" "), F.lit("-")))
    return F.array_sort(F.array_distinct(slug))


def strip_markup(text: Column) -> Column:
    """Plain text of an HTML fragment: tags out, four entities decoded, blanks squeezed."""
    text = F.regexp_replace(text, "<[^>]*>", " ")
    for pattern, value in (("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("(?i)&#39;", "'")):
        text = F.regexp_replace(text, pattern, value)
    return squeeze(text)


def search_text(text: Column) -> Column:
    """Search form: lower case, "burgers" read as "burger", blanks squeezed."""
    return squeeze(F.regexp_replace(F.lower(text), r"\bburgers\b", "burger"))


def query_key(text: Column) -> Column:
    """Request text without superficial differences."""
    return F.regexp_replace(strip(F.lower(text)), r"\s+", " ")


def all_matches(text: Column, pattern: str | Column) -> Column:
    """Every match of a pattern with its zero-based span: array<struct<start,end,text>>.

    The pieces between matches and the matches themselves come from two built-in functions, so the
    offsets follow by adding up lengths and no Python runs.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, 0)
    between = F.split(text, pattern, -1)
    spans = F.zip_with(
        F.slice(between, 1, F.size(found)),
        found,
        lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match")),
    )
    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")
    folded = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda state, span: F.struct(
            (state["at"] + span["gap"] + F.length(span["match"])).alias("at"),
            F.concat(
                state["out"],
                F.array(
                    F.struct(
                        (state["at"] + span["gap"]).alias("start"),
                        (state["at"] + span["gap"] + F.length(span["match"])).alias("end"),
                        span["match"].alias("text"),
                    )
                ),
            ).alias("out"),
        ),
    )
    return F.when(F.size(found) == 0, empty).otherwise(folded["out"])


def split_passage(text: Column, limit: int = V.PASSAGE_MAX) -> Column:
    """Cut an oversized block at sentence ends, packing sentences up to the limit.

    A sentence longer than the limit is cut at its last blank inside the limit and marked with an
    ellipsis. Pieces shorter than the minimum are dropped; short text is returned whole.
    """

    def shorten(sentence: Column) -> Column:
        start = F.substring(sentence, 1, limit)
        cut = F.when(F.contains(start, F.lit(" ")), F.regexp_replace(start, " [^ ]*$", ""))
        cut = F.regexp_replace(F.coalesce(cut, start), "[ ,;:]+$", "")
        return F.when(F.length(sentence) > limit, F.concat(cut, F.lit("…"))).otherwise(sentence)

    sentences = F.transform(F.split(text, r"(?<=[.!?])\s+"), shorten)
    start = F.struct(
        F.lit("").alias("open"), F.array().cast("array<string>").alias("done")
    )

    def pack(state: Column, sentence: Column) -> Column:
        joined = F.trim(F.concat(state["open"], F.lit(" "), sentence))
        full = (F.length(state["open"]) > 0) & (F.length(joined) > limit)
        return F.struct(
            F.when(full, sentence).otherwise(joined).alias("open"),
            F.when(full, F.array_append(state["done"], state["open"]))
            .otherwise(state["done"])
            .alias("done"),
        )

    packed = F.aggregate(sentences, start, pack)
    pieces = F.array_append(packed["done"], packed["open"])
    long_enough = F.filter(pieces, lambda piece: F.length(piece) >= V.PASSAGE_MIN)
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(long_enough)


def one_decimal(value: Column) -> Column:
    """A number with one decimal, as Python's `.1f` writes it: its exact binary value rounds half to even.

    `format_string` rounds the shortest decimal half up, so 0.15, which lies below its decimal, would become 0.2.
    """
    size = F.abs(value.cast("double"))
    tenths = F.floor(size * 10)
    # Twenty times the number less the odd number halfway; both steps are exact where it is close to zero.
    over = (size * 16 - (tenths * 2 + 1)) + size * 4
    up = (over > 0) | ((over == 0) & (tenths % 2 == 1))
    rounded = tenths + up.cast("long")
    sign = F.when(value < 0, F.lit("-")).otherwise("")
    shown = F.concat(sign, F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"))
    return F.when(size < 1e12, shown).otherwise(F.format_string("%.1f", value))
