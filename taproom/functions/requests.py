"""Free-text requests to structured preferences, as one array expression per row.

The phrase table is a constant array: phrases a request does not contain are filtered out with a
plain substring test before any pattern runs, so a row pays only for the phrases it mentions and
nothing is joined, exploded or shuffled.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taproom import vocab as V
from taproom.functions.text import strip

KINDS = {
    "area": {area: (area.lower(),) for area in V.AREAS},
    "price": {level: (level,) for level in V.PRICE_LEVELS},
    "noise": {level: (level,) for level in V.NOISE_LEVELS},
    "feature": V.FEATURE_PHRASES,
}

PREFERENCE_SCHEMA = (
    "struct<location:string,postcode:string,excludedLocations:array<string>,priceLevel:string,"
    "excludedPriceLevels:array<string>,noiseLevel:string,groupSize:int,"
    "requiredFeatures:array<string>,preferredFeatures:array<string>,"
    "excludedFeatures:array<string>,contradictions:array<string>>"
)


def phrase_table() -> list[tuple[str, str, str]]:
    """(kind, name, phrase) in model order."""
    return [
        (kind, name, phrase)
        for kind, names in KINDS.items()
        for name, phrases in names.items()
        for phrase in phrases
    ]


def _strengths(lowered: Column) -> Column:
    rows = [{"kind": kind, "name": name, "phrase": p} for kind, name, p in phrase_table()]
    table = F.from_json(
        F.lit(json.dumps(rows)), "array<struct<kind:string,name:string,phrase:string>>"
    )
    mentioned = F.filter(table, lambda row: F.contains(lowered, row["phrase"]))

    def count(lead: str, row: Column) -> Column:
        return F.regexp_count(lowered, F.concat(F.lit(lead), row["phrase"], F.lit(r"\b")))

    return F.transform(
        mentioned,
        lambda row: F.struct(
            row["kind"].alias("kind"),
            row["name"].alias("name"),
            count(V.NEGATIVE_LEAD, row).alias("rejected"),
            count(V.SOFT_LEAD, row).alias("softened"),
            count(r"\b", row).alias("mentions"),
        ),
    )


def _names(strengths: Column, kind: str, test) -> Column:
    chosen = F.filter(strengths, lambda row: (row["kind"] == kind) & test(row))
    return F.array_distinct(F.transform(chosen, lambda row: row["name"]))


def _rejected(row: Column) -> Column:
    return row["rejected"] > 0


def _softened(row: Column) -> Column:
    return row["softened"] > 0


def _required(row: Column) -> Column:
    return row["mentions"] > row["rejected"] + row["softened"]


def _wanted(row: Column) -> Column:
    return _required(row) | _softened(row)


def _first_postcode(text: Column) -> Column:
    full = F.regexp_extract(text, V.FULL_POSTCODE, 1)
    outward = F.regexp_extract(text, V.OUTWARD_POSTCODE, 1)
    return F.when(full != "", full).otherwise(outward)


def _atmosphere(levels: Column) -> Column:
    return F.transform(levels, lambda level: F.concat(level, F.lit("Atmosphere")))


def with_preferences(frame: DataFrame, text: str = "query", into: str = "prefs") -> DataFrame:
    """Add the parsed preferences of a request column as one struct."""
    strengths = F.col("_strengths")
    lowered = F.lower(F.col(text))
    staged = frame.withColumn("_strengths", _strengths(lowered))
    size = F.coalesce(
        F.nullif(F.regexp_extract(lowered, V.GROUP_SIZE, 1), F.lit("")),
        F.nullif(F.regexp_extract(lowered, V.GROUP_SIZE, 2), F.lit("")),
    ).cast("int")
    required_noise = _names(strengths, "noise", _required)
    clashing_noise = _names(strengths, "noise", lambda row: _required(row) & _rejected(row))
    fields = {
        "location": F.get(_names(strengths, "area", _wanted), F.lit(0)),
        "postcode": F.nullif(
            F.upper(F.regexp_replace(_first_postcode(F.col(text)), r"\s+", "")), F.lit("")
        ),
        "excludedLocations": F.array_sort(_names(strengths, "area", _rejected)),
        "priceLevel": F.get(_names(strengths, "price", _wanted), F.lit(0)),
        "excludedPriceLevels": F.array_sort(_names(strengths, "price", _rejected)),
        "noiseLevel": F.when(F.size(required_noise) == 1, F.get(required_noise, F.lit(0))),
        "groupSize": F.when(size.between(1, V.MAX_GROUP), size),
        "_required": _names(strengths, "feature", _required),
        "_soft": _names(strengths, "feature", _softened),
        "_rejected": _names(strengths, "feature", _rejected),
        "_softNoise": _atmosphere(_names(strengths, "noise", _softened)),
        "_noNoise": _atmosphere(_names(strengths, "noise", _rejected)),
        "_noiseClash": (F.size(required_noise) > 1) | (F.size(clashing_noise) > 0),
    }
    staged = staged.withColumn("_p", F.struct(*[c.alias(name) for name, c in fields.items()]))
    part = {name: F.col("_p")[name] for name in fields}
    clashes = F.array_intersect(part["_rejected"], F.array_union(part["_required"], part["_soft"]))
    none = F.array().cast("array<string>")
    contradictions = F.concat(
        clashes,
        F.when(
            F.array_contains(part["excludedLocations"], part["location"]),
            F.array(F.lit("location")),
        ).otherwise(none),
        F.when(
            F.array_contains(part["excludedPriceLevels"], part["priceLevel"]),
            F.array(F.lit("priceLevel")),
        ).otherwise(none),
        F.when(part["_noiseClash"], F.array(F.lit("noiseLevel"))).otherwise(none),
    )
    group = F.when(part["groupSize"].isNotNull(), F.array(F.lit("groups"))).otherwise(none)
    required = F.array_union(F.array_except(part["_required"], clashes), group)
    prefs = F.struct(
        *[
            part[name].alias(name)
            for name in (
                "location", "postcode", "excludedLocations", "priceLevel",
                "excludedPriceLevels", "noiseLevel", "groupSize",
            )
        ],
        F.array_sort(required).alias("requiredFeatures"),
        F.array_sort(F.array_union(part["_soft"], part["_softNoise"])).alias("preferredFeatures"),
        F.array_sort(F.array_union(part["_rejected"], part["_noNoise"])).alias("excludedFeatures"),
        F.array_sort(contradictions).alias("contradictions"),
    )
    return staged.withColumn(into, prefs.cast(PREFERENCE_SCHEMA)).drop("_strengths", "_p")


def parsed_texts(frame: DataFrame, text: str = "query", into: str = "prefs") -> DataFrame:
    """(text, prefs) for every distinct request text.

    The closing aggregate is a fence: without it a later filter on a preference would be pushed
    below and evaluate the whole phrase expression again. The rows are already partitioned by the
    text, so it moves no data.
    """
    texts = with_preferences(frame.select(text).distinct(), text, into)
    return texts.groupBy(text).agg(F.first(into).alias(into))


def leftover_terms(text: Column) -> Column:
    """Words of a request that no phrase, prefix, number or filler accounts for."""
    phrases = {phrase for _, _, phrase in phrase_table()} | set(V.NEGATIVE_PREFIXES)
    phrases |= set(V.SOFT_PREFIXES)
    rest = F.regexp_replace(F.lower(text), V.GROUP_SIZE, " ")
    postcode = F.lower(_first_postcode(text))
    rest = F.when(postcode != "", F.replace(rest, postcode, F.lit(" "))).otherwise(rest)
    # Longest phrase first: a later, shorter phrase sees only what the longer ones left over.
    by_length: dict[int, list[str]] = {}
    for phrase in phrases:
        by_length.setdefault(len(phrase), []).append(re.escape(phrase))
    for length in sorted(by_length, reverse=True):
        any_phrase = "|".join(sorted(by_length[length]))
        rest = F.regexp_replace(rest, rf"\b(?:{any_phrase})\b", " ")
    words = F.regexp_extract_all(rest, F.lit("([a-z0-9'-]+)"), 1)
    filler = F.array(*[F.lit(word) for word in V.FILLER_WORDS])
    return F.filter(words, lambda word: ~F.array_contains(filler, word))


def signature(prefs: Column) -> Column:
    """Stable text of parsed preferences: equal text means equal meaning."""
    return F.to_json(prefs, {"ignoreNullFields": "false"})


def clauses(text: Column) -> Column:
    """Distinct clauses of at least three characters, in order."""
    parts = F.transform(F.split(text, V.CLAUSE_BREAK), strip)
    return F.array_distinct(F.filter(parts, lambda part: F.length(part) >= 3))


def is_negative_clause(clause: Column) -> Column:
    """A clause rejects something; positive step-free wording does not count as rejection."""
    positive = F.rlike(clause, F.lit(V.POSITIVE_ACCESS)) & ~F.rlike(clause, F.lit(V.NEGATED_ACCESS))
    return ~positive & F.rlike(clause, F.lit(V.CLAUSE_NEGATIVE))


def is_soft_clause(clause: Column) -> Column:
    return F.rlike(clause, F.lit(V.SOFT_CLAUSE))


def is_global_negative(query: Column) -> Column:
    """The whole request is a rejection."""
    return (
        F.rlike(query, F.lit(V.GLOBAL_NEGATIVE))
        & ~F.rlike(query, F.lit(V.CONTRAST))
        & ~F.rlike(query, F.lit(V.POSITIVE_ACCESS))
    )


def anchored_features(text: Column) -> Column:
    """Features whose anchor words occur in the text."""
    return F.array_compact(
        F.array(
            *[
                F.when(F.rlike(text, F.lit(pattern)), F.lit(feature))
                for feature, pattern in V.INTENT_ANCHORS.items()
            ]
        )
    )
