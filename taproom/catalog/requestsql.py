"""SQL text of the request rules, for the twins of every query that parses requests."""

from __future__ import annotations

from taproom import vocab as V
from taproom.functions.requests import phrase_table


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def facts_list(name: str, options: dict[int, tuple[str, ...]]) -> str:
    cases = " ".join(
        f"WHEN {value} THEN [" + ", ".join(q(n) for n in names) + "]"
        for value, names in options.items()
        if names
    )
    return f"CASE s_suppkey % 4 {cases} ELSE CAST([] AS VARCHAR[]) END AS {name}"


PHRASES = "SELECT * FROM (VALUES " + ", ".join(
    f"({q(kind)}, {q(name)}, {order}, {q(phrase)})"
    for order, (kind, name, phrase) in enumerate(phrase_table())
) + ") p(kind, name, ord, phrase)"


def _count(lead: str) -> str:
    return f"len(regexp_extract_all(lower(t.query), concat({q(lead)}, p.phrase, {q(chr(92) + 'b')})))"


REQUEST_TEXTS = {"texts": "SELECT DISTINCT query FROM fx_request"}
FEEDBACK_TEXTS = {"texts": "SELECT DISTINCT query FROM fx_feedback WHERE coalesce(query, '') <> ''"}
WANTED = "(men > rej + sof OR sof > 0)"


def _set(kind: str, test: str) -> str:
    return (
        f"coalesce(list_sort(list(DISTINCT name) FILTER (kind = '{kind}' AND {test})), CAST([] AS VARCHAR[]))"
    )


def _size(group: int) -> str:
    return f"nullif(regexp_extract(lower(h.query), {q(V.GROUP_SIZE)}, {group}), '')"


PREFS = {
    "phrases": PHRASES,
    "hits": (
        f"SELECT t.query, p.kind, p.name, p.ord, {_count(V.NEGATIVE_LEAD)} AS rej, {_count(V.SOFT_LEAD)} AS sof, "
        f"{_count(chr(92) + 'b')} AS men FROM texts t JOIN phrases p ON contains(lower(t.query), p.phrase)"
    ),
    "sets": (
        "SELECT t.query, arg_min(name, ord) FILTER (kind = 'area' AND " + WANTED + ") AS location, "
        + _set("area", "rej > 0") + " AS excludedLocations, "
        "arg_min(name, ord) FILTER (kind = 'price' AND " + WANTED + ") AS priceLevel, "
        + _set("price", "rej > 0") + " AS excludedPriceLevels, "
        + _set("noise", "men > rej + sof") + " AS noiseReq, "
        + _set("noise", "men > rej + sof AND rej > 0") + " AS noiseClash, "
        + _set("noise", "rej > 0") + " AS noiseRej, " + _set("noise", "sof > 0") + " AS noiseSoft, "
        + _set("feature", "men > rej + sof") + " AS req, " + _set("feature", "sof > 0") + " AS soft, "
        + _set("feature", "rej > 0") + " AS rejected "
        "FROM texts t LEFT JOIN hits ON hits.query = t.query GROUP BY t.query"
    ),
    "sized": (
        f"SELECT h.*, CAST(coalesce({_size(1)}, {_size(2)}) AS INT) AS size, "
        f"nullif(upper(regexp_replace(CASE WHEN regexp_extract(h.query, {q(V.FULL_POSTCODE)}, 1) <> '' THEN "
        f"regexp_extract(h.query, {q(V.FULL_POSTCODE)}, 1) ELSE regexp_extract(h.query, {q(V.OUTWARD_POSTCODE)}, 1) END, "
        "'\\s+', '', 'g')), '') AS postcode, "
        "list_filter(rejected, lambda x: list_contains(req, x) OR list_contains(soft, x)) AS clash FROM sets h"
    ),
    "prefs": (
        "SELECT query, location, postcode, excludedLocations, priceLevel, excludedPriceLevels, "
        "CASE WHEN len(noiseReq) = 1 THEN noiseReq[1] END AS noiseLevel, "
        f"CASE WHEN size BETWEEN 1 AND {V.MAX_GROUP} THEN size END AS groupSize, "
        "list_sort(list_distinct(list_concat(list_filter(req, lambda x: NOT list_contains(clash, x)), "
        f"CASE WHEN size BETWEEN 1 AND {V.MAX_GROUP} THEN ['groups'] ELSE CAST([] AS VARCHAR[]) END))) AS requiredFeatures, "
        "list_sort(list_concat(soft, list_transform(noiseSoft, lambda x: x || 'Atmosphere'))) AS preferredFeatures, "
        "list_sort(list_concat(rejected, list_transform(noiseRej, lambda x: x || 'Atmosphere'))) AS excludedFeatures, "
        "list_sort(list_concat(list_concat(clash, CASE WHEN list_contains(excludedLocations, location) THEN ['location'] "
        "ELSE CAST([] AS VARCHAR[]) END), list_concat(CASE WHEN list_contains(excludedPriceLevels, priceLevel) THEN ['priceLevel'] "
        "ELSE CAST([] AS VARCHAR[]) END, CASE WHEN len(noiseReq) > 1 OR len(noiseClash) > 0 THEN ['noiseLevel'] "
        "ELSE CAST([] AS VARCHAR[]) END))) AS contradictions FROM sized"
    ),
}
