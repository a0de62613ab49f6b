"""Opening hours: validity, weekly rows, open-late flag."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from taproom import vocab as V
from taproom.functions.text import strip

DAY = "(?:Mo|Tu|We|Th|Fr|Sa|Su)"
RULE = rf"^{DAY}(?:-{DAY})?(?:,{DAY})*\s+(.+)$"
RANGE = r"\d{1,2}:\d{2}\s*-\s*\d{1,2}:\d{2}"
# Hours 0 to 24, minutes 0 to 59, and nothing after 24:00.
GOOD_TIME = r"(?:(?:[01]?\d|2[0-3]):[0-5]\d|24:00)"
GOOD_RANGE = rf"^{GOOD_TIME}\s*-\s*{GOOD_TIME}$"


def rules(hours: Column) -> Column:
    """Trimmed, non-empty rules of an opening-hours text."""
    parts = F.transform(F.split(hours, ";"), strip)
    return F.filter(parts, lambda part: part != "")


def valid(hours: Column) -> Column:
    """The trimmed text when every rule has days and valid times, "24/7" as such, else null."""
    trimmed = strip(hours)
    parts = rules(trimmed)

    def good(rule: Column) -> Column:
        ranges = F.regexp_extract_all(F.regexp_extract(rule, RULE, 1), F.lit(f"({RANGE})"), 1)
        return (
            F.rlike(rule, F.lit(RULE))
            & (F.size(ranges) > 0)
            & F.forall(ranges, lambda r: F.rlike(r, F.lit(GOOD_RANGE)))
        )

    return F.when(trimmed == "24/7", F.lit("24/7")).when(
        (F.size(parts) > 0) & F.forall(parts, good), trimmed
    )


def _day_index(code: Column) -> Column:
    return F.array_position(F.array(*[F.lit(day) for day in V.DAY_CODES]), code)


def _days(expression: Column) -> Column:
    """1-based week days of "Mo-Th,Sa"; null when a token is no day. Ranges do not wrap."""
    tokens = F.filter(F.transform(F.split(expression, ","), strip), lambda token: token != "")
    good = (F.size(tokens) > 0) & F.forall(
        tokens, lambda token: F.rlike(token, F.lit(rf"^{DAY}(?:-{DAY})?$"))
    )

    def expand(token: Column) -> Column:
        start = _day_index(F.substring(token, 1, 2)).cast("int")
        end = F.when(F.length(token) > 2, _day_index(F.right(token, F.lit(2))).cast("int")).otherwise(
            start
        )
        return F.when(end >= start, F.sequence(start, end)).otherwise(F.array().cast("array<int>"))

    return F.when(good, F.array_distinct(F.flatten(F.transform(tokens, expand))))


def weekly(hours: Column) -> Column:
    """array<struct<day,hours>> for a complete week in week order; empty when it is not one."""
    trimmed = strip(hours)

    def show(time_range: Column) -> Column:
        times = F.transform(
            F.split(time_range, r"\s*-\s*"),
            lambda time: F.when(time == "24:00", F.lit("00:00")).otherwise(time),
        )
        return F.array_join(times, "–")

    parsed = F.transform(
        rules(trimmed),
        lambda rule: F.struct(
            _days(strip(F.regexp_extract(rule, r"^(.*?)\d{1,2}:\d{2}", 1))).alias("days"),
            F.array_join(
                F.transform(F.regexp_extract_all(rule, F.lit(f"({RANGE})"), 1), show), ", "
            ).alias("hours"),
        ),
    )
    usable = F.filter(parsed, lambda p: (p["hours"] != "") & p["days"].isNotNull())

    def day_row(position: int, name: str) -> Column:
        mine = F.filter(usable, lambda p: F.array_contains(p["days"], position))
        joined = F.array_join(F.transform(mine, lambda p: p["hours"]), ", ")
        return F.struct(F.lit(name).alias("day"), joined.alias("hours"))

    week = F.array(*[day_row(i + 1, name) for i, name in enumerate(V.DAY_NAMES)])
    always = F.array(
        *[
            F.struct(F.lit(name).alias("day"), F.lit("Open 24 hours").alias("hours"))
            for name in V.DAY_NAMES
        ]
    )
    nothing = F.array().cast("array<struct<day:string,hours:string>>")
    complete = F.forall(week, lambda row: row["hours"] != "")
    return F.when(F.lower(trimmed) == "24/7", always).when(complete, week).otherwise(nothing)


def open_late(hours: Column) -> Column:
    """Whether a Friday or Saturday rule closes at or after midnight; null without such a rule.

    Day ranges may wrap around the week. A closing hour of 24 or more, or of 6 or less, is late.
    """

    def weekend(token: Column) -> Column:
        start = _day_index(F.substring(token, 1, 2))
        end = F.when(F.length(token) > 2, _day_index(F.right(token, F.lit(2)))).otherwise(start)
        inside = lambda day: F.when(
            start <= end, (start <= day) & (day <= end)
        ).otherwise((day >= start) | (day <= end))
        return inside(F.lit(5)) | inside(F.lit(6))

    def closings(rule: Column) -> Column:
        return F.regexp_extract_all(rule, F.lit(r"\d{1,2}:\d{2}\s*-\s*(\d{1,2}):\d{2}"), 1)

    def counts(rule: Column) -> Column:
        lead = F.regexp_extract(rule, r"^(.*?)\s+(?=\d{1,2}:\d{2})", 1)
        tokens = F.regexp_extract_all(lead, F.lit(f"({DAY}(?:-{DAY})?)"), 1)
        return F.exists(tokens, weekend) & (F.size(closings(rule)) > 0)

    relevant = F.filter(F.split(hours, ";"), counts)
    late = F.exists(
        relevant,
        lambda rule: F.exists(
            closings(rule), lambda hour: (hour.cast("int") >= 24) | (hour.cast("int") <= 6)
        ),
    )
    return F.when(F.lower(strip(hours)) == "24/7", F.lit(True)).when(F.size(relevant) > 0, late)


def from_specifications(specs: Column) -> Column:
    """Text like "Mo 11:00-23:00,…; Tu …" from array<struct<day,opens,closes>> (day codes)."""

    def day_text(code: str) -> Column:
        mine = F.filter(specs, lambda s: s["day"] == code)
        ranges = F.transform(mine, lambda s: F.concat_ws("-", s["opens"], s["closes"]))
        return F.when(
            F.size(mine) > 0, F.concat(F.lit(f"{code} "), F.array_join(ranges, ","))
        )

    days = F.array_compact(F.array(*[day_text(code) for code in V.DAY_CODES]))
    return F.when(F.size(days) > 0, F.array_join(days, "; "))


def day_code(value: Column) -> Column:
    """Two-letter code of a schema.org day, a plain day name or a code; null otherwise."""
    name = F.lower(F.regexp_replace(value, r"(?i)^https?://schema\.org/", ""))
    named = reduce(
        lambda column, pair: column.when(name == pair[0].lower(), pair[1]),
        list(zip(V.DAY_NAMES, V.DAY_CODES, strict=True))[1:],
        F.when(name == V.DAY_NAMES[0].lower(), V.DAY_CODES[0]),
    )
    return F.coalesce(named, F.when(value.isin(*V.DAY_CODES), value))
