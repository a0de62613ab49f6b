"""Venue scans: strict JSON, CSV import with a quality report, ordered and limited reads."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taproom.functions import text
from taproom.operators import quality
from taproom.session import cut
from taproom.sources import schemas


# How an import may spell a boolean.
TRUE_WORDS = ("1", "true", "t", "yes", "y", "on")
FALSE_WORDS = ("0", "false", "f", "no", "n", "off")


def between(column: str, low: float, high: float) -> Column:
    value = F.col(column)
    return value.isNull() | value.between(low, high)


def venue_rules() -> list[quality.Rule]:
    """Range rules of a stored venue; a missing optional value is fine."""
    return [
        ("venueId", F.col("venueId").isNotNull(), "is required"),
        ("name", F.col("name").isNotNull(), "is required"),
        ("area", F.col("area").isNotNull(), "is required"),
        ("latitude", F.col("latitude").between(-90, 90), "must be between -90 and 90"),
        ("longitude", F.col("longitude").between(-180, 180), "must be between -180 and 180"),
        ("priceTier", between("priceTier", 1, 4), "must be between 1 and 4"),
        ("rating", between("rating", 0, 5), "must be between 0 and 5"),
        ("popularityScore", between("popularityScore", 0, 1), "must be between 0 and 1"),
    ]


def validated(frame: DataFrame, rules: list[quality.Rule]) -> DataFrame:
    """The frame itself; any row that breaks a rule stops the job."""
    broken = quality.issues(rules)
    ok = F.when(F.size(broken) == 0, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("invalid record: "), F.array_join(broken, "; "))).cast("boolean")
    )
    return frame.where(ok)


def read_json(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Strict scan of venue JSON: fixed schema, malformed or out-of-range records are errors.

    Files hold one record a line and are split among tasks. `lines=False` reads files that hold one
    list each; such a file is one task, so a large table should be many of them.
    """
    frame = (
        spark.read.schema(schemas.VENUE)
        .option("multiLine", not lines)
        .option("mode", "FAILFAST")
        .json(path)
    )
    return validated(frame, venue_rules())


def import_rules() -> list[quality.Rule]:
    """Rules of one imported row after typing (columns suffixed "_t" are the typed values)."""
    rules: list[quality.Rule] = [
        (name, F.length(F.coalesce(F.col(name), F.lit(""))) > 0, "must not be empty")
        for name in ("venueId", "name", "area", "dataSource")
    ]
    for name, low, high in (
        ("latitude", -90, 90), ("longitude", -180, 180), ("rating", 0, 5), ("popularityScore", 0, 1),
    ):
        rules.append((name, F.col(f"{name}_t").between(low, high), f"must be between {low} and {high}"))
    for name in ("servesFood", "hasOutdoorSeating", "showsSports", "suitableForGroups"):
        rules.append((name, F.col(f"{name}_t").isNotNull(), "must be a boolean"))
    for name, allowed in (
        ("priceLevel", ("cheap", "moderate", "expensive")),
        ("noiseLevel", ("quiet", "moderate", "lively")),
    ):
        rules.append((name, F.col(name).isin(*allowed), "must be " + ", ".join(allowed)))
    rules.append(("lastVerifiedDate", F.col("lastVerifiedDate_t").isNotNull(), "must be a date"))
    return rules


def typed_import(raw: DataFrame) -> DataFrame:
    """All-string rows plus typed columns, tag list and issues."""
    quality.require_columns(raw, schemas.IMPORT_REQUIRED)
    out = raw
    for name in ("latitude", "longitude", "rating", "popularityScore"):
        out = out.withColumn(f"{name}_t", F.col(name).try_cast("double"))
    for name in ("servesFood", "hasOutdoorSeating", "showsSports", "suitableForGroups"):
        word = F.lower(F.trim(F.col(name)))
        out = out.withColumn(
            f"{name}_t", F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
        )
    out = out.withColumn("lastVerifiedDate_t", F.col("lastVerifiedDate").try_cast("date"))
    tags = F.filter(
        F.transform(F.split(F.coalesce("tags", F.lit("")), r"\|"), text.strip), lambda tag: tag != ""
    )
    return out.withColumn("tagList", tags).withColumn("issues", quality.issues(import_rules()))


def check_import(raw: DataFrame, order: str) -> DataFrame:
    """Typed rows with issues and the duplicate flag (an earlier accepted row shares id or identity)."""
    typed = typed_import(raw)
    valid = typed.where(F.size("issues") == 0).withColumn(
        "_identity", F.concat_ws("\u0001", F.lower(F.trim("name")), F.lower(F.trim("area")))
    )
    marked = quality.first_accepted(
        valid.select(order, "venueId", "_identity"), order, ["venueId", "_identity"]
    ).select(order, "duplicate")
    return typed.join(marked, order, "left").withColumn(
        "duplicate", F.coalesce("duplicate", F.lit(False))
    )


def read_csv(spark: SparkSession, path: str, order: str = "_row") -> DataFrame:
    """Rows of CSV files as text, with a column that orders them by file name and line.

    Quotes are doubled inside quotes and quoted fields may hold line ends. A file is read by one task,
    in which row numbers rise, so a large import should be many files.
    """
    raw = (
        spark.read.option("header", True).option("quote", '"').option("escape", '"')
        .option("multiLine", True).option("encoding", "UTF-8").csv(path)
    )
    line = F.lpad(F.monotonically_increasing_id().cast("string"), 19, "0")
    return raw.withColumn(order, F.concat_ws(":", F.col("_metadata.file_path"), line))


def import_csv(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    """Validate a CSV of venues; write the typed rows only when no row has an issue.

    Returns the one-row quality report. The checked rows are written once; the report and what is
    published are both read from there.
    """
    raw = cut(read_csv(spark, path))
    checked = cut(check_import(raw, "_row"))
    report = quality.import_counts(checked)
    if target is not None and report.first()["isClean"]:
        typed = [c for c in checked.columns if c.endswith("_t")]
        names = [c for c in raw.columns if f"{c}_t" not in typed and c not in ("_row", "tags")]
        checked.select(
            *names, *[F.col(c).alias(c[:-2]) for c in typed], F.col("tagList").alias("tags")
        ).write.mode("overwrite").json(target)
    return report


def ordered(venues: DataFrame) -> DataFrame:
    """Stable order: folded name, then id."""
    return venues.orderBy(F.lower("name"), "venueId")


def browse(frame: DataFrame, limit: float | None = None, key: str = "id") -> DataFrame:
    """First rows by name; the limit is clamped to 1..5000 and defaults to 500."""
    rows = 500 if limit is None or limit != limit else min(max(int(limit // 1), 1), 5000)
    return frame.orderBy("name", key).limit(rows)


def with_fallback(read_primary, read_fallback, limit: int) -> DataFrame:
    """Primary rows, or the first rows of the fallback reshaped when the primary cannot be read.

    Spark meets a broken store only when it runs, so one row is read to find out. Errors of the store
    or of Spark's readers mean the fallback; errors in the code are raised.
    """
    try:
        rows = read_primary()
        rows.take(1)
    except (OSError, PySparkException, Py4JError):
        return fallback_rows(read_fallback(), limit)
    return browse(rows, limit)


def fallback_rows(venues: DataFrame, limit: int) -> DataFrame:
    """Canonical venues in the shape of the relational table."""
    hours = F.col("openingHours") if "openingHours" in venues.columns else F.lit(None).cast("string")
    return venues.orderBy(F.lower("name"), "venueId").limit(limit).select(
        F.col("venueId").alias("id"),
        "name",
        "latitude",
        "longitude",
        F.coalesce("address", "area").alias("address"),
        "website",
        "phone",
        F.create_map(
            F.lit("area"), F.coalesce("area", F.lit("")),
            F.lit("features"), F.array_join("tags", " "),
        ).alias("tags"),
        hours.alias("openingHours"),
        F.when(F.coalesce(hours, F.lit("")) != "", "osm").otherwise("none").alias("hoursSource"),
        F.lit("openStreetMap").alias("addressSource"),
    )


def selected_ids(lines: DataFrame, column: str = "item") -> DataFrame:
    """Ids of a list whose items are strings or objects with a venueId (one JSON item per row)."""
    item = F.col(column)
    plain = F.get_json_object(F.concat(F.lit('{"v":'), item, F.lit("}")), "$.v")
    found = F.when(item.startswith("{"), F.get_json_object(item, "$.venueId")).when(
        item.startswith('"'), plain
    )
    return lines.select(found.alias("venueId")).where(F.col("venueId").isNotNull()).distinct()


