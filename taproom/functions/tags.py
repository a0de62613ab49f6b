"""Map-source tags: three-valued facts, addresses, client fields. Tags are map<string,string>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taproom import vocab as V
from taproom.functions.text import blank_to_null, strip


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def present(tags: Column, key: str) -> Column:
    """Tag value as it is, null when blank."""
    value = tag(tags, key)
    return F.when(strip(value) != "", value)


def first_present(tags: Column, *keys: str) -> Column:
    return F.coalesce(*[present(tags, key) for key in keys])


def mapped(tags: Column, key: str, yes: tuple[str, ...]) -> Column:
    """False for "no" alone, true for any listed value, unknown otherwise."""
    parts = F.array_distinct(
        F.transform(F.split(present(tags, key), ";"), lambda part: F.lower(strip(part)))
    )
    return F.when(parts == F.array(F.lit("no")), F.lit(False)).when(
        F.arrays_overlap(parts, F.array(*[F.lit(value) for value in yes])), F.lit(True)
    )


def explicit(tags: Column, key: str) -> Column:
    return mapped(tags, key, V.TAG_TRUE_VALUES)


def serves_food(tags: Column) -> Column:
    return F.coalesce(
        explicit(tags, "food"), F.when(present(tags, "cuisine").isNotNull(), F.lit(True))
    )


def live_music(tags: Column) -> Column:
    return F.coalesce(mapped(tags, "live_music", ("yes",)), mapped(tags, "music:live", ("yes",)))


def source_facts(tags: Column) -> dict[str, Column]:
    """The six facts the map source can state."""
    return {
        "servesFood": serves_food(tags),
        "hasOutdoorSeating": explicit(tags, "outdoor_seating"),
        "hasLiveMusic": live_music(tags),
        "dogFriendly": mapped(tags, "dog", ("yes", "leashed")),
        "wheelchairAccessible": mapped(tags, "wheelchair", ("yes",)),
        "acceptsReservations": mapped(tags, "reservation", ("yes", "required", "recommended")),
    }


def source_address(tags: Column) -> Column:
    """Full address tag, else number and street."""
    parts = F.concat_ws(" ", present(tags, "addr:housenumber"), present(tags, "addr:street"))
    return F.coalesce(present(tags, "addr:full"), F.nullif(parts, F.lit("")))


def import_address(tags: Column) -> Column:
    """Address of the relational import: number, street, city, postcode joined by commas."""
    keys = ("addr:housenumber", "addr:street", "addr:city", "addr:postcode")
    parts = [F.nullif(tag(tags, key), F.lit("")) for key in keys]
    return F.nullif(F.concat_ws(", ", *parts), F.lit(""))


def client_address(tags: Column, address: Column) -> Column:
    """Address shown by clients: full text, else distinct parts from the tags."""
    full = F.coalesce(blank_to_null(tag(tags, "addr:full")), blank_to_null(address))

    def some(key: str) -> Column:
        return F.nullif(tag(tags, key), F.lit(""))

    street = F.coalesce(
        blank_to_null(F.concat_ws(" ", some("addr:housenumber"), some("addr:street"))),
        blank_to_null(F.concat_ws(", ", some("addr:housename"), some("addr:street"))),
        some("addr:place"),
    )
    parts = F.array(
        blank_to_null(street), blank_to_null(tag(tags, "addr:suburb")),
        blank_to_null(tag(tags, "addr:city")), blank_to_null(tag(tags, "addr:postcode")),
    )
    joined = F.array_join(F.array_distinct(F.array_compact(parts)), ", ")
    return F.nullif(F.coalesce(full, joined), F.lit(""))


def yes_no(value: Column) -> Column:
    folded = F.lower(strip(value))
    return F.when(folded.isin("yes", "true", "designated"), F.lit(True)).when(
        folded.isin("no", "false"), F.lit(False)
    )


def wifi(value: Column) -> Column:
    folded = F.lower(strip(value))
    return F.when(folded.isin("wlan", "yes", "free"), F.lit(True)).when(
        folded.isin("no", "none"), F.lit(False)
    )


def cuisines(tags: Column) -> Column:
    parts = F.split(F.coalesce(tag(tags, "cuisine"), F.lit("")), ";")
    return F.filter(F.transform(parts, lambda p: F.lower(strip(p))), lambda p: p != "")


def client_area(tags: Column) -> Column:
    keys = ("area", "addr:suburb", "addr:district", "addr:neighbourhood", "addr:place")
    return F.coalesce(*[tag(tags, key) for key in keys])


CLIENT_FLAGS = {
    "hasFood": "food",
    "hasOutdoorSeating": "outdoor_seating",
    "hasLiveSport": "live_sport",
    "hasVeganOptions": "diet:vegan",
    "hasVegetarianOptions": "diet:vegetarian",
    "hasGlutenFreeOptions": "diet:gluten_free",
}
# Labels of the flags on a detail page, in order.
CLIENT_FLAG_LABELS = {
    "hasFood": "Food",
    "hasOutdoorSeating": "Outdoor seating",
    "hasLiveSport": "Live sport",
    "hasWifi": "Wi-Fi",
    "hasVeganOptions": "Vegan options",
    "hasVegetarianOptions": "Vegetarian options",
    "hasGlutenFreeOptions": "Gluten-free options",
}


def client_fields(tags: Column) -> dict[str, Column]:
    from taproom.functions.hours import open_late

    flags = {name: yes_no(tag(tags, key)) for name, key in CLIENT_FLAGS.items()}
    return {
        **flags,
        "hasWifi": wifi(tag(tags, "internet_access")),
        "isOpenLate": open_late(tag(tags, "opening_hours")),
        "cuisines": cuisines(tags),
        "area": client_area(tags),
    }


def search_index(name: Column, address: Column, tags: Column) -> Column:
    from taproom.functions.text import search_text

    parts = [name, address, *[tag(tags, f"addr:{k}") for k in ("postcode", "street", "city")]]
    filled = [F.nullif(part, F.lit("")) for part in (*parts, client_area(tags))]
    return search_text(F.concat_ws(" ", *filled, cuisines(tags)))


def root_or_tag(root: Column, tags: Column, *keys: str) -> Column:
    """First non-blank of a root field and ordered tags."""
    return F.coalesce(blank_to_null(root), *[blank_to_null(tag(tags, key)) for key in keys])


def web_address(value: Column) -> Column:
    return F.when(F.rlike(value, F.lit("(?i)^https?://")), value).otherwise(
        F.concat(F.lit("https://"), value)
    )


def cuisine_list(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, "[;,]"), strip), lambda part: part != "")


def commons_file(value: Column) -> Column:
    """File name of an image reference: the part after the file marker, blanks for underscores."""
    marked = F.regexp_extract(value, r"(?i)(?:File:|file/)([^#?]+)$", 1)
    plain = F.when(marked != "", F.try_url_decode(marked)).otherwise(
        F.regexp_replace(value, "(?i)^File:", "")
    )
    return F.nullif(strip(F.replace(plain, F.lit("_"), F.lit(" "))), F.lit(""))


def image_url(commons: Column, direct: Column) -> Column:
    """Image to show: the commons file, else a direct http image, else none."""
    name = commons_file(commons)
    encoded = F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))
    root = "https://commons.wikimedia.org/wiki/Special:FilePath/"
    return F.when(
        name.isNotNull(), F.concat(F.lit(root), encoded, F.lit("?width=1200"))
    ).when(F.rlike(direct, F.lit("(?i)^https?://")), direct)


def wikidata_id(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, r"(?i)(?:entity/)?(Q\d+)", 1), F.lit(""))


def hours_label(source: Column, tags: Column) -> Column:
    tagged = F.coalesce(tag(tags, "opening_hours"), F.lit("")) != ""
    return (
        F.when(source == "manual", "Hours from manual correction")
        .when(source == "official", "Hours from official website")
        .when(
            (source == "osm") | ((F.coalesce(source, F.lit("")) == "") & tagged),
            "Hours from OpenStreetMap",
        )
    )


def detail_labels(flags: dict[str, Column], cuisine: Column) -> Column:
    """Labels of true flags, then cuisines with capital initials."""
    shown = [F.when(flags[name], F.lit(label)) for name, label in CLIENT_FLAG_LABELS.items()]
    return F.concat(
        F.array_compact(F.array(*shown)),
        F.transform(F.coalesce(cuisine, F.array().cast("array<string>")), F.initcap),
    )


def client_labels(source: Column) -> Column:
    """Ordered labels whose needle the text contains; specific labels suppress general ones."""
    folded = F.lower(F.replace(source, F.lit("_"), F.lit(" ")))
    picked = []
    for needle, label in V.CLIENT_LABELS:
        hit = F.contains(folded, F.lit(needle))
        if label == "Music":
            hit = hit & ~F.contains(folded, F.lit("live music"))
        if label == "Roast dinners":
            hit = hit & ~F.contains(folded, F.lit("sunday roast"))
        picked.append(F.when(hit, F.lit(label)))
    return F.array_compact(F.array(*picked))
