"""Registry of queries and the tables they read.

The inputs of most operators (venues, places, feedback, requests, passages) are derived from the
given tables by plain expressions. The same expression text builds the Spark frame and the common
table expression of the SQL twin, so both sides start from equal rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taproom import vocab as V
from taproom.session import tune


@dataclass
class Fixture:
    source: str
    joins: list[tuple[str, str]] = field(default_factory=list)
    where: str | None = None
    columns: dict[str, str] = field(default_factory=dict)

    def sql(self) -> str:
        picked = ", ".join(f"{expr} AS {name}" for name, expr in self.columns.items())
        joined = "".join(f" JOIN {table} ON {on}" for table, on in self.joins)
        kept = f" WHERE {self.where}" if self.where else ""
        return f"SELECT {picked} FROM {self.source}{joined}{kept}"


def _fact(position: int) -> str:
    return (
        f"CASE ((c_custkey * 31 + {position * 17}) % {5 + position}) % 5 "
        "WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE NULL END"
    )


KIND = "CASE c_custkey % 3 WHEN 0 THEN 'Arms' WHEN 1 THEN 'Tavern' ELSE 'Inn' END"
CUSTOMER_PART = [("part", "p_partkey = c_custkey")]
REQUEST = (
    "concat(CASE s_suppkey % 13 "
    "WHEN 0 THEN 'pub in Camden with food' WHEN 1 THEN 'quiet pub with no sports' "
    "WHEN 2 THEN 'dog friendly beer garden in Brixton' WHEN 3 THEN 'prefer live music' "
    "WHEN 4 THEN 'Cheap pub for 6 people' WHEN 5 THEN 'step-free pub in Westminster' "
    "WHEN 6 THEN 'lively place with a quiz night' WHEN 7 THEN 'expensive pub NW1 with dj' "
    "WHEN 8 THEN 'avoid Camden, happy hour please' WHEN 9 THEN 'food but no food' "
    "WHEN 10 THEN 'not cheap with events' WHEN 11 THEN 'no quiet pub, Waterloo' "
    "ELSE 'somewhere with vegan options and an accessible toilet' END, "
    "CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' with sunday roast' "
    "WHEN 2 THEN ', ideally a beer garden' WHEN 3 THEN ' without dogs welcome' "
    "ELSE ' and unusual carpets' END)"
)

FIXTURES: dict[str, Fixture] = {
    "venue": Fixture(
        "customer",
        CUSTOMER_PART,
        None,
        {
            "n": "c_custkey",
            "venueId": "concat('v-', CAST(c_custkey AS STRING))",
            "name": f"concat('The ', p_name, ' ', {KIND})",
            "latitude": "51.28E0 + CAST((c_custkey * 7919) % 4200 AS DOUBLE) / 1.0E4",
            "longitude": "-0.51E0 + CAST((c_custkey * 104729) % 8400 AS DOUBLE) / 1.0E4",
            "area": (
                "CASE c_nationkey % 6 WHEN 0 THEN 'Waterloo' WHEN 1 THEN 'London Bridge' "
                "WHEN 2 THEN 'Shoreditch' WHEN 3 THEN 'Brixton' WHEN 4 THEN 'Camden' "
                "ELSE 'Westminster' END"
            ),
            "address": (
                "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE "
                "concat(CAST(1 + c_custkey % 250 AS STRING), ' ', "
                "CASE c_custkey % 4 WHEN 0 THEN 'High Street' WHEN 1 THEN 'Mill Lane' "
                "WHEN 2 THEN 'Albion Road' ELSE 'Kings Square' END, ', London') END"
            ),
            "postcode": (
                "concat('NW', CAST(1 + c_custkey % 9 AS STRING), ' ', "
                "CAST(c_custkey % 10 AS STRING), 'AB')"
            ),
            "website": (
                "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE "
                "concat('https://www.venue', CAST(c_custkey AS STRING), '.example/pub') END"
            ),
            "phone": "concat('+44 20 7', lpad(CAST(c_custkey AS STRING), 7, '0'))",
            "priceTier": "CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_nationkey % 5 END",
            "priceLevel": (
                "CASE c_nationkey % 5 WHEN 1 THEN 'cheap' WHEN 2 THEN 'moderate' "
                "WHEN 3 THEN 'expensive' WHEN 4 THEN 'expensive' ELSE NULL END"
            ),
            "rating": "CASE WHEN c_acctbal < 0 THEN NULL ELSE least(5.0E0, c_acctbal / 2.0E3) END",
            "popularityScore": (
                "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE "
                "CAST(c_custkey % 101 AS DOUBLE) / 1.0E2 END"
            ),
            "noiseLevel": (
                "CASE c_custkey % 4 WHEN 0 THEN 'quiet' WHEN 1 THEN 'lively' "
                "WHEN 2 THEN 'moderate' ELSE NULL END"
            ),
            **{fact: _fact(position + 1) for position, fact in enumerate(V.FACTS)},
            "tagsText": (
                "concat('pub|', CASE c_custkey % 3 WHEN 0 THEN 'Real Ale' WHEN 1 "
                "THEN 'Beer Garden' ELSE 'historic' END, CASE WHEN c_custkey % 4 = 0 "
                "THEN '|pub' ELSE '|Live Music' END)"
            ),
            "dataSource": "'FSQ Places'",
            "sourceUrl": (
                "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE "
                "concat('https://listing.example/', CAST(c_custkey AS STRING)) END"
            ),
            "lastVerifiedDate": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE DATE '2026-08-01' END",
        },
    ),
    "place_b": Fixture(
        "customer",
        CUSTOMER_PART,
        "c_custkey % 10 < 8",
        {
            "n": "c_custkey",
            "osmElementId": "concat('node/', CAST(1000000 + c_custkey AS STRING))",
            "name": f"CASE WHEN c_custkey % 5 = 0 THEN upper(p_name) ELSE concat(p_name, ' ', {KIND}) END",
            "latitude": (
                "51.28E0 + CAST((c_custkey * 7919) % 4200 + (c_custkey % 7) - 3 AS DOUBLE) / 1.0E4"
            ),
            "longitude": (
                "-0.51E0 + CAST((c_custkey * 104729) % 8400 + (c_custkey % 5) - 2 AS DOUBLE) / 1.0E4"
            ),
            "address": (
                "CASE WHEN c_custkey % 13 = 0 THEN '' ELSE "
                "concat(CAST(1 + c_custkey % 250 AS STRING), ' Side Street') END"
            ),
            "postcode": (
                "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE concat('nw', "
                "CAST(1 + c_custkey % 9 AS STRING), CAST(c_custkey % 10 AS STRING), 'ab') END"
            ),
            "website": (
                "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE "
                "concat('venue', CAST(c_custkey AS STRING), '.example') END"
            ),
            "phone": (
                "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE "
                "concat('020 7', lpad(CAST(c_custkey AS STRING), 7, '0')) END"
            ),
            **{
                fact: _fact(position + 3)
                for position, fact in enumerate(
                    (
                        "servesFood", "hasOutdoorSeating", "hasLiveMusic", "dogFriendly",
                        "wheelchairAccessible", "acceptsReservations",
                    )
                )
            },
            "categoriesText": "CASE WHEN c_custkey % 2 = 0 THEN 'pub' ELSE 'Beer Garden|pub' END",
        },
    ),
    "feedback": Fixture(
        "events",
        [],
        None,
        {
            "n": "event_id",
            "eventId": "CAST(event_id AS STRING)",
            "venueId": "concat('v-', CAST((event_id * 13) % 160 AS STRING))",
            "eventType": (
                "CASE event_type WHEN 'purchase' THEN 'like' WHEN 'error' THEN 'dislike' "
                "WHEN 'view' THEN 'impression' WHEN 'signup' THEN 'save' ELSE 'click' END"
            ),
            "query": (
                "CASE event_id % 16 WHEN 0 THEN 'pub in Camden with food' "
                "WHEN 1 THEN 'Pub in  Camden with food ' WHEN 2 THEN 'quiet pub with no sports' "
                "WHEN 3 THEN 'dog friendly beer garden in Brixton' WHEN 4 THEN 'prefer live music' "
                "WHEN 5 THEN 'cheap pub for 6 people' WHEN 6 THEN 'step-free pub in Westminster' "
                "WHEN 7 THEN 'expensive pub with dj nights' WHEN 8 THEN 'sunday roast in Waterloo' "
                "WHEN 9 THEN 'lively quiz night' WHEN 10 THEN 'vegan menu' "
                "WHEN 11 THEN 'pub in Shoreditch with no dj' WHEN 12 THEN 'happy hour' "
                "WHEN 13 THEN 'book a table in London Bridge' WHEN 14 THEN 'watch the match' "
                "ELSE NULL END"
            ),
            "recommendationRank": "1 + event_id % 20",
            "sessionId": (
                "CASE WHEN user_id % 10 = 0 THEN NULL ELSE concat('s-', CAST(user_id AS STRING)) END"
            ),
            "recordedAt": "ts",
        },
    ),
    "rating": Fixture(
        "events",
        [],
        "event_type IN ('purchase', 'signup')",
        {
            "pos": "event_id",
            "userId": "user_id",
            "venueId": "concat('v-', CAST((event_id * 13) % 150 AS STRING))",
            "rating": (
                "CASE WHEN event_id % 17 = 0 THEN NULL ELSE "
                "1.0E0 + CAST(event_id % 9 AS DOUBLE) / 2.0E0 END"
            ),
            "beenHere": "event_id % 4 <> 0",
            "photo": (
                "CASE WHEN event_id % 5 = 0 THEN concat('photo-', CAST(event_id AS STRING)) "
                "ELSE NULL END"
            ),
            "updatedAt": "ts",
        },
    ),
    "price": Fixture(
        "lineitem",
        [],
        "l_linenumber = 1",
        {
            "observationId": "l_orderkey * 100000000 + l_partkey * 1000 + l_suppkey",
            "venueId": "concat('v-', CAST(l_partkey % 140 AS STRING))",
            "observedPriceGbp": "2.0E0 + l_quantity / 5.0E0",
            "observedAt": "l_shipdate",
            "evidenceUrl": "concat('https://menu.example/', CAST(l_suppkey % 5 AS STRING))",
        },
    ),
    "request": Fixture(
        "supplier",
        [("embeddings", "vec_id = s_suppkey % 500")],
        None,
        {
            "requestId": "s_suppkey",
            "query": REQUEST,
            "userId": "s_suppkey % 60",
            "vector": "embedding",
        },
    ),
    "chunk": Fixture(
        "documents",
        [("embeddings", "vec_id = doc_id % 500")],
        None,
        {
            "n": "doc_id",
            "chunkId": "concat('c-', CAST(doc_id AS STRING))",
            "venueId": "concat('v-', CAST(doc_id % 150 AS STRING))",
            "text": (
                "concat(CASE doc_id % 6 WHEN 0 THEN 'Serves food in Camden. ' "
                "WHEN 1 THEN 'Live music and quiz nights. ' WHEN 2 THEN 'Quiet beer garden. ' "
                "WHEN 3 THEN 'Dog friendly, happy hour. ' WHEN 4 THEN 'Sunday roast with vegan options. ' "
                "ELSE '' END, text)"
            ),
            "source": "source",
            "sourceUrl": (
                "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE "
                "concat('https://pages.example/', CAST(doc_id % 40 AS STRING)) END"
            ),
            "attribute": (
                "CASE doc_id % 6 WHEN 0 THEN 'servesFood' WHEN 1 THEN 'hasLiveMusic' "
                "WHEN 2 THEN 'hasOutdoorSeating' WHEN 3 THEN 'dogFriendly' "
                "WHEN 4 THEN 'servesSundayRoast' ELSE 'officialWebsiteText' END"
            ),
            "vector": "embedding",
        },
    ),
    "run": Fixture(
        "benchmark",
        [("documents", "doc_id % 40 = item_id % 40")],
        None,
        {
            "caseId": "item_id",
            "docId": "doc_id",
            "score": "CAST((item_id * 31 + doc_id * 17) % 1009 AS DOUBLE) / 1.009E3",
            "grade": "CAST((item_id * 7 + doc_id) % 4 AS INT)",
            "topK": "CAST(3 + item_id % 5 AS INT)",
        },
    ),
    "tagged": Fixture(
        "customer",
        CUSTOMER_PART,
        None,
        {
            "n": "c_custkey",
            "id": "concat('node/', CAST(c_custkey AS STRING))",
            "name": f"concat(p_name, ' ', {KIND})",
            "address": (
                "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE "
                "concat(CAST(c_custkey % 90 AS STRING), ' Quay, Soho, London') END"
            ),
            "t_food": "CASE c_custkey % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'Limited; no' WHEN 3 THEN 'maybe' WHEN 4 THEN ' ' ELSE NULL END",
            "t_cuisine": "CASE c_custkey % 4 WHEN 0 THEN 'Burgers; thai' WHEN 1 THEN 'british,fish & chips' WHEN 2 THEN '' ELSE NULL END",
            "t_outdoor": "CASE c_custkey % 7 WHEN 0 THEN 'garden' WHEN 1 THEN 'no' WHEN 2 THEN 'yes' WHEN 3 THEN 'no;no' WHEN 4 THEN 'true' ELSE NULL END",
            "t_dog": "CASE c_custkey % 5 WHEN 0 THEN 'leashed' WHEN 1 THEN 'no' WHEN 2 THEN 'outside' ELSE NULL END",
            "t_wheelchair": "CASE c_custkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'limited' ELSE 'no' END",
            "t_reservation": "CASE c_custkey % 8 WHEN 0 THEN 'recommended' WHEN 1 THEN 'required' WHEN 2 THEN 'no' ELSE NULL END",
            "t_live": "CASE c_custkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'sometimes' ELSE NULL END",
            "t_live2": "CASE c_custkey % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'Yes' ELSE NULL END",
            "t_sport": "CASE c_custkey % 4 WHEN 0 THEN ' Designated ' WHEN 1 THEN 'false' ELSE NULL END",
            "t_wifi": "CASE c_custkey % 6 WHEN 0 THEN 'wlan' WHEN 1 THEN 'none' WHEN 2 THEN 'customers' ELSE NULL END",
            "t_vegan": "CASE c_custkey % 9 WHEN 0 THEN 'yes' WHEN 1 THEN 'only' WHEN 2 THEN 'no' ELSE NULL END",
            "t_hours": (
                "CASE c_custkey % 9 WHEN 0 THEN 'Mo-Su 11:00-23:00' WHEN 1 THEN '24/7' "
                "WHEN 2 THEN 'Mo-Th 12:00-23:00; Fr,Sa 12:00-24:00; Su 12:00-22:30' "
                "WHEN 3 THEN 'Mo-Fr 09:00-17:00' WHEN 4 THEN 'Sa-Mo 18:00-02:00' "
                "WHEN 5 THEN 'Mo-Su 25:00-26:00' WHEN 6 THEN 'call us' "
                "WHEN 7 THEN 'Mo-Su 11:00-15:00, 17:00-01:30' ELSE NULL END"
            ),
            "t_number": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 120 AS STRING) END",
            "t_street": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'Mill Lane' END",
            "t_full": "CASE WHEN c_custkey % 10 = 0 THEN '1 Full Address, London' ELSE NULL END",
            "t_city": "CASE WHEN c_custkey % 2 = 0 THEN 'London' ELSE NULL END",
            "t_suburb": "CASE c_custkey % 6 WHEN 0 THEN 'Soho' WHEN 1 THEN 'Camden Town' ELSE NULL END",
            "t_postcode": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('W', CAST(1 + c_custkey % 9 AS STRING), ' 1AA') END",
            "t_website": "CASE c_custkey % 4 WHEN 0 THEN concat('pub', CAST(c_custkey AS STRING), '.example') WHEN 1 THEN 'HTTP://loud.example/x' ELSE NULL END",
            "t_website2": "CASE WHEN c_custkey % 3 = 0 THEN 'https://contact.example' ELSE NULL END",
            "t_phone": "CASE WHEN c_custkey % 2 = 0 THEN ' 020 1234 ' ELSE NULL END",
            "t_operator": "CASE c_custkey % 3 WHEN 0 THEN 'Big Chain' ELSE NULL END",
            "t_brand": "CASE c_custkey % 2 WHEN 0 THEN 'Brand X' ELSE NULL END",
            "t_commons": "CASE c_custkey % 6 WHEN 0 THEN 'File:The_Old_Pub.jpg' WHEN 1 THEN 'Plain name.png' WHEN 2 THEN ' ' ELSE NULL END",
            "t_image": "CASE c_custkey % 5 WHEN 0 THEN 'https://img.example/a.jpg' WHEN 1 THEN 'ftp://img' ELSE NULL END",
            "t_wikidata": "CASE c_custkey % 4 WHEN 0 THEN concat('Q', CAST(c_custkey AS STRING)) WHEN 1 THEN 'https://www.wikidata.org/entity/Q77' ELSE 'none' END",
        },
    ),
    "listing": Fixture(
        "customer",
        CUSTOMER_PART,
        "c_custkey % 3 <> 1",
        {
            "n": "c_custkey",
            "listingId": "concat('l-', CAST(c_custkey AS STRING))",
            "sourceName": (
                f"concat(CASE WHEN c_custkey % 2 = 0 THEN 'The ' ELSE '' END, p_name, "
                f"CASE WHEN c_custkey % 9 = 0 THEN ' &amp; Co' ELSE '' END, ' ', {KIND})"
            ),
            "sourceAddress": (
                "concat(CAST(1 + c_custkey % 250 AS STRING), ' ', "
                "CASE c_custkey % 4 WHEN 0 THEN 'High St' WHEN 1 THEN 'Mill Lane' "
                "WHEN 2 THEN 'Albion Rd' ELSE 'Kings Sq' END, ', London', "
                "CASE WHEN c_custkey % 4 = 1 THEN '' ELSE concat(' NW', "
                "CAST(1 + c_custkey % 9 AS STRING), ' ', CAST(c_custkey % 10 AS STRING), 'AB') END)"
            ),
            "latitude": "51.28E0 + CAST((c_custkey * 7919) % 4200 AS DOUBLE) / 1.0E4 + CAST(c_custkey % 3 AS DOUBLE) / 1.0E4",
            "longitude": "-0.51E0 + CAST((c_custkey * 104729) % 8400 AS DOUBLE) / 1.0E4",
            "website": (
                "CASE WHEN c_custkey % 5 = 0 THEN concat('http://venue', CAST(c_custkey AS STRING), "
                "'.example/pub/book-now') WHEN c_custkey % 5 = 1 THEN concat('https://venue', "
                "CAST(c_custkey AS STRING), '.example') ELSE NULL END"
            ),
            "pintName": "CASE c_custkey % 4 WHEN 0 THEN 'Guinness' WHEN 1 THEN 'Guiness' WHEN 2 THEN 'GUINNESS' ELSE 'Carling' END",
            "pintPrice": "4.0E0 + CAST(c_custkey % 40 AS DOUBLE) / 1.0E1",
        },
    ),
}


class Tables:
    """The given tables of one folder and the frames derived from them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = tune(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def fx(self, name: str) -> DataFrame:
        fixture = FIXTURES[name]
        frame = self.table(fixture.source)
        for table, on in fixture.joins:
            frame = frame.join(self.table(table), F.expr(on))
        if fixture.where:
            frame = frame.where(fixture.where)
        return frame.selectExpr(*[f"{expr} AS {alias}" for alias, expr in fixture.columns.items()])

    # Frames in the shape the operators expect.

    def venues(self) -> DataFrame:
        """Canonical venues with tags and provenance."""
        from taproom.operators.canonical import entries_to_map, provenance_entry

        at = F.lit("2026-08-01").cast("date")
        source = F.when(F.col("n") % 2 == 0, V.OFFICIAL_SOURCE).otherwise("FSQ Places")
        record = F.when(F.col("n") % 4 == 0, F.concat(F.lit("https://site.example/"), "venueId"))
        entries = [
            provenance_entry(
                field, F.col(field).isNotNull(), source, F.coalesce(record, F.col("venueId")), at,
                F.lit(0.9),
            )
            for field in ("name", "website", *V.FACTS, "rating")
        ]
        return (
            self.fx("venue")
            .withColumn("tags", F.split("tagsText", r"\|"))
            .withColumn("attributeProvenance", entries_to_map(entries))
        )

    def places_a(self) -> DataFrame:
        return self.fx("venue").select(
            F.col("venueId").alias("fsqPlaceId"), "name", "latitude", "longitude", "address",
            "postcode", "website", "phone", "priceTier",
            F.split("tagsText", r"\|").alias("categories"), "area", "n",
        )

    def places_b(self) -> DataFrame:
        return self.fx("place_b").withColumn("categories", F.split("categoriesText", r"\|"))

    def requests(self) -> DataFrame:
        return self.fx("request").withColumn("vector", F.col("vector").cast("array<double>"))

    def chunks(self) -> DataFrame:
        return (
            self.fx("chunk")
            .withColumn("vector", F.col("vector").cast("array<double>"))
            .withColumn("attributes", F.array("attribute"))
        )

    def tagged(self) -> DataFrame:
        """Map-source rows with their tags as a map without empty entries."""
        keys = TAG_KEYS
        tags = F.map_from_entries(
            F.array_compact(
                F.array(
                    *[
                        F.when(
                            F.col(column).isNotNull(),
                            F.struct(F.lit(key).alias("key"), F.col(column).alias("value")),
                        )
                        for column, key in keys.items()
                    ]
                )
            )
        )
        return self.fx("tagged").withColumn("tags", tags)

    def listings(self) -> DataFrame:
        from taproom.functions.text import full_postcode

        return (
            self.fx("listing")
            .withColumn("sourcePostcode", full_postcode(F.col("sourceAddress")))
            .withColumn(
                "pints",
                F.array(
                    F.struct(F.col("pintName").alias("name"), F.col("pintPrice").alias("price")),
                    F.struct(
                        F.lit("Carling").alias("name"), (F.col("pintPrice") - 1).alias("price")
                    ),
                ),
            )
        )


TAG_KEYS = {
    "name": "name", "t_food": "food", "t_cuisine": "cuisine", "t_outdoor": "outdoor_seating",
    "t_dog": "dog", "t_wheelchair": "wheelchair", "t_reservation": "reservation",
    "t_live": "live_music", "t_live2": "music:live", "t_sport": "live_sport",
    "t_wifi": "internet_access", "t_vegan": "diet:vegan", "t_hours": "opening_hours",
    "t_number": "addr:housenumber", "t_street": "addr:street", "t_full": "addr:full",
    "t_city": "addr:city", "t_suburb": "addr:suburb", "t_postcode": "addr:postcode",
    "t_website": "website", "t_website2": "contact:website", "t_phone": "phone",
    "t_operator": "operator", "t_brand": "brand", "t_commons": "wikimedia_commons",
    "t_image": "image", "t_wikidata": "wikidata",
}


@dataclass
class Entry:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def sql(uses: str, body: str, **ctes: str) -> str:
    """SQL text over the derived tables named in `uses`, further named parts, and a body."""
    parts = [f"fx_{name} AS ({FIXTURES[name].sql()})" for name in uses.split()]
    parts += [f"{name} AS ({text})" for name, text in ctes.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def query(name: str, text: str | None = None):
    """Register a query under its operator id, with its SQL twin when there is one."""

    def keep(build: Callable[[Tables], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"query registered twice: {name}")
        ENTRIES[name] = Entry(name, build, text)
        return build

    return keep


def joined(column: str, mark: str = "|"):
    """A list column as one text."""
    return F.array_join(F.col(column), mark).alias(column)
