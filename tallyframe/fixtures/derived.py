"""Election-shaped tables derived from the order tables that tests and benchmarks are given.

Order years become elections (every fifth year the same one), regions states, nations divisions, line numbers candidates (7 is informal), order
priorities vote types, customers polling places and quantities votes. Everything is computed from whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.schemas import CAND_COLUMNS, DECLARATION, ORDINARY, PP_COLUMNS, PRE_POLL_CENTRE

PRIORITY_TYPES = {
    "1-URGENT": "Absent", "2-HIGH": "Provisional", "4-NOT SPECIFIED": "PrePollDeclaration", "5-LOW": "Postal",
}
PRE_POLL_SEGMENTS = ("FURNITURE", "HOUSEHOLD")


# The columns read from each given table. With a schema, planning a query opens no file.
SOURCE_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_linenumber int, l_quantity double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(SOURCE_SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")


def divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _read(spark, sf_dir, "nation")
    region = _read(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("nation"),
        F.col("n_regionkey").alias("region"),
        F.col("r_name").alias("state_ab"),
        (100 + F.col("n_nationkey")).cast("string").alias("division_id"),
        F.col("n_name").alias("division_nm"),
    )


def _second_party() -> Column:
    region, election = F.col("region"), F.col("election")
    queensland_like = F.when(election > 2010, "LNP").when(election == 2010, "LNQ").otherwise("LP")
    return F.when(region == 1, "NP").when(region == 3, "CLP").when(region == 2, queensland_like).otherwise("LP")


def _ballot_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: where and how its lines were voted."""
    date, priority = F.col("o_orderdate"), F.col("o_orderpriority")
    orders = _read(spark, sf_dir, "orders")
    customers = _read(spark, sf_dir, "customer").drop("c_acctbal")

    is_ordinary = priority == "3-MEDIUM"
    pseudo_place = F.lit(None).cast("string")
    for code, name in PRIORITY_TYPES.items():
        pseudo_place = F.when(priority == code, name).otherwise(pseudo_place)
    early = F.when(is_ordinary, F.col("c_mktsegment").isin(*PRE_POLL_SEGMENTS)).otherwise(
        priority.isin("4-NOT SPECIFIED", "5-LOW")
    )
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        (2004 + 3 * F.pmod(F.year(date) - 1995, F.lit(5))).cast("int").alias("election"),
        F.col("c_nationkey").alias("nation"),
        is_ordinary.alias("is_ordinary"),
        F.when(is_ordinary, F.col("c_custkey")).alias("place"),
        F.coalesce(pseudo_place, F.col("c_name")).alias("polling_place"),
        early.cast("int").alias("early"),
    )


def cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate table.

    Orders meet their customers first, so the much larger lines are shuffled once, for their order, and then only as
    partial sums. Names are attached to the sums.
    """
    boxes = _ballot_boxes(spark, sf_dir)
    sums = (
        _read(spark, sf_dir, "lineitem")
        .withColumnRenamed("l_linenumber", "slot")
        .join(boxes, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("election", "nation", "slot", "is_ordinary", "place", "polling_place", "early")
        .agg(F.sum("l_quantity").alias("votes"))
    )

    slot, is_informal = F.col("slot"), F.col("slot") == 7
    numbered = F.col("slot").cast("string")
    party = (
        F.when(slot == 1, "ALP").when(slot == 2, _second_party()).when(slot == 3, "GRN").when(slot == 4, F.when(F.col("election") >= 2010, "XEN").otherwise("HAN"))
        .when(slot == 5, "IND").otherwise("")
    )
    is_tcp = slot <= 2
    columns = {
        "polling_place_id": F.col("place").cast("string"),
        "candidate_id": F.when(is_informal, "999").otherwise(((100 + F.col("nation")) * 10 + slot).cast("string")),
        "surname": F.when(is_informal, "Informal").otherwise(F.concat(F.lit("Surname"), numbered)),
        "given_nm": F.when(is_informal, "Informal").otherwise(F.concat(F.lit("Given"), numbered)),
        "ballot_position": F.when(is_informal, 999).otherwise(slot).cast("double"),
        "elected": F.when(slot == 1 + F.col("nation") % 2, "Y").otherwise("N"),
        "historic_elected": F.when(slot == 1, "Y").otherwise("N"),
        "party_ab": party,
        "party_nm": F.when(party == "", "").otherwise(F.concat(party, F.lit(" party"))),
        "swing": (F.col("place") % 61 - 30) / 10,
        "tcp_votes": F.when(is_tcp, F.col("votes")),
        "tcp_swing": F.when(is_tcp, (F.col("place") % 41 - 20) / 10),
        "type": F.when(F.col("is_ordinary"), ORDINARY).otherwise(DECLARATION),
        "informal": is_informal.cast("int"),
    }
    return sums.join(divisions(spark, sf_dir), "nation").withColumns(columns).select(*CAND_COLUMNS)


def pp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polling-place table of 2013 and 2016.

    Account balances decide which places closed or opened; some lack coordinates, some moved by about 1.1 km or
    0.1 km, and some had only the spelling of a coordinate changed. Coordinates are text, as published.
    """
    customers = _read(spark, sf_dir, "customer")
    key, is_2016 = F.col("c_custkey"), F.col("election") == 2016
    places = customers.withColumn("election", F.explode(F.array(F.lit(2013), F.lit(2016)))).where(
        F.when(is_2016, F.col("c_acctbal") <= 9000).otherwise(F.col("c_acctbal") >= 0)
    )
    # Thousandths of a degree, so the text is exact.
    moved = F.when(is_2016 & (key % 7 == 0), 10).when(is_2016 & (key % 7 == 1), 1).otherwise(0)
    south = 10000 + (key % 300) * 100 - moved
    decimals = F.lpad((south % 1000).cast("string"), 3, "0")
    respelled = is_2016 & (key % 7 == 2)
    latitude = F.concat(
        F.lit("-"), F.floor(south / 1000).cast("string"), F.lit("."),
        F.when(respelled, F.substring(decimals, 1, 1)).otherwise(decimals),
    )
    east = 1130 + key % 400
    longitude = F.concat(F.floor(east / 10).cast("string"), F.lit("."), (east % 10).cast("string"))

    has_geocode = key % 11 != 0
    counted = ~((F.col("nation") % 5 == 3) & (key % 13 == 0))
    coalition, alp = (50 + key % 401).cast("double"), (60 + key % 307).cast("double")
    segment = F.col("c_mktsegment")
    columns = {
        "state": F.col("state_ab"),
        "polling_place_id": key.cast("string"),
        "polling_place_type_id": F.when(segment.isin(*PRE_POLL_SEGMENTS), PRE_POLL_CENTRE)
        .when(segment == "BUILDING", "2").otherwise("1"),
        "polling_place_nm": F.col("c_name"),
        "latitude": F.when(has_geocode, latitude),
        "longitude": F.when(has_geocode, longitude),
        "tpp_coalition_votes": F.when(counted, coalition),
        "tpp_coalition_percent": F.when(counted, F.round(100 * coalition / (coalition + alp), 2)),
        "tpp_alp_votes": F.when(counted, alp),
        "tpp_alp_percent": F.when(counted, F.round(100 * alp / (coalition + alp), 2)),
        "tpp_total_votes": F.when(counted, coalition + alp),
        "tpp_swing": F.when(counted, (key % 101 - 50) / 10),
    }
    joined = places.join(divisions(spark, sf_dir), F.col("c_nationkey") == F.col("nation"))
    return joined.withColumns(columns).select(*PP_COLUMNS)
