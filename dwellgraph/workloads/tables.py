"""Inputs for the operators, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.cleaning import CleaningConfig

# The events are sparse (about one in seven hours for a user), so gaps and speeds are scaled by 24.
STAY_GAP = 44_400
DRIFT = dict(gap_s=28_800, max_speed=2.5, cluster_s=240)
PINGPONG_GAP = 21_600
MERGE_GAP = 259_200
REGION_GAP = 86_400
MIN_RECORDS = 55
CLEANING = CleaningConfig(
    min_records=MIN_RECORDS, stay_gap_s=STAY_GAP, min_runs=1, drift_gap_s=DRIFT["gap_s"], max_speed=DRIFT["max_speed"],
    cluster_s=DRIFT["cluster_s"], min_stays=30, pingpong_gap_s=PINGPONG_GAP, merge_gap_s=MERGE_GAP, min_merged=1,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def call_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as call records: user, ts, raw cell id (24 of them, two for each place)."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("user"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"),
        (k % 24).cast("string").alias("cid"),
    )


def cell_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation keys as raw cell ids, each with the id of its place."""
    k = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(k.cast("string").alias("cid"), (k % 12).cast("string").alias("canon_cid"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as places: 0-7 on a grid of about 1.6 km, the others some 50 km east of it."""
    c = F.col("n_nationkey").cast("long")
    far = F.when(c >= 8, F.lit(0.5)).otherwise(F.lit(0.0))
    return table(spark, sf_dir, "nation").select(
        c.cast("string").alias("cid"), F.col("n_name").alias("name"),
        (F.lit(110.3) + F.lit(0.015) * (c % 4) + far).alias("lon"),
        (F.lit(20.0) + F.lit(0.015) * (F.floor(c / 4) % 2)).alias("lat"),
    )


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some far places listed as neighbours, in one direction only: 8 after 0, 9 after 1, ..."""
    c = F.col("cid").cast("long")
    return cells(spark, sf_dir).filter(c >= 8).select("cid", (c - 8).cast("string").alias("nbr_cid"))


def listed_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with an error event of a high value."""
    return table(spark, sf_dir, "events").filter("event_type = 'error' AND value > 100").select(
        F.col("user_id").cast("string").alias("user")
    ).distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers in one id space: an edge from part to supplier for every line item, weighted by quantity."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("weight"),
        F.struct("l_orderkey", "l_linenumber").alias("seq"),
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A position for every supplier."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.cast("string").alias("cid"), (F.lit(110.0) + F.lit(0.0037) * (k % 97)).alias("lon"),
        (F.lit(20.0) + F.lit(0.0023) * (k % 89)).alias("lat"),
    )


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A position for every customer."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.cast("string").alias("uid"), (F.lit(110.0) + F.lit(0.0011) * (k % 331)).alias("lon"),
        (F.lit(20.0) + F.lit(0.0013) * (k % 157)).alias("lat"),
    )


def nearby_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A geocoder response for every order: its line items are the POIs, returned ones the POI regions."""
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    poi = F.struct(
        F.col("l_suppkey").cast("string").alias("uid"), F.col("l_linestatus").alias("tag"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("name"),
        F.col("l_returnflag").alias("direction"), F.col("l_quantity").cast("long").cast("string").alias("distance"),
    )
    entry = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", poi.alias("poi"))

    def listed(returned: bool):
        own = (F.col("l_returnflag") == "R") == F.lit(returned)
        return F.transform(F.array_sort(F.collect_list(F.when(own, entry))), lambda e: e["poi"])

    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        listed(False).alias("pois"), listed(True).alias("poiRegions")
    )
    joined = order.join(lists, order["o_orderkey"] == lists["l_orderkey"], "left")
    empty = F.from_json(F.lit("[]"), lists.schema["pois"].dataType)
    address = F.struct(F.col("o_orderpriority").alias("city"), F.col("o_orderstatus").alias("district"))
    result = F.struct(address.alias("addressComponent"), F.coalesce("pois", empty).alias("pois"),
                      F.coalesce("poiRegions", empty).alias("poiRegions"))
    return joined.select(
        F.col("o_orderkey").cast("string").alias("location_key"), F.to_json(F.struct(result.alias("result"))).alias("value")
    )


def detail_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detail response for every part; optional fields are missing for some, the tag for parts of size 13."""
    info = F.struct(
        F.when(F.col("p_size") != 13, F.col("p_type")).alias("tag"),
        F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).alias("overall_rating"),
        F.when(F.col("p_partkey") % 3 == 0, F.lit("09:00-17:00")).alias("shop_hours"),
        F.col("p_retailprice").cast("long").cast("string").alias("price"),
        F.when(F.col("p_partkey") % 5 == 0, F.lit("AAA")).alias("level"),
    )
    k = F.col("p_partkey")
    place = F.struct((F.lit(110.0) + F.lit(0.001) * (k % 1000)).alias("lng"), (F.lit(20.0) + F.lit(0.001) * (k % 777)).alias("lat"))
    result = F.struct(
        F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("city"),
        place.alias("location"), info.alias("detail_info"),
    )
    return table(spark, sf_dir, "part").select(k.cast("string").alias("uid"), F.to_json(F.struct(result.alias("result"))).alias("value"))


# Weights run from 1 to 50.
THRESHOLDS = (13.0, 25.0, 38.0)
