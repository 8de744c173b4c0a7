"""Points of interest: stored geocoder and detail responses, request signing, radius search."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..defaults import HOT_ROWS, POI_RADIUS_M
from ..functions.geo import RADIUS_ROUNDED_KM, dist_km_4
from ..functions.text import KEPT, form_encode, percent_encode, six_decimals
from .spread import spread_join

# Fields of the two response documents.
POI = "uid STRING, tag STRING, name STRING, direction STRING, distance STRING"
NEARBY_SCHEMA = (
    "result STRUCT<addressComponent: STRUCT<city: STRING, district: STRING>, "
    f"pois: ARRAY<STRUCT<{POI}>>, poiRegions: ARRAY<STRUCT<{POI}>>>"
)
DETAIL_SCHEMA = (
    "result STRUCT<name: STRING, city: STRING, area: STRING, telephone: STRING, "
    "location: STRUCT<lng: DOUBLE, lat: DOUBLE>, detail_info: STRUCT<tag: STRING, overall_rating: STRING, "
    "shop_hours: STRING, price: STRING, level: STRING, scope_grade: STRING, content_tag: STRING>>"
)
DETAIL_COLUMNS = [
    "uid", "name", "lng", "lat", "city", "area", "tag", "overall_rating", "shop_hours", "price", "level",
    "scope_grade", "telephone", "content_tag",
]
# The two signed request texts.
NEARBY_REQUEST = "/geocoder/v2/?location=%s&output=json&pois=1&radius=%d&latest_admin=1&ak=%s"
DETAIL_REQUEST = "/place/v2/detail?uid=%s&output=json&scope=2&ak=%s"


def location_key(df: DataFrame) -> DataFrame:
    """Add location_key: 'lat,lon' at six decimals."""
    return df.withColumn("location_key", F.concat_ws(",", six_decimals("lat"), six_decimals("lon")))


def flatten_nearby(responses: DataFrame) -> DataFrame:
    """One row per POI of a response (location_key, value): points first, then regions, first of a uid wins.

    A response is small, so the duplicates are removed inside its row, without a shuffle.
    A response without POIs keeps one row with a NULL uid.
    """
    def listed(name: str, source: str) -> Column:
        empty = F.from_json(F.lit("[]"), f"ARRAY<STRUCT<{POI}>>")
        return F.transform(
            F.coalesce(F.col(f"_r.result.{name}"), empty),
            lambda p: F.struct(p["uid"].alias("uid"), p["tag"].alias("tag"), p["name"].alias("name"),
                               p["direction"].alias("direction"), p["distance"].alias("distance"),
                               F.lit(source).alias("source")),
        )

    parsed = responses.withColumn("_r", F.from_json("value", NEARBY_SCHEMA)).filter("_r.result IS NOT NULL")
    parsed = parsed.withColumn("_all", F.concat(listed("pois", "poi"), listed("poiRegions", "region")))
    parsed = parsed.withColumn("_uids", F.transform("_all", lambda p: p["uid"]))
    first = F.filter("_all", lambda p, i: F.array_position("_uids", p["uid"]) == i + 1)
    return parsed.select(
        "location_key", F.col("_r.result.addressComponent.city").alias("city"),
        F.col("_r.result.addressComponent.district").alias("district"), F.explode_outer(first).alias("_p"),
    ).select("location_key", "city", "district", "_p.*")


def describe_pois(pois: DataFrame) -> DataFrame:
    """uid and the comma-joined text of its tag, name, direction and distance."""
    return pois.filter("uid IS NOT NULL").select(
        "location_key", "uid", F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("tag", "name", "direction", "distance")]).alias("description")
    )


def distinct_uids(pois: DataFrame) -> DataFrame:
    return pois.filter("uid IS NOT NULL").select("uid").distinct()


def flatten_details(responses: DataFrame) -> DataFrame:
    """Place details (uid, value): name, position and tag are required, other fields default to ''."""
    r = responses.withColumn("_r", F.from_json("value", DETAIL_SCHEMA)).select("uid", "_r.result.*")
    r = r.select(
        "uid", "name", "location.lng", "location.lat", "city", "area", "telephone", "detail_info.*"
    ).dropna(subset=["uid", "name", "lng", "lat", "tag"])
    return r.select([F.coalesce(F.col(c), F.lit("")).alias(c) if c not in ("lng", "lat") else F.col(c)
                     for c in DETAIL_COLUMNS])


def detail_lines(details: DataFrame) -> DataFrame:
    """Tab-separated text rows, positions at six decimals."""
    cols = [six_decimals(c) if c in ("lng", "lat") else F.col(c) for c in DETAIL_COLUMNS]
    return details.select(F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in cols]).alias("value"))


def signed_requests(df: DataFrame, request: Column, secret: str, host: str = "") -> DataFrame:
    """Add sn, the md5 signature of a request text, and url. Nothing is sent.

    The request is percent-encoded but for reserved characters, the secret is appended, and the whole is
    form-encoded before hashing.
    """
    signed = F.md5(form_encode(F.concat(percent_encode(request, KEPT), F.lit(secret))))
    df = df.withColumn("sn", signed)
    return df.withColumn("url", percent_encode(F.concat(F.lit(host), request, F.lit("&sn="), F.col("sn")), KEPT))


def nearby_request(key: str, radius_m: int = POI_RADIUS_M) -> Column:
    """Request text for the surroundings of location_key."""
    before, after = NEARBY_REQUEST.split("%s", 1)
    return F.concat(F.lit(before), F.col("location_key"), F.lit(after % (radius_m, key)))


def detail_request(key: str) -> Column:
    """Request text for the details of uid."""
    before, after = DETAIL_REQUEST.split("%s", 1)
    return F.concat(F.lit(before), F.col("uid"), F.lit(after % key))


def pois_within(cells: DataFrame, pois: DataFrame, radius_m: float = POI_RADIUS_M,
                hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Pairs (cid, uid, distance_m) of a cell and a POI at most radius_m apart.

    POIs are hashed to a grid with steps of one radius; a cell looks into the few squares its circle
    touches. The width of a square in degrees of longitude grows with latitude, row by row.
    """
    step = math.degrees(radius_m / 1000 / RADIUS_ROUNDED_KM) * 1.001

    def row(lat):
        return F.floor(lat / step)

    def col(lon, r):
        edge = F.least(F.lit(89.9), F.abs(F.abs(r) + 1) * step)
        return F.floor(lon * F.cos(F.radians(edge)) / step)

    placed = pois.select("uid", F.col("lon").alias("_plon"), F.col("lat").alias("_plat"))
    placed = placed.withColumn("_row", row(F.col("_plat"))).withColumn("_col", col(F.col("_plon"), F.col("_row")))

    reach = F.sin(F.radians(F.lit(step))) / F.cos(F.radians("lat"))
    half = F.when(reach < 1, F.degrees(F.asin(F.least(reach, F.lit(1.0)))) * 1.001).otherwise(F.lit(360.0))
    around = (
        cells.select("cid", "lon", "lat").withColumn("_half", half)
        .withColumn("_row", F.explode(F.sequence(row(F.col("lat") - step), row(F.col("lat") + step))))
        # A circle across the date line is looked up on both sides of it.
        .withColumn("_shift", F.explode(F.array(*[F.lit(float(d)) for d in (-360, 0, 360)])))
        .withColumns({"_lo": F.greatest(F.lit(-180.0), F.col("lon") + F.col("_shift") - F.col("_half")),
                      "_hi": F.least(F.lit(180.0), F.col("lon") + F.col("_shift") + F.col("_half"))})
        .filter("_lo <= _hi")
        .withColumn("_col", F.explode(F.sequence(col(F.col("_lo"), F.col("_row")), col(F.col("_hi"), F.col("_row")))))
        .select("cid", "lon", "lat", "_row", "_col").distinct()
    )
    metres = F.round(dist_km_4("lon", "lat", "_plon", "_plat") * 1000, 1)
    return (
        spread_join(placed, around, ["_row", "_col"], hot_rows=hot_rows)
        .withColumn("distance_m", metres).filter(F.col("distance_m") <= radius_m)
        .select("cid", "uid", "distance_m")
    )
