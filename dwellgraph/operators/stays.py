"""Stays from located records: runs, segments, merged stays, residence points.

Located record: user, ts, cid, lon, lat. Stay: user, cid, lon, lat, start_ts, end_ts, stay_s.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..defaults import HOT_ROWS, MERGE_GAP_S, RESIDENCE_KM, RESIDENCE_MIN_S, STAY_GAP_S
from ..functions.clock import seconds_between
from ..functions.geo import dist_km_raw
from .dimensions import NEIGHBOURS
from .ordered import ROW, SLICE, Whole, per_key

USER = ["user"]
RECORD_ORDER = ["ts", "cid", "lon", "lat"]
STAY_ORDER = ["start_ts", "end_ts", "cid", "lon", "lat"]
STAY_COLUMNS = ["user", "cid", "lon", "lat", "start_ts", "end_ts", "stay_s"]


def flag(condition: Column) -> Column:
    return condition.cast("long")


def order_trace(df: DataFrame, order: list[str] = RECORD_ORDER) -> DataFrame:
    """Rows of a user together and in time order inside each output partition."""
    return df.repartition(*USER).sortWithinPartitions(*USER, *order)


def sort_by_time(df: DataFrame, time: str = "ts") -> DataFrame:
    return df.orderBy(time)


def min_rows(df: DataFrame, n: int, key: str = "user", order: list[str] = RECORD_ORDER,
             hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Keep the keys that have more than n rows."""
    return per_key(df, [key], order, lambda d, o: more_than(d, o, n), hot_rows)


def more_than(df: DataFrame, o: Whole, n: int) -> DataFrame:
    return o.totals(df, [], sums={"_rows": F.lit(1)}).filter(F.col("_rows") > n).drop("_rows")


def stay_runs(df: DataFrame, max_gap_s: int = STAY_GAP_S, keep_last: bool = False,
              hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Consecutive records in one cell less than max_gap_s apart become a stay.

    The last stay of every user is left out unless keep_last is set.
    """
    return per_key(df, USER, RECORD_ORDER, lambda d, o: runs(d, o, max_gap_s, keep_last), hot_rows)


def runs(df: DataFrame, o: Whole, max_gap_s: int = STAY_GAP_S, keep_last: bool = False) -> DataFrame:
    x = o.neighbours(df, RECORD_ORDER, prev={"_cid": "cid", "_ts": "ts"})
    starts = F.col("_ts").isNull() | (F.col("cid") != F.col("_cid")) | (seconds_between("_ts", "ts") >= max_gap_s)
    x = o.running(x, RECORD_ORDER, sums={"_run": flag(starts)})
    own = [NEIGHBOURS] * (NEIGHBOURS in df.columns)  # the neighbours of the cell go along
    x = x.groupBy(*o.keys, "_run", "cid").agg(
        F.min(F.struct("ts", "lon", "lat")).alias("_from"), F.max("ts").alias("end_ts"), *[F.first(c).alias(c) for c in own], *o.slice_columns()
    )
    if not keep_last:
        x = o.neighbours(x, ["_run"], next={"_later": "_run"}).filter(F.col("_later").isNotNull())
    x = x.withColumns({"start_ts": F.col("_from.ts"), "lon": F.col("_from.lon"), "lat": F.col("_from.lat")})
    return _stays(x, o, *own)


def _stays(x: DataFrame, o: Whole, *more: str) -> DataFrame:
    x = x.withColumn("stay_s", seconds_between("start_ts", "end_ts"))
    return x.select(*STAY_COLUMNS, *more, *slice_of(x, o))


def slice_of(x: DataFrame, o: Whole) -> list[str]:
    """Columns that later steps on slices need."""
    return [c for c in (SLICE, ROW) if o.sliced and c in x.columns]


def segment(df: DataFrame, gap_s: int, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Number (from 1) the stretches of a user's stays without a pause of gap_s or more: seg_id."""
    return per_key(df, USER, STAY_ORDER, lambda d, o: segments(d, o, gap_s), hot_rows)


def segments(df: DataFrame, o: Whole, gap_s: int, name: str = "seg_id") -> DataFrame:
    x = o.neighbours(df, STAY_ORDER, prev={"_end": "end_ts"})
    cut_here = F.col("_end").isNull() | (seconds_between("_end", "start_ts") >= gap_s)
    return o.running(x, STAY_ORDER, sums={name: flag(cut_here)}).drop("_end")


def merge_stays(df: DataFrame, max_gap_s: int = MERGE_GAP_S, exact_count: bool = False, compat: bool = True,
                hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Merge consecutive stays in one cell unless more than max_gap_s apart; adds n_records.

    By default the count of a user's last merged stay is one short when it has two rows or more, and
    a user with a single stay yields nothing; exact_count and compat=False give the plain results.
    """
    return per_key(df, USER, STAY_ORDER, lambda d, o: merged(d, o, max_gap_s, exact_count, compat), hot_rows)


def merged(df: DataFrame, o: Whole, max_gap_s: int = MERGE_GAP_S, exact_count: bool = False, compat: bool = True) -> DataFrame:
    x = o.neighbours(df, STAY_ORDER, prev={"_cid": "cid", "_end": "end_ts"})
    starts = F.col("_end").isNull() | (F.col("cid") != F.col("_cid")) | (seconds_between("_end", "start_ts") > max_gap_s)
    x = o.running(x, STAY_ORDER, sums={"_run": flag(starts)})
    position = F.struct("start_ts", "end_ts", "lon", "lat", "stay_s")
    x = x.groupBy(*o.keys, "_run", "cid").agg(
        F.min(position).alias("_from"), F.max(position).alias("_to"),
        F.count(F.lit(1)).alias("_n"), *o.slice_columns(),
    )
    x = o.neighbours(x, ["_run"], next={"_later": "_run"})
    last = F.col("_later").isNull()
    if compat:
        x = x.filter(~(last & (F.col("_run") == 1) & (F.col("_n") == 1)))
    n = F.col("_n") if exact_count else F.col("_n") - flag(last & (F.col("_n") >= 2))
    x = x.withColumns({"start_ts": F.col("_from.start_ts"), "end_ts": F.col("_to.end_ts"),
                       "lon": F.col("_from.lon"), "lat": F.col("_from.lat"), "n_records": n})
    own = F.when(last & (F.col("_n") == 1), F.col("_from.stay_s"))
    x = x.withColumn("stay_s", F.coalesce(own, seconds_between("start_ts", "end_ts")))
    return x.select(*STAY_COLUMNS, "n_records", *slice_of(x, o))


def residence_points(df: DataFrame, max_km: float = RESIDENCE_KM, min_stay_s: int = RESIDENCE_MIN_S,
                     compat: bool = True, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Label runs of stays less than max_km apart that last longer than min_stay_s 1, 2, ...; others -1."""
    return per_key(df, USER, STAY_ORDER, lambda d, o: residences(d, o, max_km, min_stay_s, compat), hot_rows)


def residences(df: DataFrame, o: Whole, max_km: float = RESIDENCE_KM, min_stay_s: int = RESIDENCE_MIN_S,
               compat: bool = True) -> DataFrame:
    x = o.neighbours(df, STAY_ORDER, prev={"_lon": "lon", "_lat": "lat"}, next={"_later": F.lit(1)})
    if compat:
        x = x.filter(F.col("_lon").isNotNull() | F.col("_later").isNotNull())
    near = F.coalesce(dist_km_raw("lon", "lat", "_lon", "_lat") < max_km, F.lit(False))
    x = x.withColumn("_first", ~near)
    x = o.running(x, STAY_ORDER, sums={"_run": flag(F.col("_first")), "_pos": F.lit(1)})
    x = o.totals(
        x, ["_run"],
        mins={"_from": F.struct("start_ts", "end_ts")}, maxes={"_to": F.struct("start_ts", "end_ts")},
    )
    x = x.withColumn("_long", seconds_between("_from.start_ts", "_to.end_ts") > min_stay_s)
    x = o.running(x, ["_pos"], sums={"_label": flag(F.col("_first") & F.col("_long"))})
    label = F.when(F.col("_long"), F.col("_label")).otherwise(F.lit(-1)).cast("int")
    return x.withColumn("residence_id", label).select(*STAY_COLUMNS, "residence_id", *slice_of(x, o))
