"""Removal of drifting records.

A segment is read from its first stay with a moving pointer. At each pointer position the next two stays
decide between going on by one and by two positions, and the decision depends only on those three stays,
not on what happened before. So the pointer visits a stay exactly when the number of two-position moves
directly before it is even, and the whole pass becomes running sums over a window: no sequential code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import defaults as D
from ..functions.clock import seconds_between
from ..functions.geo import dist_km_4, speed_ms
from .dimensions import NEIGHBOURS, with_neighbours
from .ordered import Whole, per_key
from .stays import STAY_COLUMNS, STAY_ORDER, USER, flag, segments, slice_of

STEP_BY_TWO = ("tail", "bounce", "cut", "skip")


def remove_drift(df: DataFrame, adjacency: DataFrame | None = None, *, hot_rows: int | None = D.HOT_ROWS, **options) -> DataFrame:
    """Stays without the drifting ones; options as in ``without_drift``."""
    df = df if adjacency is None else with_neighbours(df, adjacency)
    return per_key(df, USER, STAY_ORDER, lambda d, o: without_drift(d, o, **options), hot_rows)


def without_drift(
    df: DataFrame,
    o: Whole,
    *,
    gap_s: int = D.DRIFT_GAP_S,
    far_km: float = D.DRIFT_FAR_KM,
    max_speed: float = D.DRIFT_SPEED_MS,
    point_ratio: float = D.DRIFT_POINT_RATIO,
    cluster_ratio: float = D.DRIFT_CLUSTER_RATIO,
    max_share: float = D.DRIFT_SHARE,
    cluster_s: int = D.DRIFT_CLUSTER_S,
    min_cells: int = D.DRIFT_CELLS,
    isolated_rule: bool = False,
    true_share: bool = False,
) -> DataFrame:
    """Drop drifting stays from segments of stays less than gap_s apart.

    A stay next to one whose cell lists its cell in `nbrs` (a column the stays may have) is not far. isolated_rule switches on the isolated-point rule, which never fires by default; true_share compares
    the real share of a cluster in its segment, which counts as 0 by default.
    """
    x = o.running(segments(df, o, gap_s), STAY_ORDER, sums={"_pos": F.lit(1)})
    order = STAY_ORDER
    if true_share:
        order = ["_pos"]
        x = o.totals(x, ["seg_id"], sums={"_size": F.lit(1)})
    listed = NEIGHBOURS in df.columns
    here = F.struct("cid", "lon", "lat", "start_ts", "end_ts", "seg_id", *[NEIGHBOURS] * listed)
    x = o.neighbours(x, order, prev={"_p": "seg_id"}, next={"_n": here})
    x = o.neighbours(x, order, prev={"_pp": "_p"}, next={"_nn": "_n"})

    def inside(seg: str):
        return F.coalesce(F.col(seg) == F.col("seg_id"), F.lit(False))

    x = x.withColumns({"_has_p": inside("_p"), "_has_pp": inside("_pp"),
                       "_has_n": inside("_n.seg_id"), "_has_nn": inside("_nn.seg_id")})
    x = x.withColumn("_long", F.col("_has_nn") | F.col("_has_pp") | (F.col("_has_p") & F.col("_has_n")))
    x = x.withColumns({
        "_d01": dist_km_4("_n.lon", "_n.lat", "lon", "lat"),
        "_d12": dist_km_4("_n.lon", "_n.lat", "_nn.lon", "_nn.lat"),
        "_d02": dist_km_4("_nn.lon", "_nn.lat", "lon", "lat"),
    })
    x = x.withColumn("_adjacent", F.coalesce(F.array_contains(f"_n.{NEIGHBOURS}", F.col("cid")), F.lit(False)) if listed else F.lit(False))
    x = x.withColumn("_move", _move(far_km, max_speed, point_ratio, cluster_ratio, isolated_rule))
    size = ["_size"] if true_share else []
    x = x.select("_pos", "_has_p", "_long", "_move", "seg_id", *size, *STAY_COLUMNS, *slice_of(x, o))

    x = o.neighbours(x, order, prev={"_before": "_move"})
    fresh = ~F.col("_has_p") | (F.col("_before") == "go")
    x = o.running(x, order, maxes={"_anchor": F.when(fresh, F.col("_pos"))})
    x = x.withColumn("_visited", (F.col("_pos") - F.col("_anchor")) % 2 == 0)
    closes = flag(F.col("_visited") & F.col("_move").isin("cut", "skip"))
    x = o.running(x.withColumn("_closes", closes), order, sums={"_cluster": F.col("_closes")})
    x = x.withColumn("_cluster", F.col("_cluster") - F.col("_closes"))
    x = x.filter(F.col("_visited") | (F.col("_before") == "cut"))

    cluster = ["seg_id", "_cluster"]
    x = o.within(*cluster, "cid").neighbours(x, order, prev={"_seen": F.lit(1)})
    x = o.totals(
        x, cluster,
        mins={"_from": F.struct("_pos", "start_ts")}, maxes={"_to": F.struct("_pos", "end_ts")},
        sums={"_cells": flag(F.col("_seen").isNull())},
    )
    short = (seconds_between("_from.start_ts", "_to.end_ts") < cluster_s) & (F.col("_cells") < min_cells)
    if true_share:
        short = short & ((F.col("_to._pos") - F.col("_from._pos")) / F.col("_size") < max_share)
    elif not 0 < max_share:
        short = F.lit(False)
    return x.filter(~(F.col("_long") & short)).select(*STAY_COLUMNS, *slice_of(x, o))


def _move(far_km, max_speed, point_ratio, cluster_ratio, isolated_rule):
    d01, d12, d02 = F.col("_d01"), F.col("_d12"), F.col("_d02")
    v01 = speed_ms(d01, seconds_between("end_ts", "_n.start_ts"))
    v12 = speed_ms(d12, seconds_between("_n.end_ts", "_nn.start_ts"))
    suspicious = F.col("_long") & F.col("_has_n") & ~F.col("_adjacent") & (d01 > far_km)
    move = (
        F.when(~suspicious, "go")
        .when(~F.col("_has_nn"), F.when(v01 < max_speed, "go").otherwise("tail"))
        .when(d02 == 0, "bounce")
    )
    ratio = d01 / F.nullif(d02, F.lit(0.0)) if isolated_rule else F.lit(1.0)
    if isolated_rule or point_ratio < 1:
        move = move.when((ratio > point_ratio) & (v01 * v12 > max_speed * max_speed), "bounce")
    apart = F.coalesce(d02 / F.nullif(d12, F.lit(0.0)) > cluster_ratio, F.lit(True))
    return move.when(apart & (d12 < far_km), "cut").otherwise("skip")

