"""Collapse of ping-pong groups: quick alternation between cells becomes one stay in the best cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..defaults import HOT_ROWS, PINGPONG_GAP_S
from ..functions.clock import seconds_between
from ..functions.geo import dist_km_raw
from .ordered import Whole, per_key
from .stays import STAY_COLUMNS, STAY_ORDER, USER, segments, slice_of

# Distinct cells of one group that are compared within one task.
CELLS_PER_TASK = 512
TIE_DIGITS = 9


def station_scores(df: DataFrame, gap_s: int = PINGPONG_GAP_S, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Score of every cell of the groups in which a cell repeats.

    A group has no pause of gap_s or more. score = rows in the cell / mean distance to the rows of the
    other cells; infinite where that mean is 0, NULL where there is no other cell.
    """
    return per_key(df, USER, STAY_ORDER, lambda d, o: scored(d, o, gap_s), hot_rows)


def scored(df: DataFrame, o: Whole, gap_s: int = PINGPONG_GAP_S) -> DataFrame:
    x = _grouped(df, o, gap_s)
    if o.sliced:
        x = _scores(o.settle(x).filter("_repeats"), o).withColumnRenamed("_seen", "seen")
        x = x.withColumn("_slice", F.lit(0))
    else:
        x = o.running(x, STAY_ORDER, sums={"_pos": F.lit(1)}).filter("_repeats")
        x = _stations(_units(x, o), o).select(*o.keys, "_group", "score", "_seen", "cid", "lon", "lat", "freq").withColumnRenamed("_seen", "seen")
    return x.withColumnRenamed("_group", "group_id").drop("seen")


def collapse_pingpong(df: DataFrame, gap_s: int = PINGPONG_GAP_S, compat: bool = True,
                      hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """One stay for each group with a repeated cell; other stays pass. Lone stays of a user only if not compat."""
    return per_key(df, USER, STAY_ORDER, lambda d, o: collapsed(d, o, gap_s, compat), hot_rows)


def _grouped(df: DataFrame, o: Whole, gap_s: int) -> DataFrame:
    x = segments(df, o, gap_s, "_group")
    x = o.totals(x, ["_group", "cid"], sums={"_visits": F.lit(1)})
    x = o.totals(x, ["_group"], maxes={"_most": "_visits"})
    return x.withColumn("_repeats", F.col("_most") > 1).drop("_visits", "_most")


def _scores(x: DataFrame, o: Whole) -> DataFrame:
    """Cells are counted first, so that a group compares its distinct cells and not its rows."""
    group = [*o.keys, "_group"]
    places = x.groupBy(*group, "cid", "lon", "lat").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(*STAY_ORDER)).alias("_first")
    )
    stations = places.groupBy(*group, "cid").agg(
        F.sum("_n").alias("freq"), F.min("_first").alias("_seen")
    ).withColumns({"lon": F.col("_seen.lon"), "lat": F.col("_seen.lat")})
    parts = places.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / CELLS_PER_TASK).alias("_parts"))
    part = F.pmod(F.xxhash64("cid"), F.col("_parts"))
    left = stations.join(parts, group).withColumn("_part", part)
    right = (
        places.join(parts, group)
        .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
        .select(*group, "_part", F.col("cid").alias("_cid"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), "_n")
    )
    km = F.when(F.col("cid") != F.col("_cid"), dist_km_raw("lon", "lat", "_lon", "_lat") * F.col("_n"))
    others = F.when(F.col("cid") != F.col("_cid"), F.col("_n"))
    return (
        left.join(right, [*group, "_part"])
        .groupBy(*group, "cid", "lon", "lat", "freq", "_seen")
        .agg(F.sum(km).alias("_km"), F.sum(others).alias("_others"))
        .withColumn("score", _score())
        .drop("_km", "_others")
    )


def _units(x: DataFrame, o: Whole) -> DataFrame:
    """One row for each group with a repeated cell (_unit 0) and for each other stay (_unit is its position).

    _cells lists the distinct places of the unit with their number of rows, in order of first appearance.
    """
    unit = F.when(F.col("_repeats"), F.lit(0)).otherwise(F.col("_pos"))
    places = x.groupBy(*o.keys, "_group", unit.alias("_unit"), "cid", "lon", "lat").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("_pos", "start_ts", "stay_s")).alias("_from"),
        F.max(F.struct("_pos", "end_ts")).alias("_to"), *o.slice_columns(),
    )
    cell = F.struct(F.col("_from._pos").alias("pos"), "cid", "lon", "lat", "n")
    return places.groupBy(*o.keys, "_group", "_unit").agg(
        F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.array_sort(F.collect_list(cell)).alias("_cells"),
        *o.slice_columns(),
    )


def _stations(units: DataFrame, o: Whole) -> DataFrame:
    """A row for every cell of a unit with its score, from pairs of the unit's distinct places. The pairs are rows that no exchange moves: they are
    made, measured and summed in one compiled stage."""
    unit = [*o.keys, "_group", "_unit", "_from", "_to"]
    place = [F.col(f"_s.{c}").alias(c) for c in ("cid", "lon", "lat")]
    x = units.select(*unit, "_cells", F.explode("_cells").alias("_s")).select(*unit, F.col("_s.pos").alias("_seen"), *place, F.explode("_cells").alias("_c"))
    own = F.col("_c.cid") == F.col("cid")
    km = F.when(~own, dist_km_raw("lon", "lat", "_c.lon", "_c.lat") * F.col("_c.n"))
    x = x.groupBy(*unit, "_seen", "cid", "lon", "lat").agg(
        F.sum(F.when(own, F.col("_c.n"))).alias("freq"), F.sum(km).alias("_km"), F.sum(F.when(~own, F.col("_c.n"))).alias("_others"),
        F.min(F.when(own, F.col("_c.pos"))).alias("_first"),
    )
    # A cell with several positions counts at that of its first stay.
    return x.filter("_seen = _first").withColumn("score", _score()).drop("_first", "_km", "_others")


def _score() -> Column:
    mean = F.col("_km") / F.nullif(F.col("_others"), F.lit(0))
    return F.when(mean == 0, F.lit(float("inf"))).otherwise(F.col("freq") / F.nullif(mean, F.lit(0.0)))


def _rank() -> Column:
    """The highest score first, and before it none. Scores are sums of many distances, whose last digits depend on the order of summing; at TIE_DIGITS they do not,
    and equal ones are told apart by the first stay."""
    return (-F.round("score", TIE_DIGITS)).alias("rank")


def collapsed(df: DataFrame, o: Whole, gap_s: int = PINGPONG_GAP_S, compat: bool = True) -> DataFrame:
    x = _grouped(df, o, gap_s)
    if compat:
        x = o.totals(x, [], sums={"_rows": F.lit(1)}).filter("_rows > 1").drop("_rows")
    x = o.settle(o.running(x, STAY_ORDER, sums={"_pos": F.lit(1)}))
    group = [*o.keys, "_group"]
    rank = _rank()
    if o.sliced:
        # A group may be of any size: its distinct cells are compared by a join.
        best = _scores(x.filter("_repeats"), o).groupBy(*group).agg(F.min(F.struct(rank, "_seen", "cid", "lon", "lat")).alias("_best"))
        unit = F.when(F.col("_repeats"), F.lit(0)).otherwise(F.col("_pos"))
        out = x.groupBy(*group, unit.alias("_unit")).agg(
            F.min(F.struct("_pos", "start_ts", "stay_s", "cid", "lon", "lat")).alias("_from"),
            F.max(F.struct("_pos", "end_ts")).alias("_to"), *o.slice_columns(),
        )
        out = out.join(best.withColumn("_unit", F.lit(0).cast("long")), [*group, "_unit"], "left")
        chosen = F.when(F.col("_best").isNull(), F.struct("_from.cid", "_from.lon", "_from.lat")).otherwise(
            F.struct("_best.cid", "_best.lon", "_best.lat"))
    else:
        best = F.min(F.struct(rank, "_seen", "cid", "lon", "lat"))
        out = _stations(_units(x, o), o).groupBy(*group, "_unit", "_from", "_to").agg(best.alias("_best"))
        chosen = F.struct("_best.cid", "_best.lon", "_best.lat")
    out = out.withColumn("_chosen", chosen).withColumns({
        "cid": F.col("_chosen.cid"), "lon": F.col("_chosen.lon"), "lat": F.col("_chosen.lat"),
        "start_ts": F.col("_from.start_ts"), "end_ts": F.col("_to.end_ts"),
    })
    stay = F.when(F.col("_unit") == 0, seconds_between("start_ts", "end_ts")).otherwise(F.col("_from.stay_s"))
    return out.withColumn("stay_s", stay).select(*STAY_COLUMNS, *slice_of(out, o))
