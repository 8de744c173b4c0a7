"""Activity regions: A-B-A loops of stays merged into one region of several cells.

A loop starts at a stay whose cell comes again two stays later. It grows while one of the next ``lookahead``
stays is in a place the region already has. A place is known to the region exactly when its last earlier
occurrence lies at or after the region's start, so window functions can say for every stay how far back the
nearest following stays reach ("reach"); the region starting at b ends at the first stay from b + 2 on whose
reach lies before b. Only the choice of starts is sequential.

Where nothing known lies ahead of a stay (its reach is 0), no region stays open: one that began two stays before or earlier ends there, and a later start would
have a reach of its own. So a segment falls into blocks that end at such stays, found by running sums, and each block is folded alone, mostly a few
stays: the fold keeps the open start and the regions closed so far. Only slices of hot users, whose blocks may be of any length, are composed by summaries.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..defaults import HOT_ROWS, REGION_GAP_S
from ..functions.clock import seconds_between
from .ordered import SLICE, Whole, per_key
from .stays import STAY_ORDER, USER, segments

CELL = ["cid", "lon", "lat"]

# Executors get the few functions below with the task and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def merge_regions(df: DataFrame, cut_s: int = REGION_GAP_S, lookahead: int = 2,
                  hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Regions and remaining stays: user, start_ts, end_ts, stay_s, is_region, cells[cid, lon, lat, n]."""
    return per_key(df, USER, STAY_ORDER, lambda d, o: looped(d, o, cut_s, lookahead), hot_rows)


def region_cells(regions: DataFrame) -> DataFrame:
    """One row per cell of a region, in order of first appearance."""
    return regions.select("user", "start_ts", "end_ts", "is_region", F.posexplode("cells").alias("position", "cell")).select(
        "user", "start_ts", "end_ts", "is_region", "position", "cell.cid", "cell.lon", "cell.lat", "cell.n"
    )


def region_lines(regions: DataFrame) -> DataFrame:
    """Text form: tab-joined cells, longitudes and latitudes, times and stay, tab-joined counts."""
    def listed(field: str):
        return F.array_join(F.transform("cells", lambda c: c[field].cast("string")), "\t", "")

    stamp = "yyyyMMddHHmmss"
    return regions.select(
        F.concat_ws(",", listed("cid"), listed("lon"), listed("lat"), F.date_format("start_ts", stamp),
                    F.date_format("end_ts", stamp), "stay_s", listed("n")).alias("value")
    )


def looped(df: DataFrame, o: Whole, cut_s: int = REGION_GAP_S, lookahead: int = 2) -> DataFrame:
    x = segments(df, o, cut_s)
    seg = o.within("seg_id")
    x = seg.running(x, STAY_ORDER, sums={"_pos": F.lit(1)})
    x = o.within("seg_id", *CELL).neighbours(x, ["_pos"], prev={"_prev": "_pos"})
    ahead = F.struct("cid", F.coalesce("_prev", F.lit(0)).alias("prev"))
    names = [f"_a{i}" for i in range(1, max(lookahead, 2) + 1)]
    for i, name in enumerate(names):
        x = seg.neighbours(x, ["_pos"], next={name: ahead if i == 0 else names[i - 1]})
    reaches = [F.when(F.col(f"{a}.prev") <= F.col("_pos"), F.col(f"{a}.prev")) for a in names[:lookahead]]
    x = x.withColumns({
        "_loop": F.coalesce(F.col("_a2.cid") == F.col("cid"), F.lit(False)),
        "_reach": F.greatest(F.lit(0).cast("long"), *reaches),
    }).drop("_prev", *names)
    return _collect(_assign(x, o), o)


def _assign(x: DataFrame, o: Whole) -> DataFrame:
    """Add _region: the position of the first stay of the region a stay belongs to, 0 if none."""
    if not o.sliced:
        return _folded(x, o)
    schema = x.withColumn("_region", F.lit(0).cast("long")).schema
    # A segment may span slices: sum up each slice, follow the open region along the slices of a segment,
    # then mark each slice with the region that is open where it begins.
    x = o.settle(x)
    part = [*o.keys, "seg_id", SLICE]
    fields = {f.name: f.dataType.simpleString() for f in x.select(*part).schema}
    head = ", ".join(f"{n} {t}" for n, t in fields.items())
    summaries = x.select(*part, "_pos", "_loop", "_reach").groupBy(*part).applyInPandas(
        _summarize(part), head + ", first long, from_scan long, from_last long, bounds array<long>, outs array<long>"
    )
    opened = summaries.groupBy(*o.keys, "seg_id").applyInPandas(_follow(part), head + ", _open long")
    return x.join(opened, part).groupBy(*part).applyInPandas(_mark, schema)


def _folded(x: DataFrame, o: Whole) -> DataFrame:
    """The same for whole segments, block by block. The arrays of a block are as long as it is, and a region copies those before it in its block."""
    x = o.within("seg_id").running(x, ["_pos"], sums={"_ends": (F.col("_reach") == 0).cast("long")})
    block = F.col("_ends") - (F.col("_reach") == 0).cast("long")
    fields = [c for c in x.columns if c not in (*o.keys, "seg_id", "_ends")]
    # _pos comes first, so the array is sorted by it.
    rows = F.array_sort(F.collect_list(F.struct("_pos", *[c for c in fields if c != "_pos"])))
    blocks = x.groupBy(*o.keys, "seg_id", block.alias("_block")).agg(rows.alias("_rows"), F.max("_loop").alias("_any"))
    region = "struct<first: bigint, last: bigint>"
    none = F.lit(0).cast("long")
    start = F.struct(none.alias("open"), F.array().cast(f"array<{region}>").alias("done"))

    def step(acc, row):
        opened = F.when(acc["open"] > 0, acc["open"]).when(row["_loop"], row["_pos"]).otherwise(none)
        ends = (opened > 0) & (row["_pos"] >= opened + 2) & (row["_reach"] < opened)
        closed = F.struct(opened.alias("first"), row["_pos"].alias("last"))
        return F.struct(F.when(ends, none).otherwise(opened).alias("open"), F.when(ends, F.array_append(acc["done"], closed)).otherwise(acc["done"]).alias("done"))

    regions = F.when(F.col("_any"), F.aggregate("_rows", start, step, lambda acc: acc["done"])).otherwise(F.array().cast(f"array<{region}>"))
    blocks = blocks.withColumn("_done", regions)
    first = F.element_at("_rows", 1)["_pos"]

    def owners(r, k):
        after = F.when(k > 0, F.get("_done", k - 1)["last"]).otherwise(first - 1)
        return F.concat(F.array_repeat(none, (r["first"] - after - 1).cast("int")), F.array_repeat(r["first"], (r["last"] - r["first"] + 1).cast("int")))

    # Stays behind the last region have no entry.
    blocks = blocks.withColumn("_owners", F.flatten(F.transform("_done", owners)))
    out = blocks.select(*o.keys, "seg_id", "_owners", F.posexplode("_rows").alias("_k", "_row"))
    return out.select(*o.keys, "seg_id", *[F.col(f"_row.{c}").alias(c) for c in fields], F.coalesce(F.get("_owners", F.col("_k")), none).alias("_region"))


def _scan(pos, loop, reach, start: int, opened: int, owner=None, settled=None) -> int:
    """Go over the stays from index start; return the start of the region still open at the end, or 0.

    settled holds, for indexes already reached without an open region, what came out in the end.
    """
    free = []
    for i in range(start, len(pos)):
        if not opened:
            if settled is not None:
                if i in settled:
                    opened = settled[i]
                    break
                free.append(i)
            if loop[i]:
                opened = pos[i]
        if opened:
            if owner is not None:
                owner[i] = opened
            if pos[i] >= opened + 2 and reach[i] < opened:
                opened = 0
    if settled is not None:
        settled.update(dict.fromkeys(free, opened))
    return int(opened)


def _mark(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("_pos", ignore_index=True)
    owner = np.zeros(len(pdf), dtype="int64")
    opened = int(pdf.pop("_open").iloc[0])
    _scan(pdf["_pos"].tolist(), pdf["_loop"].tolist(), pdf["_reach"].tolist(), 0, opened, owner)
    pdf["_region"] = owner
    return pdf


def _summarize(part: list[str]):
    """What a slice does to a region open at its beginning, for every start the region may have."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos", ignore_index=True)
        pos, loop, reach = pdf["_pos"].tolist(), pdf["_loop"].tolist(), pdf["_reach"].tolist()
        first = pos[0]
        bounds, outs, lowest, settled = [], [], first, {}
        scanned = _scan(pos, loop, reach, 0, 0, settled=settled)
        for i, r in enumerate(reach):
            if r < lowest:
                lowest = r
                bounds.append(r)
                outs.append(_scan(pos, loop, reach, i + 1, 0, settled=settled))
        return pd.DataFrame({
            **{c: [pdf[c].iloc[0]] for c in part}, "first": [first],
            "from_scan": [scanned], "from_last": [_scan(pos, loop, reach, 0, first - 1)],
            "bounds": [bounds], "outs": [outs],
        })

    return run


def _follow(part: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(SLICE, ignore_index=True)
        opened, at = 0, []
        for first, scan, last, bounds, outs in zip(
            pdf["first"], pdf["from_scan"], pdf["from_last"], pdf["bounds"], pdf["outs"]
        ):
            at.append(opened)
            if not opened:
                opened = scan
            elif opened == first - 1:
                opened = last
            else:
                opened = next((out for bound, out in zip(bounds, outs) if bound < opened), opened)
        return pdf[part].assign(_open=np.array(at, dtype="int64"))

    return run


def _collect(x: DataFrame, o: Whole) -> DataFrame:
    unit = F.when(F.col("_region") > 0, F.col("_region")).otherwise(F.col("_pos"))
    cells = x.groupBy(*o.keys, "seg_id", unit.alias("_unit"), *CELL).agg(
        F.sum("n_records").alias("n"),
        F.min(F.struct("_pos", "start_ts", "stay_s")).alias("_from"),
        F.max(F.struct("_pos", "end_ts")).alias("_to"),
        F.max(F.col("_region") > 0).alias("is_region"),
        *o.slice_columns(),
    )
    # One entry per distinct cell of the region.
    member = F.struct(F.col("_from._pos").alias("pos"), *CELL, "n")
    out = cells.groupBy(*o.keys, "seg_id", "_unit").agg(
        F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.max("is_region").alias("is_region"),
        F.transform(F.array_sort(F.collect_list(member)),
                    lambda m: F.struct(m["cid"].alias("cid"), m["lon"].alias("lon"), m["lat"].alias("lat"),
                                       m["n"].alias("n"))).alias("cells"),
        *o.slice_columns(),
    )
    out = out.withColumns({"start_ts": F.col("_from.start_ts"), "end_ts": F.col("_to.end_ts")})
    stay = F.when(F.col("is_region"), seconds_between("start_ts", "end_ts")).otherwise(F.col("_from.stay_s"))
    return out.withColumn("stay_s", stay).select(
        "user", "start_ts", "end_ts", "stay_s", "is_region", "cells", *([SLICE] if o.sliced else [])
    )
