"""From raw call records to cleaned trajectories."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .. import defaults as D
from ..operators.dimensions import NEIGHBOURS, canonicalize_cells, filter_users, locate_cells, with_neighbours
from ..operators.drift import without_drift
from ..operators.ordered import Whole, per_key
from ..operators.pingpong import collapsed
from ..operators.stays import RECORD_ORDER, USER, merged, more_than, runs

Step = Callable[[DataFrame, Whole], DataFrame]


@dataclass(frozen=True)
class CleaningConfig:
    min_records: int = D.MIN_RAW_RECORDS
    stay_gap_s: int = D.STAY_GAP_S
    keep_last: bool = False
    min_runs: int = D.MIN_RUNS
    drift_gap_s: int = D.DRIFT_GAP_S
    far_km: float = D.DRIFT_FAR_KM
    max_speed: float = D.DRIFT_SPEED_MS
    point_ratio: float = D.DRIFT_POINT_RATIO
    cluster_ratio: float = D.DRIFT_CLUSTER_RATIO
    max_share: float = D.DRIFT_SHARE
    cluster_s: int = D.DRIFT_CLUSTER_S
    min_cells: int = D.DRIFT_CELLS
    isolated_rule: bool = False
    true_share: bool = False
    min_stays: int = D.MIN_CLEAN_STAYS
    pingpong_gap_s: int = D.PINGPONG_GAP_S
    merge_gap_s: int = D.MERGE_GAP_S
    exact_count: bool = False
    compat: bool = True
    min_merged: int = D.MIN_MERGED_STAYS
    hot_rows: int | None = D.HOT_ROWS


def locate(cdr: DataFrame, users: DataFrame | None, alias: DataFrame | None, cells: DataFrame,
           adjacency: DataFrame | None = None) -> DataFrame:
    """Records of the wanted users at canonical cells with positions and, with an adjacency table, the neighbours of the cell."""
    if users is not None:
        cdr = filter_users(cdr, users)
    if alias is not None:
        cdr = canonicalize_cells(cdr, alias)
    # Neighbours come with the cells, so drift removal needs no join of the stays.
    more = [] if adjacency is None else [NEIGHBOURS]
    return locate_cells(cdr, with_neighbours(cells, adjacency) if more else cells).select("user", "ts", "cid", "lon", "lat", *more)


def user_steps(records: DataFrame, *steps: Step, hot_rows: int | None = D.HOT_ROWS, probe: DataFrame | None = None) -> DataFrame:
    """Chain trajectory steps (frame, ordered) -> frame on located records.

    All steps work inside a user, so ordinary users need one exchange for the whole chain, and hot users are
    looked for once, in probe (the records before the lookups) if given.
    """
    def chain(d: DataFrame, o: Whole) -> DataFrame:
        for step in steps:
            d = step(d, o)
        return d

    return per_key(records, USER, RECORD_ORDER, chain, hot_rows, probe)


def clean_located(records: DataFrame, adjacency: DataFrame | None = None, cfg: CleaningConfig = CleaningConfig(),
                  probe: DataFrame | None = None) -> DataFrame:
    """Stay runs, drift removal, ping-pong collapse and merging, with the row gates between them. Neighbours of cells come with the records (`locate`) or, joined
    here, from an adjacency table."""
    records = records if adjacency is None else with_neighbours(records, adjacency)

    def chain(d: DataFrame, o: Whole) -> DataFrame:
        d = more_than(d, o, cfg.min_records)
        d = more_than(runs(d, o, cfg.stay_gap_s, cfg.keep_last), o, cfg.min_runs)
        d = without_drift(
            d, o, gap_s=cfg.drift_gap_s, far_km=cfg.far_km, max_speed=cfg.max_speed,
            point_ratio=cfg.point_ratio, cluster_ratio=cfg.cluster_ratio, max_share=cfg.max_share,
            cluster_s=cfg.cluster_s, min_cells=cfg.min_cells, isolated_rule=cfg.isolated_rule, true_share=cfg.true_share,
        )
        d = collapsed(more_than(d, o, cfg.min_stays), o, cfg.pingpong_gap_s, cfg.compat)
        d = merged(d, o, cfg.merge_gap_s, cfg.exact_count, cfg.compat)
        return more_than(d, o, cfg.min_merged)

    return user_steps(records, chain, hot_rows=cfg.hot_rows, probe=probe)


def clean_traces(cdr: DataFrame, users: DataFrame | None, alias: DataFrame | None, cells: DataFrame,
                 adjacency: DataFrame | None = None, cfg: CleaningConfig = CleaningConfig()) -> DataFrame:
    """Raw records (user, ts, cid) to merged stays: user, cid, lon, lat, start_ts, end_ts, stay_s, n_records."""
    return clean_located(locate(cdr, users, alias, cells, adjacency), None, cfg, probe=cdr.select("user"))
