"""Ordered computations inside a key: neighbours, running values and group totals.

Most keys (a user, a node) have few rows, and plain windows partitioned by the key are the right plan:
one exchange serves a whole chain of them. A key may also hold a large part of all rows. Such keys are
found by a counting pass, range-partitioned by (key, order) into slices of bounded size, and evaluated
slice by slice: each slice works alone, and one row per slice carries what the next ones need.

Operators are written once against the interface shared by ``Whole`` and ``Sliced``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..defaults import BROADCAST_ROWS, HOT_ROWS
from ..session import cut

SLICE = "_slice"
# Tells rows of a hot key apart that are equal in all order columns, so that every step sees them in one order.
ROW = "_row"


class Whole:
    """Keys small enough for one task each."""

    sliced = False

    def __init__(self, *keys: str):
        self.keys = list(keys)

    def within(self, *cols: str) -> "Whole":
        """The same, with further columns added to the key."""
        return type(self)(*self.keys, *cols)

    def slice_columns(self) -> list[Column]:
        """What an aggregation has to keep for later ordered steps: nothing here."""
        return []

    def settle(self, df: DataFrame) -> DataFrame:
        """Called before a frame is used more than once."""
        return df

    def neighbours(self, df: DataFrame, order: list[str], prev: dict | None = None, next: dict | None = None):
        w = Window.partitionBy(*self.keys).orderBy(*order)
        new = {n: F.lag(c).over(w) for n, c in (prev or {}).items()}
        new |= {n: F.lead(c).over(w) for n, c in (next or {}).items()}
        return df.withColumns(new)

    def running(self, df: DataFrame, order: list[str], sums: dict | None = None, maxes: dict | None = None):
        w = Window.partitionBy(*self.keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        new = {n: F.sum(c).over(w) for n, c in (sums or {}).items()}
        new |= {n: F.max(c).over(w) for n, c in (maxes or {}).items()}
        return df.withColumns(new)

    def totals(self, df: DataFrame, group: list[str], sums=None, mins=None, maxes=None):
        w = Window.partitionBy(*self.keys, *group)
        return df.withColumns({n: f(c).over(w) for n, f, c in _aggregates(sums, mins, maxes)})


class Sliced(Whole):
    """Keys spread over slices: local windows plus one carried row per slice."""

    sliced = True

    def slice_columns(self) -> list[Column]:
        return [F.min(SLICE).alias(SLICE)]

    def settle(self, df: DataFrame) -> DataFrame:
        return cut(df)

    def _local(self, *more: str):
        return Window.partitionBy(*self.keys, SLICE, *more)

    def _carry(self, summary: DataFrame) -> DataFrame:
        return summary.withColumnsRenamed({k: f"_k_{k}" for k in [*self.keys, SLICE]})

    def _join_carry(self, df: DataFrame, carry: DataFrame) -> DataFrame:
        on = [df[k].eqNullSafe(carry[f"_k_{k}"]) for k in [*self.keys, SLICE]]
        return df.join(carry, on, "left").drop(*[f"_k_{k}" for k in [*self.keys, SLICE]])

    def neighbours(self, df, order, prev=None, next=None):
        prev, next = prev or {}, next or {}
        df, order = self.settle(df), _total(df, order)
        position = F.struct(*order)
        edge = [F.max_by(F.struct(F.lit(1).alias("_on"), *[_as(c, n) for n, c in prev.items()]), position).alias("_carry_last"),
                F.min_by(F.struct(F.lit(1).alias("_on"), *[_as(c, n) for n, c in next.items()]), position).alias("_carry_first")]
        across = Window.partitionBy(*self.keys).orderBy(SLICE)
        carry = (
            df.groupBy(*self.keys, SLICE).agg(*edge)
            .withColumns({"_carry_before": F.lag("_carry_last").over(across), "_carry_after": F.lead("_carry_first").over(across)})
            .drop("_carry_last", "_carry_first")
        )
        w = self._local().orderBy(*order)
        local = df.withColumns(
            {"_carry_head": F.row_number().over(w) == 1, "_carry_tail": F.lead(F.lit(1)).over(w).isNull()}
            | {n: F.lag(c).over(w) for n, c in prev.items()}
            | {n: F.lead(c).over(w) for n, c in next.items()}
        )
        joined = self._join_carry(local, self._carry(carry))
        filled = {n: F.when(F.col("_carry_head"), F.col(f"_carry_before.{n}")).otherwise(F.col(n)) for n in prev}
        filled |= {n: F.when(F.col("_carry_tail"), F.col(f"_carry_after.{n}")).otherwise(F.col(n)) for n in next}
        return joined.withColumns(filled).drop("_carry_head", "_carry_tail", "_carry_before", "_carry_after")

    def running(self, df, order, sums=None, maxes=None):
        sums, maxes = sums or {}, maxes or {}
        df, order = self.settle(df), _total(df, order)
        earlier = Window.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        parts = [F.sum(c).alias(f"_c_{n}") for n, c in sums.items()]
        parts += [F.max(c).alias(f"_c_{n}") for n, c in maxes.items()]
        carry = df.groupBy(*self.keys, SLICE).agg(*parts).withColumns(
            {f"_c_{n}": F.sum(f"_c_{n}").over(earlier) for n in sums}
            | {f"_c_{n}": F.max(f"_c_{n}").over(earlier) for n in maxes}
        )
        w = self._local().orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        local = df.withColumns(
            {n: F.sum(c).over(w) for n, c in sums.items()} | {n: F.max(c).over(w) for n, c in maxes.items()}
        )
        joined = self._join_carry(local, self._carry(carry))
        filled = {n: F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in sums}
        filled |= {n: F.greatest(F.col(n), F.col(f"_c_{n}")) for n in maxes}
        return joined.withColumns(filled).drop(*[f"_c_{n}" for n in [*sums, *maxes]])

    def totals(self, df, group, sums=None, mins=None, maxes=None):
        df = self.settle(df)
        specs = _aggregates(sums, mins, maxes)
        local = df.withColumns({n: f(c).over(self._local(*group)) for n, f, c in specs})
        keys = [*self.keys, *group]
        spanning = (
            df.groupBy(*keys, SLICE).agg(*[f(c).alias(n) for n, f, c in specs])
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("_slices"), *[f(n).alias(f"_c_{n}") for n, f, _ in specs])
            .filter("_slices > 1").drop("_slices")
            .withColumnsRenamed({k: f"_k_{k}" for k in keys})
        )
        joined = local.join(spanning, [local[k].eqNullSafe(spanning[f"_k_{k}"]) for k in keys], "left")
        return (
            joined.withColumns({n: F.coalesce(F.col(f"_c_{n}"), F.col(n)) for n, _, _ in specs})
            .drop(*[f"_k_{k}" for k in keys], *[f"_c_{n}" for n, _, _ in specs])
        )


def _total(df: DataFrame, order: list[str]) -> list[str]:
    return [*order, ROW] if ROW in df.columns else order


def _as(c, name: str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).alias(name)


def _aggregates(sums, mins, maxes):
    return (
        [(n, F.sum, c) for n, c in (sums or {}).items()]
        + [(n, F.min, c) for n, c in (mins or {}).items()]
        + [(n, F.max, c) for n, c in (maxes or {}).items()]
    )


def split_hot(df: DataFrame, keys: list[str], order: list[str], hot_rows: int | None, probe: DataFrame | None = None):
    """(rows of ordinary keys, rows of hot keys with a slice number or None).

    The keys are counted in probe, a frame that has at least the rows of df for every key and is cheaper to
    read, or in df itself.
    There are at most rows / hot_rows hot keys, so the table of them stays small; it is broadcast only
    when counted below the limit. Slice numbers come from range partitioning and are fixed by a checkpoint.
    """
    if not hot_rows:
        return df, None
    hot = (df if probe is None else probe).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    n_hot, n_rows = hot.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if not n_hot:
        return df, None
    hot = cut(hot.select(*[F.col(k).alias(f"_k_{k}") for k in keys]))
    if n_hot <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    slices = -(-int(n_rows) // hot_rows) + 1
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]  # a null key may be a hot one
    rows = (
        df.join(hot, same, "left_semi")
        .repartitionByRange(slices, *keys, *order)
        .withColumns({SLICE: F.spark_partition_id(), ROW: F.monotonically_increasing_id()})
    )
    return df.join(hot, same, "left_anti"), cut(rows)


def per_key(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    body: Callable[[DataFrame, Whole], DataFrame],
    hot_rows: int | None = HOT_ROWS,
    probe: DataFrame | None = None,
) -> DataFrame:
    """Run an ordered computation: ordinary keys whole, hot keys in slices.

    body may chain any number of steps that keep to the keys and never add rows; the check is made once.
    """
    cold, hot = split_hot(df, keys, order, hot_rows, probe)
    out = body(cold, Whole(*keys))
    if hot is None:
        return out
    return out.unionByName(body(hot, Sliced(*keys)).drop(SLICE, ROW))
