"""Lookups against user lists and cell tables.

Nothing is hinted: Spark broadcasts a dimension when its size is below the session's threshold, and
otherwise joins by shuffle, where adaptive execution splits the partitions of hot cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

NEIGHBOURS = "nbrs"


def filter_users(df: DataFrame, users: DataFrame) -> DataFrame:
    """Keep the records of listed users."""
    return df.join(users.select("user"), "user", "left_semi")


def canonicalize_cells(df: DataFrame, alias: DataFrame) -> DataFrame:
    """Replace each cell id by its canonical one; records of unlisted cells are dropped."""
    others = [c for c in df.columns if c != "cid"]
    return df.join(alias.select("cid", "canon_cid"), "cid").select(*others, F.col("canon_cid").alias("cid"))


def locate_cells(df: DataFrame, cells: DataFrame) -> DataFrame:
    """Attach lon and lat, and the neighbours that the cells may have; records of cells without a position are dropped."""
    placed = cells.select("cid", "lon", "lat", *[NEIGHBOURS] * (NEIGHBOURS in cells.columns)).filter("lon IS NOT NULL AND lat IS NOT NULL")
    return df.join(placed, "cid")


def with_neighbours(df: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Rows with the set of cells that the directional adjacency table lists for theirs, as a column `nbrs` that goes along with them; null if it lists none."""
    sets = adjacency.groupBy("cid").agg(F.collect_set("nbr_cid").alias(NEIGHBOURS))
    return df.drop(NEIGHBOURS).join(sets, "cid", "left").select(*[c for c in df.columns if c != NEIGHBOURS], NEIGHBOURS)
