"""Merkle manifest of a dataset: a digest for every row, a root for every group and for all, and for every row a witness that leads to the root.

Rows of a group are leaves in ascending order. While several nodes remain, every FAN consecutive ones become the digest of their digests; the last run may
be shorter, even a single node. Roots of the groups, ordered by group, are the leaves of one tree more.

Witnesses are built incrementally. A block is an aligned subtree of FAN^HEIGHT leaves, streamed through one task: each leaf is appended to the open runs and
gets an empty witness; whenever a run is complete, the witnesses below each of its nodes are extended by that node's siblings, and the run's digest is
appended one level higher. What is still open at the end of a group is completed as it stands. Block roots are then appended in the same way as
leaves of a smaller table, and so on until each group has one node; a block's own witness is read back ahead of its leaves and extends theirs. No task
holds more than one block, whatever the size of a group.

Defined cases: a null group is a group of its own and the first, null order columns come first, rows equal in the order columns are ordered by their
leaf (equal rows are interchangeable, and each has its own place); null values are part of the leaf, different from empty ones; texts of any length are
hashed where they lie; a table of one row has its leaf as root and an empty witness; no rows give no rows. Other columns stay, also with clashing names:
only the columns this module adds replace columns of their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ranks import ranked
from ..session import cut

FAN = 8
HEIGHT = 3
STEP = "struct<left:string,right:string>"
_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])


def leaf(*values: Column) -> Column:
    """Digest of a row's values: of each its length in bytes, a colon and its text, or a dash for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(start: Column, witness: Column) -> Column:
    """The root to which a witness leads from a leaf."""
    return F.aggregate(witness, start, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def siblings(witness: Column) -> Column:
    """All digests of a witness, level by level, left to right, in one string."""
    return F.array_join(F.transform(witness, lambda step: F.concat(step["left"], step["right"])), "")


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


class OpenRuns:
    """Leaves appended one after the other, and the witnesses of all of them as far as their runs are complete."""

    def __init__(self) -> None:
        self.runs: list[list[tuple[str, list[int]]]] = [[]]  # of each level: the nodes of its open run, each with the leaves below it
        self.witnesses: list[list[tuple[str, str]]] = []

    def append(self, node: str) -> None:
        self.witnesses.append([])
        self._place(0, node, [len(self.witnesses) - 1])

    def _place(self, level: int, node: str, below: list[int]) -> None:
        if level == len(self.runs):
            self.runs.append([])
        self.runs[level].append((node, below))
        if len(self.runs[level]) == FAN:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        nodes = [node for node, _ in run]
        for k, (_, below) in enumerate(run):
            step = ("".join(nodes[:k]), "".join(nodes[k + 1 :]))
            for one in below:
                self.witnesses[one].append(step)
        self._place(level + 1, digest(nodes), [one for _, below in run for one in below])

    def close(self, levels: int | None) -> str:
        """Complete what is open, up to a number of levels, or until one node remains; that node."""
        level = 0
        while level < levels if levels is not None else any(self.runs[level + 1 :]) or len(self.runs[level]) > 1:
            if level < len(self.runs) and self.runs[level]:
                self._complete(level)
            level += 1
        return self.runs[level][0][0]


def blocks_of(batches: Iterator[pa.RecordBatch], limit: int | None = None) -> Iterator[pa.Table]:
    """Tables of rows with the same (_group, _block), which arrive one after the other; of more than `limit` rows, several tables."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        group, block = batch.column("_group").to_pylist(), batch.column("_block").to_numpy()
        new = np.ones(len(group), dtype=bool)
        new[1:] = (block[1:] != block[:-1]) | np.fromiter((a != b for a, b in zip(group[1:], group)), bool, len(group) - 1)
        edges = [*np.flatnonzero(new).tolist(), len(group)]
        for a, b in zip(edges, edges[1:]):
            if held and (group[a], block[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = (group[a], block[a])
            while limit and sum(h.num_rows for h in held) + b - a > limit:
                free = limit - sum(h.num_rows for h in held)
                yield pa.Table.from_batches([*held, batch.slice(a, free)])
                held, a = [], a + free
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _grown(nodes: list[str], n: int, height: int) -> tuple[OpenRuns, str]:
    """A block's nodes appended, and its root. A group of more than one block takes every block up to the same level."""
    tree = OpenRuns()
    for node in nodes:
        tree.append(node)
    return tree, tree.close(height if n > FAN**height else None)


def _roots(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[pa.RecordBatch]:
    for block in blocks_of(batches):
        n = block.column("_n")[0].as_py()
        root = _grown(block.column("_node").to_pylist(), n, height)[1]
        yield pa.RecordBatch.from_pydict({
            "_group": block.column("_group").combine_chunks()[:1], "_rank": pa.array([block.column("_block")[0].as_py()], pa.int64()),
            "_n": pa.array([-(-n // FAN**height)], pa.int64()), "_node": [root],
        })


def _extended(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[pa.RecordBatch]:
    """Blocks whose first row holds the block's own witness and the root of its group: the leaves with their whole witnesses."""
    for block in blocks_of(batches):
        names, above = [n for n in block.column_names if n not in HEADER], block.slice(0, 1).to_pylist()[0]
        rows = block.slice(1).combine_chunks()
        tree, _ = _grown(rows.column("_node").to_pylist(), rows.column("_n")[0].as_py(), height)
        upper = [(s["left"], s["right"]) for s in above["_above"]]
        steps = [step for own in tree.witnesses for step in (*own, *upper)]
        ends = np.cumsum([0] + [len(own) + len(upper) for own in tree.witnesses])
        flat = pa.StructArray.from_arrays([pa.array([s[k] for s in steps], pa.string()) for k in (0, 1)], fields=list(_STEP))
        witness = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
        subroot = pa.array([above["_subroot"]] * rows.num_rows, pa.string())
        yield pa.RecordBatch.from_arrays([*[rows.column(n).chunk(0) for n in names], subroot, witness], [*names, "_subroot", "_witness"])


HEADER = ("_above", "_subroot")


def _streamed(df: DataFrame) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, "_group", "_block").sortWithinPartitions("_group", "_block", "_rank")


def _in_blocks(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("_block", F.floor(F.col("_rank") / FAN**height))


def _climbed(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The nodes, their block roots, the roots of blocks of those and so on; the last has one row a group. Each is smaller by a block's size."""
    levels = [nodes]
    while len(levels) == 1 or not levels[-1].filter("_n > 1").isEmpty():
        below = _in_blocks(levels[-1], height).select("_group", "_block", "_rank", "_n", "_node")
        levels.append(cut(_streamed(below).mapInArrow(partial(_roots, height=height), "_group string, _rank long, _n long, _node string")))
    return levels


def _descended(levels: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """The lowest level with witnesses. tops: _group, _above (from the group's root on), _subroot."""
    above = tops.withColumn("_block", F.lit(0).cast("long"))
    for level in reversed(levels[:-1]):
        rows = _in_blocks(level, height)
        first = above.withColumn("_rank", F.lit(-1).cast("long"))
        streamed = _streamed(rows.unionByName(first, allowMissingColumns=True))
        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        done = streamed.mapInArrow(partial(_extended, height=height), f"{kept}, _subroot string, _witness array<{STEP}>").drop("_block")
        if level is not levels[0]:
            above = cut(done.select("_group", F.col("_rank").alias("_block"), F.col("_witness").alias("_above"), "_subroot"))
    return done


def manifest(df: DataFrame, group: str, order: list[str], leaf: str, height: int = HEIGHT) -> DataFrame:
    """df with subroot, root and witness (steps from the leaf to the root: the siblings left and right of the node, level by level). height: levels of a
    block, which only say how the work is dealt out."""
    names = [c for c in df.columns if c not in ("subroot", "root", "witness")]
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null first, the others bytewise
    kept = F.struct(*[df[c] for c in names]).alias("_row")
    leaves = cut(df.select(named.alias("_group"), F.struct(*order).alias("_order"), F.col(leaf).alias("_node"), kept))
    levels = _climbed(cut(ranked(leaves, "_group", ["_order", "_node"]).drop("_order")), height)
    subroots = levels[-1].select(F.lit("").alias("_group"), F.col("_group").alias("_name"), "_node")
    higher = _climbed(cut(ranked(subroots, "_group", ["_name"])), height)
    top = higher[-1].first()
    none = higher[-1].select("_group", F.array().cast(f"array<{STEP}>").alias("_above"), F.lit(None).cast("string").alias("_subroot"))
    tops = _descended(higher, none, height).select(F.col("_name").alias("_group"), F.col("_witness").alias("_above"), F.col("_node").alias("_subroot"))
    return _descended(levels, cut(tops), height).select(
        "_row.*", F.col("_subroot").alias("subroot"), F.lit(top["_node"] if top else None).cast("string").alias("root"), F.col("_witness").alias("witness")
    )
