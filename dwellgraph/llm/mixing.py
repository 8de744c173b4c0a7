"""Mixing sources to target weights by balanced sampling (cube method).

Every source has a target of words; divided by the source's size it is the number of times each of its documents is taken on average, whole copies and a
fraction. The fractions are inclusion probabilities. The flight moves them through the null space of the constraints (words and documents of the source
stay as expected) until they are 0 or 1: the largest document still open is pushed, all others of its block make up for it together, and a
draw between the two ends of the way keeps every probability what it was. A block ends with two open documents at most, its smallest ones. Blocks are
bounded and independent; what they leave open is dealt into new blocks, smaller by BLOCK / 2 each round, until a source is one block. There the landing
tries all ways to round the last LANDING documents and takes the nearest to the words still due.

Draws are keyed by seed, source, round and block, and blocks by hashes of the rows, so that reruns and retries agree whatever the partitions.

Defined cases: a null source is a source, the last; a null or empty text has size 0 and takes 0 words; equal rows are taken separately (which of
them, cannot be told apart); texts of any length are counted whole; a single document of a source is rounded to the nearer end; a corpus without words has
targets of 0; no rows give no rows. Other columns stay, also with clashing names: only the columns this module adds replace columns of their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..defaults import BROADCAST_ROWS
from ..operators.ranks import ranked
from ..session import cut
from .merkle import blocks_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK = 512
PART = 4 * BLOCK
LANDING = 10
NOT_MOVED = 1e-9


def words(text: str = "text"):
    """How many words a text has."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(_group, _words, ...) with one row a source, _group in the order in which weights repeat: adds `target`.

    share of all words is dealt out by weight. A source gets `most` times its words at most; what is over goes to the others by weight, until none is
    above. Each pass is an aggregation of the sources; it ends when no further source reaches its end.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    sources = cut(ranked(sizes.withColumn("_all", F.lit(0)), "_all", ["_group"]).select(*sizes.columns, weight.alias("_weight")))
    end = F.col("_words") * F.lit(most)
    level = 0.0  # words a unit of weight
    while True:
        full = end <= F.lit(level) * F.col("_weight")
        total, taken, open_ = sources.agg(F.sum("_words"), F.sum(F.when(full, end)), F.sum(F.when(~full, F.col("_weight")))).first()
        higher = ((total or 0) * share - (taken or 0.0)) / open_ if open_ else level
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return sources.withColumn("target", F.least(end, F.lit(level) * F.col("_weight")))


def _uniform(*key) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr(key).encode()).digest()[:8], "little"))


def flight(p: np.ndarray, balanced: np.ndarray, draw: np.random.Generator, leave: int = 0) -> np.ndarray:
    """Probabilities moved to 0 or 1 except for as many as there are constraints at most, or until `leave` are open. balanced: a row a constraint; their products
    with p do not change. Units come in the order in which they are to be decided."""
    p = p.copy()
    scale = np.abs(balanced).max(axis=1, keepdims=True)
    A = balanced / np.where(scale == 0, 1, scale)
    at, alive = np.arange(len(p)), p.copy()
    first = 0
    while True:
        free = alive * (1 - alive)
        while first < len(alive) and free[first] == 0:
            first += 1
        if first == len(alive) or leave and np.count_nonzero(free) <= leave:
            break
        weighed = A * free
        v = -A.T @ (np.linalg.pinv(weighed @ A.T, rcond=1e-10, hermitian=True) @ weighed[:, first])
        v[first] += 1
        u = free * v
        if u[first] <= NOT_MOVED * free[first]:
            first += 1  # only this unit can hold up its part of a constraint
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - alive) / u, np.where(u < 0, alive / -u, np.inf))
            down = np.where(u > 0, alive / u, np.where(u < 0, (1 - alive) / -u, np.inf))
        a, b = up.min(), down.min()
        step, hit = (a, up <= a * (1 + 1e-9)) if draw.random() * (a + b) < b else (-b, down <= b * (1 + 1e-9))
        alive = np.clip(alive + step * u, 0, 1)
        alive[hit] = np.round(alive[hit])
        alive[np.abs(alive - np.round(alive)) < 1e-12] = np.round(alive[np.abs(alive - np.round(alive)) < 1e-12])
        if first >= 64:  # what is decided leaves the matrices
            open_ = alive * (1 - alive) > 0
            open_[first:] = True
            p[at] = alive
            at, A, alive, first = at[open_], A[:, open_], alive[open_], 0
    p[at] = alive
    return p


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All open units rounded: the last LANDING of them so that the words come nearest to what was expected, then the documents; those before, if any, one by
    one to the nearer end."""
    p = p.copy()
    due, wanted = float(p @ size), float(p.sum())
    open_ = np.flatnonzero(p * (1 - p) > 0)
    p[open_[: max(0, len(open_) - LANDING)]] = np.round(p[open_[: max(0, len(open_) - LANDING)]])
    open_ = open_[-LANDING:]
    ways = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1).astype(float)
    settled = np.setdiff1d(np.arange(len(p)), open_)
    off = np.abs(ways @ size[open_] + float(p[settled] @ size[settled]) - due)
    docs = np.abs(ways.sum(axis=1) + float(p[settled].sum()) - wanted)
    p[open_] = ways[np.lexsort((docs, np.round(off, 6)))[0]]
    return p


def _flown(number: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows that are equal share a hash, and so a block, however many they are: such a block flies in parts.
        for block in blocks_of(batches, PART):
            block = block.combine_chunks()
            last = block.column("_blocks")[0].as_py() == 1
            size, p = (block.column(c).to_numpy().astype(float) for c in ("_size", "_p"))
            first = (block.column(c)[0].as_py() for c in ("_group", "_block", "_key", "_size"))
            p = flight(p, np.vstack([size, np.ones_like(size)]), _uniform(seed, number, *first), LANDING if last else 0)
            p = landing(p, size) if last else p
            yield pa.RecordBatch.from_arrays([*[block.column(c).chunk(0) for c in ROW], pa.array(p)], [*ROW, "_p"])

    return run


ROW = ["_group", "_key", "_size"]


def _beside(sources: DataFrame) -> DataFrame:
    """A table with a row a source, to be joined with all rows: broadcast if counted small."""
    sources = cut(sources)
    return F.broadcast(sources) if sources.count() <= BROADCAST_ROWS else sources


def sampled(units: DataFrame, seed: int = 0) -> DataFrame:
    """(_group, _key, _size, _p) with probabilities between 0 and 1 to the same rows with _p 0 or 1, balanced in each group by _size and by number."""
    spark = units.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = (F.col("_p") <= 0) | (F.col("_p") >= 1)
    units = cut(units.select(*ROW, "_p"))
    done, number = [units.filter(whole)], 0
    left = units.filter(~whole)
    while not left.isEmpty():
        counts = left.groupBy("_group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks"))
        dealt = left.join(_beside(counts), "_group").withColumn("_block", F.pmod(F.xxhash64("_key", "_size", F.lit(number)), F.col("_blocks")))
        dealt = dealt.repartition(parts, "_group", "_block").sortWithinPartitions("_group", "_block", F.desc("_size"), "_key")
        flown = cut(dealt.mapInArrow(_flown(number, seed), f"_group string, _key {units.schema['_key'].dataType.simpleString()}, _size long, _p double"))
        done.append(flown.filter(whole))
        left = flown.filter(~whole)
        number += 1
    return reduce(DataFrame.unionByName, done)


def mixed(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0) -> DataFrame:
    """(key, source, size, source_size, target, copies, taken) for every document: how many copies of it the mix takes, and how many words they are."""
    group = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("~"))  # null last, the others by code point
    units = cut(docs.select(group.alias("_group"), F.col(key).alias("_key"), words(text).alias("_size")))
    sizes = targets(units.groupBy("_group").agg(F.sum("_size").alias("_words")), weights, share, most)
    sizes = _beside(sizes.withColumn("_rate", F.coalesce(F.col("target") / F.nullif("_words", F.lit(0)), F.lit(0.0))))
    p = F.least(F.col("_rate"), F.lit(float(most)))
    whole = F.floor(p)
    drawn = sampled(units.join(sizes, "_group").select(*ROW, (p - whole).alias("_p")), seed)
    copies = (F.floor(F.least("_rate", F.lit(float(most)))) + F.col("_p")).cast("long")
    return drawn.join(sizes, "_group").select(
        F.col("_key").alias(key), F.when(F.col("_group") != "~", F.substring("_group", 2, 2**31 - 1)).alias(source), F.col("_size").alias("size"),
        F.col("_words").alias("source_size"), "target", copies.alias("copies"), (copies * F.col("_size")).alias("taken"),
    )
