"""Near-duplicate groups by fast similarity sketches, banding and exact verification.

A sketch has SIZE coordinates. In the first SIZE rounds every shingle is thrown into a bin by a hash of the round, in the next SIZE rounds all
shingles go to bin (round - SIZE), so every coordinate is filled; a bin keeps the smallest value, and a value of an earlier round is smaller than any of a
later one. The rounds end as soon as all bins are full: one or two for long texts, more for short ones. Matching coordinates estimate the Jaccard
similarity with concentration bounds. Coordinates are banded ROWS at a time: a pair at similarity 0.85 shares no band with probability
(1 - 0.85^6)^40 < 1e-8.

Documents with the same shingle set form a class, found by a digest of the set; only classes go on. Classes that share a band are candidates of each
other; connected candidates form a cluster. Within a cluster all pairs whose sizes allow the similarity are checked on their full sets: a small cluster
in one task, a larger one as pairs of blocks of bounded size, in as many tasks. A task counts intersections by matrix products over the shingles that
several members have and returns a spanning forest of the links it finds, never the pairs.

Defined cases: a null text, or one without words, has an empty set and is linked with nothing; fewer words than a shingle make one shingle; rows of
one id with different texts are grouped by their own texts (and joined if that id is the smallest of both groups); repeated rows share their result; a
row with a null id is linked with nothing, has a null component and is kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .batches import U64, mix, ngram_hashes, seeds, slices, texts_of, word_hashes
from .components import components

WORDS = 5
SIZE = 240
ROWS = 6
BANDS = SIZE // ROWS
LEAST_PERCENT = 85  # a link: 100 * intersection >= 85 * union
BLOCK_SHINGLES = 150_000  # of all members of a block
BLOCK_MEMBERS = 2_000  # a task's matrices have a row or column for each member
_SEEDS = seeds(SIZE, 1)
_BAND_SEEDS = seeds(BANDS, 2)


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, bounds = word_hashes(texts)
    ends = bounds.tolist()
    out = []
    for a, b in zip(ends, ends[1:]):
        own = hashes[a:b]
        out.append(np.unique(ngram_hashes(own, words) if b - a >= words else ngram_hashes(own, b - a) if b > a else own))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """SIZE coordinates of each set, none of which may be empty."""
    out = np.full((len(sets), SIZE), np.iinfo(np.uint64).max, dtype=U64)
    flat = out.reshape(-1)
    lengths = np.array([len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.zeros(0, U64)
    owner = np.repeat(np.arange(len(sets)), lengths)
    for turn in range(2 * SIZE):
        value = mix(items ^ _SEEDS[turn % SIZE])
        if turn < SIZE:
            place = ((value >> U64(32)) * U64(SIZE) >> U64(32)).astype(np.int64)
            value = mix(value)
        else:
            place = np.full(len(items), turn - SIZE)
        # The round is in the top bits, so that earlier rounds win.
        np.minimum.at(flat, owner * SIZE + place, (value >> U64(9)) | (U64(turn) << U64(55)))
        missing = (out == np.iinfo(np.uint64).max).any(axis=1)
        if not missing.any():
            break
        stay = missing[owner]
        items, owner = items[stay], owner[stay]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One hash for each band of each sketch."""
    keys = np.broadcast_to(_BAND_SEEDS, (len(sketch), BANDS)).copy()
    parts = sketch.reshape(len(sketch), BANDS, ROWS)
    for k in range(ROWS):
        keys = mix(keys * U64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys


def digest(items: np.ndarray) -> bytes:
    """16 bytes that stand for a set."""
    with np.errstate(over="ignore"):
        return np.array([mix(items ^ U64(s)).sum(dtype=U64) for s in (0x2545F4914F6CDD1D, 0x8CB92BA72F3D8DD7)], dtype=U64).tobytes()


def described(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, d, bands) of every row: set size, digest and band keys; the last two null for an empty set."""
    rows = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(texts_of(part, "text"))
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(sketches(full)).astype(np.int64) if full else ())
                columns = [
                    part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "d", "bands"])

    return rows.mapInArrow(run, "id long, n long, d binary, bands array<long>")


def links_between(left: list[np.ndarray], right: list[np.ndarray], percent: int = LEAST_PERCENT) -> np.ndarray:
    """[left, right]: whether two sorted sets reach the similarity."""
    sets = left + right
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1
    keep = counts[code] > 1
    owner, code = owner[keep], shared[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    width = max(256, (1 << 24) // (4 * len(sets)))  # columns at a time, for matrices of 16 MB
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, (low, low + width))
        has = np.zeros((len(sets), width), dtype=np.float32)
        has[owner[a:b], code[a:b] - low] = 1
        common += has[: len(left)] @ has[len(left) :].T
    both = sizes[: len(left), None] + sizes[None, len(left) :]
    return 100 * common >= percent * (both - common)


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """(node, smaller node) links that connect what a matrix of links connects."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*(a.tolist() for a in np.nonzero(linked))):
        a, b = find(int(left[i])), find(int(right[j]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((max(a, b), min(a, b)))
    return out


def dealt(members: DataFrame) -> DataFrame:
    """The members (cluster, node, set) once for each pair of blocks (cluster, b1, p1, b2, p2) they are compared in; second: as part of the second block."""
    n = F.size("set")
    members = members.withColumn("size", n).withColumn("band", F.floor(F.log(n) / -np.log(LEAST_PERCENT / 100)).cast("int"))
    weight = members.groupBy("cluster", "band").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("m"))
    count = F.greatest(F.ceil(F.col("w") / BLOCK_SHINGLES), F.ceil(F.col("m") / BLOCK_MEMBERS)).cast("int")
    large = weight.groupBy("cluster").agg(F.sum("w").alias("total"), F.sum("m").alias("count"), F.map_from_entries(F.collect_list(F.struct(F.col("band"), count.alias("n")))).alias("parts"))
    # parts: an entry for each size band of a cluster, and there are at most 43 bands for each factor of a thousand in size.
    placed = members.join(large, "cluster")
    own = F.pmod(F.xxhash64("node", "size"), F.col("parts")[F.col("band")]).cast("int")
    placed = placed.withColumn("own", F.when((F.col("total") <= BLOCK_SHINGLES) & (F.col("count") <= BLOCK_MEMBERS), F.lit(-1)).otherwise(own))

    def blocks(band, lower: bool):
        """Keys of the block pairs with a band: own block first or second."""
        count = F.coalesce(F.col("parts")[band], F.lit(0))
        parts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        mine, theirs = (F.col("band"), F.col("own")), band
        if lower:
            return F.transform(parts, lambda p: F.struct(theirs.alias("b1"), p.alias("p1"), mine[0].alias("b2"), mine[1].alias("p2"), F.lit(True).alias("second")))
        return F.transform(parts, lambda p: F.struct(mine[0].alias("b1"), mine[1].alias("p1"), theirs.alias("b2"), p.alias("p2"), F.lit(False).alias("second")))

    band = F.col("band")
    same = F.transform(
        F.sequence(F.lit(0), F.col("parts")[band] - 1),
        lambda p: F.struct(band.alias("b1"), F.least(p, F.col("own")).alias("p1"), band.alias("b2"), F.greatest(p, F.col("own")).alias("p2"), (p < F.col("own")).alias("second")),
    )
    alone = F.array(F.struct(F.lit(-1).alias("b1"), F.lit(-1).alias("p1"), F.lit(-1).alias("b2"), F.lit(-1).alias("p2"), F.lit(False).alias("second")))
    pairs = F.when(F.col("own") < 0, alone).otherwise(F.concat(same, blocks(band + 1, False), blocks(band - 1, True)))
    return placed.select("cluster", "node", "set", F.explode(pairs).alias("pair")).select("cluster", "pair.b1", "pair.p1", "pair.b2", "pair.p2", "pair.second", "node", "set")


def verified(members: DataFrame) -> DataFrame:
    """(a, b): links that connect the members (cluster, node, set) of each cluster as all their links do."""

    def check(frame: pd.DataFrame) -> pd.DataFrame:
        sets = [np.asarray(s, dtype=np.int64).view(U64) for s in frame["set"]]
        nodes, second = frame["node"].to_numpy(), frame["second"].to_numpy()
        left, right = np.flatnonzero(~second), np.flatnonzero(second)
        if not len(right):
            if (frame["b1"].iloc[0], frame["p1"].iloc[0]) != (frame["b2"].iloc[0], frame["p2"].iloc[0]):
                return pd.DataFrame({"a": [], "b": []}, dtype="int64")  # the other block is empty
            right = left
        if not len(left):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        linked = links_between([sets[k] for k in left], [sets[k] for k in right])
        return pd.DataFrame(forest(linked, nodes[left], nodes[right]), columns=["a", "b"], dtype="int64")

    return dealt(members).groupBy("cluster", "b1", "p1", "b2", "p2").applyInPandas(check, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row: the smallest id of its group, and whether it is that document."""
    rows = cut(described(docs, key, text))
    classes = rows.filter("d is not null and id is not null").groupBy("d").agg(F.min("id").alias("node"), F.first("bands").alias("bands"))
    classes = cut(classes)
    keyed = classes.select("node", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader < last").select("band", "leader")
    near = cut(keyed.join(shared, "band").filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct())
    clusters = components(near)
    # Only documents with a candidate are read again for their full sets.
    texts = docs.select(docs[key].cast("long").alias("node"), docs[text].alias("text")).join(clusters.withColumnRenamed("component", "cluster"), "node")

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(texts_of(part, "text"))
                full = pa.array([len(s) > 0 for s in sets])
                out = pa.RecordBatch.from_arrays([part.column("cluster"), part.column("node"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["cluster", "node", "set"])
                yield out.filter(full)

    members = cut(texts.mapInArrow(full_sets, "cluster long, node long, set array<long>"))
    found = components(cut(verified(members)))
    named = classes.select("d", "node").join(found, "node", "left").select("d", F.coalesce("component", "node").alias("component"))
    named = rows.select("id", "n", "d").join(named, "d", "left")
    return named.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )
