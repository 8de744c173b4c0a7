"""Benchmark decontamination: word n-grams of the items as seeds, then Smith-Waterman alignment of passages with test items.

One pass over the documents looks for the items' n-grams in a bitmap of fixed size (broadcast: FILTER_BITS bits, whatever the benchmark's size) and
keeps the passages around two or more of them, as word hashes. The passages are joined with the items on the exact seeds, and every pair that shares two
distinct seeds is aligned (match 2, mismatch -1, gap -1), however many documents hold them: an edited or partial leak keeps its pair in one document as in
many. Only pairs with too few words in common to reach the score, whatever their order, are spared the alignment;
the score is that of the best local alignment over that of the whole item with itself.

Defined cases: null or empty texts have no seeds; an item of fewer than LEAST_WORDS words is too short to show a leak and is never found; items or
documents that occur twice are found twice with the same score, rows of one id with the best of their passages; an empty benchmark finds nothing; a
null id stays null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .batches import U64, ngram_hashes, slices, texts_of, word_hashes

SEED_WORDS = 3
LEAST_WORDS = 8
LEAST_SEEDS = 2
LEAST_SCORE = 0.5
FILTER_BITS = 24
MATCH, MISMATCH, GAP = 2.0, -1.0, 1.0
PASSAGE = "id long, start int, words array<long>, seeds array<long>"


def align(passage: np.ndarray, item: np.ndarray) -> float:
    """Score of the best local alignment of two word sequences, over that of the item with itself."""
    places = np.arange(len(passage) + 1) * GAP
    row, best = np.zeros(len(passage) + 1), 0.0
    for word in item:
        new = np.zeros(len(passage) + 1)
        new[1:] = np.maximum(row[:-1] + np.where(passage == word, MATCH, MISMATCH), row[1:] - GAP)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + places) - places  # gaps along the passage
        best = max(best, float(row.max()))
    return best / (MATCH * len(item))


def may_reach(passage: np.ndarray, item: np.ndarray, least_score: float) -> bool:
    """False if the two have too few words in common, repeated ones counted, for an alignment of that score."""
    words, needed = np.unique(item, return_counts=True)
    at = np.searchsorted(words, passage)
    at[at == len(words)] = 0
    held = np.bincount(at[words[at] == passage], minlength=len(words))
    return int(np.minimum(held, needed).sum()) / len(item) >= least_score


def items_of(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words) of the items that are long enough."""
    rows = benchmark.select(benchmark[key].cast("long").alias("item"), benchmark[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, bounds = word_hashes(texts_of(part, "text"), words="alnum", lower="all")
                out = pa.RecordBatch.from_arrays([part.column("item"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(words.view(np.int64)))], ["item", "words"])
                yield out.filter(pa.array(np.diff(bounds) >= LEAST_WORDS))

    return rows.mapInArrow(run, "item long, words array<long>")


def seeds_of(items: DataFrame) -> DataFrame:
    """(item, seed): the distinct n-grams of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [np.unique(ngram_hashes(np.asarray(w, dtype=np.int64).view(U64), SEED_WORDS)) for w in batch.column("words").to_pylist()]
            owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
            flat = np.concatenate(grams) if grams else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(owner)), pa.array(flat.view(np.int64))], ["item", "seed"])

    return items.mapInArrow(run, "item long, seed long")


def bitmap(seeds: DataFrame) -> np.ndarray:
    """2^FILTER_BITS bits with those of the seeds set: at most that many bits come to the driver, packed in longs."""
    place = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    words = seeds.select(F.shiftrightunsigned(place, 5).cast("int").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(31)).cast("int")).alias("mask"))
    rows = words.groupBy("at").agg(F.bit_or("mask").alias("mask")).toPandas()
    table = np.zeros(1 << (FILTER_BITS - 5), dtype=np.uint32)
    table[rows["at"].to_numpy(dtype=np.int64)] = rows["mask"].to_numpy(dtype=np.int64).astype(np.uint32)
    return table


def passages(docs: DataFrame, table: np.ndarray, reach: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """PASSAGE rows: runs of words with at least LEAST_SEEDS possible seeds no more than `reach` words apart, and `reach` words on both sides."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    rows = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                words, bounds = word_hashes(texts_of(part, "text"), words="alnum", lower="all")
                ids = part.column("id").to_pylist()
                grams = ngram_hashes(words, SEED_WORDS)  # those across two texts are sorted out below
                place = (grams >> U64(64 - FILTER_BITS)).astype(np.int64)
                hit = np.flatnonzero((bits[place >> 5] >> (place & 31).astype(np.uint32)) & 1)
                owner = np.searchsorted(bounds, hit, side="right") - 1
                inside = hit + SEED_WORDS <= bounds[owner + 1]
                hit, owner = hit[inside], owner[inside]
                if not len(hit):
                    continue
                new = np.flatnonzero((np.diff(hit, prepend=-(10**12)) > reach) | (np.diff(owner, prepend=-1) != 0))
                out: list[tuple] = []
                for a, b in zip(new.tolist(), [*new[1:].tolist(), len(hit)]):
                    seeds = np.unique(grams[hit[a:b]])
                    if len(seeds) < LEAST_SEEDS:
                        continue
                    low = max(int(bounds[owner[a]]), int(hit[a]) - reach)
                    high = min(int(bounds[owner[a] + 1]), int(hit[b - 1]) + SEED_WORDS + reach)
                    out.append((ids[owner[a]], low - int(bounds[owner[a]]), words[low:high].view(np.int64), seeds.view(np.int64)))
                if out:
                    columns = list(zip(*out))
                    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "start", "words", "seeds"])

    return rows.mapInArrow(run, PASSAGE)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
                 least_score: float = LEAST_SCORE) -> DataFrame:
    """(key, item_key, score, start, n_words): the documents that hold a test item, with the best passage's first word and length in words."""
    items = cut(items_of(benchmark, item_key, item_text))
    seeds = cut(seeds_of(items))
    reach = items.agg(F.max(F.size("words"))).first()[0] or 0
    found = cut(passages(docs, bitmap(seeds), reach, key, text).withColumn("passage", F.xxhash64("id", "start", "words")))

    hits = found.select("id", "passage", F.explode("seeds").alias("seed")).join(seeds.select("seed").distinct(), "seed")  # exact, after the bitmap
    pairs = hits.join(seeds, "seed").groupBy("passage", "item").agg(F.count_distinct("seed").alias("n")).filter(F.col("n") >= LEAST_SEEDS)
    ready = pairs.select("passage", "item").join(items.withColumnRenamed("words", "wanted"), "item").join(found.drop("seeds"), "passage").select("id", "item", "start", "words", "wanted")

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            both = [(np.asarray(p, np.int64), np.asarray(w, np.int64)) for p, w in zip(frame["words"], frame["wanted"])]
            yield pd.DataFrame({
                "id": frame["id"].astype("Int64"), "item": frame["item"].astype("Int64"), "start": frame["start"], "n_words": [len(p) for p, _ in both],
                "score": [align(p, w) if may_reach(p, w, least_score) else -1.0 for p, w in both],
            })

    scored = ready.mapInPandas(score, "id long, item long, start int, n_words int, score double").filter(F.col("score") >= least_score)
    best = scored.groupBy("id", "item").agg(F.max(F.struct("score", -F.col("start"), "n_words")).alias("b"))
    return best.select(F.col("id").alias(key), F.col("item").alias(item_key), F.col("b.score").alias("score"), (-F.col("b.col2")).alias("start"), F.col("b.n_words").alias("n_words"))
