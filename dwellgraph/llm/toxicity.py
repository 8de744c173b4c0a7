"""Toxicity: logistic regression learned by FTRL-proximal over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one or two words between, hashed to 2^BITS places. Each coordinate has its own rate, and L1
keeps most weights at exactly zero, so the model is a short list of places and weights that is broadcast. Training passes over a bounded sample
of labelled rows in hash order, in one task; scoring goes over every text.

Defined cases: a null or empty text has no features, its score is that of the bias; rows labelled twice count once, as toxic if any label is; null
labels are no labels; without training rows every score is 0.5; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import U64, ngram_hashes, slices, texts_of, word_hashes

BITS = 20
SAMPLE = 10_000  # labelled rows that are learned from: the first by a hash of their id
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.1


def features(texts: list[str], bits: int = BITS) -> list[np.ndarray]:
    """Distinct hashed places of each text."""
    words, bounds = word_hashes(texts, words="alnum", lower="all")
    out = []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        own = words[a:b]
        grams = np.concatenate([ngram_hashes(own, 1), *(ngram_hashes(own, 2, gap) for gap in (1, 2, 3))])
        out.append(np.unique(grams >> U64(64 - bits)).astype(np.int32))
    return out


@dataclass
class Model:
    places: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str], bits: int = BITS) -> np.ndarray:
        table = self.__dict__.get("_table")
        if table is None:
            table = np.zeros(1 << bits)
            table[self.places] = self.weights
            self.__dict__["_table"] = table
        sums = np.array([table[f].sum() for f in features(texts, bits)]) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(sums, -35, 35)))


def ftrl(rows: list[np.ndarray], labels: list[int], bits: int = BITS, epochs: int = EPOCHS) -> Model:
    """Weights after `epochs` passes in the given order. The bias is a coordinate without L1."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    l1 = np.full(size + 1, L1)
    l1[size] = 0.0

    def weights(at):
        zs = z[at]
        return np.where(np.abs(zs) <= l1[at], 0.0, -(zs - np.sign(zs) * l1[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rows = [np.append(r, size) for r in rows]
    for _ in range(epochs):
        for at, y in zip(rows, labels):
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    all_weights = weights(np.arange(size + 1))
    places = np.flatnonzero(all_weights[:size])
    return Model(places.astype(np.int32), all_weights[places], float(all_weights[size]))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from the labelled rows as given: hold rows out before. At most `sample` of them are used."""
    labelled = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("y")).dropna()
    # About twice as many labels as needed go on to the sort: those with the smallest hashes, by a share from their count.
    share = (F.col("h").cast("double") + 2.0**63) / 2.0**64
    few = labelled.withColumn("h", F.xxhash64("key")).filter(share * labelled.count() < 2 * sample + 100)
    chosen = few.groupBy("key", "h").agg(F.max("y").alias("y")).orderBy("h", "key").limit(sample)
    # F.broadcast: at most `sample` rows of three numbers.
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text")).join(F.broadcast(chosen), "key").select("h", "y", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("y"), pa.array(features(texts_of(part, "text")), pa.list_(pa.int32()))], ["h", "y", "f"])

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(frames)
        if got and sum(map(len, got)):
            data = pd.concat(got)
            data = data.assign(size=[len(f) for f in data["f"]]).sort_values(["h", "size"])
            model = ftrl(data["f"].tolist(), data["y"].tolist())
            yield pd.DataFrame({"places": [model.places], "weights": [model.weights], "bias": [model.bias]})

    hashed = rows.mapInArrow(extract, "h long, y int, f array<int>").repartition(1)  # bounded by `sample`
    got = hashed.mapInPandas(fit, "places array<int>, weights array<double>, bias double").collect()
    if not got:
        return Model(np.zeros(0, np.int32), np.zeros(0), 0.0)
    return Model(np.array(got[0]["places"], dtype=np.int32), np.array(got[0]["weights"]), got[0]["bias"])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2^BITS weights, in practice some thousand
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = dict(rows.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(shared.value.scores(texts_of(part, "text")))], ["key", "score"])

    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)
