"""I-Match fingerprints: terms of a middle document-frequency band, hashed over randomised lexicon subsets.

The lexicon holds the terms (folded words) that are in at least LOW and at most HIGH of all documents. As a document has T distinct terms in the mean, at
most T / LOW terms can be that frequent; LOW is raised where that bound would exceed MAX_LEXICON, so the lexicon's size has a bound whatever the corpus
holds, and it can be broadcast. A document's distinct lexicon terms, sorted, are hashed once for each of SUBSETS random subsets of the
lexicon. Subsets come in scales: at scale s a term belongs to a subset with probability 2^-s. A document with m lexicon terms uses SCALES_USED
scales, from that at which a subset holds between half a term and one, so that an edit leaves the hashes of the other subsets alone however long the
text is, and texts whose numbers of terms differ up to eightfold still have a scale in common.
Texts of a large group of copies have nearly all their terms above the band, whose upper edge the group itself exceeds. A text with less than FEW of its
distinct terms in the lexicon therefore takes those of a second band, from HIGH to UPPER, along; of those there are at most T / HIGH, and they are
broadcast too.
Empty subsets are not written. The likeness of two fingerprints is, over the scales that both have, the share of subsets with equal hashes among those
that are not empty in either; it estimates the overlap of their lexicon terms.

Defined cases: a text without lexicon terms has one hash over all its terms (over none, if it has none), alike only to the same; null is an empty text;
equal texts have equal fingerprints; a null id sorts below all others; rows of one id are ordered by text; the next document of the only one is
itself; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut
from .batches import U64, mix, seeds, slices, texts_of, word_hashes

LOW, HIGH, UPPER = 0.0005, 0.1, 0.5
FEW = 0.1
MAX_LEXICON = 1 << 20
SUBSETS = 64
SCALES = 30
SCALES_USED = 4
NULL_ID = -(2**63)
_SEEDS = seeds(SCALES, 5)
COUNTED_AT_ONCE = 1 << 20

Fingerprint = dict[tuple[int, int], int]  # (scale, subset) -> hash; scale -1: of a text without lexicon terms


def distinct_terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct term hashes of each text, one text after the other, and the text each belongs to."""
    words, bounds = word_hashes(texts, words="alnum", lower="all")
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    order = np.lexsort((words, owner))
    words, owner = words[order], owner[order]
    new = np.ones(len(words), dtype=bool)
    new[1:] = (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])
    return words[new], owner[new]


class Lexicon(NamedTuple):
    """Sorted hashes of the terms in the band, and of those in the second band above it."""

    band: np.ndarray
    above: np.ndarray


def _member(terms: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(terms), dtype=bool)
    at = np.searchsorted(listed, terms)
    at[at == len(listed)] = 0
    return listed[at] == terms


def lexicon(docs: DataFrame, text: str = "text") -> Lexicon:
    """The terms in the two bands, from counts over all documents."""
    rows = docs.select(docs[text].alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            terms, at = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
            return terms, np.bincount(at, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        n_docs = 0
        for batch in batches:
            n_docs += batch.num_rows
            for part in slices(batch, "text"):
                held.append(np.unique(distinct_terms(texts_of(part, "text"))[0], return_counts=True))
            if sum(len(t) for t, _ in held) > COUNTED_AT_ONCE:
                held = [summed()]
                if len(held[0][0]) > COUNTED_AT_ONCE // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], ["term", "df"])
                    held = []
        if held:
            terms, df = summed()
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(df)], ["term", "df"])

    counted = rows.mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    n = docs.count()
    frequent = cut(counted.filter((F.col("df") >= LOW * n) & (F.col("df") <= UPPER * n)).withColumn("above", F.col("df") > HIGH * n))
    total = frequent.filter("not above").agg(F.sum("df")).first()[0] or 0
    kept = frequent.filter(F.col("above") | (F.col("df") >= total / MAX_LEXICON)).select("term", "above").toPandas()  # at most MAX_LEXICON and T / HIGH
    terms, above = kept["term"].to_numpy(dtype=np.int64).view(U64), kept["above"].to_numpy(dtype=bool)
    return Lexicon(np.sort(terms[~above]), np.sort(terms[above]))


def fingerprints(texts: list[str], lexicon: Lexicon) -> list[Fingerprint]:
    terms, owner = distinct_terms(texts)
    out: list[Fingerprint] = [{} for _ in texts]
    known = _member(terms, lexicon.band)
    few = np.bincount(owner[known], minlength=len(texts)) < FEW * np.bincount(owner, minlength=len(texts))
    known |= few[owner] & _member(terms, lexicon.above)
    sizes = np.bincount(owner[known], minlength=len(texts))
    for k in np.flatnonzero(sizes == 0).tolist():
        a, b = np.searchsorted(owner, (k, k + 1))
        with np.errstate(over="ignore"):
            out[k][-1, 0] = int(mix(mix(terms[a:b]).sum(dtype=U64) + U64(b - a)))
    terms, owner = terms[known], owner[known]
    scale = (np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64) + 1)[owner]  # a subset holds between a half and one term
    mask = np.full(len(terms), np.iinfo(np.uint64).max, dtype=U64)
    for s in range(1, min(SCALES, int(scale.max(initial=0)) + SCALES_USED - 1) + 1):
        live = scale + SCALES_USED > s
        mask[live] &= mix(terms[live] ^ _SEEDS[s - 1])
        chosen = np.flatnonzero((scale <= s) & live & (mask != 0))
        if not len(chosen):
            continue
        bits = np.unpackbits(mask[chosen].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, subset = np.nonzero(bits)
        group = owner[chosen][row] * SUBSETS + subset
        order = np.argsort(group, kind="stable")
        group, values = group[order], mix(terms[chosen][row] + U64(s))[order]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        hashes = mix(np.add.reduceat(values, first)) >> U64(40)
        for g, h in zip(group[first].tolist(), hashes.tolist()):
            out[g // SUBSETS][s, g % SUBSETS] = h
    # The scales are kept even where all their subsets are empty, so that likeness knows them.
    for k in np.flatnonzero(sizes > 0).tolist():
        own = int(np.floor(np.log2(sizes[k]))) + 1
        for s in range(own, own + SCALES_USED):
            out[k][s, SUBSETS] = 0
    return out


def written(print_: Fingerprint) -> str:
    return ".".join(f"{s}-{j:x}-{h:x}" for (s, j), h in sorted(print_.items()))


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """0 to 1. Equal fingerprints are alike by 1."""
    if a == b:
        return 1.0
    scales = {s for s, j in a if j == SUBSETS} & {s for s, j in b if j == SUBSETS}
    left = {k: h for k, h in a.items() if k[0] in scales and k[1] < SUBSETS}
    right = {k: h for k, h in b.items() if k[0] in scales and k[1] < SUBSETS}
    either = len(left.keys() | right.keys())
    return sum(right.get(k) == h for k, h in left.items()) / either if either else 0.0


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(bucket, key, text, ahead), dealt by bucket and sorted by descending key: each bucket ends with a row (ahead) that repeats the first document of the
    next bucket, or the very first one. Buckets are ranges of keys between quantiles, one small row each."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(docs[key].cast("long"), F.lit(NULL_ID)).alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select("key")
    edges = sorted(set(ids.agg(F.percentile_approx("key", [k / n for k in range(1, n)], 10_000)).first()[0] or []))
    # edges: two numbers for each shuffle partition.
    bucket = F.size(F.filter(F.array(*[F.lit(e) for e in edges]).cast("array<long>"), lambda e: e >= F.col("key")))  # 0 holds the largest keys
    placed = rows.withColumn("bucket", bucket)
    heads = placed.select("bucket", "key").groupBy("bucket").agg(F.max("key").alias("key"))
    order = Window.orderBy("bucket")  # a row for each bucket
    everything = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = heads.select("key", F.coalesce(F.lag("bucket").over(order), F.last("bucket").over(everything)).alias("to"))
    texts = rows.join(F.broadcast(before), "key").groupBy("to", "key").agg(F.min("text").alias("text"))  # the first row of a repeated key
    ahead = texts.select(F.col("to").alias("bucket"), "key", "text", F.lit(True).alias("ahead"))
    both = placed.select("bucket", "key", "text", F.lit(False).alias("ahead")).unionByName(ahead)
    return both.repartition(n, "bucket").sortWithinPartitions("bucket", "ahead", F.desc("key"), "text")


def compared(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all documents and of their edited texts: the last third replaced by the beginning of the next document in descending key order."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # its two parts are bounded
    schema = f"`{key}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        waiting: tuple | None = None  # the row whose next one has not come yet: bucket, key, text, ahead
        for batch in batches:
            for part in slices(batch, "text"):
                rows = list(zip(part.column("bucket").to_pylist(), part.column("key").to_pylist(), part.column("text").to_pylist(), part.column("ahead").to_pylist()))
                if waiting is not None:
                    rows.insert(0, waiting)
                waiting = rows[-1]
                own = [(a, b) for a, b in zip(rows, rows[1:]) if not a[3] and a[0] == b[0]]
                if not own:
                    continue
                edited = [a[2][: len(a[2]) - len(a[2]) // 3] + b[2][: len(a[2]) // 3] for a, b in own]
                prints = fingerprints([r[2] for r in rows], terms)
                changed = fingerprints(edited, terms)
                place = [k for k, (a, b) in enumerate(zip(rows, rows[1:])) if not a[3] and a[0] == b[0]]
                columns = [
                    pa.array([None if a[1] == NULL_ID else a[1] for a, _ in own], pa.int64()), pa.array([len(a[2]) for a, _ in own], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]), pa.array([written(prints[k]) for k in place]),
                    pa.array([written(c) for c in changed]), pa.array([likeness(prints[k], c) for k, c in zip(place, changed)], pa.float64()),
                    pa.array([likeness(prints[k], prints[k + 1]) for k in place], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs, key, text).mapInArrow(run, schema)
