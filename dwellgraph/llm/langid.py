"""Language identification by unigram pieces whose segmentations are summed out.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum over all its segmentations into
pieces, by a forward pass over its characters; that of a text is the product over its words, and the score is the posterior of the best language
under equal priors. Probabilities come from expectation maximisation (forward and backward) on word counts of a bounded labelled sample.

Words are runs of letters, folded, with the vocabulary's word mark in front; a character in no piece is a piece of its own with a floor probability.

Defined cases: null text or text without a letter is UNDETERMINED with score 0; a training row needs a language and a letter; without any training row
every text is UNDETERMINED; ties go to the language that sorts first; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .batches import U64, mix, resident, slices, texts_of

UNDETERMINED = "und"
MARK = "▁"
WORD = re.compile(r"[^\W\d_]+")
SAMPLE_PER_LANGUAGE = 400  # labelled documents of a language that are learned from, the first by a hash of their id
LONGEST_PIECE = 8
LONGEST_WORD = 64  # longer runs are scored in parts of this length
ROUNDS = 4
FLOOR = 1e-7
CACHED_WORDS = 120_000


def _code(chars: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix(start * U64(0x9E3779B97F4A7C15) + chars)


def pieces_of(path: str) -> np.ndarray:
    """Sorted hashes of the vocabulary's letter pieces. path: a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).lower()
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and len(piece) <= LONGEST_PIECE and (piece[:1] == MARK or piece.isalpha()) and (len(piece) == 1 or piece[1:].isalpha()):
            kept.add(piece)
    out = np.zeros(len(kept), dtype=U64)
    for k, piece in enumerate(sorted(kept)):
        code = np.zeros(1, dtype=U64)
        for c in piece:
            code = _code(np.array([ord(c)], dtype=U64), code)
        out[k] = code[0]
    return np.sort(out)


def lattice(words: list[str], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece numbers [word, end, length - 1] (-1: none, len(vocabulary): a single unknown character) and word lengths, the mark included."""
    marked = [MARK + w for w in words]
    sizes = np.array([len(w) for w in marked])
    width = int(sizes.max())
    chars = np.zeros((len(words), width), dtype=U64)
    chars[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    found = np.full((len(words), width, LONGEST_PIECE), -1, dtype=np.int32)
    code = np.zeros((len(words), width), dtype=U64)  # of the piece that begins at each place
    for length in range(1, min(LONGEST_PIECE, width) + 1):
        n = width - length + 1
        code = _code(chars[:, length - 1 :], code[:, :n])
        at = np.searchsorted(vocabulary, code)
        at[at == len(vocabulary)] = 0
        hit = vocabulary[at] == code
        if length == 1:
            found[:, :, 0] = np.where(hit, at, len(vocabulary))
        else:
            found[:, length - 1 :, length - 1] = np.where(hit, at, -1)
    return found, sizes


def forward(found: np.ndarray, probabilities: np.ndarray) -> np.ndarray:
    """alpha[word, place, language]: the mass of all segmentations of the first `place` characters, each scaled step by step."""
    n, width, _ = found.shape
    alpha = np.zeros((n, width + 1, probabilities.shape[1]))
    alpha[:, 0] = 1.0
    for end in range(width):
        total = np.zeros((n, probabilities.shape[1]))
        for length in range(1, min(LONGEST_PIECE, end + 1) + 1):
            piece = found[:, end, length - 1]
            rows = np.flatnonzero(piece >= 0)
            total[rows] += alpha[rows, end + 1 - length] * probabilities[piece[rows]]
        alpha[:, end + 1] = total
    return alpha


def buckets(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Words of similar length together, a bounded number at a time, with their places."""
    sizes = np.array([len(w) for w in words])
    for low in (1, 4, 7, 11, 16, 25, 40):
        high = {1: 3, 4: 6, 7: 10, 11: 15, 16: 24, 25: 39, 40: LONGEST_WORD}[low]
        inside = np.flatnonzero((sizes >= low) & (sizes <= high))
        for a in range(0, len(inside), 4096):
            part = inside[a : a + 4096]
            yield part, [words[k] for k in part]


def words_of(text: str) -> list[str]:
    out = []
    for w in WORD.findall(text.lower()):
        if not w.isalpha():  # number characters other than digits are no letters
            out.extend(words_of("".join(c if c.isalpha() else " " for c in w)))
        elif len(w) <= LONGEST_WORD:
            out.append(w)
        else:
            out.extend(w[a : a + LONGEST_WORD] for a in range(0, len(w), LONGEST_WORD))
    return out


def learn(words: list[str], counts: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Piece probabilities of one language (the last entry: an unknown character) from its word counts."""
    p = np.full((len(vocabulary) + 1, 1), 1.0 / (len(vocabulary) + 1))
    lattices = [(counts[at], *lattice(part, vocabulary)) for at, part in buckets(words)]
    for _ in range(ROUNDS):
        expected = np.full(len(vocabulary) + 1, 0.01)
        for weight, found, sizes in lattices:
            n, width, _ = found.shape
            alpha = forward(found, p)[:, :, 0]
            beta = np.zeros((n, width + 1))
            beta[np.arange(n), sizes] = 1.0
            whole = alpha[np.arange(n), sizes]
            for end in range(width - 1, -1, -1):
                for length in range(1, min(LONGEST_PIECE, end + 1) + 1):
                    piece = found[:, end, length - 1]
                    rows = np.flatnonzero((piece >= 0) & (beta[:, end + 1] > 0))
                    mass = p[piece[rows], 0] * beta[rows, end + 1]
                    share = alpha[rows, end + 1 - length] * mass / whole[rows] * weight[rows]
                    expected += np.bincount(piece[rows], weights=share, minlength=len(expected))
                    beta[rows, end + 1 - length] += mass
        p = np.maximum(expected / expected.sum(), FLOOR)[:, None]
    return p[:, 0]


class Cache:
    """Scores of words seen lately: rows of a table, by word."""

    def __init__(self, languages: int):
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, languages))


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray
    probabilities: np.ndarray  # [piece, language]

    mark: str = field(default_factory=lambda: uuid.uuid4().hex)  # of this model in a worker's cache

    def word_scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        for at, part in buckets(words):
            found, sizes = lattice(part, self.vocabulary)
            alpha = forward(found, self.probabilities)
            out[at] = np.log(np.maximum(alpha[np.arange(len(part)), sizes], 1e-300))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The best language of each text and its posterior."""
        found = [words_of(t) for t in texts]
        cache = resident(("langid", self.mark), lambda: Cache(len(self.languages)))
        if len(cache.known) > CACHED_WORDS:
            cache.__init__(len(self.languages))
        fresh = list({w for ws in found for w in ws if w not in cache.known})
        if fresh:
            cache.scores = np.concatenate([cache.scores, self.word_scores(fresh)])
            cache.known.update(zip(fresh, range(len(cache.known), len(cache.known) + len(fresh))))
        names, posteriors = [], np.zeros(len(texts))
        get = cache.known.__getitem__
        for k, ws in enumerate(found):
            if not ws or not self.languages:
                names.append(UNDETERMINED)
                continue
            total = cache.scores[np.fromiter(map(get, ws), np.int64, len(ws))].sum(axis=0)
            best = int(total.argmax())
            names.append(self.languages[best])
            posteriors[k] = 1.0 / np.exp(total - total[best]).sum()
        return names, posteriors


def train(labelled: DataFrame, path: str, lang: str = "lang", key: str = "doc_id", text: str = "text", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learn from rows (key, text, lang) as given: hold rows out before. At most per_language documents of each language are used, whole."""
    spark = labelled.sparkSession
    rows = labelled.select(labelled[lang].cast("string").alias("lang"), labelled[text].alias("text"), F.xxhash64(labelled[key]).alias("h"))
    rows = rows.filter("lang is not null and text is not null")
    # Only about twice as many rows as needed go on to the ranking: those with the smallest hashes, by a share from the counts.
    sizes = labelled.filter(labelled[lang].isNotNull()).groupBy(labelled[lang].cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("total"))
    share = (F.col("h").cast("double") + 2.0**63) / 2.0**64
    rows = rows.join(F.broadcast(sizes), "lang").filter(share * F.col("total") < 2 * per_language + 50)  # broadcast: a row a language
    order = Window.partitionBy("lang").orderBy("h", "text")
    sample = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = pd.DataFrame({"lang": batch.column("lang").to_pylist(), "word": [words_of(t) for t in texts_of(batch, "text")]})
            counted = frame.explode("word").dropna().value_counts(["lang", "word"]).reset_index(name="n")
            yield pa.RecordBatch.from_pandas(counted.astype({"lang": str, "word": str, "n": "int64"}), preserve_index=False)

    counted = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("word")
        p = learn(frame["word"].tolist(), frame["n"].to_numpy(dtype=float), pieces_of(path))
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "p": [p]})

    # One row of vocabulary size for each language, from at most per_language documents of it.
    fitted = sorted(counted.groupBy("lang").applyInPandas(fit, "lang string, p array<double>").collect())
    vocabulary = pieces_of(path)
    table = np.array([r["p"] for r in fitted]).T if fitted else np.zeros((len(vocabulary) + 1, 0))
    return Model([r["lang"] for r in fitted], vocabulary, table)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(key, the columns in keep, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages numbers
    keep = keep or []
    rows = docs.select(docs[key].alias("_key"), docs[text].alias("_text"), *[docs[c].alias(f"_keep{i}") for i, c in enumerate(keep)])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    kept = [f"_keep{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for batch in batches:
            for part in slices(batch, "_text"):
                names, scores = judge.predict(texts_of(part, "_text"))
                yield pa.RecordBatch.from_arrays([part.column("_key"), *[part.column(c) for c in kept], pa.array(names, pa.string()), pa.array(scores)], ["_key", *kept, "_lang", "_score"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in ["_key", *kept]) + ", _lang string, _score double"
    out = rows.mapInArrow(run, schema)
    return out.select(F.col("_key").alias(key), *[F.col(a).alias(b) for a, b in zip(kept, keep)], F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def recognised(docs: DataFrame, model: Model, text: str = "text", least_score: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, whose text has a language with at least this posterior."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                names, scores = shared.value.predict(texts_of(part, text))
                yield part.filter(pa.array((np.array(names) != UNDETERMINED) & (scores >= least_score)))

    return docs.mapInArrow(run, docs.schema)


def remainder(key: Column, of: int) -> Column:
    """crc32 of a key as text, modulo `of`; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % of
