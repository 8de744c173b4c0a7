"""Arrow batches in small slices, and words of many texts hashed at once."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

U64 = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
# Letters, digits and every byte of a character beyond ASCII.
_IS_ALNUM = np.zeros(256, dtype=bool)
_IS_ALNUM[48:58] = _IS_ALNUM[65:91] = _IS_ALNUM[97:123] = _IS_ALNUM[128:] = True


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `limit` bytes of text each; a longer text is a slice of its own."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // limit
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    starts[0] = 0
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(int(a), int(b - a))


def whole_texts(batch: pa.RecordBatch, column: str) -> pa.StringArray:
    """The texts of a column, null ones as empty."""
    return pc.fill_null(batch.column(column), "").cast(pa.string())


def pieces_of(texts: pa.StringArray, between: str) -> tuple[pa.StringArray, np.ndarray]:
    """All pieces of the texts between a separator, and how many each text has."""
    parts = pc.split_pattern(texts, between)
    parts = parts.combine_chunks() if isinstance(parts, pa.ChunkedArray) else parts
    return parts.flatten(), np.diff(parts.offsets.to_numpy())


def bounds_of(ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Where each text's ids begin, from where each of its pieces' do."""
    return ends[np.concatenate([[0], np.cumsum(counts)])]


def in_order(groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of n texts in one array and their bounds, from groups of (texts, ids, bounds)."""
    flat, owner = np.concatenate([g[1] for g in groups]), np.concatenate([g[0] for g in groups])
    lengths = np.concatenate([np.diff(g[2]) for g in groups])
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(owner, kind="stable")
    return ragged(flat, starts[order], lengths[order])


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeds(n: int, stream: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        offset = U64(stream) * U64(0xD1342543DE82EF95)
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + offset)


_BYTE_VALUES = seeds(256, 11)
_BASE = 0x9E6C63D0876A9A47 | 1


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[U64(1)], np.full(max(n - 1, 0), U64(_BASE))]).astype(U64), dtype=U64)


def word_hashes(texts: list[str], words: str = "space", lower: str = "ascii") -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and where each text's words begin (one entry more than texts).

    words: "space" splits at ASCII white space only, "alnum" at everything but letters, digits and characters beyond ASCII.
    lower: "ascii" folds A-Z only, "all" folds by Unicode.
    """
    raw = [(t.lower() if lower == "all" else t).encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    inside = ~_IS_SPACE[data] if words == "space" else _IS_ALNUM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = np.flatnonzero(begins)
    bounds = np.concatenate([[0], np.searchsorted(first, ends)])
    if not len(first):
        return np.zeros(0, dtype=U64), bounds
    kept = _LOWER[data[inside]]
    at = np.flatnonzero(begins[inside])
    lengths = np.diff(at, append=len(kept))
    place = np.arange(len(kept)) - np.repeat(at, lengths)
    values = _BYTE_VALUES[kept] * _powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, at) + lengths.astype(U64)), bounds


def ngram_hashes(words: np.ndarray, n: int, gap: int = 1) -> np.ndarray:
    """Hashes of every n words in a row (or `gap` apart); n-1 windows at the end are missing."""
    count = len(words) - (n - 1) * gap
    if count <= 0:
        return np.zeros(0, dtype=U64)
    out = np.full(count, (0x51ED270B27B4F3CF * n + gap) % (1 << 64), dtype=U64)
    for k in range(n):
        out = mix(out * U64(0x9E3779B97F4A7C15) + words[k * gap : k * gap + count])
    return out


_RESIDENT: dict = {}


def resident(key: tuple, make: Callable):
    """An object that a Python worker keeps between tasks. Another key takes its place, so a reused worker holds one at a time."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        gc.collect()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


class RaggedCache:
    """From a string to an array of ids, kept between batches; it starts anew when it holds more than `limit` strings."""

    def __init__(self, limit: int):
        self.limit = limit
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)

    def gather(self, keys: list[list[str]], make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all keys of all texts in one array, and where each text's ids begin. make: (ids, lengths) of strings not seen yet."""
        counts = np.fromiter(map(len, keys), np.int64, len(keys))
        index = self._index(list(chain.from_iterable(keys)), make)
        ids, ends = ragged(self.ids, self.starts[index], self.lengths[index])
        return ids, ends[np.concatenate([[0], np.cumsum(counts)])]

    def _index(self, flat: list[str], make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Where each string's ids are kept, after those not seen yet are made."""
        if len(self.known) > self.limit:
            self._forget()
        index = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(index < 0).tolist()
        if missing:
            fresh = list(dict.fromkeys([flat[k] for k in missing]))
            ids, lengths = make(fresh)
            begin = len(self.known)
            self.known.update(zip(fresh, range(begin, begin + len(fresh))))
            self.lengths = np.concatenate([self.lengths, lengths])
            self.starts = np.cumsum(self.lengths) - self.lengths
            self.ids = np.concatenate([self.ids, ids])
            index[missing] = [self.known[flat[k]] for k in missing]
        return index

    def gather_words(self, words: pa.StringArray, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and where each word's ids begin (and the last ends). Words that are equal are looked up once."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist
        index = self._index(distinct, make)[coded.indices.to_numpy(zero_copy_only=False)]
        return ragged(self.ids, self.starts[index], self.lengths[index])


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat that begin at starts, one after the other, and where each begins (and the last ends)."""
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return flat[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lengths)], ends
