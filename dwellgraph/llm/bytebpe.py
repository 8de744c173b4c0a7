"""Byte-level byte-pair encoding and decoding on padded numpy matrices.

The distinct pieces of a slice of texts become rows of byte ids, in matrices of a few widths. In each round every row merges its leftmost pair of
minimum rank; pair ranks come from a hash table, finished rows leave the matrix. Pieces and their ids are kept between batches in a bounded table.

Defined cases: a null or empty text has no ids and decodes to no bytes; texts of any length are encoded whole; equal rows give equal ids; columns
other than the ones named are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .batches import RaggedCache, U64, bounds_of, in_order, mix, pieces_of, ragged, resident, slices, whole_texts

NONE = np.int32(2**31 - 1)
CACHED_PIECES = 300_000
CELLS = 1 << 21
# Where white space is more than one space between two words, a text is split by the pattern as a whole.
BLANK = r"[\s\v\x{1c}-\x{1f}\x{85}\p{Z}]"
UNEVEN_SPACE = rf"{BLANK}{BLANK}|\A{BLANK}|{BLANK}\z|\x00"


class PairTable:
    """Open-addressed table from two ids to the rank of their merge."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 3))))
        size = 1 << self.bits
        self.mask = np.int64(size - 1)
        self.keys = np.full(size, -1, dtype=np.int64)
        self.values = np.full(size, NONE, dtype=np.int32)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[left[free]]  # of several the last one stays
            placed = self.keys[slot] == keys[left]
            self.values[slot[placed]] = values[left[placed]]
            left, slot = left[~placed], (slot[~placed] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(U64)) >> U64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of id pairs; NONE where there is no merge or an id is negative."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1) & (keys >= 0))
        slot = slot[open_]
        for _ in range(self.probes):
            if not len(open_):
                break
            slot = (slot + 1) & self.mask
            found = self.keys[slot]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[hit]]
            go_on = ~hit & (found != -1)
            open_, slot = open_[go_on], slot[go_on]
        return out


class ByteBpe:
    """Encoder and decoder for a rank file (base64 piece and rank on each line) and a splitting pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.whole = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.pieces_of_ids = Pieces(path)
        self.byte_ids = np.array([self.whole[bytes([b])] for b in range(256)], dtype=np.int32)
        keys, values = [], []
        for piece, rank in self.whole.items():
            for cut in range(1, len(piece)):
                left, right = self.whole.get(piece[:cut]), self.whole.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.pairs = PairTable(np.array(keys, dtype=np.int64), np.array(values, dtype=np.int32))
        self.chunks = RaggedCache(CACHED_PIECES)
        self.pieces = RaggedCache(CACHED_PIECES)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By rounds over one padded matrix: pieces in the order in which they were finished, their numbers of ids, all their ids."""
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        width = int(sizes.max())
        cells = np.full((len(pieces), width), -1, dtype=np.int32)
        flat = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        cells[np.arange(width) < sizes[:, None]] = flat
        finished: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        owner = np.arange(len(pieces))
        ranks = self.pairs.ranks(cells[:, :-1].ravel(), cells[:, 1:].ravel()).reshape(len(pieces), width - 1)
        while len(owner):
            if cells.shape[1] > 1:
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(owner)), at]
                done = best == NONE
            else:
                done = np.ones(len(owner), dtype=bool)
            if done.any():
                inside = np.arange(cells.shape[1]) < sizes[done][:, None]
                finished.append((owner[done], sizes[done], cells[done][inside]))
            if done.all():
                break
            if done.any():  # compaction: finished rows and the columns that only they needed
                stay = ~done
                owner, sizes, at, best = owner[stay], sizes[stay], at[stay], best[stay]
                width = int(sizes.max())
                cells, ranks = cells[stay, :width], ranks[stay, : width - 1]
            rows = np.arange(len(owner))
            columns = np.arange(cells.shape[1] - 1)
            behind = columns[None, :] > at[:, None]  # cells right of the merged pair move left by one
            merged = np.where(behind, cells[:, 1:], cells[:, :-1])
            merged[rows, at] = best
            gone = np.full((len(owner), 1), NONE, dtype=np.int32)
            ranks = np.where(behind[:, :-1] if ranks.shape[1] > 1 else False, ranks[:, 1:], ranks[:, :-1]) if ranks.shape[1] > 1 else gone[:, :0]
            cells = merged
            sizes = sizes - 1
            for side in (at - 1, at):
                ok = (side >= 0) & (side + 1 < sizes)
                if ranks.shape[1]:
                    inside = (side >= 0) & (side < ranks.shape[1])
                    ranks[rows[inside], side[inside]] = NONE
                if ok.any():
                    ranks[rows[ok], side[ok]] = self.pairs.ranks(cells[rows[ok], side[ok]], cells[rows[ok], side[ok] + 1])
        owners, lengths, ids = zip(*finished)
        return np.concatenate(owners), np.concatenate(lengths), np.concatenate(ids)

    def _merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, and how many each has: whole ones by one lookup, the others in matrices by width."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        rank = np.array(list(map(self.whole.get, raw, repeat(-1))), dtype=np.int32)
        whole = np.flatnonzero(rank >= 0)
        owners, lengths, ids = [whole], [np.ones(len(whole), dtype=np.int64)], [rank[whole]]
        todo: dict[int, list[int]] = {}
        for k in np.flatnonzero(rank < 0).tolist():
            todo.setdefault(max(8, 1 << (len(raw[k]) - 1).bit_length()), []).append(k)
        for width, members in todo.items():
            step = max(1, CELLS // width)
            for a in range(0, len(members), step):
                part = members[a : a + step]
                who, many, found = self.merge([raw[k] for k in part])
                owners.append(np.array(part)[who])
                lengths.append(many)
                ids.append(found)
        owner, length, flat = np.concatenate(owners), np.concatenate(lengths), np.concatenate(ids)
        order = np.argsort(owner)
        starts = np.cumsum(length) - length
        return ragged(flat, starts[order], length[order])[0], length[order]

    def _chunk_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = self.pattern.findall
        ids, bounds = self.pieces.gather([[c] if c.isascii() and c[1:].isalpha() and (c[0] == " " or c[0].isalpha()) else split(c) for c in chunks], self._merged)
        return ids, np.diff(bounds)

    def encode(self, texts: list[str] | pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids begin (one entry more than texts)."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        whole = pc.match_substring_regex(texts, UNEVEN_SPACE).to_numpy(zero_copy_only=False)
        even = np.flatnonzero(~whole & (pc.binary_length(texts).to_numpy() > 0))
        # Parts that can be encoded one by one: no match of the pattern goes across a single space from the left.
        chunks, counts = pieces_of(pc.replace_substring(texts.take(pa.array(even)), " ", "\0 "), "\0")
        ids, ends = self.chunks.gather_words(chunks, self._chunk_ids)
        groups = [(even, ids, bounds_of(ends, counts))]
        if len(even) < len(texts):
            others = np.setdiff1d(np.arange(len(texts)), even)
            groups.append((others, *self.chunks.gather([self.pattern.findall(t) for t in texts.take(pa.array(others)).to_pylist()], self._chunk_ids)))
        return in_order(groups, len(texts))

    def decode(self, ids: Iterable[int]) -> bytes:
        return self.pieces_of_ids.decode(ids)


def loaded(path: str, pattern: str) -> ByteBpe:
    """One encoder per Python worker."""
    return resident(("byte_bpe", path, pattern), lambda: ByteBpe(path, pattern))


class Pieces:
    """What decoding needs: the bytes of each id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pieces = {int(b): base64.b64decode(a) for a, b in (line.split() for line in f if line.strip())}
        self.lengths = np.full(max(pieces) + 1, -1, dtype=np.int64)
        self.lengths[list(pieces)] = [len(p) for p in pieces.values()]
        ordered = [pieces.get(k, b"") for k in range(len(self.lengths))]
        self.flat = np.frombuffer(b"".join(ordered), dtype=np.uint8)
        self.starts = np.cumsum([0, *map(len, ordered[:-1])])

    def decode(self, ids: Iterable[int]) -> bytes:
        flat = np.fromiter(ids, np.int64)
        return self.decoded(flat, np.array([0, len(flat)]))[0].as_py()

    def decoded(self, ids: np.ndarray, bounds: np.ndarray) -> pa.LargeBinaryArray:
        """The bytes of many rows of ids, which begin at bounds; KeyError for an id that stands for nothing."""
        known = (ids >= 0) & (ids < len(self.lengths))
        if not known.all() or (self.lengths[ids] < 0).any():
            raise KeyError("an id that is not in the vocabulary")
        data, ends = ragged(self.flat, self.starts[ids], self.lengths[ids])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(ends[bounds]), pa.py_buffer(np.ascontiguousarray(data))])


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row. path: a rank file that exists on every executor."""
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = dict(rows.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = bpe.encode(whole_texts(part, "text"))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))], ["key", "ids"])

    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, decoded binary) of every row: `encode`, and `decode` of its ids, in one Python worker instead of two."""
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = dict(rows.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = bpe.encode(whole_texts(part, "text"))
                column = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                decoded = bpe.pieces_of_ids.decoded(ids, bounds).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("key"), column, decoded], ["key", "ids", "decoded"])

    return rows.mapInArrow(run, f"key {kind}, ids array<int>, decoded binary").withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, decoded binary): the bytes that the ids stand for. Null ids decode to no bytes."""
    rows = encoded.select(encoded[key].alias("key"), encoded[ids].alias("ids"))
    kind = dict(rows.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = resident(("byte_pieces", path), lambda: Pieces(path))
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                column = part.column("ids")
                counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
                raw = pieces.decoded(column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts)]))
                yield pa.RecordBatch.from_arrays([part.column("key"), column, raw.cast(pa.binary())], ["key", "ids", "decoded"])

    return rows.mapInArrow(run, f"key {kind}, ids array<int>, decoded binary").withColumnRenamed("key", key)
