"""Token ids in length-delimited binary records with masked checksums, and an offset index for reads in any order.

A record file holds, for each document: the length of the body (8 bytes), its masked checksum (4), the body, the masked checksum of the body (4);
all little-endian. A body is the document id (8 bytes), the width of an id (1) and the ids. The checksum is CRC-32, rotated right by 15 bits plus
MASK_DELTA, so that a checksum of data that holds checksums stays sound. Beside each record file lies an index file: for each record its document id,
offset and number of ids (8 bytes each). Files are in ascending order of document ids, as are the records in them.

Tasks write under a name of their own and rename at the end, so a task that is run again replaces its file by the same bytes; only files that the
manifest names are ever read. The folder must be one that driver and executors share.

Defined cases: a null or empty text is a record of the end id alone; a document id that occurs twice has two records, in the order of their texts; a
null id is written as NULL_ID and comes first; no rows give no files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import shared_dir
from .batches import RaggedCache, bounds_of, in_order, pieces_of, ragged, resident, slices, whole_texts

MASK_DELTA = 0xA282EAD8  # fixed value of the masking formula
NULL_ID = -(2**63)
CACHED_WORDS = 400_000
WORDS_IN_LINE = 200
ENCODED_AT_ONCE = 1 << 22  # bytes of text, whose distinct words are looked up
FIRST_COMBINING = "\u0300"  # below it, NFC changes nothing and case does not depend on neighbours
INDEX = np.dtype([("key", "<i8"), ("offset", "<i8"), ("n", "<i8")])
MANIFEST = "shard int, path string, n_records long, n_ids long, n_bytes long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(body: bytes) -> bytes:
    head = struct.pack("<Q", len(body))
    return b"".join((head, struct.pack("<I", masked(head)), body, struct.pack("<I", masked(body))))


def unframe(data: bytes, at: int) -> tuple[bytes, int]:
    """The body of the record at a position, and where the next one begins; ValueError if a checksum doesn't fit."""
    head = data[at : at + 8]
    if len(head) < 8 or struct.unpack("<I", data[at + 8 : at + 12])[0] != masked(head):
        raise ValueError(f"damaged length at {at}")
    end = at + 12 + struct.unpack("<Q", head)[0]
    body = data[at + 12 : end]
    if end + 4 > len(data) or struct.unpack("<I", data[end : end + 4])[0] != masked(body):
        raise ValueError(f"damaged record at {at}")
    return body, end + 4


class WordEncoder:
    """Ids by the tokenizers library. Words between spaces or line ends are encoded once and kept; this needs a tokenizer that never joins
    across white space and drops it. A text with a special token's string is encoded as a whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a match of the splitting pattern
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.split = regex.compile(self._pattern()).findall
        self.words = RaggedCache(CACHED_WORDS)
        self.cores = RaggedCache(CACHED_WORDS)

    def _pattern(self) -> str:
        """The pattern that splits texts before merging, as the tokenizer's file states it."""
        stated = json.loads(self.tokenizer.to_str())["pre_tokenizer"]
        return next(p["pattern"]["Regex"] for p in stated.get("pretokenizers", [stated]) if p["type"] == "Split")

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters alone are encoded as lines of many, which saves most of a call's cost; such a line is taken apart where a match ends.
        A line with more ends than words holds a word of several matches, and its words are encoded one by one, like all other words."""
        plain = [k for k, w in enumerate(words) if w.isalpha()]
        lines = [plain[a : a + WORDS_IN_LINE] for a in range(0, len(plain), WORDS_IN_LINE)]
        single = [k for k, w in enumerate(words) if not w.isalpha()]
        owners, lengths, ids = [], [], []
        for line, coded in zip(lines, self.tokenizer.encode_batch_fast([" ".join([words[k] for k in line]) for line in lines], add_special_tokens=False)):
            found = np.array(coded.ids, dtype=np.int32)
            last = np.flatnonzero(self.ends[found])
            if len(last) == len(line):
                owners.append(np.array(line))
                lengths.append(np.diff(last, prepend=-1))
                ids.append(found)
            else:
                single.extend(line)
        for k, coded in zip(single, self.tokenizer.encode_batch_fast([words[k] for k in single], add_special_tokens=False)):
            owners.append(np.array([k]))
            lengths.append(np.array([len(coded.ids)]))
            ids.append(np.array(coded.ids, dtype=np.int32))
        if not owners:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        owner, length, flat = np.concatenate(owners), np.concatenate(lengths), np.concatenate(ids)
        order = np.argsort(owner)
        return ragged(flat, (np.cumsum(length) - length)[order], length[order])[0], length[order]

    def _parts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """New words by their parts: folded, and cut into the matches of the splitting pattern, which the library encodes one by one. A word with
        characters that normalisation may change otherwise than by case, or with unprintable ones, is a part itself."""
        given = pa.array(words, pa.string())
        plain = pc.ascii_is_alpha(given).to_numpy(zero_copy_only=False)
        ids, ends = self.cores.gather_words(pc.ascii_lower(given.filter(pa.array(plain))), self._encode)
        groups = [(np.flatnonzero(plain), ids, ends)]
        others, keys = np.flatnonzero(~plain), []
        for w in map(words.__getitem__, others.tolist()):
            if w.isascii() or max(w) < FIRST_COMBINING:
                low = w.lower()
                keys.append([low] if low.isalpha() else self.split(low) if low.isprintable() else [w])
            else:
                keys.append([w])
        groups.append((others, *self.cores.gather(keys, self._encode)))
        ids, ends = in_order(groups, len(words))
        return ids, np.diff(ends)

    def encode(self, texts: list[str] | pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids begin (one entry more than texts)."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        whole = np.zeros(len(texts), dtype=bool)
        for string in self.special:
            whole |= pc.match_substring(texts, string).to_numpy(zero_copy_only=False)
        split = np.flatnonzero(~whole)
        words, counts = pieces_of(pc.replace_substring(texts.take(pa.array(split)), "\n", " "), " ")
        ids, ends = self.words.gather_words(words, self._parts)
        groups = [(split, ids, bounds_of(ends, counts))]
        if whole.any():
            own = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32) for t in texts.filter(pa.array(whole)).to_pylist()]
            groups.append((np.flatnonzero(whole), np.concatenate(own), np.concatenate([[0], np.cumsum([len(e) for e in own])])))
        return in_order(groups, len(texts))


def loaded(path: str) -> WordEncoder:
    """One encoder per Python worker."""
    return resident(("word_bpe", path), lambda: WordEncoder(path))


def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def write(docs: DataFrame, path: str, end_id: int, folder: str | None = None, key: str = "doc_id", text: str = "text", files: int | None = None) -> DataFrame:
    """Encode all rows and write record and index files in ascending key order. Returns the manifest: one row for each file.

    path: a tokenizers file on every executor; folder: a new one under the shared folder if not given; files: how many (as many as there are
    shuffle partitions if not given).
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(docs[key].cast("long"), F.lit(NULL_ID)).alias("key"), docs[text].alias("text"))
    rows = rows.repartitionByRange(files, "key").sortWithinPartitions("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        shard = context.partitionId()
        encoder = loaded(path)
        out = fs = None
        index: list[np.ndarray] = []
        at = n_ids = n_records = 0
        base = f"records-{shard:06d}"
        for batch in batches:
            for part in slices(batch, "text", ENCODED_AT_ONCE):
                if out is None:
                    fs, place = _file_system(folder)
                    fs.create_dir(place, recursive=True)
                    own = f"{place}/.{base}-{context.taskAttemptId()}"
                    out = fs.open_output_stream(f"{own}.rec")
                keys = part.column("key").to_numpy()
                ids, bounds = encoder.encode(whole_texts(part, "text"))
                kind = "<u2" if encoder.width == 2 and end_id < 1 << 16 else "<u4"
                small, end = ids.astype(kind), np.array([end_id], dtype=kind).tobytes()
                ends = bounds.tolist()
                head = struct.Struct("<qB")
                frames = [frame(head.pack(k, int(kind[-1])) + small[a:b].tobytes() + end) for k, a, b in zip(keys.tolist(), ends, ends[1:])]
                sizes = np.array([len(f) for f in frames], dtype=np.int64)
                rows_ = np.zeros(len(frames), dtype=INDEX)
                rows_["key"], rows_["n"] = keys, np.diff(bounds) + 1
                rows_["offset"] = at + np.cumsum(sizes) - sizes
                index.append(rows_)
                out.write(b"".join(frames))
                at += int(sizes.sum())
                n_ids += int(rows_["n"].sum())
                n_records += len(frames)
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{own}.idx") as f:
                f.write(np.concatenate(index).tobytes())
            for kind in ("idx", "rec"):
                fs.move(f"{own}.{kind}", f"{place}/{base}.{kind}")
            row = [[shard], [f"{folder}/{base}"], [n_records], [n_ids], [at]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["shard", "path", "n_records", "n_ids", "n_bytes"])

    # The manifest has a row a file. It is made once, here: a second run would write the files again.
    made = rows.mapInArrow(run, MANIFEST).checkpoint(eager=True)
    return made


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with `start`: the ids in all files before. One row a file, so one task is enough."""
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))


def read(manifest: DataFrame, key: str = "doc_id", ids: bool = False) -> DataFrame:
    """One row for each record, from the files: key, start (ids before it), n_tokens, ids_crc32 (of the ids as 4 bytes each), and the ids on request.

    Records are fetched through the index, some megabytes at a time, and both checksums of each are checked.
    """
    schema = f"`{key}` long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")
    files = with_starts(manifest).select("path", "start", "n_bytes")
    files = files.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                fs, place = _file_system(file["path"])
                with fs.open_input_file(f"{place}.idx") as f:
                    index = np.frombuffer(f.read(), dtype=INDEX)
                starts = file["start"] + np.cumsum(index["n"]) - index["n"]
                ends = np.append(index["offset"][1:], file["n_bytes"])
                with fs.open_input_file(f"{place}.rec") as f:
                    group = index["offset"] // (1 << 22)
                    edges = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(index)]
                    for a, b in zip(edges, edges[1:]):
                        f.seek(int(index["offset"][a]))
                        yield _rows(f.read(int(ends[b - 1] - index["offset"][a])), index[a:b], starts[a:b])

    def _rows(data: bytes, index: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        keys, counts, sums, lists = [], [], [], []
        at = 0
        for wanted in index.tolist():
            body, at = unframe(data, at)
            found, width = struct.unpack_from("<qB", body)
            values = np.frombuffer(body, dtype=f"<u{width}", offset=9)
            if found != wanted[0] or len(values) != wanted[2]:
                raise ValueError(f"index and records differ at document {wanted[0]}")
            keys.append(None if found == NULL_ID else found)
            counts.append(len(values))
            sums.append(zlib.crc32(values.astype("<u4").tobytes()))
            if ids:
                lists.append(values.astype(np.int64))
        columns = [pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())]
        names = [key, "start", "n_tokens", "ids_crc32"]
        return pa.RecordBatch.from_arrays(columns + ([pa.array(lists, pa.list_(pa.int64()))] if ids else []), names + ["ids"] * ids)

    return files.mapInArrow(run, schema)


def shuffled_read(spark: SparkSession, manifest: DataFrame, seed: int = 0) -> DataFrame:
    """All records with their ids, in an order drawn by a seed: the files are read once, the rows are dealt out and sorted by a hash."""
    return read(manifest, ids=True).repartition(F.xxhash64("doc_id", "start", F.lit(seed))).sortWithinPartitions(F.xxhash64("doc_id", F.lit(seed), "start"))
