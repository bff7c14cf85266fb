"""Token ids by the tokenizers library, raw id shards, and keyed access through a minimal perfect hash.

``write_store`` deals documents by ranges of ``doc_id`` and sorts each range;
every task encodes its texts and writes one shard of two files to the shared
folder: ``.ids`` with nothing but little-endian ids (16 bits where the
vocabulary allows, else 32) and ``.idx`` with

* the levels of a minimal perfect hash over the shard's distinct keys: at each
  level a key that alone sets its bit is placed, the others go on, and the slot
  is the number of set bits before its own;
* for each slot a 32-bit fingerprint of its key, its first row and its number
  of rows (repeated keys lie side by side);
* for each row its key and the offset of its ids.

A look-up hashes the key, reads one slot, compares the fingerprint and slices
the payload.  The manifest (one row per shard) is itself a Parquet table; a
task that is run again writes files under a new name, and only those of the
task that the manifest names are ever read.  Rows with a null key come first,
are counted in the header and are not reachable by key.

A shard holds about ``SHARD_BYTES`` of text, counting ``ROW_BYTES`` more for each
row, so keys and offsets of a shard fit a task at every scale; a longer text is
a shard's work by itself.  A null text is an empty one: its only id is the end
id.  Repeated rows lie side by side.  An empty table gives an empty manifest.
Extra columns are ignored.  Shards stay in the folder until its owner clears it.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import RARE, byte_letters, vocabulary
from .common import arrow_map, chunks, qualified, shared_dir, tokenizer_path, written
from .shingles import mix

MAGIC = b"QGIDX1\n\x00"
GAMMA = 2
#: One text in so many is encoded by both libraries.
PROBE = 64
#: Text of a shard; below it there are as many shards as shuffle partitions, of LEAST_BYTES or more.
SHARD_BYTES, LEAST_BYTES, ROW_BYTES = 128 << 20, 8 << 20, 64
_U = np.uint64


class LibraryEncoder:
    """The tokenizers library's ids of whole texts, through the same merges in tiktoken where the two agree.

    A byte-level vocabulary whose merges are numbered in order is also a table of
    ranks.  Tiktoken applies such a table several times faster, to the same ids.
    Texts with special strings or with characters that the libraries may class
    differently go to tokenizers, so do texts that tiktoken gives up on (very long
    runs of white space) and all texts under any other vocabulary.  Every
    ``PROBE``-th text goes to both; on a difference, which the tests rule out for
    the installed versions, the rest of the worker's texts go to tokenizers and a
    warning is given.
    """

    def __init__(self, path: str):
        v = self.vocabulary = vocabulary(path)
        self.library, self.fast, self.seen = v.library(), None, 0
        back = {x: b for b, x in enumerate(byte_letters())}
        ordinary = [s for s in v.ids if v.ids[s] not in v.special.values()]
        if v.joined or v.lower or v.suffix or any(m >> 20 != (m & 0xFFFFF) - 256 for m in v.merges.values()):
            return
        import tiktoken

        ranks = {bytes(back[c] for c in s): v.ids[s] for s in ordinary}
        self.fast = tiktoken.Encoding(path, pat_str=v.pattern.pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out: list[bytes | None] = []
        slow = []
        for i, t in enumerate(texts):
            if self.fast is None or "<|" in t or (not t.isascii() and RARE.search(t)):
                out.append(None)
                slow.append(i)
                continue
            try:
                out.append(self.fast.encode_to_numpy(t, disallowed_special=()).astype("<u4").tobytes())
            except ValueError:  # beyond the backtracking limit of its pattern
                out.append(None)
                slow.append(i)
                continue
            self.seen += 1
            if self.seen % PROBE == 1:
                slow.append(i)
        for i, e in zip(slow, self.library.encode_batch([texts[i] for i in slow], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4").tobytes()
            if out[i] is not None and out[i] != ids:
                warnings.warn("tiktoken and tokenizers differ on a text; going on with tokenizers", stacklevel=2)
                self.fast = None
                return self.encode(texts)
            out[i] = ids
        return out


_encoders: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys, by levels of bits that one key alone sets."""

    def __init__(self, levels: list[tuple[int, np.ndarray]]):
        self.levels = [(m, bits, np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])) for m, bits in levels]

    @staticmethod
    def _place(keys: np.ndarray, level: int, m: int) -> np.ndarray:
        return (mix(keys ^ mix(np.array([level + 1], _U))) % _U(m)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys.astype(np.int64).view(_U)
        while len(left):
            m = max(64, -(-GAMMA * len(left) // 64) * 64)
            at = cls._place(left, len(levels), m)
            alone = np.bincount(at, minlength=m)[at] == 1
            bits = np.zeros(m, np.uint8)
            bits[at[alone]] = 1
            levels.append((m, np.packbits(bits, bitorder="little").view(_U)))
            left = left[~alone]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for a key that was not built in, any slot or -1."""
        left = keys.astype(np.int64).view(_U)
        out, who, base = np.full(len(left), -1, np.int64), np.arange(len(left)), 0
        for level, (m, bits, before) in enumerate(self.levels):
            at = self._place(left, level, m)
            word, bit = at >> 6, (at & 63).astype(_U)
            set_ = (bits[word] >> bit) & _U(1) == 1
            rank = before[word] + np.bitwise_count(bits[word] & ((_U(1) << bit) - _U(1)))
            out[who[set_]] = base + rank[set_]
            left, who, base = left[~set_], who[~set_], base + int(before[-1])
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(_U) ^ _U(0xF1E2D3C4B5A69788)) >> _U(32)).astype(np.uint32)


def build_index(keys: np.ndarray, nulls: int, offsets: np.ndarray, width: int) -> bytes:
    """The index file of a shard: ``keys`` sorted (nulls first, counted apart), ``offsets`` one longer than the rows."""
    distinct, first, count = np.unique(keys[nulls:], return_index=True, return_counts=True)
    mph = PerfectHash.build(distinct)
    slot = mph.slots(distinct)
    marks, start, rows = np.zeros(len(slot), np.uint32), np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
    marks[slot], start[slot], rows[slot] = fingerprints(distinct), first + nulls, count
    arrays = [*(bits for _, bits, _ in mph.levels), marks, start, rows, keys.astype(np.int64), offsets.astype(np.int64)]
    head = json.dumps({"nulls": nulls, "width": width, "levels": [m for m, _, _ in mph.levels], "sizes": [a.nbytes for a in arrays]}).encode()
    out = io.BytesIO()
    out.write(MAGIC + struct.pack("<I", len(head)) + head)
    for a in arrays:
        out.write(a.tobytes())
    return out.getvalue()


class Shard:
    """Read access to one shard's files."""

    def __init__(self, path: str):
        fs, at = pafs.FileSystem.from_uri(path)
        with fs.open_input_file(at + ".idx") as f:
            data = f.read()
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{path}.idx is not an index")
        (n,) = struct.unpack_from("<I", data, len(MAGIC))
        self.head = json.loads(data[len(MAGIC) + 4 : len(MAGIC) + 4 + n])
        at_, arrays = len(MAGIC) + 4 + n, []
        kinds = [_U] * len(self.head["levels"]) + [np.uint32, np.int64, np.int64, np.int64, np.int64]
        for size, kind in zip(self.head["sizes"], kinds, strict=True):
            arrays.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at_))
            at_ += size
        self.hash = PerfectHash(list(zip(self.head["levels"], arrays[:-5], strict=True)))
        self.marks, self.first, self.count, self.keys, self.offsets = arrays[-5:]
        self._fs, self._at = fs, at + ".ids"

    def rows_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; (-1, 0) for an absent one."""
        if not len(self.marks):
            return np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        slot = self.hash.slots(keys)
        there = (slot >= 0) & (self.marks[slot] == fingerprints(keys))
        return np.where(there, self.first[slot], -1), np.where(there, self.count[slot], 0)

    def payload(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """The raw ids from one offset to another."""
        width = self.head["width"]
        end = int(self.offsets[-1]) if end is None else end
        with self._fs.open_input_file(self._at) as f:
            data = f.read_at((end - start) * width, start * width)
        return np.frombuffer(data, "<u2" if width == 2 else "<u4")

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every row of a key, by one hash look-up and one read."""
        first, count = (int(x[0]) for x in self.rows_of(np.array([key], np.int64)))
        if not count:
            return []
        cut = self.offsets[first : first + count + 1]
        ids = self.payload(int(cut[0]), int(cut[-1]))
        return [ids[a - cut[0] : b - cut[0]] for a, b in zip(cut[:-1], cut[1:], strict=True)]


MANIFEST = "shard int, path string, n_rows long, n_ids long, least long, most long"


def _writer(folder: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(path)
        width = 2 if max(encode.vocabulary.strings) < 1 << 16 else 4
        shard = TaskContext.get().partitionId()
        fs, at = pafs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        keys, sizes, nulls = [], [], 0
        tail = struct.pack("<I", end_id)
        with fs.open_output_stream(f"{at}/{name}.ids") as f:
            for batch in chunks(batches, "text"):
                ids = batch.column("doc_id").cast(pa.int64())
                nulls += ids.null_count
                keys.append(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False))
                rows = [x + tail for x in encode.encode(pc.fill_null(batch.column("text"), "").to_pylist())]
                sizes.append(np.array([len(x) // 4 for x in rows], np.int64))
                f.write(np.frombuffer(b"".join(rows), "<u4").astype("<u2" if width == 2 else "<u4").tobytes())
        if not keys:
            fs.delete_file(f"{at}/{name}.ids")
            return
        key = np.concatenate(keys)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        with fs.open_output_stream(f"{at}/{name}.idx") as f:
            f.write(build_index(key, nulls, offsets, width))
        known = key[nulls:]
        least, most = (int(known[0]), int(known[-1])) if len(known) else (None, None)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(key)], pa.int64()), pa.array([int(offsets[-1])], pa.int64()), pa.array([least], pa.int64()), pa.array([most], pa.int64())], names=["shard", "path", "n_rows", "n_ids", "least", "most"])

    return run


def write_store(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, tokenizer_folder: str | None = None) -> DataFrame:
    """Writes shards in ascending ``doc_id`` order and returns the written manifest, with each shard's first position in the whole (start)."""
    spark = docs.sparkSession
    folder = qualified(spark, folder or f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}")
    run = _writer(folder, tokenizer_path(tokenizer, tokenizer_folder), end_id)
    size = docs.select(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    shards = max(-(-size // SHARD_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // LEAST_BYTES)), 1)
    dealt = docs.select("doc_id", "text").repartitionByRange(shards, "doc_id", F.length("text"), F.xxhash64("text"))
    manifest = written(arrow_map(dealt.sortWithinPartitions("doc_id", F.length("text"), F.xxhash64("text")), run, MANIFEST), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            shard = Shard(path)
            nulls, offsets, keys = shard.head["nulls"], shard.offsets, shard.keys
            distinct = np.unique(keys[nulls:])
            first, count = shard.rows_of(distinct)
            if (count < 1).any():
                raise ValueError(f"{path}: a key is not found")
            row = np.concatenate([np.arange(nulls), np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))]).astype(np.int64)
            doc = pa.array(keys[row], pa.int64(), mask=row < nulls)
            at = 0
            while at < len(row):  # a bounded part of the payload at a time
                end = max(at + 1, int(np.searchsorted(offsets[row], offsets[row[at]] + (1 << 21))))
                base = int(offsets[row[at]])
                ids = shard.payload(base, int(offsets[row[end - 1] + 1])).astype("<u4")
                a, b = offsets[row[at:end]], offsets[row[at:end] + 1]
                crc = [zlib.crc32(ids[x - base : y - base].tobytes()) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc.slice(at, end - at), pa.array(a + start, pa.int64()), pa.array(b - a, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                at = end


def read_store(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, each found by its key in its shard."""
    return arrow_map(manifest.select("shard", "path", "start").repartition("shard"), _reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, key: int) -> list[np.ndarray]:
    """The ids of a key's rows: its shards by their ranges, then one hash look-up in each."""
    paths = manifest.where((F.col("least") <= key) & (F.col("most") >= key)).orderBy("shard").select("path").collect()  # one shard, or those that share a repeated key
    return [ids for row in paths for ids in Shard(row.path).get(key)]
