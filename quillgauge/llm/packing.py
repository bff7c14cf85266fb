"""Packing documents into training sequences, best fit decreasing.

Each document's ids (by the tokenizers library, with an end id) are cut into
full windows and a rest.  Pieces are dealt at random into groups of about
``GROUP`` pieces, so that a group's size is bounded at every scale, and each
group is packed longest first: a segment tree over the remaining capacities
finds the open window with the least room that still holds the piece.

``sequences`` yields the training sequences themselves: little-endian ids (16
bits where the vocabulary allows, else 32), filled up to the window with the
padding id, and the pieces they hold.  ``packed`` lists the pieces, with
checksums taken from the sequences.

A null text is an empty one: its only token is the end id.  Repeated rows are
packed each by itself.  Of pieces of one length the smaller id goes first, then
the smaller start.  A very long text is encoded whole, as one row of work.  An
empty table gives no sequences; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks, tokenizer_path, written
from .idstore import encoder

WINDOW = 2048
GROUP = 4096
#: Groups that share a task, about 100 MB of ids, once the session's shuffle partitions would hold more.
TASK = 16


class Room:
    """Open windows by remaining capacity, in a segment tree that counts them."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.n = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        i = room + self.leaves
        while i:
            self.n[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes the window with the least room of at least ``need``; None if there is none."""
        n, i = self.n, need + self.leaves
        if not n[i]:
            while i > 1 and (i & 1 or not n[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i *= 2
                if not n[i]:
                    i += 1
        room = i - self.leaves
        while i:
            n[i] -= 1
            i >>= 1
        return room, self.windows[room].pop()


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window and offset of each piece, given in descending order of length."""
    room, where, offset, opened = Room(window), [], [], 0
    for need in lengths:
        found = room.take(need)
        if found is None:
            found = (window, opened)
            opened += 1
        left, at = found
        where.append(at)
        offset.append(window - left)
        if left > need:
            room.put(left - need, at)
    return where, offset


PIECE = "doc_id long, start long, length long, doc_tokens long"
SEQUENCES = f"sequence_id long, n_tokens long, ids binary, pieces array<struct<{PIECE}, offset long>>"
#: Sequences of an Arrow batch on its way back.
SLICE = 256


def _cutter(path: str, end_id: int, pad_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = encoder(path), struct.pack("<I", end_id)
        narrow = max(*encode.vocabulary.strings, end_id, pad_id) < 1 << 16
        for batch in chunks(batches, "text"):
            doc, start, length, total, parts = [], [], [], [], []
            for i, x in enumerate(encode.encode(pc.fill_null(batch.column("text"), "").to_pylist())):
                data = np.frombuffer(x + tail, "<u4")
                n = len(data)
                data = data.astype("<u2") if narrow else data
                for a in range(0, n, window):
                    part = data[a : a + window]
                    doc.append(i)
                    start.append(a)
                    length.append(len(part))
                    total.append(n)
                    parts.append(part.tobytes())
            ids = batch.column("doc_id").cast(pa.int64()).take(pa.array(doc, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in (start, length, total)), pa.array(parts, pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return run


def _packer(pad_id: int, window: int):
    """Rows sorted by group, then longest first; a group has a bounded number of rows."""

    def pack(t: pa.Table) -> Iterator[pa.RecordBatch]:
        lengths, parts = t.column("length").to_pylist(), t.column("ids").to_pylist()
        where, offset = (np.array(x, np.int64) for x in best_fit_decreasing(lengths, window))
        n = int(where.max()) + 1
        ids = np.full((n, window), pad_id, "<u2" if len(parts[0]) == 2 * lengths[0] else "<u4")
        for part, k, at, size in zip(parts, where.tolist(), offset.tolist(), lengths, strict=True):
            ids[k, at : at + size] = np.frombuffer(part, ids.dtype)
        order = np.lexsort((offset, where))
        edges = np.searchsorted(where[order], np.arange(n + 1))
        names = ["doc_id", "start", "length", "doc_tokens", "offset"]
        columns = [*(t.column(c).combine_chunks().take(pa.array(order)) for c in names[:-1]), pa.array(offset[order])]
        pieces = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(columns, names))
        used = np.bincount(where, weights=np.array(lengths), minlength=n).astype(np.int64)
        first = t.column("grp")[0].as_py() * (1 << 32)
        for a in range(0, n, SLICE):
            b = min(n, a + SLICE)
            yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(a, b)), pa.array(used[a:b]), pa.array([x.tobytes() for x in ids[a:b]], pa.binary()), pieces.slice(a, b - a)], names=["sequence_id", "n_tokens", "ids", "pieces"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            grp = batch.column("grp").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(grp)) + 1).tolist(), len(grp)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and held[-1].column("grp")[0].as_py() != grp[a]:
                    yield from pack(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from pack(pa.Table.from_batches(held))

    return run


def sequences(docs: DataFrame, tokenizer: str, end_id: int = 1, pad_id: int = 0, window: int = WINDOW, tokenizer_folder: str | None = None) -> DataFrame:
    """One row per training sequence: sequence_id, n_tokens before the padding, ids of the whole window, and its pieces in order."""
    run = _cutter(tokenizer_path(tokenizer, tokenizer_folder), end_id, pad_id, window)
    cut = arrow_map(docs.select("doc_id", "text"), run, f"{PIECE}, ids binary")
    pieces = written(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // GROUP))
    tasks = -(-groups // TASK)
    spread = (tasks, "grp") if tasks > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else ("grp",)  # fewer are left to the session
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups))).repartition(*spread).sortWithinPartitions("grp", F.desc("length"), "doc_id", "start", "row")
    return arrow_map(dealt.select("grp", "doc_id", "start", "length", "doc_tokens", "ids"), _packer(pad_id, window), SEQUENCES)


def _sums(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, crc = batch.column("pieces"), []
            for ids, pieces in zip(batch.column("ids").to_pylist(), held.to_pylist(), strict=True):
                e = np.frombuffer(ids, "<u2" if len(ids) == 2 * window else "<u4").astype("<u4")
                crc += [zlib.crc32(e[p["offset"] : p["offset"] + p["length"]].tobytes()) for p in pieces]
            flat = held.flatten()
            column = dict(zip((f.name for f in flat.type), flat.flatten(), strict=True))
            sequence = batch.column("sequence_id").take(pc.list_parent_indices(held))
            yield pa.RecordBatch.from_arrays(
                [column["doc_id"], column["start"], column["length"], pa.array(crc, pa.int64()), column["doc_tokens"], sequence, column["offset"]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, tokenizer_folder: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset in its sequence."""
    whole = sequences(docs, tokenizer, end_id=end_id, window=window, tokenizer_folder=tokenizer_folder)
    return arrow_map(whole, _sums(window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pieces_with_sequences(whole: DataFrame) -> DataFrame:
    """One row per piece of ``sequences``; the row at offset 0 carries its sequence's ids and n_tokens, the others null."""
    rows = whole.select("sequence_id", "n_tokens", "ids", F.inline("pieces"))
    first = F.col("offset") == 0
    return rows.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", F.when(first, F.col("n_tokens")).alias("n_tokens"), F.when(first, F.col("ids")).alias("ids"))
