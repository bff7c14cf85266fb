"""Near-duplicate detection: an exact Jaccard join on word shingles by parity sketches.

``near_duplicates`` finds the groups of documents whose sets of distinct
five-word shingles reach a similarity of 0.75, as connected components of
exactly verified links.  The steps:

1. every text becomes a set id, its size and bit sketches (a written table);
2. every distinct set emits the signatures of its parity sketch
   (:mod:`shingles`); sorting by signature makes runs of sets that agree on a
   part.  A run of up to ``RUN`` sets gives its pairs; a longer one is tied to
   its smallest id, its hub, so rows stay linear in the run.  These pairs are
   verified and contracted;
3. sets that share a hub but lie in different components are still open; most
   only have a common passage.  Up to ``GROUP`` sets of a hub are compared in a
   task by their bit sketches, and those with a possible partner are marked;
4. the sets of larger hubs emit all their signatures instead, and a signature
   that more than ``RUN`` of them have is hot.  Two linked sets differ in at most
   ``d`` parts; if one of them has more than ``d`` parts that are not hot, they
   agree on such a part, so the short runs give every pair but those of two
   dense sets, which consist mostly of hot parts; dense sets are marked;
5. marked sets are held against each other in blocks bounded in bytes.  A block
   is a task's work in memory: it verifies on whole sets and gives only links
   that join two components, at most one fewer than its sets.  This step compares
   all marked sets of a hub: comparisons grow with their square, rows don't;
6. links are contracted to components without leaving the executors.

Two bit sketches whose Hamming distance exceeds the largest symmetric difference
of a link rule a pair out; every other pair is verified on the whole shingle
sets, recomputed from the texts.

Nulls, empty and wordless texts have no shingles and stay alone.  Rows with a
null ``doc_id`` take no part (``component_id`` null).  Repeated rows fall into
one component.  Extra columns are ignored.  An empty table gives an empty one.
A very long text is one row of work: its set has eight bytes for each shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import shingles as sh
from .common import arrow_map, chunks, map_arrow, written

RUN = 8
#: Sets of a hub, and bytes of their sketches, that a task compares; more go by their rarer signatures.
GROUP, GROUP_BYTES = 8192, 16 << 20
#: Bytes of shingle sets in a block of marked sets; a larger set is a block of its own with those dealt to it.
BLOCK_BYTES = 8 << 20


def _profiler(seed: int):
    def profile(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, sid, own, low, lack = [], [], [], [], []
        for s in sh.shingle_sets(batch.column("text").to_pylist()):
            n.append(len(s))
            sid.append(sh.set_id(s))
            lack.append(len(s) >= sh.SMALL and sh.lacks(s, seed))
            level, below = sh.band(len(s)), sh.band(-(-len(s) * sh.NUM // sh.DEN))
            own.append(sh.bit_sketch(s, level).tobytes() if len(s) else None)
            low.append(sh.bit_sketch(s, below).tobytes() if below < level else None)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(own, pa.binary()), pa.array(low, pa.binary()), pa.array(lack, pa.bool_())], names=["doc_id", "n_shingles", "sid", "own", "low", "lack"])

    return profile


def profiles(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, n_shingles, sid (identity of the shingle set) and bit sketches of each document, and a usable seed.

    With random parts, a set with too few non-empty ones is all but impossible
    (under 1e-10); should one occur, the next seed deals the parts anew.
    """
    seed = 0
    while True:
        out = written(map_arrow(docs.select("doc_id", "text"), _profiler(seed), "doc_id long, n_shingles long, sid long, own binary, low binary, lack boolean"), "profiles")
        if out.where("lack").isEmpty():
            return out.drop("lack"), seed
        seed += 1


def _emitter(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within a task emit once; emptied when large, which only repeats rows
        for batch in chunks(batches, "text"):
            sigs, ids = [], []
            for s in sh.shingle_sets(batch.column("text").to_pylist()):
                i = sh.set_id(s)
                if not len(s) or i in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(i)
                sigs.append(sh.signatures(s, seed)[0])
                ids.append(np.full(len(sigs[-1]), i, np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(ids))], names=["sig", "sid"])

    return run


def _runs(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by signature and set: from each run its pairs, or ties to its first set.

        ``tied`` marks rows of longer runs, whose other pairs are still open.  Only the
        open run's first most + 1 sets are held, so a hot signature needs no more memory than another.
        """
        hold_sig, hold_sid = np.zeros(0, np.int64), np.zeros(0, np.int64)
        hub: tuple[int, int] | None = None  # signature and first set of an open run that is already long

        def ties(sig: np.ndarray, sid: np.ndarray, last: bool):
            nonlocal hub, hold_sig, hold_sid
            fresh = np.ones(len(sig), dtype=bool)
            fresh[1:] = (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])
            sig, sid = sig[fresh], sid[fresh]
            a, b, tied = [], [], []
            if hub is not None and len(sig):
                k = int(np.searchsorted(sig, hub[0], side="right"))
                rest = sid[:k][sid[:k] != hub[1]]
                a.append(np.full(len(rest), hub[1], np.int64))
                b.append(rest)
                tied.append(np.ones(len(rest), np.int64))
                if k < len(sig):
                    hub = None
                sig, sid = sig[k:], sid[k:]
            if len(sig):
                first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
                size = np.diff(np.append(first, len(sig)))
                if not last and size[-1] <= most:
                    hold_sig, hold_sid = sig[first[-1] :], sid[first[-1] :]
                    first, size = first[:-1], size[:-1]
                else:
                    hold_sig, hold_sid = sig[:0], sid[:0]
                    if not last:
                        hub = (int(sig[-1]), int(sid[first[-1]]))
                for c in range(2, most + 1):
                    at = first[size == c]
                    for i in range(c if len(at) else 0):
                        for j in range(i + 1, c):
                            a.append(sid[at + i])
                            b.append(sid[at + j])
                            tied.append(np.zeros(len(at), np.int64))
                long = size > most
                if long.any():
                    at, c = first[long], size[long]
                    a.append(np.repeat(sid[at], c - 1))
                    b.append(np.concatenate([sid[s + 1 : s + n] for s, n in zip(at, c, strict=True)]))
                    tied.append(np.ones(len(b[-1]), np.int64))
            else:
                hold_sig, hold_sid = sig, sid
            if a:
                pair = np.unique(np.stack([np.concatenate(a), np.concatenate(b), np.concatenate(tied)]), axis=1)
                if pair.shape[1]:
                    return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(pair[2] == 1)], names=["hub", "sid", "tied"])
            return None

        for batch in batches:
            sig = np.concatenate([hold_sig, batch.column("sig").to_numpy()])
            sid = np.concatenate([hold_sid, batch.column("sid").to_numpy()])
            out = ties(sig, sid, False)
            if out is not None:
                yield out
        out = ties(hold_sig, hold_sid, True)
        if out is not None:
            yield out

    return run


def neighbourhoods(docs: DataFrame, seed: int = 0, run: int = RUN) -> DataFrame:
    """(hub, sid, tied): every two linked sets are a row, or are both tied to one hub."""
    emitted = arrow_map(docs.where(F.col("doc_id").isNotNull()).select("text"), _emitter(seed), "sig long, sid long")
    runs = arrow_map(emitted.repartition("sig").sortWithinPartitions("sig", "sid"), _runs(run), "hub long, sid long, tied boolean")
    return written(runs.groupBy("hub", "sid").agg(F.max("tied").alias("tied")), "neighbourhoods")


def _level(n):
    """:func:`shingles.band` as a column."""
    return F.when(n < sh.SMALL, F.lit(0)).otherwise(F.length(F.bin(F.floor(n / sh.SMALL))))


def _unruled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches don't rule out a link."""
    for batch in batches:
        c = batch.to_pydict()
        keep = [bool(sh.may_link(n, np.frombuffer(x, np.uint64), np.array([m]), np.frombuffer(y, np.uint64)[None])[0]) for n, x, m, y in zip(c["na"], c["xa"], c["nb"], c["xb"], strict=True)]
        if any(keep):
            yield batch.select(["a", "b"]).filter(pa.array(keep))


def _short_or_hot(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by signature and set: the pairs (a, b) of short runs, and (a, null, level) for each row of a hot one.

        Of the open run at most ``most`` rows are held.
        """
        hold_sig, hold_sid = np.zeros(0, np.int64), np.zeros(0, np.int64)
        hot_sig: int | None = None  # signature of an open run that is already hot

        def told(sig: np.ndarray, sid: np.ndarray, last: bool):
            nonlocal hold_sig, hold_sid, hot_sig
            first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            size = np.diff(np.append(first, len(sig)))
            hot = size > most
            hot[0] |= hot_sig is not None and int(sig[0]) == hot_sig
            hot_sig, hold_sig, hold_sid = None, sig[:0], sid[:0]
            if not last and hot[-1]:
                hot_sig = int(sig[-1])
            elif not last:
                hold_sig, hold_sid = sig[first[-1] :], sid[first[-1] :]
                first, size, hot = first[:-1], size[:-1], hot[:-1]
            row = np.repeat(hot, size)
            a, b = [sid[: len(row)][row]], [np.full(int(row.sum()), -1, np.int64)]
            level = [sig[: len(row)][row] & ((1 << sh.LEVEL_BITS) - 1)]
            for c in range(2, most + 1):
                at = first[(size == c) & ~hot]
                for i in range(c if len(at) else 0):
                    for j in range(i + 1, c):
                        a.append(sid[at + i])
                        b.append(sid[at + j])
                        level.append(np.full(len(at), -1, np.int64))
            out = np.stack([np.concatenate(a), np.concatenate(b), np.concatenate(level)])
            if out.shape[1]:
                return pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1], mask=out[2] >= 0), pa.array(out[2].astype(np.int32), mask=out[2] < 0)], names=["a", "b", "level"])
            return None

        for batch in batches:
            sig = np.concatenate([hold_sig, batch.column("sig").to_numpy()])
            if len(sig) and (out := told(sig, np.concatenate([hold_sid, batch.column("sid").to_numpy()]), False)) is not None:
                yield out
        if len(hold_sig) and (out := told(hold_sig, hold_sid, True)) is not None:
            yield out

    return run


def _every_signature(seed: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        sigs, ids = [], []
        for sid, data in zip(batch.column("sid").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
            for _, _, sig in sh.all_signatures(np.frombuffer(data, np.uint64), seed):
                sigs.append(sig)
                ids.append(np.full(len(sig), sid, np.int64))
        if not sigs:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(ids))], names=["sig", "sid"])

    return run


def _spares(seed: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        shapes = [(sid, level, spare) for sid, data in zip(batch.column("sid").to_pylist(), batch.column("shingles").to_pylist(), strict=True) for level, spare, _ in sh.all_signatures(np.frombuffer(data, np.uint64), seed)]
        sid, level, spare = zip(*shapes, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(level, pa.int32()), pa.array(spare, pa.int32())], names=["sid", "level", "spare"])

    return run


def _with_partner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, level, n, sid): those that may be linked with one of another component, by their bit sketches."""
    key, held = None, []

    def marked() -> pa.RecordBatch | None:
        if len(held) < 2:
            return None
        sid, n, comp, own = (np.array([r[i] for r in held]) for i in range(4))
        words = np.ascontiguousarray(np.frombuffer(b"".join(r[4] for r in held), np.uint64).reshape(len(held), -1).T)
        end = np.searchsorted(n, n * sh.DEN // sh.NUM, side="right")
        out = np.zeros(len(held), dtype=bool)
        for i in np.flatnonzero(own & (end > np.arange(1, len(held) + 1))):  # the smaller of a pair has this level
            other = slice(i + 1, end[i])
            hit = (np.bitwise_count(words[:, other] ^ words[:, i : i + 1]).sum(axis=0, dtype=np.int64) <= (n[i] + n[other]) // 7) & (comp[other] != comp[i])
            if hit.any():
                out[i] = True
                out[other] |= hit
        found = sid[out]
        if not len(found):
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), key[0])), pa.array(np.full(len(found), key[1], np.int32)), pa.array(found)], names=["hub", "level", "sid"])

    for batch in batches:
        for *now, sid, n, comp, own, bits in zip(*(batch.column(c).to_pylist() for c in ("hub", "level", "sid", "n", "comp", "own", "bits")), strict=True):
            if now != key:
                if (out := marked()) is not None:
                    yield out
                key, held = now, []
            held.append((sid, n, comp, own, bits))
    if (out := marked()) is not None:
        yield out


class _Block:
    """Sets of one block: ids, sizes, components, whole contents and bit sketches at a level."""

    def __init__(self, rows: list[tuple[int, int, bytes]], level: int):
        self.sid = [r[0] for r in rows]
        self.comp = np.array([r[1] for r in rows], np.int64)
        self.sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        self.n = np.array([len(s) for s in self.sets])
        self.bits = np.stack([sh.bit_sketch(s, level) for s in self.sets])


def _joining(left: _Block, right: _Block) -> list[tuple[int, int]]:
    """Verified links between two blocks (or within one) that join components, found in order, each only while it joins."""
    links = []
    for i, s in enumerate(left.sets):
        hit = np.flatnonzero((right.comp != left.comp[i]) & sh.may_link(len(s), left.bits[i], right.n, right.bits))
        if left is right:
            hit = hit[hit > i]
        if not len(hit):
            continue
        for j in hit[sh.similar_to(s, [right.sets[j] for j in hit])]:
            mine, other = left.comp[i], right.comp[j]
            if mine != other:
                links.append((left.sid[i], right.sid[j]))
                for block in (left, right):
                    block.comp[block.comp == other] = mine
    return links


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, level, x, y): links between the blocks x and y of a hub's sets, or within one if they are equal."""
    key, held = None, {}

    def links() -> pa.RecordBatch | None:
        if key is None or len(held) < (2 if key[2] != key[3] else 1):
            return None
        blocks = [_Block(held[b], key[1]) for b in sorted(held)]
        found = _joining(blocks[0], blocks[-1])
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"]) if found else None

    for batch in batches:
        for *now, blk, sid, comp, data in zip(*(batch.column(c).to_pylist() for c in ("hub", "level", "x", "y", "blk", "sid", "comp", "shingles")), strict=True):
            if now != key:
                if (out := links()) is not None:
                    yield out
                key, held = now, {}
            held.setdefault(blk, []).append((sid, comp, data))
    if (out := links()) is not None:
        yield out


def _set_bytes(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = list(sh.shingle_sets(batch.column("text").to_pylist()))
    return pa.RecordBatch.from_arrays([pa.array([sh.set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sid", "shingles"])


def _true_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [sh.similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)]
        if any(keep):
            yield batch.select(["a", "b"]).filter(pa.array(keep))


def set_table(docs: DataFrame, prof: DataFrame, ids: DataFrame) -> DataFrame:
    """(sid, shingles) of the given set ids, recomputed from one text each; a written table."""
    need = written(prof.where(F.col("doc_id").isNotNull()).join(ids, "sid").groupBy("sid").agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "verify")
    sets = map_arrow(docs.select("doc_id", "text").join(need.distinct(), "doc_id", "left_semi"), _set_bytes, "sid long, shingles binary")
    return written(sets.join(ids, "sid", "left_semi").groupBy("sid").agg(F.first("shingles").alias("shingles")), "sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of set ids whose whole shingle sets reach the similarity; a written table."""
    both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("sid").alias("b"), F.col("shingles").alias("sb")), "b")
    return written(arrow_map(both.select("a", "b", "sa", "sb"), _true_links, "a long, b long"), "links")


def joining_links(members: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """Links that join components, among the sets (hub, level, sid, comp, shingles) that share hub and level; a written table.

    First each block by itself, then, for groups of several blocks that are still
    apart, the blocks against each other.
    """
    spec, keys = "a long, b long", ["hub", "level"]

    def found(rows: DataFrame) -> DataFrame:
        rows = rows.select("hub", "level", "x", "y", "blk", "sid", "comp", "shingles")
        return written(arrow_map(rows.repartition("hub", "level", "x", "y").sortWithinPartitions("hub", "level", "x", "y", "sid"), _blocks, spec), "joining")

    group = members.groupBy(*keys).agg(F.count("*").alias("size"), F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.ceil(F.sum(F.length("shingles")) / block).cast("int").alias("nb")).where("c1 != c2")
    rows = written(members.join(group.select(*keys, "nb"), keys).withColumn("blk", F.expr("cast(pmod(xxhash64(sid), nb) as int)")), "dense")
    links = found(rows.withColumns({"x": F.col("blk"), "y": F.col("blk")}))
    several = rows.where("nb > 1")
    if several.isEmpty():
        return links
    now = components(links.union(rows.select(F.col("sid").alias("a"), F.col("comp").alias("b"))))
    several = several.drop("comp").join(now.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("root", "sid")).drop("root")
    apart = several.groupBy(*keys).agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 != c2").select(*keys)
    several = several.join(apart, keys).withColumn("other", F.explode(F.expr("sequence(0, nb - 1)"))).where("other != blk")
    return links.union(found(several.withColumns({"x": F.least("blk", "other"), "y": F.greatest("blk", "other")})))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): its component's smallest node.

    Each round hangs every root below its smallest neighbouring root, follows the
    hangings twice and drops the links inside a tree, until none is left.
    """
    edges = written(links.where("a != b").distinct(), "edges")
    label = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root"))
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        up = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p"))
        for _ in range(2):
            over = up.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            up = up.join(over, "p", "left").select("a", F.coalesce("pp", "p").alias("p"))
        up = written(up, "parents")
        label = written(label.join(up.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "labels")
        edges = edges.join(up.select("a", F.col("p").alias("pa")), "a").join(up.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
        edges = written(edges.where("pa != pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges")
    return label


def labelled(docs: DataFrame, run: int = RUN, group: int = GROUP, block: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, sid, n_shingles and component_id of every row of ``docs`` (columns doc_id and text).

    ``run``, ``group`` and ``block`` change the work, not the result.
    """
    prof, seed = profiles(docs)
    around = neighbourhoods(docs, seed, run)
    known = prof.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    sizes = known.groupBy("sid").agg(F.first("n_shingles").alias("n"))
    # each set's sketch at its own level, and at the one below if it can meet a set there
    level, below = _level(F.col("n_shingles")), _level(F.ceil(F.col("n_shingles") * sh.NUM / sh.DEN))
    sketches = known.select("sid", level.alias("level"), F.lit(True).alias("own"), F.col("own").alias("bits")).union(known.where("low is not null").select("sid", below.alias("level"), F.lit(False), "low"))

    def with_sketch(pairs: DataFrame, side: str) -> DataFrame:
        """Adds ``x<side>``, the sketch of column ``side`` at the pair's level."""
        ids = pairs.select(F.col(side).alias("sid"), "level").distinct()
        own = sketches.join(ids, ["sid", "level"], "left_semi").groupBy("sid", "level").agg(F.first("bits").alias(f"x{side}"))
        return pairs.join(own.withColumnRenamed("sid", side), [side, "level"])

    def candidates(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that sizes and sketches don't rule out; a written table."""
        pairs = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").where(sh.DEN * F.least("na", "nb") >= sh.NUM * F.greatest("na", "nb"))
        pairs = written(pairs.withColumn("level", _level(F.least("na", "nb"))), "pairs")
        return written(arrow_map(with_sketch(with_sketch(pairs, "a"), "b").select("a", "b", "na", "nb", "xa", "xb"), _unruled, "a long, b long"), "candidates")

    first = candidates(around.select(F.col("hub").alias("a"), F.col("sid").alias("b")))
    links = verified(first, set_table(docs, prof, first.select(F.col("a").alias("sid")).union(first.select("b")).distinct()))
    comp = components(links)

    def with_component(rows: DataFrame, column: str, name: str) -> DataFrame:
        """Adds the component of a set id; a set without links is its own."""
        return rows.join(comp.select(F.col("node").alias(column), F.col("root")), column, "left").withColumn(name, F.coalesce("root", column)).drop("root")

    tied = around.where("tied").select("hub", "sid")
    tied = with_component(tied.union(tied.select("hub", F.col("hub").alias("sid")).distinct()), "sid", "comp")
    apart = (F.min("comp") != F.max("comp")).alias("apart")
    open_ = tied.groupBy("hub").agg(apart).where("apart").select("hub")
    levels = F.explode(F.array_distinct(F.array(_level(F.col("n")), _level(F.ceil(F.col("n") * sh.NUM / sh.DEN)))))
    members = tied.join(open_, "hub").join(sizes, "sid").withColumn("level", levels)
    members = written(members.select("hub", "level", "sid", "n", "comp", (F.col("level") == _level(F.col("n"))).alias("own")), "open")
    groups = members.groupBy("hub", "level").agg(apart, F.count("*").alias("size"), F.bool_or("own").alias("own")).where("apart and own")
    large = (F.col("size") > group) | (F.col("size") * F.pow(F.lit(2), F.col("level")) * (sh.sketch_words(0) * 8) > GROUP_BYTES)
    groups = groups.select("hub", "level", large.alias("large"))
    members = members.join(groups, ["hub", "level"])
    bits = sketches.groupBy("sid", "level").agg(F.first("bits").alias("bits"))
    small = members.where("not large").join(bits, ["sid", "level"]).repartition("hub", "level").sortWithinPartitions("hub", "level", "n", "sid")
    marked = written(arrow_map(small.select("hub", "level", "sid", "n", "comp", "own", "bits"), _with_partner, "hub long, level int, sid long"), "marked")
    big = members.where("large").select("hub", "level", "sid")
    if not big.isEmpty():
        sets = set_table(docs, prof, big.select("sid").distinct())
        every = map_arrow(sets, _every_signature(seed), "sig long, sid long", "shingles")
        met = written(arrow_map(every.repartition("sig").sortWithinPartitions("sig", "sid"), _short_or_hot(run), "a long, b long, level int").groupBy("a", "b", "level").count(), "met")
        pairs = with_component(with_component(met.where("b is not null").select("a", "b"), "a", "ca"), "b", "cb").where("ca != cb").select("a", "b")
        links = links.union(verified(candidates(pairs), sets))
        comp = components(links)
        hot = met.where("b is null").select(F.col("a").alias("sid"), "level", "count")
        spare = map_arrow(sets.join(hot.select("sid").distinct(), "sid", "left_semi"), _spares(seed), "sid long, level int, spare int", "shingles")
        dense = hot.join(spare, ["sid", "level"]).where("count > spare").select("sid", "level")
        marked = written(marked.union(big.join(dense, ["sid", "level"]).select("hub", "level", "sid")), "marked")
    if not marked.isEmpty():
        sets = set_table(docs, prof, marked.select("sid").distinct())
        comp = components(links.union(joining_links(with_component(marked, "sid", "comp").join(sets, "sid"), block)))

    per_set = known.groupBy("sid").agg(F.min("doc_id").alias("least"))
    per_set = per_set.join(comp.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "least", F.coalesce("root", "sid").alias("root"))
    least = per_set.groupBy("root").agg(F.min("least").alias("component_id"))
    label = written(per_set.join(least, "root").select("sid", "component_id"), "classes")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return prof.join(label, "sid", "left").select("doc_id", "sid", "n_shingles", own.cast("long").alias("component_id"))


def near_duplicates(docs: DataFrame, run: int = RUN, group: int = GROUP, block: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    return labelled(docs, run, group, block).select("doc_id", "n_shingles", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: one with the smallest id.

    Rows without words and rows with a null id stay.  Where an id occurs several
    times, each of its rows is judged by its own text.
    """
    rows = written(labelled(docs).where("doc_id is not null and n_shingles > 0"), "groups")
    repeated = written(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    losers = rows.where("component_id != doc_id").select("doc_id")
    if repeated.isEmpty():
        return docs.join(losers, "doc_id", "left_anti").select(*docs.columns)
    single = docs.join(repeated, "doc_id", "left_anti").join(losers, "doc_id", "left_anti").select(*docs.columns)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = sh.shingle_sets(batch.column("row").field("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array([sh.set_id(s) for s in sets], pa.int64())], names=["row", "sid"])

    schema = StructType([StructField("row", docs.schema), StructField("sid", LongType())])
    whole = docs.join(repeated, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"))
    whole = written(arrow_map(whole, lambda batches: map(run, batches), schema).withColumn("place", F.monotonically_increasing_id()), "rows")
    whole = whole.join(rows.select("sid", "component_id").distinct(), "sid", "left")
    first = whole.where("row.doc_id = component_id").groupBy("component_id").agg(F.min(F.struct("sid", "place")).alias("m")).select(F.col("m.place").alias("place"))
    kept = whole.join(first, "place", "left_semi").unionByName(whole.where("component_id is null"))
    return single.unionByName(kept.select("row.*"))
