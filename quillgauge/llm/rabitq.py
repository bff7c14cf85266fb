"""Approximate nearest neighbours by inner product, on randomly rotated one-bit codes.

A vector minus the centre is rotated by a seeded random orthogonal matrix and
kept as the signs of its coordinates, packed into bits, with two scalars: its
length and the inner product of its direction with its code.  A rotated query is
rounded to ``PLANES`` bits a coordinate and kept as as many bit planes, so that
its product with a code is a weighted sum of bit counts of ANDs.  With the
scalars this estimates the inner product, with an error of about
``length * |query| * sqrt((1 - a^2) / (a^2 * (dim - 1)))``, ``a`` being the second
scalar, and one of the query's rounding.  A vector whose estimate plus ``EPSILON``
such errors stays below the query's ``k``-th best score so far is left out; all
others are scored on the original vectors in double precision.

The centre is the mean of at most ``SAMPLE`` vectors, those first in hash order;
everything else covers every vector.  Vectors are coded once, into a written
table.  Queries reach the tasks in batches of at most ``QUERIES``, so a broadcast
has a fixed bound; a task holds and gives at most ``k`` rows for each query of a
batch.

Taking no part: null ids, and vectors that are null, all zero, hold null or
non-finite components or have another length than most.  A row never finds
rows with its own id.  Of rows that repeat a query id one, the least vector, asks;
repeated candidates are found each by itself.  Ties go to the smaller id.  An
empty table, or one without usable vectors, gives an empty one; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, written

EPSILON = 3.0
PLANES = 4
SAMPLE = 20_000
QUERIES = 16_384
BLOCK = 4096
_SUB = 128
_PAIRS = 1 << 16


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words, filled up with zeros."""
    data = np.packbits(bits, axis=1)
    return np.pad(data, ((0, 0), (0, -data.shape[1] % 8))).view(np.uint64)


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sign bits in 64-bit words, lengths, and inner products of directions with codes."""
    d = x.astype(np.float32) - centre
    length = np.linalg.norm(d, axis=1)
    y = (d @ turn) / np.maximum(length, 1e-30)[:, None]
    along = np.abs(y).sum(axis=1) / np.sqrt(x.shape[1])
    return _packed(y > 0), length.astype(np.float32), np.maximum(along, 1e-6).astype(np.float32)


def estimate(words: np.ndarray, length: np.ndarray, along: np.ndarray, dim: int, q: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates (queries by vectors) of the inner products from the packed bits, and one standard error of each."""
    y = q.astype(np.float32) @ turn
    low = y.min(axis=1, keepdims=True)
    step = np.maximum((y.max(axis=1, keepdims=True) - low) / ((1 << PLANES) - 1), 1e-30)
    rounded = np.rint((y - low) / step).astype(np.uint8)
    both = np.zeros((len(q), len(words)), np.int32)
    for j in range(PLANES):
        plane = _packed(rounded >> j & 1)
        for w in range(words.shape[1]):
            both += np.bitwise_count(plane[:, w, None] & words[None, :, w]).astype(np.int32) << j
    ones = np.bitwise_count(words).sum(axis=1, dtype=np.int32).astype(np.float32)
    code = 2 * (low * ones[None] + step * both) - (dim * low + step * rounded.sum(axis=1, keepdims=True, dtype=np.int32))  # with signs for bits
    scale = length / along / np.sqrt(dim)
    est = code * scale[None] + (q.astype(np.float32) @ centre)[:, None]
    spread = length * np.sqrt(np.maximum(1 - along**2, 0) / along**2 / max(dim - 1, 1))
    norm = np.linalg.norm(q, axis=1).astype(np.float32)[:, None]
    return est, np.sqrt((norm * spread[None]) ** 2 + (step * np.sqrt(dim / 12) * scale[None]) ** 2)


class Best:
    """The k best candidates of each query, by score and then by smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(q)
        who = np.concatenate([np.repeat(touched, self.k), q])
        s = np.concatenate([self.score[touched].ravel(), score])
        i = np.concatenate([self.ids[touched].ravel(), ids])
        order = np.lexsort((i, -s, who))
        who = who[order]
        first = np.searchsorted(who, touched)
        take = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.score[touched] = s[take].reshape(-1, self.k)
        self.ids[touched] = i[take].reshape(-1, self.k)


def search_block(best: Best, qid: np.ndarray, qvec: np.ndarray, ids: np.ndarray, x: np.ndarray, code: tuple, centre: np.ndarray, turn: np.ndarray) -> int:
    """Takes a block of candidates into ``best``; returns how many exact scores it needed."""
    dim, scored = x.shape[1], 0

    def exact(q: np.ndarray, c: np.ndarray) -> None:
        nonlocal scored
        other = ids[c] != qid[q]
        q, c = q[other], c[other]
        for a in range(0, len(q), _PAIRS):
            qq, cc = q[a : a + _PAIRS], c[a : a + _PAIRS]
            s = (qvec[qq] * x[cc].astype(np.float64)).sum(axis=1)
            worth = s >= best.score[qq, -1]
            if worth.any():
                best.add(qq[worth], s[worth], ids[cc[worth]])
            scored += len(qq)

    for lo in range(0, len(qid), _SUB):
        part = np.arange(lo, min(lo + _SUB, len(qid)))
        est, error = estimate(*code, dim, qvec[part], centre, turn)
        near = min(2 * best.k, len(ids))
        top = np.argpartition(-est, near - 1, axis=1)[:, :near]
        exact(np.repeat(part, near), top.ravel())
        est += EPSILON * error
        np.put_along_axis(est, top, -np.inf, axis=1)
        q, c = np.nonzero((est > -np.inf) & (est >= best.score[part, -1][:, None].astype(np.float32) - 1e-5))  # the nearest are in already
        exact(part[q], c)
    return scored


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of floats) of the rows that take part, apart from the length."""
    fine = F.forall("embedding", lambda v: F.coalesce((v == v) & ~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))) & F.exists("embedding", lambda v: v != 0)
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float32).reshape(-1, dim)


def coded(rows: DataFrame, dim: int, centre: np.ndarray, turn: np.ndarray) -> DataFrame:
    """vec_id, embedding, words (binary), length and along of every row; a written table."""

    def run(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces:
            for at in range(0, piece.num_rows, BLOCK):
                part = piece.slice(at, BLOCK)
                words, length, along = encode(_matrix(part.column("embedding"), dim), centre, turn)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("embedding"), pa.array([w.tobytes() for w in words], pa.binary()), pa.array(length), pa.array(along)], names=["vec_id", "embedding", "words", "length", "along"])

    return written(arrow_map(rows, run, "vec_id long, embedding array<float>, words binary, length float, along float"), "codes")


def _code(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = np.frombuffer(b"".join(piece.column("words").to_pylist()), np.uint64).reshape(piece.num_rows, -1)
    return words, piece.column("length").to_numpy(), piece.column("along").to_numpy()


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` largest inner products of each vector whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    out = "query_id long, vec_id long, score double"
    lengths = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return empty
    dim = lengths.dim
    rows = rows.where(F.size("embedding") == dim)
    sample = _matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(SAMPLE).select("embedding").toArrow().column("embedding").combine_chunks(), dim)
    centre, turn = sample.mean(axis=0, dtype=np.float64).astype(np.float32), rotation(dim)
    codes = coded(rows, dim, centre, turn)
    asking = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    batches = -(-asking.count() // QUERIES) * 2 - 1  # hashed batches differ in size; half of QUERIES on average
    parts = []
    for b in range(batches):
        got = (asking.where(F.pmod(F.xxhash64("vec_id"), F.lit(batches)) == b) if batches > 1 else asking).toArrow().sort_by("vec_id")
        for lo in range(0, got.num_rows, QUERIES):
            some = got.slice(lo, QUERIES)
            queries = spark.sparkContext.broadcast((some.column("vec_id").to_numpy(), _matrix(some.column("embedding").combine_chunks(), dim)))

            def run(pieces: Iterator[pa.RecordBatch], queries=queries) -> Iterator[pa.RecordBatch]:
                qid, qvec = queries.value
                qvec = qvec.astype(np.float64)
                best, seen = Best(len(qid), k), False
                for whole in pieces:
                    for at in range(0, whole.num_rows, BLOCK):
                        piece = whole.slice(at, BLOCK)
                        search_block(best, qid, qvec, piece.column("vec_id").to_numpy(), _matrix(piece.column("embedding"), dim), _code(piece), centre, turn)
                        seen = True
                if seen:
                    q, c = np.nonzero(np.isfinite(best.score))
                    for a in range(0, len(q), 1 << 16):
                        qq, cc = q[a : a + (1 << 16)], c[a : a + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array(qid[qq]), pa.array(best.ids[qq, cc]), pa.array(best.score[qq, cc])], names=["query_id", "vec_id", "score"])

            parts.append(arrow_map(codes, run, out))
    if not parts:
        return empty
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
