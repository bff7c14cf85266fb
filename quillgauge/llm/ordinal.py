"""A quality classifier on graded ratings: ordinal cumulative-link regression over hashed text.

A rating is one of ordered grades.  One weight vector over ``BUCKETS`` hash
buckets is shared by all grades, and ordered thresholds part them:
``P(grade >= k) = sigmoid(score - threshold_k)``.  The score of a text is the
sum of the weights of its features: words and beginnings of words (letters
folded to lower case, punctuation at the ends dropped) that occur at least 1,
2, 4 or 8 times, and three bands: the shares of marked and of repeated words,
and the length.  Every text counts whole.

``fit`` learns from at most ``SAMPLE`` labelled documents, those whose ids come
first in hash order; that is the only bound, and it limits what reaches the
driver to ``SAMPLE`` rows of distinct buckets.  Buckets that no two grades
differ in are left out, and a weight is the less held back the more clearly
its bucket parts two grades.  Scoring covers every row.

Defined cases: a document with several label rows takes the lowest grade; rows
with a null label or id are not learned from; without two grades to tell apart
every document has the same score and stays; a null or wordless text has score
0; repeated rows are scored each by itself; an empty table gives an empty one; a
very long text is one row of work; extra columns stay as they are.
"""

from __future__ import annotations

import dataclasses
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks, map_arrow

BUCKETS = 1 << 18
SAMPLE = 12_000
#: A document is selected if it reaches the highest grade at least with this probability.
LEAST = 0.5
LEVELS = (1, 2, 4, 8)
BEGINNINGS = (4, 5, 6, 7)
#: Standard errors by which some two grades must differ in a bucket, and documents that must have it.
CLEAR, SEEN = 8.0, 5
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TRIM = ".,;:!?\"'()[]"
_BANDS = 64
#: What is known of a word without keys: it is marked, or it isn't.
_NONE = ((True, ()), (False, ()))
REMEMBERED = 100_000


def _place(key: str) -> int:
    return zlib.crc32(key.encode("utf-8", "surrogatepass")) % BUCKETS


def _at(place: int, level: int) -> int:
    """The bucket of a key's count level; the first buckets belong to the bands."""
    return _BANDS + (place + level * 65537) % (BUCKETS - _BANDS)


class Words:
    """Word -> (is marked, places of its keys), remembered within a bound; only keys with a live place are listed."""

    def __init__(self, live: np.ndarray | None = None):
        self.live, self.known = live, {}

    def __getitem__(self, word: str) -> tuple[bool, tuple[int, ...]]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            bare = word.strip(_TRIM)
            keys = [_place(bare)] if bare else []
            keys += [_place("^" + bare[:k]) for k in BEGINNINGS if len(bare) > k]
            if self.live is not None:
                keys = [k for k in keys if self.live[k]]
            got = self.known[word] = (not bare.isalnum(), tuple(keys)) if keys else _NONE[bare.isalnum()]
        return got

    def features(self, text: str | None) -> list[int]:
        """The buckets of a text, each once."""
        words = Counter(_WORD.findall((text or "").lower()))
        if not words:
            return []
        total = sum(words.values())
        marked, count = 0, {}
        for w, n in words.items():
            mark, keys = self[w]
            if mark:
                marked += n
            for k in keys:
                count[k] = count.get(k, 0) + n
        out = {int(15 * marked / total), 16 + int(15 * (1 - len(words) / total)), 32 + min(15, int(math.log2(total)))}
        for k, n in count.items():
            for i, least in enumerate(LEVELS):
                if n >= least:
                    out.add(_at(k, i))
        return sorted(out)


@dataclasses.dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... in columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - score[:, None], -60, 60)))

    def scorer(self):
        """A function from texts to scores, for one worker."""
        place = np.arange(BUCKETS)
        words = Words(np.any([self.weights[_at(place, i)] != 0 for i in range(len(LEVELS))], axis=0))
        return lambda texts: np.array([self.weights[words.features(t)].sum() for t in texts], float)


def grades(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 for poor quality, 1 for good but toxic, 2 for good and clean."""
    rated = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    grade = F.when(F.col("quality") < 1, 0).when(F.col("toxic") > 0, 1).otherwise(2)
    return rated.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in chunks(batches, "text"):
        f = [words.features(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("grade").cast(pa.int32()), pa.array([np.array(x, np.int32).tobytes() for x in f], pa.binary())], names=["doc_id", "grade", "f"])


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and grades of at most ``sample`` labelled documents, in hash order of their ids."""
    chosen = grades(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` ids
    got = arrow_map(rows, _sampled, "doc_id long, grade int, f binary").groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("f").alias("f"))
    got = got.toArrow().sort_by("doc_id")
    return [np.frombuffer(x, np.int32) for x in got.column("f").to_pylist()], got.column("grade").to_numpy()


def _clearness(rows: list[np.ndarray], grade: np.ndarray, classes: int) -> np.ndarray:
    """For each bucket the largest difference between two grades' shares of documents, in standard errors."""
    n = np.bincount(grade, minlength=classes)
    have = np.stack([np.bincount(np.concatenate([np.zeros(0, np.int64), *(r for r, x in zip(rows, grade, strict=True) if x == k)]), minlength=BUCKETS) for k in range(classes)])
    out = np.zeros(BUCKETS)
    for a in range(classes):
        for b in range(a + 1, classes):
            if n[a] and n[b]:
                share = (have[a] + have[b]) / (n[a] + n[b])
                error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n[a] + 1 / n[b]))
                z = np.abs(have[a] / n[a] - have[b] / n[b]) / error
                out = np.maximum(out, np.where(have[a] + have[b] >= SEEN, z, 0))
    return out


def fit_rows(rows: list[np.ndarray], grade: np.ndarray, classes: int = 3, steps: int = 300, decay: float = 1e-4, rate: float = 0.1) -> Model:
    """Adam on the mean negative log-likelihood of the cumulative-link model; gaps between thresholds stay positive as exponentials."""
    weights = np.zeros(BUCKETS)
    if len(np.unique(grade)) < 2:
        return Model(weights, np.full(classes - 1, -60.0))
    clear = _clearness(rows, grade, classes)
    who = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows).astype(np.int64)
    keep = clear[flat] > CLEAR
    used, flat = np.unique(flat[keep], return_inverse=True)
    who, n, w = who[keep], len(rows), len(used)
    scale = (clear[used] / 20) ** 2
    size = np.maximum(np.bincount(grade, minlength=classes), 1)
    each = np.sqrt(n / (classes * size))[grade] / n
    p = np.zeros(w + classes - 1)  # the weights over their scale, the first threshold, the logs of the gaps
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        score = np.bincount(who, weights=(p[:w] * scale)[flat], minlength=n)
        gaps = np.exp(p[w + 1 :])
        cut = np.cumsum(np.concatenate([p[w : w + 1], gaps]))
        tail = 1 / (1 + np.exp(np.clip(cut[None] - score[:, None], -60, 60)))
        upper = np.concatenate([np.ones((n, 1)), tail], axis=1)[np.arange(n), grade]
        lower = np.concatenate([tail, np.zeros((n, 1))], axis=1)[np.arange(n), grade]
        inside = np.maximum(upper - lower, 1e-12)
        up, down = each * upper * (1 - upper) / inside, each * lower * (1 - lower) / inside
        by_cut = np.array([up[grade == k + 1].sum() - down[grade == k].sum() for k in range(classes - 1)])
        after = np.cumsum(by_cut[::-1])[::-1]  # a threshold moves with all gaps below it
        g = np.concatenate([np.bincount(flat, weights=(down - up)[who], minlength=w) * scale + decay * p[:w], after[:1], after[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights[used] = np.round(p[:w] * scale, 6)
    return Model(weights, np.round(np.cumsum(np.concatenate([p[w : w + 1], np.exp(p[w + 1 :])])), 6))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    return fit_rows(*training_rows(docs, labels, sample))


def graded(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """Per row: doc_id, score, expected_grade, p_good (grade of 1 or more), p_best (the highest) and selected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights
    state: dict = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "f" not in state:
            state["f"] = shared.value.scorer()
        score = state["f"](batch.column("text").to_pylist())
        tails = shared.value.tails(score)
        cols = [pa.array(np.round(x, 9)) for x in (score, tails.sum(axis=1), tails[:, 0], tails[:, -1])]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *cols, pa.array(tails[:, -1] >= least)], names=["doc_id", "score", "expected_grade", "p_good", "p_best", "selected"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double, expected_grade double, p_good double, p_best double, selected boolean")


def selected(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` that reach the highest grade with the least probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, state = docs.columns.index("text"), {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "f" not in state:
            state["f"] = shared.value.scorer()
        tails = shared.value.tails(state["f"](batch.column(at).to_pylist()))
        return batch.filter(pa.array(tails[:, -1] >= least))

    return map_arrow(docs, run, docs.schema)
