"""What the operators share: reading tables, the shared folder, and Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir, written  # noqa: F401  (the operators take them from here)

#: Bytes of text that a Python worker handles at a time.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch on its way to a worker; a single larger row still passes.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with its scheme, as Spark itself resolves it: a bare path lies on the default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
    return re.sub(r"^file:/(?!/)", "file:///", full)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of one string column, so that long texts don't add up."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        offsets = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy(zero_copy_only=False)
        while at < n:
            base = offsets[at - 1] if at else 0
            end = max(at + 1, int(offsets.searchsorted(base + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def _trim() -> None:
    """Gives freed memory back to the system: workers live on, and the next stage needs the room."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _bytes(setting: str) -> float:
    """A size such as 64m, 1g or 2097152b in bytes; -1 is unlimited."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", setting.lower()).groups()
    return float("inf") if int(number) < 0 else int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}[unit[:1]]


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes and memory given back after each task.

    Spark reads the bound when the plan runs, so a larger setting of the session is lowered for good.
    """
    conf = df.sparkSession.conf
    if _bytes(conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            _trim()

    return df.mapInArrow(run, schema)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text") -> DataFrame:
    """Maps slices of bounded text volume; ``fn`` gets a record batch and returns one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, text):
            out = fn(piece)
            if out is not None:
                yield out

    return arrow_map(df, run, schema)


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Where a public vocabulary file lies: in ``folder``, or where the installed package has it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
