"""Scoring and counting over streams.

Matching, scoring and gating keep no state, so they are the batch operators on
a streaming table; only the counts need a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.affix import ARABIC, Affixes
from ..operators.gates import filter_clean, lite_scores
from ..operators.matching import find_candidates


def file_stream(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files) if files else r).parquet(path)


def gate_stream(pairs: DataFrame, patterns: DataFrame, mode: str = "affix", strict: bool = False, affixes: Affixes = ARABIC) -> DataFrame:
    """Candidates of arriving sentence pairs that pass the gate; ``patterns`` is a static table."""
    return filter_clean(lite_scores(find_candidates(pairs, patterns, mode, affixes)), strict)


def windowed_counts(events: DataFrame, ts: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows by window and key; rows later than the watermark are dropped."""
    w = F.window(ts, window)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what is there, exactly once, and ends."""
    return df.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode(mode).trigger(availableNow=True).start()
