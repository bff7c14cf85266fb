"""Sources and sinks: byte-order-tolerant CSV, JSON, patterns, rubric, text and reports."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "﻿"

CANDIDATES = "source_row_id long, sub_subtype string, keyword string, best_match string, ar_ref string, mt_output string, source_en string, ocs int, cps_proxy double, sfr_proxy double, mpqs_lite double, accepts_basic boolean, predicted_label string, confidence double"


def read_csv(spark: SparkSession, path: str, schema: str | None = None, required: Iterable[str] = ()) -> DataFrame:
    """A CSV file with header, quoted line breaks and perhaps a byte-order mark; all columns are strings without a schema."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8")
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    first = df.columns[0]
    if first.startswith(BOM):
        df = df.withColumnRenamed(first, first.lstrip(BOM).strip('"'))
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks columns: {missing}")
    return df


def read_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One column as strings; KeyError if there is none of that name."""
    df = read_csv(spark, path)
    if column not in df.columns:
        raise KeyError(column)
    return df.select(column)


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file as one string."""
    return spark.read.text(path, wholetext=True).first()[0]


def read_json(spark: SparkSession, path: str):
    """A small JSON file as Python values."""
    return json.loads(read_text(spark, path).lstrip(BOM))


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(sub_subtype, keyword, best_match) from a JSON object of lists by class."""
    return flat_patterns(spark.read.text(path, wholetext=True).select(F.col("value").alias("json")))


def flat_patterns(raw: DataFrame, column: str = "json") -> DataFrame:
    kinds = "map<string,array<struct<keyword:string,best_match:string>>>"
    entries = raw.select(F.explode(F.from_json(F.ltrim(column), kinds)).alias("sub_subtype", "items"))
    return entries.select("sub_subtype", F.explode("items").alias("p")).select("sub_subtype", "p.keyword", "p.best_match")


def first_existing(spark: SparkSession, paths: Iterable[str]) -> str:
    """The first path that exists, on any file system Spark reads."""
    tried = []
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            return p
        tried.append(p)
    raise FileNotFoundError(f"none of these exists: {tried}")


def merged_config(base: dict, override: dict) -> dict:
    """Nested settings, the override's values in place of the base's."""
    out = dict(base)
    for k, v in override.items():
        out[k] = merged_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(spark: SparkSession, *paths: str) -> dict:
    """JSON (or, where PyYAML is installed, YAML) files, later ones overriding earlier ones."""
    out: dict = {}
    for p in paths:
        text = read_text(spark, p)
        if p.endswith((".yaml", ".yml")):
            import yaml

            out = merged_config(out, yaml.safe_load(text) or {})
        else:
            out = merged_config(out, json.loads(text))
    return out


def resolve(df: DataFrame, *names: str, required: bool = True) -> str | None:
    """The first of several names that the table has."""
    found = next((n for n in names if n in df.columns), None)
    if found is None and required:
        raise KeyError(f"none of {names} in {df.columns}")
    return found


def aliased(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns under their standard names, whichever alias the file uses; a name without a column is null."""
    taken = {name: resolve(df, name, *others, required=False) for name, others in aliases.items()}
    rest = [c for c in df.columns if c not in taken.values()]
    made: list[Column] = [(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(n) for n, c in taken.items()]
    return df.select(*made, *(F.col(f"`{c}`") for c in rest))


#: Standard names of validator input and the names that files use for them.
VALIDATOR_ALIASES = {"clean_ar": ("ar", "clean_ar"), "error_ar": ("mt_output", "error_ar"), "error_type": ("Sub-Subtype", "error_type"), "keyword": ("Keyword", "keyword"), "best_match": ("Best_Match", "best_match")}


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with a header, also for an empty table; arrays are joined by commas, failed constraints by semicolons."""
    flat = [F.array_join(c, ";" if c == "ocs_failed_constraints" else ",").alias(c) if kind.startswith("array") else F.col(f"`{c}`") for c, kind in df.dtypes]
    out = df.select(*flat)
    if bom:
        out = out.withColumnRenamed(out.columns[0], BOM + out.columns[0])
    out.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def empty_candidates(spark: SparkSession) -> DataFrame:
    """The result table without rows: its header stays."""
    return spark.createDataFrame([], CANDIDATES)


def update_metrics(spark: SparkSession, path: str, new: DataFrame, keys: list[str], to: str) -> DataFrame:
    """Metrics of a file with the new ones put in place, written to another folder and returned."""
    from ..operators.curation import latest

    old = spark.read.schema(new.schema).parquet(path)
    latest(old, new, keys).write.mode("overwrite").parquet(to)
    return spark.read.schema(new.schema).parquet(to)
