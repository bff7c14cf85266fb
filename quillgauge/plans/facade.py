"""A small object API over the operators, for whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.affix import ARABIC, Affixes
from ..functions.text import normalize
from ..operators import gates
from ..operators.matching import occurs
from ..operators.taxonomy import default_rubric, rubric_table, taxonomy
from ..sources.files import read_csv
from .scorers import audit, classify


class Gauge:
    """Normalisation, matching, regimes and validation under one rubric and one language's affixes."""

    def __init__(self, spark: SparkSession, rubric_path: str | None = None, affixes: Affixes = ARABIC):
        self.spark, self.affixes = spark, affixes
        self.rubric = rubric_table(read_csv(spark, rubric_path)) if rubric_path else default_rubric(spark)

    def normalize(self, rows: DataFrame, column: str, strip_diacritics: bool = False) -> DataFrame:
        return rows.withColumn(f"{column}_norm", normalize(column, strip_diacritics))

    def match(self, rows: DataFrame, keyword: str, target: str) -> DataFrame:
        return rows.withColumn("matched", occurs(keyword, target, self.affixes))

    def regime(self, rows: DataFrame, error_type: str = "error_type") -> DataFrame:
        return rows.withColumns({"regime": gates.regime(error_type), "cps_floor": gates.cps_floor(error_type)})

    def validate(self, rows: DataFrame, sfr: str | None = None) -> DataFrame:
        return gates.composite(rows, sfr=sfr, affixes=self.affixes)

    def validate_all(self, rows: DataFrame, sfr: str = "sfr") -> dict[str, DataFrame]:
        return gates.routed(gates.validate(rows, self.rubric, sfr, affixes=self.affixes))


class Classifier:
    """A pluggable scorer with its labels."""

    def __init__(self, factory, labels):
        self.factory, self.labels = factory, tuple(labels)

    def predict(self, rows: DataFrame) -> DataFrame:
        return classify(rows, self.factory, self.labels)


class Auditor:
    """A pluggable judge with its least quality index."""

    def __init__(self, factory=None, least: float = 0.75):
        self.factory, self.least = factory, least

    def audit(self, rows: DataFrame) -> DataFrame:
        return audit(rows, self.factory, self.least)


def taxonomy_map(spark: SparkSession) -> dict[str, dict]:
    """The taxonomy by class name."""
    return {r["class"]: r.asDict() for r in taxonomy(spark).collect()}  # a row for each class


def load_pool(spark: SparkSession, path: str) -> DataFrame:
    """A pool of labelled samples as it is in its file, with the path it came from."""
    return read_csv(spark, path).withColumn("loaded_from", F.lit(path))
