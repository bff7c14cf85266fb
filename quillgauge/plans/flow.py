"""The batch pipeline: scan, match, score, gate, audit, classify, write."""

from __future__ import annotations

import argparse
import functools
import importlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.affix import ARABIC, Affixes
from ..operators.curation import with_sequence
from ..operators.gates import filter_clean, lite_scores
from ..operators.matching import find_candidates
from ..operators.taxonomy import LABELS
from ..sources.files import CANDIDATES, read_csv, read_patterns, write_csv
from .scorers import audit, classify

REQUIRED = ("source_en", "ar_ref", "mt_output")


def candidates(rows: DataFrame, patterns: DataFrame, mode: str = "affix", strict: bool = False, affixes: Affixes = ARABIC, compose: bool = True, gate: bool = True) -> DataFrame:
    """Scored candidates that pass the gate (without ``gate`` all of them, unscored), with a source_row_id if the rows have none."""
    if "source_row_id" not in rows.columns:
        rows = with_sequence(rows, "source_row_id", list(REQUIRED))
    hits = find_candidates(rows, patterns, mode, affixes, compose=compose)
    return filter_clean(lite_scores(hits), strict) if gate else hits


def run(rows: DataFrame, patterns: DataFrame, mode: str = "affix", strict: bool = False, judge: Callable | None = None, require_audit: bool = False, scorer: Callable | None = None, labels: tuple[str, ...] = (), affixes: Affixes = ARABIC, gate: bool = True, least: float = 0.75) -> DataFrame:
    """The pipeline's result in its fixed schema.

    Without ``gate`` every candidate stays, and its scores are null.  With
    ``require_audit`` only rows stay whose quality index reaches ``least``; without
    a judge that drops all of them.  Without a scorer labels are null and
    confidence is 0.
    """
    x = candidates(rows, patterns, mode, strict, affixes, gate=gate)
    if require_audit:
        x = audit(x, judge, least).where("accepted")
    if scorer is not None:
        x = classify(x, scorer, labels)
    else:
        x = x.withColumns({"predicted_label": F.lit(None).cast("string"), "confidence": F.lit(0.0)})
    fields = [f.split() for f in CANDIDATES.split(", ")]
    return x.select(*((F.col(n) if n in x.columns else F.lit(None).cast(t).alias(n)).cast(t).alias(n) for n, t in fields))


def distribution(result: DataFrame, k: int = 10) -> DataFrame:
    return result.groupBy("sub_subtype").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sub_subtype").limit(k)


def named(spec: str) -> Callable:
    """What ``package.module:name`` stands for; LookupError if it isn't there."""
    module, _, name = spec.partition(":")
    try:
        return getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError, ValueError) as e:
        raise LookupError(f"{spec} can't be found: {e}") from e


def main(args: list[str] | None = None) -> int:
    """The command line: 0 on success, 2 for unusable input, 3 if a scorer or judge can't be found."""
    p = argparse.ArgumentParser(description="Find, score and gate error candidates in sentence pairs.")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--patterns", required=True)
    p.add_argument("--mode", choices=["affix", "literal", "as_shipped"], default="affix")
    p.add_argument("--strict", action="store_true", help="the higher threshold of the gate")
    p.add_argument("--skip-gate", action="store_true", help="keep every candidate, unscored")
    p.add_argument("--label-map", help="JSON of label names and ids; names in order of ids are the scorer's labels")
    p.add_argument("--scorer", help="package.module:factory of the classifier; without it labels stay empty")
    p.add_argument("--checkpoint", help="handed to the factory as checkpoint")
    p.add_argument("--device", default="cpu", help="handed to the factory as device")
    p.add_argument("--batch-size", type=int, default=16, help="handed to the factory as batch_size")
    p.add_argument("--skip-classifier", action="store_true")
    p.add_argument("--audit", metavar="JUDGE", help="package.module:factory of a judge; only accepted rows stay")
    p.add_argument("--audit-min", type=float, default=0.75)
    p.add_argument("--bom", action="store_true", help="write a byte-order mark")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    try:
        rows = read_csv(spark, a.input, required=REQUIRED)
        patterns = read_patterns(spark, a.patterns)
        ids = json.loads("".join(r.value for r in spark.read.text(a.label_map, wholetext=True).collect())) if a.label_map else {}
    except (ValueError, AnalysisException) as e:
        print(e)
        return 2
    try:
        judge = named(a.audit) if a.audit else None
        made = None if a.skip_classifier or not a.scorer else functools.partial(named(a.scorer), checkpoint=a.checkpoint, device=a.device, batch_size=a.batch_size)
    except LookupError as e:
        print(e)
        return 3
    labels = tuple(sorted(ids, key=ids.get)) or LABELS
    result = run(rows, patterns, a.mode, a.strict, judge, judge is not None, made, labels, gate=not a.skip_gate, least=a.audit_min)
    write_csv(result, a.output, a.bom)
    distribution(result).show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
