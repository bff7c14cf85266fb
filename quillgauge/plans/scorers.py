"""External models as Arrow-batched maps over pluggable callables.

A scorer or judge is made once per worker by a factory, so models load where
they run, and gets a batch of rows at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import judge_message
from ..operators.gates import accepted

Scores = Sequence[Sequence[float]]
SCORES = "anchor_validity int, phenomenon_clarity int, arabic_naturalness int, collateral_severity int, seed_recommendation int, justification string"


def classify(rows: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], Scores]], labels: Sequence[str]) -> DataFrame:
    """Adds predicted_id, predicted_label and confidence: the softmax's largest entry, the first of equals."""
    names = list(labels)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        scorer = factory()
        for f in frames:
            logits = np.asarray(scorer(f), dtype=float).reshape(len(f), len(names))
            e = np.exp(logits - logits.max(axis=1, keepdims=True)) if len(f) else logits
            p = e / e.sum(axis=1, keepdims=True) if len(f) else e
            best = p.argmax(axis=1) if len(f) else np.zeros(0, int)
            yield f.assign(predicted_id=best.astype("int32"), predicted_label=[names[i] for i in best], confidence=p[np.arange(len(f)), best] if len(f) else [])

    return rows.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", predicted_id int, predicted_label string, confidence double")


def embed(rows: DataFrame, text: str, factory: Callable[[], Callable[[list[str]], Scores]], name: str = "embedding") -> DataFrame:
    """Adds an array<float> column from an encoder of text batches; null texts give null."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = factory()
        for s in batches:
            known = s.notna()
            made = iter(encode(s[known].tolist()) if known.any() else [])
            yield pd.Series([list(map(float, next(made))) if k else None for k in known], index=s.index, dtype=object)

    return rows.withColumn(name, vectors(text))


def extract_spans(rows: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], Sequence[tuple[int, int]]]], text: str = "mt_output") -> DataFrame:
    """Adds span_start, span_end and span_text of a span extractor; an end before its start, or offsets outside the text, give nulls."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor = factory()
        for f in frames:
            spans = [(a, b) if isinstance(t, str) and 0 <= a <= b <= len(t) else (None, None) for (a, b), t in zip(extractor(f), f[text], strict=True)]
            said = [t[a:b].strip() if a is not None else None for (a, b), t in zip(spans, f[text], strict=True)]
            yield f.assign(span_start=pd.array([a for a, _ in spans], "Int32"), span_end=pd.array([b for _, b in spans], "Int32"), span_text=said)

    return rows.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", span_start int, span_end int, span_text string")


def audit(candidates: DataFrame, factory: Callable[[], Callable[[list[str]], list[str]]] | None, least: float = 0.75) -> DataFrame:
    """Adds the judge's scores, dqi, accepted and audit_skipped.

    Without a judge every row is marked as skipped and not accepted.  Answers are
    read as the JSON between their first and last brace; what can't be read counts as 0.
    """
    if factory is None:
        empty = [F.lit(None).cast("int").alias(c.split()[0]) for c in SCORES.split(", ")[:-1]] + [F.lit(None).cast("string").alias("justification")]
        return candidates.select("*", *empty, F.lit(0.0).alias("dqi"), F.lit(False).alias("accepted"), F.lit(True).alias("audit_skipped"))

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        judge = factory()
        for s in batches:
            yield pd.Series(judge(s.tolist()), index=s.index)

    answer = F.from_json(F.regexp_extract("__answer", "(?s)\\{.*\\}", 0), SCORES)
    x = candidates.withColumn("__answer", ask(judge_message())).withColumn("__s", answer)
    fields = [f.split()[0] for f in SCORES.split(", ")]
    x = x.select(*candidates.columns, *(F.coalesce(F.col(f"__s.{c}"), F.lit(0)).alias(c) for c in fields[:-1]), F.col(f"__s.{fields[-1]}"))
    return accepted(x, least).withColumn("audit_skipped", F.lit(False))


def rule_judge() -> Callable[[list[str]], list[str]]:
    """A deterministic judge for tests and dry runs: scores follow from the lengths of the message's fields."""

    def judge(messages: list[str]) -> list[str]:
        out = []
        for m in messages:
            n = len(m) % 5 + 1
            out.append("Scores: " + json.dumps({"anchor_validity": n, "phenomenon_clarity": 5, "arabic_naturalness": 4, "collateral_severity": 4, "seed_recommendation": n, "justification": f"length {len(m)}"}))
        return out

    return judge


def rule_scorer(checkpoint: str | None = None, device: str = "cpu", batch_size: int = 16) -> Callable[[pd.DataFrame], Scores]:
    """A deterministic scorer of two labels for tests and dry runs: the second leads by the batch size."""
    return lambda rows: [[0.0, float(batch_size)]] * len(rows)
