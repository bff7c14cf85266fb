"""Model inputs, judge messages and prompts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import anchor_or_empty, anchor_or_omitted, col, strip


def _join(*parts: Column) -> Column:
    return F.concat_ws(" ", *(F.when(p != "", p) for p in parts))


def model_input(form: str, ref: str | Column, mt: str | Column, keyword: str | Column, match: str | Column) -> Column:
    """struct(text_a, text_b) in one of the input forms.

    A: reference and translation; B: reference, and translation with both anchors;
    C: translation alone; D: the anchors, and both texts (A without any anchor).
    """
    r, m = strip(F.coalesce(col(ref), F.lit(""))), strip(F.coalesce(col(mt), F.lit("")))
    k, b = anchor_or_empty(keyword), anchor_or_omitted(match)
    pair = lambda x, y: F.struct(x.alias("text_a"), y.alias("text_b"))
    if form == "A":
        return pair(r, m)
    if form == "B":
        return pair(r, _join(m, k, b))
    if form == "C":
        return pair(m, F.lit(None).cast("string"))
    if form == "D":
        return F.when(k != "", pair(_join(k, b), _join(r, m))).otherwise(pair(r, m))
    raise ValueError(f"unknown form {form!r}")


def shared_input(ref: str | Column, mt: str | Column, keyword: str | Column, match: str | Column) -> Column:
    """struct(anchor, context): the anchors without the sentinel, or the reference; and both texts."""
    r, m = strip(F.coalesce(col(ref), F.lit(""))), strip(F.coalesce(col(mt), F.lit("")))
    anchor = _join(anchor_or_empty(keyword), anchor_or_empty(match))
    return F.struct(F.when(anchor != "", anchor).otherwise(r).alias("anchor"), _join(r, m).alias("context"))


def ablation_input(form: str, ref: str | Column, mt: str | Column, keyword: str | Column, match: str | Column) -> Column:
    """Forms A and D of the ablation: D falls back to the reference as anchor."""
    r, m = strip(F.coalesce(col(ref), F.lit(""))), strip(F.coalesce(col(mt), F.lit("")))
    if form == "A":
        return F.struct(r.alias("text_a"), m.alias("text_b"))
    anchor = _join(anchor_or_empty(keyword), anchor_or_omitted(match))
    return F.struct(F.when(anchor_or_empty(keyword) != "", anchor).otherwise(r).alias("text_a"), _join(r, m).alias("text_b"))


def separated(a: str | Column, b: str | Column, mark: str = "[SEP]") -> Column:
    return F.concat_ws(f" {mark} ", col(a), col(b))


def judge_message(label="sub_subtype", keyword="keyword", match="best_match", ref="ar_ref", mt="mt_output", rule: str | Column | None = None) -> Column:
    """The message that asks a judge for five scores and a justification as JSON."""
    value = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit("\n"))
    # fixed values: the field names and the wording that judges have been calibrated with
    return F.concat(
        line("error_label", value(label)), line("keyword", value(keyword)), line("best_match", value(match)), line("clean_ar", value(ref)), line("error_ar", value(mt)),
        line("ocs_match_rule", F.lit("exact") if rule is None else value(rule)),
        F.lit("\nReturn your evaluation as a JSON object with keys: anchor_validity (1-5), phenomenon_clarity (1-5), arabic_naturalness (1-5), collateral_severity (1-5), seed_recommendation (1-5), justification (string)."),
    )


def classify_prompt(instructions: str, labels: tuple[str, ...], keyword: str | Column, match: str | Column, ref: str | Column, mt: str | Column, examples: str | Column | None = None) -> Column:
    """A zero-shot prompt, or a few-shot one with examples, that asks for exactly one class name."""
    k, b = col(keyword), col(match)
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit("\n"))
    parts = [F.lit(instructions + "\n\n" + "\n".join(f"- {x}" for x in labels) + "\n\n")]
    if examples is not None:
        parts.append(F.concat(F.lit("Examples:\n"), col(examples), F.lit("\n")))
    parts += [line("Keyword", k), line("Best_Match", b), line("Reference", col(ref)), line("MT Output", col(mt)), F.lit("\nAnswer with exactly one class name from the list.")]
    return F.concat(*parts)


def few_shot_example(label: str | Column, keyword: str | Column, match: str | Column, ref: str | Column, mt: str | Column) -> Column:
    """One worked example; anchors are cut at 80 characters and texts at 150."""
    cut = lambda c, n: F.substring(F.coalesce(col(c), F.lit("")), 1, n)
    return F.concat(
        F.lit("--- Example ("), col(label), F.lit(") ---\nKeyword: "), cut(keyword, 80), F.lit(" -> Became: "), cut(match, 80), F.lit("\nReference: "), cut(ref, 150),
        F.lit("\nMT Output: "), cut(mt, 150), F.lit("\nAnswer: "), col(label), F.lit("\n"),
    )
