"""Rule-based integrity checks of data files; every check is a row (check_id, status, n_bad)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains, has_script

# How a pair was retrieved.
SUBSTITUTION_ERROR = "REF_HAS_KEYWORD_AND_MT_HAS_BESTMATCH"
SUBSTITUTION_CLEAN = "REF_HAS_KEYWORD_MT_MISSING_BESTMATCH"
OMISSION_CLEAN = "OMISSION_CONTEXT_REF_HAS_KW_MT_HAS_KW"
OMISSION_ERROR = "OMISSION_CONTEXT_REF_HAS_KW_MT_MISSING_KW"


def as_rows(one: DataFrame, checks: dict[str, str], warn: tuple[str, ...] = ()) -> DataFrame:
    """One row of failure counts as check rows; checks in ``warn`` warn instead of failing."""
    each = [F.struct(F.lit(name).alias("check_id"), F.when(F.col(c) == 0, "pass").otherwise("warn" if name in warn else "fail").alias("status"), F.col(c).cast("long").alias("n_bad")) for name, c in checks.items()]
    return one.select(F.inline(F.array(*each)))


def label_rule(label: str, labels: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose label isn't in the first column of ``labels``; nulls are no label."""
    known = labels.select(F.col(labels.columns[0]).alias(label)).distinct()
    return rows.where(F.col(label).isNotNull()).join(known, label, "left_anti")


def file_checks(rows: DataFrame, labels: DataFrame, key: str = "sample_id", label: str = "Sub-Subtype", ref: str = "ar", mt: str = "mt_output", keyword: str = "Keyword", script: str = "[\\u0600-\\u06FF]") -> DataFrame:
    """Unknown labels, repeated ids (n - 1 for each), blank texts, texts without the script, and (a warning) keywords missing in the reference."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    known = labels.select(F.col(labels.columns[0]).alias("__l"), F.lit(True).alias("__known")).distinct()
    x = rows.join(known, F.col(f"`{label}`") == F.col("__l"), "left")
    one = x.agg(
        F.count_if(F.col(f"`{label}`").isNotNull() & F.col("__known").isNull()).alias("labels"),
        (F.count(key) - F.countDistinct(key)).alias("ids"),
        F.count_if(blank(ref) | blank(mt)).alias("blank"),
        F.count_if(~blank(ref) & ~has_script(ref, script) | ~blank(mt) & ~has_script(mt, script)).alias("script"),
        F.count_if(~contains(ref, keyword)).alias("keyword"),
    )
    return as_rows(one, {"labels_known": "labels", "ids_unique": "ids", "texts_present": "blank", "texts_in_script": "script", "keyword_in_ref": "keyword"}, ("keyword_in_ref",))


def flagged_keywords(rows: DataFrame, ref: str = "ar", keyword: str = "Keyword") -> DataFrame:
    """The rows behind the keyword warning."""
    return rows.where(~contains(ref, keyword))


def signal_checks(rows: DataFrame, signal: str = "retrieval_signal", mt: str = "mt_output", keyword: str = "Keyword", match: str = "Best_Match") -> DataFrame:
    """What each retrieval signal promises about keyword and match in the translation; one pass of conditional counts."""
    k, m = contains(mt, keyword), contains(mt, match)
    s = F.col(signal)
    one = rows.agg(
        F.count_if((s == OMISSION_CLEAN) & ~k).alias("a"), F.count_if((s == SUBSTITUTION_CLEAN) & ~k).alias("b1"), F.count_if((s == SUBSTITUTION_CLEAN) & m).alias("b2"),
        F.count_if((s == OMISSION_ERROR) & k).alias("c"), F.count_if((s == SUBSTITUTION_ERROR) & ~m).alias("d"),
    )
    return as_rows(one, {"omission_no_error_kw_in_mt": "a", "substitution_no_error_kw_in_mt": "b1", "substitution_no_error_bm_absent": "b2", "omission_error_kw_absent": "c", "substitution_error_bm_in_mt": "d"})


def prediction_checks(preds: DataFrame, ids: DataFrame, label: str = "true_label", label_id: str = "true_label_id", most: int = 25) -> DataFrame:
    """Rows with an unknown label or an id that isn't the label's, at most ``most`` for a report."""
    want = ids.select(F.col(ids.columns[0]).alias(label), F.col("label_id").alias("__id"))
    bad = preds.join(want, label, "left").where(F.col("__id").isNull() | (F.col(label_id) != F.col("__id")))
    return bad.select(*preds.columns, F.col("__id").alias("expected_id")).orderBy(*preds.columns).limit(most)


def label_id_checks(rows: DataFrame, ids: DataFrame, tax: DataFrame, label: str, label_id: str = "label_id", category: str = "tqa_category") -> DataFrame:
    """A labelled file against the label map and taxonomy: R01 unknown labels, R02 wrong ids, R03 wrong categories."""
    from ..functions.text import fold_category

    want = ids.select(F.col(ids.columns[0]).alias("__l"), F.col("label_id").alias("__id"))
    cat = tax.select(F.col("class").alias("__l"), fold_category("tqa_category").alias("__c"))
    x = rows.join(want.join(cat, "__l"), F.col(f"`{label}`") == F.col("__l"), "left")
    one = x.agg(F.count_if(F.col("__l").isNull()).alias("a"), F.count_if(F.col("__l").isNotNull() & ~F.col(label_id).eqNullSafe(F.col("__id"))).alias("b"), F.count_if(F.col("__l").isNotNull() & ~fold_category(rows[category]).eqNullSafe(F.col("__c"))).alias("c"))
    return as_rows(one, {"R01": "a", "R02": "b", "R03": "c"})


def leak_check(train: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """G01: keys that train and held-out rows share."""
    shared = train.select(key).where(F.col(key).isNotNull()).distinct().join(held_out.select(key).distinct(), key, "left_semi")
    return as_rows(shared.agg(F.count("*").alias("n")), {"G01": "n"})


def text_rules(docs: DataFrame, rules: dict[str, Column], text: str = "text") -> DataFrame:
    """Documents by named rules over their text: (check_id, status, n_bad), where n_bad counts documents that fail."""
    one = docs.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()))
    return as_rows(one, {name: name for name in rules}, tuple(rules))


def mentions(text: str, *parts: str) -> Column:
    """All parts occur literally."""
    out = F.lit(True)
    for p in parts:
        out = out & contains(text, F.lit(p))
    return out


def verdict(report: DataFrame, strict: bool = False) -> DataFrame:
    """Counts of each status and the exit code: 1 with a failure, or with a warning if strict."""
    n = {s: F.count_if(F.col("status") == s) for s in ("pass", "fail", "warn")}
    bad = n["fail"] + (n["warn"] if strict else F.lit(0))
    return report.agg(*(v.alias(f"n_{k}") for k, v in n.items()), F.when(bad > 0, 1).otherwise(0).alias("exit_code"))
