"""Constraint checks, rubric gates, quality tiers and routing, as expressions over one pass of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.affix import ARABIC, Affixes, count_matches
from ..functions.text import OMITTED, col, has_script, normalize, remove_all, strip, tokens, word_set

# The classes that each regime and list holds, and the floors.
REGIME_D = ("Meaning Shift",)
STRUCTURE_TOLERANT = ("Wrong Word Order", "Wrong Structure", "Active to Passive Voice", "Passive to Active Voice", "Perfective to Progressive", "Progressive to Perfective", "Tense Shift Under Negation")
FIDELITY = (
    "Tanween Omission", "Spelling Error", "Gender Disagreement", "Definiteness Shift", "Register Mismatch", "Active to Passive Voice", "Passive to Active Voice",
    "Perfective to Progressive", "Progressive to Perfective", "Tense Shift Under Negation", "Wrong Structure", "Wrong Word Order", "Noun to Adjective", "Adjective to Noun",
)
OMISSIONS = ("Total Omission", "Partial Translation")
CPS_FLOOR, CPS_FLOOR_TOLERANT, CPS_TIER_A = 0.55, 0.45, 0.65
FATAL = ("empty_field", "identical_sentences", "non_arabic", "metric_calculation_failed")
DEFAULT_WEIGHTS = (0.33, 0.34, 0.33)


def regime(error_type: str | Column) -> Column:
    """D for controlled meaning shifts, F for everything else, unknown classes included."""
    return F.when(F.coalesce(col(error_type).isin(*REGIME_D), F.lit(False)), "D").otherwise("F")


def cps_floor(error_type: str | Column) -> Column:
    return F.when(F.coalesce(col(error_type).isin(*STRUCTURE_TOLERANT), F.lit(False)), CPS_FLOOR_TOLERANT).otherwise(CPS_FLOOR)


def quality_tier(cps: str | Column, reg: str | Column) -> Column:
    """A or B by context preservation under regime F (null below B), always B under D."""
    cps, reg = col(cps), col(reg)
    return F.when(reg == "D", "B").when(cps >= CPS_TIER_A, "A").when(cps >= CPS_FLOOR, "B")


def reject_reason(csr, ocs, sfr, cps, rubric: str = "rubric") -> Column:
    """The first rule of a joined rubric row (a struct, null for an unknown class) that the metrics break, or null.

    NaN counts as out of range.  Regime F looks at the context and semantic
    floors only, regime D at the inverted similarity maximum and the semantic range.
    """
    m = [col(x).cast("double") for x in (csr, ocs, sfr, cps)]
    r = F.col(rubric)
    missing, outside = F.lit(False), F.lit(False)
    for x in m:
        missing, outside = missing | x.isNull(), outside | F.isnan(x) | (x < 0) | (x > 1)
    c, o, s, p = m
    return (
        F.when(r.isNull(), "unknown_error_type")
        .when(missing, "missing_metric")
        .when(outside, "metric_out_of_range")
        .when(o < 1.0, "ocs_failed")
        .when((r["regime"] == "F") & (p < r["cps_floor"]), "cps_below_floor")
        .when((r["regime"] == "F") & (s < r["min_sfr"]), "sfr_below_floor")
        .when(r["regime"] == "F", F.lit(None))
        .when((F.coalesce(r["max_csr"], F.lit(1.0)) < 1.0) & (c > r["max_csr"]), "csr_exceeds_maximum")
        .when(s < r["min_sfr"], "sfr_below_minimum")
        .when(s > r["max_sfr"], "sfr_above_maximum")
    )


def with_rubric(rows: DataFrame, rubric: DataFrame, error_type: str = "error_type") -> DataFrame:
    """Adds the rubric's row as a struct, null where the class is unknown."""
    side = rubric.select(F.col("error_type").alias("__class"), F.struct(*rubric.columns).alias("rubric"))
    return rows.join(side, rows[error_type] == side["__class"], "left").drop("__class")


def constraints(rows: DataFrame, clean: str = "clean_ar", error: str = "error_ar", keyword: str = "keyword", match: str = "best_match", error_type: str = "error_type", affixes: Affixes = ARABIC, compose: bool = True) -> DataFrame:
    """Adds ``ocs`` (1 or 0), ``ocs_failed_constraints`` in order of the checks, and the nine diagnostics.

    The keyword must be in the clean text, less often or not at all in the other,
    and the match in the other text; omissions want "[OMITTED]" instead.  A count
    of zero is tried again without diacritics.
    """
    raw_k, raw_m, kind = strip(F.coalesce(F.col(keyword), F.lit(""))), strip(F.coalesce(F.col(match), F.lit(""))), strip(F.coalesce(F.col(error_type), F.lit("")))
    norm = lambda c, bare=False: normalize(c, bare, compose)
    toks = lambda c, bare=False: tokens(norm(c, bare))
    blank = lambda c: strip(F.coalesce(F.col(c), F.lit(""))) == ""
    keep = rows.columns
    x = rows.withColumns({"__k": raw_k, "__m": raw_m, "__e": kind})
    x = x.withColumns({
        "__stop": F.when(blank(clean) | blank(error), F.array_compact(F.array(F.when(blank(clean), "clean_ar_empty"), F.when(blank(error), "error_ar_empty"))))
        .when((F.col("__k") == "") | (F.col("__m") == ""), F.array_compact(F.array(F.when(F.col("__k") == "", "keyword_missing"), F.when(F.col("__m") == "", "best_match_missing")))),
        "__kn": norm("__k"), "__kd": norm("__k", True), "__ct": toks(clean), "__cd": toks(clean, True), "__et": toks(error), "__ed": toks(error, True),
        "__mn": F.when(F.col("__m") == OMITTED, OMITTED).otherwise(norm("__m")), "__md": norm("__m", True),
    })
    x = x.withColumns({f"{c}t": tokens(c) for c in ("__kn", "__kd", "__mn", "__md")})
    x = x.withColumns({"__c0": count_matches("__ct", "__knt", affixes), "__c1": count_matches("__cd", "__kdt", affixes)})
    x = x.withColumn("__kr", (F.col("__c0.n") < 1) & (F.col("__c1.n") >= 1))
    x = x.withColumns({"__c": F.when(F.col("__kr"), F.col("__c1")).otherwise(F.col("__c0")), "__kw": F.when(F.col("__kr"), F.col("__kd")).otherwise(F.col("__kn")), "__kwt": F.when(F.col("__kr"), F.col("__kdt")).otherwise(F.col("__knt")), "__er": F.when(F.col("__kr"), F.col("__ed")).otherwise(F.col("__et"))})
    x = x.withColumns({"__ke": count_matches("__er", "__kwt", affixes), "__b0": count_matches("__er", "__mnt", affixes), "__b1": count_matches("__ed", "__mdt", affixes)})
    omission, omitted = F.col("__e").isin(*OMISSIONS), F.col("__mn") == OMITTED
    x = x.withColumn("__br", ~omission & ~omitted & (F.col("__b0.n") < 1) & (F.col("__b1.n") >= 1))
    n, e, b = F.col("__c.n"), F.col("__ke.n"), F.when(F.col("__br"), F.col("__b1.n")).otherwise(F.col("__b0.n"))
    text = lambda name, *parts: F.concat(F.lit(name), *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    say = lambda v: v.cast("string")
    reduced = text("keyword_not_reduced_in_error_clean", say(n), "_err", say(e))
    present = text("keyword_present_in_error_", say(e))
    total = F.col("__e") == "Total Omission"
    failures = F.array_compact(F.array(
        F.when(n < 1, text("keyword_absent_in_clean_", say(n))),
        F.when(omission & ~omitted, "omission_best_match_not_OMITTED"),
        F.when(omission & total & (e != 0), present),
        F.when(omission & ~total & (n >= 1) & (e >= n), reduced),
        F.when(~omission & (n == 1) & (e != 0), present),
        F.when(~omission & (n > 1) & (e >= n), reduced),
        F.when(~omission & omitted, "best_match_OMITTED_for_non_omission"),
        F.when(~omission & ~omitted & (b < 1), text("best_match_absent_in_error_", say(F.col("__b0.n")))),
    ))
    go = F.col("__stop").isNull()
    sought = ~omission & ~omitted
    return x.withColumn("ocs_failed_constraints", F.coalesce("__stop", failures)).select(
        *keep,
        F.when(F.size("ocs_failed_constraints") == 0, 1.0).otherwise(0.0).alias("ocs"),
        "ocs_failed_constraints",
        F.when(go, n).otherwise(0).alias("kw_count_clean_tok"),
        F.when(go, e).otherwise(0).alias("kw_count_error_tok"),
        F.when(go & sought, b).otherwise(0).alias("bm_count_error_tok"),
        F.when(go & (F.col("__kr") | F.col("__br")), "diacritics").otherwise("light").alias("ocs_norm_level"),
        F.when(go, F.col("__kw")).otherwise("").alias("kw_norm"),
        F.when(go, F.when(F.col("__br"), F.col("__md")).otherwise(F.col("__mn"))).otherwise("").alias("bm_norm"),
        F.when(go & F.col("__kr") & F.col("__br"), "both").when(go & F.col("__kr"), "kw_diac").when(go & F.col("__br"), "bm_diac").otherwise("").alias("ocs_rescued_by"),
        F.when(go, F.col("__c.rule")).otherwise("").alias("ocs_match_rule_kw"),
        F.when(go & sought, F.when(F.col("__br"), F.col("__b1.rule")).otherwise(F.col("__b0.rule"))).otherwise("").alias("ocs_match_rule_bm"),
    )


def validate(rows: DataFrame, rubric: DataFrame, sfr: str = "sfr", script: str = "[\\u0600-\\u06FF]", affixes: Affixes = ARABIC, compose: bool = True) -> DataFrame:
    """The full validator and router over clean_ar, error_ar, keyword, best_match, error_type and a semantic score.

    One pass adds the metrics, the clean verdict, the tier, flags of either track
    and the bucket: "clean", "noisy" (the clean standard is broken; passed stays
    true there, as reports expect) or "discarded" (a fatal reason).
    """
    clean, error = F.col("clean_ar"), F.col("error_ar")
    x = constraints(with_rubric(rows, rubric), affixes=affixes, compose=compose)
    fatal = (
        F.when((F.coalesce(clean, F.lit("")) == "") | (F.coalesce(error, F.lit("")) == ""), "empty_field")
        .when(strip(clean) == strip(error), "identical_sentences")
        .when(~has_script(error, script), "non_arabic")
    )
    x = x.withColumns({"__fatal": fatal, "csr": M.char_similarity(clean, error), "cps": M.context_preservation(clean, error, "keyword", "best_match"), "sfr": F.col(sfr).cast("double"), "regime": regime("error_type")})
    lost = F.col("csr").isNull() | F.col("sfr").isNull() | F.col("cps").isNull()
    x = x.withColumn("__fatal", F.coalesce("__fatal", F.when(lost, "metric_calculation_failed")))
    known = F.col("rubric").isNotNull()
    weights = tuple(F.when(known, F.col(f"rubric.weight_{m}")).otherwise(w) for m, w in zip(("csr", "ocs", "sfr"), DEFAULT_WEIGHTS, strict=True))
    x = x.withColumns({"__mpqs": M.weighted_harmonic("csr", "ocs", "sfr", weights), "mpqs_normalized": M.normalized_harmonic("csr", "ocs", "sfr", weights), "__reason": reject_reason("csr", "ocs", "sfr", "cps")})
    x = x.withColumns({"mpqs": F.when(F.col("__fatal").isNull(), F.coalesce("__mpqs", F.lit(0.0))).otherwise(0.0), "bucket": F.when(F.col("__fatal").isNotNull(), "discarded").when(F.col("__reason").isNull(), "clean").otherwise("noisy")})
    bucket, q = F.col("bucket"), F.col("mpqs")
    flags = F.array_compact(F.array(
        F.when((bucket == "discarded") & (F.col("__fatal") == "metric_calculation_failed"), "metric_error").when(bucket == "discarded", "fatal_error"),
        F.when((bucket != "discarded") & F.col("__mpqs").isNull(), "mpqs_calculation_failed"),
        F.when((bucket == "clean") & (q < 0.70), "low_mpqs"),
        F.when((bucket == "noisy") & known, "violates_clean_standard"),
        F.when((bucket == "noisy") & (q < 0.50), "low_quality_suspected"),
        F.when((bucket == "noisy") & (q < 0.40), "multi_error_suspected"),
    ))
    zero = lambda c: F.when((bucket == "discarded") & (F.col("__fatal") != "metric_calculation_failed"), 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
    return x.withColumns({
        "passed": bucket != "discarded",
        "reject_reason": F.when(bucket == "discarded", F.col("__fatal")).when(known | (bucket == "clean"), F.col("__reason")),
        "csr": zero(F.col("csr")), "sfr": zero(F.col("sfr")), "cps": zero(F.col("cps")), "ocs": zero(F.col("ocs")),
        "mpqs_mode": F.when(F.col("error_type").isin(*FIDELITY) & (bucket != "discarded"), "score").otherwise("diagnostic"),
        "quality_tier": F.when(bucket == "clean", quality_tier("cps", "regime")),
        "flags": flags,
        "cps_threshold": F.coalesce(F.col("rubric.cps_floor"), cps_floor("error_type")),
        "sfr_threshold_min": F.coalesce(F.col("rubric.min_sfr"), F.lit(0.40)),
        "sfr_threshold_max": F.coalesce(F.col("rubric.max_sfr"), F.lit(1.0)),
    }).drop("__fatal", "__mpqs", "__reason", "rubric")


def routed(validated: DataFrame) -> dict[str, DataFrame]:
    """The five result sets of the router: filters on one validated table, so nothing is computed twice if it is persisted."""
    clean = validated.where("bucket = 'clean'")
    return {"clean": clean, "clean_a": clean.where("quality_tier = 'A'"), "clean_b": clean.where("quality_tier = 'B'"), "noisy": validated.where("bucket = 'noisy'"), "discarded": validated.where("bucket = 'discarded'")}


def routing_stats(validated: DataFrame) -> DataFrame:
    """Totals and rates of the buckets and tiers in one row; rates are 0 without rows."""
    n = F.count("*")
    count = lambda cond: F.count_if(F.expr(cond))
    out = validated.agg(
        n.alias("total"), count("bucket = 'clean'").alias("clean"), count("quality_tier = 'A'").alias("clean_a"), count("quality_tier = 'B'").alias("clean_b"),
        count("bucket = 'noisy'").alias("noisy"), count("bucket = 'discarded'").alias("discarded"),
    )
    rate = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), F.col("total")), F.lit(0.0)), 4)
    return out.select("*", rate("clean").alias("clean_rate"), rate("noisy").alias("noisy_rate"), rate("discarded").alias("discard_rate"))


def counters(validated: DataFrame) -> DataFrame:
    """(counter, value, n): rules, rescues, regimes, tiers, reasons and failed constraints, in one long table."""
    one = lambda name, c: F.struct(F.lit(name).alias("counter"), c.cast("string").alias("value"))
    singles = F.array(*(one(n, F.col(n)) for n in ("ocs_match_rule_kw", "ocs_match_rule_bm", "ocs_rescued_by", "regime", "quality_tier", "reject_reason", "bucket")))
    failed = F.transform("ocs_failed_constraints", lambda f: F.struct(F.lit("ocs_failed_constraint").alias("counter"), F.regexp_replace(f, "[0-9]+", "n").alias("value")))
    return validated.select(F.inline(F.concat(singles, failed))).where("value is not null and value != ''").groupBy("counter", "value").agg(F.count("*").alias("n"))


def clean_rates(validated: DataFrame, by: str = "error_type") -> DataFrame:
    """Rows, clean rows and the clean rate of each class, with a status: ok from 0.10, low above 0, none at 0."""
    out = validated.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("bucket") == "clean").alias("n_clean"))
    rate = F.col("n_clean") / F.col("n")
    return out.select(by, "n", "n_clean", rate.alias("clean_rate"), F.when(rate >= 0.10, "ok").when(rate > 0, "low").otherwise("none").alias("status"))


def lite_scores(rows: DataFrame, ref: str = "ar_ref", mt: str = "mt_output", keyword: str = "keyword", match: str = "best_match") -> DataFrame:
    """Adds ocs, cps_proxy, sfr_proxy, mpqs_lite (rounded to four places) and accepts_basic (on the unrounded score)."""
    x = rows.withColumns({"__a": word_set(remove_all(ref, keyword)), "__b": word_set(remove_all(mt, match)), "__r": word_set(ref), "__m": word_set(mt)})  # each set once for a row
    x = x.withColumns({"ocs": M.anchor_present(ref, keyword), "__c": M.recall_of_sets("__a", "__b"), "__s": M.jaccard_of_sets("__r", "__m")}).drop("__a", "__b", "__r", "__m")
    score = M.LITE[0] * F.col("__c") + M.LITE[1] * F.col("ocs") + M.LITE[2] * F.col("__s")
    x = x.withColumn("__q", score)
    return x.withColumns({"cps_proxy": F.round("__c", 4), "sfr_proxy": F.round("__s", 4), "mpqs_lite": F.round("__q", 4), "accepts_basic": (F.col("ocs") == 1) & (F.col("__q") >= M.LOOSE)}).drop("__c", "__s", "__q")


def filter_clean(scored: DataFrame, strict: bool = False) -> DataFrame:
    """Rows with the anchor whose rounded score reaches 0.55, or 0.65 if strict."""
    return scored.where((F.col("ocs") == 1) & (F.col("mpqs_lite") >= (M.STRICT if strict else M.LOOSE)))


def composite(rows: DataFrame, clean: str = "clean_ar", error: str = "error_ar", sfr: str | None = None, affixes: Affixes = ARABIC, compose: bool = True) -> DataFrame:
    """The light validator: constraint, similarity and context scores, the harmonic score by fixed weights, and accept flags.

    Without a semantic score the harmonic score and the tier are null, and nothing is accepted.
    """
    x = constraints(rows, clean, error, affixes=affixes, compose=compose)
    x = x.withColumns({"csr": M.char_similarity(clean, error), "cps": M.context_preservation(clean, error, "keyword", "best_match"), "sfr": F.col(sfr).cast("double") if sfr else F.lit(None).cast("double"), "regime": regime("error_type")})
    x = x.withColumn("mpqs", M.weighted_harmonic("csr", "ocs", "sfr", M.LITE))
    ok = lambda least: (F.col("ocs") == 1) & F.coalesce(F.col("mpqs") >= least, F.lit(False))
    return x.withColumns({"quality_tier": F.when(F.col("sfr").isNotNull(), quality_tier("cps", "regime")), "accepts_strict": ok(M.STRICT), "accepts_basic": ok(M.LOOSE)})


def accepted(scores: DataFrame, least: float, recommendation: int = 4) -> DataFrame:
    """Adds dqi and accepted: a quality index of at least ``least`` and a recommendation of at least 4."""
    x = scores.withColumn("dqi", M.dqi("anchor_validity", "phenomenon_clarity", "arabic_naturalness", "collateral_severity"))
    return x.withColumn("accepted", (F.col("dqi") >= least) & F.coalesce(F.col("seed_recommendation") >= recommendation, F.lit(False)))
