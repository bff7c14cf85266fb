"""Queries over gates, routing, checks and the taxonomy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.affix import ENGLISH
from ..operators import checks, gates
from ..operators import taxonomy as X
from .text import read

CLASS_VALUES = "tax(class, label_id, grp, cat, lvl, score, weight, dim) AS (VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in c) + ")" for c in X.CLASSES) + ")"
RUBRIC_VALUES = "rub(et, cls, min_csr, min_ocs, min_sfr, max_sfr, w1, w2, w3, inv) AS (VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in r) + ")" for r in X.RUBRIC) + ")"


def metric_rows(spark, d):
    """Lines of orders as rows of metrics with a class: whole numbers over a hundred, some out of range, null or unknown."""
    names = F.array(*(F.lit(x) for x in X.LABELS))
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3
    li = read(spark, d, "lineitem")
    pct = lambda m, mod: F.pmod(k * m + F.col("l_partkey"), F.lit(mod)) / 100.0
    return li.select(
        "l_orderkey", "l_linenumber",
        F.when(F.pmod(k, F.lit(24)) == 23, "No Such Class").otherwise(F.element_at(names, (F.least(F.pmod(k, F.lit(24)), F.lit(22)) + 1).cast("int"))).alias("error_type"),
        pct(11, 104).alias("csr"), F.when(F.pmod(k * 5, F.lit(7)) == 0, 0.0).otherwise(1.0).alias("ocs"),
        F.when(F.pmod(k, F.lit(31)) == 0, None).otherwise(pct(13, 101)).alias("sfr"), pct(17, 101).alias("cps"),
    )


METRICS = f"""
WITH {RUBRIC_VALUES}, {CLASS_VALUES}, k AS (SELECT *, l_orderkey * 7 + l_linenumber * 3 AS k FROM lineitem),
m AS (SELECT l_orderkey, l_linenumber, CASE WHEN k % 24 = 23 THEN 'No Such Class' ELSE class END AS error_type,
  ((k * 11 + l_partkey) % 104) / 100.0::DOUBLE AS csr, CASE WHEN (k * 5) % 7 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS ocs,
  CASE WHEN k % 31 <> 0 THEN ((k * 13 + l_partkey) % 101) / 100.0::DOUBLE END AS sfr, ((k * 17 + l_partkey) % 101) / 100.0::DOUBLE AS cps
  FROM k JOIN tax ON label_id = least(k.k % 24, 22)),
f AS (SELECT m.*, rub.*, CASE WHEN error_type = 'Meaning Shift' THEN 'D' ELSE 'F' END AS regime,
  CASE WHEN error_type IN ({', '.join(f"'{x}'" for x in gates.STRUCTURE_TOLERANT)}) THEN 0.45::DOUBLE ELSE 0.55::DOUBLE END AS cps_floor,
  CASE WHEN inv THEN min_csr END AS max_csr FROM m LEFT JOIN rub ON et = error_type),
g AS (SELECT *, CASE WHEN et IS NULL THEN 'unknown_error_type' WHEN csr IS NULL OR ocs IS NULL OR sfr IS NULL OR cps IS NULL THEN 'missing_metric'
  WHEN csr < 0 OR csr > 1 OR sfr < 0 OR sfr > 1 OR cps < 0 OR cps > 1 THEN 'metric_out_of_range' WHEN ocs < 1 THEN 'ocs_failed'
  WHEN regime = 'F' AND cps < cps_floor THEN 'cps_below_floor' WHEN regime = 'F' AND sfr < min_sfr THEN 'sfr_below_floor' WHEN regime = 'F' THEN NULL
  WHEN coalesce(max_csr, 1.0) < 1 AND csr > max_csr THEN 'csr_exceeds_maximum' WHEN sfr < min_sfr THEN 'sfr_below_minimum' WHEN sfr > max_sfr THEN 'sfr_above_maximum' END AS reason FROM f),
h AS (SELECT *, CASE WHEN reason IS NULL THEN CASE WHEN regime = 'D' THEN 'B' WHEN cps >= 0.65 THEN 'A' WHEN cps >= 0.55 THEN 'B' END END AS tier,
  CASE WHEN csr IS NULL OR ocs IS NULL OR sfr IS NULL THEN NULL WHEN csr <= 0 OR ocs <= 0 OR sfr <= 0 THEN 0.0::DOUBLE
    ELSE greatest(0.0, least(1.0, 3.0 / (coalesce(w1, 0.33) / csr + coalesce(w2, 0.34) / ocs + coalesce(w3, 0.33) / sfr))) END AS mpqs,
  CASE WHEN csr IS NULL OR ocs IS NULL OR sfr IS NULL THEN NULL WHEN csr <= 0 OR ocs <= 0 OR sfr <= 0 THEN 0.0::DOUBLE
    ELSE least(1.0, (coalesce(w1, 0.33) + coalesce(w2, 0.34) + coalesce(w3, 0.33)) / (coalesce(w1, 0.33) / csr + coalesce(w2, 0.34) / ocs + coalesce(w3, 0.33) / sfr)) END AS mean FROM g)"""


def _gated(spark, d):
    x = gates.with_rubric(metric_rows(spark, d), X.default_rubric(spark))
    w = tuple(F.coalesce(F.col(f"rubric.weight_{m}"), F.lit(v)) for m, v in zip(("csr", "ocs", "sfr"), gates.DEFAULT_WEIGHTS, strict=True))
    x = x.withColumns({"reason": gates.reject_reason("csr", "ocs", "sfr", "cps"), "regime": gates.regime("error_type"), "mpqs": M.weighted_harmonic("csr", "ocs", "sfr", w), "mean": M.normalized_harmonic("csr", "ocs", "sfr", w)})
    return x.withColumn("tier", F.when(F.col("reason").isNull(), gates.quality_tier("cps", "regime")))


def rubric_gate(spark, d):
    return _gated(spark, d).select("l_orderkey", "l_linenumber", "error_type", "regime", "reason", "tier")


RUBRIC_GATE = METRICS + " SELECT l_orderkey, l_linenumber, error_type, regime, reason, tier FROM h"


def mpqs_score(spark, d):
    return _gated(spark, d).select("l_orderkey", "l_linenumber", F.round("mpqs", 6).alias("mpqs"), F.round("mean", 6).alias("mpqs_normalized"))


MPQS_SCORE = METRICS + " SELECT l_orderkey, l_linenumber, round(mpqs, 6) AS mpqs, round(mean, 6) AS mpqs_normalized FROM h"


def regime_stats(spark, d):
    x = _gated(spark, d).withColumn("bucket", F.when(F.col("reason").isNull(), "clean").otherwise("noisy"))
    return gates.clean_rates(x).select("error_type", "n", "n_clean", F.round("clean_rate", 6).alias("clean_rate"), "status")


REGIME_STATS = METRICS + """ SELECT error_type, count(*) AS n, count(*) FILTER (WHERE reason IS NULL) AS n_clean, round(count(*) FILTER (WHERE reason IS NULL) / count(*)::DOUBLE, 6) AS clean_rate,
  CASE WHEN count(*) FILTER (WHERE reason IS NULL) / count(*)::DOUBLE >= 0.10 THEN 'ok' WHEN count(*) FILTER (WHERE reason IS NULL) > 0 THEN 'low' ELSE 'none' END AS status FROM h GROUP BY error_type"""


def reject_counters(spark, d):
    return _gated(spark, d).groupBy("reason", "regime", "tier").agg(F.count("*").alias("n"))


REJECT_COUNTERS = METRICS + " SELECT reason, regime, tier, count(*) AS n FROM h GROUP BY ALL"


def _validator_rows(spark, d):
    """Parts as sentence pairs: the name as reference, a changed copy as translation."""
    p = read(spark, d, "part").select("p_partkey", F.col("p_name").alias("clean_ar"), F.get(F.split("p_name", " "), F.lit(0)).alias("w1"), F.get(F.split("p_name", " "), F.lit(1)).alias("w2"))
    k = F.pmod("p_partkey", F.lit(6))
    return p.select(
        "p_partkey", "clean_ar",
        F.when(k == 0, F.replace("clean_ar", F.col("w1"), F.lit("OTHER"))).when(k == 1, F.col("clean_ar")).when(k == 2, F.lit("")).when(k == 3, F.replace("clean_ar", F.col("w1"), F.lit(""))).when(k == 4, F.replace("clean_ar", F.col("w2"), F.lit("ODD"))).otherwise(F.lit("12345")).alias("error_ar"),
        F.when(k == 4, F.col("w2")).otherwise(F.col("w1")).alias("keyword"), F.when(k == 3, "[OMITTED]").when(k == 4, "ODD").otherwise("OTHER").alias("best_match"),
        F.when(k == 3, "Total Omission").otherwise("Spelling Error").alias("error_type"), F.lit(0.9).alias("sfr"),
    )


def router_buckets(spark, d):
    x = gates.validate(_validator_rows(spark, d), X.default_rubric(spark), script="[a-z]", affixes=ENGLISH, compose=False)
    return x.select("p_partkey", "bucket", "passed", "reject_reason", F.round("csr", 6).alias("csr"), F.round("cps", 6).alias("cps"), "ocs", "quality_tier", "mpqs_mode", F.array_join("flags", ",").alias("flags"), F.array_join("ocs_failed_constraints", ";").alias("failed"))


ROUTER_ROWS = f"""
WITH w AS (SELECT p_partkey, p_name, string_split(p_name, ' ')[1] AS w1, string_split(p_name, ' ')[2] AS w2, p_partkey % 6 AS k FROM part),
r AS (SELECT p_partkey, p_name AS c, k, CASE k WHEN 0 THEN replace(p_name, w1, 'OTHER') WHEN 1 THEN p_name WHEN 2 THEN '' WHEN 3 THEN replace(p_name, w1, '') WHEN 4 THEN replace(p_name, w2, 'ODD') ELSE '12345' END AS e,
  CASE k WHEN 4 THEN w2 ELSE w1 END AS kw, CASE k WHEN 3 THEN '[OMITTED]' WHEN 4 THEN 'ODD' ELSE 'OTHER' END AS bm, CASE k WHEN 3 THEN 'Total Omission' ELSE 'Spelling Error' END AS et FROM w),
x AS (SELECT *, CASE WHEN e = '' THEN 'empty_field' WHEN trim(c) = trim(e) THEN 'identical_sentences' WHEN NOT regexp_matches(e, '[a-z]') THEN 'non_arabic' END AS fatal,
  {'CASE WHEN strpos(c, kw) > 0 THEN substr(c, 1, strpos(c, kw) - 1) || substr(c, strpos(c, kw) + length(kw)) ELSE c END'} AS cc,
  {"CASE WHEN bm <> '[OMITTED]' AND strpos(e, bm) > 0 THEN substr(e, 1, strpos(e, bm) - 1) || substr(e, strpos(e, bm) + length(bm)) ELSE e END"} AS ee FROM r),"""
ROUTER_BUCKETS = ROUTER_ROWS + """
y AS (SELECT *, CASE WHEN fatal IS NULL THEN 1 - levenshtein(c, e)::DOUBLE / greatest(length(c), length(e)) ELSE 0 END AS csr,
  CASE WHEN fatal IS NOT NULL THEN 0 WHEN trim(cc) = '' OR trim(ee) = '' THEN 0.9 ELSE 1 - levenshtein(cc, ee)::DOUBLE / greatest(length(cc), length(ee)) END AS cps FROM x),
z AS (SELECT *, CASE WHEN fatal IS NULL AND cps < 0.55 THEN 'cps_below_floor' END AS reason,
  CASE WHEN et = 'Total Omission' THEN 3.0 / (0.35 / csr + 0.35 / 1 + 0.30 / 0.9) WHEN fatal IS NULL THEN 3.0 / (0.35 / csr + 0.35 / 1 + 0.30 / 0.9) END AS mpqs FROM y)
SELECT p_partkey, CASE WHEN fatal IS NOT NULL THEN 'discarded' WHEN reason IS NULL THEN 'clean' ELSE 'noisy' END AS bucket, fatal IS NULL AS passed, coalesce(fatal, reason) AS reject_reason,
  round(csr, 6) AS csr, round(cps, 6) AS cps, CASE WHEN fatal IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS ocs,
  CASE WHEN fatal IS NULL AND reason IS NULL THEN CASE WHEN cps >= 0.65 THEN 'A' WHEN cps >= 0.55 THEN 'B' END END AS quality_tier,
  CASE WHEN fatal IS NULL AND et = 'Spelling Error' THEN 'score' ELSE 'diagnostic' END AS mpqs_mode,
  CASE WHEN fatal IS NOT NULL THEN 'fatal_error' WHEN reason IS NOT NULL THEN 'violates_clean_standard' || CASE WHEN mpqs < 0.5 THEN ',low_quality_suspected' ELSE '' END || CASE WHEN mpqs < 0.4 THEN ',multi_error_suspected' ELSE '' END
    WHEN mpqs < 0.7 THEN 'low_mpqs' ELSE '' END AS flags,
  CASE k WHEN 1 THEN 'keyword_present_in_error_1;best_match_absent_in_error_0' WHEN 2 THEN 'error_ar_empty' WHEN 5 THEN 'best_match_absent_in_error_0' ELSE '' END AS failed
FROM z"""


def routing_totals(spark, d):
    return gates.routing_stats(gates.validate(_validator_rows(spark, d), X.default_rubric(spark), script="[a-z]", affixes=ENGLISH, compose=False))


ROUTING_TOTALS = f"""
WITH v AS ({ROUTER_BUCKETS}) SELECT count(*) AS total, count(*) FILTER (WHERE bucket = 'clean') AS clean, count(*) FILTER (WHERE quality_tier = 'A') AS clean_a, count(*) FILTER (WHERE quality_tier = 'B') AS clean_b,
  count(*) FILTER (WHERE bucket = 'noisy') AS noisy, count(*) FILTER (WHERE bucket = 'discarded') AS discarded, round(count(*) FILTER (WHERE bucket = 'clean') / count(*)::DOUBLE, 4) AS clean_rate,
  round(count(*) FILTER (WHERE bucket = 'noisy') / count(*)::DOUBLE, 4) AS noisy_rate, round(count(*) FILTER (WHERE bucket = 'discarded') / count(*)::DOUBLE, 4) AS discard_rate FROM v"""


def dqi_accept(spark, d):
    li = read(spark, d, "lineitem")
    k = F.col("l_orderkey") + F.col("l_linenumber")
    x = li.select("l_orderkey", "l_linenumber", F.pmod(k, F.lit(6)).alias("anchor_validity"), (F.pmod(k, F.lit(5)) + 1).alias("phenomenon_clarity"), (F.pmod(k, F.lit(4)) + 2).alias("arabic_naturalness"), F.lit(5).alias("collateral_severity"), (F.pmod(k, F.lit(3)) + 3).alias("seed_recommendation"))
    return gates.accepted(x, 0.75).select("l_orderkey", "l_linenumber", "dqi", "accepted")


DQI_ACCEPT = """
WITH k AS (SELECT l_orderkey, l_linenumber, l_orderkey + l_linenumber AS k FROM lineitem),
q AS (SELECT *, CASE WHEN k % 6 = 0 THEN 0 ELSE round(((k % 6 - 1) / 4.0 + (k % 5) / 4.0 + (k % 4 + 1) / 4.0 + 1.0) / 4, 4) END AS dqi FROM k)
SELECT l_orderkey, l_linenumber, dqi, dqi >= 0.75 AND k % 3 + 3 >= 4 AS accepted FROM q"""


def data_quality_report(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("Sub-Subtype"), F.col("text").alias("ar"), F.col("source").alias("mt_output"), F.lit("the").alias("Keyword"))
    twice = docs.unionByName(docs.where("sample_id % 10 = 0"))
    return checks.file_checks(twice, spark.createDataFrame([("en",), ("fr",)], "label string"), script="[a-z]")


DATA_QUALITY_REPORT = """
WITH t AS (SELECT * FROM documents UNION ALL SELECT * FROM documents WHERE doc_id % 10 = 0),
a AS (SELECT count(*) FILTER (WHERE lang NOT IN ('en', 'fr')) AS l, count(doc_id) - count(DISTINCT doc_id) AS i, count(*) FILTER (WHERE text IS NULL OR trim(text) = '' OR source IS NULL OR trim(source) = '') AS b,
  count(*) FILTER (WHERE (trim(text) <> '' AND NOT regexp_matches(text, '[a-z]')) OR (trim(source) <> '' AND NOT regexp_matches(source, '[a-z]'))) AS s, count(*) FILTER (WHERE NOT contains(text, 'the')) AS k FROM t)
SELECT unnest(['labels_known', 'ids_unique', 'texts_present', 'texts_in_script', 'keyword_in_ref']) AS check_id,
       unnest([CASE WHEN l = 0 THEN 'pass' ELSE 'fail' END, CASE WHEN i = 0 THEN 'pass' ELSE 'fail' END, CASE WHEN b = 0 THEN 'pass' ELSE 'fail' END, CASE WHEN s = 0 THEN 'pass' ELSE 'fail' END, CASE WHEN k = 0 THEN 'pass' ELSE 'warn' END]) AS status,
       unnest([l, i, b, s, k]) AS n_bad FROM a"""


def signal_rules(spark, d):
    docs = read(spark, d, "documents")
    s = F.element_at(F.array(*(F.lit(x) for x in (checks.SUBSTITUTION_ERROR, checks.SUBSTITUTION_CLEAN, checks.OMISSION_CLEAN, checks.OMISSION_ERROR))), (F.col("doc_id") % 4 + 1).cast("int"))
    return checks.signal_checks(docs.select(s.alias("retrieval_signal"), F.col("text").alias("mt_output"), F.lit("the").alias("Keyword"), F.lit("and").alias("Best_Match")))


SIGNAL_RULES = """
WITH a AS (SELECT count(*) FILTER (WHERE doc_id % 4 = 2 AND NOT contains(text, 'the')) AS a, count(*) FILTER (WHERE doc_id % 4 = 1 AND NOT contains(text, 'the')) AS b1, count(*) FILTER (WHERE doc_id % 4 = 1 AND contains(text, 'and')) AS b2,
  count(*) FILTER (WHERE doc_id % 4 = 3 AND contains(text, 'the')) AS c, count(*) FILTER (WHERE doc_id % 4 = 0 AND NOT contains(text, 'and')) AS d FROM documents),
u AS (SELECT unnest(['omission_no_error_kw_in_mt', 'substitution_no_error_kw_in_mt', 'substitution_no_error_bm_absent', 'omission_error_kw_absent', 'substitution_error_bm_in_mt']) AS check_id, unnest([a, b1, b2, c, d]) AS n_bad FROM a)
SELECT check_id, CASE WHEN n_bad = 0 THEN 'pass' ELSE 'fail' END AS status, n_bad FROM u"""


def taxonomy_weight_check(spark, d):
    return X.taxonomy_checks(X.taxonomy(spark)).select("check_id", "status", "n_bad")


TAXONOMY_WEIGHT_CHECK = f"""
WITH {CLASS_VALUES}, g(grp, w) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in X.GROUP_WEIGHTS.items())}), c(cat, w) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in X.CATEGORY_WEIGHTS.items())}),
gs AS (SELECT count(*) AS n FROM (SELECT grp, sum(weight) AS s FROM tax GROUP BY grp) FULL JOIN g USING (grp) WHERE abs(coalesce(s, -1) - coalesce(w, -2)) > 1e-9),
cs AS (SELECT count(*) AS n FROM (SELECT cat, sum(weight) AS s FROM tax GROUP BY cat) FULL JOIN c USING (cat) WHERE abs(coalesce(s, -1) - coalesce(w, -2)) > 1e-9),
u AS (SELECT 'C01' AS check_id, (SELECT count(DISTINCT class) <> 23 FROM tax)::BIGINT AS bad, 0 AS n_bad UNION ALL SELECT 'C02', 0, 0 UNION ALL SELECT 'C03', (SELECT n FROM gs), (SELECT n FROM gs) UNION ALL SELECT 'C04', (SELECT n FROM cs), (SELECT n FROM cs)
  UNION ALL SELECT 'C05', ((SELECT abs(sum(w) - 1) > 1e-9 FROM g) OR (SELECT abs(sum(w) - 1) > 1e-9 FROM c))::BIGINT, 0 UNION ALL SELECT 'C05b', (SELECT min(label_id) <> 0 OR max(label_id) <> 22 OR count(DISTINCT label_id) <> 23 FROM tax)::BIGINT, 0)
SELECT check_id, CASE WHEN bad = 0 THEN 'pass' ELSE 'fail' END AS status, n_bad FROM u"""


def taxonomy_rollup(spark, d):
    return X.weight_rollup(X.taxonomy(spark))


TAXONOMY_ROLLUP = f"WITH {CLASS_VALUES} SELECT 'group' AS level, grp AS name, round(sum(weight), 9) AS weight, count(*) AS n FROM tax GROUP BY grp UNION ALL SELECT 'category', cat, round(sum(weight), 9), count(*) FROM tax GROUP BY cat"


def taxonomy_map_check(spark, d):
    t = X.taxonomy(spark)
    wrong = X.label_ids(spark).withColumn("label_id", F.when(F.col("label") == "Spelling Error", 22).when(F.col("label") == "Invalid Pattern", 21).otherwise(F.col("label_id")))
    return X.map_checks(t, wrong, t.select("group", F.col("class").alias("label")).where("class != 'Meaning Shift'")).select("check_id", "status", "n_bad")


TAXONOMY_MAP_CHECK = f"""
WITH {CLASS_VALUES}, lab AS (SELECT class, CASE class WHEN 'Spelling Error' THEN 22 WHEN 'Invalid Pattern' THEN 21 ELSE label_id END AS id FROM tax), par AS (SELECT grp, class FROM tax WHERE class <> 'Meaning Shift'),
l AS (SELECT count(id) AS n, count(label_id) AS m, count(*) FILTER (WHERE id IS NULL OR label_id IS NULL) AS k, count(*) FILTER (WHERE id <> label_id) AS d, count(DISTINCT id) AS u, min(id) AS lo, max(id) AS hi FROM lab FULL JOIN tax USING (class)),
p AS (SELECT count(*) FILTER (WHERE par.grp IS DISTINCT FROM tax.grp) AS moved, count(*) FILTER (WHERE par.grp IS NULL) AS lost FROM tax LEFT JOIN par USING (class)),
g AS (SELECT count(DISTINCT a.grp) AS a, count(DISTINCT b.grp) AS b, count(*) FILTER (WHERE a.grp IS NULL OR b.grp IS NULL) AS odd FROM (SELECT DISTINCT grp FROM par) a FULL JOIN (SELECT DISTINCT grp FROM tax) b USING (grp)),
u AS (SELECT unnest(['L01', 'L02', 'L03', 'L04', 'P01', 'P02', 'P03', 'P04']) AS check_id, unnest([n = m, k = 0, d = 0, u = n AND lo = 0 AND hi = n - 1, a = b, odd = 0, moved = 0, lost = 0]) AS ok, unnest([0, k, d, 0, 0, odd, moved, lost]) AS n_bad FROM l, p, g)
SELECT check_id, CASE WHEN ok THEN 'pass' ELSE 'fail' END AS status, n_bad FROM u"""


def rubric_overview(spark, d):
    return X.rubric_summary(X.default_rubric(spark))


RUBRIC_OVERVIEW = f"""
WITH {RUBRIC_VALUES}, r AS (SELECT *, CASE WHEN et = 'Meaning Shift' THEN 'D' ELSE 'F' END AS regime, CASE WHEN et IN ({', '.join(f"'{x}'" for x in gates.STRUCTURE_TOLERANT)}) THEN 0.45 ELSE 0.55 END AS f FROM rub)
SELECT regime, cls AS class, count(*) AS n, min(min_sfr) AS least_sfr, max(min_sfr) AS most_sfr, min(f)::DOUBLE AS least_cps FROM r GROUP BY regime, cls"""


def document_rules(spark, d):
    docs = read(spark, d, "documents")
    return checks.text_rules(docs, {"mentions_license": checks.mentions("text", "License"), "mentions_both": checks.mentions("text", "the", "and"), "one_line": ~F.contains("text", F.lit("\n"))})


DOCUMENT_RULES = r"""
WITH u AS (SELECT unnest(['mentions_license', 'mentions_both', 'one_line']) AS check_id, unnest([count(*) FILTER (WHERE NOT contains(text, 'License')), count(*) FILTER (WHERE NOT (contains(text, 'the') AND contains(text, 'and'))), count(*) FILTER (WHERE contains(text, chr(10)))]) AS n_bad FROM documents)
SELECT check_id, CASE WHEN n_bad = 0 THEN 'pass' ELSE 'warn' END AS status, n_bad FROM u"""


def report_verdict(spark, d):
    return checks.verdict(data_quality_report(spark, d), strict=True)


REPORT_VERDICT = f"WITH r AS ({DATA_QUALITY_REPORT}) SELECT count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'fail') AS n_fail, count(*) FILTER (WHERE status = 'warn') AS n_warn, CASE WHEN count(*) FILTER (WHERE status <> 'pass') > 0 THEN 1 ELSE 0 END AS exit_code FROM r"


def prediction_id_check(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.element_at(F.array(*(F.lit(x) for x in X.LABELS)), (F.col("o_orderkey") % 23 + 1).cast("int")).alias("true_label"), F.when(F.col("o_orderkey") % 1000 == 7, 99).otherwise((F.col("o_orderkey") % 23).cast("int")).alias("true_label_id"))
    return checks.prediction_checks(o, X.label_ids(spark), most=20)


PREDICTION_ID_CHECK = f"""
WITH {CLASS_VALUES} SELECT o_orderkey, class AS true_label, 99 AS true_label_id, label_id AS expected_id FROM orders JOIN tax ON label_id = o_orderkey % 23
WHERE o_orderkey % 1000 = 7 ORDER BY o_orderkey LIMIT 20"""

QUERIES = {
    "rubric_gate": (rubric_gate, RUBRIC_GATE),
    "mpqs_score": (mpqs_score, MPQS_SCORE),
    "regime_stats": (regime_stats, REGIME_STATS),
    "reject_counters": (reject_counters, REJECT_COUNTERS),
    "router_buckets": (router_buckets, ROUTER_BUCKETS),
    "routing_totals": (routing_totals, ROUTING_TOTALS),
    "dqi_accept": (dqi_accept, DQI_ACCEPT),
    "data_quality_report": (data_quality_report, DATA_QUALITY_REPORT),
    "signal_rules": (signal_rules, SIGNAL_RULES),
    "taxonomy_weight_check": (taxonomy_weight_check, TAXONOMY_WEIGHT_CHECK),
    "taxonomy_rollup": (taxonomy_rollup, TAXONOMY_ROLLUP),
    "taxonomy_map_check": (taxonomy_map_check, TAXONOMY_MAP_CHECK),
    "rubric_overview": (rubric_overview, RUBRIC_OVERVIEW),
    "document_rules": (document_rules, DOCUMENT_RULES),
    "report_verdict": (report_verdict, REPORT_VERDICT),
    "prediction_id_check": (prediction_id_check, PREDICTION_ID_CHECK),
}
