"""Queries over model inputs, prompts, spans, sequences of affixed words, and the checks of sheets and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions import text as T
from ..functions.affix import ENGLISH, count_matches
from ..operators import checks, gates
from ..operators import taxonomy as X
from .rules import CLASS_VALUES, METRICS, ROUTER_ROWS, _gated, _validator_rows
from .text import read


def ablation_forms(spark, d):
    p, k = read(spark, d, "part"), F.col("p_partkey")
    keyword = F.when(k % 5 == 0, None).when(k % 5 == 1, " NaN ").when(k % 5 == 2, "[OMITTED]").when(k % 5 == 3, "  ").otherwise(F.concat(F.lit(" "), "p_brand"))
    match = F.when(k % 3 == 0, "none").when(k % 3 == 1, " [omitted] ").otherwise(F.col("p_type"))
    x = p.select("p_partkey", F.concat(F.lit(" "), "p_name", F.lit("  ")).alias("ref"), F.when(k % 7 != 0, F.col("p_type")).alias("mt"), keyword.alias("keyword"), match.alias("match"))
    a, b = (prompts.ablation_input(form, "ref", "mt", "keyword", "match") for form in "AD")
    return x.select("p_partkey", a["text_a"].alias("a_a"), a["text_b"].alias("a_b"), b["text_a"].alias("d_a"), b["text_b"].alias("d_b"))


ABLATION_FORMS = """
WITH x AS (SELECT p_partkey, trim(p_name) AS r, CASE WHEN p_partkey % 7 <> 0 THEN trim(p_type) ELSE '' END AS m,
  CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' NaN ' WHEN 2 THEN '[OMITTED]' WHEN 3 THEN '  ' ELSE ' ' || p_brand END AS k,
  CASE p_partkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN ' [omitted] ' ELSE p_type END AS b FROM part),
y AS (SELECT *, CASE WHEN k IS NULL OR lower(trim(k)) IN ('', 'nan', 'none', '[omitted]') THEN '' ELSE trim(k) END AS ke,
  CASE WHEN b IS NULL OR lower(trim(b)) IN ('', 'nan', 'none') THEN '[OMITTED]' ELSE trim(b) END AS bo FROM x)
SELECT p_partkey, r AS a_a, m AS a_b, CASE WHEN ke <> '' THEN ke || ' ' || bo ELSE r END AS d_a, concat_ws(' ', nullif(r, ''), nullif(m, '')) AS d_b FROM y"""


def class_prompts(spark, d):
    """Zero-shot and few-shot prompts, by length and digest."""
    p = read(spark, d, "part").select("p_partkey", F.repeat("p_name", F.lit(20)).alias("ref"), F.repeat("p_type", F.lit(20)).alias("mt"), F.repeat("p_brand", F.lit(12)).alias("k"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_type")).alias("b"))
    example = prompts.few_shot_example(F.lit("Spelling Error"), "k", "b", "ref", "mt")
    value = lambda c: F.coalesce(F.col(c), F.lit(""))
    zero, few = (prompts.classify_prompt("Name the class.", X.LABELS, "k", value("b"), "ref", "mt", e) for e in (None, example))
    return p.select("p_partkey", F.length(zero).alias("n_zero"), F.md5(zero).alias("zero"), F.length(few).alias("n_few"), F.md5(few).alias("few"))


CLASS_PROMPTS = f"""
WITH p AS (SELECT p_partkey, chr(10) AS nl, repeat(p_name, 20) AS ref, repeat(p_type, 20) AS mt, repeat(p_brand, 12) AS k, CASE WHEN p_partkey % 4 <> 0 THEN p_type ELSE '' END AS b FROM part),
q AS (SELECT p_partkey, 'Name the class.' || nl || nl || {" || nl || ".join(f"'- {x}'" for x in X.LABELS)} || nl || nl AS top,
  'Examples:' || nl || '--- Example (Spelling Error) ---' || nl || 'Keyword: ' || substr(k, 1, 80) || ' -> Became: ' || substr(b, 1, 80) || nl || 'Reference: ' || substr(ref, 1, 150) || nl || 'MT Output: ' || substr(mt, 1, 150) || nl || 'Answer: Spelling Error' || nl || nl AS shown,
  'Keyword: ' || k || nl || 'Best_Match: ' || b || nl || 'Reference: ' || ref || nl || 'MT Output: ' || mt || nl || nl || 'Answer with exactly one class name from the list.' AS ask FROM p)
SELECT p_partkey, length(top || ask)::INT AS n_zero, md5(top || ask) AS zero, length(top || shown || ask)::INT AS n_few, md5(top || shown || ask) AS few FROM q"""


def category_fold(spark, d):
    return read(spark, d, "customer").select("c_custkey", T.fold_category(F.concat(F.lit(" "), "c_mktsegment"), "mach", "Machines").alias("category"))


CATEGORY_FOLD = "SELECT c_custkey, CASE WHEN starts_with(lower(trim(c_mktsegment)), 'mach') THEN 'Machines' ELSE ' ' || c_mktsegment END AS category FROM customer"


def token_spans(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.transform(F.sequence(F.lit(0), F.col("p_size") % 10), lambda i: i * 4).alias("starts"), (F.col("p_partkey") % 45).alias("a"), (F.col("p_partkey") % 45 + F.col("p_size") % 7).alias("b"))
    p = p.withColumn("ends", F.transform("starts", lambda i: i + 3))
    at = T.char_to_token_span("starts", "ends", "a", "b")
    return p.select("p_partkey", at["first"].alias("first_token"), at["last"].alias("last_token"))


TOKEN_SPANS = """
WITH p AS (SELECT p_partkey, p_partkey % 45 AS a, p_partkey % 45 + p_size % 7 AS b, unnest(range(0, p_size % 10 + 1)) AS i FROM part)
SELECT p_partkey, (min(i) FILTER (WHERE i * 4 < b AND i * 4 + 3 > a))::INT AS first_token, (max(i) FILTER (WHERE i * 4 < b AND i * 4 + 3 > a))::INT AS last_token FROM p GROUP BY p_partkey"""


def affix_sequences(spark, d):
    """Keywords of several words: the exact sequence, or one whose first or last word differs by an affix."""
    w, k = F.col("toks"), F.col("p_partkey") % 6
    a, b = F.get(w, F.lit(0)), F.get(w, F.lit(1))
    p = read(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("toks"))
    first = F.when(k == 1, F.concat(a, F.lit("s"))).when(k == 2, F.concat(F.lit("un"), a)).when(k == 3, F.lit("zz")).otherwise(a)
    last = F.when(k == 4, F.concat(b, F.lit("ing"))).when(k == 5, F.concat(F.lit("th"), b)).otherwise(b)
    found = p.withColumn("k", F.array(first, last)).withColumn("m", count_matches("toks", "k", ENGLISH))
    return found.select("p_partkey", "m.n", "m.rule")


AFFIX_SEQUENCES = """
WITH w AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, p_partkey % 6 AS k FROM part),
x AS (SELECT *, CASE k WHEN 1 THEN a || 's' WHEN 2 THEN 'un' || a WHEN 3 THEN 'zz' ELSE a END AS f, CASE k WHEN 4 THEN b || 'ing' WHEN 5 THEN 'th' || b ELSE b END AS l FROM w),
s AS (SELECT unnest(['ing', 'ed', 'er', 's']) AS s), p AS (SELECT unnest(['un', 're', 'th']) AS p),
y AS (SELECT x.*, (SELECT max('kw_prefix_' || p) FROM p WHERE p || a = f) AS f1, (SELECT max('kw_suffix_' || s) FROM s WHERE a || s = f) AS f2, (SELECT max('kw_prefix_' || p) FROM p WHERE p || b = l) AS l1, (SELECT max('kw_suffix_' || s) FROM s WHERE b || s = l) AS l2 FROM x),
z AS (SELECT *, CASE WHEN a = f AND b = l THEN 'exact_seq' WHEN b = l THEN 'seq_' || coalesce(f1, f2) WHEN a = f THEN 'seq_' || coalesce(l1, l2) END AS rule FROM y)
SELECT p_partkey, CASE WHEN rule IS NULL THEN 0 ELSE 1 END AS n, coalesce(rule, '') AS rule FROM z"""


def light_validator(spark, d):
    x = gates.composite(_validator_rows(spark, d), sfr="sfr", affixes=ENGLISH, compose=False)
    return x.select("p_partkey", "ocs", *(F.round(c, 6).alias(c) for c in ("csr", "cps", "mpqs")), "regime", "quality_tier", "accepts_strict", "accepts_basic")


LIGHT_VALIDATOR = ROUTER_ROWS + """
s AS (SELECT *, CASE WHEN e <> '' THEN 1 - levenshtein(c, e)::DOUBLE / greatest(length(c), length(e)) END AS csr, (fatal IS NULL)::INT::DOUBLE AS ocs,
  CASE WHEN e = '' THEN NULL WHEN trim(cc) = '' OR trim(ee) = '' THEN 0.9 ELSE 1 - levenshtein(cc, ee)::DOUBLE / greatest(length(cc), length(ee)) END AS cps FROM x),
q AS (SELECT *, CASE WHEN csr IS NULL THEN NULL WHEN csr <= 0 OR ocs <= 0 THEN 0.0::DOUBLE ELSE least(1.0, 3.0 / (0.45 / csr + 0.30 / ocs + 0.25 / 0.9)) END AS mpqs FROM s)
SELECT p_partkey, ocs, round(csr, 6) AS csr, round(cps, 6) AS cps, round(mpqs, 6) AS mpqs, 'F' AS regime, CASE WHEN cps >= 0.65 THEN 'A' WHEN cps >= 0.55 THEN 'B' END AS quality_tier,
  ocs = 1 AND coalesce(mpqs >= 0.65, false) AS accepts_strict, ocs = 1 AND coalesce(mpqs >= 0.55, false) AS accepts_basic FROM q"""


def metric_counters(spark, d):
    j = F.col("l_orderkey") + F.col("l_linenumber")
    x = _gated(spark, d).withColumns({
        "ocs_match_rule_kw": F.when(j % 4 == 0, "exact").when(j % 4 == 1, "prefix_un").otherwise(""),
        "ocs_match_rule_bm": F.when(j % 3 == 0, "exact").when(j % 3 == 1, None).otherwise(""),
        "ocs_rescued_by": F.when(j % 50 == 0, "both").otherwise(""),
        "ocs_failed_constraints": F.when(F.col("ocs") < 1, F.array(F.concat(F.lit("keyword_present_in_error_"), (j % 30).cast("string")), F.lit("error_ar_empty"))).otherwise(F.array().cast("array<string>")),
        "bucket": F.when(F.col("reason").isNull(), "clean").otherwise("noisy"), "quality_tier": F.col("tier"), "reject_reason": F.col("reason"),
    })
    return gates.counters(x)


METRIC_COUNTERS = METRICS + """, c AS (SELECT *, l_orderkey + l_linenumber AS j FROM h),
u AS (SELECT 'ocs_match_rule_kw' AS counter, CASE j % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'prefix_un' END AS value FROM c UNION ALL SELECT 'ocs_match_rule_bm', CASE WHEN j % 3 = 0 THEN 'exact' END FROM c
  UNION ALL SELECT 'ocs_rescued_by', CASE WHEN j % 50 = 0 THEN 'both' END FROM c UNION ALL SELECT 'regime', regime FROM c UNION ALL SELECT 'quality_tier', tier FROM c UNION ALL SELECT 'reject_reason', reason FROM c
  UNION ALL SELECT 'bucket', CASE WHEN reason IS NULL THEN 'clean' ELSE 'noisy' END FROM c UNION ALL SELECT 'ocs_failed_constraint', unnest(['keyword_present_in_error_n', 'error_ar_empty']) FROM c WHERE ocs < 1)
SELECT counter, value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY counter, value"""


def held_out_leak(spark, d):
    docs = read(spark, d, "documents")
    return checks.leak_check(docs.where("doc_id % 5 != 0"), read(spark, d, "labels"), "doc_id").select("check_id", "status", "n_bad")


HELD_OUT_LEAK = """
WITH n AS (SELECT count(DISTINCT doc_id) AS n FROM documents WHERE doc_id % 5 <> 0 AND doc_id IN (SELECT doc_id FROM labels))
SELECT 'G01' AS check_id, CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END AS status, n AS n_bad FROM n"""


def metadata_checks(spark, d):
    """The per-class sheet with one class missing and some scores, levels, categories and weights changed."""
    t, i = X.taxonomy(spark), F.col("label_id")
    weight = lambda by: F.sum("class_weight").over(Window.partitionBy(by))
    meta = t.withColumns({"group_weight": weight("group") + F.when(i == 5, 0.1).otherwise(0.0), "category_weight": weight("tqa_category")}).where("class != 'Meaning Shift'").select(
        "class", (F.col("severity_score") + F.when(F.col("class") == "Spelling Error", 1).otherwise(0)).alias("severity_score"), F.when(i % 7 == 0, "x").otherwise(F.col("severity_level")).alias("severity_level"),
        F.when(i == 3, "Other").otherwise(F.col("tqa_category")).alias("tqa_category"), "group_weight", "category_weight",
    )
    return X.meta_checks(t, meta).select("check_id", "status", "n_bad")


METADATA_CHECKS = f"""
WITH {CLASS_VALUES}, g AS (SELECT *, sum(weight) OVER (PARTITION BY grp) AS gw, sum(weight) OVER (PARTITION BY cat) AS cw FROM tax),
m AS (SELECT class, score + (class = 'Spelling Error')::INT AS score, CASE WHEN label_id % 7 = 0 THEN 'x' ELSE lvl END AS lvl, CASE WHEN label_id = 3 THEN 'Other' ELSE cat END AS cat, gw + CASE WHEN label_id = 5 THEN 0.1 ELSE 0 END AS gw, cw FROM g WHERE class <> 'Meaning Shift'),
j AS (SELECT g.score AS s, m.score AS ms, g.lvl <> m.lvl AS l, g.cat <> m.cat AND NOT (starts_with(lower(trim(g.cat)), 'style') AND starts_with(lower(trim(m.cat)), 'style')) AS c, abs(g.gw - m.gw) >= 1e-9 OR abs(g.cw - m.cw) >= 1e-9 AS w FROM g FULL JOIN m USING (class)),
a AS (SELECT (count(s) <> count(ms))::INT AS odd, count(*) FILTER (WHERE s IS NULL OR ms IS NULL) AS k, count(*) FILTER (WHERE s <> ms) AS s, count(*) FILTER (WHERE l) AS l, count(*) FILTER (WHERE c) AS c, count(*) FILTER (WHERE w) AS w FROM j),
u AS (SELECT unnest(['M01', 'M02', 'M03', 'M04', 'M05', 'M06']) AS check_id, unnest([odd, k, s, l, c, w]) AS bad, unnest([0, k, s, l, c, w]) AS n_bad FROM a)
SELECT check_id, CASE WHEN bad = 0 THEN 'pass' ELSE 'fail' END AS status, n_bad FROM u"""

QUERIES = {name: (f, globals()[name.upper()]) for name, f in list(globals().items()) if callable(f) and name.islower() and name.upper() in globals()}
