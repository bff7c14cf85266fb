"""Gates, checks, curation, evaluation, sources, flows and streams."""

from __future__ import annotations

import json
import math
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgauge.functions.affix import ENGLISH
from quillgauge.operators import checks, curation, evaluation, gates, taxonomy
from quillgauge.plans import facade, flow, scorers
from quillgauge.sources import files
from quillgauge.streaming import gate


def test_constraints(spark):
    rows = [
        ("نعرض الحالة", "نعرض الوضع", "حالة", "وضع", "Meaning Shift"), ("الحالة", "الحالة", "حالة", "وضع", "Meaning Shift"), ("", "x", "k", "b", "Meaning Shift"), ("a", "b", "", None, "Meaning Shift"),
        ("نص كلمة", "نص", "كلمة", "[OMITTED]", "Total Omission"), ("نص كلمة", "نص كلمة", "كلمة", "x", "Total Omission"), ("كَتَبَ نص", "نص قرأ", "كتب", "قَرَأ", "Meaning Shift"), ("نص كلمة", "نص", "كلمة", "[OMITTED]", "Meaning Shift"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, clean_ar string, error_ar string, keyword string, best_match string, error_type string")
    got = {r.i: r for r in gates.constraints(df).collect()}
    assert (got[0].ocs, got[0].ocs_match_rule_kw, got[0].ocs_match_rule_bm) == (1.0, "prefix_ال", "prefix_ال")
    assert got[1].ocs_failed_constraints == ["keyword_present_in_error_1", "best_match_absent_in_error_0"]
    assert got[2].ocs_failed_constraints == ["clean_ar_empty"] and got[3].ocs_failed_constraints == ["keyword_missing", "best_match_missing"]
    assert got[4].ocs == 1.0 and got[5].ocs_failed_constraints == ["omission_best_match_not_OMITTED", "keyword_present_in_error_1"]
    assert (got[6].ocs, got[6].ocs_rescued_by, got[6].ocs_norm_level) == (1.0, "both", "diacritics")
    assert got[7].ocs_failed_constraints == ["best_match_OMITTED_for_non_omission"] and got[7].bm_count_error_tok == 0


def test_validator_partitions_the_rows(spark):
    r = random.Random(3)
    words = ["cat", "dogs", "reading", "unread", "tree"]
    rows = [(i, " ".join(r.choice(words) for _ in range(4)), " ".join(r.choice(words) for _ in range(r.randrange(0, 5))), r.choice(words), r.choice([*words, "[OMITTED]"]), r.choice(["Spelling Error", "Meaning Shift", "Total Omission", "Nope"]), r.choice([None, 0.5, 0.7, 0.95])) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, clean_ar string, error_ar string, keyword string, best_match string, error_type string, sfr double")
    out = gates.validate(df, taxonomy.default_rubric(spark), script="[a-z]", affixes=ENGLISH, compose=False).persist()
    parts = gates.routed(out)
    assert sum(parts[k].count() for k in ("clean", "noisy", "discarded")) == 200
    for x in out.collect():
        assert all(0 <= v <= 1 for v in (x.csr, x.cps, x.sfr, x.mpqs, x.ocs)) and x.passed == (x.bucket != "discarded")
        assert (x.reject_reason in gates.FATAL) == (x.bucket == "discarded")
        assert x.quality_tier is None or x.bucket == "clean"
        assert ("violates_clean_standard" in x.flags) == (x.bucket == "noisy" and x.error_type != "Nope")
    stats = gates.routing_stats(out).first()
    assert stats.total == 200 and stats.clean_a + stats.clean_b <= stats.clean
    assert gates.counters(out).where("counter = 'bucket'").agg(F.sum("n")).first()[0] == 200
    assert gates.routing_stats(out.where("false")).first().clean_rate == 0.0


def test_reject_reasons_in_order(spark):
    r = taxonomy.default_rubric(spark)
    rows = [("Nope", 1.0, 1.0, 1.0, 1.0, "unknown_error_type"), ("Spelling Error", None, 1.0, 1.0, 1.0, "missing_metric"), ("Spelling Error", float("nan"), 1.0, 1.0, 1.0, "metric_out_of_range"), ("Spelling Error", 1.0, 0.0, 1.0, 1.0, "ocs_failed"),
            ("Spelling Error", 1.0, 1.0, 0.1, 0.54, "cps_below_floor"), ("Wrong Structure", 1.0, 1.0, 0.1, 0.5, "sfr_below_floor"), ("Wrong Structure", 0.0, 1.0, 0.62, 0.45, None), ("Meaning Shift", 0.89, 1.0, 0.5, 0.0, "csr_exceeds_maximum"),
            ("Meaning Shift", 0.88, 1.0, 0.44, 0.0, "sfr_below_minimum"), ("Meaning Shift", 0.5, 1.0, 0.79, 0.0, "sfr_above_maximum"), ("Total Omission", 1.0, 1.0, 1.0, 0.9, None)]
    df = spark.createDataFrame(rows, "error_type string, csr double, ocs double, sfr double, cps double, want string")
    for x in gates.with_rubric(df, r).withColumn("got", gates.reject_reason("csr", "ocs", "sfr", "cps")).collect():
        assert x.got == x.want


def test_lite_gate(spark):
    df = spark.createDataFrame([(1, 0.40), (1, 0.60), (1, 0.70), (0, 0.99)], "ocs int, mpqs_lite double")
    assert gates.filter_clean(df).count() == 2 and gates.filter_clean(df, strict=True).count() == 1
    one = spark.createDataFrame([("a السلام c d", "a الأمن c d", "السلام", "الأمن"), ("x", "y", "k", "b")], "ar_ref string, mt_output string, keyword string, best_match string")
    a, b = gates.lite_scores(one).collect()
    assert a.ocs == 1 and a.cps_proxy == 1.0 and a.sfr_proxy == 0.6 and a.mpqs_lite == 0.9 and a.accepts_basic and b.ocs == 0 and not b.accepts_basic


def test_rubric_and_taxonomy(spark):
    t = taxonomy.taxonomy(spark)
    assert {r.status for r in taxonomy.taxonomy_checks(t).collect()} == {"pass"}
    assert {r.check_id for r in taxonomy.taxonomy_checks(t.where("label_id != 3")).where("status = 'fail'").collect()} == {"C01", "C03", "C04", "C05b"}
    meta = t.selectExpr("class", "severity_score", "severity_level", "tqa_category", "sum(class_weight) over (partition by `group`) as group_weight", "sum(class_weight) over (partition by tqa_category) as category_weight")
    assert {r.status for r in taxonomy.meta_checks(t, meta).collect()} == {"pass"}
    r = taxonomy.default_rubric(spark)
    assert r.count() == 23 and r.where("inverted").count() == 2 and r.where("regime = 'D'").first().error_type == "Meaning Shift"
    raw = spark.createDataFrame(list(taxonomy.RUBRIC[:2]) + [taxonomy.RUBRIC[0]], "Error_Type string, Class string, CSR_Min double, OCS_Min double, SFR_Min double, SFR_Max double, Weight_CSR double, Weight_OCS double, Weight_SFR double, Inverted boolean")
    with pytest.raises(ValueError, match="repeats"):
        taxonomy.rubric_table(raw, None)
    with pytest.raises(ValueError, match="not 23"):
        taxonomy.rubric_table(raw.limit(2))
    with pytest.raises(ValueError, match="lacks"):
        taxonomy.rubric_table(raw.drop("SFR_Max"))


def test_checks(spark):
    labels = spark.createDataFrame([("A",)], "label string")
    df = spark.createDataFrame([("1", "A", "abc", "k abc", "k"), ("1", "B", None, "9", "x"), ("2", None, " ", "b", None)], "sample_id string, `Sub-Subtype` string, ar string, mt_output string, Keyword string")
    got = {r.check_id: (r.status, r.n_bad) for r in checks.file_checks(df, labels, script="[a-z]").collect()}
    assert got == {"labels_known": ("fail", 1), "ids_unique": ("fail", 1), "texts_present": ("fail", 2), "texts_in_script": ("fail", 1), "keyword_in_ref": ("warn", 3)}
    assert checks.label_rule("Sub-Subtype", labels, df).count() == 1 and checks.flagged_keywords(df).count() == 3
    v = checks.verdict(checks.file_checks(df, labels, script="[a-z]")).first()
    assert (v.n_fail, v.n_warn, v.exit_code) == (4, 1, 1)
    assert checks.leak_check(df, df.limit(1), "sample_id").first().status == "fail"
    ids = taxonomy.label_ids(spark)
    rows = spark.createDataFrame([("Spelling Error", 21, "Fluency"), ("Spelling Error", 1, "style"), ("Odd", 0, "")], "l string, label_id int, tqa_category string")
    assert [r.n_bad for r in checks.label_id_checks(rows, ids, taxonomy.taxonomy(spark), "l").orderBy("check_id").collect()] == [1, 1, 1]


def test_curation(spark):
    df = spark.range(200).selectExpr("id", "case when id < 190 then concat('c', id % 4) else 'rare' end as label", "id % 37 as grp")
    q = curation.stratified_quota(df, "label", df, 43, "id").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in q} == {"c0": 9, "c1": 9, "c2": 9, "c3": 8, "rare": 8}
    folds = curation.stratified_group_folds(df, "grp", "label")
    assert folds.count() == 200 and curation.leaking_groups(folds, "grp").count() == 0 and folds.select("fold").distinct().count() == 5
    assert curation.leaking_groups(curation.hash_group_folds(df, "grp"), "grp").count() == 0
    few = curation.stratified_folds(df.where("label != 'rare' or id < 193"), "label", "id")
    assert {r.fold for r in few.where("label = 'rare'").collect()} == {-1}
    seq = curation.with_sequence(df.repartition(7), "n", ["id"])
    assert all(r.id == r.n for r in seq.collect())
    assert [r.n for r in curation.with_sequence(df.limit(2), "n", ["id"], "T_%03d").orderBy("id").collect()] == ["T_000", "T_001"]
    split = {r.split: r["count"] for r in curation.three_way_split(df, "label", "id").groupBy("split").count().collect()}
    assert sum(split.values()) == 200 and split["train"] > 130
    nulls = spark.createDataFrame([(1,), (None,), (3,)], "Sentence_ID int")
    assert curation.remove_leakage(nulls, nulls.where("Sentence_ID = 1 or Sentence_ID is null")).count() == 2
    assert curation.spot_check(df, "id").count() == 30 and curation.spot_check(df.where("false"), "id").count() == 0
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert {tuple(r) for r in curation.latest(old, spark.createDataFrame([("b", 5), ("c", 6)], "k string, v int"), ["k"]).collect()} == {("a", 1), ("b", 5), ("c", 6)}
    fixed = curation.apply_manifests(old.withColumn("l", F.lit("x")), "k", "l", old.where("k = 'a'"), spark.createDataFrame([("b", "y")], "k string, label_new string"), spark.createDataFrame([("b", 9)], "k string, v_corrected int"), "v")
    assert [tuple(r) for r in fixed.collect()] == [("b", 9, "y")]


def brute_f1(pairs, labels=None):
    out = {}
    for c in labels or sorted({x for p in pairs for x in p}):
        tp, fp, fn = (sum(f(t, p) for t, p in pairs) for f in (lambda t, p: t == p == c, lambda t, p: p == c != t, lambda t, p: t == c != p))
        out[c] = (2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0, tp + fn)
    return out


def test_evaluation_against_loops(spark):
    r = random.Random(4)
    pairs = [(r.choice("abcd"), r.choice("abcde")) for _ in range(300)]
    df = spark.createDataFrame([(i, *p, i % 3) for i, p in enumerate(pairs)], "k int, true_label string, pred_label string, fold int")
    s, want = evaluation.summary(df).first(), brute_f1(pairs)
    assert s.macro_f1 == pytest.approx(sum(f for f, _ in want.values()) / len(want)) and s.accuracy == pytest.approx(sum(t == p for t, p in pairs) / 300)
    assert s.weighted_f1 == pytest.approx(sum(f * n for f, n in want.values()) / 300)
    assert evaluation.summary(df, labels=list("abcd")).first().macro_f1 == pytest.approx(sum(f for f, _ in brute_f1(pairs, list("abcd")).values()) / 4)
    assert evaluation.confusion(df).agg(F.sum("n")).first()[0] == 300 and evaluation.confusion(df).count() == 25
    folds = evaluation.summary(df, by=("fold",))
    assert evaluation.best_fold(folds).first().macro_f1 == evaluation.over_folds(folds).first().best
    ci = evaluation.bootstrap_ci(df, 60).first()
    assert ci.resamples == 60 and ci.ci_lower < s.macro_f1 < ci.ci_upper
    same = evaluation.paired_bootstrap(df, df, "k", 20).first()
    assert same.delta_macro_f1 == 0 and same.p_value == 1.0 and not same.significant


def test_numbers_are_exact_in_large_tables(spark, tmp_path):
    """Two million rows in several files, with a column beside the key: 0 to n - 1, each once, in order."""
    n = 2_000_000
    path = str(tmp_path / "big")
    spark.range(n).selectExpr("pmod(id * 7919, 2000000) as id", "concat('payload ', id) as pay", "id % 3 as g").repartition(11).write.parquet(path)
    big = spark.read.parquet(path)
    got = curation.with_sequence(big, "n", ["id"])
    assert got.where("n != id").isEmpty() and got.agg(F.countDistinct("n")).first()[0] == n
    by = curation.with_sequence(big, "n", ["id"], by=("g",)).groupBy("g").agg(F.countDistinct("n").alias("k"), F.max("n").alias("m"), F.count("*").alias("c"))
    assert all(r.k == r.c == r.m + 1 for r in by.collect()) and by.count() == 3


def test_each_resample_draws_as_many_rows_as_there_are():
    for b in range(3):
        drawn = evaluation.draw_counts([133_334, 0, 200_000, 66_666], b)
        assert drawn.sum() == 400_000 and drawn[1] == 0 and list(drawn) == list(evaluation.draw_counts([133_334, 0, 200_000, 66_666], b))
        assert all(abs(n - e) < 5 * e**0.5 for n, e in zip(drawn, (133_334, 0, 200_000, 66_666), strict=True) if e)


def macro(pairs):
    scores = brute_f1(pairs, sorted({x for p in pairs for x in p if x is not None}))
    return sum(f for f, _ in scores.values()) / len(scores)


def test_bootstraps_against_loops(spark):
    """The same draws scored by loops; and, by its moments, drawing row by row."""
    r = random.Random(5)
    rows = [(i, r.choice("aabc"), *r.choices(["a", "b", "c", "d", None], [6, 3, 3, 1, 1], k=2)) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, true_label string, pred_label string, other string")
    cells = sorted(Counter((t, p, q) for _, t, p, q in rows).items(), key=lambda c: [(x is not None, x or "") for x in c[0]])  # nulls first, as Spark sorts
    want = []
    for b in range(100):
        drawn = [(c, n) for (c, _), n in zip(cells, evaluation.draw_counts([n for _, n in cells], b), strict=True)]
        want.append([macro([(c[0], c[m]) for c, n in drawn for _ in range(n)]) for m in (1, 2)])
    got = [x.f1 for x in evaluation.resampled_f1(df, 100, preds_of=("pred_label", "other")).orderBy("b").collect()]
    assert len(got) == 100 and all(g == pytest.approx(w) for g, w in zip(got, want, strict=True))
    loops = [macro([rows[r.randrange(120)][1:3] for _ in range(120)]) for _ in range(1500)]
    f1 = [x.f1[0] for x in evaluation.resampled_f1(df, 1500).collect()]
    assert abs(statistics.mean(f1) - statistics.mean(loops)) < 0.008 and 0.85 < statistics.stdev(f1) / statistics.stdev(loops) < 1.15
    ci = evaluation.bootstrap_ci(df, 1500).first()
    assert ci.resamples == 1500 and ci.mean_f1 == pytest.approx(statistics.mean(f1))
    s = sorted(f1)
    for q, at in ((ci.ci_lower, 0.025 * 1499), (ci.ci_upper, 0.975 * 1499)):
        assert q == pytest.approx(s[int(at)] + (at % 1) * (s[int(at) + 1] - s[int(at)]))
    other = df.select("k", "true_label", F.col("other").alias("pred_label"))
    pair = evaluation.paired_bootstrap(df, other, "k", 100).first()
    assert pair.p_value == pytest.approx(1 - sum(round(x - y, 12) > 0 for x, y in want) / 100) and pair.delta_macro_f1 == pytest.approx(macro([x[1:3] for x in rows]) - macro([(x[1], x[3]) for x in rows]))
    none = evaluation.bootstrap_ci(df.where("false"), 10).first()
    assert none.resamples == 0 and none.mean_f1 is None


def test_samples_and_folds_of_a_hot_label(spark):
    df = spark.range(30_000).selectExpr("id", "case when id % 10 < 9 then 'hot' when id % 100 = 9 then null else 'cold' end as label")
    folds = curation.stratified_folds(df, "label", "id").groupBy("label", "fold").count().collect()
    sizes = {k: [r["count"] for r in folds if r.label == k] for k in ("hot", "cold", None)}
    assert all(len(v) == 5 and max(v) - min(v) <= 1 for v in sizes.values()) and sum(map(sum, sizes.values())) == 30_000
    split = {(r.label, r.split): r["count"] for r in curation.three_way_split(df, "label", "id").groupBy("label", "split").count().collect()}
    assert split["hot", "train"] == 18_900 and split["hot", "valid"] == 4_050 and split["hot", "test"] == 4_050
    plan = curation.sample_per_group(df, "label", 5, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_registered_bootstraps_run_the_operators_resamples(spark, tmp_path):
    from inspect import signature

    from quillgauge.queries import curation

    spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(12)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    for query, operator, times in ((curation.bootstrap_ci, evaluation.bootstrap_ci, 1000), (curation.paired_bootstrap, evaluation.paired_bootstrap, 10_000)):
        assert query(spark, str(tmp_path)).first().resamples == times == signature(operator).parameters["times"].default


def test_agreement_and_adjustment(spark):
    pairs = spark.createDataFrame([("q", "1", "1"), ("q", "1", "1"), ("r", "1", "0"), ("r", "0", "0"), ("r", "1", "1"), ("r", None, "1"), ("r", " ", "1")], "criterion string, a string, b string")
    got = {x.criterion: (x.n, x.ac1) for x in evaluation.gwet_ac1(pairs).collect()}
    assert got["q"] == (2, 1.0)
    pe = 2 * 0.5 * 0.5
    assert got["r"][0] == 3 and got["r"][1] == pytest.approx((2 / 3 - pe) / (1 - pe))
    tests = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.9])], "pair int, p_value double")
    from quillgauge.queries.curation import P_VALUES

    published = spark.createDataFrame(list(enumerate(P_VALUES)), "pair int, p_value double")
    assert [round(x.p_adjusted, 6) for x in evaluation.bh_adjusted(published).orderBy("pair").collect()] == [0.078, 0.3028, 0.0, 0.007, 0.574444, 0.7726, 0.355, 0.355, 0.015333, 0.355]
    assert [round(x.p_adjusted, 6) for x in evaluation.bh_adjusted(tests).orderBy("pair").collect()] == [0.04, 0.053333, 0.053333, 0.9]


def test_correlations_with_ties_and_without_variance(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 2.0, 5.0), ("a", 3.0, 9.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0)], "g string, x double, y double")
    got = {r.g: r for r in evaluation.correlations(df, "x", "y", ("g",)).collect()}
    assert got["a"].spearman == pytest.approx(0.9486833) and got["a"].mae == pytest.approx(3.0) and got["b"].pearson is None and got["b"].spearman is None
    d = evaluation.density(df, "y", 200, 0.5).collect()
    step = d[1]["at"] - d[0]["at"] if len(d) > 1 else 0
    assert 0.7 < abs(sum(r.density for r in d) * abs(step)) or math.isclose(step, 0)


def test_tfidf_baseline(spark):
    df = spark.createDataFrame([(f"good fine {i}", "p") for i in range(20)] + [(f"bad poor {i}", "n") for i in range(20)], "text string, label string")
    for kind in ("logistic", "svc"):
        model = evaluation.tfidf_pipeline("text", "label", kind).fit(df)
        assert model.transform(df).where("y = prediction").count() == 40


def test_sources(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('﻿source_en,ar_ref,mt_output\n"a, ""q""\nb",r,m\n', encoding="utf-8")
    df = files.read_csv(spark, str(p), required=["source_en", "ar_ref"])
    assert df.columns[0] == "source_en" and df.first().source_en == 'a, "q"\nb'
    with pytest.raises(ValueError):
        files.read_csv(spark, str(p), required=["nope"])
    with pytest.raises(KeyError):
        files.read_column(spark, str(p), "nope")
    j = tmp_path / "p.json"
    j.write_text(json.dumps({"A": [{"keyword": "k", "best_match": "b"}, {"keyword": "k2", "best_match": "[OMITTED]"}], "B": []}))
    assert {tuple(r) for r in files.read_patterns(spark, str(j)).collect()} == {("A", "k", "b"), ("A", "k2", "[OMITTED]")}
    assert files.first_existing(spark, [str(tmp_path / "no"), str(j)]) == str(j)
    with pytest.raises(FileNotFoundError):
        files.first_existing(spark, [str(tmp_path / "no")])
    assert files.merged_config({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}, "c": 4}) == {"a": {"x": 1, "y": 3}, "b": 1, "c": 4}
    files.write_csv(spark.createDataFrame([(["a", "b"], ["c"], 1)], "flags array<string>, ocs_failed_constraints array<string>, n int"), str(tmp_path / "out"))
    assert files.read_csv(spark, str(tmp_path / "out")).first().flags == "a,b"
    files.write_csv(files.empty_candidates(spark), str(tmp_path / "none"))
    renamed = files.aliased(spark.createDataFrame([("x", "y", 3)], "ar string, error_ar string, other int"), files.VALIDATOR_ALIASES)
    assert renamed.columns == ["clean_ar", "error_ar", "error_type", "keyword", "best_match", "other"] and renamed.first().error_type is None


def test_flow_and_scorers(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "the reader left home", "the writer left home"), ("s2", "x", "y")], "source_en string, ar_ref string, mt_output string")
    pats = spark.createDataFrame([("A", "reader", "writer")], "sub_subtype string, keyword string, best_match string")
    out = flow.run(rows, pats, scorer=lambda: lambda f: [[0.0, 2.0]] * len(f), labels=("n", "p"), affixes=ENGLISH)
    r = out.collect()
    assert len(r) == 1 and r[0].predicted_label == "p" and r[0].confidence == pytest.approx(1 / (1 + math.exp(-2))) and r[0].source_row_id == 0
    assert out.columns == files.empty_candidates(spark).columns and flow.distribution(out).first().n == 1
    assert flow.run(rows, pats, require_audit=True).count() == 0
    audited = scorers.audit(flow.candidates(rows, pats), scorers.rule_judge).first()
    assert audited.phenomenon_clarity == 5 and audited.audit_skipped is False and 0 <= audited.dqi <= 1
    assert scorers.audit(flow.candidates(rows, pats), None).first().audit_skipped
    spans = scorers.extract_spans(rows, lambda: lambda f: [(4, 10)] * len(f)).orderBy("source_en").collect()
    assert spans[0].span_text == "writer" and spans[1].span_start is None
    emb = scorers.embed(rows, "ar_ref", lambda: lambda ts: [[float(len(t))] for t in ts]).orderBy("source_en").collect()
    assert emb[1].embedding == [1.0]
    g = facade.Gauge(spark, affixes=ENGLISH)
    df = rows.selectExpr("ar_ref as clean_ar", "mt_output as error_ar", "'reader' as keyword", "'writer' as best_match", "'Spelling Error' as error_type", "0.9D as sfr")
    v = g.validate(df, "sfr").orderBy(F.desc("clean_ar")).collect()
    assert v[0].ocs == 0.0 and v[1].ocs == 1.0 and v[1].accepts_basic and g.validate(df).first().quality_tier is None
    assert facade.taxonomy_map(spark)["Spelling Error"]["label_id"] == 21


def test_command_line(spark, tmp_path):
    (tmp_path / "in.csv").write_text("source_en,ar_ref,mt_output\ns,the reader left home,the writer left home\ns,the reader,odd writer\n", encoding="utf-8")
    (tmp_path / "pats.json").write_text(json.dumps({"A": [{"keyword": "reader", "best_match": "writer"}]}))
    (tmp_path / "labels.json").write_text(json.dumps({"second": 1, "first": 0}))
    given = ["--input", str(tmp_path / "in.csv"), "--patterns", str(tmp_path / "pats.json"), "--label-map", str(tmp_path / "labels.json"), "--output"]
    run = lambda name, *more: (flow.main([*given, str(tmp_path / name), *more]), files.read_csv(spark, str(tmp_path / name)).collect())
    code, rows = run("a")
    assert code == 0 and len(rows) == 1 and rows[0].confidence == "0.0"
    code, rows = run("b", "--skip-gate", "--scorer", "quillgauge.plans.scorers:rule_scorer", "--batch-size", "3")
    assert code == 0 and len(rows) == 2 and {r.predicted_label for r in rows} == {"second"} and rows[0].mpqs_lite is None
    assert run("c", "--scorer", "no.module:x", "--skip-classifier")[0] == 0
    code, rows = run("d", "--audit", "quillgauge.plans.scorers:rule_judge", "--audit-min", "0.0", "--skip-gate")
    assert code == 0 and len(rows) <= 2
    assert flow.main([*given, str(tmp_path / "e"), "--scorer", "no.module:x"]) == 3 and flow.main([*given, str(tmp_path / "e"), "--audit", "json:nothing"]) == 3
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    assert flow.main(["--input", str(tmp_path / "bad.csv"), "--patterns", str(tmp_path / "pats.json"), "--output", str(tmp_path / "f")]) == 2
    assert flow.main(["--input", str(tmp_path / "none.csv"), "--patterns", str(tmp_path / "pats.json"), "--output", str(tmp_path / "f")]) == 2


def test_published_demo_rows(spark):
    """Golden values: three of the published pairs, the patterns of their rows, and their scores."""
    rows = [
        (1, "ويؤيد الجهاز المركزي بحزم الجهود التي تبذلها بلدان المنطقة للتصدي للحالة السائدة في أنجوان.", "ويؤيد الجهاز المركزي بقوة الجهود التي تبذلها بلدان المنطقة للتعامل مع الوضع السائد في أنجوان."),
        (6, "رسالة مؤرخة ٨ شباط/فبراير ١٩٩٩ موجهة من البعثة الدائمة", "رسالة مؤرخة 8 شباط/فبراير 1999 من الممثل الدائم لـ"),
        (9, "٢ - الحالة بين إريتريا وإثيوبيا", "2. الوضع بين إريتريا وإثيوبيا"),
    ]
    pats = [("حالة", "أجواء"), ("حالة", "الغلاف الجوي"), ("منطقة", "مجال"), ("بعثة", "عملية"), ("بعثة", "قوة"), ("حالة", "[OMITTED]")]
    df = spark.createDataFrame([(*r, "") for r in rows], "source_row_id long, ar_ref string, mt_output string, source_en string")
    p = spark.createDataFrame([("Meaning Shift", *x) for x in pats], "sub_subtype string, keyword string, best_match string")
    got = {(r.source_row_id, r.keyword, r.best_match): (r.ocs, r.cps_proxy, r.sfr_proxy, r.mpqs_lite, r.accepts_basic) for r in flow.run(df, p, "as_shipped").collect()}
    assert got == {
        (1, "حالة", "أجواء"): (1, 0.7143, 0.5263, 0.753, True), (1, "حالة", "الغلاف الجوي"): (1, 0.7143, 0.5263, 0.753, True), (1, "منطقة", "مجال"): (1, 0.6429, 0.5263, 0.7209, True),
        (6, "بعثة", "عملية"): (1, 0.4444, 0.2857, 0.5714, True), (6, "بعثة", "قوة"): (1, 0.4444, 0.2857, 0.5714, True),
        (9, "حالة", "أجواء"): (1, 0.5, 0.375, 0.6188, True), (9, "حالة", "الغلاف الجوي"): (1, 0.5, 0.375, 0.6188, True),
    }


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    pairs = spark.createDataFrame([("the reader left home", "the writer left home"), ("x", "y")], "ar_ref string, mt_output string")
    pairs.write.parquet(src)
    pats = spark.createDataFrame([("A", "reader", "writer")], "sub_subtype string, keyword string, best_match string")
    q = gate.to_table(gate.gate_stream(gate.file_stream(spark, src, pairs.schema), pats, "literal"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    ev = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "t string, k string").select(F.to_timestamp("t").alias("ts"), "k")
    assert {(r.k, r.n) for r in gate.windowed_counts(ev, "ts", "k").collect()} == {("a", 2), ("b", 1)}


def test_spark_queries_equal_sql(spark):
    """Every registered query that has SQL, at the smallest scale, where the tables are there."""
    import os

    import duckdb

    from quillgauge.queries import curation as c
    from quillgauge.queries import forms, rules, text

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")

    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, bool):
            return v
        return f"{float(v):.6g}" if isinstance(v, int | float) or type(v).__name__ == "Decimal" else str(v)

    bad = []
    every = text.QUERIES | rules.QUERIES | forms.QUERIES | c.QUERIES
    assert {name for name, (_, sql) in every.items() if not sql} == {"bootstrap_ci", "paired_bootstrap"}  # held against loops above
    for name, (f, sql) in every.items():
        if not sql:
            continue
        got = f(spark, d)
        cols = sorted(got.columns)
        a = sorted((tuple(plain(r[x]) for x in cols) for r in got.collect()), key=str)
        rel = con.sql(sql)
        b = sorted((tuple(plain(dict(zip(rel.columns, r, strict=True))[x]) for x in cols) for r in rel.fetchall()), key=str)
        if sorted(rel.columns) != cols or a != b:
            bad.append(name)
    assert bad == []
