"""Text functions, affix matching and metrics on hand-made cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillgauge.functions import metrics as M
from quillgauge.functions import prompts
from quillgauge.functions import text as T
from quillgauge.functions.affix import ARABIC, ENGLISH, Affixes, count_matches, match_rule
from quillgauge.operators.matching import affix_match_join, find_candidates, occurs


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("token, keyword, rule", [
    ("الحالة", "الحالة", "exact"), ("الحالة", "حالة", "prefix_ال"), ("تابعين", "تابع", "suffix_ين"), ("للحالة", "حالة", "prefix_لل"),
    ("الخاصة", "خاص", "both_ال_ة"), ("حالة", "غير_موجود", ""), ("حالة", "الحالة", "kw_prefix_ال"), ("تابع", "تابعين", "kw_suffix_ين"),
])
def test_match_rules(spark, token, keyword, rule):
    assert value(spark, match_rule(F.lit(token), F.lit(keyword), ARABIC)) == rule


def brute_rule(t, k, a: Affixes):
    def pre(x):
        return next(((x[len(p) :], p) for p in a.prefixes if x.startswith(p) and len(x) > len(p)), (x, ""))

    def suf(x):
        return next(((x[: -len(s)], s) for s in a.suffixes if x.endswith(s) and len(x) > len(s)), (x, ""))

    (bp, p), (bs, s), (kp, p2), (ks, s2) = pre(t), suf(t), pre(k), suf(k)
    tries = [(t == k, "exact"), (p and bp == k, f"prefix_{p}"), (s and bs == k, f"suffix_{s}"), (p and suf(bp)[1] and suf(bp)[0] == k, f"both_{p}_{suf(bp)[1]}")]
    tries += [(s and pre(bs)[1] and pre(bs)[0] == k, f"both_{pre(bs)[1]}_{s}"), (p2 and t == kp, f"kw_prefix_{p2}"), (s2 and t == ks, f"kw_suffix_{s2}")]
    return next((r for ok, r in tries if ok), "")


def affix_match_cascade(tokens, patterns, affixes):
    """The same result by comparing every token with every keyword."""
    pairs = tokens.crossJoin(patterns.select("keyword").distinct())
    return pairs.withColumn("rule", match_rule("token", "keyword", affixes)).where("rule != ''")


@pytest.mark.parametrize("affixes, letters", [(ARABIC, "ولابكفتينةه"), (ENGLISH, "unrethigds")])
def test_join_equals_cascade_and_loops(spark, affixes, letters):
    r = random.Random(1)
    made = lambda n, most: sorted({"".join(r.choice(letters) for _ in range(r.randrange(1, most))) for _ in range(n)})
    tokens, keywords = made(500, 7), made(120, 5)
    t = spark.createDataFrame([(x,) for x in tokens], "token string")
    k = spark.createDataFrame([(x,) for x in keywords], "keyword string")
    want = {(x, y, brute_rule(x, y, affixes)) for x in tokens for y in keywords if brute_rule(x, y, affixes)}
    joined = affix_match_join(t, k, affixes).select("token", "keyword", "rule")
    assert {tuple(x) for x in joined.collect()} == want == {tuple(x) for x in affix_match_cascade(t, k, affixes).select("token", "keyword", "rule").collect()}
    once = affix_match_join(t.selectExpr("token", "length(token) as n"), k, affixes, unique=True)
    assert {tuple(x) for x in once.collect()} == {(x, len(x), y, z) for x, y, z in want}
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


@pytest.mark.parametrize("toks, keyword, n, rule", [
    (["the", "reading", "read"], ["read"], 2, "suffix_ing"), (["a", "b", "c"], ["b", "c"], 1, "exact_seq"), (["a", "unb", "c"], ["b", "c"], 1, "seq_prefix_un"),
    (["b", "cs"], ["b", "c"], 1, "seq_suffix_s"), (["x"], ["b", "c"], 0, ""), ([], ["b"], 0, ""), (["a"], [], 0, ""),
])
def test_counts(spark, toks, keyword, n, rule):
    df = spark.createDataFrame([(toks, keyword)], "t array<string>, k array<string>").select(count_matches("t", "k", ENGLISH).alias("v"))
    assert tuple(df.first().v) == (n, rule)


def test_normal_form(spark):
    assert value(spark, T.normalize(F.lit("السَّلامُ عَلَيكُم"), True)) == "السلام عليكم"
    assert value(spark, T.normalize(F.lit("  أإآٱ ىـ ٣ ﻻ\t"))) == "اااا ي 3 لا"
    assert value(spark, T.normalize(F.lit(None).cast("string"))) == ""
    assert value(spark, T.tokens(F.lit("été, سياق، (x_1)"))) == ["été", "سياق،", "x_1"]
    assert value(spark, T.strip(F.lit("  a b\n "))) == "a b"


def test_small_text_functions(spark):
    assert value(spark, T.remove_first(F.lit("abcabc"), F.lit("bc"))) == "aabc" and value(spark, T.remove_all(F.lit("abcabc"), F.lit("bc"))) == "aa"
    assert value(spark, T.remove_first(F.lit("abc"), F.lit(""))) == "abc" and value(spark, T.remove_all(F.lit("abc"), F.lit(None).cast("string"))) == "abc"
    assert value(spark, T.contains(F.lit(None).cast("string"), F.lit("a"))) is False
    assert value(spark, T.normalize_label(F.lit(" Negation  "))) == "Tense Shift Under Negation" and value(spark, T.normalize_label(F.lit("Wrong​ Word  Order"))) == "Wrong Word Order"
    assert value(spark, T.anchor_or_omitted(F.lit("NaN"))) == "[OMITTED]" and value(spark, T.anchor_or_empty(F.lit("[OMITTED]"))) == ""
    assert value(spark, T.parse_label(F.lit('"Answer: spelling error."'), ["Meaning Shift", "Spelling Error"])) == "Spelling Error" and value(spark, T.parse_label(F.lit("?"), ["A"])) == "Unknown"
    assert value(spark, T.json_object(F.lit('so: {"a": {"b": 1}} ok'), "a struct<b:int>"))["a"]["b"] == 1 and value(spark, T.json_object(F.lit("none"), "a int")) is None
    assert value(spark, T.span(F.lit("ab cd"), F.lit(2), F.lit(5))) == "cd" and value(spark, T.span(F.lit("ab"), F.lit(2), F.lit(1))) is None
    assert tuple(value(spark, T.char_to_token_span(F.array(F.lit(0), F.lit(4), F.lit(9)), F.array(F.lit(3), F.lit(8), F.lit(12)), F.lit(5), F.lit(10)))) == (1, 2)
    assert value(spark, T.fold_category(F.lit(" style"))) == "Style & Register" and value(spark, T.has_script(F.lit("abc"))) is False


def test_metrics(spark):
    assert value(spark, M.char_similarity(F.lit("kitten"), F.lit("sitting"))) == pytest.approx(1 - 3 / 7) and value(spark, M.char_similarity(F.lit(""), F.lit("a"))) is None
    assert value(spark, M.context_preservation(F.lit("kw"), F.lit("bm"), F.lit("kw"), F.lit("bm"))) == 0.90
    assert value(spark, M.weighted_harmonic(F.lit(0.92), F.lit(1.0), F.lit(0.85), M.LITE)) == 1.0
    assert value(spark, M.normalized_harmonic(F.lit(0.5), F.lit(0.5), F.lit(0.5), M.LITE)) == pytest.approx(0.5)
    assert value(spark, M.weighted_harmonic(F.lit(0.0), F.lit(1.0), F.lit(1.0), M.LITE)) == 0.0 and value(spark, M.weighted_harmonic(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), M.LITE)) is None
    assert value(spark, M.dqi(*(F.lit(5),) * 4)) == 1.0 and value(spark, M.dqi(F.lit(0), F.lit(5), F.lit(5), F.lit(5))) == 0.0
    assert value(spark, M.token_f1(F.lit(""), F.lit(" "))) == 1.0 and value(spark, M.token_f1(F.lit("a b"), F.lit("b c"))) == 0.5
    assert value(spark, M.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.5**0.5) and value(spark, M.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert value(spark, M.data_efficiency(F.lit(0.6558), F.lit(738))) == pytest.approx(0.8886, abs=1e-4)


def test_occurrence_and_candidates(spark):
    assert value(spark, occurs(F.lit("حالة"), F.lit("نعرض الحالة الراهنة"))) is True and value(spark, occurs(F.lit(""), F.lit("a"))) is False
    rows = spark.createDataFrame([(1, "the reader left", "a writer left"), (2, "the cat", "cat")], "id long, ar_ref string, mt_output string")
    pats = spark.createDataFrame([("A", "reader", "writer"), ("B", "the", "[OMITTED]"), ("C", "lefts", "writ")], "sub_subtype string, keyword string, best_match string")
    found = lambda mode: {(r.id, r.sub_subtype) for r in find_candidates(rows, pats, mode, ENGLISH).collect()}
    assert found("literal") == {(1, "A"), (1, "B"), (2, "B")}
    assert found("affix") == {(1, "A"), (1, "B"), (2, "B"), (1, "C")}
    assert found("as_shipped") == {(i, x) for i in (1, 2) for x in "AC"}
    assert find_candidates(rows, pats.where("false")).count() == 0


@pytest.mark.parametrize("mode", ["affix", "literal", "as_shipped"])
def test_many_patterns_equal_loops(spark, mode):
    """20,000 patterns, joined or riding along, against plain loops."""
    r = random.Random(6)
    word = lambda most: "".join(r.choice("unrethigdsabc") for _ in range(r.randrange(1, most)))
    rows = [(i, " ".join(word(7) for _ in range(r.randrange(0, 5))), " ".join(word(7) for _ in range(4))) for i in range(6 if mode == "as_shipped" else 25)] + [(98, None, "x"), (99, "", "")]
    pats = sorted({(r.choice("AB"), word(6), r.choice([word(5), "[OMITTED]"])) for _ in range(23_000)})[:20_000] + [("A", "", "x"), ("B", "un", "")]
    df = spark.createDataFrame(rows, "id long, ar_ref string, mt_output string")

    def there(k, t):
        return bool(k and t) and (k in t or (mode == "affix" and any(brute_rule(x, k, ENGLISH) for x in t.split())))

    def in_text(k, t):
        return there(k, t) if mode == "affix" else t is not None and k in t

    want = {(i, s, k, b) for i, a, m in rows for s, k, b in pats if (b != "[OMITTED]" if mode == "as_shipped" else in_text(k, a) and (not in_text(k, m) if b == "[OMITTED]" else in_text(b, m)))}
    p = spark.createDataFrame(pats, "sub_subtype string, keyword string, best_match string")
    found = find_candidates(df, p, mode, ENGLISH, compose=False, inline=8000)
    got = [(x.id, x.sub_subtype, x.keyword, x.best_match) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    if mode != "as_shipped":
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    few = find_candidates(df, p.limit(300), mode, ENGLISH, compose=False)
    some = find_candidates(df, p.limit(300), mode, ENGLISH, compose=False, inline=10)
    key = lambda x: {(y.id, y.sub_subtype, y.keyword, y.best_match) for y in x.collect()}
    assert key(few) == key(some)


def test_inputs_and_messages(spark):
    form = lambda f, k="k", b="b": tuple(value(spark, prompts.model_input(f, F.lit("r"), F.lit("m"), F.lit(k), F.lit(b))))
    assert form("A") == ("r", "m") and form("B") == ("r", "m k b") and form("C") == ("m", None) and form("D") == ("k b", "r m") and form("D", "nan") == ("r", "m") and form("D", "k", "") == ("k [OMITTED]", "r m")
    assert tuple(value(spark, prompts.shared_input(F.lit("r"), F.lit("m"), F.lit("k"), F.lit("[OMITTED]")))) == ("k", "r m")
    assert "Answer with exactly one class name" in value(spark, prompts.classify_prompt("Do it.", ("A", "B"), F.lit("k"), F.lit("b"), F.lit("r"), F.lit("m"), prompts.few_shot_example(F.lit("A"), F.lit("k" * 99), F.lit("b"), F.lit("r"), F.lit("m"))))
    with pytest.raises(ValueError):
        prompts.model_input("Z", F.lit(""), F.lit(""), F.lit(""), F.lit(""))
