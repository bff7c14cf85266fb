"""Queries over text functions, matching and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import prompts
from ..functions import text as T
from ..functions.affix import ENGLISH, match_rule
from ..operators import gates
from ..operators.matching import affix_match_join, find_candidates
from ..operators.taxonomy import LABELS

LETTERS = "\\p{L}\\p{N}_"
KEYWORDS = ("the", "her", "tion", "ed", "on", "an", "ar", "thin", "un", "er", "ent", "que", "reat", "and")
PATTERNS = (
    ("Meaning Shift", "the", "and"), ("Total Omission", "the", "[OMITTED]"), ("Spelling Error", "on", "er"),
    ("Register Mismatch", "que", "le"), ("Wrong Structure", "der", "die"), ("Partial Translation", "und", "[OMITTED]"),
)


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PATTERNS), "sub_subtype string, keyword string, best_match string")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring turns of the conversations as sentence pairs."""
    c = read(spark, d, "conversations")
    a = c.select("conv_id", "turn", F.col("text").alias("ar_ref"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("mt_output"))
    return a.join(b, ["conv_id", "turn"])


PAIRS = "pairs AS (SELECT a.conv_id, a.turn, a.text AS ar_ref, b.text AS mt_output FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
PATTERN_VALUES = "pats(sub_subtype, keyword, best_match, pattern_no) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {i})" for i, (a, b, c) in enumerate(PATTERNS)) + ")"
WORDS = "list_filter(string_split_regex({0}, '\\s+'), lambda x: x <> '')"


def text_normalize_fold(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.normalize("text", compose=False)).alias("norm_md5"), T.has_script("text").alias("has_script"))


TEXT_NORMALIZE_FOLD = r"""
SELECT doc_id, md5(trim(regexp_replace(translate(text, 'أإآٱى٠١٢٣٤٥٦٧٨٩ـ', 'ااااي0123456789'), '\s+', ' ', 'g'))) AS norm_md5,
       regexp_matches(text, '[\x{0600}-\x{06FF}]') AS has_script FROM documents"""


def token_explode_counts(spark, d):
    return read(spark, d, "documents").select(F.explode(T.tokens("text", LETTERS)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


TOKENS = r"toks AS (SELECT unnest(list_filter(string_split_regex(text, '[^\p{L}\p{N}_]+'), lambda x: x <> '')) AS token FROM documents)"
TOKEN_EXPLODE_COUNTS = f"WITH {TOKENS} SELECT token, count(*) AS n FROM toks GROUP BY token"


def affix_strip(spark, d):
    t = read(spark, d, "documents").select(F.explode(T.tokens("text", LETTERS)).alias("token")).distinct()
    return t.select("token", ENGLISH.prefix("token").alias("prefix"), ENGLISH.without_prefix("token").alias("no_prefix"), ENGLISH.suffix("token").alias("suffix"), ENGLISH.without_suffix("token").alias("no_suffix"))


def _prefix(x: str) -> str:
    return "CASE " + " ".join(f"WHEN starts_with({x}, '{p}') AND length({x}) > {len(p)} THEN '{p}'" for p in ENGLISH.prefixes) + " ELSE '' END"


def _suffix(x: str) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({x}, '{s}') AND length({x}) > {len(s)} THEN '{s}'" for s in ENGLISH.suffixes) + " ELSE '' END"


AFFIX_STRIP = f"""
WITH {TOKENS}, d AS (SELECT DISTINCT token FROM toks), s AS (SELECT token, {_prefix('token')} AS prefix, {_suffix('token')} AS suffix FROM d)
SELECT token, prefix, substr(token, length(prefix) + 1) AS no_prefix, suffix, substr(token, 1, length(token) - length(suffix)) AS no_suffix FROM s"""


def affix_match_join_query(spark, d):
    t = read(spark, d, "documents").select(F.explode(T.tokens("text", LETTERS)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    k = spark.createDataFrame([(k,) for k in KEYWORDS], "keyword string")
    return affix_match_join(t, k, ENGLISH, unique=True).select("token", "n", "keyword", "rule")


AFFIX_MATCH_JOIN = f"""
WITH {TOKENS}, d AS (SELECT token, count(*) AS n FROM toks GROUP BY token),
t1 AS (SELECT token, n, {_prefix('token')} AS p, {_suffix('token')} AS s FROM d),
t2 AS (SELECT *, substr(token, length(p) + 1) AS bp, substr(token, 1, length(token) - length(s)) AS bs FROM t1),
t3 AS (SELECT *, {_suffix('bp')} AS sp, {_prefix('bs')} AS ps FROM t2),
k1(keyword) AS (VALUES {', '.join(f"('{k}')" for k in KEYWORDS)}),
k2 AS (SELECT keyword, {_prefix('keyword')} AS kp, {_suffix('keyword')} AS ks FROM k1),
m AS (SELECT token, n, keyword, CASE
  WHEN token = keyword THEN 'exact'
  WHEN p <> '' AND bp = keyword THEN 'prefix_' || p
  WHEN s <> '' AND bs = keyword THEN 'suffix_' || s
  WHEN p <> '' AND sp <> '' AND substr(bp, 1, length(bp) - length(sp)) = keyword THEN 'both_' || p || '_' || sp
  WHEN s <> '' AND ps <> '' AND substr(bs, length(ps) + 1) = keyword THEN 'both_' || ps || '_' || s
  WHEN kp <> '' AND substr(keyword, length(kp) + 1) = token THEN 'kw_prefix_' || kp
  WHEN ks <> '' AND substr(keyword, 1, length(keyword) - length(ks)) = token THEN 'kw_suffix_' || ks END AS rule
  FROM t3 CROSS JOIN k2)
SELECT token, n, keyword, rule FROM m WHERE rule IS NOT NULL"""


def affix_rule_cascade(spark, d):
    """The cascade as one expression, on names of parts against a keyword."""
    return read(spark, d, "part").select("p_partkey", F.explode(T.words("p_name")).alias("token")).select("p_partkey", "token", match_rule("token", F.lit("part"), ENGLISH).alias("rule"))


AFFIX_RULE_CASCADE = f"""
WITH w AS (SELECT p_partkey, unnest({WORDS.format('p_name')}) AS token FROM part),
a AS (SELECT *, {_prefix('token')} AS p, {_suffix('token')} AS s FROM w),
b AS (SELECT *, substr(token, length(p) + 1) AS bp, substr(token, 1, length(token) - length(s)) AS bs FROM a),
c AS (SELECT *, {_suffix('bp')} AS sp, {_prefix('bs')} AS ps FROM b)
SELECT p_partkey, token, CASE WHEN token = 'part' THEN 'exact' WHEN p <> '' AND bp = 'part' THEN 'prefix_' || p WHEN s <> '' AND bs = 'part' THEN 'suffix_' || s
  WHEN p <> '' AND sp <> '' AND substr(bp, 1, length(bp) - length(sp)) = 'part' THEN 'both_' || p || '_' || sp
  WHEN s <> '' AND ps <> '' AND substr(bs, length(ps) + 1) = 'part' THEN 'both_' || ps || '_' || s ELSE '' END AS rule FROM c"""


def candidate_scan_literal(spark, d):
    return find_candidates(pairs(spark, d), patterns(spark), "literal").select("conv_id", "turn", "sub_subtype", "keyword", "best_match")


HIT = "contains(ar_ref, keyword) AND CASE WHEN best_match = '[OMITTED]' THEN NOT contains(mt_output, keyword) ELSE contains(mt_output, best_match) END"
CANDIDATE_SCAN_LITERAL = f"WITH {PAIRS}, {PATTERN_VALUES} SELECT conv_id, turn, sub_subtype, keyword, best_match FROM pairs CROSS JOIN pats WHERE {HIT}"


def candidate_scan_as_shipped(spark, d):
    return find_candidates(pairs(spark, d), patterns(spark), "as_shipped").groupBy("sub_subtype").agg(F.count("*").alias("n"))


CANDIDATE_SCAN_AS_SHIPPED = f"WITH {PAIRS}, {PATTERN_VALUES} SELECT sub_subtype, count(*) AS n FROM pairs CROSS JOIN pats WHERE best_match <> '[OMITTED]' GROUP BY sub_subtype"


def _token_hit(keyword: str, text: str) -> str:
    x = "x"
    p, s = _prefix(x), _suffix(x)
    bp, bs = f"substr(x, length({p}) + 1)", f"substr(x, 1, length(x) - length({s}))"
    sp, ps = _suffix(f"({bp})"), _prefix(f"({bs})")
    kp, ks = _prefix(keyword), _suffix(keyword)
    rules = (
        f"x = {keyword} OR ({p} <> '' AND {bp} = {keyword}) OR ({s} <> '' AND {bs} = {keyword}) OR ({p} <> '' AND {sp} <> '' AND substr({bp}, 1, length({bp}) - length({sp})) = {keyword})"
        f" OR ({s} <> '' AND {ps} <> '' AND substr({bs}, length({ps}) + 1) = {keyword}) OR ({kp} <> '' AND substr({keyword}, length({kp}) + 1) = x) OR ({ks} <> '' AND substr({keyword}, 1, length({keyword}) - length({ks})) = x)"
    )
    return f"(contains({text}, {keyword}) OR len(list_filter(string_split_regex({text}, '\\s+'), lambda x: x <> '' AND ({rules}))) > 0)"


def candidate_scan_affix(spark, d):
    return find_candidates(pairs(spark, d), patterns(spark), "affix", ENGLISH, compose=False).select("conv_id", "turn", "sub_subtype", "keyword", "best_match")


CANDIDATE_SCAN_AFFIX = f"""
WITH {PAIRS}, {PATTERN_VALUES} SELECT conv_id, turn, sub_subtype, keyword, best_match FROM pairs CROSS JOIN pats
WHERE {_token_hit('keyword', 'ar_ref')} AND CASE WHEN best_match = '[OMITTED]' THEN NOT {_token_hit('keyword', 'mt_output')} ELSE {_token_hit('best_match', 'mt_output')} END"""


def esv_lite(spark, d):
    x = gates.lite_scores(find_candidates(pairs(spark, d), patterns(spark), "literal"))
    return x.select("conv_id", "turn", "pattern_no", "ocs", "cps_proxy", "sfr_proxy", "mpqs_lite", "accepts_basic")


_A, _B = WORDS.format("replace(ar_ref, keyword, '')"), WORDS.format("replace(mt_output, best_match, '')")
_R, _M = WORDS.format("ar_ref"), WORDS.format("mt_output")
SCORES = f"""
WITH {PAIRS}, {PATTERN_VALUES}, hits AS (SELECT * FROM pairs CROSS JOIN pats WHERE {HIT}),
sets AS (SELECT *, list_distinct({_A}) AS a, list_distinct({_B}) AS b, list_distinct({_R}) AS r, list_distinct({_M}) AS m FROM hits),
raw AS (SELECT *, CASE WHEN contains(ar_ref, keyword) OR contains(ar_ref, trim(keyword)) THEN 1 ELSE 0 END AS ocs,
  CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / greatest(len(a), 1) END AS c,
  CASE WHEN len(r) = 0 OR len(m) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(r, m))::DOUBLE / greatest(len(r) + len(m) - len(list_intersect(r, m)), 1) END AS s FROM sets),
scored AS (SELECT *, round(c, 4) AS cps_proxy, round(s, 4) AS sfr_proxy, round(0.45::DOUBLE * c + 0.30::DOUBLE * ocs + 0.25::DOUBLE * s, 4) AS mpqs_lite,
  ocs = 1 AND 0.45::DOUBLE * c + 0.30::DOUBLE * ocs + 0.25::DOUBLE * s >= 0.55 AS accepts_basic FROM raw)"""
ESV_LITE = SCORES + " SELECT conv_id, turn, pattern_no, ocs, cps_proxy, sfr_proxy, mpqs_lite, accepts_basic FROM scored"


def esv_lite_gate(spark, d):
    x = gates.lite_scores(find_candidates(pairs(spark, d), patterns(spark), "literal"))
    return gates.filter_clean(x).groupBy("sub_subtype").agg(F.count("*").alias("n_loose"), F.count_if((F.col("ocs") == 1) & (F.col("mpqs_lite") >= M.STRICT)).alias("n_strict"))


ESV_LITE_GATE = SCORES + " SELECT sub_subtype, count(*) AS n_loose, count(*) FILTER (WHERE mpqs_lite >= 0.65) AS n_strict FROM scored WHERE ocs = 1 AND mpqs_lite >= 0.55 GROUP BY sub_subtype"


def char_similarity_csr(spark, d):
    return read(spark, d, "part").select("p_partkey", F.round(M.char_similarity("p_name", "p_type"), 6).alias("csr"))


CHAR_SIMILARITY_CSR = "SELECT p_partkey, CASE WHEN p_name <> '' AND p_type <> '' THEN round(greatest(0.0, least(1.0, 1 - levenshtein(p_name, p_type)::DOUBLE / greatest(length(p_name), length(p_type)))), 6) END AS csr FROM part"


def context_preservation_cps(spark, d):
    p = read(spark, d, "part").withColumns({"kw": F.element_at(F.split("p_name", " "), 1), "bm": F.element_at(F.split("p_type", " "), 1)})
    return p.select("p_partkey", F.round(M.context_preservation("p_name", "p_type", "kw", "bm"), 6).alias("cps"))


_CUT = "CASE WHEN strpos({0}, {1}) > 0 AND {1} <> '' THEN substr({0}, 1, strpos({0}, {1}) - 1) || substr({0}, strpos({0}, {1}) + length({1})) ELSE {0} END"
CONTEXT_PRESERVATION_CPS = f"""
WITH k AS (SELECT p_partkey, p_name, p_type, trim(string_split(p_name, ' ')[1]) AS kw, trim(string_split(p_type, ' ')[1]) AS bm FROM part),
c AS (SELECT p_partkey, {_CUT.format('p_name', 'kw')} AS a, {_CUT.format('p_type', 'bm')} AS b FROM k)
SELECT p_partkey, round(CASE WHEN trim(a) = '' OR trim(b) = '' THEN 0.9 ELSE greatest(0.0, least(1.0, 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)))) END, 6) AS cps FROM c"""


def token_f1_spans(spark, d):
    return pairs(spark, d).select("conv_id", "turn", F.round(M.token_f1("ar_ref", "mt_output"), 6).alias("f1"), M.exact_match("ar_ref", "mt_output").alias("exact"))


TOKEN_F1_SPANS = f"""
WITH {PAIRS}, s AS (SELECT conv_id, turn, ar_ref = mt_output AS exact, list_distinct({_R}) AS r, list_distinct({_M}) AS m FROM pairs)
SELECT conv_id, turn, round(CASE WHEN len(r) = 0 AND len(m) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(r, m)) / (len(r) + len(m)) END, 6) AS f1, exact FROM s"""


def cosine_sfr(spark, d):
    e = read(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(M.cosine("embedding", "other"), 5).alias("sfr"))


COSINE_SFR = """
SELECT a.vec_id, round(greatest(0.0, least(1.0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 5) AS sfr
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""


def label_normalize(spark, d):
    x = F.concat(F.lit("  "), F.initcap("event_type"), F.lit("  "), F.lit("Definiteness ​"))
    e = read(spark, d, "events").select("event_id", "event_type")
    names = {"Click Definiteness": "click", "View Definiteness": "view", "Definiteness": "Definiteness Shift"}
    return e.select(T.normalize_label(x, names).alias("label"), T.normalize_label(F.lit(" Terminological  Substitution ")).alias("mapped")).groupBy("label", "mapped").agg(F.count("*").alias("n"))


LABEL_NORMALIZE = """
WITH x AS (SELECT upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) || ' Definiteness' AS s FROM events)
SELECT CASE s WHEN 'Click Definiteness' THEN 'click' WHEN 'View Definiteness' THEN 'view' ELSE s END AS label, 'Terminology Substitution' AS mapped, count(*) AS n FROM x GROUP BY ALL"""


def anchor_cleanup(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, " NaN ").when(F.col("o_orderkey") % 5 == 1, "[OMITTED]").when(F.col("o_orderkey") % 5 == 2, "").when(F.col("o_orderkey") % 5 == 3, F.col("o_orderstatus")).alias("a"))
    return o.select("o_orderkey", T.anchor_or_omitted("a").alias("kept"), T.anchor_or_empty("a").alias("bare"))


ANCHOR_CLEANUP = """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN o_orderstatus ELSE '[OMITTED]' END AS kept, CASE o_orderkey % 5 WHEN 3 THEN o_orderstatus ELSE '' END AS bare FROM orders"""


def model_inputs(spark, d):
    p = read(spark, d, "part")
    forms = {f: prompts.model_input(f, "p_name", "p_type", "p_brand", F.lit("[OMITTED]")) for f in "ABCD"}
    s = prompts.shared_input("p_name", "p_type", "p_brand", F.lit("[OMITTED]"))
    return p.select("p_partkey", *(F.concat_ws(" [SEP] ", c["text_a"], c["text_b"]).alias(f"form_{f.lower()}") for f, c in forms.items()), prompts.separated(s["anchor"], s["context"]).alias("shared"))


MODEL_INPUTS = """
WITH t AS (SELECT p_partkey, trim(p_name) AS r, trim(p_type) AS m, trim(p_brand) AS k FROM part)
SELECT p_partkey, r || ' [SEP] ' || m AS form_a, r || ' [SEP] ' || m || ' ' || k || ' [OMITTED]' AS form_b, m AS form_c,
       k || ' [OMITTED] [SEP] ' || r || ' ' || m AS form_d, k || ' [SEP] ' || r || ' ' || m AS shared FROM t"""


def judge_messages(spark, d):
    return read(spark, d, "part").select("p_partkey", prompts.judge_message(F.lit("Spelling Error"), "p_brand", "p_brand", "p_name", "p_type").alias("message"))


JUDGE_MESSAGES = """
SELECT p_partkey, 'error_label: Spelling Error' || chr(10) || 'keyword: ' || p_brand || chr(10) || 'best_match: ' || p_brand || chr(10) || 'clean_ar: ' || p_name || chr(10) || 'error_ar: ' || p_type || chr(10)
  || 'ocs_match_rule: exact' || chr(10) || chr(10) || 'Return your evaluation as a JSON object with keys: anchor_validity (1-5), phenomenon_clarity (1-5), arabic_naturalness (1-5), collateral_severity (1-5), seed_recommendation (1-5), justification (string).' AS message FROM part"""


def json_extract_scores(spark, d):
    e = read(spark, d, "events").select("event_id", F.concat(F.lit("Answer: "), F.to_json(F.struct(F.col("event_id").alias("score"), F.col("event_type").alias("kind"))), F.lit(" end")).alias("t"))
    s = T.json_object("t", "score long, kind string")
    return e.select("event_id", s["score"].alias("score"), s["kind"].alias("kind"))


JSON_EXTRACT_SCORES = "SELECT event_id, event_id AS score, event_type AS kind FROM events"


def llm_label_parse(spark, d):
    names = F.array(*(F.lit(x) for x in LABELS))
    o = read(spark, d, "orders").withColumn("l", F.element_at(names, (F.col("o_orderkey") % 23 + 1).cast("int")))
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('"Error type: '), F.upper("l"), F.lit('"'))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("It is "), F.lower("l"), F.lit(".\nBecause"))).otherwise("no idea")
    return o.select(T.parse_label(raw, list(LABELS)).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


LLM_LABEL_PARSE = f"""
WITH l(i, name) AS (VALUES {', '.join(f"({i}, '{x}')" for i, x in enumerate(LABELS))}),
p AS (SELECT CASE WHEN o_orderkey % 3 = 2 THEN 'Unknown' ELSE name END AS label FROM orders JOIN l ON i = o_orderkey % 23)
SELECT label, count(*) AS n FROM p GROUP BY label"""


def remove_first_and_all(spark, d):
    return read(spark, d, "documents").select("doc_id", F.length(T.remove_first("text", F.lit("the"))).alias("n_first"), F.length(T.remove_all("text", F.lit("the"))).alias("n_all"), T.contains("text", F.lit("the")).alias("has"))


REMOVE_FIRST_AND_ALL = "SELECT doc_id, (length(text) - CASE WHEN contains(text, 'the') THEN 3 ELSE 0 END)::INTEGER AS n_first, length(replace(text, 'the', ''))::INTEGER AS n_all, contains(text, 'the') AS has FROM documents"


def text_spans(spark, d):
    return read(spark, d, "part").select("p_partkey", T.span("p_name", F.lit(0), F.lit(4)).alias("head"), T.span("p_name", F.lit(5), F.lit(3)).alias("none"), T.shorten("p_type", {"STANDARD": "STD", "ECONOMY": "ECO"}).alias("short"))


TEXT_SPANS = "SELECT p_partkey, trim(substr(p_name, 1, 4)) AS head, NULL::VARCHAR AS none, replace(replace(p_type, 'STANDARD', 'STD'), 'ECONOMY', 'ECO') AS short FROM part"

QUERIES = {
    "text_normalize_fold": (text_normalize_fold, TEXT_NORMALIZE_FOLD),
    "token_explode_counts": (token_explode_counts, TOKEN_EXPLODE_COUNTS),
    "affix_strip": (affix_strip, AFFIX_STRIP),
    "affix_match_join": (affix_match_join_query, AFFIX_MATCH_JOIN),
    "affix_rule_cascade": (affix_rule_cascade, AFFIX_RULE_CASCADE),
    "candidate_scan_literal": (candidate_scan_literal, CANDIDATE_SCAN_LITERAL),
    "candidate_scan_as_shipped": (candidate_scan_as_shipped, CANDIDATE_SCAN_AS_SHIPPED),
    "candidate_scan_affix": (candidate_scan_affix, CANDIDATE_SCAN_AFFIX),
    "esv_lite": (esv_lite, ESV_LITE),
    "esv_lite_gate": (esv_lite_gate, ESV_LITE_GATE),
    "char_similarity_csr": (char_similarity_csr, CHAR_SIMILARITY_CSR),
    "context_preservation_cps": (context_preservation_cps, CONTEXT_PRESERVATION_CPS),
    "token_f1_spans": (token_f1_spans, TOKEN_F1_SPANS),
    "cosine_sfr": (cosine_sfr, COSINE_SFR),
    "label_normalize": (label_normalize, LABEL_NORMALIZE),
    "anchor_cleanup": (anchor_cleanup, ANCHOR_CLEANUP),
    "model_inputs": (model_inputs, MODEL_INPUTS),
    "judge_messages": (judge_messages, JUDGE_MESSAGES),
    "json_extract_scores": (json_extract_scores, JSON_EXTRACT_SCORES),
    "llm_label_parse": (llm_label_parse, LLM_LABEL_PARSE),
    "remove_first_and_all": (remove_first_and_all, REMOVE_FIRST_AND_ALL),
    "text_spans": (text_spans, TEXT_SPANS),
}
