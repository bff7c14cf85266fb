"""Queries over curation, evaluation and streaming counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import curation as C
from ..operators import evaluation as E
from .text import read


def _preds(spark, d):
    """Labels as predictions: quality against toxicity turned round, in five folds by id."""
    x = read(spark, d, "labels")
    return x.select("doc_id", F.col("quality").cast("string").alias("true_label"), (1 - F.col("toxic")).cast("string").alias("pred_label"), F.pmod("doc_id", F.lit(5)).alias("fold"))


PREDS = "p AS (SELECT doc_id, quality::VARCHAR AS t, (1 - toxic)::VARCHAR AS p, doc_id % 5 AS fold FROM labels)"


def _scores(by: str = "", source: str = "p", n: str = "count(*)") -> str:
    """CTEs that end in ``cls``: per-class scores, for each ``by``."""
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {lead}t, p"
    return f"""
cells AS (SELECT {lead}t, p, {n} AS n FROM {source} {group}),
parts AS (SELECT {lead}t AS label, CASE WHEN t = p THEN n ELSE 0 END AS tp, 0 AS fp, CASE WHEN t <> p THEN n ELSE 0 END AS fn FROM cells UNION ALL SELECT {lead}p, 0, n, 0 FROM cells WHERE t <> p),
cls AS (SELECT {lead}label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, (sum(tp) + sum(fn))::BIGINT AS support,
  CASE WHEN sum(tp) + sum(fp) = 0 THEN 0 ELSE sum(tp)::DOUBLE / (sum(tp) + sum(fp)) END AS "precision", CASE WHEN sum(tp) + sum(fn) = 0 THEN 0 ELSE sum(tp)::DOUBLE / (sum(tp) + sum(fn)) END AS recall,
  CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) = 0 THEN 0 ELSE 2 * sum(tp)::DOUBLE / (2 * sum(tp) + sum(fp) + sum(fn)) END AS f1 FROM parts GROUP BY {lead}label)"""


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


def confusion_matrix(spark, d):
    return E.confusion(_preds(spark, d)).select("t", "p", "n", *_r("share"))


CONFUSION_MATRIX = f"""
WITH {PREDS}, l AS (SELECT t AS l FROM p UNION SELECT p FROM p), c AS (SELECT t, p, count(*) AS n FROM p GROUP BY t, p),
g AS (SELECT a.l AS t, b.l AS p, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN c ON c.t = a.l AND c.p = b.l)
SELECT t, p, n, round(CASE WHEN sum(n) OVER (PARTITION BY t) > 0 THEN n::DOUBLE / sum(n) OVER (PARTITION BY t) ELSE 0 END, 6) AS share FROM g"""


def f1_macro_weighted(spark, d):
    return E.summary(_preds(spark, d)).select("n", *_r("accuracy", "macro_f1", "weighted_f1", "micro_f1"))


F1_MACRO_WEIGHTED = f"""
WITH {PREDS}, {_scores()} SELECT (SELECT count(*) FROM p) AS n, round((SELECT avg((t = p)::INT) FROM p), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1,
  round(2 * sum(tp)::DOUBLE / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1 FROM cls"""


def per_class_report(spark, d):
    return E.per_class(_preds(spark, d)).select("label", "support", *_r("precision", "recall", "f1"))


PER_CLASS_REPORT = f'WITH {PREDS}, {_scores()} SELECT label, support, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM cls'


def _folds(spark, d):
    return E.summary(_preds(spark, d), by=("fold",))


def fold_scores(spark, d):
    return _folds(spark, d).select("fold", "n", *_r("accuracy", "macro_f1", "weighted_f1"))


FOLDS = f"WITH {PREDS}, {_scores('fold')}, f AS (SELECT fold, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1, sum(support)::BIGINT AS n, sum(tp)::DOUBLE / sum(support) AS accuracy FROM cls GROUP BY fold)"
FOLD_SCORES = FOLDS + " SELECT fold, n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1 FROM f"


def mean_std_folds(spark, d):
    return E.over_folds(_folds(spark, d)).select(*_r("mean", "std", "best"))


MEAN_STD_FOLDS = FOLDS + " SELECT round(avg(macro_f1), 6) AS mean, round(stddev_samp(macro_f1), 6) AS std, round(max(macro_f1), 6) AS best FROM f"


def best_fold(spark, d):
    return E.best_fold(_folds(spark, d)).select("fold", *_r("macro_f1"))


BEST_FOLD = FOLDS + " SELECT fold, round(macro_f1, 6) AS macro_f1 FROM f ORDER BY f.macro_f1 DESC, fold LIMIT 1"


def data_efficiency(spark, d):
    return _folds(spark, d).select("fold", F.round(M.data_efficiency("macro_f1", "n"), 6).alias("des"))


DATA_EFFICIENCY = FOLDS + " SELECT fold, round(macro_f1 / (n / 1000.0), 6) AS des FROM f"

# The operators' own numbers of resamples; multinomial draws are beyond SQL.
TIMES = 1000
PAIRED_TIMES = 10_000
BOOTSTRAP_CI = PAIRED_BOOTSTRAP = None


def bootstrap_ci(spark, d):
    return E.bootstrap_ci(_preds(spark, d), TIMES).select("resamples", *_r("mean_f1", "ci_lower", "ci_upper"))


def paired_bootstrap(spark, d):
    a = _preds(spark, d)
    b = a.withColumn("pred_label", F.when(F.pmod("doc_id", F.lit(3)) == 0, "0").otherwise("1"))
    x = E.paired_bootstrap(a, b, "doc_id", PAIRED_TIMES)
    return x.select(*_r("macro_f1_a", "macro_f1_b", "delta_macro_f1", "p_value", "ci_lower", "ci_upper"), "significant", "resamples")


# P-values of ten model pairs, whose adjusted forms have been published.
P_VALUES = (0.0312, 0.1514, 0.0, 0.0014, 0.517, 0.7726, 0.284, 0.2492, 0.0046, 0.2552)


def bh_fdr(spark, d):
    t = spark.createDataFrame([(i, p) for i, p in enumerate(P_VALUES)], "pair int, p_value double")
    return E.bh_adjusted(t).select("pair", "p_value", "rank", *_r("p_adjusted"))


BH_FDR = f"""
WITH t(pair, p_value) AS (VALUES {', '.join(f'({i}, {p}::DOUBLE)' for i, p in enumerate(P_VALUES))}), r AS (SELECT *, row_number() OVER (ORDER BY p_value, pair) AS rank, count(*) OVER () AS m FROM t)
SELECT pair, p_value, rank, round(least(1.0, min(p_value * m / rank) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_adjusted FROM r"""


def gwet_ac1(spark, d):
    x = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return E.gwet_ac1(x.select(F.col("lang").alias("criterion"), F.col("quality").cast("string").alias("a"), (1 - F.col("toxic")).cast("string").alias("b"))).select("criterion", "n", *_r("agreement", "ac1"))


GWET_AC1 = """
WITH x AS (SELECT lang AS criterion, quality AS a, 1 - toxic AS b FROM labels JOIN documents USING (doc_id)), s AS (SELECT criterion, count(*) AS n, avg((a = b)::INT) AS agreement FROM x GROUP BY criterion),
v AS (SELECT criterion, a AS v FROM x UNION ALL SELECT criterion, b FROM x), k AS (SELECT criterion, v, count(*) AS k FROM v GROUP BY criterion, v),
p AS (SELECT criterion, k / sum(k) OVER (PARTITION BY criterion) AS pi FROM k), c AS (SELECT criterion, sum(pi * (1 - pi)) AS spread, count(*) AS q FROM p GROUP BY criterion)
SELECT criterion, n, round(agreement, 6) AS agreement, round(CASE WHEN q < 2 THEN 1.0 ELSE (agreement - spread / (q - 1)) / (1 - spread / (q - 1)) END, 6) AS ac1 FROM s JOIN c USING (criterion)"""


def class_weights(spark, d):
    langs = spark.createDataFrame([(x,) for x in ("en", "fr", "de", "es", "xx")], "lang string")
    return E.class_weights(read(spark, d, "documents"), "lang", langs).select("lang", "n", *_r("weight"))


CLASS_WEIGHTS = """
WITH l(lang) AS (VALUES ('en'), ('fr'), ('de'), ('es'), ('xx')), c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT lang, coalesce(n, 0) AS n, round(coalesce(sum(n) OVER () / (count(n) OVER () * n), 0.0), 6) AS weight FROM l LEFT JOIN c USING (lang)"""


def leakage_anti_join(spark, d):
    return C.remove_leakage(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id").select("doc_id", "lang", "source")


LEAKAGE_ANTI_JOIN = "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def overlap_semi(spark, d):
    return C.overlap(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id")


OVERLAP_SEMI = "SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"


def stratified_quota_sample(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source")
    return C.stratified_quota(docs, "source", docs, 333, "doc_id")


STRATIFIED_QUOTA_SAMPLE = """
WITH l AS (SELECT source, row_number() OVER (ORDER BY source) AS i, count(*) OVER () AS k FROM (SELECT DISTINCT source FROM documents)),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS r FROM documents)
SELECT doc_id, source FROM r JOIN l USING (source) WHERE r <= 333 // k + CASE WHEN i <= 333 % k THEN 1 ELSE 0 END"""


def sample_per_group(spark, d):
    return C.sample_per_group(read(spark, d, "documents").select("doc_id", "lang"), "lang", 3, "doc_id")


SAMPLE_PER_GROUP = "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 3"


def spot_check_sample(spark, d):
    return C.spot_check(read(spark, d, "documents").select("doc_id"), "doc_id")


SPOT_CHECK_SAMPLE = "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents) WHERE r <= greatest(30, floor(n * 0.05))"


def group_folds(spark, d):
    return C.hash_group_folds(read(spark, d, "conversations").select("conv_id", "turn"), "conv_id")


GROUP_FOLDS = "SELECT conv_id, turn, (('0x' || substr(md5('42|' || conv_id), 1, 8))::BIGINT % 5)::INT AS fold FROM conversations"


def stratified_group_folds(spark, d):
    return C.stratified_group_folds(read(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "role").select("conv_id", "turn", "fold")


STRATIFIED_GROUP_FOLDS = """
WITH s AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL), m AS (SELECT conv_id, arg_max(role, row(n, role)) AS main, sum(n) AS size FROM s GROUP BY conv_id),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY main ORDER BY size DESC, md5('42|' || conv_id), conv_id) - 1 AS k FROM m)
SELECT conv_id, turn, (CASE WHEN (k // 5) % 2 = 0 THEN k % 5 ELSE 4 - k % 5 END)::INT AS fold FROM conversations JOIN r USING (conv_id)"""


def stratified_folds(spark, d):
    return C.stratified_folds(read(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id")


STRATIFIED_FOLDS = "SELECT doc_id, lang, (CASE WHEN count(*) OVER (PARTITION BY lang) < 5 THEN -1 ELSE (row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) - 1) % 5 END)::INT AS fold FROM documents"


def three_way_split(spark, d):
    return C.three_way_split(read(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id")


THREE_WAY_SPLIT = """
WITH r AS (SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) - 1) / (count(*) OVER (PARTITION BY lang))::DOUBLE AS s FROM documents)
SELECT doc_id, lang, CASE WHEN s < 0.70::DOUBLE THEN 'train' WHEN s < 0.70::DOUBLE + 0.15::DOUBLE THEN 'valid' ELSE 'test' END AS split FROM r"""


def split_stats(spark, d):
    return C.split_stats(C.fold_roles(C.hash_group_folds(read(spark, d, "documents").select("doc_id", "lang"), "doc_id")), "lang")


SPLIT_STATS = """
WITH f AS (SELECT lang, ('0x' || substr(md5('42|' || doc_id), 1, 8))::BIGINT % 5 AS fold FROM documents), k AS (SELECT unnest(range(5)) AS fold)
SELECT k.fold::INT AS fold, CASE WHEN k.fold = f.fold THEN 'val' ELSE 'train' END AS role, lang, count(*) AS n FROM f CROSS JOIN k GROUP BY ALL"""


def fold_leaks(spark, d):
    x = C.hash_group_folds(read(spark, d, "conversations").select("conv_id", "turn"), "conv_id").withColumn("fold", F.when(F.col("conv_id") % 50 == 0, F.pmod("turn", F.lit(2))).otherwise(F.col("fold")))
    return C.leaking_groups(x, "conv_id")


FOLD_LEAKS = "SELECT conv_id, count(DISTINCT turn % 2) AS n_folds FROM conversations WHERE conv_id % 50 = 0 GROUP BY conv_id HAVING count(DISTINCT turn % 2) > 1"


def dedup_left_join(spark, d):
    right = read(spark, d, "events").select("user_id", F.col("event_type").alias("first_type"), "event_id")
    left = read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return C.left_join_first(left, right, ["user_id"], ["event_id"], {"first_type": "unknown", "event_id": -1})


DEDUP_LEFT_JOIN = """
WITH e AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events)
SELECT c_custkey AS user_id, c_name, coalesce(event_type, 'unknown') AS first_type, coalesce(event_id, -1) AS event_id FROM customer LEFT JOIN e ON user_id = c_custkey AND r = 1"""


def sequence_ids(spark, d):
    return C.with_sequence(read(spark, d, "customer").select("c_custkey", "c_name"), "sample_id", ["c_name"], "T1_%06d")


SEQUENCE_IDS = "SELECT c_custkey, c_name, 'T1_' || lpad((row_number() OVER (ORDER BY c_name) - 1)::VARCHAR, 6, '0') AS sample_id FROM customer"


def union_binary_dataset(spark, d):
    docs = read(spark, d, "documents")
    return C.binary_dataset(docs.where("lang = 'en'").select("doc_id", "lang"), docs.where("lang != 'en'").select("doc_id", "source")).select("doc_id", "lang", "source", "binary_label")


UNION_BINARY_DATASET = "SELECT doc_id, CASE WHEN lang = 'en' THEN lang END AS lang, CASE WHEN lang <> 'en' THEN source END AS source, CASE WHEN lang = 'en' THEN 'Error' ELSE 'No-Error' END AS binary_label FROM documents"


def no_error_pool(spark, d):
    docs = read(spark, d, "documents")
    s = F.when(F.col("doc_id") % 3 == 0, "OMISSION_CONTEXT_REF_HAS_KW_MT_HAS_KW").when(F.col("doc_id") % 3 == 1, "REF_HAS_KEYWORD_MT_MISSING_BESTMATCH").otherwise("REF_HAS_KEYWORD_AND_MT_HAS_BESTMATCH")
    return C.no_error_pool(docs.select("doc_id", s.alias("retrieval_signal"), F.col("text").alias("mt_output"), F.lit("and").alias("Keyword"))).select("doc_id", "retrieval_signal")


NO_ERROR_POOL = """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'OMISSION_CONTEXT_REF_HAS_KW_MT_HAS_KW' ELSE 'REF_HAS_KEYWORD_MT_MISSING_BESTMATCH' END AS retrieval_signal FROM documents WHERE doc_id % 3 = 0 OR (doc_id % 3 = 1 AND contains(text, 'and'))"""


def manifest_apply(spark, d):
    x = read(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    out = x.where("doc_id % 11 = 0").select("doc_id")
    new = x.where("doc_id % 7 = 0").select("doc_id", F.lit("new").alias("label_new"))
    return C.apply_manifests(x, "doc_id", "label", out, new)


MANIFEST_APPLY = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'new' ELSE quality::VARCHAR END AS label FROM labels WHERE doc_id % 11 <> 0"


def latest_metrics_merge(spark, d):
    e = read(spark, d, "events")
    old = e.where("event_id % 2 = 0").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    new = e.where("event_id % 3 = 0").groupBy("event_type", "user_id").agg((F.count("*") + 1000).alias("n"))
    return C.latest(old, new, ["event_type", "user_id"])


LATEST_METRICS_MERGE = """
WITH o AS (SELECT event_type, user_id, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY ALL), w AS (SELECT event_type, user_id, count(*) + 1000 AS n FROM events WHERE event_id % 3 = 0 GROUP BY ALL)
SELECT * FROM w UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.event_type = o.event_type AND w.user_id = o.user_id)"""


def label_ids(spark, d):
    ids = spark.createDataFrame([("en", 0), ("fr", 1), ("de", 2)], "label string, label_id int")
    return C.with_label_id(read(spark, d, "documents").select("doc_id", "lang"), "lang", ids)


LABEL_IDS = "SELECT doc_id, lang, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 END AS label_id FROM documents"


def pivot_class_domain_rate(spark, d):
    docs = read(spark, d, "documents")
    x = E.pivot_counts(docs, "source", "lang", ["en", "fr", "de", "zz"], docs.select("source"))
    return x.select("source", "en", "fr", "de", "zz", F.round(E.rates("en", "fr"), 6).alias("en_per_fr"))


PIVOT_CLASS_DOMAIN_RATE = """
SELECT source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'fr') AS fr, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'zz') AS zz,
  round(count(*) FILTER (WHERE lang = 'en') * 100.0::DOUBLE / nullif(count(*) FILTER (WHERE lang = 'fr'), 0), 6) AS en_per_fr FROM documents GROUP BY source"""


def value_counts_top(spark, d):
    return E.value_counts(read(spark, d, "events"), "user_id", 10)


VALUE_COUNTS_TOP = "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10"


def spearman_pearson_mae(spark, d):
    return E.correlations(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ("l_returnflag",)).select("l_returnflag", "n", *_r("pearson", "spearman"), F.round("mae", 3).alias("mae"))


SPEARMAN_PEARSON_MAE = """
WITH r AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS ry FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(avg(abs(x - y)), 3) AS mae FROM r GROUP BY l_returnflag"""


def score_quantiles(spark, d):
    return E.quantiles(read(spark, d, "events"), "value", by=("event_type",)).select("event_type", *_r("q25", "q50", "q75"))


SCORE_QUANTILES = "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75 FROM events GROUP BY event_type"


def score_density(spark, d):
    return E.density(read(spark, d, "events"), "value", 16, 5.0).select(F.round("at", 6).alias("point"), F.round("density", 6).alias("density"))


SCORE_DENSITY = """
WITH s AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM events), g AS (SELECT lo + (hi - lo) * i / 15 AS pt, n FROM s CROSS JOIN (SELECT unnest(range(16)) AS i)),
c AS (SELECT value AS v, count(*) AS k FROM events GROUP BY value)
SELECT round(pt, 6) AS point, round(sum(k * exp(-((pt - v) / 5.0) * ((pt - v) / 5.0) / 2)) / (n * 5.0 * sqrt(2 * pi())), 6) AS density FROM g CROSS JOIN c GROUP BY pt, n"""


def baselines(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang", "text")
    train, test = docs.where("doc_id % 5 != 0"), docs.where("doc_id % 5 = 0")
    both = [("majority", E.majority_baseline(train, test, "lang")), ("keyword", E.keyword_baseline(test, "text", {"en": ["the "], "fr": ["que"], "de": ["und"]}, "es"))]
    out = None
    for name, x in both:
        s = E.summary(x, "lang").select(F.lit(name).alias("baseline"), "n", *_r("accuracy", "macro_f1"))
        out = s if out is None else out.unionByName(s)
    return out


BASELINES = f"""
WITH m AS (SELECT lang FROM documents WHERE doc_id % 5 <> 0 GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1),
x AS (SELECT 'majority' AS baseline, documents.lang AS t, m.lang AS p FROM documents, m WHERE doc_id % 5 = 0
  UNION ALL SELECT 'keyword', lang, CASE WHEN contains(text, 'the ') THEN 'en' WHEN contains(text, 'que') THEN 'fr' WHEN contains(text, 'und') THEN 'de' ELSE 'es' END FROM documents WHERE doc_id % 5 = 0),
{_scores('baseline', 'x')} SELECT baseline, sum(support)::BIGINT AS n, round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM cls GROUP BY baseline"""


def stratified_random_baseline(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang")
    return E.stratified_random_baseline(docs.where("doc_id % 5 != 0"), docs.where("doc_id % 5 = 0"), "lang", "doc_id")


STRATIFIED_RANDOM_BASELINE = """
WITH c AS (SELECT lang, count(*) AS n FROM documents WHERE doc_id % 5 <> 0 GROUP BY lang), e AS (SELECT lang AS v, sum(n) OVER (ORDER BY lang)::DOUBLE / sum(n) OVER () AS e FROM c),
u AS (SELECT doc_id, lang, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM documents WHERE doc_id % 5 = 0)
SELECT doc_id, lang, (SELECT arg_min(v, e) FROM e WHERE e > u) AS pred_label FROM u"""


def windowed_event_counts(spark, d):
    """The batch form of the streaming counts."""
    from ..streaming.gate import windowed_counts

    return windowed_counts(read(spark, d, "events"), "ts", "event_type")


WINDOWED_EVENT_COUNTS = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"


def unpivoted_raters(spark, d):
    x = read(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("Q1_A"), F.concat(F.col("quality").cast("string"), F.lit(".0")).alias("Q1_B"), F.col("toxic").cast("string").alias("Q2_A"), F.lit("").alias("Q2_B"))
    return E.gwet_ac1(E.unpivot_raters(x, ["doc_id"], ["Q1", "Q2"])).select("criterion", "n", *_r("agreement", "ac1"))


UNPIVOTED_RATERS = "SELECT 'Q1' AS criterion, count(*) AS n, 1.0::DOUBLE AS agreement, 1.0::DOUBLE AS ac1 FROM labels"

QUERIES = {name: (f, globals()[name.upper()]) for name, f in list(globals().items()) if callable(f) and name.upper() in globals() and name != name.upper()}
