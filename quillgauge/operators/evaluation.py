"""Evaluation of predictions: counts of cells first, statistics from the counts.

Every score depends on the rows only through how often each (true, predicted)
pair occurs, so one aggregation leaves at most classes x classes rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cells(preds: DataFrame, true: str = "true_label", pred: str = "pred_label", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., t, p, n): how often each pair of labels occurs."""
    return preds.groupBy(*by, F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))


def confusion(preds: DataFrame, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """The dense matrix in long form over the union of the labels, with each cell's share of its row (0 for empty rows)."""
    c = cells(preds, true, pred)
    labels = c.select(F.col("t").alias("l")).union(c.select("p")).where("l is not null").distinct()
    every = labels.agg(F.sort_array(F.collect_set("l")).alias("ls"))  # one row of class names
    grid = every.select(F.explode("ls").alias("t"), "ls").select("t", F.explode("ls").alias("p"))
    out = grid.join(c, ["t", "p"], "left").select("t", "p", F.coalesce("n", F.lit(0)).alias("n"))
    row = F.sum("n").over(Window.partitionBy("t"))
    return out.withColumn("share", F.when(row > 0, F.col("n") / row).otherwise(0.0))


def per_class(preds: DataFrame, true: str = "true_label", pred: str = "pred_label", by: tuple[str, ...] = (), labels: list[str] | None = None) -> DataFrame:
    """(by..., label, tp, fp, fn, support, precision, recall, f1); zero divisions give 0.

    Labels are the union of both sides, or those given.
    """
    return class_scores(cells(preds, true, pred, by), by, labels)


def class_scores(c: DataFrame, by: tuple[str, ...] = (), labels: list[str] | None = None, n: str = "n") -> DataFrame:
    hit = F.col("t") == F.col("p")
    rows = c.select(*by, F.inline(F.when(hit, F.array(F.struct(F.col("t").alias("label"), F.col(n).alias("tp"), F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn")))).otherwise(
        F.array(F.struct(F.col("t").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.col(n).alias("fn")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"), F.col(n).alias("fp"), F.lit(0).cast("long").alias("fn")))
    )))
    if labels is not None:
        rows = rows.where(F.col("label").isin(*labels))
    s = rows.where("label is not null").groupBy(*by, "label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select(*by, "label", "tp", "fp", "fn", (tp + fn).alias("support"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def summary(preds: DataFrame, true: str = "true_label", pred: str = "pred_label", by: tuple[str, ...] = (), labels: list[str] | None = None) -> DataFrame:
    """One row for each ``by``: n, accuracy, macro and weighted F1, and micro P/R/F1 (which differ from accuracy for a label subset)."""
    return summary_of(cells(preds, true, pred, by), by, labels)


def summary_of(c: DataFrame, by: tuple[str, ...] = (), labels: list[str] | None = None) -> DataFrame:
    s = class_scores(c, by, labels)
    weight = lambda m: F.coalesce(F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")), F.lit(0.0))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double")), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scores = s.groupBy(*by).agg(
        F.avg("f1").alias("macro_f1"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), weight("f1").alias("weighted_f1"),
        ratio(tp, tp + fp).alias("micro_precision"), ratio(tp, tp + fn).alias("micro_recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("micro_f1"),
    )
    total = c.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return total.join(scores, list(by)) if by else total.join(F.broadcast(scores))


def over_folds(folds: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """Mean, sample deviation and maximum of a metric over folds."""
    return folds.agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.max(metric).alias("best"))


def best_fold(folds: DataFrame, metric: str = "macro_f1", fold: str = "fold", last: bool = False) -> DataFrame:
    """The row with the largest metric; of equals the first fold, or the last."""
    return folds.orderBy(F.desc(metric), F.desc(fold) if last else F.asc(fold)).limit(1)


#: Resamples drawn together in a task.
STEP = 64


def draw_counts(counts: list[int], b: int, seed: int = 42):
    """How often resample ``b`` draws each cell: one multinomial of as many rows as there are, the same wherever it runs."""
    import numpy as np

    total = sum(counts)
    return np.random.Generator(np.random.Philox(key=[seed, b])).multinomial(total, np.asarray(counts, dtype="float64") / total)


def resampled_f1(preds: DataFrame, times: int, true: str = "true_label", preds_of: tuple[str, ...] = ("pred_label",), seed: int = 42) -> DataFrame:
    """(b, f1): macro-F1 of each model over ``times`` resamples of the rows, drawn with replacement.

    Rows of one cell (the true label and every model's prediction) are alike, so
    drawing rows is drawing cells from a multinomial by their counts: one
    aggregation of the rows, then cells x resamples numbers, however many rows
    there are.  All models share the draws.  Cells are at most classes to the
    power of models + 1.  Without rows there are no resamples.
    """
    names = ["t", *(f"p{i}" for i in range(len(preds_of)))]
    counts = preds.groupBy(F.col(true).alias("t"), *(F.col(p).alias(f"p{i}") for i, p in enumerate(preds_of))).agg(F.count("*").alias("size"))
    labels = F.array(*(F.col(c).cast("string") for c in names))
    one = counts.agg(F.sort_array(F.collect_list(F.struct(labels.alias("l"), "size"))).alias("cells")).where(F.size("cells") > 0)
    steps = preds.sparkSession.range(0, -(-times // STEP)).join(F.broadcast(one))  # one row of cells

    def run(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            for step, found in zip(frame["id"], frame["cells"], strict=True):
                sizes = [int(c["size"]) for c in found]
                bs = list(range(step * STEP, min(times, (step + 1) * STEP)))
                drawn = np.stack([draw_counts(sizes, b, seed) for b in bs]).astype("float64")
                scores = []
                for m in range(1, len(names)):
                    pairs = [(c["l"][0], c["l"][m]) for c in found]
                    kinds = sorted({x for pair in pairs for x in pair if x is not None})
                    is_t = np.array([[t == k for k in kinds] for t, _ in pairs], dtype="float64").reshape(len(pairs), len(kinds))
                    is_p = np.array([[p == k for k in kinds] for _, p in pairs], dtype="float64").reshape(len(pairs), len(kinds))
                    both = drawn @ is_t + drawn @ is_p
                    f1 = np.divide(2 * (drawn @ (is_t * is_p)), both, out=np.zeros_like(both), where=both > 0)
                    scores.append(f1.sum(axis=1) / np.maximum((both > 0).sum(axis=1), 1))
                yield pd.DataFrame({"b": bs, "f1": list(np.stack(scores, axis=1).tolist())})

    return steps.mapInPandas(run, "b long, f1 array<double>")


def bootstrap_ci(preds: DataFrame, times: int = 1000, true: str = "true_label", pred: str = "pred_label", seed: int = 42) -> DataFrame:
    """Mean and the 2.5 and 97.5 percentiles (linear interpolation) of macro-F1 over resamples."""
    f1 = resampled_f1(preds, times, true, (pred,), seed).select(F.col("f1")[0].alias("f1"))
    return f1.agg(F.count("*").alias("resamples"), F.avg("f1").alias("mean_f1"), F.percentile("f1", 0.025).alias("ci_lower"), F.percentile("f1", 0.975).alias("ci_upper"))


def paired_bootstrap(a: DataFrame, b: DataFrame, key: str = "sample_id", times: int = 10_000, true: str = "true_label", pred: str = "pred_label", seed: int = 42) -> DataFrame:
    """Difference of macro-F1 of two models on the rows both have: p is the share of resamples in which a isn't better."""
    both = a.select(key, true, F.col(pred).alias("pred_a")).join(b.select(key, F.col(pred).alias("pred_b")), key)
    # rounded, as the order of a sum must not decide which model is better
    delta = resampled_f1(both, times, true, ("pred_a", "pred_b"), seed).select(F.round(F.col("f1")[0] - F.col("f1")[1], 12).alias("d"))
    seen = summary(both.select(F.col(true).alias("t0"), "pred_a"), "t0", "pred_a").select(F.col("macro_f1").alias("macro_f1_a")).join(F.broadcast(summary(both.select(F.col(true).alias("t0"), "pred_b"), "t0", "pred_b").select(F.col("macro_f1").alias("macro_f1_b"))))
    p = 1 - F.count_if(F.col("d") > 0) / F.count("*")
    out = delta.agg(p.alias("p_value"), F.percentile("d", 0.025).alias("ci_lower"), F.percentile("d", 0.975).alias("ci_upper"), F.count("*").alias("resamples"))
    return seen.join(F.broadcast(out)).select("macro_f1_a", "macro_f1_b", (F.col("macro_f1_a") - F.col("macro_f1_b")).alias("delta_macro_f1"), "p_value", (F.col("p_value") < 0.05).alias("significant"), "ci_lower", "ci_upper", "resamples")


def bh_adjusted(tests: DataFrame, p: str = "p_value", key: str = "pair") -> DataFrame:
    """Adds p_adjusted after Benjamini and Hochberg: the least p * m / rank from each rank up, at most 1."""
    order = Window.orderBy(p, key)  # a row for each test
    ranked = tests.withColumns({"rank": F.row_number().over(order), "m": F.count("*").over(Window.partitionBy())})
    up = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return ranked.withColumn("p_adjusted", F.least(F.lit(1.0), F.min(F.col(p) * F.col("m") / F.col("rank")).over(up))).drop("m")


def gwet_ac1(pairs: DataFrame, criterion: str = "criterion", a: str = "a", b: str = "b") -> DataFrame:
    """Agreement of two raters for each criterion: (criterion, n, agreement, ac1).

    Pairs with a blank side are dropped; fewer than two categories give 1, no pairs no row.
    """
    given = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.trim(F.col(a).cast("string")) != "") & (F.trim(F.col(b).cast("string")) != ""))
    same = given.groupBy(criterion).agg(F.count("*").alias("n"), F.avg(F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)).alias("agreement"))
    votes = given.select(criterion, F.explode(F.array(F.col(a), F.col(b))).alias("v")).groupBy(criterion, "v").agg(F.count("*").alias("k"))
    share = votes.withColumn("pi", F.col("k") / F.sum("k").over(Window.partitionBy(criterion)))
    chance = share.groupBy(criterion).agg(F.sum(F.col("pi") * (1 - F.col("pi"))).alias("spread"), F.count("*").alias("q"))
    pe = F.try_divide(F.col("spread"), F.col("q") - 1)
    return same.join(chance, criterion).select(criterion, "n", "agreement", F.when(F.col("q") < 2, 1.0).otherwise(F.try_divide(F.col("agreement") - pe, 1 - pe)).alias("ac1"))


def unpivot_raters(wide: DataFrame, keys: list[str], criteria: list[str], left: str = "_A", right: str = "_B") -> DataFrame:
    """Wide rating sheets (Q1_A, Q1_B, ...) as rows of (keys..., criterion, a, b); '1' and '1.0' count as equal."""
    number = lambda c: F.col(c).try_cast("double")
    value = lambda c: F.coalesce(number(c).cast("string"), F.col(c).cast("string"))
    return wide.select(*keys, F.inline(F.array(*(F.struct(F.lit(q).alias("criterion"), value(q + left).alias("a"), value(q + right).alias("b")) for q in criteria))))


def class_weights(rows: DataFrame, label: str, labels: DataFrame, absent: float = 0.0) -> DataFrame:
    """n / (k * n_label) for each label that occurs, k being how many do; ``absent`` for the others."""
    n = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    every = labels.select(label).distinct().join(n, label, "left")
    total, kinds = F.sum("n").over(Window.partitionBy()), F.count("n").over(Window.partitionBy())  # a row for each label
    return every.withColumn("weight", F.coalesce(total / (kinds * F.col("n")), F.lit(absent))).select(label, F.coalesce("n", F.lit(0)).alias("n"), "weight")


def value_counts(rows: DataFrame, c: str, k: int | None = None) -> DataFrame:
    """Counts, most frequent first, ties by value; the first ``k`` if given."""
    out = rows.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(c))
    return out.limit(k) if k else out


def pivot_counts(rows: DataFrame, row: str, column: str, values: list[str], domain: DataFrame) -> DataFrame:
    """Counts with fixed rows and columns: combinations that don't occur are 0."""
    counts = rows.groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(v) for v in values))
    return domain.select(row).distinct().join(counts, row, "left").fillna(0, values)


def rates(part: str, whole: str) -> Column:
    return F.try_divide(F.col(part) * 100.0, F.col(whole))


def correlations(rows: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n, Pearson and Spearman correlation and mean absolute error; null correlations without variance.

    Spearman is Pearson over average ranks of ties.  Ranks come from counts of
    equal values, so a value's rows needn't meet in one task.
    """
    def ranked(c: str) -> DataFrame:
        counts = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, c).agg(F.count("*").alias("k"))
        upto = F.sum("k").over(Window.partitionBy(*by).orderBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return counts.select(*by, c, (upto - (F.col("k") - 1) / 2).alias(f"__r_{c}"))

    keys = list(by)
    full = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y).join(ranked(x), [*keys, x]).join(ranked(y), [*keys, y])
    safe = lambda a, b: F.when((F.var_pop(a) > 0) & (F.var_pop(b) > 0), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))
    return full.groupBy(*by).agg(F.count("*").alias("n"), safe(x, y).alias("pearson"), safe(f"__r_{x}", f"__r_{y}").alias("spearman"), F.avg(F.abs(F.col(x) - F.col(y))).alias("mae"))


def quantiles(rows: DataFrame, c: str, at: tuple[float, ...] = (0.25, 0.5, 0.75), by: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(*(F.percentile(c, q).alias(f"q{round(q * 100)}") for q in at))


def density(rows: DataFrame, c: str, points: int = 64, bandwidth: float | None = None) -> DataFrame:
    """A Gaussian kernel density on an even grid, by the rule of Silverman unless a bandwidth is given."""
    s = rows.where(F.col(c).isNotNull()).agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count("*").alias("n"), F.stddev_samp(c).alias("sd"))
    width = F.lit(bandwidth) if bandwidth else F.greatest(1.06 * F.coalesce("sd", F.lit(0.0)) * F.pow("n", F.lit(-0.2)), F.lit(1e-9))
    grid = s.select("n", width.alias("w"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / (points - 1))).alias("at"))
    counts = rows.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("double").alias("v")).agg(F.count("*").alias("k"))
    z = (F.col("at") - F.col("v")) / F.col("w")
    listed = grid.agg(F.collect_list(F.struct("at", "w", "n")).alias("g"))  # as many entries as points
    pairs = counts.join(F.broadcast(listed)).select("v", "k", F.inline("g"))
    return pairs.groupBy("at").agg((F.sum(F.col("k") * F.exp(-z * z / 2)) / F.first(F.col("n") * F.col("w") * (2 * 3.141592653589793) ** 0.5)).alias("density"))


def majority_baseline(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Test rows with the training set's most frequent label as prediction."""
    top = value_counts(train, label, 1).select(F.col(label).alias("pred_label"))
    return test.join(F.broadcast(top))


def stratified_random_baseline(train: DataFrame, test: DataFrame, label: str, key: str) -> DataFrame:
    """Test rows with labels drawn by the training shares, by md5 of the key."""
    n = train.groupBy(label).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(label).rowsBetween(Window.unboundedPreceding, Window.currentRow))  # a row for each label
    ends = n.select(F.col(label).alias("v"), (upto / F.sum("n").over(Window.partitionBy())).alias("end"))
    table = ends.agg(F.sort_array(F.collect_list(F.struct("end", "v"))).alias("ends"))
    u = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return test.join(F.broadcast(table)).withColumn("pred_label", F.get(F.filter("ends", lambda e: e["end"] > u), F.lit(0))["v"]).drop("ends")


def keyword_baseline(test: DataFrame, text: str, rules: dict[str, list[str]], default: str) -> DataFrame:
    """The first label with a keyword in the text, else the default."""
    out = F.lit(default)
    for name, keys in reversed(list(rules.items())):
        hit = F.lit(False)
        for k in keys:
            hit = hit | F.coalesce(F.contains(F.col(text), F.lit(k)), F.lit(False))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return test.withColumn("pred_label", out)


def tfidf_pipeline(text: str, label: str, kind: str = "logistic", size: int = 50_000, min_df: int = 2):
    """Words and pairs of words, plain counts by inverse frequency, and a linear classifier: an unfitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, SQLTransformer, StringIndexer

    model = LogisticRegression(labelCol="y", featuresCol="x") if kind == "logistic" else OneVsRest(classifier=LinearSVC(), labelCol="y", featuresCol="x")
    return Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="y", handleInvalid="keep"),
        RegexTokenizer(inputCol=text, outputCol="w1", pattern="\\s+"),
        NGram(n=2, inputCol="w1", outputCol="w2"),
        SQLTransformer(statement="SELECT *, concat(w1, w2) AS w12 FROM __THIS__"),
        CountVectorizer(inputCol="w12", outputCol="tf", vocabSize=size, minDF=min_df),
        IDF(inputCol="tf", outputCol="x"),
        model,
    ])
