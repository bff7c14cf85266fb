"""The class taxonomy and the rubric as dimension tables, with their integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .gates import cps_floor, regime

# Class, label id, group, category, severity level, severity score, class weight, quality dimension.
CLASSES = (
    ("Meaning Shift", 0, "Semantic Divergence", "Accuracy", "Critical", 5, 0.12, "Accuracy"),
    ("Total Omission", 1, "Semantic Divergence", "Accuracy", "Critical", 5, 0.12, "Accuracy"),
    ("Partial Translation", 2, "Semantic Divergence", "Accuracy", "Severe", 4, 0.04, "Accuracy"),
    ("Name Entity Error", 3, "Semantic Divergence", "Accuracy", "Severe", 4, 0.04, "Accuracy"),
    ("Terminology Substitution", 4, "Pragmatic Divergence", "Terminology", "Severe", 4, 0.28, "Terminology"),
    ("Literal Translation", 5, "Semantic Divergence", "Accuracy", "Major", 3, 0.04, "Accuracy"),
    ("Hypernym for Hyponym", 6, "Semantic Divergence", "Accuracy", "Moderate", 2, 0.02, "Accuracy"),
    ("Hyponym for Hypernym", 7, "Semantic Divergence", "Accuracy", "Moderate", 2, 0.02, "Accuracy"),
    ("Tanween Omission", 8, "Morphosyntactic Shifts", "Fluency", "Moderate", 2, 0.02, "Fluency"),
    ("Gender Disagreement", 9, "Morphosyntactic Shifts", "Fluency", "Major", 3, 0.03, "Fluency"),
    ("Definiteness Shift", 10, "Morphosyntactic Shifts", "Fluency", "Moderate", 2, 0.02, "Fluency"),
    ("Perfective to Progressive", 11, "Syntactic Shifts", "Fluency", "Severe", 4, 0.015, "Fluency"),
    ("Progressive to Perfective", 12, "Syntactic Shifts", "Fluency", "Severe", 4, 0.015, "Fluency"),
    ("Tense Shift Under Negation", 13, "Syntactic Shifts", "Accuracy", "Major", 3, 0.02, "Accuracy"),
    ("Wrong Structure", 14, "Syntactic Shifts", "Fluency", "Major", 3, 0.02, "Fluency"),
    ("Wrong Word Order", 15, "Syntactic Shifts", "Fluency", "Major", 3, 0.02, "Fluency"),
    ("Active to Passive Voice", 16, "Syntactic Shifts", "Style & Register", "Moderate", 2, 0.0025, "Style & Register"),
    ("Passive to Active Voice", 17, "Syntactic Shifts", "Style & Register", "Moderate", 2, 0.0025, "Style & Register"),
    ("Noun to Adjective", 18, "Syntactic Shifts", "Fluency", "Moderate", 2, 0.0025, "Fluency"),
    ("Adjective to Noun", 19, "Syntactic Shifts", "Fluency", "Moderate", 2, 0.0025, "Fluency"),
    ("Register Mismatch", 20, "Pragmatic Divergence", "Style & Register", "Major", 3, 0.07, "Style & Register"),
    ("Spelling Error", 21, "Orthographic Shifts", "Fluency", "Minor", 1, 0.05, "Fluency"),
    ("Invalid Pattern", 22, "Morphosyntactic Shifts", "Fluency", "Major", 3, 0.03, "Fluency"),
)
GROUP_WEIGHTS = {"Semantic Divergence": 0.40, "Morphosyntactic Shifts": 0.10, "Syntactic Shifts": 0.10, "Pragmatic Divergence": 0.35, "Orthographic Shifts": 0.05}
CATEGORY_WEIGHTS = {"Accuracy": 0.42, "Fluency": 0.225, "Style & Register": 0.075, "Terminology": 0.28}
LABELS = tuple(c[0] for c in CLASSES)

# Class, rubric class, CSR, OCS and SFR minimum, SFR maximum, weights of CSR, OCS and SFR, inverted.
RUBRIC = (
    ("Gender Disagreement", "B", 0.87, 1.0, 0.82, 1.0, 0.45, 0.30, 0.25, False),
    ("Definiteness Shift", "B", 0.90, 1.0, 0.84, 1.0, 0.45, 0.30, 0.25, False),
    ("Tanween Omission", "B", 0.92, 1.0, 0.86, 1.0, 0.45, 0.30, 0.25, False),
    ("Active to Passive Voice", "B", 0.82, 1.0, 0.75, 1.0, 0.45, 0.30, 0.25, False),
    ("Passive to Active Voice", "B", 0.82, 1.0, 0.75, 1.0, 0.45, 0.30, 0.25, False),
    ("Perfective to Progressive", "B", 0.84, 1.0, 0.76, 1.0, 0.45, 0.30, 0.25, False),
    ("Progressive to Perfective", "B", 0.84, 1.0, 0.76, 1.0, 0.45, 0.30, 0.25, False),
    ("Tense Shift Under Negation", "B", 0.82, 1.0, 0.74, 1.0, 0.45, 0.30, 0.25, False),
    ("Adjective to Noun", "B", 0.85, 1.0, 0.78, 1.0, 0.45, 0.30, 0.25, False),
    ("Noun to Adjective", "B", 0.85, 1.0, 0.78, 1.0, 0.45, 0.30, 0.25, False),
    ("Wrong Word Order", "B", 0.78, 1.0, 0.65, 1.0, 0.45, 0.30, 0.25, False),
    ("Wrong Structure", "B", 0.75, 1.0, 0.62, 1.0, 0.45, 0.30, 0.25, False),
    ("Invalid Pattern", "B", 0.80, 1.0, 0.72, 1.0, 0.45, 0.30, 0.25, False),
    ("Register Mismatch", "B", 0.80, 1.0, 0.65, 1.0, 0.45, 0.30, 0.25, False),
    ("Spelling Error", "A", 0.88, 1.0, 0.78, 1.0, 0.35, 0.35, 0.30, False),
    ("Terminology Substitution", "A", 0.82, 1.0, 0.68, 1.0, 0.35, 0.35, 0.30, False),
    ("Literal Translation", "A", 0.80, 1.0, 0.65, 1.0, 0.35, 0.35, 0.30, False),
    ("Hypernym for Hyponym", "A", 0.82, 1.0, 0.68, 1.0, 0.35, 0.35, 0.30, False),
    ("Hyponym for Hypernym", "A", 0.82, 1.0, 0.68, 1.0, 0.35, 0.35, 0.30, False),
    ("Name Entity Error", "A", 0.85, 1.0, 0.72, 1.0, 0.35, 0.35, 0.30, False),
    ("Meaning Shift", "A", 0.88, 1.0, 0.45, 0.78, 0.35, 0.35, 0.30, True),
    ("Total Omission", "A", 0.85, 1.0, 0.50, 0.80, 0.35, 0.35, 0.30, True),
    ("Partial Translation", "A", 0.75, 1.0, 0.55, 1.0, 0.35, 0.35, 0.30, False),
)
RUBRIC_COLUMNS = ("Error_Type", "Class", "CSR_Min", "OCS_Min", "SFR_Min", "SFR_Max", "Weight_CSR", "Weight_OCS", "Weight_SFR", "Inverted")


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CLASSES), "class string, label_id int, `group` string, tqa_category string, severity_level string, severity_score int, class_weight double, mqm_dimension string")


def label_ids(spark: SparkSession) -> DataFrame:
    return taxonomy(spark).select(F.col("class").alias("label"), "label_id")


def rubric_table(raw: DataFrame, classes: int | None = 23) -> DataFrame:
    """A rubric sheet as a dimension: trimmed keys, blanks dropped, duplicates and missing columns refused, thresholds derived."""
    missing = sorted(set(RUBRIC_COLUMNS) - set(raw.columns))
    if missing:
        raise ValueError(f"rubric lacks columns: {missing}")
    r = raw.withColumn("Error_Type", F.trim("Error_Type")).where("Error_Type != ''")
    twice = [x[0] for x in r.groupBy("Error_Type").count().where("count > 1").select("Error_Type").collect()]  # a row for each class
    if twice:
        raise ValueError(f"rubric repeats classes: {sorted(twice)}")
    if classes is not None and (n := r.count()) != classes:
        raise ValueError(f"rubric has {n} classes, not {classes}")
    inverted = F.col("Inverted").cast("boolean")
    num = lambda c: F.col(c).cast("double")
    return r.select(
        F.col("Error_Type").alias("error_type"), F.trim("Class").alias("class"), num("CSR_Min").alias("min_csr"), num("OCS_Min").alias("min_ocs"), num("SFR_Min").alias("min_sfr"), num("SFR_Max").alias("max_sfr"),
        num("Weight_CSR").alias("weight_csr"), num("Weight_OCS").alias("weight_ocs"), num("Weight_SFR").alias("weight_sfr"), inverted.alias("inverted"),
        regime("Error_Type").alias("regime"), cps_floor("Error_Type").alias("cps_floor"), F.when(inverted, num("CSR_Min")).alias("max_csr"),
    )


def default_rubric(spark: SparkSession) -> DataFrame:
    kinds = "Error_Type string, Class string, CSR_Min double, OCS_Min double, SFR_Min double, SFR_Max double, Weight_CSR double, Weight_OCS double, Weight_SFR double, Inverted boolean"
    return rubric_table(spark.createDataFrame(list(RUBRIC), kinds))


def rubric_summary(rubric: DataFrame) -> DataFrame:
    """How many classes each regime and rubric class has, and the range of their floors."""
    return rubric.groupBy("regime", "class").agg(F.count("*").alias("n"), F.min("min_sfr").alias("least_sfr"), F.max("min_sfr").alias("most_sfr"), F.min("cps_floor").alias("least_cps"))


def weight_rollup(tax: DataFrame) -> DataFrame:
    """Class weights summed by group and by category in one pass: (level, name, weight, n)."""
    both = tax.select("class_weight", F.inline(F.array(F.struct(F.lit("group").alias("level"), F.col("group").alias("name")), F.struct(F.lit("category").alias("level"), F.col("tqa_category").alias("name")))))
    return both.groupBy("level", "name").agg(F.round(F.sum("class_weight"), 9).alias("weight"), F.count("*").alias("n"))


def _row(check: str, ok, message: str, n_bad=None):
    bad = F.lit(0).cast("long") if n_bad is None else n_bad.cast("long")
    return F.struct(F.lit(check).alias("check_id"), F.when(ok, "pass").otherwise("fail").alias("status"), F.lit(message).alias("message"), bad.alias("n_bad"))


def taxonomy_checks(tax: DataFrame, groups: dict[str, float] = GROUP_WEIGHTS, categories: dict[str, float] = CATEGORY_WEIGHTS, eps: float = 1e-9, classes: int = 23) -> DataFrame:
    """Counts, required fields, weight sums by group and category, totals and contiguous ids: (check_id, status, message, n_bad)."""
    spark = tax.sparkSession
    declared = spark.createDataFrame([("group", k, v) for k, v in groups.items()] + [("category", k, v) for k, v in categories.items()], "level string, name string, declared double")
    diff = weight_rollup(tax).select("level", "name", "weight").join(declared, ["level", "name"], "full_outer")
    off = diff.groupBy().agg(*(F.count_if((F.col("level") == level) & ~F.coalesce(F.abs(F.col("weight") - F.col("declared")) < eps, F.lit(False))).alias(level) for level in ("group", "category")))
    needed = F.lit(False)
    for c in ("group", "tqa_category", "severity_level", "severity_score", "class_weight", "mqm_dimension"):
        needed = needed | F.col(c).isNull()
    base = tax.agg(F.countDistinct("class").alias("n"), F.count_if(needed).alias("lack"), F.countDistinct("label_id").alias("ids"), F.min("label_id").alias("lo"), F.max("label_id").alias("hi"))
    totals = F.lit(abs(sum(groups.values()) - 1) < eps and abs(sum(categories.values()) - 1) < eps)
    return base.join(F.broadcast(off)).select(F.inline(F.array(
        _row("C01", F.col("n") == classes, "number of classes"),
        _row("C02", F.col("lack") == 0, "required fields", F.col("lack")),
        _row("C03", F.col("group") == 0, "group weights are the sums of class weights", F.col("group")),
        _row("C04", F.col("category") == 0, "category weights are the sums of class weights", F.col("category")),
        _row("C05", totals, "declared weights sum to one"),
        _row("C05b", (F.col("ids") == classes) & (F.col("lo") == 0) & (F.col("hi") == classes - 1), "label ids are contiguous from 0"),
    )))


def map_checks(tax: DataFrame, labels: DataFrame, parents: DataFrame, prefix: tuple[str, str] = ("L", "P")) -> DataFrame:
    """A label map (label, label_id) and a parent map (group, label) held against the taxonomy, by full outer joins."""
    canon = tax.select(F.col("class").alias("label"), F.col("label_id").alias("canon_id"), F.col("group").alias("canon_group"))
    l_, p_ = prefix
    d = labels.join(canon, "label", "full_outer").agg(
        F.count("label_id").alias("n"), F.count_if(F.col("label_id").isNull() | F.col("canon_id").isNull()).alias("keys"),
        F.count_if(F.col("label_id").isNotNull() & F.col("canon_id").isNotNull() & (F.col("label_id") != F.col("canon_id"))).alias("ids"), F.countDistinct("label_id").alias("distinct"), F.count("canon_id").alias("canon"), F.min("label_id").alias("lo"), F.max("label_id").alias("hi"),
    )
    one = d.select(F.inline(F.array(
        _row(f"{l_}01", F.col("n") == F.col("canon"), "number of labels"), _row(f"{l_}02", F.col("keys") == 0, "label set", F.col("keys")),
        _row(f"{l_}03", F.col("ids") == 0, "label ids", F.col("ids")), _row(f"{l_}04", (F.col("distinct") == F.col("n")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1), "ids are contiguous from 0"),
    )))
    per = parents.groupBy("label").agg(F.count("*").alias("times"), F.min("group").alias("group"))
    q = per.join(canon, "label", "full_outer").agg(F.count_if(~F.col("group").eqNullSafe(F.col("canon_group"))).alias("moved"), F.count_if(F.coalesce("times", F.lit(0)) != 1).alias("times"))
    names = parents.select("group").distinct().withColumn("a", F.lit(1)).join(tax.select("group").distinct().withColumn("b", F.lit(1)), "group", "full_outer").agg(F.count("a").alias("na"), F.count("b").alias("nb"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("odd"))
    two = q.join(F.broadcast(names)).select(F.inline(F.array(
        _row(f"{p_}01", F.col("na") == F.col("nb"), "number of groups"), _row(f"{p_}02", F.col("odd") == 0, "group names", F.col("odd")),
        _row(f"{p_}03", F.col("moved") == 0, "membership", F.col("moved")), _row(f"{p_}04", F.col("times") == 0, "every class occurs once", F.col("times")),
    )))
    return one.unionByName(two)


def meta_checks(tax: DataFrame, meta: DataFrame, eps: float = 1e-9) -> DataFrame:
    """A per-class sheet (class, severity_score, severity_level, tqa_category, group_weight, category_weight) against the taxonomy."""
    from ..functions.text import fold_category

    sums_g = F.sum("class_weight").over(Window.partitionBy("group"))
    sums_c = F.sum("class_weight").over(Window.partitionBy("tqa_category"))
    canon = tax.select("class", F.col("severity_score").alias("s"), F.col("severity_level").alias("l"), fold_category("tqa_category").alias("c"), sums_g.alias("gw"), sums_c.alias("cw"))
    d = meta.join(canon, "class", "full_outer")
    both = F.col("s").isNotNull() & F.col("severity_score").isNotNull()
    near = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) < eps, F.lit(False))
    x = d.agg(
        F.count("severity_score").alias("n"), F.count("s").alias("m"), F.count_if(~both).alias("keys"), F.count_if(both & (F.col("severity_score") != F.col("s"))).alias("score"), F.count_if(both & (F.col("severity_level") != F.col("l"))).alias("level"),
        F.count_if(both & (fold_category(d["tqa_category"]) != F.col("c"))).alias("cat"), F.count_if(both & ~(near("group_weight", "gw") & near("category_weight", "cw"))).alias("w"),
    )
    return x.select(F.inline(F.array(
        _row("M01", F.col("n") == F.col("m"), "number of classes"), _row("M02", F.col("keys") == 0, "class set", F.col("keys")), _row("M03", F.col("score") == 0, "severity score", F.col("score")),
        _row("M04", F.col("level") == 0, "severity level", F.col("level")), _row("M05", F.col("cat") == 0, "category", F.col("cat")), _row("M06", F.col("w") == 0, "derived weights", F.col("w")),
    )))
