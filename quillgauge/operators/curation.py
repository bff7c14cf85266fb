"""Dataset curation: leakage removal, sampling, folds, manifests and merges.

Random choices are ordered by md5 of a key and a seed: the same on every run,
engine and partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

SEED = 42


def lot(*key: str | Column, seed: int = SEED) -> Column:
    """A reproducible random-looking order of the rows by their key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key)))


def remove_leakage(rows: DataFrame, held_out: DataFrame, key: str = "Sentence_ID") -> DataFrame:
    """Rows whose key isn't held out; null keys stay."""
    return rows.join(held_out.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def overlap(rows: DataFrame, held_out: DataFrame, key: str = "Sentence_ID") -> DataFrame:
    """The distinct keys that both have."""
    return rows.select(key).where(F.col(key).isNotNull()).distinct().join(held_out.select(key).distinct(), key, "left_semi")


def with_sequence(rows: DataFrame, name: str, order: list[str | Column], pattern: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds consecutive numbers from 0 by an order (within each ``by``, if given), or ids after a pattern such as 'T1_%04d'.

    The rows are sorted into ranges and written once with each row's range and
    place in it; counts and numbers are both read from that table, so they belong to the
    same ranges whatever a second sampling would choose.  A number is the rows in
    the ranges before plus the place.  No single task sees all rows of a table or group; rows
    that are equal in the order are numbered in any order.
    """
    cols = rows.columns
    keys = [*by, *order]
    spread = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    placed = written(spread, "numbered")
    # the id's upper bits are the partition, its lower bits count within it
    sizes = placed.groupBy(*by, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range (and group)
    start = F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")
    starts = sizes.select(*(F.col(c).alias(f"__by{i}") for i, c in enumerate(by)), F.col("__part").alias("__range"), start.alias("__start"))
    same = F.col("__part") == F.col("__range")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    number = F.col("__start") + F.col("__at")
    return placed.join(starts, same).select(*cols, (F.format_string(pattern, number) if pattern else number).alias(name))


def keep_first(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row for each key: the first by an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def left_join_first(left: DataFrame, right: DataFrame, keys: list[str], order: list[str | Column], fill: dict) -> DataFrame:
    """Left join with the first right row of each key, missing values filled."""
    return left.join(keep_first(right, keys, order), keys, "left").fillna(fill)


def _first_of_each(rows: DataFrame, group: str, n: int, key: str, seed: int) -> DataFrame:
    """The ``n`` first rows of each group by lot, with their rank in __r.

    Spark keeps the ``n`` first of each group in every task before the exchange
    (the rank's limit is pushed below it), so a hot group sends few rows.
    """
    w = Window.partitionBy(group).orderBy(lot(key, seed=seed), key)
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)


def stratified_quota(rows: DataFrame, label: str, labels: DataFrame, total: int, key: str, seed: int = SEED) -> DataFrame:
    """``total`` rows shared out evenly over the labels; the remainder goes one each to the first labels by name.

    A label with fewer rows gives all it has; its share isn't passed on.
    """
    kinds = labels.select(F.col(label)).distinct()
    ranked = kinds.withColumns({"__i": F.row_number().over(Window.orderBy(label)), "__n": F.count("*").over(Window.partitionBy())})  # a row for each label
    quota = ranked.select(label, (F.floor(F.lit(total) / F.col("__n")) + F.when(F.col("__i") <= F.lit(total) % F.col("__n"), 1).otherwise(0)).alias("__quota"))
    return _first_of_each(rows, label, total, key, seed).join(quota, label).where("__r <= __quota").drop("__r", "__quota").select(*rows.columns)


def sample_per_group(rows: DataFrame, group: str, n: int, key: str, seed: int = SEED) -> DataFrame:
    """At most ``n`` rows of each group."""
    return _first_of_each(rows, group, n, key, seed).drop("__r")


def spot_check(rows: DataFrame, key: str, least: int = 30, share: float = 0.05, seed: int = SEED) -> DataFrame:
    """A sample of max(least, share of the rows), all of them if there are fewer; empty input gives an empty sample."""
    n = rows.count()
    return rows.orderBy(lot(key, seed=seed), key).limit(max(least, int(n * share)))


def hash_group_folds(rows: DataFrame, group: str, folds: int = 5, seed: int = SEED) -> DataFrame:
    """Adds a fold by the group's lot: a group never spans two folds, at any scale and without a join."""
    return rows.withColumn("fold", F.pmod(F.conv(F.substring(lot(group, seed=seed), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int"))


def stratified_group_folds(rows: DataFrame, group: str, label: str, folds: int = 5, seed: int = SEED) -> DataFrame:
    """Adds a fold: groups are dealt in turn within each main label, largest first, so labels and sizes stay balanced.

    A group's main label is its most frequent one; no group spans two folds.
    """
    sizes = rows.groupBy(group, label).agg(F.count("*").alias("n"))
    main = sizes.groupBy(group).agg(F.max_by(label, F.struct("n", label)).alias("main"), F.sum("n").alias("size"))
    ranked = main.select(group, "main", (-F.col("size")).alias("least"), lot(group, seed=seed).alias("lot"))
    turn = with_sequence(ranked, "turn", ["least", "lot", group], by=("main",))
    dealt = turn.select(group, F.when(F.floor(F.col("turn") / folds) % 2 == 0, F.col("turn") % folds).otherwise(folds - 1 - F.col("turn") % folds).cast("int").alias("fold"))
    return rows.join(dealt, group)


def _numbered_by_lot(rows: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Adds __r, each row's number within its label by lot, and __n, the rows of the label; hot labels are spread over many ranges."""
    numbered = with_sequence(rows.withColumn("__lot", lot(key, seed=seed)), "__r", ["__lot", key], by=(label,)).drop("__lot")
    sizes = rows.groupBy(F.col(label).alias("__label")).agg(F.count("*").alias("__n"))
    return numbered.join(sizes, numbered[label].eqNullSafe(sizes["__label"])).drop("__label")


def stratified_folds(rows: DataFrame, label: str, key: str, folds: int = 5, seed: int = SEED) -> DataFrame:
    """Adds a fold by turns within each label; labels with fewer rows than folds get -1 (always trained on)."""
    fold = F.when(F.col("__n") < folds, -1).otherwise(F.pmod("__r", F.lit(folds))).cast("int")
    return _numbered_by_lot(rows, label, key, seed).select(*rows.columns, fold.alias("fold"))


def three_way_split(rows: DataFrame, label: str, key: str, train: float = 0.70, valid: float = 0.15, seed: int = SEED) -> DataFrame:
    """Adds split: train, valid or test, by shares within each label."""
    share = F.col("__r") / F.col("__n")
    return _numbered_by_lot(rows, label, key, seed).select(*rows.columns, F.when(share < train, "train").when(share < train + valid, "valid").otherwise("test").alias("split"))


def fold_roles(rows: DataFrame, folds: int = 5) -> DataFrame:
    """The long table of folds: every row once for each fold, as val in its own and as train in the others."""
    out = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return out.withColumn("role", F.when(F.col("k") == F.col("fold"), "val").otherwise("train")).drop("fold").withColumnRenamed("k", "fold")


def split_stats(roles: DataFrame, label: str) -> DataFrame:
    return roles.groupBy("fold", "role", label).agg(F.count("*").alias("n"))


def leaking_groups(rows: DataFrame, group: str) -> DataFrame:
    """Groups that lie in more than one fold; empty for a sound split."""
    return rows.groupBy(group).agg(F.countDistinct("fold").alias("n_folds")).where("n_folds > 1")


def no_error_pool(tiered: DataFrame) -> DataFrame:
    """Pairs without the error: omission contexts that kept the keyword, and substitutions whose keyword is literally there."""
    kept = F.col("retrieval_signal") == "OMISSION_CONTEXT_REF_HAS_KW_MT_HAS_KW"
    same = (F.col("retrieval_signal") == "REF_HAS_KEYWORD_MT_MISSING_BESTMATCH") & F.coalesce(F.contains("mt_output", "Keyword"), F.lit(False))
    return tiered.where(kept | same)


def binary_dataset(errors: DataFrame, clean: DataFrame) -> DataFrame:
    """Both sets by column name, with binary_label."""
    return errors.withColumn("binary_label", F.lit("Error")).unionByName(clean.withColumn("binary_label", F.lit("No-Error")), allowMissingColumns=True)


def apply_manifests(rows: DataFrame, key: str, label: str, excluded: DataFrame, relabelled: DataFrame, corrected: DataFrame | None = None, value: str = "Best_Match") -> DataFrame:
    """Excludes listed keys, then puts in new labels (key, label_new) and corrected values (key, <value>_corrected)."""
    cols = rows.columns
    out = rows.join(excluded.select(key).distinct(), key, "left_anti")
    out = out.join(relabelled.select(key, "label_new"), key, "left").withColumn(label, F.coalesce("label_new", label))
    if corrected is not None:
        out = out.join(corrected.select(key, f"{value}_corrected"), key, "left").withColumn(value, F.coalesce(f"{value}_corrected", value))
    return out.select(*cols)


def latest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows with the new ones put in their place or added."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def with_label_id(rows: DataFrame, label: str, ids: DataFrame) -> DataFrame:
    """Adds label_id from (label, label_id); null where the label is unknown."""
    return rows.join(ids.select(F.col(ids.columns[0]).alias(label), "label_id"), label, "left")
