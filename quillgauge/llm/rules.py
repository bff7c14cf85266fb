"""Quality rules: counts over the words and lines of a text, and a log-likelihood ratio of hashed n-grams.

Two multinomials over ``BUCKETS`` hash buckets (words in the lower half, pairs
of neighbouring words in the upper) are counted with add-one smoothing: one
over the trusted documents, those that the labels call good and not toxic, and
one over the whole corpus.  Texts with the same words count once in both, however
many copies the corpus holds, else a group of copies that is labelled less often
than the rest would push itself below the cut.  A document's score is the sum of the bucket's
log ratios over all its n-grams, divided by their number; a document that
passes the base counts stays if its score is at least ``LEAST``.  With ``shrunk``,
as the query and the pipeline use it, a bucket's trusted count is compared with
the count that its raw share lets expect, both raised by pseudo-counts, so that
buckets with little evidence go to ratio 0 and few labels reject nothing.  Both counts
and every score cover all documents and whole texts.  The ratios are a table of
``BUCKETS`` numbers at every scale, and the only thing that reaches the driver.

All work is in SQL functions.  Defined cases: a null text has no words; a text
without words has score 0 and fails the base; an empty corpus gives an empty
result; without trusted documents all ratios follow from the smoothing alone (shrunk: 0);
a document with several label rows is trusted if all of them agree, and so is a
text with several labelled copies; repeated rows are judged each by itself, a
null id matches no label; a very long text is one row of work; extra columns stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 8192
#: Nats for each n-gram.
LEAST = -0.04
#: Pseudo-counts of the shrunk ratios: n-grams in each bucket, and n-grams in all, dealt by raw shares.
EACH, SHARED = 8, 100_000
GAPS = "[\\x20\\x09-\\x0D]+"
HALF = BUCKETS // 2

#: Names of the columns that the rules add to the rows they judge.
OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def words_of(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAPS), "")


def _bucket_of_word(a: Column) -> Column:
    return F.pmod(F.xxhash64(a), F.lit(HALF))


def _bucket_of_pair(a: Column, b: Column) -> Column:
    return F.lit(HALF) + F.pmod(F.xxhash64(a, b), F.lit(HALF))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents whose labels all say quality 1 and toxic 0, each once."""
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(good).alias("good")).where("good").select("doc_id")


def _same_text(text: str) -> Column:
    """One key for all texts with the same words in the same order."""
    return F.sha2(F.array_join(words_of(text), " "), 256).alias("key")


def trusted_keys(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Key of the texts that have labelled rows, all of them trusted, each once."""
    good = trusted_ids(labels).withColumn("good", F.lit(True))
    marked = labels.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().join(good, "doc_id", "left")
    rows = docs.select("doc_id", _same_text("text")).join(marked.hint("shuffle_hash"), "doc_id")
    return rows.groupBy("key").agg(F.min(F.coalesce("good", F.lit(False))).alias("good")).where("good").select("key")


def bucket_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, raw, target): n-grams of the corpus and of its trusted documents, copies once; at most BUCKETS rows."""
    texts = docs.select(_same_text("text"), F.array_join(words_of("text"), " ").alias("text")).groupBy("key").agg(F.first("text").alias("text"))
    rows = texts.join(trusted_keys(docs, labels).withColumn("target", F.lit(1)).hint("shuffle_hash"), "key", "left")
    rows = rows.select(words_of("text").alias("w"), F.coalesce("target", F.lit(0)).alias("target"))
    pairs = rows.select("target", F.inline(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b")))).toDF("target", "a", "b")
    grams = pairs.select("target", F.explode(F.array(_bucket_of_word(F.col("a")), F.when(F.col("b").isNotNull(), _bucket_of_pair(F.col("a"), F.col("b"))))).alias("bucket"))
    return grams.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, shrunk: bool = False) -> list[float]:
    """The log ratio of every bucket, to six places."""
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for bucket, r, t in counts.collect():  # at most BUCKETS rows
        raw[bucket], target[bucket] = r, t
    out = []
    for lo in (0, HALF):
        hi = lo + HALF
        if shrunk:
            trusted, whole = sum(target[lo:hi]), max(1, sum(raw[lo:hi]))
            for i in range(lo, hi):
                prior = EACH + SHARED * raw[i] / whole
                out.append(round(math.log((target[i] + prior) / (trusted * raw[i] / whole + prior)), 6))
            continue
        a, b = sum(target[lo:hi]) + HALF, sum(raw[lo:hi]) + HALF
        out += [round(math.log((target[i] + 1) / a) - math.log((raw[i] + 1) / b), 6) for i in range(lo, hi)]
    return out


def judged(docs: DataFrame, ratios: list[float], least: float = LEAST) -> DataFrame:
    """All rows as (row: struct of the columns of ``docs``) and the columns in ``OUT``."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    n = F.size("w")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("t"), words_of(docs["text"]).alias("w"))

    def gram(a: Column, b: Column) -> Column:
        return F.get(table, _bucket_of_word(a).cast("int")) + F.when(b.isNull(), F.lit(0.0)).otherwise(F.get(table, _bucket_of_pair(a, b).cast("int")))

    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    # Lambdas refer to their arguments only.  The optimiser may put a column's expression in its place, and inside a
    # lambda that would be worked out again for each element.
    after = lambda k: F.slice("w", k + 1, F.greatest(n, F.lit(1)))
    triples = F.when(n >= 4, F.slice(F.zip_with(F.zip_with("w", after(1), lambda a, b: F.xxhash64(a, b)), after(2), lambda h, c: F.xxhash64(h, c)), 1, F.greatest(n - 2, F.lit(0))))
    total = F.aggregate(F.zip_with("w", after(1), gram), F.lit(0.0), lambda acc, x: acc + x)
    rows = rows.select(
        "row",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        triples.alias("h"),
        (total / F.greatest(2 * n - 1, F.lit(1))).alias("score"),
    )
    same = F.size(F.array_distinct("h")) < F.size("h")
    rows = rows.select(
        "row", "n_words", "word_chars", "n_symbols", "score",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(same, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("s"),
    )
    both = F.zip_with("s", F.slice("s", 2, F.greatest(F.size("s"), F.lit(1))), lambda e, f: F.when(e["h"] == f["h"], F.array(*(x["i"] + k for x in (e, f) for k in range(3)))))
    covered = F.size(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))
    rows = rows.withColumn("n_repeat_words", F.when(F.col("s").isNull(), F.lit(0)).otherwise(covered).cast("long"))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least)).select("row", *OUT)


def quality_rules(docs: DataFrame, labels: DataFrame, shrunk: bool = False) -> DataFrame:
    """doc_id and the columns in ``OUT`` of every row of ``docs``."""
    rows = judged(docs.select("doc_id", "text"), log_ratios(bucket_counts(docs, labels), shrunk))
    return rows.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 9).alias("score"))


def kept_by_rules(docs: DataFrame, labels: DataFrame, shrunk: bool = False, corpus: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep; both multinomials are counted over ``corpus``, if given."""
    rows = judged(docs, log_ratios(bucket_counts(docs if corpus is None else corpus, labels), shrunk))
    # a column that the optimiser can't move keeps the filter above the counts, else it would work them out again for each word
    return rows.select("row", "kept", F.monotonically_increasing_id().alias("fixed")).where("kept and fixed >= 0").select("row.*")
