"""Finding anchor patterns in sentence pairs."""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.affix import ARABIC, Affixes, keyword_keys, match_rule, token_keys
from ..functions.text import OMITTED, contains, normalize, words
from ..session import written
from .curation import with_sequence

#: Up to this many patterns ride along with the rows; more meet them by an index of their beginnings and keys.
INLINE = 1000


def affix_match_join(tokens: DataFrame, patterns: DataFrame, affixes: Affixes = ARABIC, unique: bool = False) -> DataFrame:
    """Tokens joined to the keywords they match, with the first rule by rank.

    With ``unique``, which says that no row of ``tokens`` repeats, the rows are read once and not joined back.

    ``tokens`` has a column token, ``patterns`` a column keyword.  The match is an
    equi-join on at most five keys of a token and three of a keyword, so it
    hashes (and broadcasts a small side by Spark's own size check) where the
    cascade of rules would compare every token with every keyword.
    """
    there = tokens.where("token is not null and token != ''")
    left = (there if unique else there.select("token").distinct()).select("*", F.explode(token_keys("token", affixes)).alias("t"))
    right = patterns.select("keyword").where("keyword is not null and keyword != ''").distinct().select("keyword", F.explode(keyword_keys("keyword", affixes)).alias("k"))
    met = left.join(right, F.col("t.key") == F.col("k.key")).where("k.rank = 0 or t.rank = 0")
    own = tokens.columns if unique else ["token"]
    met = met.select(*own, "keyword", F.when(F.col("k.rank") == 0, F.col("t.rank")).otherwise(F.col("k.rank")).alias("rank"), F.when(F.col("k.rank") == 0, F.col("t.rule")).otherwise(F.col("k.rule")).alias("rule"))
    best = met.groupBy(*own, "keyword").agg(F.min_by("rule", "rank").alias("rule"))
    return best if unique else tokens.join(best, "token")


def occurs(keyword: str | Column, target: str | Column, affixes: Affixes = ARABIC, compose: bool = True) -> Column:
    """Whether a keyword is in a text: literally, in normal form, or as a token by affixes; false if either is empty."""
    k = F.col(keyword) if isinstance(keyword, str) else keyword
    t = F.col(target) if isinstance(target, str) else target
    some = F.coalesce((k != "") & (t != ""), F.lit(False))
    by_token = F.exists(words(t), lambda x: match_rule(x, k, affixes) != "")
    return some & (contains(t, k) | contains(normalize(t, compose=compose), normalize(k, compose=compose)) | F.coalesce(by_token, F.lit(False)))


def _hits(found_in_ref: Column, found_in_mt: Column, omitted: Column, keyword_in_mt: Column) -> Column:
    return found_in_ref & F.when(omitted, ~keyword_in_mt).otherwise(found_in_mt)


def _prepared(rows: DataFrame, texts: dict[str, str], affixes: Affixes, compose: bool) -> DataFrame:
    """Adds each text's normal form, words and all keys of its words, worked out once for a row: ``__<name>_norm``, ``_words``, ``_keys``."""
    x = rows.withColumns({f"__{name}_norm": normalize(c, compose=compose) for name, c in texts.items()} | {f"__{name}_words": F.array_distinct(words(c)) for name, c in texts.items()})
    keys = lambda name: F.array_distinct(F.flatten(F.transform(f"__{name}_words", lambda t: F.transform(token_keys(t, affixes), lambda k: k["key"]))))
    return x.withColumns({f"__{name}_keys": keys(name) for name in texts})


def _with_forms(patterns: DataFrame, affixes: Affixes, compose: bool) -> DataFrame:
    """Adds the normal form and the stripped forms of both sides of a pattern: ``<side>_norm``, ``<side>_forms``."""
    stripped = lambda c: F.transform(F.filter(keyword_keys(c, affixes), lambda k: k["rank"] > 0), lambda k: k["key"])
    return patterns.withColumns({f"{c}_norm": normalize(c, compose=compose) for c in ("keyword", "best_match")} | {f"{c}_forms": stripped(c) for c in ("keyword", "best_match")})


def _found(p, side: str, text: Column, name: str) -> Column:
    """:func:`occurs` of a prepared pattern's side in a prepared text: comparisons only."""
    k = p(side)
    there = contains(text, k) | contains(F.col(f"__{name}_norm"), p(f"{side}_norm")) | F.array_contains(f"__{name}_keys", k) | F.arrays_overlap(f"__{name}_words", p(f"{side}_forms"))
    return F.coalesce((k != "") & (text != "") & there, F.lit(False))


def _grams(text: Column, letter: str) -> Column:
    """All runs of one, two and three characters, and the empty one, marked by a letter."""
    one = F.split(text, "")
    two = F.zip_with(one, F.slice(one, 2, F.greatest(F.size(one), F.lit(1))), lambda a, b: F.concat(a, b))
    three = F.zip_with(two, F.slice(one, 3, F.greatest(F.size(one), F.lit(1))), lambda a, b: F.concat(a, b))
    every = F.array_distinct(F.array_compact(F.concat(one, two, three, F.array(F.lit("")))))
    return F.transform(every, lambda x: F.concat(F.lit(letter), x))


def _marked(keys: Column, letter: str) -> Column:
    return F.transform(keys, lambda x: F.concat(F.lit(letter), x))


def _indexed(rows: DataFrame, patterns: DataFrame, literal: bool, hit, ref: str) -> DataFrame:
    """Rows with their hits, by an equi-join: a keyword that is in a text shares its first three characters with it, or a key of one of its words."""
    base = written(rows.withColumn("__id", F.monotonically_increasing_id()), "rows")
    known = written(with_sequence(patterns, "pattern_no", ["sub_subtype", "keyword", "best_match"]), "patterns")
    mine = _grams(F.coalesce(F.col(ref), F.lit("")), "a")
    theirs = F.array(F.concat(F.lit("a"), F.substring("keyword", 1, 3)))
    if not literal:
        mine = F.concat(mine, _grams(F.col("__ref_norm"), "b"), _marked(F.col("__ref_keys"), "c"), _marked(F.col("__ref_words"), "d"))
        theirs = F.concat(theirs, F.array(F.concat(F.lit("b"), F.substring("keyword_norm", 1, 3)), F.concat(F.lit("c"), F.col("keyword"))), _marked(F.col("keyword_forms"), "d"))
    met = base.select("__id", F.explode(mine).alias("key")).join(known.select("pattern_no", F.explode(theirs).alias("key")), "key").select("__id", "pattern_no").distinct()
    return met.join(base, "__id").join(known.select(F.struct("*").alias("hit")), F.col("pattern_no") == F.col("hit.pattern_no")).where(hit)


def find_candidates(rows: DataFrame, patterns: DataFrame, mode: str = "affix", affixes: Affixes = ARABIC, ref: str = "ar_ref", mt: str = "mt_output", compose: bool = True, inline: int = INLINE) -> DataFrame:
    """A row for each sentence pair and pattern that it shows.

    A pattern hits if its keyword is in the reference and its match in the
    translation, or, for a match of "[OMITTED]", if the keyword isn't in the
    translation.  Modes: "literal" (containment), "affix" (also in normal form and
    by affixes), and "as_shipped" (every pair with every pattern but the omitted
    ones, the behaviour of an early release).

    Up to ``inline`` patterns ride along as one array, so every row is filtered
    where it lies: no join and no shuffle, and affixes are taken off each word once.
    More patterns meet the rows by an equi-join on the keyword's beginning and keys, and what
    meets is checked in full; for "as_shipped" they ride along in turns.
    ``pattern_no`` counts patterns in their order, in the joined form by content.
    """
    flat = patterns.select("sub_subtype", "keyword", "best_match")
    literal = mode != "affix"
    if not literal:
        flat = _with_forms(flat, affixes, compose)
    listed = flat.limit(inline + 1).collect()
    if not listed:
        return rows.select("*", *(F.lit(None).cast("string").alias(c) for c in ("sub_subtype", "keyword", "best_match")), F.lit(None).cast("int").alias("pattern_no")).where("false")
    r, m = F.col(ref), F.col(mt)
    field = lambda name: F.col(f"hit.{name}")
    k, b = field("keyword"), field("best_match")
    if mode == "as_shipped":
        hit = b != OMITTED
    elif literal:
        hit = _hits(contains(r, k), contains(m, b), b == OMITTED, contains(m, k))
    else:
        hit = _hits(_found(field, "keyword", r, "ref"), _found(field, "best_match", m, "mt"), b == OMITTED, _found(field, "keyword", m, "mt"))
    x = rows if literal else _prepared(rows, {"ref": ref, "mt": mt}, affixes, compose)
    names = [*rows.columns, "hit.sub_subtype", "hit.keyword", "hit.best_match", F.col("hit.pattern_no").cast("int").alias("pattern_no")]

    def riding(some: list, first: int) -> DataFrame:
        said = json.dumps([p.asDict() | {"pattern_no": i} for i, p in enumerate(some, first)])  # one literal, read once
        schema = ArrayType(StructType([*flat.schema.fields, StructField("pattern_no", IntegerType())]))
        return x.withColumn("hit", F.explode(F.from_json(F.lit(said), schema))).where(hit).select(*names)

    if len(listed) <= inline:
        return riding(listed, 0)
    if mode != "as_shipped":
        return _indexed(x, flat, literal, hit, ref).select(*names)
    out, every = None, flat.toLocalIterator()
    for first in itertools.count(0, inline):
        some = list(itertools.islice(every, inline))
        if not some:
            return out
        out = riding(some, first) if out is None else out.union(riding(some, first))
