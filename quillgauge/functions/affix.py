"""Affix-aware token matching, parametrised by a language's affixes.

A token matches a keyword if they are equal, if the token without its first
prefix, its last suffix or both is the keyword, or if the keyword without its
prefix or suffix is the token.  The rule that comes first in that order names
the match.
"""

from __future__ import annotations

import dataclasses
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


@dataclasses.dataclass(frozen=True)
class Affixes:
    """Prefixes and suffixes, longer ones first: the first that fits is taken."""

    prefixes: tuple[str, ...]
    suffixes: tuple[str, ...]

    def prefix(self, token: str | Column) -> Column:
        """The prefix that is stripped, or an empty string."""
        return F.regexp_extract(col(token), f"(?s)^({'|'.join(map(re.escape, self.prefixes))})(?=.)", 1)

    def suffix(self, token: str | Column) -> Column:
        return F.regexp_extract(col(token), f"(?s)(?<=.)({'|'.join(map(re.escape, self.suffixes))})\\z", 1)

    def without_prefix(self, token: str | Column) -> Column:
        token = col(token)
        return F.substring(token, F.length(self.prefix(token)) + 1, F.length(token))

    def without_suffix(self, token: str | Column) -> Column:
        token = col(token)
        return F.substring(token, F.lit(1), F.length(token) - F.length(self.suffix(token)))


# Arabic proclitics and endings, longer ones first.
ARABIC = Affixes(
    prefixes=("وبال", "فبال", "كال", "وال", "فال", "بال", "لل", "ال", "و", "ف", "ب", "ك", "ل"),
    suffixes=("تين", "تان", "ين", "ون", "ان", "ات", "ية", "ة", "ه", "ي", "ا"),
)
ENGLISH = Affixes(prefixes=("un", "re", "th"), suffixes=("ing", "ed", "er", "s"))


def match_rule(token: str | Column, keyword: str | Column, affixes: Affixes = ARABIC) -> Column:
    """The name of the rule by which the token matches, or an empty string."""
    t, k = col(token), col(keyword)
    p, s = affixes.prefix(t), affixes.suffix(t)
    bare_p, bare_s = affixes.without_prefix(t), affixes.without_suffix(t)
    s_of_p, p_of_s = affixes.suffix(bare_p), affixes.prefix(bare_s)
    kp, ks = affixes.prefix(k), affixes.suffix(k)
    return (
        F.when(t == k, F.lit("exact"))
        .when((p != "") & (bare_p == k), F.concat(F.lit("prefix_"), p))
        .when((s != "") & (bare_s == k), F.concat(F.lit("suffix_"), s))
        .when((p != "") & (s_of_p != "") & (affixes.without_suffix(bare_p) == k), F.concat(F.lit("both_"), p, F.lit("_"), s_of_p))
        .when((s != "") & (p_of_s != "") & (affixes.without_prefix(bare_s) == k), F.concat(F.lit("both_"), p_of_s, F.lit("_"), s))
        .when((kp != "") & (affixes.without_prefix(k) == t), F.concat(F.lit("kw_prefix_"), kp))
        .when((ks != "") & (affixes.without_suffix(k) == t), F.concat(F.lit("kw_suffix_"), ks))
        .otherwise(F.lit(""))
    )


def token_keys(token: str | Column, affixes: Affixes = ARABIC) -> Column:
    """The keys under which a token meets a keyword, as structs (key, rank, rule): an equi-join instead of a cascade."""
    t = col(token)
    p, s = affixes.prefix(t), affixes.suffix(t)
    bare_p, bare_s = affixes.without_prefix(t), affixes.without_suffix(t)
    s_of_p, p_of_s = affixes.suffix(bare_p), affixes.prefix(bare_s)

    def key(ok: Column | None, value: Column, rank: int, rule: Column) -> Column:
        made = F.struct(value.alias("key"), F.lit(rank).alias("rank"), rule.alias("rule"))
        return made if ok is None else F.when(ok, made)

    return F.array_compact(
        F.array(
            key(None, t, 0, F.lit("exact")),
            key(p != "", bare_p, 1, F.concat(F.lit("prefix_"), p)),
            key(s != "", bare_s, 2, F.concat(F.lit("suffix_"), s)),
            key((p != "") & (s_of_p != ""), affixes.without_suffix(bare_p), 3, F.concat(F.lit("both_"), p, F.lit("_"), s_of_p)),
            key((s != "") & (p_of_s != ""), affixes.without_prefix(bare_s), 4, F.concat(F.lit("both_"), p_of_s, F.lit("_"), s)),
        )
    )


def keyword_keys(keyword: str | Column, affixes: Affixes = ARABIC) -> Column:
    """The keyword's own key (rank 0), and its stripped forms (ranks 5 and 6), which only whole tokens meet."""
    k = col(keyword)
    p, s = affixes.prefix(k), affixes.suffix(k)

    def key(ok: Column | None, value: Column, rank: int, rule: Column) -> Column:
        made = F.struct(value.alias("key"), F.lit(rank).alias("rank"), rule.alias("rule"))
        return made if ok is None else F.when(ok, made)

    return F.array_compact(
        F.array(
            key(None, k, 0, F.lit("")),
            key(p != "", affixes.without_prefix(k), 5, F.concat(F.lit("kw_prefix_"), p)),
            key(s != "", affixes.without_suffix(k), 6, F.concat(F.lit("kw_suffix_"), s)),
        )
    )


def count_matches(toks: str | Column, keyword_tokens: str | Column, affixes: Affixes = ARABIC) -> Column:
    """struct(n, rule): how often a keyword, given as its tokens, occurs among the tokens.

    Both should be columns of a table, not expressions: lambdas would work those out again for each token.

    One token: all matching tokens, and the rule of the first.  Several: 1 if the
    exact sequence occurs anywhere, else 1 for the first place where its first or
    last token matches by affixes and the rest is equal; never more.
    """
    toks, k = col(toks), col(keyword_tokens)
    m, n = F.size(k), F.size(toks)
    # whichever rule holds, one of the two is part of the other: few tokens are left for the regular expressions
    near_k = F.filter(toks, lambda t: t.contains(F.get(k, F.lit(0))) | F.get(k, F.lit(0)).contains(t))
    rules = F.filter(F.transform(near_k, lambda t: match_rule(t, F.get(k, F.lit(0)), affixes)), lambda r: r != "")
    starts = F.when(n >= m, F.sequence(F.lit(0), n - m)).otherwise(F.array().cast("array<int>"))
    exact = F.exists(starts, lambda i: F.slice(toks, i + 1, m) == k)

    def near(i: Column) -> Column:
        first = match_rule(F.get(toks, i), F.get(k, F.lit(0)), affixes)
        last = match_rule(F.get(toks, i + m - 1), F.get(k, m - 1), affixes)
        rest = m - 1
        tail, head = F.slice(toks, i + 2, rest) == F.slice(k, F.lit(2), rest), F.slice(toks, i + 1, rest) == F.slice(k, F.lit(1), rest)
        return F.when(tail & (first != ""), first).when(head & (last != ""), last).otherwise(F.lit(""))

    close = F.filter(F.transform(starts, near), lambda r: r != "")
    none = F.struct(F.lit(0).alias("n"), F.lit("").alias("rule"))
    single = F.struct(F.size(rules).alias("n"), F.coalesce(F.get(rules, F.lit(0)), F.lit("")).alias("rule"))
    several = F.when(exact, F.struct(F.lit(1).alias("n"), F.lit("exact_seq").alias("rule"))).when(F.size(close) > 0, F.struct(F.lit(1).alias("n"), F.concat(F.lit("seq_"), F.get(close, F.lit(0))).alias("rule"))).otherwise(none)
    return F.when(m == 0, none).when(m == 1, single).otherwise(several)
