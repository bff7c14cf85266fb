"""Similarity and quality metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import OMITTED, col, contains, remove_all, remove_first, strip, word_set


def clamp(c: Column) -> Column:
    """Within 0 and 1; null stays null, which ``greatest`` and ``least`` alone would skip."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def _empty(c: Column) -> Column:
    return c.isNull() | (c == "")


def char_similarity(a: str | Column, b: str | Column) -> Column:
    """1 minus the edit distance over the longer length; null if either is empty."""
    a, b = col(a), col(b)
    return F.when(~_empty(a) & ~_empty(b), clamp(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))))


def context_preservation(clean: str | Column, error: str | Column, keyword: str | Column, match: str | Column) -> Column:
    """Character similarity of what remains without the first keyword and the first match; 0.90 if nothing remains."""
    clean, error = col(clean), col(error)
    k, m = strip(F.coalesce(col(keyword), F.lit(""))), strip(F.coalesce(col(match), F.lit("")))
    a = remove_first(clean, k)
    b = F.when(m == OMITTED, error).otherwise(remove_first(error, m))
    rest = F.when((strip(a) == "") | (strip(b) == ""), F.lit(0.90)).otherwise(char_similarity(a, b))
    return F.when(~_empty(clean) & ~_empty(error), rest)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two arrays, clamped to [0, 1]; null for nulls and zero vectors."""
    a, b = col(a), col(b)

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return clamp(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def weighted_harmonic(csr: str | Column, ocs: str | Column, sfr: str | Column, weights: tuple) -> Column:
    """min(1, 3 / sum(weight / metric)); null if one is null, 0 if one isn't positive.

    The weights sum to 1, so the numerator saturates it; see :func:`normalized_harmonic`.
    """
    return _harmonic(csr, ocs, sfr, weights, F.lit(3.0))


def normalized_harmonic(csr: str | Column, ocs: str | Column, sfr: str | Column, weights: tuple) -> Column:
    """The weighted harmonic mean proper."""
    a, b, c = (w if isinstance(w, Column) else F.lit(w) for w in weights)
    return _harmonic(csr, ocs, sfr, weights, a + b + c)


def _harmonic(csr, ocs, sfr, weights, top: Column) -> Column:
    m = [col(csr), col(ocs), col(sfr)]
    w = [x if isinstance(x, Column) else F.lit(x) for x in weights]
    known = m[0].isNotNull() & m[1].isNotNull() & m[2].isNotNull()
    positive = (m[0] > 0) & (m[1] > 0) & (m[2] > 0)
    parts = F.try_divide(w[0], m[0]) + F.try_divide(w[1], m[1]) + F.try_divide(w[2], m[2])
    return F.when(known & ~positive, F.lit(0.0)).when(known, clamp(F.try_divide(top, parts)))


def anchor_present(ref: str | Column, keyword: str | Column) -> Column:
    """1 if the reference holds the keyword, as it is or stripped."""
    return F.when(contains(ref, keyword) | contains(ref, strip(keyword)), 1).otherwise(0)


def _share(n: Column, of: Column) -> Column:
    return n / F.greatest(of, F.lit(1))


def recall_of_sets(a: str | Column, b: str | Column) -> Column:
    """Share of a word set that another has; 0 if either is empty."""
    a, b = col(a), col(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(_share(F.size(F.array_intersect(a, b)), F.size(a)))


def jaccard_of_sets(a: str | Column, b: str | Column) -> Column:
    """Jaccard similarity of two word sets; 0 if either is empty."""
    a, b = col(a), col(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(_share(both, F.size(a) + F.size(b) - both))


def context_recall(ref: str | Column, mt: str | Column, keyword: str | Column, match: str | Column) -> Column:
    """Share of the reference's words, without the keyword, that the translation has, without the match."""
    return recall_of_sets(word_set(remove_all(ref, keyword)), word_set(remove_all(mt, match)))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Jaccard similarity of the word sets; 0 if either is empty."""
    return jaccard_of_sets(word_set(a), word_set(b))


#: Weights of context recall, anchor presence and word similarity.
LITE = (0.45, 0.30, 0.25)
LOOSE, STRICT = 0.55, 0.65


def dqi(*axes: str | Column) -> Column:
    """Mean of (v - 1) / 4 over the axes, to four places; 0 if one is 0 or missing."""
    v = [F.coalesce(col(a).cast("double"), F.lit(0.0)) for a in axes]
    bad = v[0] == 0
    for x in v[1:]:
        bad = bad | (x == 0)
    total = sum(((x - 1) / 4 for x in v[1:]), (v[0] - 1) / 4)
    return F.when(bad, F.lit(0.0)).otherwise(F.round(total / len(v), 4))


def token_f1(pred: str | Column, gold: str | Column) -> Column:
    """F1 of the word sets; 1 if both are empty, 0 without a common word."""
    p, g = word_set(pred), word_set(gold)
    both = F.size(F.array_intersect(p, g))
    return F.when((F.size(p) == 0) & (F.size(g) == 0), F.lit(1.0)).otherwise(F.coalesce(F.try_divide(2.0 * both, (F.size(p) + F.size(g)).cast("double")), F.lit(0.0)))


def exact_match(pred: str | Column, gold: str | Column) -> Column:
    return F.coalesce(col(pred) == col(gold), F.lit(False))


def data_efficiency(f1: str | Column, n_train: str | Column) -> Column:
    """F1 for each thousand training rows."""
    return F.try_divide(col(f1), col(n_train) / 1000)
