"""Medians, quantiles, divergences and error rates as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The share of words of 1 to 12 characters (12 and over) in printed Arabic.
WORD_LENGTHS = {1: 0.020, 2: 0.130, 3: 0.205, 4: 0.205, 5: 0.165, 6: 0.110, 7: 0.075, 8: 0.045, 9: 0.025, 10: 0.012, 11: 0.005, 12: 0.003}
LONGEST, FEWEST_TOKENS, SMOOTHING = 12, 8, 1e-9


def median_of(values: Column) -> Column:
    """Of an array: the mean of the middle two if it is even, null if empty."""
    v, n = F.array_sort(values), F.size(values)
    at = lambda k: F.get(v, k.cast("int"))
    return F.when(n % 2 == 1, at((n - 1) / 2)).when(n > 0, (at(n / 2 - 1) + at(n / 2)) / 2)


def exclusive_tertile(values: Column, i: int) -> Column:
    """The i-th of the two cuts into thirds by the exclusive method; null under two values."""
    v, n = F.array_sort(values), F.size(values)
    whole = F.floor(F.lit(i) * (n + 1) / 3)
    j = F.greatest(F.lit(1), F.least(n - 1, whole)).cast("int")
    d = F.lit(i) * (n + 1) - 3 * j
    return F.when(n > 1, (F.get(v, j - 1) * (3 - d) + F.get(v, j) * d) / 3)


def bound(value: Column, use) -> Column:
    """use(value), with value worked out once however often use takes it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def length_shares(tokens: Column) -> Column:
    """For each length from 1 to LONGEST the share of tokens of it, the last one with all longer ones."""
    def shares(lengths: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(LONGEST)), lambda k: F.size(F.filter(lengths, lambda n: n == k)) / F.size(lengths))

    return bound(F.transform(tokens, lambda t: F.least(F.char_length(t), F.lit(LONGEST))), shares)


def divergence(p: Column, q: dict[int, float] | None = None) -> Column:
    """Kullback-Leibler divergence in nats of an array of shares from a reference, not below 0."""
    q = WORD_LENGTHS if q is None else q
    against = F.array(*(F.lit(float(q.get(k, 0.0))) for k in range(1, LONGEST + 1)))
    terms = F.zip_with(p, against, lambda x, y: F.when(x > 0, x * F.log((x + SMOOTHING) / (y + SMOOTHING))).otherwise(0.0))
    return F.greatest(F.aggregate(terms, F.lit(0.0), lambda total, t: total + t), F.lit(0.0))


def word_boundary_divergence(tokens: Column, q: dict[int, float] | None = None) -> Column:
    return bound(tokens, lambda t: F.when(F.size(t) < FEWEST_TOKENS, 0.0).otherwise(divergence(length_shares(t), q)))


def lengths_divergence(lengths: Column, q: dict[int, float] | None = None) -> Column:
    """The same from the numbers of tokens of each length, 1 to LONGEST."""
    total = F.aggregate(lengths, F.lit(0), lambda a, n: a + n)
    shares = lambda t: F.transform(lengths, lambda n: n / t)
    return bound(total, lambda t: F.when(F.coalesce(t, F.lit(0)) < FEWEST_TOKENS, 0.0).otherwise(divergence(shares(t), q)))


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    distance = F.levenshtein(reference, hypothesis)
    return distance / F.greatest(F.char_length(reference), F.lit(1))


def scale(dpi: int) -> float:
    """Pixels for a point."""
    if dpi <= 0:
        raise ValueError(f"dpi must be positive: {dpi}")
    return dpi / 72.0


def rounded(values: dict[int, float], digits: int = 4) -> dict[int, float]:
    total = math.fsum(values.values()) or 1.0
    return {k: round(values[k] / total, digits) for k in sorted(values)}
