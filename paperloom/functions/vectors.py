"""Vector arithmetic as column expressions, for vectors that live in array columns.

Search over whole tables runs in ``operators.search`` on Arrow batches; these
expressions serve single pairs per row (triplets, questions, losses).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _with_scalar(a: Column, scalar: Column, combine) -> Column:
    # Zipping with a repeated scalar evaluates the scalar once; inside a lambda it would run per element.
    d = as_doubles(a)
    return F.zip_with(d, F.array_repeat(scalar, F.size(d)), combine)


def unit(a: Column) -> Column:
    """L2-normalised vector; a zero vector stays zero."""
    return _with_scalar(a, norm(a), lambda x, n: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def centred(a: Column) -> Column:
    """The vector minus its own mean: the direction that layer norm keeps."""
    mean = F.aggregate(as_doubles(a), F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return _with_scalar(a, mean, lambda x, m: x - m)


def units(vectors: Column) -> Column:
    return F.transform(vectors, unit)


def max_sim(query_units: Column, doc_units: Column) -> Column:
    """Sum over query vectors of the best cosine over the paper's vectors; 0 for a paper with none. Takes unit vectors."""
    best = F.transform(query_units, lambda q: F.array_max(F.transform(doc_units, lambda d: dot(q, d))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def soft_max_sim(query_units: Column, doc_units: Column, temperature: float) -> Column:
    """Mean over query vectors of logsumexp(cosine / temperature), shifted by the maximum to stay finite. Takes unit vectors."""

    def log_sum_exp(scaled: Column) -> Column:
        top = F.array_max(scaled)
        shifted = F.zip_with(scaled, F.array_repeat(top, F.size(scaled)), lambda x, t: F.exp(x - t))
        return top + F.log(F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x))

    sims = F.transform(query_units, lambda q: F.transform(doc_units, lambda d: dot(q, d) / F.lit(temperature)))
    total = F.aggregate(F.transform(sims, log_sum_exp), F.lit(0.0), lambda s, x: s + x)
    return total / F.size(query_units)
