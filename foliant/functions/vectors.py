"""Column functions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity [G21]; null where a side has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance [G22]."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, v: s + v))


def softmax(z: Column, temperature: float = 1.0) -> Column:
    """Stable softmax of logits over a temperature of 1e-3 or more [G19]."""
    t = max(1e-3, temperature)
    shifted = F.transform(z, lambda v: F.exp((v.cast("double") - F.array_max(z).cast("double")) / t))
    return F.transform(shifted, lambda v: v / F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x))


def margin_uncertainty(p: Column) -> Column:
    """One minus the largest probability [G18]."""
    return 1.0 - F.array_max(p)


def entropy_uncertainty(p: Column) -> Column:
    """Entropy over the logarithm of the number of classes, probabilities clipped to [1e-6, 1] [G18]."""
    clip = lambda v: F.least(F.greatest(v, F.lit(1e-6)), F.lit(1.0))
    return F.aggregate(p, F.lit(0.0), lambda s, v: s - clip(v) * F.ln(clip(v))) / F.ln(F.size(p).cast("double"))


def argmax(p: Column) -> Column:
    """Position of the first largest value, from 0 [C20]."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def logprob_confidence(p: Column, how: str = "mean") -> Column:
    """exp of the mean (or least) log-probability, without nulls and infinities; 0 if none is left [E25]."""
    kept = F.filter(p, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    value = F.array_min(kept) if how == "min" else F.aggregate(kept, F.lit(0.0), lambda s, v: s + v) / F.size(kept)
    return F.when(F.size(kept) > 0, F.exp(value)).otherwise(0.0)
