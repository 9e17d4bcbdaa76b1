"""Similarity of pose vectors (ARRAY<DOUBLE>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decay of a similarity with distance, and the template share.
DECAY = 3.5
TEMPLATE_SHARE = 0.35
EMPTY_DISTANCE = 1e9


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def cut(vec: Column, n: Column) -> Column:
    return F.slice(vec, 1, n)


def weighted_distance(vec: Column, centroid: Column, weights: Column) -> Column:
    """Square root of the weighted squared differences over the common length."""
    weights = F.coalesce(weights, F.transform(centroid, lambda _: F.lit(1.0)))
    n = F.least(F.size(vec), F.size(centroid), F.size(weights))
    squares = F.zip_with(
        F.zip_with(cut(vec, n), cut(centroid, n), lambda v, c: (v - c) * (v - c)),
        cut(weights, n),
        lambda s, w: s * w,
    )
    return F.sqrt(total(squares))


def prototype_similarity(vec: Column, centroid: Column, weights: Column) -> Column:
    """exp(-3.5 d), at most 1; 0 without a vector or a prototype."""
    score = F.least(F.lit(1.0), F.exp(-DECAY * weighted_distance(vec, centroid, weights)))
    return F.when((F.size(vec) > 0) & (F.size(centroid) > 0), score).otherwise(F.lit(0.0))


def phase_similarity(vec: Column, quality: Column, proto: Column, template: Column) -> Column:
    """Prototype score blended with the athlete's own template, times quality.

    ``proto`` and ``template`` are STRUCT<centroid, weights>; either may be null.
    """
    base = F.exp(-DECAY * weighted_distance(vec, proto.centroid, proto.weights))
    own = F.exp(
        -DECAY
        * weighted_distance(vec, template.centroid, F.coalesce(template.weights, proto.weights))
    )
    blended = F.when(
        F.coalesce(F.size(template.centroid), F.lit(0)) > 0,
        (1 - TEMPLATE_SHARE) * base + TEMPLATE_SHARE * own,
    ).otherwise(base)
    return F.when(
        (F.size(vec) > 0) & (F.size(proto.centroid) > 0),
        F.round(F.least(F.lit(1.0), blended * quality), 4),
    ).otherwise(F.lit(0.0))


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed a single time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Null on different lengths, empty vectors or a zero norm."""
    sizes = F.struct(norm(a).alias("a"), norm(b).alias("b"))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return _once(
        sizes,
        lambda n: F.when(usable & (n.a >= 1e-9) & (n.b >= 1e-9), dot(a, b) / (n.a * n.b)),
    )


def to_unit_range(cos: Column) -> Column:
    """A cosine as a 0-1 score: negatives are folded by (c + 1) / 2, the rest kept."""
    folded = F.when(cos < 0, (cos + 1.0) * 0.5).otherwise(cos)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), folded))


def similarity01(a: Column, b: Column) -> Column:
    return _once(cosine(a, b), lambda c: F.when(c.isNotNull(), to_unit_range(c)))


def vec_distance(a: Column, b: Column) -> Column:
    """Euclid over the common length; a huge value when there is none."""
    n = F.least(F.size(a), F.size(b))
    squares = F.zip_with(cut(a, n), cut(b, n), lambda x, y: (x - y) * (x - y))
    return F.when(n > 0, F.sqrt(total(squares))).otherwise(F.lit(EMPTY_DISTANCE))


def rounded(vec: Column, digits: int = 4) -> Column:
    return F.transform(vec, lambda v: F.round(v, digits))


def median(values: Column) -> Column:
    """Exact median of a short array, nulls ignored."""
    kept = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    n = F.size(kept)
    low = F.get(kept, F.floor((n - 1) / 2).cast("int"))
    high = F.get(kept, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def average(values: Column) -> Column:
    """Mean of the non-null entries of a short array; null when there is none."""
    kept = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(kept) > 0, total(kept) / F.size(kept))


def dot_fixed(a: Column, b: Column, n: int) -> Column:
    """Dot product of two vectors of known length as plain (generated) arithmetic."""
    terms = [F.get(a, F.lit(i)) * F.get(b, F.lit(i)) for i in range(n)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out
