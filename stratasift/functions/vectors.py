"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def valid_vector(a: Column, dim: int | None = None) -> Column:
    ok = a.isNotNull() & (F.size(a) > 0) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok & (F.size(a) == dim if dim else F.lit(True)), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors of different lengths or without a direction."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (length > 0), dot(a, b) / length)


def cosine_damped(a: Column, b: Column, epsilon: float = 1e-8) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + epsilon)


def l2_normalize(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / norm(a))


def masked_mean(rows: Column, mask: Column, dim: int) -> Column:
    """Mean of those vectors of an array whose mask is true; null without any."""
    kept = F.filter(F.arrays_zip(rows.alias("v"), mask.alias("m")), lambda x: x["m"])
    zero = F.array_repeat(F.lit(0.0), dim)
    total = F.aggregate(kept, zero, lambda s, x: F.zip_with(s, x["v"], lambda a, b: a + b.cast("double")))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))


def hashed_bag(tokens: Column, dim: int = 32) -> Column:
    """Counts of tokens by MD5 bucket, scaled to length one: an embedder without a model."""
    buckets = F.transform(tokens, lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dim)
    counts = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"),
    )
    return F.transform(counts, lambda x: x / F.sqrt(dot(counts, counts)))


def centroid_status(a: Column, dim: int) -> Column:
    """Aggregate: why a group of vectors has no centroid, or that it has one."""
    wrong = F.count_if(a.isNotNull() & (F.size(a) != dim))
    return F.when(F.count(a) == 0, "empty").when(wrong > 0, "dimension_mismatch").otherwise("ok")
