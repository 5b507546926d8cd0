"""Vector measures on arrays, in double precision and inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products in order; a longer array's tail is ignored."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(doubles(a), 1, n), F.slice(doubles(b), 1, n), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of vectors that are already of unit length (or zero)."""
    return dot(a, b)


def unit(v: Column) -> Column:
    """``v`` over its Euclidean norm; a zero vector stays zero."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, doubles(v)).otherwise(F.transform(F.arrays_zip(doubles(v).alias("x"), F.array_repeat(norm, F.size(v)).alias("n")), lambda p: p["x"] / p["n"]))


def mean_abs_distance(a: Column, b: Column) -> Column:
    """Mean absolute difference over the length of ``a``; 0 if it is empty."""
    n = F.least(F.size(a), F.size(b))
    gaps = F.zip_with(F.slice(doubles(a), 1, n), F.slice(doubles(b), 1, n), lambda x, y: F.abs(x - y))
    return F.when(F.size(a) == 0, 0.0).otherwise(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.lit(1), F.size(a)))


def hamming(a: Column, b: Column) -> Column:
    """Places in which two bit arrays differ."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def packed_hamming(a: Column, b: Column) -> Column:
    """Differing bits of two packed 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def pack_bits(bits: Column) -> Column:
    """64 bits, the first lowest, in one long."""
    return F.aggregate(
        F.transform(bits, lambda b, i: F.when(b != 0, F.expr("1L")).otherwise(F.expr("0L"))), F.struct(F.expr("0L").alias("v"), F.expr("1L").alias("m")),
        lambda s, b: F.struct((s["v"].bitwiseOR(F.when(b != 0, s["m"]).otherwise(F.expr("0L")))).alias("v"), F.shiftleft(s["m"], 1).alias("m")), lambda s: s["v"],
    )


def preference(image: Column, positive: Column, negative: Column) -> Column:
    """Probability that an image is closer to the positive of two prompts."""
    p, n = F.exp(dot(image, positive)), F.exp(dot(image, negative))
    return p / (p + n)
