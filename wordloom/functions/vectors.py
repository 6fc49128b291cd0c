"""Vector math over array<double> columns with higher-order functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F



def as_double(vec: Column) -> Column:
    return F.transform(vec, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Σ a_j b_j."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(a: Column) -> Column:
    """A / ‖a‖; NULL for a zero vector (the original yields NaN)."""
    # bound once by a one-element transform: inside the inner lambda the norm would be added up again for every component
    bound = F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)))
    return F.element_at(bound, 1)


def cosine(a: Column, b: Column) -> Column:
    """Q1: Σab / (‖a‖‖b‖); NULL when either norm is zero."""
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den)


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(−x))."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def log_sigmoid_neg(x: Column) -> Column:
    """−ln σ(x), stable: ln(1 + exp(−x))."""
    return F.when(x >= 0, F.log1p(F.exp(-x))).otherwise(-x + F.log1p(F.exp(x)))


def round_vec(a: Column, digits: int = 6) -> Column:
    return F.transform(a, lambda x: F.round(x, digits))


def xavier_vector(seed, stream: str, idx: Column, hidden: int, n: Column | int) -> Column:
    """U(−1,1)·sqrt(2/(n+n)) per component, hash-seeded by (stream, idx)."""
    from wordloom.functions.hashing import uniform_vector
    nn = F.lit(n) if not isinstance(n, Column) else n
    scale = F.sqrt(F.try_divide(F.lit(2.0), (nn + nn).cast("double")))
    return F.transform(uniform_vector(seed, stream, hidden, idx),
                       lambda u: (u * F.lit(2.0) - F.lit(1.0)) * scale)


def sum_vectors(vec: Column) -> Column:
    """Aggregate: component-wise sum of array<double> (Summarizer, JVM-side)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    return vector_to_array(Summarizer.sum(array_to_vector(vec)))


LN2 = math.log(2.0)
