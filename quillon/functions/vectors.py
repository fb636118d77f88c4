"""Vectors and logits as array columns (X10-X15, X18, X20, X24, X25, X30-X33).  Arithmetic is in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12
#: Probabilities stay this far below one before they divide.
P_MAX = 1 - 1e-6


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def double(v: str | Column) -> Column:
    return col(v).cast("array<double>")


def fold(v: str | Column, step, start: float = 0.0) -> Column:
    return F.aggregate(col(v), F.lit(start), step)


def let(value: Column, body) -> Column:
    """*body* of *value*, which is found once a row, also where *body* goes through an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: str | Column, b: str | Column) -> Column:
    return fold(F.zip_with(col(a), col(b), lambda x, y: x * y), lambda s, x: s + x)


def norm(v: str | Column) -> Column:
    return F.sqrt(fold(v, lambda s, x: s + x * x))


def at_least(x: str | Column, low: float = EPS) -> Column:
    return F.greatest(col(x), F.lit(low))


def scale(v: str | Column, by: str | Column) -> Column:
    by = col(by)
    return F.transform(col(v), lambda x: x * by)


def unit(v: str | Column) -> Column:
    return let(at_least(norm(v)), lambda n: F.transform(col(v), lambda x: x / n))


def subtract(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x - y)


def larger(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: F.greatest(x, y))


def cosine(dots: str | Column, norm_a: str | Column, norm_b: str | Column) -> Column:
    return col(dots) / (at_least(norm_a) * at_least(norm_b))


def finite(x: Column) -> Column:
    """NaN and both infinities become 0; null stays."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def sanitize(v: str | Column) -> Column:
    return F.transform(double(v), finite)


def sigmoid(x: str | Column) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def log_sigmoid(x: str | Column) -> Column:
    x = col(x)
    return -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def lse(z: str | Column, times: float = 1.0) -> Column:
    """log sum exp of *times* z, shifted by the maximum."""
    z = col(z)
    return let(F.array_max(z), lambda top: times * top + F.log(fold(F.transform(z, lambda x: F.exp(times * (x - top))), lambda s, x: s + x)))


def nll(z: str | Column, target: str | Column) -> Column:
    return lse(z) - F.get(col(z), col(target))


def token_probability(loss: str | Column) -> Column:
    return F.least(F.exp(-col(loss)), F.lit(P_MAX))


def collision(z: str | Column) -> Column:
    """The sum of squared probabilities."""
    return F.exp(lse(z, 2.0) - 2 * lse(z))


def norm1_weight(p: str | Column) -> Column:
    return 1 / (2 * (1 - col(p)))


def norm2_weight(p: str | Column, squares: str | Column) -> Column:
    return 1 / F.sqrt(at_least(1 - 2 * col(p) + col(squares)))


def entropy(z: str | Column) -> Column:
    z = col(z)
    return let(lse(z), lambda whole: whole - fold(F.transform(z, lambda x: F.exp(x - whole) * x), lambda s, x: s + x))


def position_kl(ref: str | Column, policy: str | Column) -> Column:
    """KL(ref || policy) of the distributions that two logit arrays stand for."""
    ref, policy = col(ref), col(policy)
    both = lambda a, b: fold(F.zip_with(ref, policy, lambda x, y: F.exp(x - a) * ((x - a) - (y - b))), lambda s, x: s + x)
    return let(lse(ref), lambda a: let(lse(policy), lambda b: both(a, b)))


def logit_gradient(z: str | Column, target: str | Column) -> Column:
    """softmax(z) - onehot(target): the gradient of the token loss in its logits."""
    z, target = col(z), col(target)
    whole = lse(z)
    return F.transform(z, lambda x, i: F.exp(x - whole) - F.when(i == target, 1.0).otherwise(0.0))


def close(a: str | Column, b: str | Column, rtol: float = 1e-4, atol: float = 1e-3) -> Column:
    return F.abs(col(a) - col(b)) <= atol + rtol * F.abs(col(b))


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison, without negative zero."""
    return F.round(col(c), digits) + F.lit(0.0)
