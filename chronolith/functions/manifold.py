"""Distances and maps on a product of hyperbolic (ball), spherical and Euclidean spaces, as Columns over double arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = 1e-5
INF = float("inf")
WEIGHTS = (1.0, 1.0, 1.0)


def vec(xs) -> Column:
    return F.array(*(F.lit(float(x)) for x in xs)) if len(xs) else F.expr("cast(array() as array<double>)")


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f's lambdas use it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def square(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def euclid(a: Column, b: Column) -> Column:
    d = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return F.when(F.size(a) == 0, 0.0).when(F.size(a) != F.size(b), INF).otherwise(d)


def ball(a: Column, curvature: float = 1.0) -> Column:
    """Projected into the ball, EDGE inside its border."""
    most = (1 - EDGE) / curvature**0.5
    return let(F.sqrt(square(a)), lambda n: F.when(n > most, F.transform(a, lambda x: x * most / n)).otherwise(a))


def poincare(a: Column, b: Column, curvature: float = 1.0) -> Column:
    c = curvature

    def between(p: Column, q: Column) -> Column:
        gap = F.aggregate(F.zip_with(p, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
        return F.acosh(F.greatest(1 + 2 * c * gap / ((1 - c * square(p)) * (1 - c * square(q))), F.lit(1.0))) / c**0.5

    d = let(ball(a, c), lambda p: let(ball(b, c), lambda q: between(p, q)))
    return F.when(F.size(a) == 0, 0.0).when(F.size(a) != F.size(b), INF).otherwise(F.when(F.isnan(d), INF).otherwise(d))


def sphere(a: Column, b: Column) -> Column:
    n = F.sqrt(square(a)) * F.sqrt(square(b))
    cos = F.when(n > 0, dot(a, b) / F.when(n > 0, n)).otherwise(1.0)
    return F.when(F.size(a) == 0, 0.0).when(F.size(a) != F.size(b), INF).otherwise(F.acos(F.greatest(F.least(cos, F.lit(1.0)), F.lit(-1.0))))


def product(e: Column, flat: Column, weights=WEIGHTS) -> Column:
    """Of an embedding and a flat query, sliced by the row's own dimensions; null if they don't add up."""
    h, s, u = (F.coalesce(F.size(e[x]), F.lit(0)) for x in ("hyp", "sph", "euc"))
    q = (F.slice(flat, F.lit(1), h), F.slice(flat, h + 1, s), F.slice(flat, h + s + 1, u))
    d = (poincare(e["hyp"], q[0]), sphere(e["sph"], q[1]), euclid(e["euc"], q[2]))
    total = sum((w * x * x for w, x in zip(weights, d, strict=True)), F.lit(0.0))
    return F.when(h + s + u == F.size(flat), F.sqrt(total))


def mobius_add(a: Column, b: Column) -> Column:
    parts = F.struct(dot(a, b).alias("ab"), square(a).alias("aa"), square(b).alias("bb"))
    return let(parts, lambda k: F.zip_with(a, b, lambda x, y: ((1 + 2 * k["ab"] + k["bb"]) * x + (1 - k["aa"]) * y) / (1 + 2 * k["ab"] + k["aa"] * k["bb"])))


def exp0(v: Column) -> Column:
    return let(F.sqrt(square(v)), lambda n: F.when(n > 0, F.transform(v, lambda x: F.tanh(n) * x / n)).otherwise(v))


def log0(v: Column) -> Column:
    return let(ball(v), lambda p: let(F.sqrt(square(p)), lambda n: F.when(n > 0, F.transform(p, lambda x: F.atanh(n) * x / n)).otherwise(p)))


def _factor(x: Column) -> Column:
    return 2 / F.greatest(1 - square(x), F.lit(1e-12))


def exp_at(x: Column, v: Column) -> Column:
    """The point that a tangent vector at x leads to."""
    step = lambda f: let(F.sqrt(square(v)), lambda n: F.when(n > 0, F.transform(v, lambda c: F.tanh(f * n / 2) * c / n)).otherwise(v))
    return let(_factor(x), lambda f: let(step(f), lambda s: mobius_add(x, s)))


def log_at(x: Column, y: Column) -> Column:
    """The tangent vector at x that leads to y."""
    away = mobius_add(F.transform(x, lambda c: -c), y)
    return let(_factor(x), lambda f: let(away, lambda d: let(F.sqrt(square(d)), lambda n: F.when(n > 0, F.transform(d, lambda c: 2 / f * F.atanh(F.least(n, F.lit(1 - 1e-12))) * c / n)).otherwise(d))))


def slerp_mid(a: Column, b: Column) -> Column:
    return let(F.zip_with(a, b, lambda x, y: x + y), lambda m: let(F.sqrt(square(m)), lambda n: F.when(n > 0, F.transform(m, lambda x: x / n)).otherwise(a)))


def gamma(v: Column) -> Column:
    """Lorentz factor of a point in the Klein model, the weight in an Einstein centroid."""
    return 1 / F.sqrt(F.greatest(1 - square(v), F.lit(1e-12)))
