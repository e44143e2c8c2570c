"""Vector expressions over array<double> columns: ball geometry, attention, gates, norms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Floors and margins that change results.
TINY, BALL_MARGIN, ATANH_MARGIN = 1e-10, 1e-2, 1e-5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, not once for each use or element."""
    return F.transform(F.array(value), body)[0]


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def scaled(v: Column, s: Column) -> Column:
    return let(s, lambda k: F.transform(v, lambda x: x * k))


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def root_curvature(c: Column) -> Column:
    return F.sqrt(F.greatest(c, F.lit(TINY)))


def project_to_ball(x: Column, c: Column) -> Column:
    def within(n: Column) -> Column:
        radius = 1 / root_curvature(c) - BALL_MARGIN
        return F.when(n > radius, scaled(x, radius / n)).otherwise(x)

    return let(F.greatest(norm(x), F.lit(TINY)), within)


def exp_map(v: Column, c: Column) -> Column:
    """From the tangent space at the origin into the ball."""

    def moved(n: Column) -> Column:
        s = root_curvature(c) * n
        return scaled(v, F.tanh(s / 2) / s)

    return let(let(F.greatest(norm(v), F.lit(TINY)), moved), lambda y: project_to_ball(y, c))


def log_map(x: Column, c: Column) -> Column:
    """From the ball into the tangent space at the origin."""

    def moved(y: Column) -> Column:
        def by(n: Column) -> Column:
            s = root_curvature(c)
            return scaled(y, 2 / s * F.atanh(F.least(s * n, F.lit(1 - ATANH_MARGIN))) / n)

        return let(F.greatest(norm(y), F.lit(TINY)), by)

    return let(project_to_ball(x, c), moved)


def mobius_add(x: Column, y: Column, c: Column) -> Column:
    parts = F.struct(dot(x, y).alias("xy"), dot(x, x).alias("xx"), dot(y, y).alias("yy"))

    def combined(p: Column) -> Column:
        den = F.greatest(1 + 2 * c * p["xy"] + c * c * p["xx"] * p["yy"], F.lit(TINY))
        a = (1 + 2 * c * p["xy"] + c * p["yy"]) / den
        b = (1 - c * p["xx"]) / den
        return let(F.struct(a.alias("a"), b.alias("b")), lambda k: F.zip_with(x, y, lambda u, v: u * k["a"] + v * k["b"]))

    return let(let(parts, combined), lambda z: project_to_ball(z, c))


def geodesic(x: Column, y: Column, c: Column) -> Column:
    minus = F.transform(x, lambda v: -v)
    apart = F.greatest(norm(mobius_add(minus, y, c)), F.lit(TINY))
    s = root_curvature(c)
    return 2 / s * F.atanh(F.least(s * apart, F.lit(1 - ATANH_MARGIN)))


def conformal_factor(x: Column, c: Column) -> Column:
    return F.pow(F.greatest(1 - c * dot(x, x), F.lit(1e-6)) / 2, F.lit(2.0))


def softmax(v: Column) -> Column:
    def shares(top: Column) -> Column:
        return let(F.transform(v, lambda x: F.exp(x - top)), lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))

    return let(F.array_max(v), shares)


def log_softmax(v: Column) -> Column:
    def logs(top: Column) -> Column:
        return let(F.log(total(F.transform(v, lambda x: F.exp(x - top)))), lambda z: F.transform(v, lambda x: x - top - z))

    return let(F.array_max(v), logs)


def distance_gates(distances: Column, log_temperature: Column) -> Column:
    """softmax(-d / temperature), the temperature being at least 0.1."""
    t = F.greatest(F.exp(log_temperature), F.lit(0.1))
    return softmax(F.transform(distances, lambda d: -d / t))


def entropy_share(p: Column) -> Column:
    """Entropy as a share of the most that so many classes can have."""
    return -total(F.transform(p, lambda x: x * F.log(x + 1e-8))) / F.log(F.size(p).cast("double"))


def entropy_nats(logits: Column) -> Column:
    return -total(F.transform(log_softmax(logits), lambda x: F.exp(x) * x))


def rms_norm(v: Column, eps: float = 1e-6) -> Column:
    return let(dot(v, v) / F.size(v), lambda m: F.transform(v, lambda x: x / F.sqrt(m + eps)))


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    def by(mean: Column) -> Column:
        var = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(v)
        return let(var, lambda s: F.transform(v, lambda x: (x - mean) / F.sqrt(s + eps)))

    return let(total(v) / F.size(v), by)


def weighted_sum(weights: Column, vectors: Column, dim: int) -> Column:
    zero = F.array_repeat(F.lit(0.0), dim)
    return F.aggregate(
        F.arrays_zip(weights.alias("w"), vectors.alias("v")),
        zero,
        lambda acc, p: F.zip_with(acc, p["v"], lambda a, x: a + p["w"] * x),
    )


def top_gates(gates: Column, k: int) -> Column:
    """The k largest gates (ties: lower index) renormalised, others 0; all of them if k is out of range."""
    ranked = F.transform(gates, lambda g, i: F.struct((-g).alias("neg"), i.alias("i")))

    def masked(best: Column) -> Column:
        kept = F.transform(gates, lambda g, i: F.when(F.array_contains(best, i), g).otherwise(0.0))
        return let(kept, lambda m: let(total(m), lambda s: F.transform(m, lambda g: g / (s + 1e-8))))

    best = F.transform(F.slice(F.array_sort(ranked), 1, max(k, 1)), lambda r: r["i"])
    return F.when((F.size(gates) <= k) | F.lit(k <= 0), gates).otherwise(let(best, masked))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def silu(x: Column) -> Column:
    return x * sigmoid(x)


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def merged(old: Column, new: Column, share: Column) -> Column:
    """share * old + (1 - share) * new."""
    return F.zip_with(old, new, lambda a, b: share * a + (1 - share) * b)


def prepend_rows(rows: Column, extra: Column) -> Column:
    return F.concat(extra, rows)


def strip_rows(rows: Column, count: int) -> Column:
    return F.slice(rows, count + 1, F.greatest(F.size(rows) - count, F.lit(0)))


def shadow(old: Column, new: Column, decay: float) -> Column:
    return F.zip_with(old, new, lambda s, m: decay * s + (1 - decay) * m)
