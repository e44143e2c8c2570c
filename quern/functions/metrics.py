"""Scalar expressions over training metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Schedule:
    """Defaults of the learning-rate schedule and of the loss filter."""

    rate: float = 4e-4
    floor: float = 1e-5
    warmup: int = 3_000
    steps: int = 50_000
    low: float = 0.2
    high: float = 12.0
    curriculum: bool = True
    curriculum_warmup: int = 2_000
    curriculum_end: float = 0.15


def cosine_rate(step: Column, s: Schedule = Schedule()) -> Column:
    progress = (step - s.warmup) / F.lit(float(max(s.steps - s.warmup, 1)))
    decay = s.floor + (s.rate - s.floor) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * F.least(progress, F.lit(1.0))))
    return F.when(step < s.warmup, s.rate * step / float(max(s.warmup, 1))).otherwise(decay)


def picky_bounds(step: Column, s: Schedule = Schedule()) -> tuple[Column, Column]:
    """Least and largest loss that is learned from; they open up while warming up."""
    if not s.curriculum:
        return F.lit(s.low), F.lit(s.high)
    warm = max(s.curriculum_warmup, int(s.steps * s.curriculum_end), 1)
    t = F.least(F.lit(1.0), step / F.lit(float(warm)))
    return s.low * t, s.high + (20 - s.high) * (1 - t)


def perplexity(ce: Column) -> Column:
    return F.exp(F.least(ce, F.lit(20.0)))


def tokens_per_second(tokens: Column, ms: Column) -> Column:
    return F.when(ms > 0, tokens / (ms / 1000)).otherwise(0.0)


def delta_class(delta: Column) -> Column:
    """How a change reads; ``none`` for NaN and null."""
    return F.when(F.isnan(delta) | delta.isNull(), "none").when(delta > 0, "better").when(delta < -1, "worse").otherwise("parity")


def short_duration(seconds: Column) -> Column:
    """Seconds below a minute, minutes below an hour, else hours."""
    return (
        F.when(seconds < 60, F.format_string("%.0fs", seconds))
        .when(seconds < 3600, F.format_string("%.1fmin", seconds / 60))
        .otherwise(F.format_string("%.1fh", seconds / 3600))
    )


def clock_duration(seconds: Column) -> Column:
    whole = F.floor(seconds)
    part = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    hours = F.floor(whole / 3600).cast("string")
    return F.concat_ws(":", F.lpad(hours, F.greatest(F.length(hours), F.lit(2)), F.lit("0")), part(whole % 3600 / 60), part(whole % 60))


#: Parts of names of geometry-sensitive parameters.
GEO_NAMES = ("hyp_proj", "w_cssc", "curv_gate", "log_scale_weights", "curvature", "geom_gate", "grad_gate")


def parameter_class(name: Column, ndim: Column) -> Column:
    """Optimiser group of a parameter; the first that fits counts."""
    return (
        F.when(name.rlike("|".join(GEO_NAMES)), "geo")
        .when((ndim == 1) | name.rlike("norm|bias"), "no_decay")
        .otherwise("decay")
    )


def stability_class(gsi: Column) -> Column:
    return F.when(gsi >= 0.85, "good").when(gsi >= 0.6, "fair").otherwise("poor")


def share_class(share: Column) -> Column:
    clamped = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    return F.when(clamped < 0.7, "good").when(clamped < 0.9, "fair").otherwise("poor")
