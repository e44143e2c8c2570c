"""Operators over ordered metric rows: gated averages, intervals, log lines, recurrences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import scans

#: Fixed value: a metrics line of the training log.
LOG_LINE = (
    r"Step\s+(\d+)\s+\|\s+LR=([0-9.eE+-]+)\s+\|\s+CE=([0-9.eE+-]+)\s+\|\s+PPL=([0-9.eE+-]+)"
    r"\s+\|\s+GGR-aux=([0-9.eE+-]+)\s+\|\s+VRAM=([0-9.eE+-]+)/([0-9.eE+-]+)GiB\s+\|\s+([0-9.eE+-]+)tok/s"
    r"\s+\|\s+Baseline Δ=([+\-0-9.eE]+)%"
)
LOG_FORMAT = "Step %6d | LR=%.2e | CE=%.4f | PPL=%.2f | GGR-aux=%.4f | VRAM=%.2f/%.1fGiB | %.0ftok/s | Baseline Δ=%+.1f%%"
LOG_FIELDS = ("step", "lr", "ce", "ppl", "aux", "vram", "vram_total", "tok_s", "delta")


def gated_ema(df: DataFrame, key: str, order: str, value: str, alpha: float = 0.02, factor: float | None = 3.0, splits: int | None = None) -> DataFrame:
    """key, order, value, ema, rejected: the first value seeds; spikes over ``factor`` times the average leave it.

    Null and NaN values are left out; null orders come first, equal ones go by value;
    null keys are a series; repeated rows count again. Without ``factor`` nothing is
    rejected. A key is cut over tasks and equals the step-by-step average to the last
    bit: see ``scans.gated_states``.
    """
    return scans.gated_ema(_sound(df, value), key, order, value, alpha, factor, splits)


def _sound(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull() & ~F.isnan(value))


def linear_scan(df: DataFrame, key: str, order: str, value: str, decay: float, splits: int | None = None) -> DataFrame:
    """key, order, value, h: h = exp(decay) * h + value by key, from 0. Null values are left out; see ``scans.affine_scan``."""
    rows = df.where(F.col(value).isNotNull()).select(key, order, F.col(value).cast("double").alias(value))
    return scans.affine_scan(rows, key, [order, value], F.lit(math.exp(decay)), F.col(value), splits=splits)


def with_interval(df: DataFrame, step: str, every: int) -> DataFrame:
    """interval: the logged step that a row's metrics are averaged into."""
    return df.withColumn("interval", (F.ceil(F.col(step) / every) * every).cast("long"))


def accumulated(rows: DataFrame, step: str, value: str, low: Column, high: Column, most: float = 1.0) -> DataFrame:
    """step, n, skipped, mean, scale: the mean of a step's values within bounds, and what its norm is clipped by.

    Values outside the bounds, null or NaN are skipped; a step of which all are makes no
    update and gives no row. ``scale`` brings the norm of the values down to ``most``.
    """
    kept = F.when(~F.isnan(value) & F.col(value).between(low, high), F.col(value))
    found = rows.groupBy(step).agg(
        F.count(kept).alias("n"), (F.count("*") - F.count(kept)).alias("skipped"), F.sum(kept).alias("_sum"), F.sqrt(F.sum(kept * kept)).alias("_norm")
    )
    scale = F.least(F.lit(1.0), most / (F.col("_norm") + 1e-6))
    return found.where("n > 0").select(step, "n", "skipped", (F.col("_sum") / F.col("n")).alias("mean"), scale.alias("scale"))


#: Fixed value: bars from nothing to full.
BARS = " ▁▂▃▄▅▆▇█"


def levels(df: DataFrame, key: str, value: str) -> DataFrame:
    """``df`` plus level: where a value stands between its key's least (0) and largest (8); 0 for a flat series."""
    ends = df.groupBy(F.col(key).alias("_key")).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    return df.join(ends, F.col(key).eqNullSafe(F.col("_key"))).withColumn("level", _level(F.col(value))).drop("_key", "_low", "_high")


def _level(value: Column) -> Column:
    span = F.when(F.col("_high") != F.col("_low"), F.col("_high") - F.col("_low")).otherwise(1.0)
    return ((value - F.col("_low")) / span * (len(BARS) - 1)).cast("int")


def sparkline(df: DataFrame, key: str, order: str, value: str, width: int = 20) -> DataFrame:
    """key, line: bars of each key's last ``width`` values, levelled over all of them, filled up with blanks.

    Null and NaN values are left out; a key without values has no line.
    """
    ends = _sound(df, value).groupBy(F.col(key).alias("_key")).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    last = scans.last_rows(_sound(df, value).select(key, order, value), key, [order, value], width)
    rows = last.join(ends, F.col(key).eqNullSafe(F.col("_key"))).withColumn("level", _level(F.col(value)))
    bars = F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("at"), F.substring(F.lit(BARS), F.col("level") + 1, F.lit(1)).alias("bar"))))
    return rows.groupBy(key).agg(F.rpad(F.array_join(F.transform(bars, lambda b: b["bar"]), ""), width, " ").alias("line"))


def log_line(step: Column, lr: Column, ce: Column, ppl: Column, aux: Column, vram: Column, vram_total: Column, tok_s: Column, delta: Column) -> Column:
    return F.format_string(LOG_FORMAT, step, lr, ce, ppl, aux, vram, vram_total, tok_s, delta)


def parse_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """One row per metrics line; other lines, also those with ``nan``, are dropped."""
    text = F.col(line)
    found = lines.where(text.rlike(LOG_LINE))
    part = lambda i: F.regexp_extract(text, LOG_LINE, i)
    return found.select(
        part(1).cast("long").alias("step"), *(part(i).cast("double").alias(n) for i, n in enumerate(LOG_FIELDS[1:], 2))
    )


def log_summary(parsed: DataFrame) -> DataFrame:
    """First, last and percentual change of the series by step; changes are 0 where the first is 0."""
    ends = []
    for name in ("ppl", "ce", "tok_s", "aux"):
        ends += [F.min_by(name, "step").alias(f"{name}_first"), F.max_by(name, "step").alias(f"{name}_last")]
    row = parsed.agg(F.count("*").alias("n"), *ends, F.avg("delta").alias("delta_mean"))

    def change(name: str, sign: int) -> Column:
        first, last = F.col(f"{name}_first"), F.col(f"{name}_last")
        return F.when(first != 0, sign * (last - first) / first * 100).otherwise(0.0).alias(f"{name}_change")

    return row.select("*", change("ppl", -1), change("ce", -1), change("tok_s", 1), change("aux", -1))


def rolling(df: DataFrame, key: str, order: str, value: str, n: int, block: int | None = None) -> DataFrame:
    """Mean, least and largest of the last n rows of a key, which is cut into blocks (``scans.with_halo``)."""
    rows, window = scans.with_halo(df.select(key, order, value), [key], order, n, block)
    frame = window.rowsBetween(-(n - 1), 0)
    told = rows.select(
        key, order, F.avg(value).over(frame).alias("mean"), F.min(value).over(frame).alias("low"), F.max(value).over(frame).alias("high"), F.count(value).over(frame).alias("n"), "_halo"
    )
    return told.where(~F.col("_halo")).drop("_halo")


def gaps(df: DataFrame, key: str, order: str, at: str, block: int | None = None) -> DataFrame:
    """``df`` plus gap: how far ``at`` is beyond that of the key's row before; null for the first row."""
    rows, window = scans.with_halo(df, [key], order, 2, block)
    rows = rows.withColumn("gap", F.col(at) - F.lag(at).over(window))
    return rows.where(~F.col("_halo")).select(*df.columns, "gap")


def baseline_delta(df: DataFrame, key: str, order: str, value: str, alpha: float = 0.02, factor: float = 3.0, splits: int | None = None) -> DataFrame:
    """key, order, value, ema (gated), baseline (ungated) and how far the first is below the second, in per cent."""
    rows = gated_ema(df, key, order, value, alpha, factor, splits).drop("rejected")
    v = F.col(value)  # the first value as the state before it gives itself
    rows = scans.affine_scan(rows, key, [order, value, "ema"], F.lit(1 - alpha), v * alpha, v, "baseline", splits)
    return rows.withColumn("delta", (F.col("baseline") - F.col("ema")) / (F.col("baseline") + 1e-8) * 100)
