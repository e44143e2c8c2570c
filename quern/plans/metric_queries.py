"""Registered queries over ``events``, read as metric series (value: loss, event_id: step, user_id: run)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import metrics as M
from quern.operators import series
from quern.plans.text_queries import table

EVERY = 50
TOKENS = 4 * 16 * 512


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")


def r6(column):
    return F.round(column, 6) + F.lit(0.0)


def fmt_duration(spark, sf_dir):
    s = F.round(F.col("value") * 100) + 0.3  # no ties, which engines round differently
    return _events(spark, sf_dir).select("event_id", M.short_duration(s).alias("short"), M.clock_duration(s).alias("clock"))


def picky_filter(spark, sf_dir):
    low, high = M.picky_bounds(F.col("event_id").cast("double"))
    loss = F.col("value") / 20
    return _events(spark, sf_dir).where(loss.between(low, high)).select("event_id", r6(loss).alias("loss"))


def ema_spike(spark, sf_dir):
    rows = series.gated_ema(_events(spark, sf_dir), "user_id", "event_id", "value")
    return rows.select("user_id", "event_id", r6(F.col("ema")).alias("ema"), "rejected")


def loss_spike(spark, sf_dir):
    rows = series.gated_ema(_events(spark, sf_dir), "user_id", "event_id", "value")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("rejected").cast("long").alias("n_rejected"))


def baseline_delta(spark, sf_dir):
    rows = series.baseline_delta(_events(spark, sf_dir), "user_id", "event_id", "value")
    return rows.select("user_id", "event_id", r6(F.col("baseline")).alias("baseline"), F.round("delta", 4).alias("delta"))


def interval_metrics(spark, sf_dir):
    kept = F.col("value").between(1, 100)
    rows = series.with_interval(_events(spark, sf_dir), "event_id", EVERY)
    return rows.groupBy("interval").agg(
        F.count("*").alias("n"),
        F.count(F.when(kept, 1)).alias("n_kept"),
        r6(F.avg(F.when(kept, F.col("value")))).alias("mean_ce"),
    )


def _lines(spark, sf_dir):
    v, nan = F.col("value"), F.col("event_id") % 10 == 9
    line = series.log_line(
        F.col("event_id"),
        F.lit(4e-4),
        F.floor(v).cast("double"),
        F.floor(v * 2).cast("double"),
        F.lit(0.25),
        F.lit(9.5),
        F.lit(16.0),
        F.floor(v * 100).cast("double"),
        F.floor(v - 50).cast("double"),
    )
    return _events(spark, sf_dir).select(F.when(nan, F.regexp_replace(line, r"CE=\d+", "CE=nan")).otherwise(line).alias("value"))


def log_parse(spark, sf_dir):
    return series.parse_log(_lines(spark, sf_dir))


def log_summary(spark, sf_dir):
    row = series.log_summary(series.parse_log(_lines(spark, sf_dir)))
    return row.select("n", *(r6(F.col(c)).alias(c) for c in row.columns if c != "n"))


def rolling_history(spark, sf_dir):
    rows = series.rolling(_events(spark, sf_dir), "user_id", "event_id", "value", 50)
    return rows.select("user_id", "event_id", F.round("mean", 8).alias("mean"), "low", "high", "n")


def events_props(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", F.from_json("props", "k int").alias("p"))
    return rows.select("event_id", "p.k", F.to_json("p").alias("again"))


def cosine_lr(spark, sf_dir):
    rate = M.cosine_rate(F.col("event_id").cast("double") * 6)
    return _events(spark, sf_dir).select("event_id", F.round(rate, 10).alias("lr"))


def ppl(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.round(M.perplexity(F.col("value") / 10), 3).alias("ppl"))


def throughput(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    rows = series.gaps(rows, "user_id", "event_id", "at").select("user_id", "event_id", F.coalesce("gap", F.lit(0)).cast("double").alias("ms"))
    return rows.select("user_id", "event_id", r6(M.tokens_per_second(F.lit(float(TOKENS)), F.col("ms"))).alias("tok_s"))


def sparkline(spark, sf_dir):
    rows = series.levels(_events(spark, sf_dir).select("user_id", "event_id", "value"), "user_id", "value")
    return rows.select("user_id", "event_id", "level", M.delta_class(F.col("value") - 50).alias("class"))


def sparkline_text(spark, sf_dir):
    return series.sparkline(_events(spark, sf_dir), "user_id", "event_id", "value")


def trust_weighted_mean(spark, sf_dir):
    ce = F.when(F.col("event_id") % 10 == 0, 0.0).otherwise(F.col("value"))
    weight = F.least(F.greatest(F.col("user_id") % 120 / F.lit(100.0), F.lit(0.0)), F.lit(1.0))
    return _events(spark, sf_dir).groupBy("event_type").agg(r6(F.sum(ce * weight) / (F.sum(weight) + 1e-8)).alias("mean_ce"))


def masked_mean(spark, sf_dir):
    kept = F.when(F.col("event_id") % 10 != 0, F.col("value"))
    return _events(spark, sf_dir).groupBy("event_type").agg(r6(F.avg(kept)).alias("mean_ce"))


def accumulated(spark, sf_dir):
    """Micro-batches of eight: the mean loss of those that are learned from, and how many are skipped."""
    rows = _events(spark, sf_dir).select(F.floor(F.col("event_id") / 8).alias("step"), (F.col("value") / 5).alias("loss"))
    found = series.accumulated(rows, "step", "loss", *M.picky_bounds(F.col("step").cast("double")))
    return found.select("step", "n", "skipped", r6(F.col("mean")).alias("mean"), r6(F.col("scale")).alias("scale"))


def linear_scan(spark, sf_dir):
    rows = series.linear_scan(_events(spark, sf_dir), "user_id", "event_id", "value", -0.5)
    return rows.select("user_id", "event_id", r6(F.col("h")).alias("h"))


NAMES = [
    "fmt_duration", "picky_filter", "ema_spike", "loss_spike", "baseline_delta", "interval_metrics", "log_parse",
    "log_summary", "rolling_history", "events_props", "cosine_lr", "ppl", "throughput", "sparkline", "sparkline_text",
    "trust_weighted_mean", "masked_mean", "accumulated", "linear_scan",
]


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}


# --- SQL ---------------------------------------------------------------------------

_S = M.Schedule()
_ORD = "o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)"
_EMA = f"""WITH RECURSIVE {_ORD},
r AS (
  SELECT user_id, event_id, rn, value AS ema, value AS base, 0 AS rejected FROM o WHERE rn = 1
  UNION ALL
  SELECT o.user_id, o.event_id, o.rn, CASE WHEN o.value > r.ema * 3 THEN r.ema ELSE 0.98::DOUBLE * r.ema + 0.02::DOUBLE * o.value END,
    0.98::DOUBLE * r.base + 0.02::DOUBLE * o.value, (o.value > r.ema * 3)::INT
  FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1)"""
_LOG = """l AS (
  SELECT event_id AS step, 4e-4::DOUBLE AS lr, floor(value)::DOUBLE AS ce, floor(value * 2)::DOUBLE AS ppl, 0.25::DOUBLE AS aux, 9.5::DOUBLE AS vram,
    16.0::DOUBLE AS vram_total, floor(value * 100)::DOUBLE AS tok_s, floor(value - 50)::DOUBLE AS delta FROM events WHERE event_id % 10 <> 9)"""


def _change(name: str, sign: int) -> str:
    a, b = f"arg_min({name}, step)", f"arg_max({name}, step)"
    return f"""round({a}, 6) AS {name}_first, round({b}, 6) AS {name}_last,
  CASE WHEN {a} <> 0 THEN round({sign} * ({b} - {a}) / {a} * 100, 6) + 0.0 ELSE 0.0 END::DOUBLE AS {name}_change"""


def oracle_sql() -> dict[str, str]:
    warm = max(_S.curriculum_warmup, int(_S.steps * _S.curriculum_end), 1)
    t = f"least(1.0::DOUBLE, event_id / {warm}.0::DOUBLE)"
    s = "(round(value * 100) + 0.3)"
    return {
        "fmt_duration": f"""SELECT event_id, CASE WHEN {s} < 60 THEN printf('%.0fs', {s}) WHEN {s} < 3600 THEN printf('%.1fmin', {s} / 60)
  ELSE printf('%.1fh', {s} / 3600) END AS short,
  printf('%02d:%02d:%02d', (floor({s})::BIGINT // 3600), (floor({s})::BIGINT % 3600 // 60), (floor({s})::BIGINT % 60)) AS clock FROM events""",
        "picky_filter": f"""SELECT event_id, round(value / 20, 6) AS loss FROM events
WHERE value / 20 BETWEEN {_S.low}::DOUBLE * {t} AND {_S.high}::DOUBLE + (20 - {_S.high}::DOUBLE) * (1 - {t})""",
        "ema_spike": f"{_EMA} SELECT user_id, event_id, round(ema, 6) AS ema, rejected FROM r",
        "loss_spike": f"{_EMA} SELECT user_id, count(*)::BIGINT AS n, sum(rejected)::BIGINT AS n_rejected FROM r GROUP BY user_id",
        "baseline_delta": f"{_EMA} SELECT user_id, event_id, round(base, 6) AS baseline, round((base - ema) / (base + 1e-8) * 100, 4) AS delta FROM r",
        "interval_metrics": f"""SELECT (ceil(event_id / {EVERY}.0::DOUBLE) * {EVERY})::BIGINT AS interval, count(*)::BIGINT AS n,
  count(*) FILTER (value BETWEEN 1 AND 100)::BIGINT AS n_kept, round(avg(value) FILTER (value BETWEEN 1 AND 100), 6) AS mean_ce
FROM events GROUP BY 1""",
        "log_parse": f"WITH {_LOG} SELECT * FROM l",
        "log_summary": f"""WITH {_LOG} SELECT count(*)::BIGINT AS n, {_change("ppl", -1)}, {_change("ce", -1)}, {_change("tok_s", 1)},
  {_change("aux", -1)}, round(avg(delta), 6) AS delta_mean FROM l""",
        "rolling_history": """SELECT user_id, event_id, round(avg(value) OVER w, 8) AS mean, min(value) OVER w AS low, max(value) OVER w AS high,
  count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""",
        "events_props": """SELECT event_id, json_extract(props, '$.k')::INT AS k, '{"k":' || json_extract(props, '$.k')::INT || '}' AS again FROM events""",
        "cosine_lr": f"""WITH s AS (SELECT event_id, event_id * 6.0::DOUBLE AS st FROM events)
SELECT event_id, round(CASE WHEN st < {_S.warmup} THEN {_S.rate}::DOUBLE * st / {_S.warmup}
  ELSE {_S.floor}::DOUBLE + ({_S.rate}::DOUBLE - {_S.floor}::DOUBLE) * 0.5::DOUBLE
    * (1 + cos(pi() * least((st - {_S.warmup}) / {_S.steps - _S.warmup}.0::DOUBLE, 1.0::DOUBLE))) END, 10) AS lr FROM s""",
        "ppl": "SELECT event_id, round(exp(least(value / 10, 20.0::DOUBLE)), 3) AS ppl FROM events",
        "throughput": f"""WITH g AS (SELECT user_id, event_id,
  coalesce(epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY event_id), 0)::DOUBLE AS ms FROM events)
SELECT user_id, event_id, CASE WHEN ms > 0 THEN round({TOKENS} / (ms / 1000), 6) ELSE 0.0::DOUBLE END AS tok_s FROM g""",
        "sparkline": """WITH e AS (SELECT user_id, min(value) AS low, max(value) AS high FROM events GROUP BY user_id)
SELECT user_id, event_id, trunc((value - low) / CASE WHEN high <> low THEN high - low ELSE 1.0 END * 8)::INT AS level,
  CASE WHEN value - 50 > 0 THEN 'better' WHEN value - 50 < -1 THEN 'worse' ELSE 'parity' END AS class FROM events JOIN e USING (user_id)""",
        "sparkline_text": f"""WITH e AS (SELECT user_id, min(value) AS low, max(value) AS high FROM events GROUP BY user_id),
l AS (SELECT user_id, event_id, trunc((value - low) / CASE WHEN high <> low THEN high - low ELSE 1.0 END * 8)::INT AS level,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events JOIN e USING (user_id))
SELECT user_id, rpad(string_agg(substring('{series.BARS}', level + 1, 1), '' ORDER BY event_id), 20, ' ') AS line FROM l WHERE n <= 20 GROUP BY user_id""",
        "trust_weighted_mean": """WITH x AS (SELECT event_type, CASE WHEN event_id % 10 = 0 THEN 0.0 ELSE value END AS ce,
  least(user_id % 120 / 100.0::DOUBLE, 1.0::DOUBLE) AS w FROM events)
SELECT event_type, round(sum(ce * w) / (sum(w) + 1e-8), 6) AS mean_ce FROM x GROUP BY event_type""",
        "masked_mean": "SELECT event_type, round(avg(value) FILTER (event_id % 10 <> 0), 6) AS mean_ce FROM events GROUP BY event_type",
        "accumulated": f"""WITH b AS (SELECT event_id // 8 AS step, value / 5 AS loss, least(1.0::DOUBLE, (event_id // 8) / {warm}.0::DOUBLE) AS t FROM events),
k AS (SELECT step, loss, loss BETWEEN {_S.low}::DOUBLE * t AND {_S.high}::DOUBLE + (20 - {_S.high}::DOUBLE) * (1 - t) AS ok FROM b),
g AS (SELECT step, count(*) FILTER (ok) AS n, count(*) FILTER (NOT ok) AS skipped, sum(loss) FILTER (ok) AS s, sqrt(sum(loss * loss) FILTER (ok)) AS norm FROM k GROUP BY step)
SELECT step::BIGINT AS step, n::BIGINT AS n, skipped::BIGINT AS skipped, round(s / n, 6) AS mean, round(least(1.0::DOUBLE, 1 / (norm + 1e-6)), 6) AS scale FROM g WHERE n > 0""",
        "linear_scan": f"""WITH RECURSIVE {_ORD}, r AS (
  SELECT user_id, event_id, rn, value AS h FROM o WHERE rn = 1
  UNION ALL SELECT o.user_id, o.event_id, o.rn, exp(-0.5::DOUBLE) * r.h + o.value FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1)
SELECT user_id, event_id, round(h, 6) AS h FROM r""",
    }
