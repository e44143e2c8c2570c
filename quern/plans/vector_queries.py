"""Registered queries over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators import attention as A
from quern.operators import scans
from quern.plans.metric_queries import r6
from quern.plans.text_queries import table
from quern.sources import checkpoints

DIM = 64
EXPERTS, TOP = 4, 2
#: Fixed value: slots of the memory.
SLOTS = 8_192
GATE = 0.5
SEQUENCE, WINDOW, STRIDE, LONG_STRIDE, ALPHA = 32, 8, 8, 16, 0.5
FILTER = (0.1, 0.2, 0.3, 0.4)
THRESHOLDS = (-0.5, 0.5, 1.5)
QUARTER = DIM // (len(THRESHOLDS) + 1)


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def _spread(df: DataFrame, *keys: str, column: str = "r", name: str = "value") -> DataFrame:
    """One row per component, i from 1."""
    rows = df.select(*keys, F.posexplode(column).alias("pos", "x"))
    return rows.select(*keys, (F.col("pos") + 1).alias("i"), r6(F.col("x")).alias(name))


def _by(factor: float) -> Column:
    """The vector times factor * (1, 2 or 3, by id)."""
    return V.scaled(F.col("v"), F.lit(factor) * (1 + F.col("vec_id") % 3))


def _pairs(spark, sf_dir) -> DataFrame:
    a = _vectors(spark, sf_dir)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("v2"))
    return a.join(b, "vec_id")


def _mapped(spark, sf_dir, column: Column) -> DataFrame:
    return _spread(_vectors(spark, sf_dir).select("vec_id", column.alias("r")), "vec_id")


def vec_norm(spark, sf_dir):
    df = _pairs(spark, sf_dir)
    return df.select("vec_id", r6(V.norm(F.col("v"))).alias("norm"), r6(V.dot(F.col("v"), F.col("v2"))).alias("dot"))


def project_ball(spark, sf_dir):
    return _mapped(spark, sf_dir, V.project_to_ball(_by(0.6), F.lit(1.0)))


def exp_map(spark, sf_dir):
    return _mapped(spark, sf_dir, V.exp_map(_by(1.0), F.lit(1.0)))


def log_map(spark, sf_dir):
    return _mapped(spark, sf_dir, V.log_map(_by(0.3), F.lit(1.0)))


def _half(name: str, by: float) -> Column:
    return V.scaled(F.col(name), F.lit(by))


def mobius_add(spark, sf_dir):
    df = _pairs(spark, sf_dir).select("vec_id", V.mobius_add(_half("v", 0.5), _half("v2", 0.3), F.lit(1.0)).alias("r"))
    return _spread(df, "vec_id")


def geodesic(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", r6(V.geodesic(_half("v", 0.5), _half("v2", 0.3), F.lit(1.0))).alias("d"))


def gravity_route(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    means = df.where(F.col("label") < EXPERTS).select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    rows = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("m"))
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("label", F.transform("m", lambda x: x["m"]).alias("m")))).alias("c"))
    near = df.crossJoin(F.broadcast(listed))  # one row of as many centroids as experts
    gates = V.distance_gates(F.transform("c", lambda c: V.geodesic(_half("v", 0.5), c["m"], F.lit(1.0))), F.lit(0.0))
    return _spread(near.select("vec_id", gates.alias("r")), "vec_id", name="gate")


def _logits(first: int = 1, n: int = 8) -> Column:
    return V.scaled(F.slice(F.col("v"), first, n), F.lit(5.0))


def _whole() -> Column:
    return V.scaled(F.col("v"), F.lit(5.0))


def softmax(spark, sf_dir):
    return _mapped(spark, sf_dir, V.softmax(_whole()))


def entropy_probe(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", r6(V.let(V.softmax(_whole()), V.entropy_share)).alias("h"))


def entropy_nats(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", r6(V.entropy_nats(_whole())).alias("h"))


def rms_norm(spark, sf_dir):
    return _mapped(spark, sf_dir, V.rms_norm(F.col("v")))


def layer_norm(spark, sf_dir):
    return _mapped(spark, sf_dir, V.layer_norm(F.col("v")))


def memory_read(spark, sf_dir):
    df = _vectors(spark, sf_dir).select("vec_id", "v")
    return _spread(A.memory_read(df, df.where(F.col("vec_id") < SLOTS), GATE), "vec_id")


def _sequences(spark, sf_dir) -> DataFrame:
    at = F.col("vec_id")
    return _vectors(spark, sf_dir).select("vec_id", F.floor(at / SEQUENCE).alias("seq"), (at % SEQUENCE).alias("t"), "v")


def window_attention(spark, sf_dir):
    read = A.window_attention(_sequences(spark, sf_dir), WINDOW, ALPHA, DIM)
    return _spread(read, "seq", "t")


def causal_pool(spark, sf_dir):
    return _spread(A.causal_pool(_sequences(spark, sf_dir), STRIDE), "seq", "slot", column="v")


def causal_conv(spark, sf_dir):
    return _spread(A.causal_conv(_sequences(spark, sf_dir), FILTER), "seq", "t", column="v")


def chunked_scan(spark, sf_dir):
    """The recurrence over vectors in chunks, with decays by the vectors' own size."""
    rows = _sequences(spark, sf_dir)
    log_decay = F.transform("v", lambda x: -F.abs(x) * 3)
    return _spread(scans.chunked_scan(rows, "seq", "t", log_decay, V.scaled(F.col("v"), F.lit(2.0)), STRIDE), "seq", "t", column="h")


def vector_scan(spark, sf_dir):
    """The recurrence over vectors itself, a decay for each component."""
    rows = _sequences(spark, sf_dir)
    decay = F.transform("v", lambda x: F.exp(-F.abs(x)))
    return _spread(scans.affine_scan(rows, "seq", ["t"], decay, F.col("v")), "seq", "t", column="h")


def activations(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("vec_id", F.posexplode("v").alias("pos", "x"))
    x = F.col("x") * 10
    return rows.select(
        "vec_id", (F.col("pos") + 1).alias("i"), r6(V.sigmoid(x)).alias("sigmoid"), r6(V.silu(x)).alias("silu"),
        r6(V.softplus(x)).alias("softplus"), r6(F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))).alias("clamp"),
    )


def conformal_factor(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", r6(V.conformal_factor(_half("v", 0.9), F.lit(1.0))).alias("factor"))


def _gates(spark, sf_dir) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", V.softmax(_logits(1, EXPERTS)).alias("gates"))


def topk_gates(spark, sf_dir):
    return _spread(_gates(spark, sf_dir).select("vec_id", V.top_gates(F.col("gates"), TOP).alias("r")), "vec_id", name="gate")


def expert_load(spark, sf_dir):
    return A.expert_load(_gates(spark, sf_dir)).select("expert", r6(F.col("load")).alias("load"))


def load_balance(spark, sf_dir):
    return A.load_balance(_gates(spark, sf_dir), EXPERTS, TOP).select(r6(F.col("loss")).alias("loss"))


def gsi(spark, sf_dir):
    return A.stability(A.expert_load(_gates(spark, sf_dir))).select(r6(F.col("gsi")).alias("gsi"))


def halting(spark, sf_dir):
    """A pass for each quarter of a vector."""
    passes = F.array(*(V.entropy_nats(_logits(1 + QUARTER * i, QUARTER)) for i in range(len(THRESHOLDS) + 1)))
    df = _vectors(spark, sf_dir).select("vec_id", passes.alias("entropies"))
    return A.halting(df, THRESHOLDS, QUARTER).select(r6(F.col("ponder")).alias("ponder"), r6(F.col("halted")).alias("halted"))


def scale_blend(spark, sf_dir):
    """Attention to rows, sentences and blocks of each sequence, blended by the softmax of their log weights."""
    return _spread(A.scale_blend(_sequences(spark, sf_dir), WINDOW, (STRIDE, LONG_STRIDE), ALPHA, DIM), "seq", "t")


def soft_merge(spark, sf_dir):
    return _spread(_pairs(spark, sf_dir).select("vec_id", V.merged(F.col("v"), F.col("v2"), F.lit(0.25)).alias("r")), "vec_id")


def prepend_strip(spark, sf_dir):
    """Three rows put before each vector's components, and two of them taken away again."""
    return _mapped(spark, sf_dir, V.strip_rows(V.prepend_rows(F.col("v"), F.slice("v", 5, 3)), 2))


def load_share(spark, sf_dir):
    gates = _gates(spark, sf_dir).select("vec_id", A.load_shares(V.scaled(F.col("gates"), F.lit(3.0))).alias("r"))
    return _spread(gates, "vec_id", name="share")


def _blocks(spark, sf_dir, lag: int) -> DataFrame:
    """Vectors as parameters: block is the label, name the id; every seventh has another shape."""
    v = F.when(F.col("vec_id") % 7 == lag, F.slice(F.col("v"), 1, DIM // 2)).otherwise(F.col("v"))
    return _vectors(spark, sf_dir).select(F.col("label").alias("block"), F.col("vec_id").alias("name"), v.alias("value"))


def shadow_merge(spark, sf_dir):
    """Parameters drawn towards those of the same block and name where the shapes agree."""
    main = _blocks(spark, sf_dir, 1)
    main = main.withColumn("value", V.scaled(F.col("value"), F.lit(2.0))).where(F.col("name") % 5 != 0)
    return _spread(checkpoints.shadow_merge(_blocks(spark, sf_dir, 0), main, 0.9), "block", "name", column="value")


def state_load(spark, sf_dir):
    """Current vectors, replaced where the stored state has one."""
    current = _vectors(spark, sf_dir).select(F.col("vec_id").alias("name"), F.col("v").alias("value"))
    stored = current.where(F.col("name") % 3 == 0).select("name", F.transform("value", lambda x: x + 1).alias("value"))
    unknown = stored.select((-F.col("name") - 1).alias("name"), "value")
    return _spread(checkpoints.loaded(current, stored.unionByName(unknown)), "name", column="value")


def window_mask(spark, sf_dir):
    return A.window_mask(_sequences(spark, sf_dir), WINDOW)


def decay_bias(spark, sf_dir):
    return A.decay_bias(_sequences(spark, sf_dir), ALPHA).select("seq", "i", "j", r6(F.col("bias")).alias("bias"))


def segment_bias(spark, sf_dir):
    return A.segment_bias(_sequences(spark, sf_dir), STRIDE, ALPHA).select("seq", "i", "j", r6(F.col("bias")).alias("bias"))


def context_efficiency(spark, sf_dir):
    """What the softmax of a row's three log weights (its first components) leaves to the scales beyond the first."""
    weights = V.softmax(_logits(1, 3))
    return _vectors(spark, sf_dir).select("vec_id", r6(V.let(weights, lambda s: s[1] + s[2])).alias("share"))


NAMES = [
    "vec_norm", "project_ball", "exp_map", "log_map", "mobius_add", "geodesic", "gravity_route", "softmax",
    "entropy_probe", "entropy_nats", "rms_norm", "layer_norm", "memory_read", "window_attention", "causal_pool",
    "causal_conv", "chunked_scan", "vector_scan", "activations", "conformal_factor", "topk_gates", "expert_load", "load_balance", "gsi", "halting",
    "window_mask", "decay_bias", "segment_bias", "context_efficiency", "scale_blend", "soft_merge", "prepend_strip", "load_share",
    "shadow_merge", "state_load",
]


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}


# --- SQL ---------------------------------------------------------------------------

_E = "e AS (SELECT vec_id, label, i::INT AS i, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i))"
_P = f"{_E}, p AS (SELECT a.vec_id, a.i, a.x, b.x AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 AND b.i = a.i)"
_BALL = """b AS (SELECT *, greatest(sqrt(sum(z * z) OVER (PARTITION BY vec_id)), 1e-10) AS zn FROM z),
o AS (SELECT * EXCLUDE (z), CASE WHEN zn > 0.99::DOUBLE THEN z * (0.99::DOUBLE / zn) ELSE z END AS value FROM b)"""
_OUT = "SELECT vec_id, i, round(value, 6) + 0.0 AS value FROM o"


def _scaled(factor: str) -> str:
    return f"{_E}, s AS (SELECT vec_id, i, x * {factor}::DOUBLE * (1 + vec_id % 3) AS x FROM e)"


def _mobius(x: str, y: str, source: str) -> str:
    return f"""q AS (SELECT vec_id, i, {x} AS x, {y} AS y FROM {source}),
d AS (SELECT *, sum(x * y) OVER k AS xy, sum(x * x) OVER k AS xx, sum(y * y) OVER k AS yy FROM q WINDOW k AS (PARTITION BY vec_id)),
z AS (SELECT vec_id, i, ((1 + 2 * xy + yy) * x + (1 - xx) * y) / greatest(1 + 2 * xy + xx * yy, 1e-10) AS z FROM d), {_BALL}"""


def _logit(first: int = 1, n: int = 8) -> str:
    last = first + n - 1
    return f"""l AS (SELECT vec_id, (i - {first - 1})::INT AS i, exp(5 * x) AS x FROM e WHERE i BETWEEN {first} AND {last}),
g AS (SELECT vec_id, i, x / sum(x) OVER (PARTITION BY vec_id) AS g FROM l)"""


_ATANH = "2 * atanh(least({n}, 1 - 1e-5::DOUBLE))"
_SEQ = f"{_E}, s AS (SELECT vec_id // {SEQUENCE} AS seq, vec_id % {SEQUENCE} AS t, i, x FROM e)"
_GRID = f"""q AS (SELECT DISTINCT vec_id // {SEQUENCE} AS seq, vec_id % {SEQUENCE} AS t FROM embeddings),
g AS (SELECT a.seq, a.t AS i, b.t AS j FROM q a JOIN q b ON b.seq = a.seq)"""
_TOP = f"""r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY g DESC, i) AS rn FROM g),
k AS (SELECT vec_id, i, CASE WHEN rn <= {TOP} THEN g ELSE 0 END AS g, rn FROM r)"""


def _halting() -> str:
    parts = []
    for n in range(len(THRESHOLDS) + 1):
        first = QUARTER * n + 1
        parts.append(
            f"""x{n} AS (SELECT vec_id, 5 * x AS x FROM e WHERE i BETWEEN {first} AND {first + QUARTER - 1}),
h{n} AS (SELECT vec_id, -sum(exp(x) / s * ln(exp(x) / s)) AS h FROM (SELECT vec_id, x, sum(exp(x)) OVER (PARTITION BY vec_id) AS s FROM x{n}) GROUP BY vec_id)"""
        )
    prev = "h0"
    parts.append("c0 AS (SELECT vec_id, h, FALSE AS halted FROM h0)")
    for n, raw in enumerate(THRESHOLDS):
        t = f"(1 / (1 + exp(-({raw}::DOUBLE))) * ln({QUARTER}.0::DOUBLE))"
        parts.append(
            f"""c{n + 1} AS (SELECT c.vec_id, c.halted OR c.h < {t} AS halted, CASE WHEN c.halted OR c.h < {t} THEN c.h ELSE n.h END AS h,
  CASE WHEN c.halted OR c.h < {t} THEN 0 ELSE 1 - 1 / (1 + exp(-({t} - c.h) * 5)) END AS f FROM c{n} c JOIN h{n + 1} n USING (vec_id))"""
        )
    assert prev
    last = len(THRESHOLDS)
    fractions = " + ".join(f"(SELECT avg(f) FROM c{n + 1})" for n in range(last))
    return f"""WITH {_E}, {", ".join(parts)}
SELECT round(({fractions}) / {last}, 6) AS ponder, round((SELECT avg(halted::INT) FROM c{last}), 6) AS halted"""


def _blend() -> str:
    """Scores against rows in reach, and against the zero slot and the means of full segments before the own one."""
    scales = [f"""k0 AS (SELECT q.seq, q.t, k.t AS j, k.i, k.x, 0.0::DOUBLE AS bias FROM (SELECT DISTINCT seq, t FROM s) q
  JOIN s k ON k.seq = q.seq AND q.t - k.t BETWEEN 0 AND {WINDOW - 1})"""]
    for n, stride in enumerate((STRIDE, LONG_STRIDE), 1):
        scales.append(f"""p{n} AS (
  SELECT s.seq, t // {stride} + 1 AS j, i, avg(x) AS x FROM s JOIN n USING (seq) WHERE n > {stride} AND t // {stride} < n // {stride} - 1 GROUP BY ALL
  UNION ALL SELECT DISTINCT seq, 0, i, 0.0 FROM s),
k{n} AS (SELECT q.seq, q.t, j, i, x, -ln(1 + {ALPHA}::DOUBLE * (q.t // {stride} - j)) AS bias FROM (SELECT DISTINCT seq, t FROM s) q
  JOIN p{n} k ON k.seq = q.seq AND j <= q.t // {stride})""")
    for n in range(3):
        scales.append(f"""c{n} AS (SELECT k.seq, k.t, j, exp(sum(s.x * k.x) / sqrt({DIM}.0::DOUBLE) + any_value(bias)) AS c
  FROM k{n} k JOIN s ON s.seq = k.seq AND s.t = k.t AND s.i = k.i GROUP BY ALL),
o{n} AS (SELECT seq, t, i, sum(c * x) / sum(c) AS r FROM c{n} JOIN k{n} USING (seq, t, j) GROUP BY ALL)""")
    return f"""WITH {_E}, r AS (SELECT vec_id, i, x / sqrt(avg(x * x) OVER (PARTITION BY vec_id) + 1e-6::DOUBLE) AS x FROM e),
s AS (SELECT vec_id // {SEQUENCE} AS seq, vec_id % {SEQUENCE} AS t, i, x FROM r), n AS (SELECT seq, count(DISTINCT t) AS n FROM s GROUP BY seq),
{", ".join(scales)}
SELECT seq, t, i, round(0.5::DOUBLE * o0.r + 0.3::DOUBLE * o1.r + 0.2::DOUBLE * o2.r, 6) + 0.0 AS value
FROM o0 JOIN o1 USING (seq, t, i) JOIN o2 USING (seq, t, i)"""


def oracle_sql() -> dict[str, str]:
    norm = "sqrt(sum(x * x) OVER (PARTITION BY vec_id))"
    loads = f"WITH {_E}, {_logit(1, EXPERTS)}, ld AS (SELECT i - 1 AS expert, avg(g) AS load FROM g GROUP BY i)"
    return {
        "vec_norm": f"WITH {_P} SELECT vec_id, round(sqrt(sum(x * x)), 6) AS norm, round(sum(x * y), 6) + 0.0 AS dot FROM p GROUP BY vec_id",
        "project_ball": f"WITH {_scaled('0.6')}, z AS (SELECT vec_id, i, x AS z FROM s), {_BALL} {_OUT}",
        "exp_map": f"""WITH {_scaled("1.0")}, n AS (SELECT *, greatest({norm}, 1e-10) AS n FROM s),
z AS (SELECT vec_id, i, x * tanh(n / 2) / n AS z FROM n), {_BALL} {_OUT}""",
        "log_map": f"""WITH {_scaled("0.3")}, z AS (SELECT vec_id, i, x AS z FROM s), {_BALL.replace("AS value", "AS x").replace("o AS", "m AS")},
n AS (SELECT *, greatest({norm}, 1e-10) AS n FROM m),
o AS (SELECT vec_id, i, x * {_ATANH.format(n="n")} / n AS value FROM n) {_OUT}""",
        "mobius_add": f"WITH {_P}, {_mobius('x * 0.5::DOUBLE', 'y * 0.3::DOUBLE', 'p')} {_OUT}",
        "geodesic": f"""WITH {_P}, {_mobius("-(x * 0.5::DOUBLE)", "y * 0.3::DOUBLE", "p")},
n AS (SELECT vec_id, greatest(sqrt(sum(value * value)), 1e-10) AS n FROM o GROUP BY vec_id)
SELECT vec_id, round({_ATANH.format(n="n")}, 6) AS d FROM n""",
        "gravity_route": f"""WITH {_E}, c AS (SELECT label AS c, i, avg(x) AS y FROM e WHERE label < {EXPERTS} GROUP BY label, i),
p AS (SELECT e.vec_id * 100 + c.c AS vec_id, i, e.x, c.y FROM e JOIN c USING (i)),
{_mobius("-(x * 0.5::DOUBLE)", "y", "p")},
n AS (SELECT vec_id // 100 AS v, vec_id % 100 AS c, greatest(sqrt(sum(value * value)), 1e-10) AS n FROM o GROUP BY vec_id),
x AS (SELECT v, c, exp(-({_ATANH.format(n="n")})) AS x FROM n)
SELECT v AS vec_id, (row_number() OVER (PARTITION BY v ORDER BY c))::INT AS i, round(x / sum(x) OVER (PARTITION BY v), 6) AS gate FROM x""",
        "softmax": f"WITH {_E}, {_logit(1, DIM)} SELECT vec_id, i, round(g, 6) AS value FROM g",
        "entropy_probe": f"WITH {_E}, {_logit(1, DIM)} SELECT vec_id, round(-sum(g * ln(g + 1e-8)) / ln({DIM}.0::DOUBLE), 6) AS h FROM g GROUP BY vec_id",
        "entropy_nats": f"WITH {_E}, {_logit(1, DIM)} SELECT vec_id, round(-sum(g * ln(g)), 6) AS h FROM g GROUP BY vec_id",
        "rms_norm": f"""WITH {_E}, o AS (SELECT vec_id, i, x / sqrt(avg(x * x) OVER (PARTITION BY vec_id) + 1e-6::DOUBLE) AS value FROM e) {_OUT}""",
        "layer_norm": f"""WITH {_E}, m AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY vec_id) AS c FROM e),
o AS (SELECT vec_id, i, c / sqrt(avg(c * c) OVER (PARTITION BY vec_id) + 1e-5::DOUBLE) AS value FROM m) {_OUT}""",
        "memory_read": f"""WITH {_E}, n AS (SELECT vec_id, i, x, {norm} AS n FROM e),
c AS (SELECT q.vec_id, s.vec_id AS slot, sum(q.x * s.x / q.n / s.n) AS c FROM n q JOIN n s ON s.i = q.i AND s.vec_id < {SLOTS} GROUP BY ALL),
w AS (SELECT vec_id, slot, exp(c) / sum(exp(c)) OVER (PARTITION BY vec_id) AS w FROM c),
o AS (SELECT w.vec_id, e.i, tanh({GATE}::DOUBLE) * sum(w * e.x) AS value FROM w JOIN e ON e.vec_id = slot GROUP BY w.vec_id, e.i) {_OUT}""",
        "window_attention": f"""WITH {_SEQ},
c AS (SELECT q.seq, q.t, k.t AS j, sum(q.x * k.x) / sqrt({DIM}.0::DOUBLE) - ln(1 + {ALPHA}::DOUBLE * (q.t - k.t)) AS c
  FROM s q JOIN s k ON k.seq = q.seq AND k.i = q.i AND q.t - k.t BETWEEN 0 AND {WINDOW - 1} GROUP BY q.seq, q.t, k.t),
w AS (SELECT seq, t, j, exp(c) / sum(exp(c)) OVER (PARTITION BY seq, t) AS w FROM c)
SELECT w.seq, w.t, s.i, round(sum(w * x), 6) + 0.0 AS value FROM w JOIN s ON s.seq = w.seq AND s.t = w.j GROUP BY ALL""",
        "causal_pool": f"""WITH {_SEQ}, n AS (SELECT seq, count(DISTINCT t) AS n FROM s GROUP BY seq),
m AS (SELECT seq, t // {STRIDE} AS slot, i, avg(x) AS v FROM s JOIN n USING (seq) WHERE n > {STRIDE} AND t // {STRIDE} < n // {STRIDE} - 1 GROUP BY ALL),
f AS (SELECT seq, unnest(range(1, {DIM + 1})) AS i FROM n)
SELECT seq, slot + 1 AS slot, i, round(v, 6) + 0.0 AS value FROM m UNION ALL SELECT seq, 0, i::INT, 0.0 FROM f""",
        "causal_conv": f"""WITH {_SEQ}, w(lag, w) AS (VALUES {", ".join(f"({n}, {x}::DOUBLE)" for n, x in enumerate(reversed(FILTER)))})
SELECT a.seq, a.t, a.i, round(sum(b.x * w), 6) + 0.0 AS value FROM s a JOIN w ON TRUE JOIN s b ON b.seq = a.seq AND b.i = a.i AND b.t = a.t - lag GROUP BY ALL""",
        "chunked_scan": f"""WITH RECURSIVE {_SEQ},
k AS (SELECT *, t // {STRIDE} AS c, sum(-abs(x) * 3) OVER (PARTITION BY seq, t // {STRIDE}, i ORDER BY t) AS l FROM s),
f AS (SELECT *, exp(l) * sum(2 * x * exp(least(-l, 30.0::DOUBLE))) OVER (PARTITION BY seq, c, i ORDER BY t) AS f FROM k),
m AS (SELECT seq, c, t, list(exp(l) ORDER BY i) AS p, list(f ORDER BY i) AS f FROM f GROUP BY ALL),
z AS (SELECT seq, c, arg_max(p, t) AS p, arg_max(f, t) AS f FROM m GROUP BY seq, c),
b AS (
  SELECT DISTINCT seq, 0::BIGINT AS c, list_resize([0.0::DOUBLE], {DIM}, 0.0::DOUBLE) AS h FROM m
  UNION ALL
  SELECT seq, c, list_transform(h, lambda x: x / greatest(sqrt(list_sum(list_transform(h, lambda y: y * y))), 1.0)) FROM (
    SELECT b.seq, b.c + 1 AS c, list_transform(range(1, {DIM + 1}), lambda i: z.p[i] * b.h[i] + z.f[i]) AS h FROM b JOIN z ON z.seq = b.seq AND z.c = b.c)),
g AS (SELECT m.seq, m.t, list_transform(range(1, {DIM + 1}), lambda i: m.p[i] * b.h[i] + m.f[i]) AS h FROM m JOIN b ON b.seq = m.seq AND b.c = m.c)
SELECT seq, t, i::INT AS i, round(h[i] / greatest(sqrt(list_sum(list_transform(h, lambda y: y * y))), 1.0), 6) + 0.0 AS value FROM g, unnest(range(1, {DIM + 1})) AS u(i)""",
        "vector_scan": f"""WITH RECURSIVE {_SEQ}, r AS (
  SELECT seq, t, i, x AS h FROM s WHERE t = 0
  UNION ALL SELECT s.seq, s.t, s.i, exp(-abs(s.x)) * r.h + s.x FROM r JOIN s ON s.seq = r.seq AND s.i = r.i AND s.t = r.t + 1)
SELECT seq, t, i, round(h, 6) + 0.0 AS value FROM r""",
        "activations": f"""WITH {_E}, t AS (SELECT vec_id, i, x * 10 AS x FROM e)
SELECT vec_id, i, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(x / (1 + exp(-x)), 6) + 0.0 AS silu,
  round(greatest(x, 0) + ln(1 + exp(-abs(x))), 6) AS softplus, round(least(greatest(x, -1.0), 1.0), 6) + 0.0 AS clamp FROM t""",
        "conformal_factor": f"""WITH {_E} SELECT vec_id, round(pow(greatest(1 - sum(x * 0.9::DOUBLE * (x * 0.9::DOUBLE)), 1e-6) / 2, 2), 6) AS factor FROM e GROUP BY vec_id""",
        "topk_gates": f"""WITH {_E}, {_logit(1, EXPERTS)}, {_TOP}
SELECT vec_id, i, round(g / (sum(g) OVER (PARTITION BY vec_id) + 1e-8), 6) AS gate FROM k""",
        "expert_load": f"{loads} SELECT expert, round(load, 6) AS load FROM ld",
        "load_balance": f"""{loads}, {_TOP}, f AS (SELECT i - 1 AS expert, avg((rn <= {TOP})::INT) AS f FROM k GROUP BY i)
SELECT round({EXPERTS} * sum(f * load), 6) AS loss FROM f JOIN ld USING (expert)""",
        "gsi": f"""{loads} SELECT round(CASE WHEN avg(load) < 1e-8 THEN 0 ELSE least(greatest(1 - coalesce(stddev_samp(load), 0) / (avg(load) + 1e-8), 0), 1) END, 6)::DOUBLE AS gsi FROM ld""",
        "halting": _halting(),
        "scale_blend": _blend(),
        "soft_merge": f"WITH {_P}, o AS (SELECT vec_id, i, 0.25::DOUBLE * x + 0.75::DOUBLE * y AS value FROM p) {_OUT}",
        "prepend_strip": """WITH r AS (SELECT vec_id, (embedding[5:7] || embedding)[3:] AS v FROM embeddings)
SELECT vec_id, i::INT AS i, round(v[i]::DOUBLE, 6) + 0.0 AS value FROM r, unnest(range(1, len(v) + 1)) AS u(i)""",
        "load_share": f"""WITH {_E}, {_logit(1, EXPERTS)}
SELECT vec_id, i, round(3 * g / (sum(3 * g) OVER (PARTITION BY vec_id) + 1e-8), 6) AS share FROM g""",
        "shadow_merge": f"""WITH {_E}, s AS (SELECT label AS block, vec_id AS name, i, x FROM e WHERE vec_id % 7 <> 0 OR i <= {DIM // 2}),
m AS (SELECT vec_id AS name, i, 2 * x AS y FROM e WHERE vec_id % 5 <> 0 AND vec_id % 7 NOT IN (0, 1))
SELECT block, name, i, round(CASE WHEN y IS NULL THEN x ELSE 0.9::DOUBLE * x + 0.1::DOUBLE * y END, 6) + 0.0 AS value FROM s LEFT JOIN m USING (name, i)""",
        "state_load": f"WITH {_E} SELECT vec_id AS name, i, round(x + (vec_id % 3 = 0)::INT, 6) + 0.0 AS value FROM e",
        "window_mask": f"WITH {_GRID} SELECT seq, i, j, i - j BETWEEN 0 AND {WINDOW - 1} AS keep FROM g",
        "decay_bias": f"WITH {_GRID} SELECT seq, i, j, CASE WHEN j <= i THEN round(-ln(1 + {ALPHA}::DOUBLE * (i - j)), 6) + 0.0 END AS bias FROM g",
        "segment_bias": f"""WITH {_GRID}, n AS (SELECT seq, count(DISTINCT i) AS n FROM g GROUP BY seq)
SELECT seq, i, j, CASE WHEN j <= i // {STRIDE} THEN round(-ln(1 + {ALPHA}::DOUBLE * (i // {STRIDE} - j)), 6) + 0.0 END AS bias
FROM g JOIN n USING (seq) WHERE j < n // {STRIDE}""",
        "context_efficiency": f"WITH {_E}, {_logit(1, 3)} SELECT vec_id, round(sum(g) FILTER (i > 1), 6) + 0.0 AS share FROM g GROUP BY vec_id",
    }
