"""Algebraic identities of the vector expressions, and worked gate cases."""

import math

import pytest
from pyspark.sql import functions as F

from quern.functions import metrics as M
from quern.functions import vectors as V
from quern.operators import attention as A
from quern.operators import series as S


@pytest.fixture(scope="module")
def pairs(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.alias("a").join(e.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1).select(F.col("a.v").alias("x"), F.col("b.v").alias("y")).limit(60).cache()


def apart(a, b):
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def worst(df, column):
    return df.agg(F.max(column)).first()[0]


@pytest.mark.parametrize("c", [0.5, 1.0, 2.0])
def test_ball_identities(pairs, c):
    c = F.lit(c)
    x, y = V.scaled(F.col("x"), F.lit(0.3)), V.scaled(F.col("y"), F.lit(0.4))
    zero = V.scaled(F.col("x"), F.lit(0.0))
    minus = V.scaled(x, F.lit(-1.0))
    assert worst(pairs, apart(V.log_map(V.exp_map(x, c), c), x)) < 1e-6
    assert worst(pairs, apart(V.mobius_add(x, zero, c), x)) < 1e-9
    assert worst(pairs, V.norm(V.mobius_add(minus, x, c))) < 1e-9
    assert worst(pairs, F.abs(V.geodesic(x, y, c) - V.geodesic(y, x, c))) < 1e-9
    assert worst(pairs, V.geodesic(x, x, c)) < 1e-6
    radius = pairs.select((1 / V.root_curvature(c) - 1e-2 + 1e-12).alias("r")).first()["r"]
    assert worst(pairs, V.norm(V.project_to_ball(V.scaled(x, F.lit(100.0)), c))) <= radius


def test_norms_and_shares(pairs):
    x = F.col("x")
    assert abs(worst(pairs, V.norm(V.rms_norm(x))) - math.sqrt(64)) < 1e-2
    assert worst(pairs, F.abs(V.total(V.layer_norm(x)))) < 1e-9
    assert worst(pairs, F.abs(V.total(V.softmax(x)) - 1)) < 1e-12
    assert worst(pairs, V.let(V.softmax(x), V.entropy_share)) <= 1 + 1e-6
    assert worst(pairs, V.entropy_nats(x)) <= math.log(64) + 1e-9
    assert worst(pairs, apart(V.shadow(x, F.col("y"), 0.0), F.col("y"))) == 0
    assert worst(pairs, apart(V.merged(x, F.col("y"), F.lit(1.0)), x)) == 0


def gates_of(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "gates array<double>")


def test_load_balance(spark):
    uniform = gates_of(spark, [[0.25 + e, 0.25, 0.25, 0.25 - e] for e in (1e-9, -1e-9)] * 4)
    assert abs(A.load_balance(uniform, 4, 2).first()["loss"] - 2) < 1e-6
    collapsed = gates_of(spark, [[1.0, 0.0, 0.0, 0.0]] * 5)
    assert abs(A.load_balance(collapsed, 4, 1).first()["loss"] - 4) < 1e-6
    assert abs(A.load_balance(uniform, 4, 4).first()["loss"] - 1) < 1e-6


def test_stability(spark):
    loads = lambda xs: spark.createDataFrame([(x,) for x in xs], "load double")
    assert A.stability(loads([1.0, 0.0, 0.0, 0.0])).first()["gsi"] == 0
    assert A.stability(loads([0.25] * 4)).first()["gsi"] == pytest.approx(1)
    assert A.stability(loads([0.0] * 4)).first()["gsi"] == 0
    assert A.stability(loads([0.7])).first()["gsi"] == pytest.approx(1)


def test_top_gates(spark):
    df = gates_of(spark, [[0.3, 0.3, 0.3, 0.1]])
    got = df.select(V.top_gates(F.col("gates"), 2).alias("g"), V.top_gates(F.col("gates"), 0).alias("z"), V.top_gates(F.col("gates"), 9).alias("a")).first()
    assert got["g"] == pytest.approx([0.5, 0.5, 0, 0]) and got["z"] == got["a"] == [0.3, 0.3, 0.3, 0.1]


def test_causal_pool(spark):
    rows = spark.createDataFrame([(0, t, [float(t)]) for t in range(33)] + [(1, t, [1.0]) for t in range(4)], "seq int, t int, v array<double>")
    got = {(r["seq"], r["slot"]): r["v"][0] for r in A.causal_pool(rows, 8).collect()}
    assert got == {(0, 0): 0.0, (0, 1): 3.5, (0, 2): 11.5, (0, 3): 19.5, (1, 0): 0.0}


def test_blend_and_rows(spark):
    df = spark.createDataFrame([([1.0], [2.0], [4.0])], "a array<double>, b array<double>, c array<double>")
    assert df.select(A.blended([F.col("a"), F.col("b"), F.col("c")]).alias("r")).first()["r"] == pytest.approx([1.9])
    rows = spark.createDataFrame([([3, 4],)], "r array<int>")
    got = rows.select(V.strip_rows(V.prepend_rows(F.col("r"), F.array(F.lit(1), F.lit(2))), 2).alias("r")).first()["r"]
    assert got == [3, 4]


def test_gated_average(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, 2.0, 30.0, float("nan"), 2.0])], "k int, i int, x double")
    rows = S.gated_ema(df, "k", "i", "x").orderBy("i").collect()
    assert [r["ema"] for r in rows] == pytest.approx([1, 1.02, 1.02, 1.0396]) and [r["rejected"] for r in rows] == [0, 0, 1, 0]


def test_log_lines(spark):
    lines = ["Step      7 | LR=4.00e-04 | CE=2.5000 | PPL=12.18 | GGR-aux=0.0100 | VRAM=9.50/16.0GiB | 2000tok/s | Baseline Δ=+1.5% | more", "Step 8 | CE=nan", ""]
    row = S.parse_log(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [tuple(r) for r in row] == [(7, 4e-4, 2.5, 12.18, 0.01, 9.5, 16.0, 2000.0, 1.5)]


def test_schedules_and_classes(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(M.cosine_rate(F.lit(1500.0))) == pytest.approx(2e-4)
    assert one(M.cosine_rate(F.lit(50_000.0))) == pytest.approx(1e-5) and one(M.cosine_rate(F.lit(3000.0))) == pytest.approx(4e-4)
    assert one(F.array(*M.picky_bounds(F.lit(7500.0)))) == pytest.approx([0.2, 12.0])
    assert one(F.array(*M.picky_bounds(F.lit(0.0)))) == pytest.approx([0.0, 20.0])
    assert one(M.clock_duration(F.lit(360_061.9))) == "100:01:01" and one(M.short_duration(F.lit(90.0))) == "1.5min"
    assert [one(M.parameter_class(F.lit(n), F.lit(d))) for n, d in (("x.curvature", 1), ("a.norm.weight", 2), ("w", 1), ("w", 2))] == ["geo", "no_decay", "no_decay", "decay"]
    assert [one(M.stability_class(F.lit(g))) for g in (0.9, 0.7, 0.1)] == ["good", "fair", "poor"]
    assert one(M.tokens_per_second(F.lit(100.0), F.lit(0.0))) == 0 and one(M.delta_class(F.lit(-0.5))) == "parity"
    assert one(M.share_class(F.lit(0.8))) == "fair"
