"""Recurrences, gates, frames and softmax states, with one key or memory over many tasks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import attention as A
from quern.operators import scans, series
from quern.storage import Scratch

ROWS = "k string, o long, v double"


def one_series(n=3000, seed=1, spikes=True):
    rnd = random.Random(seed)
    level, rows = 5.0, []
    for i in range(n):
        level = max(0.5, level + rnd.gauss(0, 0.2))
        rows.append(("a", i, level * (rnd.choice([4, 9, 30]) if spikes and rnd.random() < 0.05 else 1)))
    return rows


def several(spark):
    rows = one_series() + [("b", i // 2, float(i % 5)) for i in range(40)] + [(None, i, 2.0) for i in range(7)] + [("c", None, 3.0), ("c", None, 1.0), ("c", 1, 9.0)]
    rows += [("b", 3, None), ("b", 4, math.nan), ("d", 1, -4.0), ("d", 2, -5.0), ("d", 3, 2.0)]
    random.Random(3).shuffle(rows)
    return rows, spark.createDataFrame(rows, ROWS)


def by_key(rows, nan=False):
    out = {}
    sound = [r for r in rows if r[2] is not None and (nan or not math.isnan(r[2]))]
    for k, o, v in sorted(sound, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2])):
        out.setdefault(k, []).append((o, v))
    return out


def fold_gate(series_, alpha=0.02, factor=3.0):
    ema, out = None, []
    for o, v in series_:
        if ema is None:
            ema, gone = v, 0
        elif factor is not None and v > ema * factor:
            gone = 1
        else:
            ema, gone = (1 - alpha) * ema + alpha * v, 0
        out.append((o, v, ema, gone))
    return out


@pytest.mark.parametrize("factor", [3.0, None])
def test_gate_equals_the_fold_to_the_last_bit(spark, factor):
    rows, df = several(spark)
    got = series.gated_ema(df, "k", "o", "v", factor=factor, splits=16).collect()
    want = [(k, *r) for k, s in by_key(rows).items() for r in fold_gate(s, factor=factor)]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_gate_runs_few_segments_again(spark):
    rows = one_series(8000)
    df = spark.createDataFrame(rows, ROWS)
    scratch = Scratch(spark, "t")
    dealt = scratch.save(scans.split(df, ["k", "o", "v"], 16), "dealt")
    n = dealt.select("_part").distinct().count()
    states, repairs = scans.gated_states(dealt, "k", "v", 0.02, 3.0, scratch)
    assert n == states.count() == 16 and 15 <= repairs < 16 * 15 / 2
    firsts = {r["_part"]: r["_n"] for r in dealt.groupBy("_part").agg(F.min("o").alias("_n")).collect()}
    fold = fold_gate([(o, v) for _, o, v in rows])
    for r in states.collect():
        at = firsts[r["_q"]]
        assert r["_start"] == (fold[at - 1][2] if at else None)


def test_affine_scan_over_many_splits(spark):
    rows, df = several(spark)
    got = series.linear_scan(df, "k", "o", "v", -0.5, splits=16).where("v = v").collect()
    want = []
    for k, s in by_key([r for r in rows if not (r[2] is not None and math.isnan(r[2]))]).items():
        h = 0.0
        for o, v in s:
            h = math.exp(-0.5) * h + v
            want.append((k, o, v, h))
    assert len(got) == len(want) + 1 or len(got) == len(want)
    found = {}
    for r in got:
        found.setdefault((r["k"], r["o"], r["v"]), []).append(r["h"])
    for k, o, v, h in want:
        if k != "b":  # where a NaN is a step of the series
            assert any(x == pytest.approx(h, rel=1e-12) for x in found[k, o, v])


def test_vectors_and_a_start(spark):
    rnd = np.random.default_rng(2)
    a, b = rnd.uniform(0.2, 1.0, (500, 3)), rnd.normal(size=(500, 3))
    rows = [("x", i, a[i].tolist(), b[i].tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o long, a array<double>, b array<double>").repartition(5)
    start = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    got = {r["o"]: r["h"] for r in scans.affine_scan(df, "k", ["o"], F.col("a"), F.col("b"), start, splits=16).collect()}
    h = np.array([1.0, 2.0, 3.0])
    for i in range(500):
        h = a[i] * h + b[i]
        assert got[i] == pytest.approx(h.tolist(), rel=1e-11, abs=1e-12)
    assert scans.affine_scan(df.limit(0), "k", ["o"], F.col("a"), F.col("b")).collect() == []


def test_baseline_over_many_splits(spark):
    rows, df = several(spark)
    got = sorted((tuple(r) for r in series.baseline_delta(df, "k", "o", "v", splits=16).where("k in ('a', 'd')").collect()), key=repr)
    want = []
    for k in "ad":
        s = by_key(rows)[k]
        gate, base = fold_gate(s), [b[2] for b in fold_gate(s, factor=None)]
        want += [(k, o, v, e, b, (b - e) / (b + 1e-8) * 100) for (o, v, e, _), b in zip(gate, base, strict=True)]
    want.sort(key=repr)
    assert len(got) == len(want)
    for x, y in zip(got, want, strict=True):
        assert x[:4] == y[:4] and x[4:] == pytest.approx(y[4:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("chunk", [1, 7, 64])
def test_chunked_scan_equals_brute_force(spark, chunk):
    rnd = np.random.default_rng(4)
    rows = []
    for k, n in (("a", 200), (None, 9), ("c", 1)):
        logs, drive = -rnd.exponential(2.0, (n, 4)), rnd.normal(size=(n, 4))
        rows += [(k, i, logs[i].tolist(), drive[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, o long, l array<double>, b array<double>").repartition(6)
    got = {(r["k"], r["o"]): r["h"] for r in scans.chunked_scan(df, "k", "o", F.col("l"), F.col("b"), chunk).collect()}
    assert len(got) == len(rows)
    for key in ("a", None, "c"):
        own = [r for r in rows if r[0] == key]
        h = np.zeros(4)
        for at in range(0, len(own), chunk):
            part, log_p, fill = own[at : at + chunk], np.zeros(4), np.zeros(4)
            for _, o, logs, drive in part:
                log_p = log_p + logs
                fill = fill + np.array(drive) * np.exp(np.minimum(-log_p, 30))
                now = np.exp(log_p) * h + np.exp(log_p) * fill
                now = now / max(1.0, np.linalg.norm(now))
                assert got[key, o] == pytest.approx(now.tolist(), rel=1e-9, abs=1e-12)
            h = now


def test_frames_reach_over_blocks(spark):
    rows, df = several(spark)
    df = df.where("v is not null and not isnan(v) and o is not null")
    got = sorted(map(tuple, series.rolling(df, "k", "o", "v", 50, block=60).where("k = 'a'").collect()), key=lambda r: r[1])
    values = [v for _, v in by_key(rows)["a"]]
    for i, (_, o, mean, low, high, n) in enumerate(got):
        near = values[max(0, i - 49) : i + 1]
        assert (o, low, high, n) == (i, min(near), max(near), len(near)) and mean == pytest.approx(sum(near) / len(near))
    whole = sorted(map(repr, series.rolling(df, "k", "o", "v", 5).select("k", "o", "low", "high", "n").collect()))
    assert sorted(map(repr, series.rolling(df, "k", "o", "v", 5, block=4).select("k", "o", "low", "high", "n").collect())) == whole
    times = spark.createDataFrame([("x", i, i * i) for i in range(100)], "k string, o long, at long")
    assert sorted((r["o"], r["gap"]) for r in series.gaps(times, "k", "o", "at", block=3).where("gap is not null").collect()) == [(i, 2 * i - 1) for i in range(1, 100)]


def test_conv_and_last_rows_over_blocks(spark):
    rows = spark.createDataFrame([(1, i, [float(i), 1.0]) for i in range(50)], "seq long, t long, v array<double>")
    whole = {r["t"]: r["v"] for r in A.causal_conv(rows, (0.1, 0.2, 0.3, 0.4)).collect()}
    assert {r["t"]: r["v"] for r in A.causal_conv(rows, (0.1, 0.2, 0.3, 0.4), block=5).collect()} == whole
    assert whole[2][0] == pytest.approx(0.4 * 2 + 0.3 * 1) and whole[9][0] == pytest.approx(0.4 * 9 + 0.3 * 8 + 0.2 * 7 + 0.1 * 6)
    last = scans.last_rows(rows.select("seq", "t"), "seq", ["t"], 7, ways=4).collect()
    assert sorted((r["_back"], r["t"]) for r in last) == [(b, 50 - b) for b in range(1, 8)]


def test_memory_of_many_blocks(spark):
    rnd = np.random.default_rng(5)
    q, s = rnd.normal(size=(60, 8)), rnd.normal(size=(90, 8))
    rows = [(i, x.tolist()) for i, x in enumerate(q)] + [(0, q[0].tolist()), (None, q[1].tolist()), (7, q[2].tolist())]
    slots = [(i % 80, x.tolist()) for i, x in enumerate(s)]  # ids repeat
    a, b = (spark.createDataFrame(x, "vec_id long, v array<double>") for x in (rows, slots))
    cos = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (s / np.linalg.norm(s, axis=1, keepdims=True)).T
    want = np.exp(cos) / np.exp(cos).sum(axis=1, keepdims=True) @ s * math.tanh(0.5)
    got = A.memory_read(a, b, 0.5, query_block=16, slot_block=20).collect()
    assert len(got) == len(rows)
    for r in got:
        options = [want[1]] if r["vec_id"] is None else [want[r["vec_id"]], *([want[2]] if r["vec_id"] == 7 else [])]
        assert any(np.allclose(r["r"], w, rtol=1e-10) for w in options)
    assert A.memory_read(a, b.limit(0), 0.5).collect() == []


def test_states_of_large_scores_merge(spark):
    """Scores far beyond what an exponential holds, in blocks whose maxima differ."""
    rows = spark.createDataFrame([(0, [1000.0], 0, [0, 1, 2])], "_row long, q array<double>, _q long, _ks array<long>")
    slots = spark.createDataFrame([([float(x)], [float(x)], x % 3, [0]) for x in range(9)], "k array<double>, value array<double>, _k long, _qs array<long>")
    assert A.blocked_softmax(rows, slots, [], ["_row"]).first()["r"] == pytest.approx([8.0])


@pytest.mark.parametrize(("stride", "length"), [(3, 20), (8, 8), (5, 3)])
def test_segments_in_small_blocks(spark, stride, length):
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(length, 4))
    df = spark.createDataFrame([("s", t, x[t].tolist()) for t in range(length)], "seq string, t long, v array<double>")
    got = {r["t"]: r["r"] for r in A.segment_attention(df, stride, 0.5, 4, query_block=4, slot_block=2).collect()}
    slots = [np.zeros(4)] + ([x[j * stride : (j + 1) * stride].mean(axis=0) for j in range(length // stride - 1)] if length > stride else [])
    for t in range(length):
        near = [(j, k) for j, k in enumerate(slots) if j <= t // stride]
        w = np.array([math.exp(x[t] @ k / 2 - math.log1p(0.5 * (t // stride - j))) for j, k in near])
        assert got[t] == pytest.approx((w / w.sum() @ np.array([k for _, k in near])).tolist(), abs=1e-12)


@pytest.mark.parametrize("alpha", [None, 0.1])
def test_a_block_of_scores_is_never_held_whole(alpha):
    import tracemalloc

    import pyarrow as pa

    rnd = np.random.default_rng(1)
    q, k = rnd.normal(size=(1_500, 8)), rnd.normal(size=(2_000, 8))
    queries = pa.table({"_row": np.arange(1_500), "q": pa.array([*q]), "at": np.arange(1_500) - 2})
    slots = pa.table({"k": pa.array([*k]), "value": pa.array([*k]), "at": np.arange(2_000)})
    tracemalloc.start()
    got = A._partial(queries, slots, ["_row"], 0.5, alpha)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_500 * 2_000 * 8, peak
    scores = q @ k.T * 0.5
    if alpha is not None:
        apart = queries["at"].to_numpy()[:, None] - slots["at"].to_numpy()[None, :]
        scores = np.where(apart >= 0, scores - np.log1p(alpha * np.maximum(apart, 0)), -np.inf)[2:]
    m = scores.max(axis=1)
    weights = np.exp(scores - m[:, None])
    assert got["_row"].to_pylist() == [*range(0 if alpha is None else 2, 1_500)]
    np.testing.assert_allclose(got["m"].to_numpy(), m)
    np.testing.assert_allclose(got["s"].to_numpy(), weights.sum(axis=1))
    np.testing.assert_allclose(np.array(got["acc"].to_pylist()), weights @ k, atol=1e-9)
