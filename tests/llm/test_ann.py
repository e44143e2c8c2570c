import math

import numpy as np

from quern.llm import ann, skew


def brute(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(len(v), []).append((i, v))
    good = max(good.values(), key=len, default=[])
    out = []
    for i, v in good:
        if i % 20 == 0:
            rest = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in good if j != i)[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(rest, 1)]
    return out


def recall(spark, x, k=20):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found, hits = {}, 0
    for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q, got in found.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got & set(np.argsort(-s)[:k].tolist()))
    assert len(found) == -(-len(x) // 20)
    return hits / (k * len(found))


def test_small_tables_go_through_learned_parts(spark):
    """500 vectors of ten loose clusters, as the supplied tables have: eight parts, at least 0.9 of the neighbours."""
    assert ann.parts_of(500, 500) == ann.LEAST_PARTS and ann.parts_of(100, 100) == 1
    assert ann.parts_of(60_000, ann.SAMPLE) == 40 and ann.parts_of(10**9, ann.SAMPLE) == 425
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(10, 64))
    assert recall(spark, centres[rng.integers(0, 10, 500)] + 0.5 * rng.normal(size=(500, 64))) >= 0.9


def test_the_model_is_kept_as_a_row():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6))
    model = ann.fit(x, 8)
    row = {k: v.astype("<f8").tobytes() if isinstance(v, np.ndarray) else v for k, v in model.items()}
    assert np.array_equal(ann._forward(ann._model(row), x), ann._forward(model, x)) and 1 <= model["asked"] <= 8 and model["recall"] >= ann.TARGET


def test_queries_of_one_vector_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(skew, "FLOOR", 5)
    rows = [(i, [1.0, 2.0] if i % 3 else [float(i), 1.0]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.nearest(df, df).collect()]
    want = []
    for i, v in rows:
        rest = sorted((-(v[0] * w[0] + v[1] * w[1]), j) for j, w in rows if j != i)[:20]
        want += [(i, n, j, -s) for n, (s, j) in enumerate(rest, 1)]
    assert sorted(got) == sorted(want)


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(150)]  # many ties
    rows += [(200 + i, [1.0] * 6) for i in range(60)]
    rows += [(300, None), (301, []), (302, [0.0] * 6), (303, [float("nan")] * 6), (304, [None] * 6), (320, [float("inf")] * 6), (None, [1.0] * 6), (340, [1.0])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, part int")
    got = [tuple(r) for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect()]
    assert sorted(got) == sorted(brute(rows, 20))
    few = df.where("vec_id in (20, 21, 22)")
    assert len(ann.nearest(few, few.where("vec_id = 20")).collect()) <= 2
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_recall_with_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_SIZE", 300)
    monkeypatch.setattr(ann, "BLOCK", 200)
    monkeypatch.setattr(ann, "EPOCHS", 12)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 2400)] + 0.3 * rng.normal(size=(2400, 16))
    assert recall(spark, x) >= 0.9


def test_parts_are_balanced():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8))
    label = ann.balanced_parts(x, ann.neighbour_graph(x), 7, rng)
    assert np.bincount(label, minlength=7).max() <= math.ceil(1.1 * 900 / 7)
