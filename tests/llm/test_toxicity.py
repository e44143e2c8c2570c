import math
import re
import zlib

import numpy as np

from quern.llm import toxicity as t
from quern.llm.queries import op7_toxicity
from quern.storage import Scratch


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op7_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    right = sum((s >= 0.3) == bool(y) for s, y in held)
    assert right / len(held) > 0.9
    good = [s for s, y in held if y]
    clean = [s for s, y in held if not y]
    assert sum(a > b for a in good for b in clean) / len(good) / len(clean) > 0.95


def test_sentences_are_located():
    texts = [f"Fine words here number{i}. You awful creature{i}! More of it." if i % 3 == 0 else f"Fine words number{i}. All is well{i}." for i in range(90)]
    weights = t.fit(texts, [int(i % 3 == 0) for i in range(90)])
    found = t.Scorer(weights).offending(texts[0], 0.3)
    assert any("awful" in texts[0][f["start"] : f["end"]] for f in found)
    assert t.Scorer(weights).score(texts[1]) < 0.3 <= t.Scorer(weights).score(texts[0])


def test_one_class_and_no_labels(spark, odd, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    rows = t.toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in rows)
    assert all(r["score"] == 0 for r in rows if not (r["text"] or "").strip())
    assert t.toxicity(no_docs, labels).count() == 0
    assert t.train(no_docs, labels.limit(0), Scratch(spark, "t")) in ({}, {"": -30.0})


def test_scores_are_noisy_or():
    """One by one: words and beginnings weigh, sentences are logistic, a text is clean if all of them are."""
    weights = {"": -2.0, "awful": 1.5, "awfu~": 0.25, "creat~": -0.5, "creature": 0.75, "you": 0.125}
    scorer = t.Scorer(weights)
    for text in ["You awful creature! Fine.\nAwful, awful day? created", "", "1234 !!", "plain words only", "AWFUL" * 3, "a. b. c. awful"]:
        clean = 1.0
        for sentence in re.split(r"[.!?\n]", text.lower()):
            words = re.findall(r"[^\W\d_]+", sentence)
            if words:
                z = weights[""]
                for w in words:
                    for f in {w} | {w[:n] + "~" for n in (4, 5, 6) if len(w) >= n}:
                        z += weights.get(f, 0.0)
                clean *= 1 - 1 / (1 + math.exp(-z))
        assert abs(scorer.score(text) - (1 - clean)) < 1e-12


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(5)
    doc_of = np.sort(rng.integers(0, 12, 40))
    sentence_of = np.sort(rng.integers(0, 40, 160))
    bags = t.Bags(rng.integers(0, 9, 160), sentence_of, doc_of, rng.integers(0, 2, 12).astype(float))
    w = rng.normal(size=10)
    slopes = []
    for i in range(10):
        up, down = w.copy(), w.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slopes.append((bags.loss(up) - bags.loss(down)) / 2e-6)
    assert np.allclose(bags.gradient(w), slopes, atol=1e-7)


def test_sample_is_bounded_by_characters(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "concat('bad word', id, ' ', repeat('x ', 500)) as text")
    labels = spark.range(400).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    few = t.train(docs, labels, Scratch(spark, "t"), sample_chars=50_000)
    all_ = t.train(docs, labels, Scratch(spark, "t"))
    assert few and all_ and few != all_
