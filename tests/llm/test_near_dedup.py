import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import near_dedup, skew
from quern.llm.components import components
from quern.llm.near_dedup import banding, near_duplicates
from quern.storage import Scratch


def brute(rows, k, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {d: (len(s), rows[find(i)][0], find(i) == i) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))}


def near_copies(seed=5, groups=6, copies=14):
    """Groups of texts of all degrees of likeness, also chains that only link step by step."""
    rnd = random.Random(seed)
    rows = []
    for g in range(groups):
        words = [f"g{g}x{rnd.randrange(400)}" for _ in range(120)]
        for c in range(copies):
            if g % 2:
                words = words.copy()
            copy = words if g % 2 else words.copy()
            for _ in range(rnd.randrange(6)):
                copy[rnd.randrange(len(copy))] = f"n{rnd.randrange(10**6)}"
            rows.append(" ".join(copy))
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_equals_brute_force(spark):
    rows = [*near_copies(), (900, None), (901, ""), (902, "two words"), (903, "Two WORDS"), (904, "two\u00a0words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs, 4, 80).collect()}
    assert got == brute(rows, 4, 80)
    assert 5 < sum(not v[2] for v in got.values()) < len(rows) - 5


def test_odd_rows(odd, no_docs):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[5]["component_id"] == 1 and not by_id[5]["kept"] and by_id[1]["kept"]
    assert by_id[2]["n_shingles"] == 0 and by_id[2]["component_id"] == 2 and by_id[2]["kept"]
    assert by_id[None]["component_id"] is None and by_id[None]["kept"] and by_id[None]["n_shingles"] == 1
    assert near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("percent", [50, 65, 95])
def test_other_thresholds_equal_brute_force(spark, percent):
    rows = near_copies(seed=percent, groups=5, copies=10)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs, 3, percent).collect()}
    assert got == brute(rows, 3, percent)


def test_banding_meets_the_bound():
    assert banding(80) == (54, 6)
    for percent in (1, 10, 30, 50, 80, 90, 99):
        bands, rows = banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= near_dedup.LOST


def test_repeated_ids_follow_their_own_text(spark):
    a, b = "one two three four five six seven eight nine ten", "red green blue white black brown pink grey gold lime"
    rows = [(5, a), (5, b), (3, a + " eleven"), (7, b + " rose"), (5, a), (9, b)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    told = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got)
    assert told == [(3, 3, True), (5, 3, False), (5, 3, False), (5, 5, True), (7, 5, False), (9, 5, False)]
    assert len({r["group"] for r in got}) == 2 and sum(r["first"] for r in got) == 2


def test_common_buckets_sets_and_centres(spark, monkeypatch):
    """With hardly any key counted as rare, every join deals its keys out, and results stay."""
    monkeypatch.setattr(skew, "FLOOR", 2)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 3)
    rows = near_copies(seed=8, groups=4, copies=16)
    rows += [(1000 + i, rows[0][1]) for i in range(30)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()}
    assert got == brute(rows, 4, 80)


def test_components_of_stars_chains_and_noise(spark, monkeypatch):
    rnd = random.Random(4)
    edges = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000)]
    edges += [(rnd.randrange(2000, 2300), rnd.randrange(2000, 2300)) for _ in range(260)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        root[max(find(u), find(v))] = min(find(u), find(v))
    want = {x: find(x) for x in root if find(x) != x}
    df = spark.createDataFrame([*edges, *edges[:50]], "u long, v long")
    for floor in (skew.FLOOR, 3):
        monkeypatch.setattr(skew, "FLOOR", floor)
        assert {r["node"]: r["root"] for r in components(df, Scratch(spark, "t"), "c").collect()} == want


def test_dealt_join_keeps_every_row(spark, monkeypatch):
    monkeypatch.setattr(skew, "FLOOR", 5)
    left = spark.range(300).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    right = spark.createDataFrame([(7, "seven"), (8, "eight"), (11, "eleven")], "r long, name string")
    common = skew.common_in(left, ["k"], 300)
    assert [r["k"] for r in common.collect()] == [7]
    plain = sorted(map(repr, left.join(right, F.col("k") == F.col("r"), "left").collect()))
    assert sorted(map(repr, skew.dealt_join(left, right, [("k", "r")], common, ["x"], "left").collect())) == plain
    assert len(plain) == 300 and np.sum(["seven" in p for p in plain]) == 101
