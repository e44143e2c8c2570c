"""Windows, dedup, quotas, order, repacking: worked cases."""

import itertools
import random
from functools import partial

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import series
from quern.operators import tokens as K
from quern.operators import windows as O
from quern.plans import text_queries as Q
from quern.sources import catalog
from quern.storage import Scratch
from quern.streaming.repack import Loader


def test_window_boundaries(spark):
    sizes = [0, 14, 15, 510, 511, 525, 1020]
    docs = spark.createDataFrame([(n, list(range(10, 10 + n))) for n in sizes], "doc int, ids array<int>")
    rows = O.token_windows(docs, 512).collect()
    counts = {n: sum(r["doc"] == n for r in rows) for n in sizes}
    assert counts == {0: 0, 14: 0, 15: 1, 510: 1, 511: 1, 525: 2, 1020: 2}
    for r in rows:
        assert len(r["input_ids"]) == len(r["labels"]) == 512
        assert r["input_ids"][0] == 2 and r["input_ids"][-1] == 0 and r["labels"][-1] == -100
    short = next(r for r in rows if r["doc"] == 15)
    assert short["input_ids"][:17] == [2, *range(10, 25), 0] and short["labels"][:17] == [*range(10, 25), 3, -100]


def test_window_beyond_a_quota_survives_in_a_later_source(spark):
    w1, w2, w3 = ([i] * 70 for i in (1, 2, 3))
    rows = [("a", 0, w1), ("a", 1, w2), ("a", 2, w1), ("b", 3, w1), ("b", 4, w2), ("b", 5, w3)]
    df = spark.createDataFrame(rows, "source string, ord int, input_ids array<int>")
    got = O.quota_mix(df, [("a", 1), ("b", 9)], ["ord"], Scratch(spark, "t")).select("source", "ord").collect()
    assert sorted(map(tuple, got)) == [("a", 0), ("b", 4), ("b", 5)]


def test_quotas():
    assert catalog.group_targets(1_000_000) == {"code": 250_000, "math": 250_000, "reasoning": 300_000, "educational": 200_000}
    assert catalog.group_targets(7) == {"code": 1, "math": 1, "reasoning": 2, "educational": 3}
    first, fill = catalog.SOURCES[0], catalog.SOURCES[2]
    assert catalog.source_target(first, 1_000_000, 250_000) == 7_500
    assert catalog.source_target(first, 10, 2) == 1 and catalog.source_target(fill, 10, 2) == 2
    assert catalog.source_skip(catalog.SOURCES[5], 1_000_000) == 50_000
    assert catalog.text_bound(fill, 10) == 60 and catalog.text_bound(first, 10) == 30
    assert catalog.tokenizer_texts(100) == 5_000 and catalog.tokenizer_texts(100_000) == 500_000


def test_catalogue_and_verification(spark):
    df = catalog.frame(spark)
    assert df.count() == 7 and df.dropDuplicates(["fmt"]).count() == 5
    assert catalog.verify({"openmath": df, "finemath": df.limit(0)}) == {s.name: s.stream == "openmath" for s in catalog.SOURCES}
    assert catalog.streams(df).count() == 6 and {r["name"] for r in catalog.streams(df).collect()}.isdisjoint({"openmath_reason"})


def test_interleave_keeps_order_in_a_source(spark):
    rows = [("a", k, f"a{k}") for k in range(40)] + [("b", k, f"b{k}") for k in range(25)]
    df = spark.createDataFrame(rows, "source string, k long, name string")
    got = O.interleave(df, 1).orderBy("slot").collect()
    assert len(got) == 65
    for s, n in (("a", 40), ("b", 25)):
        assert [r["k"] for r in got if r["source"] == s] == list(range(n))
    assert [r["source"] for r in got] != sorted(r["source"] for r in got)


def test_difficulty_counts_bos_and_padding(spark):
    df = spark.createDataFrame([([2, 5, 5, 6, 0, 0],), ([],)], "ids array<int>").select(O.difficulty(F.col("ids")).alias("d"))
    assert sorted(r["d"] for r in df.collect()) == [0.0, 0.5]


def test_reservoir_sample(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    a = {r["k"] for r in O.reservoir_sample(df, 10, 1, "k").collect()}
    assert len(a) == 10 and a == {r["k"] for r in O.reservoir_sample(df.repartition(7), 10, 1, "k").collect()}
    assert O.reservoir_sample(df, 1000, 1, "k").count() == 100


RECORDS = [(0, [1, 2, 3], 10.0), (1, [4, 0, 0], 20.0), (2, [5, 6, 7], 30.0)]


def test_repack_worked_example(spark):
    df = spark.createDataFrame(RECORDS, "ord long, input_ids array<int>, trust_score double")
    got = O.repack(df, 3)
    assert sorted((r["window"], r["tokens"], r["trust"]) for r in got.collect()) == [(0, [1, 2, 3, 4], 10.0), (1, [0, 0, 5, 6], 20.0)]
    second = O.batches(got, 2, 3).where("slot = 1").first()
    assert (second["input_ids"], second["labels"]) == ([0, 0, 5], [-100, 5, 6])


def test_repack_drops_and_truncates(spark):
    rows = [(0, [9], 1.0), (1, list(range(1, 9)), 2.0), (2, [7, 8], 3.0)]
    df = spark.createDataFrame(rows, "ord long, input_ids array<int>, trust_score double")
    assert [(r["tokens"], r["trust"]) for r in O.repack(df, 4).orderBy("window").collect()] == [([1, 2, 3, 4, 5], 2.0)]


def test_ordinals(spark):
    df = spark.range(500).select((F.col("id") * 3).alias("o"), (F.col("id") % 3).alias("g"))
    assert all(r["k"] == r["o"] // 3 for r in O.with_ordinal(df.select("o"), [], "o").collect())
    assert all(r["k"] == r["o"] // 9 for r in O.with_ordinal(df, ["g"], "o").collect())


def test_streaming_equals_batch(spark, tmp_path):
    rows = [(f"s{i % 3}", i, [100 * i + j for j in range(1 + i % 7)], float(i)) for i in range(60)]
    schema = "shard string, ord long, input_ids array<int>, trust_score double"
    df = spark.createDataFrame(rows, schema)
    for part in range(3):  # three micro-batches, in order
        df.where((F.col("ord") >= 20 * part) & (F.col("ord") < 20 * part + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with Loader(stream, 4, str(tmp_path / "loader")) as loader:
        assert loader.start() is loader
        loader.wait()
        assert loader.wait_for_fill(0.5, 5) and loader.get(1_000) is None
        got = loader.get_blocking(5, 5)
        got += loader.get(loader.written - 5)
        with pytest.raises(TimeoutError):
            loader.get_blocking(1, 0.2)
    got = sorted((r["shard"], r["window"], r["tokens"], r["trust"]) for r in got)
    batch = O.repack(df, 4, key="shard").collect()
    assert got == sorted((r["shard"], r["window"], r["tokens"], r["trust"]) for r in batch) and len(got) > 20


def test_validation(spark):
    rows = [
        (1, [2, 5, 0], [5, 3, -100], 1.0, "a"), (2, [2], [5, 3], 1.0, "a"), (3, [], [], 1.0, "a"), (4, [2, 99], [1, 2], 1.0, "a"),
        (5, [2, 5], [1, 99], 1.0, "a"), (6, [2], [2], None, "a"), (7, None, [2], 1.0, "a"),
    ]
    df = spark.createDataFrame(rows, "id int, input_ids array<int>, labels array<int>, trust_score double, source string")
    got = {r["id"]: r["problem"] for r in O.validate(df, 50).collect()}
    assert got == {1: None, 2: "lengths", 3: "empty", 4: "input id out of range", 5: "label out of range", 6: "missing", 7: "missing"}


def test_ordinals_keep_every_row(spark):
    """Equal and null orders, null keys, repeated rows: none is lost or multiplied."""
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 2, "x"), (None, 1, "x"), (None, None, "x"), ("a", None, "q"), ("a", 1, "x"), ("a", 1, "x"), ((None), 1, "x")]
    df = spark.createDataFrame(rows, "g string, o int, t string").repartition(3)
    got = O.with_ordinal(df, ["g"], "o").collect()
    assert sorted(map(repr, ((r["g"], r["o"], r["t"]) for r in got))) == sorted(map(repr, rows))
    for g in ("a", None):
        own = sorted((r["k"], r["o"] is not None, r["o"]) for r in got if r["g"] == g)
        assert [k for k, _, _ in own] == [*range(len(own))] and own == sorted(own, key=lambda x: (x[1], x[2] or 0))
    assert O.with_ordinal(df.limit(0), ["g"], "o").count() == 0


def test_sums_before_rows(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, "a", "b"]), rnd.choice([None, *range(40)]), rnd.randrange(9), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, n long, i int").repartition(5)
    got = O.starts(df, ["g"], ["o", "i"], "n").collect()
    want, at = {}, {}
    for g, o, n, i in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[3])):
        want[i] = at.get(g, 0)
        at[g] = want[i] + n
    assert {r["i"]: r["start"] for r in got} == want and len(got) == 500


def test_offsets_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(O, "BROADCAST_ROWS", 0)
    df = spark.range(300).select((F.col("id") % 7).alias("g"), F.col("id").alias("o"))
    assert all(r["k"] == r["o"] // 7 for r in O.with_ordinal(df, ["g"], "o").collect())


def test_first_rows_beyond_a_list(spark, monkeypatch):
    monkeypatch.setattr(O, "LIST_ROWS", 5)
    df = spark.range(200).select((F.col("id") * 37 % 200).alias("o"))
    assert sorted(r["o"] for r in O.take_first(df, ["o"], 50).collect()) == [*range(50)]


def test_repack_of_records_of_equal_order(spark):
    rows = [(0, [1, 2], 1.0), (0, [3, 4], 2.0), (1, [5, 6], 3.0), (None, [7, 8], 4.0), (1, [5, 6], 3.0)]
    got = O.repack(spark.createDataFrame(rows, "ord long, input_ids array<int>, trust_score double"), 1).orderBy("window").collect()
    assert len(got) == 5 and got[0]["tokens"] == [7, 8] and sorted(r["tokens"] for r in got[1:3]) == [[1, 2], [3, 4]]
    assert [r["tokens"] for r in got[3:]] == [[5, 6], [5, 6]]


def test_interleave_of_equal_orders_and_null_sources(spark):
    rows = [("a", 3, "x"), ("a", 3, "y"), ("a", 5, "z"), (None, 3, "u"), (None, None, "v")]
    got = O.interleave(spark.createDataFrame(rows, "source string, ord int, t string"), 1, "ord").collect()
    assert sorted((r["t"], r["k"]) for r in got if r["t"] in "zuv") == [("u", 1), ("v", 0), ("z", 2)] and len(got) == 5
    for s in ("a", None):
        own = sorted((r["slot"], r["k"]) for r in got if r["source"] == s)
        assert [k for _, k in own] == [*range(len(own))]


def test_series_leave_keys_as_they_are(spark):
    rows = [(1 << 60 | 1, 1, 1.0), (None, 1, 5.0), (1 << 60 | 1, 2, 2.0), (None, 2, 7.0), (3, None, 1.0)]
    got = series.gated_ema(spark.createDataFrame(rows, "k long, o long, v double").coalesce(1), "k", "o", "v", 0.5, None).collect()
    assert sorted(((r["k"] or 0), (r["o"] or 0), r["ema"]) for r in got) == [(0, 1, 5.0), (0, 2, 6.0), (3, 0, 1.0), (1 << 60 | 1, 1, 1.0), (1 << 60 | 1, 2, 1.5)]


def test_quota_without_sources(spark):
    df = spark.createDataFrame([("a", 0, [1] * 70)], "source string, ord int, input_ids array<int>")
    assert O.quota_mix(df, [], ["ord"], Scratch(spark, "t")).columns == ["source", "ord", "input_ids", "_step"]


def test_first_rows_and_the_rest_with_equal_and_null_orders(spark, monkeypatch):
    monkeypatch.setattr(O, "LIST_ROWS", 2)
    data = [(i // 3 if i % 5 else None, f"t{i % 7}") for i in range(60)] + [(4, "same")] * 6 + [(None, None)] * 4
    df = spark.createDataFrame(data, "ord int, txt string").repartition(5)
    ordered = [tuple(r) for r in df.orderBy("ord", F.xxhash64("ord", "txt")).collect()]
    key = repr
    for n in (3, 5, 17, 31, 33, 69, 70, 90):
        assert sorted(map(tuple, O.take_first(df, ["ord"], n).collect()), key=key) == sorted(ordered[:n], key=key)
        assert sorted(map(tuple, O.skip_first(df, ["ord"], n).collect()), key=key) == sorted(ordered[n:], key=key)


def test_whole_rows_are_not_numbered(spark, monkeypatch):
    seen, ordinal = [], O.with_ordinal
    monkeypatch.setattr(O, "LIST_ROWS", 2)
    monkeypatch.setattr(O, "with_ordinal", lambda df, *a: seen.append(df.columns) or ordinal(df, *a))
    df = spark.range(20).selectExpr("id", "repeat('x', 100) AS txt")
    assert O.take_first(df, ["id"], 7).count() == 7 and O.skip_first(df, ["id"], 7).count() == 13
    assert len(seen) == 2 and not any("txt" in c for c in seen)


def test_dedup_sends_only_what_is_kept(spark, monkeypatch):
    seen, first = [], O.first_by
    df = spark.createDataFrame([(i, [i % 3] * 70, "wide") for i in range(9)], "k int, input_ids array<int>, more string")
    whole = [r["k"] for r in O.dedup_prefix(df, ["k"]).collect()]
    monkeypatch.setattr(O, "first_by", lambda rows, *a: seen.append(rows.columns) or first(rows, *a))
    got = O.dedup_prefix(df, ["k"], F.size("input_ids").alias("n")).collect()
    assert sorted(map(tuple, got)) == [(k, 70) for k in sorted(whole)] and seen == [["k", "n", "_p"]]


def test_rows_beyond_a_full_quota_do_not_travel(spark):
    rows = spark.createDataFrame([(i if i else None, "s") for i in range(10)], "k int, source string")
    chosen = O.take_first(rows, ["k"], 4)
    assert sorted(r["k"] or 0 for r in rows.where(O.reaches(chosen, "k")).collect()) == [0, 1, 2, 3]
    assert rows.where(O.reaches(O.take_first(rows, ["k"], 1), "k")).count() == 1


def test_orders_may_be_structs(spark, monkeypatch):
    monkeypatch.setattr(O, "LIST_ROWS", 2)
    df = spark.range(20).selectExpr("id", "struct(concat('f', id div 8) AS file, id div 4 AS block, cast(id AS int) AS line) AS ord")
    first = O.take_first(df, ["ord"], 9)
    assert sorted(r["id"] for r in first.collect()) == [*range(9)]
    assert sorted(r["id"] for r in O.skip_first(df, ["ord"], 9).collect()) == [*range(9, 20)]
    assert df.where(O.reaches(first, "ord")).count() == 9


def test_first_of_each_key_numbers_orders_only(spark, monkeypatch):
    rows = [("a", i // 2 if i else None, f"t{i % 3}") for i in range(12)] + [("b", 1, "same")] * 5 + [("c", 1, "x"), (None, 1, "y"), ("d", 1, "z")]
    df = spark.createDataFrame(rows, "grp string, ord long, text string").repartition(4)
    seen, starts = [], O.starts
    monkeypatch.setattr(O, "starts", lambda d, *args: seen.append(d.columns) or starts(d, *args))
    got = sorted(map(tuple, O.first_of_each(df, "grp", ["ord"], {"a": 6, "b": 3, "c": 9, "d": 0}).collect()), key=repr)
    assert seen == [["_key", "_o0", "_h"]]  # no text travels
    want = O.with_ordinal(df, ["grp"], "ord").where("grp = 'a' and k < 6 or grp = 'b' and k < 3 or grp = 'c'").drop("k").collect()
    assert len(got) == 10 and got == sorted(map(tuple, want), key=repr)
    assert O.first_of_each(df.limit(0), "grp", ["ord"], {"a": 1}).collect() == []


def test_texts_are_encoded_and_cut_in_one_pass(spark):
    texts = ["", "abc", "defgh" * 9, "i", "", "jk" * 3, "lmnopqrst", "u"]
    starts = [0, *itertools.accumulate(map(len, texts))]
    rows = [("x" if i % 2 else None, t, float(i), starts[i]) for i, t in enumerate(texts)]
    placed = spark.createDataFrame(rows, "key string, txt string, trust_score double, start long").repartition(3)
    vocab = K.char_vocab(placed.select(F.col("txt").alias("text")))
    number = {r["ch"]: r["id"] for r in vocab.collect()}
    whole = "".join(texts)
    owner = [i for i, t in enumerate(texts) for _ in t]
    assert number == {c: 4 + i for i, c in enumerate(sorted(set(whole)))}
    encode = partial(K.encode_texts, vocab=vocab)
    want = [(w, [number[c] for c in whole[5 * w : 5 * w + 5]], float(owner[5 * w])) for w in range(len(whole) // 5)]
    for made in (O.cut_stream(placed, 4, [], encode), O.cut_stream(encode(placed), 4, [])):
        assert sorted((r["window"], r["tokens"], r["trust"]) for r in made.collect()) == want
    keyed = [sorted(map(tuple, x.collect()), key=repr) for x in (O.cut_stream(placed, 4, ["key"], encode), O.cut_stream(encode(placed), 4, ["key"]))]
    assert keyed[0] == keyed[1] and {r[0] for r in keyed[0]} == {None, "x"}


def test_window_digest_is_that_of_joined_ids(spark, monkeypatch):
    ids = [[1, -100, 7], [0], [], [2_000_000_000, 1, 1], []]
    df = spark.createDataFrame([(x,) for x in ids], "ids array<int>").coalesce(1)
    want = [r[0] for r in df.select(Q.joined_ids(F.col("ids"))).collect()]
    assert [r[0] for r in df.select(Q.window_digest("ids")).collect()] == want
    monkeypatch.setattr(Q, "WINDOWS", 2)
    assert Q.window_digest.func(pa.array(ids, pa.list_(pa.int32()))).to_pylist() == want
