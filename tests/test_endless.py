"""Endless batches against the finite replay, repacked; stops, restarts and odd records."""

import random

import pytest

from pyspark.sql import functions as F

from quern.operators import windows as O
from quern.sources import jsonl
from quern.streaming.endless import Endless, lay, to_folder

LENGTH, BATCH = 4, 3
RECORDS = "ord long, input_ids array<int>, trust_score double, source string"


def records(n=40, seed=1):
    rnd = random.Random(seed)
    odd = [None, [], [7]]
    return [(i // 2, rnd.choice([*odd, *([[100 * i + j for j in range(rnd.randrange(2, 9))]] * 5)]), rnd.choice([None, float(i)]), "s") for i in range(n)]


def rows(df):
    return sorted((r["batch_id"], r["slot"], tuple(r["input_ids"]), tuple(r["labels"]), r["trust"]) for r in df.collect())


def replayed(df, epochs, seed):
    """What the batch operators make of so many epochs, whole batches only."""
    kept = df.where("size(input_ids) >= 2")
    stream = jsonl.replay(kept, "ord", epochs, seed).select("at", "input_ids", "trust_score")
    found = rows(O.batches(O.repack(stream, LENGTH, order="at"), BATCH, LENGTH))
    full = len(found) // BATCH
    return [r for r in found if r[0] < full], full


@pytest.mark.parametrize("seed", [None, 5])
def test_three_epochs_are_those_of_the_replay(spark, tmp_path, seed):
    df = spark.createDataFrame(records(), RECORDS).drop("source").distinct().withColumn("ord", F.expr("ord * 100 + coalesce(input_ids[0], 0)"))
    lay(df, "ord", LENGTH, str(tmp_path / "corpus"), part_tokens=50)  # several parts
    endless = Endless(spark, str(tmp_path / "corpus"), BATCH, seed)
    want, full = replayed(df, 3, seed)
    assert full > 15 and rows(endless.batches(0, full)) == want
    assert [r for at in range(full) for r in rows(endless.batches(at, at + 1))] == want


def test_a_batch_reads_the_parts_that_it_touches(spark, tmp_path):
    df = spark.range(400).selectExpr("id AS ord", "array(int(id), int(id) + 1, 5) AS input_ids", "double(id) AS trust_score")
    lay(df, "ord", LENGTH, str(tmp_path / "corpus"), part_tokens=100)
    plan = Endless(spark, str(tmp_path / "corpus"), BATCH).batches(20, 21)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan
    assert "GreaterThan(start," in plan and "LessThan(start," in plan


def test_a_corpus_shorter_than_a_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], None, "s"), (2, None, 1.0, "s"), (3, [3, 4, 5], 2.0, "s")], RECORDS)
    lay(df, "ord", LENGTH, str(tmp_path / "corpus"))
    found = rows(Endless(spark, str(tmp_path / "corpus"), 40).batches(2, 3))  # forty windows of five tokens: one each epoch
    assert found == [(2, i, (1, 2, 3, 4), (2, 3, 4, 5), None) for i in range(40)]


def test_a_query_goes_on_after_a_stop_and_repeats_what_was_not_consumed(spark, tmp_path):
    df = spark.createDataFrame(records(60, 3), RECORDS)
    lay(df, ["ord", "input_ids"], LENGTH, str(tmp_path / "corpus"), part_tokens=64)
    out, checkpoint, fail = str(tmp_path / "out"), str(tmp_path / "checkpoint"), [False]

    def consume(found, micro_batch):
        to_folder(out)(found, micro_batch)
        if fail[0]:
            raise RuntimeError("the consumer is gone")

    for run in range(5):
        fail[0] = run == 2  # written, not committed: given again by the next run
        query = Endless(spark, str(tmp_path / "corpus"), BATCH, 9).start(consume, checkpoint, per_trigger=4, once=True)
        if fail[0]:
            with pytest.raises(Exception, match="consumer is gone"):
                query.awaitTermination()
        else:
            query.awaitTermination(120)
    found = rows(spark.read.parquet(out))
    ids = sorted({r[0] for r in found})
    assert len(found) == len(ids) * BATCH and ids == [*range(len(ids))] and len(ids) >= 16
    assert found == rows(Endless(spark, str(tmp_path / "corpus"), BATCH, 9).batches(0, len(ids)))


def test_without_records_or_description(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="complete"):
        Endless(spark, str(tmp_path / "none"), BATCH)
    lay(spark.createDataFrame([(1, [1], 1.0, "s")], RECORDS), "ord", LENGTH, str(tmp_path / "corpus"))
    with pytest.raises(ValueError, match="no record"):
        Endless(spark, str(tmp_path / "corpus"), BATCH)


def test_texts_are_laid_as_they_are_and_encoded_when_read(spark, tmp_path):
    texts = ["", "a", "ab", "abcdefghij" * 3, "xyz", None, "k" * 57, "no"]
    df = spark.createDataFrame([*enumerate(texts)], "ord long, txt string").withColumn("trust_score", F.col("ord").cast("double")).withColumn("n", F.length("txt"))
    ids = F.transform(F.split("txt", ""), lambda c: F.ascii(c)).alias("ids")
    lay(df, "ord", LENGTH, str(tmp_path / "corpus"), part_tokens=32)
    assert "ids" not in spark.read.parquet(str(tmp_path / "corpus" / "records")).columns
    endless = Endless(spark, str(tmp_path / "corpus"), BATCH, encode=lambda rows: rows.select("trust", "n", "start", ids))
    flat = [(ord(c), float(i)) for i, t in enumerate(texts) if t and len(t) >= 2 for c in t] * 3
    width, full = LENGTH + 1, len(flat) // ((LENGTH + 1) * BATCH)
    want = []
    for w in range(full * BATCH):
        t = [x for x, _ in flat[w * width : (w + 1) * width]]
        want.append((w // BATCH, w % BATCH, tuple(t[:-1]), tuple(t[1:]), flat[w * width][1]))
    assert rows(endless.batches(0, full)) == want and full > 10
    assert [r for at in range(full) for r in rows(endless.batches(at, at + 1))] == want
    with pytest.raises(ValueError, match="encode"):
        Endless(spark, str(tmp_path / "corpus"), BATCH)


def test_laying_shuffles_records_once(spark, tmp_path, monkeypatch):
    seen, repartition = [], type(spark.range(1)).repartitionByRange
    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", lambda self, *a: seen.append(a) or repartition(self, *a))
    lay(spark.createDataFrame(records(), RECORDS), "ord", LENGTH, str(tmp_path / "corpus"))
    assert len(seen) == 1
