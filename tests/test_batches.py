"""Batches of a stream against the batch operator, whatever the micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import windows as W
from quern.streaming.batches import PROVIDER, batch_stream

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RECORD = "shard string, ord long, input_ids array<int>, trust_score double"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    yield spark
    spark.conf.set(PROVIDER, before)


def rows_of(seed):
    rng, rows = random.Random(seed), []
    for i in range(240):
        ids = None if i % 13 == 5 else [rng.choice([0, 5, 6, 7]) for _ in range(rng.choice([0, 1, 2, 3, 9, 40]))]
        rows.append((rng.choice(["a", "a", "b", None]), i, ids, None if i % 7 == 3 else float(i)))
    return rows


def ran(stream, folder, name):
    query = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start()
    query.awaitTermination()


def plain(df):
    return sorted((repr((r["shard"], r["batch_id"], r["slot"], list(r["input_ids"]), list(r["labels"]), r["trust"])) for r in df.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_batch_operator_and_goes_on_after_a_stop(rocks, tmp_path, seed):
    rows, cuts = rows_of(seed), sorted(random.Random(seed).sample(range(1, 240), 5))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, 240], strict=True)]
    source = rocks.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for half in (range(3), range(3, 6)):  # the second query goes on from the checkpoint of the first
        for i in half:
            rocks.createDataFrame(parts[i], RECORD).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        ran(batch_stream(source, 6, 4), tmp_path, "out")
    told = rocks.read.parquet(f"{tmp_path}/out")
    whole = W.batches(W.repack(rocks.createDataFrame(rows, RECORD), 6, key="shard"), 4, 6, "shard")
    full = whole.groupBy("shard", "batch_id").count().where("count = 4").withColumnRenamed("shard", "s").withColumnRenamed("batch_id", "i")
    want = whole.join(full, F.col("s").eqNullSafe(F.col("shard")) & (F.col("i") == F.col("batch_id")), "left_semi")
    assert plain(told) == plain(want) and told.count() > 40 and told.count() < whole.count()


def test_asks_for_a_store_that_keeps_lists(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        batch_stream(spark.createDataFrame([], RECORD), 6, 4)
