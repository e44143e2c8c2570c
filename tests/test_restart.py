"""What a stop or a crash leaves behind: checkpoints, loaders, delivered rows; nulls in streams as in batches."""

import random

import pytest

from quern.operators import windows as O
from quern.sources import checkpoints
from quern.streaming.repack import Ledger, Loader, deliver, to_callback

RECORDS = "shard string, ord long, input_ids array<int>, trust_score double"


def records(n=60, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        ids = rnd.choice([None, [], [7], [100 * i + j for j in range(rnd.randrange(2, 8))]])
        rows.append((f"s{i % 3}", i, ids, rnd.choice([None, float(i)])))
    return rows


def in_files(spark, rows, path, files=4):
    df = spark.createDataFrame(rows, RECORDS)
    step = -(-len(rows) // files)
    for at in range(0, len(rows), step):
        df.where(f"ord >= {at} and ord < {at + step}").coalesce(1).write.mode("append").parquet(path)
    return df, spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", 1).parquet(path)


def as_rows(found):
    return sorted(((r["shard"], r["window"], r["tokens"], r["trust"]) for r in found), key=repr)


def test_nulls_in_a_stream_are_those_of_the_batch(spark, tmp_path):
    df, stream = in_files(spark, records(), str(tmp_path / "in"))
    with Loader(stream, 4, str(tmp_path / "loader")) as loader:
        loader.wait()
        got = as_rows(loader.get(loader.written))
    assert got == as_rows(O.repack(df, 4, key="shard").collect()) and len(got) > 10 and None in [r[3] for r in got]


def test_another_loader_goes_on_where_one_has_stopped(spark, tmp_path):
    rows = records(80, 2)
    df, stream = in_files(spark, rows[:50], str(tmp_path / "in"))
    first = Loader(stream, 4, str(tmp_path / "loader")).start()
    first.wait()
    got = first.get(4)
    first.stop()  # windows are written but not read
    assert first.written > 4
    again = Loader(stream, 4, str(tmp_path / "loader"))
    assert (again.written, again.read_) == (first.written, 4)
    spark.createDataFrame(rows[50:], RECORDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with again:
        again.wait()
        got += again.get(again.written - 4)
        assert again.get(1) is None
    want = O.repack(spark.createDataFrame(rows, RECORDS), 4, key="shard").collect()
    assert as_rows(got) == as_rows(want)


def test_back_pressure_holds_the_first_batch_too(spark, tmp_path):
    _, stream = in_files(spark, records(80, 3), str(tmp_path / "in"))
    with Loader(stream, 4, str(tmp_path / "loader"), most=1) as loader:
        assert loader.wait_for_fill(1.0, 60)
        before = loader.written
        assert loader.get_blocking(1, 5) and loader.written == before  # the second batch waits
    assert loader.written - loader.read_ >= 1


def test_a_step_that_was_cut_short_is_not_taken(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    state = spark.createDataFrame([("w", [1.0]), ("b", [2.0])], "name string, value array<double>")
    more = {"model": state, "optimiser": state}
    good = checkpoints.save(more, root, 100)
    calls = []

    def dies(df):
        calls.append(df)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return checkpoints_told(df)

    checkpoints_told = checkpoints.told
    monkeypatch.setattr(checkpoints, "told", dies)
    with pytest.raises(KeyboardInterrupt):
        checkpoints.save(more, root, 200)  # both tables are there, but not the manifest
    monkeypatch.setattr(checkpoints, "told", checkpoints_told)
    assert checkpoints.steps(spark, root) == [100] and checkpoints.latest(spark, root) == good
    with pytest.raises(FileNotFoundError, match="complete"):
        checkpoints.load(spark, f"{root}/step_00000200", {"model": state})
    assert checkpoints.load(spark, good, more, verify=True)[1] == 100
    checkpoints.save(more, root, 200)
    assert checkpoints.steps(spark, root) == [100, 200]
    state.limit(1).write.mode("overwrite").parquet(f"{good}/model")
    with pytest.raises(ValueError, match="not what was saved"):
        checkpoints.load(spark, good, more, verify=True)
    assert checkpoints.latest(spark, str(tmp_path / "none")) is None


def test_a_repeated_micro_batch_is_delivered_once(spark, tmp_path):
    got, tokens, fail = [], [], [True]

    def effect(rows, token):
        if len(got) == 4 and fail:
            fail.clear()
            raise RuntimeError("the consumer is gone")
        got.extend(r["id"] for r in rows)
        tokens.append(token)

    ledger = Ledger(spark, str(tmp_path / "ledger"))
    rows = spark.range(9).repartition(3)
    with pytest.raises(RuntimeError):
        deliver(effect, ledger, 2)(rows, 5)
    assert got == [0, 1, 2, 3] and ledger.delivered(5) == 4
    again = Ledger(spark, str(tmp_path / "ledger"))  # after a restart
    deliver(effect, again, 2)(rows, 5)
    deliver(effect, again, 2)(rows, 5)
    assert got == [*range(9)] and tokens == [(5, 0), (5, 2), (5, 4), (5, 6), (5, 8)]


def test_callback_query(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second query has nothing new
        query = to_callback(stream, lambda rows, token: got.extend(r["id"] for r in rows), str(tmp_path / "q"), 3)
        query.processAllAvailable()
        query.stop()
    assert got == [*range(10)]
