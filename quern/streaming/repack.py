"""Repacking a stream of token records into windows, with the left-over tokens as state."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.storage import Files

OUTPUT = "shard string, window long, tokens array<int>, trust double"
STATE = "tokens array<int>, trusts array<double>, sizes array<int>, window long"


def _repack(length: int) -> Callable:
    width = length + 1

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, trusts, sizes, window = state.get if state.exists else ([], [], [], 0)
        tokens, trusts, sizes = list(tokens), list(trusts), list(sizes)
        rows = pd.concat([*frames]).sort_values("ord")
        for ids, trust in zip(rows["input_ids"], rows["trust_score"], strict=True):
            cut = [] if ids is None else [int(x) for x in ids[:width]]
            if len(cut) >= 2:
                tokens += cut
                trusts.append(None if pd.isna(trust) else float(trust))
                sizes.append(len(cut))
        out, at = [], 0
        record, within = 0, 0  # of the token at ``at``
        while len(tokens) - at >= width:
            out.append((key[0], window, tokens[at : at + width], trusts[record]))
            window, at, within = window + 1, at + width, within + width
            while record < len(sizes) and within >= sizes[record]:
                within -= sizes[record]
                record += 1
        left = sizes[record:]
        if left:
            left[0] -= within
        state.update((tokens[at:], trusts[record:], left, window))
        yield pd.DataFrame(out, columns=["shard", "window", "tokens", "trust"])

    return run


def repack_stream(records: DataFrame, length: int) -> DataFrame:
    """Windows of ``length`` + 1 tokens of each shard's records, in order within a micro-batch.

    ``records`` is a stream of shard, ord, input_ids and trust_score. A shard is one
    logical sequence, so it is handled by one task: use many shards. As in the batch
    operator, records with null ids or fewer than two are left out, and a null trust
    stays null.
    """
    return records.select(F.col("shard").cast("string").alias("shard"), "ord", "input_ids", "trust_score").groupBy("shard").applyInPandasWithState(
        _repack(length), OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout
    )


class Ledger:
    """How many rows of each micro-batch have been delivered: marker files that are created, never changed."""

    def __init__(self, spark, folder: str):
        self.files = Files(spark, folder)

    def delivered(self, batch: int) -> int:
        return max((int(n) for n in self.files.names(f"{batch}") if n.isdigit()), default=0)

    def commit(self, batch: int, rows: int) -> None:
        self.files.write(f"{batch}/{rows}", "")


def to_callback(stream: DataFrame, callback: Callable[..., None], path: str, most: int = 1_000):
    """Start a query that hands each micro-batch's rows to ``callback`` (metric rows, not data), ``most`` at a time.

    Rows of a micro-batch go in order of their values, and a ledger beside the query's
    checkpoint tells how many have been handed over: a micro-batch that is repeated after
    a restart goes on behind them, so nothing that the ledger has is delivered twice. Each
    call is ``callback(rows, token)``; the token (micro-batch, first row) names the slice, so that
    an effect that stores it too is also safe from a crash between it and the ledger.
    """
    ledger = Ledger(stream.sparkSession, f"{path.rstrip('/')}/delivered")
    return stream.writeStream.foreachBatch(deliver(callback, ledger, most)).option("checkpointLocation", f"{path.rstrip('/')}/checkpoint").start()


def deliver(callback: Callable[..., None], ledger: Ledger, most: int) -> Callable[[DataFrame, int], None]:
    def push(df: DataFrame, batch: int) -> None:
        done = ledger.delivered(batch)
        rows: list = []

        def hand_over() -> None:
            nonlocal done, rows
            callback(rows, (batch, done))
            done += len(rows)
            rows = []
            ledger.commit(batch, done)

        for at, row in enumerate(df.orderBy(*df.columns).toLocalIterator()):  # a partition at a time
            if at < done + len(rows):
                continue
            rows.append(row)
            if len(rows) == most:
                hand_over()
        if rows:
            hand_over()

    return push


class Loader:
    """Feeds a consumer with windows of a repacked stream; starts and stops once, whatever the number of calls.

    Windows go to Parquet below ``folder``, in order of arrival, and are read from there,
    so neither driver nor query holds what is not yet consumed. How many have been read
    is noted there too: a loader on a folder that another one has left, by a stop or a
    crash, finds what was written but not read, and its query goes on from the
    checkpoint. The source's own limit, such as ``maxFilesPerTrigger``, bounds a
    micro-batch; with ``most`` the query also waits while more windows than that are
    written but not read (back-pressure).
    """

    def __init__(self, records: DataFrame, length: int, folder: str, most: int | None = None):
        self.stream, self.folder, self.most, self.query = repack_stream(records, length), folder.rstrip("/"), most, None
        self.spark = records.sparkSession
        self.running = False
        self.waiting: list = []
        self.files = Files(self.spark, self.folder)
        self.read_ = max((int(n) for n in self.files.names("read") if n.isdigit()), default=0)
        # A micro-batch counts once it is written whole; a part of one is written again.
        self.batches = sorted(int(n.rpartition("=")[2]) for n in self.files.names("windows") if "_SUCCESS" in self.files.names(f"windows/{n}"))
        counts = [self._rows(b).count() for b in self.batches]
        self.written, skip = sum(counts), self.read_
        while self.batches and skip >= counts[0]:
            skip -= counts.pop(0)
            self.batches.pop(0)
        if skip:
            self.waiting = self._rows(self.batches.pop(0)).orderBy("shard", "window").collect()[skip:]  # one micro-batch

    def _rows(self, batch: int) -> DataFrame:
        return self.spark.read.schema(OUTPUT).parquet(f"{self.folder}/windows/batch={batch}")

    def _store(self, df: DataFrame, batch: int) -> None:
        known = "_SUCCESS" in self.files.names(f"windows/batch={batch}")
        if not known:  # a repeated micro-batch is there already, and may have been read
            df.write.mode("overwrite").parquet(f"{self.folder}/windows/batch={batch}")
            self.batches.append(batch)
            self.written += self._rows(batch).count()
        while self.most is not None and self.running and self.written - self.read_ >= self.most:
            time.sleep(0.01)

    def start(self) -> Loader:
        if self.query is None:
            self.running = True
            writer = self.stream.writeStream.foreachBatch(self._store).outputMode("append")
            self.query = writer.option("checkpointLocation", f"{self.folder}/checkpoint").start()
        return self

    def fill(self) -> float:
        """Windows that are written but not read, as a share of ``most`` (or of one)."""
        return (self.written - self.read_) / (self.most or 1)

    def wait_for_fill(self, share: float, seconds: float = 60.0) -> bool:
        """Whether ``fill`` reaches ``share`` in time."""
        end = time.monotonic() + seconds
        while time.monotonic() < end:
            if self.fill() >= share:
                return True
            time.sleep(0.05)
        return False

    def get(self, count: int) -> list | None:
        """The next ``count`` windows, or None if there are fewer; none is lost then."""
        while len(self.waiting) < count and self.batches:
            self.waiting += self._rows(self.batches.pop(0)).orderBy("shard", "window").collect()  # one micro-batch
        if len(self.waiting) < count:
            return None
        found, self.waiting = self.waiting[:count], self.waiting[count:]
        before, self.read_ = self.read_, self.read_ + count
        self.files.write(f"read/{self.read_}", "")
        self.files.delete(f"read/{before}")
        return found

    def get_blocking(self, count: int, seconds: float = 60.0) -> list:
        """``get``, waiting for windows; an error if they do not come in time, or if the query has failed."""
        end = time.monotonic() + seconds
        while True:
            found = self.get(count)
            if found is not None:
                return found
            if self.query is not None and self.query.exception() is not None:
                raise RuntimeError(f"the stream has failed: {self.query.exception()}")
            if time.monotonic() >= end:
                raise TimeoutError(f"no {count} windows within {seconds} s: look at the source and the query")
            time.sleep(0.05)

    def wait(self) -> None:
        self.query.processAllAvailable()

    def stop(self) -> None:
        self.running = False
        if self.query is not None:
            query, self.query = self.query, None
            query.stop()

    def __enter__(self) -> Loader:
        return self.start()

    def __exit__(self, *_) -> None:
        self.stop()
