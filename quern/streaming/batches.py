"""Whole training batches of a stream of token records, with left-over pieces and windows as list state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quern.operators import windows as W
from quern.streaming.repack import OUTPUT

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PIECE = "tokens array<int>, trust double"


class _Batches(StatefulProcessor):
    """Pieces of records that fill no window yet, windows that fill no batch yet, and how many there are.

    Both lists are only appended to until something is complete: a micro-batch that fills no window reads
    neither, one that fills no batch does not read the waiting windows.
    """

    def __init__(self, width: int, batch: int):
        self.width, self.batch = width, batch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pieces = handle.getListState("pieces", PIECE)
        self.windows = handle.getListState("windows", PIECE)
        self.counts = handle.getValueState("counts", "held long, cut long")

    def _whole(self, state, fresh: list, complete: bool) -> list | None:
        """What waits and what is new, taken out of the state; None, and new ones are added, if nothing is complete."""
        if not complete:
            if fresh:
                state.appendList(fresh)
            return None
        told = [(list(tokens), trust) for tokens, trust in state.get()] if state.exists() else []
        state.clear()
        return told + fresh

    def _cut(self, pieces: list) -> tuple[list, list]:
        """Whole windows with the trust of their first token, and the pieces that are left."""
        out, open_, trust, have = [], [], None, 0
        for at, (tokens, own) in enumerate(pieces):
            begin = 0
            while begin < len(tokens):
                if not have:
                    trust = own
                part = tokens[begin : begin + self.width - have]
                open_.append((part, own))
                have, begin = have + len(part), begin + len(part)
                if have == self.width:
                    out.append(([t for p, _ in open_ for t in p], trust))
                    open_, have = [], 0
        return out, open_

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held, cut = self.counts.get() if self.counts.exists() else (0, 0)
        ordered = sorted(rows, key=lambda r: (r["ord"] is not None, r["ord"]))
        fresh = [(list(r["input_ids"][: self.width]), r["trust_score"]) for r in ordered if r["input_ids"] is not None and len(r["input_ids"]) >= 2]
        held += sum(len(tokens) for tokens, _ in fresh)
        made: list = []
        pieces = self._whole(self.pieces, fresh, held >= self.width)
        if pieces is not None:
            made, left = self._cut(pieces)
            if left:
                self.pieces.put(left)
            held %= self.width
        waiting = cut % self.batch
        whole = self._whole(self.windows, made, waiting + len(made) >= self.batch)
        first, cut = cut - waiting, cut + len(made)
        self.counts.update((held, cut))
        if whole is not None:
            n = len(whole) - len(whole) % self.batch
            if whole[n:]:
                self.windows.put(whole[n:])
            for i, (tokens, trust) in enumerate(whole[:n]):
                yield Row(shard=key[0], window=first + i, tokens=tokens, trust=trust)

    def close(self) -> None:
        pass


def batch_stream(records: DataFrame, length: int, batch: int) -> DataFrame:
    """shard, batch_id, slot, input_ids, labels, trust: a stream that gives whole batches of ``batch`` windows.

    ``records`` is a stream of shard, ord, input_ids and trust_score, as ``repack_stream`` takes it. Every
    shard is one logical sequence with batches of its own. Windows that fill no batch wait as state, so at
    the end of a finite stream the last ones stay behind, as the rest of the tokens does. Records with null
    ids or fewer than two are left out, a null trust or shard stays null, null orders come first in their
    micro-batch. The session needs the RocksDB state store, which keeps lists entry by entry.
    """
    if not records.sparkSession.conf.get(PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"set {PROVIDER} to the RocksDB provider")
    rows = records.select(F.col("shard").cast("string").alias("shard"), "ord", "input_ids", "trust_score")
    made = rows.groupBy("shard").transformWithState(_Batches(length + 1, batch), OUTPUT, "append", "none")
    return W.batches(made, batch, length, "shard")
