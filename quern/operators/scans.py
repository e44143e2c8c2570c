"""Recurrences and moving frames over series that may be longer than a task can hold.

Rows are range-partitioned by key and order, so a key is cut over as many tasks as its
rows ask for. A cut of a key, its rows in one partition, is a segment. Affine
recurrences compose: a segment is one pair (a, b), and pairs of segments give the state
that each begins with. Gated averages do not compose: segments begin with a guess, and
those whose guess was wrong are run again until every segment begins where the one
before it ends. Frames over the last rows get those rows from the block before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quern.operators.windows import BROADCAST_ROWS, with_ordinal
from quern.storage import Scratch

#: Rows of a key that a frame sees in one task, besides those from the block before.
BLOCK = 65_536


def split(rows: DataFrame, by: list[str], splits: int | None = None) -> DataFrame:
    """``rows`` range-partitioned and sorted ``by`` (key first), plus _part and _n, the place in it."""
    width = [splits] if splits else []
    dealt = rows.repartitionByRange(*width, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return dealt.select(*rows.columns, F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_n"))


def _at_segments(rows: DataFrame, told: DataFrame, key: str) -> DataFrame:
    """``rows`` with what is ``told`` of each segment (_key, _q, ...): at most as many as keys and partitions together."""
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_q"))
    return rows.join(F.broadcast(told) if told.count() <= BROADCAST_ROWS else told, same).drop("_key", "_q")


def _same_as_before(keys: pa.Array, last: object, first: bool) -> np.ndarray:
    """Whether each row has the key of the row before; ``last`` is the key before the batch."""
    codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
    same = np.concatenate([[False], codes[1:] == codes[:-1]])
    if not first and len(keys):
        same[0] = keys[0].as_py() == last
    return same


def composed(a: np.ndarray, b: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the map x -> a x + b of all rows of its run so far; a run goes on where ``same``.

    Doubling steps: each joins a row's map with that of as many rows before it as it
    covers itself. ``a`` and ``b`` have a row for each row and a column for each component.
    """
    run = np.cumsum(~same)
    longest = int(np.bincount(run).max()) if len(run) else 0
    step = 1
    while step < longest:
        joined = (run[step:] == run[:-step])[:, None]
        more = np.where(joined, a[step:] * b[:-step] + b[step:], b[step:])
        a[step:] = np.where(joined, a[step:] * a[:-step], a[step:])
        b[step:] = more
        step *= 2
    return a, b


def _matrix(column: pa.Array) -> np.ndarray:
    """Numbers as one column, lists of equal length as rows."""
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array([*values], kind) if pa.types.is_list(kind) else pa.array(values[:, 0])


def _compose(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """_a and _b replaced by those of each key's rows so far, in a sorted partition."""
    last, carry = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        same = _same_as_before(batch.column(key), last, carry is None)
        at = {c: batch.schema.get_field_index(c) for c in ("_a", "_b")}
        a, b = composed(_matrix(batch.column("_a")), _matrix(batch.column("_b")), np.concatenate([[False], same[1:]]))
        if same[0]:
            first = slice(0, int(np.argmin(np.concatenate([same, [False]]))))
            b[first] += a[first] * carry[1]
            a[first] *= carry[0]
        last, carry = batch.column(key)[-1].as_py(), (a[-1].copy(), b[-1].copy())
        for name, values in (("_a", a), ("_b", b)):
            batch = batch.set_column(at[name], name, _column(values, batch.column(name).type))
        yield batch


def affine_scan(df: DataFrame, key: str, order: list[str], decay: Column, drive: Column, start: Column | None = None, name: str = "h", splits: int | None = None) -> DataFrame:
    """``df`` plus ``name``: h = decay * h + drive over each key's rows in order, from ``start`` of its first row (0).

    Decay and drive are numbers or arrays of the same length, and so are ``start`` and h.
    Rows are compared by ``order`` (nulls first). Null keys are a series; repeated rows
    take a step each; null and NaN numbers make h what arithmetic makes of them; an empty
    table gives an empty result. No Python step is taken for a row: maps of whole batches
    are composed in doubling steps. Equal to the step-by-step recurrence but for rounding.
    """
    scratch = Scratch(df.sparkSession, "scan")
    rows = df.select("*", decay.alias("_a"), drive.alias("_b"), *([start.alias("_start")] if start is not None else []))
    vectors = isinstance(rows.schema["_b"].dataType, ArrayType)
    kind = ArrayType(DoubleType()) if vectors else DoubleType()
    rows = rows.withColumns({c: F.col(c).cast(kind) for c in ("_a", "_b", "_start") if c in rows.columns})
    dealt = split(rows, [key, *order], splits)
    local = scratch.save(dealt.mapInArrow(lambda it: _compose(it, key), dealt.schema), "local")

    ends = local.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_q")).agg(
        F.max_by(F.struct("_a", "_b"), "_n").alias("e"), *([F.min_by("_start", "_n").alias("_start")] if start is not None else [])
    )
    ends = ends.select("_key", "_q", "e.*", *(["_start"] if start is not None else []))
    ends = ends.repartition("_key").sortWithinPartitions("_key", "_q")
    so_far = ends.mapInArrow(lambda it: _compose(it, "_key"), ends.schema)
    parts = W.partitionBy("_key").orderBy("_q")  # of a key, as many as partitions at most
    before = so_far.select(
        "_key", "_q", F.lag("_a").over(parts).alias("_a0"), F.lag("_b").over(parts).alias("_b0"), *([F.first("_start").over(parts).alias("_s0")] if start is not None else [])
    )
    found = _at_segments(local, scratch.save(before, "before"), key)

    def applied(a: Column, b: Column, x: Column) -> Column:
        return F.zip_with(F.zip_with(a, x, lambda p, q: p * q), b, lambda p, q: p + q) if vectors else a * x + b

    first = F.col("_s0") if start is not None else (F.transform("_b", lambda x: F.lit(0.0)) if vectors else F.lit(0.0))
    begin = F.when(F.col("_a0").isNull(), first).otherwise(applied(F.col("_a0"), F.col("_b0"), first))
    found = found.withColumn("_begin", begin)
    return found.select(*df.columns, applied(F.col("_a"), F.col("_b"), F.col("_begin")).alias(name))


#: Fixed value: inverse products within a chunk are taken of no more than this exponent.
MOST_EXPONENT = 30.0


def _chunk_maps(batches: Iterator[pa.RecordBatch], ids: list[str]) -> Iterator[pa.RecordBatch]:
    """_a and _b (log decays and drives) replaced by the products and fillings of each chunk so far; holds one chunk."""

    def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        rows = rows.combine_chunks()
        logs, drive = (_matrix(rows[c].combine_chunks()) for c in ("_a", "_b"))
        ends = _chunk_ends(rows, ids)
        products, filled = np.empty_like(logs), np.empty_like(drive)
        for x, y in zip([0, *ends[:-1]], ends, strict=True):
            log_p = logs[x:y].cumsum(axis=0)
            products[x:y] = np.exp(log_p)
            filled[x:y] = products[x:y] * (drive[x:y] * np.exp(np.minimum(-log_p, MOST_EXPONENT))).cumsum(axis=0)
        for name, values in (("_a", products), ("_b", filled)):
            rows = rows.set_column(rows.schema.get_field_index(name), name, _column(values, rows.schema.field(name).type))
        yield from rows.to_batches()

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        ends = _chunk_ends(rows, ids)
        last = ends[-2] if len(ends) > 1 else 0
        yield from done(rows.slice(0, last))
        held = rows.slice(last)
    if held is not None:
        yield from done(held)


def _chunk_ends(rows: pa.Table, ids: list[str]) -> list[int]:
    """Where runs of equal ``ids`` end."""
    if not rows.num_rows:
        return []
    changes = np.zeros(rows.num_rows - 1, bool)
    for c in ids:
        codes = rows[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        changes |= codes[1:] != codes[:-1]
    return [*(np.flatnonzero(changes) + 1).tolist(), rows.num_rows]


def _capped(h: np.ndarray) -> np.ndarray:
    return h / np.maximum(np.sqrt((h * h).sum(axis=-1, keepdims=True)), 1.0)


def _chunk_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_key, _chunk, _begin: the state before each chunk, from the chunks' maps in order; holds one state."""
    last, state = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        same = _same_as_before(batch.column("_key"), last, state is None)
        a, b, out = _matrix(batch.column("_a")), _matrix(batch.column("_b")), []
        for i in range(batch.num_rows):
            state = state if same[i] else np.zeros(a.shape[1])
            out.append(state)
            state = _capped(a[i] * state + b[i])
        last = batch.column("_key")[-1].as_py()
        yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_chunk"), pa.array(out, pa.list_(pa.float64()))], names=["_key", "_chunk", "_begin"])


def chunked_scan(df: DataFrame, key: str, order: str | list[str], log_decay: Column, drive: Column, chunk: int, name: str = "h") -> DataFrame:
    """``df`` plus ``name``: the recurrence of ``affine_scan`` over vectors, evaluated in chunks of ``chunk`` rows of a key.

    Within a chunk h = P * before + P * sum(drive * exp(min(-log P, 30))), P being the
    product of decays so far; each h is scaled down to norm 1, and the last one is what
    the next chunk begins with. So results depend on the chunk. Log decays and drives
    are arrays of equal length, none of them null. Products and sums of all chunks are
    made at once; then the chunks of a key, one row for each, are gone through in order.
    Null keys are a series; equal orders go by content.
    """
    scratch = Scratch(df.sparkSession, "chunks")
    kind = ArrayType(DoubleType())
    rows = with_ordinal(df.select("*", log_decay.cast(kind).alias("_a"), drive.cast(kind).alias("_b")), [key], order, "_g")
    rows = rows.withColumn("_c", F.expr(f"_g div {chunk}")).repartition(key, "_c").sortWithinPartitions(key, "_c", "_g")
    maps = scratch.save(rows.mapInArrow(lambda it: _chunk_maps(it, [key, "_c"]), rows.schema), "maps")
    ends = maps.groupBy(F.col(key).alias("_key"), F.col("_c").alias("_chunk")).agg(F.max_by(F.struct("_a", "_b"), "_g").alias("e")).select("_key", "_chunk", "e.*")
    schema = StructType([*ends.select("_key", "_chunk").schema, StructField("_begin", kind)])
    starts = ends.repartition("_key").sortWithinPartitions("_key", "_chunk").mapInArrow(_chunk_starts, schema)
    found = maps.join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_c") == F.col("_chunk")))
    h = F.zip_with(F.zip_with("_a", "_begin", lambda p, q: p * q), "_b", lambda p, q: p + q)
    found = found.withColumn("_h", h)
    norm = F.greatest(F.sqrt(F.aggregate("_h", F.lit(0.0), lambda t, x: t + x * x)), F.lit(1.0))
    found = found.withColumn("_norm", norm)
    return found.select(*df.columns, F.transform("_h", lambda x: x / F.col("_norm")).alias(name))


def _gate(ema: float | None, v: float, alpha: float, factor: float | None) -> tuple[float, int]:
    if ema is None:
        return v, 0
    if factor is not None and v > ema * factor:
        return ema, 1
    return (1 - alpha) * ema + alpha * v, 0


def _run_segments(batches: Iterator[pa.RecordBatch], value: str, alpha: float, factor: float | None, rows: bool) -> Iterator[pa.RecordBatch]:
    """Segments from their _start (null: the first value seeds); each row with ema and rejected, or each segment's _end."""
    now, ema, names, ended = None, None, [], []

    def ends() -> pa.RecordBatch:
        keys, parts, last = zip(*ended, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, names[1]), pa.array(parts, pa.int64()), pa.array(last, pa.float64())], names=["_key", "_q", "_end"])

    for batch in batches:
        names = [batch.schema.names[0], batch.schema.field(0).type]
        found = []
        values = (batch.column(c).to_pylist() for c in (names[0], "_part", "_start", value))
        for key, part, start, v in zip(*values, strict=True):
            if (key, part) != now:
                if now is not None:
                    ended.append((*now, ema))
                now, ema = (key, part), start
            ema, out = _gate(ema, v, alpha, factor)
            if rows:
                found.append((ema, out))
        if rows:
            emas, outs = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(emas, pa.float64()), pa.array(outs, pa.int32())], names=[*batch.schema.names, "ema", "rejected"])
        elif ended:
            yield ends()
            ended = []
    if now is not None and not rows:
        ended.append((*now, ema))
        yield ends()


def gated_states(dealt: DataFrame, key: str, value: str, alpha: float, factor: float | None, scratch: Scratch) -> tuple[DataFrame, int]:
    """_key, _q, _start of each segment of ``dealt`` (see ``split``), and how many segments were run again.

    A segment first begins with the value that it begins with. One that does not begin
    where the segment before it ends, to the last bit, is run again from there, until
    none is left. The average forgets, so all but the first rounds run few segments;
    what comes to the driver is their number.
    """
    first = dealt.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_q")).agg(F.min_by(value, "_n").alias("_first"))
    parts = W.partitionBy("_key").orderBy("_q")
    seed = F.row_number().over(parts) == 1
    states = scratch.save(first.select("_key", "_q", F.when(~seed, F.col("_first")).alias("_start"), F.lit(None).cast("double").alias("_end"), F.lit(True).alias("_again")), "states-0")
    turn = repairs = 0
    while True:
        again = states.where("_again").select("_key", "_q", "_start")
        rows = _at_segments(dealt.select(key, "_part", "_n", value), again, key)
        rows = rows.repartition("_part", key).sortWithinPartitions("_part", key, "_n")
        schema = StructType([StructField("_key", dealt.schema[key].dataType), *StructType.fromDDL("_q long, _end double")])
        ran = rows.mapInArrow(lambda it: _run_segments(it, value, alpha, factor, False), schema)
        ran = ran.select(F.col("_key").alias("_k"), F.col("_q").alias("_p"), F.col("_end").alias("_new"))
        same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_q") == F.col("_p"))
        ended = states.join(ran, same, "left").select("_key", "_q", "_start", F.coalesce("_new", "_end").alias("_end"))
        before = F.lag("_end").over(parts)
        ended = ended.withColumn("_from", before)
        wrong = F.col("_from").isNotNull() & ~F.col("_from").eqNullSafe(F.col("_start"))
        turn += 1
        states = scratch.save(ended.select("_key", "_q", F.when(wrong, F.col("_from")).otherwise(F.col("_start")).alias("_start"), "_end", wrong.alias("_again")), f"states-{turn}")
        scratch.drop(f"states-{turn - 1}")
        left = states.where("_again").count()
        if not left:
            return states.select("_key", "_q", "_start"), repairs
        repairs += left


def gated_ema(df: DataFrame, key: str, order: str, value: str, alpha: float, factor: float | None, splits: int | None = None) -> DataFrame:
    """key, order, value, ema, rejected: see ``series.gated_ema``; equal to the step-by-step fold to the last bit."""
    scratch = Scratch(df.sparkSession, "gate")
    rows = df.select(key, order, F.col(value).cast("double").alias(value))
    dealt = scratch.save(split(rows, [key, order, value], splits), "dealt")
    states, _ = gated_states(dealt, key, value, alpha, factor, scratch)
    found = _at_segments(dealt, states, key).repartition("_part", key).sortWithinPartitions("_part", key, "_n")
    schema = StructType([*found.schema, *StructType.fromDDL("ema double, rejected int")])
    found = found.mapInArrow(lambda it: _run_segments(it, value, alpha, factor, True), schema)
    return found.select(key, order, value, "ema", "rejected")


def with_halo(df: DataFrame, keys: list[str], order: str | list[str], n: int, block: int | None = None) -> tuple[DataFrame, W]:
    """``df`` in blocks of its keys' rows, and the window of a block; frames may reach ``n`` - 1 rows back.

    Rows get their place _g in the key and their _block; the last ``n`` - 1 rows of a block
    stand in the next one too, marked _halo: leave them out when frames are done. So a key
    of any length is as many tasks as it has blocks. Null orders come first, equal rows go
    by content, null keys are a series.
    """
    size = max(BLOCK if block is None else block, n - 1, 1)
    rows = with_ordinal(df, keys, order, "_g")
    own = F.expr(f"_g div {size}")
    reaches = F.col("_g") % size >= size - (n - 1)
    rows = rows.withColumn("_block", F.explode(F.when(reaches, F.array(own, own + 1)).otherwise(F.array(own))))
    rows = rows.withColumn("_halo", F.col("_block") != own)
    return rows, W.partitionBy(*keys, "_block").orderBy("_g")


def last_rows(df: DataFrame, key: str, order: list[str], n: int, ways: int = 64) -> DataFrame:
    """The last ``n`` rows of each key by ``order``, with _back from 1: chosen in ``ways`` parts of a key first."""
    down = [F.col(c).desc() for c in order]
    way = F.pmod(F.xxhash64(*df.columns), F.lit(ways))
    part = F.row_number().over(W.partitionBy(key, "_way").orderBy(*down))
    rows = df.withColumn("_way", way).withColumn("_back", part).where(F.col("_back") <= n)
    return rows.withColumn("_back", F.row_number().over(W.partitionBy(key).orderBy(*down))).where(F.col("_back") <= n).drop("_way")
