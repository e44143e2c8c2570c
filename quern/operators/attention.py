"""Attention, pooling and gate operators over rows of (seq, t, v)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.functions import vectors as V
from quern.operators import scans
from quern.storage import Scratch


def window_attention(rows: DataFrame, window: int, alpha: float, dim: int) -> DataFrame:
    """seq, t, r: each row attends to itself and the ``window`` - 1 rows before, with a decay by distance.

    Queries, keys and values are the rows themselves. The keys come from a window
    frame, so there is no join of positions with positions.
    """
    frame = W.partitionBy("seq").orderBy("t").rangeBetween(-(window - 1), 0)
    near = rows.withColumn("_near", F.collect_list(F.struct("t", "v")).over(frame))
    scores = F.transform(
        "_near", lambda k: V.dot(F.col("v"), k["v"]) / math.sqrt(dim) - F.log1p(F.lit(alpha) * (F.col("t") - k["t"]))
    )
    values = F.transform("_near", lambda k: k["v"])
    return near.select("seq", "t", V.let(V.softmax(scores), lambda w: V.weighted_sum(w, values, dim)).alias("r"))


#: Queries whose scores with a block of slots are held at a time.
STRIP = 256
PARTIAL = "m double, s double, acc array<double>"


def _partial(queries: pa.Table, slots: pa.Table, ids: list[str], scale: float, alpha: float | None) -> pa.Table:
    """Softmax states of a block of queries over a block of slots: largest score, sum of weights, weighted sum of values."""

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        flat = pc.list_flatten(column).to_numpy().astype(np.float64, copy=False)
        return flat.reshape(len(column), -1)

    if not (queries.num_rows and slots.num_rows):
        queries, asked, keys, held = queries.slice(0, 0), np.zeros((0, 1)), np.zeros((1, 1)), np.zeros((1, 1))
    else:
        asked, keys, held = matrix(queries["q"]), matrix(slots["k"]).T, matrix(slots["value"])
    places = None if alpha is None else (queries["at"].to_numpy(), slots["at"].to_numpy())
    found, m, s, acc = [np.zeros(0, bool)], [np.zeros(0)], [np.zeros(0)], [np.zeros((0, held.shape[1]))]
    for at in range(0, len(asked), STRIP):  # scores of a strip only
        scores = asked[at : at + STRIP] @ keys
        scores *= scale
        if places is not None:
            apart = places[0][at : at + STRIP, None] - places[1][None, :]
            scores += np.where(apart >= 0, -np.log1p(alpha * np.maximum(apart, 0)), -np.inf)
        most = scores.max(axis=1)
        seen = np.isfinite(most)
        weights = scores if seen.all() else scores[seen]
        weights -= most[seen, None]
        np.exp(weights, out=weights)
        found.append(seen)
        m.append(most[seen])
        s.append(weights.sum(axis=1))
        acc.append(weights @ held)
    kept, acc = pa.array(np.concatenate(found)), np.concatenate(acc)
    ends = np.arange(len(acc) + 1, dtype=np.int32) * np.int32(acc.shape[1])
    out = [queries[c].filter(kept) for c in ids]
    out += [pa.array(np.concatenate(m)), pa.array(np.concatenate(s)), pa.ListArray.from_arrays(pa.array(ends), pa.array(acc.ravel()))]
    return pa.Table.from_arrays(out, names=[*ids, "m", "s", "acc"])


def _merged(batches: Iterator[pa.RecordBatch], ids: list[str]) -> Iterator[pa.RecordBatch]:
    """States of a row (the first of ``ids``) in sorted order as one: its weighted mean ``r``."""
    held = None
    for batch in _then_none(batches):
        table = [b for b in (held, batch) if b is not None]
        if not table:
            return
        rows = pa.Table.from_batches(table).combine_chunks()
        row = rows[ids[0]].to_numpy()
        begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, int)
        if batch is not None:  # the last row may go on in the next batch
            if not len(begins):
                continue
            held = rows.slice(int(begins[-1])).to_batches()[0]
            rows, begins = rows.slice(0, int(begins[-1])), begins[:-1]
        if not len(begins):
            continue
        m, s = rows["m"].to_numpy(), rows["s"].to_numpy()
        acc = rows["acc"].combine_chunks().flatten().to_numpy().reshape(len(m), -1)
        most = np.maximum.reduceat(m, begins)
        weight = np.exp(m - np.repeat(most, np.diff([*begins, len(m)])))
        total = np.add.reduceat(acc * weight[:, None], begins) / np.add.reduceat(s * weight, begins)[:, None]
        kept = rows.select(ids).take(pa.array(begins)).combine_chunks()
        columns = [kept[c].combine_chunks() for c in ids] + [pa.array([*total], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=[*ids, "r"])


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def blocked_softmax(queries: DataFrame, slots: DataFrame, keys: list[str], ids: list[str], scale: float = 1.0, alpha: float | None = None) -> DataFrame:
    """``ids`` and r: the softmax of each query's products with all slots of its ``keys`` weighs their values.

    ``queries`` has q, keys, ``ids`` (the first one a number of its own for each row), _q and _ks: its block, and the blocks of
    slots that it reads. ``slots`` has k, value, keys, _k and _qs. With ``alpha`` both
    have a place ``at``: later slots are not seen, earlier ones lose log(1 + alpha *
    distance). Each pair of blocks is one group of bounded size; it gives a state
    (maximum, sum, weighted sum) for each query, and states of a query are merged as they
    stream by, so neither slots nor scores ever meet in one place. A query that sees no
    slot gives no row.
    """
    pair = [*keys, "_q", "_k"]
    places = ["at"] if alpha is not None else []
    q = queries.withColumn("_k", F.explode("_ks")).select(*dict.fromkeys([*pair, *ids, *places]), "q")
    k = slots.withColumn("_q", F.explode("_qs")).select(*pair, *places, "k", "value")
    schema = StructType([*queries.select(*ids).schema, *StructType.fromDDL(PARTIAL)])
    made = q.groupBy(*pair).cogroup(k.groupBy(*pair)).applyInArrow(lambda a, b: _partial(a, b, ids, scale, alpha), schema)
    made = made.repartition(ids[0]).sortWithinPartitions(ids[0])
    return made.mapInArrow(lambda it: _merged(it, ids), StructType([*queries.select(*ids).schema, *StructType.fromDDL("r array<double>")]))


#: Queries and slots of a group, about.
QUERY_BLOCK, SLOT_BLOCK = 4_096, 8_192


def memory_read(rows: DataFrame, slots: DataFrame, gate: float, query_block: int = QUERY_BLOCK, slot_block: int = SLOT_BLOCK) -> DataFrame:
    """vec_id, r: the softmax of each row's cosines with all slots weighs their sum, times tanh(gate).

    ``slots`` (vec_id, v) is the memory; it may have any number of rows and stays
    distributed: rows and slots are dealt into blocks by hash, and every block of rows
    meets every block of slots. Repeated rows each have a result, repeated slots count
    again, null ids are ids like others. Without slots there are no results.
    """
    scratch = Scratch(rows.sparkSession, "memory")
    rows = scratch.save(rows.select("vec_id", "v").withColumn("_row", F.monotonically_increasing_id()), "rows")
    slots = scratch.save(slots.select("vec_id", "v").withColumn("_row", F.monotonically_increasing_id()), "slots")
    n_q, n_k = (max(1, -(-df.count() // size)) for df, size in ((rows, query_block), (slots, slot_block)))

    def direction(v: Column) -> Column:
        return V.let(F.greatest(V.norm(v), F.lit(V.TINY)), lambda n: F.transform(v, lambda x: x / n))

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("_row"), F.lit(n))

    def every(n: int) -> Column:
        return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))

    q = rows.select("_row", "vec_id", direction(F.col("v")).alias("q"), block(n_q).alias("_q"), every(n_k).alias("_ks"))
    k = slots.select(direction(F.col("v")).alias("k"), F.col("v").alias("value"), block(n_k).alias("_k"), every(n_q).alias("_qs"))
    read = blocked_softmax(q, k, [], ["_row", "vec_id"])
    return read.select("vec_id", V.scaled(F.col("r"), F.lit(math.tanh(gate))).alias("r"))


def segment_attention(rows: DataFrame, stride: int, alpha: float, dim: int, query_block: int = QUERY_BLOCK, slot_block: int = SLOT_BLOCK) -> DataFrame:
    """seq, t, r: each row attends to the means of the full segments of ``stride`` rows before its own.

    Slots are those of ``causal_pool``: slot j is the mean of segment j - 1, slot 0 is
    zero, and a row sees the slots up to its own segment, each less log(1 + alpha *
    segments between). (seq, t) names a row; t runs from 0 without gaps.
    """
    scratch = Scratch(rows.sparkSession, "segments")
    rows = scratch.save(rows.select("seq", "t", "v").withColumn("_row", F.monotonically_increasing_id()), "rows")
    slots = scratch.save(causal_pool(rows.select("seq", "t", "v"), stride), "slots")
    last = rows.groupBy(F.col("seq").alias("_s")).agg(F.max("t").alias("_last"))
    own = F.floor(F.col("t") / stride)
    zero = F.lit(0).cast("long")
    q = rows.select(
        "seq", "t", "_row", own.alias("at"), F.col("v").alias("q"), F.expr(f"t div {query_block}").alias("_q"), F.sequence(zero, F.floor(own / slot_block)).alias("_ks")
    )
    # A slot is read by the rows of its own segment and all after it.
    first = F.floor(F.col("slot") * stride / query_block)
    k = slots.join(last, F.col("seq").eqNullSafe(F.col("_s"))).where(F.col("slot") * stride <= F.col("_last")).select(
        "seq", F.col("slot").alias("at"), F.col("v").alias("k"), F.col("v").alias("value"), F.floor(F.col("slot") / slot_block).alias("_k"),
        F.sequence(first, F.expr(f"_last div {query_block}")).alias("_qs"),
    )
    return blocked_softmax(q, k, ["seq"], ["_row", "seq", "t"], dim**-0.5, alpha).select("seq", "t", "r")


def scale_blend(rows: DataFrame, window: int, strides: tuple[int, int], alpha: float, dim: int, weights: tuple[float, ...] = (0.5, 0.3, 0.2)) -> DataFrame:
    """seq, t, r: window attention over rows, and attention over segments of two lengths, blended; rows are RMS-normalised first."""
    rows = rows.select("seq", "t", V.rms_norm(F.col("v")).alias("v"))
    out = window_attention(rows, window, 0.0, dim).withColumnRenamed("r", "_r0")
    for i, stride in enumerate(strides, 1):
        more = segment_attention(rows, stride, alpha, dim).select(F.col("seq").alias("_s"), F.col("t").alias("_t"), F.col("r").alias(f"_r{i}"))
        out = out.join(more, F.col("seq").eqNullSafe(F.col("_s")) & (F.col("t") == F.col("_t"))).drop("_s", "_t")
    return out.select("seq", "t", blended([F.col(f"_r{i}") for i in range(len(strides) + 1)], weights).alias("r"))


def load_shares(loads):
    """Loads as shares of their sum, which is kept from zero."""
    return V.let(V.total(loads), lambda t: F.transform(loads, lambda x: x / (t + 1e-8)))


def blended(outputs: list, weights: tuple[float, ...] = (0.5, 0.3, 0.2)):
    """Outputs of several scales, weighted by the softmax of their log weights."""
    total = sum(weights)
    parts = [V.scaled(o, F.lit(w / total)) for o, w in zip(outputs, weights, strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = V.added(out, p)
    return out


def causal_pool(rows: DataFrame, stride: int) -> DataFrame:
    """seq, slot, v: means of full strides, each one slot later; slot 0 is zero.

    A sequence of at most ``stride`` rows gives one zero slot; an incomplete tail is
    left out.
    """
    sizes = rows.groupBy("seq").agg(F.count("*").alias("_n"), F.max(F.size("v")).alias("_dim"))
    parts = rows.select("seq", F.floor(F.col("t") / stride).alias("slot"), F.posexplode("v").alias("i", "x"))
    means = parts.groupBy("seq", "slot", "i").agg(F.avg("x").alias("m")).groupBy("seq", "slot")
    means = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("v"))
    last = F.floor(F.col("_n") / stride) - 1
    shifted = means.join(sizes, "seq").where((F.col("_n") > stride) & (F.col("slot") < last))
    zeros = sizes.select("seq", F.lit(0).cast("long").alias("slot"), F.expr("array_repeat(0D, _dim)").alias("v"))
    return shifted.select("seq", (F.col("slot") + 1).alias("slot"), "v").unionByName(zeros)


def causal_conv(rows: DataFrame, taps: tuple[float, ...], block: int | None = None) -> DataFrame:
    """seq, t, v: each component filtered over the last rows, the last tap for the row itself; a sequence is cut into blocks."""
    rows, order = scans.with_halo(rows.select("seq", "t", "v"), ["seq"], "t", len(taps), block)
    out = F.transform("v", lambda x: x * taps[-1])
    for back, tap in enumerate(reversed(taps[:-1]), 1):
        past = F.lag("v", back).over(order)
        out = F.when(past.isNotNull(), V.added(out, V.scaled(past, F.lit(tap)))).otherwise(out)
    return rows.select("seq", "t", out.alias("v"), "_halo").where(~F.col("_halo")).drop("_halo")


def expert_load(gates: DataFrame) -> DataFrame:
    """expert, load: the mean gate."""
    return gates.select(F.posexplode("gates").alias("expert", "g")).groupBy("expert").agg(F.avg("g").alias("load"))


def load_balance(gates: DataFrame, experts: int, k: int) -> DataFrame:
    """loss: experts * sum of (share of rows with the expert among the k largest) * (mean gate)."""
    if k >= experts:
        share = F.transform("gates", lambda g: F.lit(1.0 / experts))
    else:
        share = F.transform(V.top_gates(F.col("gates"), k), lambda g: F.when(g > 0, 1.0).otherwise(0.0))
    rows = gates.select(F.posexplode(F.arrays_zip(F.col("gates").alias("g"), share.alias("f"))).alias("expert", "p"))
    means = rows.groupBy("expert").agg(F.avg("p.g").alias("g"), F.avg("p.f").alias("f"))
    return means.agg((experts * F.sum(F.col("f") * F.col("g"))).alias("loss"))


def stability(loads: DataFrame) -> DataFrame:
    """gsi: 1 - sample deviation over mean of the loads, within [0, 1]; 0 without load."""
    row = loads.agg(F.avg("load").alias("m"), F.coalesce(F.stddev_samp("load"), F.lit(0.0)).alias("s"))
    value = F.least(F.greatest(1 - F.col("s") / (F.col("m") + 1e-8), F.lit(0.0)), F.lit(1.0))
    return row.select(F.when(F.col("m") < 1e-8, 0.0).otherwise(value).alias("gsi"))


def halting(df: DataFrame, thresholds: tuple[float, ...], classes: int) -> DataFrame:
    """ponder, halted: mean active share of extra passes, share of rows halted in the end.

    ``entropies`` holds a row's entropy before the first and after each pass. A row
    halts for good below sigmoid(threshold) * ln(classes); passes end when none is active.
    """
    rows = df.select("entropies", F.lit(False).alias("halted"), F.col("entropies")[0].alias("h"))
    for i, raw in enumerate(thresholds):
        t = 1 / (1 + math.exp(-raw)) * math.log(classes)
        halts = F.col("halted") | (F.col("h") < t)
        soft = 1 - V.sigmoid((F.lit(t) - F.col("h")) * 5)
        rows = rows.withColumn(f"f{i}", F.when(halts, 0.0).otherwise(soft)).withColumn("_halts", halts)
        rows = rows.withColumn(f"a{i}", (~F.col("_halts")).cast("int"))
        rows = rows.withColumn("h", F.when(F.col("_halts"), F.col("h")).otherwise(F.col("entropies")[i + 1]))
        rows = rows.withColumn("halted", F.col("_halts"))
    n = range(len(thresholds))
    sums = rows.agg(
        F.avg(F.col("halted").cast("int")).alias("halted"),
        *(F.avg(f"f{i}").alias(f"f{i}") for i in n),
        *(F.max(f"a{i}").alias(f"a{i}") for i in n),
    )
    ran = [F.lit(1)]  # a pass runs while some row was active before
    for i in n[:-1]:
        ran.append(ran[-1] * F.col(f"a{i}"))
    ponder = sum((r * F.col(f"f{i}") for i, r in enumerate(ran)), F.lit(0.0)) / sum(ran, F.lit(0))
    return sums.select(ponder.alias("ponder"), "halted")


def _pairs(rows: DataFrame, stride: int) -> DataFrame:
    """seq, i, j of each row's place i and the places, or full segments of ``stride`` rows, of its sequence."""
    sizes = rows.groupBy(F.col("seq").alias("_s")).agg(F.count("*").alias("_n"))
    n = F.expr(f"_n div {stride}")
    js = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    return rows.join(sizes, F.col("seq").eqNullSafe(F.col("_s"))).select("seq", F.col("t").alias("i"), F.explode(js).alias("j"))


def window_mask(rows: DataFrame, window: int) -> DataFrame:
    """seq, i, j, keep: which rows j of its sequence a row i sees."""
    return _pairs(rows, 1).withColumn("keep", (F.col("i") - F.col("j")).between(0, window - 1))


def decay_bias(rows: DataFrame, alpha: float) -> DataFrame:
    """seq, i, j, bias: -ln(1 + alpha * distance); null for the future."""
    return segment_bias(rows, 1, alpha)


def segment_bias(rows: DataFrame, stride: int, alpha: float) -> DataFrame:
    """The same between a row's segment and segment j of its sequence."""
    own = F.floor(F.col("i") / stride)
    return _pairs(rows, stride).withColumn("bias", F.when(F.col("j") <= own, -F.log1p(alpha * F.abs(own - F.col("j")))))
