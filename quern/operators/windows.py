"""Token windows, dedup on their prefixes, quotas, order and samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quern.operators.tokens import BOS, EOS, IGNORE, PAD
from quern.storage import Scratch

MIN_TOKENS = 16
PREFIX = 64
#: Row counts that may be sorted in one list, and offset tables that may be broadcast.
LIST_ROWS, BROADCAST_ROWS = 10_000, 100_000


def token_windows(docs: DataFrame, length: int, ids: str = "ids") -> DataFrame:
    """Columns of ``docs`` but the ids, plus window, input_ids and labels.

    Content is cut into pieces of ``length`` - 2; inputs begin with BOS, labels end
    with EOS, both are padded. Pieces of fewer than 15 tokens are dropped.
    """
    body = length - 2
    starts = F.when(F.size(ids) > 0, F.sequence(F.lit(0), F.size(ids) - 1, F.lit(body))).otherwise(F.array().cast("array<int>"))
    kept = [c for c in docs.columns if c != ids]
    pieces = F.filter(F.transform(starts, lambda s: F.slice(ids, s + 1, body)), lambda p: F.size(p) + 1 >= MIN_TOKENS)
    rows = docs.select(*kept, F.posexplode(pieces).alias("window", "_piece"))
    gap = F.lit(length - 1) - F.size("_piece")
    return rows.select(
        *kept,
        "window",
        F.concat(F.array(F.lit(BOS)), "_piece", F.array_repeat(F.lit(PAD), gap)).alias("input_ids"),
        F.concat("_piece", F.array(F.lit(EOS)), F.array_repeat(F.lit(IGNORE), gap)).alias("labels"),
    )


def prefix(ids: Column) -> Column:
    return F.slice(ids, 1, PREFIX)


def prefix_digest(ids: Column) -> Column:
    """The prefix in 128 bits, by which windows are compared and dealt."""
    return F.struct(F.xxhash64(prefix(ids)).alias("a"), F.xxhash64(F.lit(1), prefix(ids)).alias("b"))


def dedup_prefix(windows: DataFrame, order: list[str], *kept: Column) -> DataFrame:
    """The first window, by ``order``, of each 64-id prefix; with ``kept`` only the order, these columns and a digest travel."""
    if not kept:
        return first_by(windows, prefix_digest(F.col("input_ids")), order)
    return first_by(windows.select(*order, *kept, prefix_digest(F.col("input_ids")).alias("_p")), "_p", order).drop("_p")


def first_by(rows: DataFrame, key: Column | str, order: list[str]) -> DataFrame:
    """The first row, by ``order``, of each key; each task sends one row of a key at most."""
    first = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def take_first(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows by ``order`` (nulls first; equal ones by content).

    Up to ``LIST_ROWS`` rows are merged from each task's first n. Beyond that only orders
    and hashes are numbered; they tell the last row, and all rows before it are read where
    they are, so no task holds them all and no whole row travels.
    """
    if n <= LIST_ROWS:
        return df.orderBy(*order, F.xxhash64(*df.columns)).limit(n)
    last = _nth(df, order, n - 1)
    if last is None:
        return df
    before, same = _against(df, order, last)
    return df.where(before).unionByName(df.where(same).limit(n - df.where(before).count()))  # the same rows again, if there are several


def skip_first(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """What ``take_first`` leaves."""
    if n <= 0:
        return df
    last = _nth(df, order, n - 1)
    if last is None:
        return df.limit(0)
    before, same = _against(df, order, last)
    left = df.where(before | same).count() - n  # the same row again, if there are several
    return df.where(~(before | same)).unionByName(df.where(same).limit(left))


def first_of_each(df: DataFrame, key: str, order: list[str], most: dict[str, int]) -> DataFrame:
    """The first rows by ``order`` of each ``key``, as many as ``most`` has for it; none of other keys.

    As in ``take_first`` only orders and hashes are numbered, for all keys at once, and only if a key has more rows.
    """
    scratch = Scratch(df.sparkSession, "first")
    df = df.where(F.col(key).isin([k for k, n in most.items() if n > 0]))
    named = [*(f"_o{i}" for i in range(len(order))), "_h"]
    keys = df.select(F.col(key).alias("_key"), *(F.col(c).alias(o) for c, o in zip(order, named, strict=False)), F.xxhash64(*df.columns).alias("_h"))
    keys = scratch.save(keys, "keys")
    over = [r["_key"] for r in keys.groupBy("_key").count().collect() if r["count"] > most[r["_key"]]]
    if not over:
        return df
    placed = scratch.save(with_ordinal(keys.where(F.col("_key").isin(over)), ["_key"], named, "_n"), "placed")
    within, more = ~F.col(key).isin(over), []
    for k in over:
        own = placed.where(F.col("_key") == k)
        last = own.where(F.col("_n") == most[k] - 1).first()
        before, same = _against(df, order, tuple(last[o] for o in named))
        equal = own
        for o in named:
            equal = equal.where(F.col(o).eqNullSafe(_literal(last[o]).cast(placed.schema[o].dataType)))
        first, n = equal.agg(F.min("_n"), F.count("*")).first()
        if first + n <= most[k]:
            before = before | same
        else:  # the same row again
            more.append(df.where((F.col(key) == k) & same).limit(most[k] - first))
        within = within | ((F.col(key) == k) & before)
    chosen = df.where(within)
    for rows in more:
        chosen = chosen.unionByName(rows)
    return chosen


def _nth(df: DataFrame, order: list[str], n: int) -> Row | None:
    """Order and content hash of the row with place ``n`` by both; None if there are not as many."""
    keys = df.select(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.xxhash64(*df.columns).alias("_h"))
    return with_ordinal(keys, [], keys.columns, "_n").where(F.col("_n") == n).drop("_n").first()


def _literal(value) -> Column:
    """A collected value as a column; an order may be a struct, such as file, block and line."""
    return F.struct(*map(_literal, value)) if isinstance(value, Row) else F.lit(value)


def _against(df: DataFrame, order: list[str], row: Row) -> tuple[Column, Column]:
    """Whether rows come before a row of ``_nth``, and whether they are equal to it. Nulls come first."""
    before, same = F.lit(False), F.lit(True)
    for column, at, kind in zip([*map(F.col, order), F.xxhash64(*df.columns)], row, [*(df.schema[c].dataType for c in order), LongType()], strict=True):
        value = _literal(at).cast(kind)
        less = F.lit(False) if at is None else column.isNull() | F.coalesce(column < value, F.lit(False))
        before, same = before | (same & less), same & column.eqNullSafe(value)
    return before, same


def difficulty(ids: Column) -> Column:
    """Distinct non-PAD ids as a share of the whole length; 0 for none."""
    real = F.array_distinct(F.filter(ids, lambda x: x != PAD))
    return F.when(F.size(ids) > 0, F.size(real) / F.size(ids)).otherwise(0.0)


def quota_mix(windows: DataFrame, targets: list[tuple[str, int]], order: list[str], scratch: Scratch) -> DataFrame:
    """Windows of each source in turn up to its target, without prefixes emitted before, plus ``_step``.

    A window that is not emitted because its source's quota is full does not count as
    seen: a later source may still emit it. Emitted prefixes grow by source, so each
    step reads the steps before it, as written tables. ``windows`` is computed once.
    """
    # Steps carry a row's number, order and digest; whole rows are fetched at the end.
    rows = scratch.save(windows.select("*", prefix_digest(F.col("input_ids")).alias("_p"), F.monotonically_increasing_id().alias("_row")), "windows")
    done, met = None, F.lit(False)
    for i, (source, target) in enumerate(targets):
        reach = F.lit(True)
        fresh = rows.where(F.col("source") == source).select("_row", *(c for c in order if c != "_row"), "_p")
        fresh = first_by(fresh, "_p", order)
        if done is not None:
            fresh = fresh.join(done.select(F.col("_p").alias("_seen")), F.col("_p") == F.col("_seen"), "left_anti")
        fresh = scratch.save(fresh.withColumn("_step", F.lit(i)), f"fresh-{i}")
        if fresh.count() > target:
            fresh = scratch.save(take_first(fresh, order, target), f"quota-{i}")
            reach = reaches(fresh, order[0])
        met = met | ((F.col("source") == source) & reach)
        done = fresh if done is None else done.unionByName(fresh)
    if done is None:
        return windows.limit(0).withColumn("_step", F.lit(0))
    chosen = done.select(F.col("_row").alias("_chosen"), "_step")
    return rows.where(met).join(chosen, F.col("_row") == F.col("_chosen")).drop("_p", "_row", "_chosen")


def reaches(chosen: DataFrame, order: str) -> Column:
    """Whether a row's ``order`` is no larger than any of ``chosen``: what lies beyond a full quota need not travel."""
    last = chosen.agg(F.max(order)).first()[0]
    return F.col(order).isNull() | (F.lit(False) if last is None else F.col(order) <= _literal(last).cast(chosen.schema[order].dataType))


def seeded_key(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def interleave(records: DataFrame, seed: int, order: str | list[str] = "k") -> DataFrame:
    """Columns of ``records`` plus k and slot: sources shuffled into each other, each in its own order.

    ``records`` has source; k is a record's 0-based place by ``order`` in its source
    (equal ones by content, null sources are a source). Every place draws a slot; a
    source's slots, in order, are filled with its records, in order.
    """
    numbered = with_ordinal(records, ["source"], order, "_n").drop("k").withColumnRenamed("_n", "k")
    slots = numbered.select("source", seeded_key(seed, "source", "k").alias("slot"))
    ranked = with_ordinal(slots, ["source"], "slot", "_k").withColumnRenamed("source", "_s")
    return numbered.join(ranked, F.col("source").eqNullSafe(F.col("_s")) & (F.col("k") == F.col("_k"))).drop("_s", "_k")


def reservoir_sample(df: DataFrame, k: int, seed: int, key: str) -> DataFrame:
    """min(k, all) rows without replacement: those with the least seeded hash."""
    return df.withColumn("_h", seeded_key(seed, key)).orderBy("_h", key).limit(k).drop("_h")


def _running(batches: Iterator[pa.RecordBatch], size: str) -> Iterator[pa.RecordBatch]:
    """Adds ``_near``: the sum of ``size`` over the rows of the partition before."""
    total = 0
    for batch in batches:
        n = batch.column(size).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = total + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - n)], names=[*batch.schema.names, "_near"])
        total = int(ends[-1]) if len(ends) else total


def starts(df: DataFrame, keys: list[str], order: str | list[str], size: str | None = None, name: str = "start", place: str | None = None) -> DataFrame:
    """``df`` plus ``name``: the sum of column ``size`` (1 without it) over the rows before by ``order``, within ``keys``.

    With ``place`` that column has the number of these rows, from the same pass.

    Null keys are keys; null orders come first; rows of equal order go by a hash of
    their content. Rows are range-partitioned by all of that and written with their
    place in the partition, so each is kept exactly once and no task sees a whole key.
    Only the sums of each partition and key, at most as many as both together, are
    joined to them.
    """
    order = [order] if isinstance(order, str) else [*order]
    scratch = Scratch(df.sparkSession, "starts")
    by = [*keys, *order, "_tie"]
    dealt = df.withColumn("_tie", F.xxhash64(*df.columns)).repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    if size is not None:
        schema = StructType([*dealt.schema, StructField("_near", LongType())])
        dealt = dealt.mapInArrow(lambda it: _running(it, size), schema)
    at = F.monotonically_increasing_id()  # the partition, then the place in it in 33 bits
    dealt = dealt.withColumn("_at", at).select("*", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_nth")).drop("_at")
    made = {name: ("_nth", F.lit(1).cast("long")) if size is None else ("_near", F.col(size).cast("long"))}
    if place:
        made[place] = ("_nth", F.lit(1).cast("long"))
    dealt = scratch.save(dealt, "dealt")
    each = [x for i, (near, n) in enumerate(made.values()) for x in (F.sum(n).alias(f"_sum{i}"), F.min(near).alias(f"_first{i}"))]
    sums = dealt.groupBy(*keys, "_part").agg(*each)
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    named = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    shifts = [(F.coalesce(F.sum(f"_sum{i}").over(before), F.lit(0)) - F.col(f"_first{i}")).alias(f"_shift{i}") for i in range(len(made))]
    offsets = scratch.save(sums.select(*named, F.col("_part").alias("_q"), *shifts), "offsets")
    same = F.col("_part") == F.col("_q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    small = offsets.count() <= BROADCAST_ROWS
    found = [(F.col(near) + F.col(f"_shift{i}")).alias(c) for i, (c, (near, _)) in enumerate(made.items())]
    return dealt.join(F.broadcast(offsets) if small else offsets, same).select(*df.columns, *found)


def repack(records: DataFrame, length: int, order: str = "ord", key: str | None = None) -> DataFrame:
    """window, tokens, trust: records laid end to end and cut every ``length`` + 1 tokens.

    ``records`` has ``order``, input_ids and trust_score; each gives its first
    ``length`` + 1 ids if there are at least two. Records of equal or null order all
    stay (null first, equal ones by content). The trust is that of the first token.
    The incomplete rest is left out. Positions are prefix sums over record sizes; a
    record is then cut where windows end, so no window ever runs over tokens. With
    ``key`` every key is a stream of its own, the null key too.
    """
    keys = [key] if key else []
    cut = F.slice("input_ids", 1, length + 1)
    rows = records.select(*keys, order, cut.alias("ids"), "trust_score").where(F.size("input_ids") >= 2)
    placed = starts(rows.withColumn("_n", F.size("ids").cast("long")), keys, order, "_n")
    return cut_stream(placed, length, keys)


def _pieces(batch: pa.RecordBatch, width: int, kept: list[str]) -> pa.RecordBatch:
    """``kept``, window, at, piece of records (ids, start): the ids stay where they are, they are only cut anew."""
    ids = batch.column("ids")
    n = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = batch.column("start").to_numpy()
    first = start // width
    count = np.where(n > 0, (start + n - 1) // width - first + 1, 0)
    rows = np.repeat(np.arange(len(n)), count)
    window = first[rows] + np.arange(len(rows)) - (np.cumsum(count) - count)[rows]
    at = np.maximum(window * width, start[rows])
    begins = (np.cumsum(n) - n)[rows] + at - start[rows]
    piece = pa.ListArray.from_arrays(pa.array(np.append(begins, n.sum()).astype(np.int32)), ids.flatten())
    chosen = pa.array(rows)
    return pa.RecordBatch.from_arrays([*(batch.column(c).take(chosen) for c in kept), pa.array(window), pa.array(at), piece], names=[*kept, "window", "at", "piece"])


def cut_stream(placed: DataFrame, length: int, keys: list[str], encode: Callable[..., DataFrame] | None = None) -> DataFrame:
    """window, tokens, trust of whole records (ids, trust_score) from their start in the stream.

    A window within one record is complete at once; only pieces at the ends of records
    are grouped. All pieces are written once. With ``encode`` (``tokens.encode_texts`` of a
    vocabulary) records are texts, which are encoded and cut in one pass.
    """
    width, kept = length + 1, [*keys, "trust_score"]
    schema = StructType([*(placed.schema[c] for c in kept), *StructType.fromDDL(f"window long, at long, piece {'array<int>' if encode else placed.schema['ids'].dataType.simpleString()}")])
    if encode:
        parts = encode(placed, then=lambda b: _pieces(b, width, kept), gives=schema)
    else:
        parts = placed.select(*kept, "start", "ids").mapInArrow(lambda it: (_pieces(b, width, kept) for b in it), schema)
    parts = Scratch(placed.sparkSession, "repack").save(parts, "pieces")
    inner = parts.where(F.size("piece") == width)
    listed = parts.where(F.size("piece") < width).groupBy(*keys, "window").agg(F.array_sort(F.collect_list(F.struct("at", "piece", "trust_score"))).alias("p"))
    joined = listed.select(*keys, "window", F.flatten(F.transform("p", lambda x: x["piece"])).alias("tokens"), F.col("p")[0]["trust_score"].alias("trust"))
    inner = inner.select(*keys, "window", F.col("piece").alias("tokens"), F.col("trust_score").alias("trust"))
    return inner.unionByName(joined.where(F.size("tokens") == width))


def laid(ids: np.ndarray, length: int) -> np.ndarray:
    """The input_ids of the ``token_windows`` of one text, end to end."""
    body = length - 2
    out = np.full((windows_of(len(ids), length), length), PAD, np.int32)
    flat = np.full(len(out) * body, PAD, np.int32)
    flat[: len(ids)] = ids[: len(flat)]
    out[:, 0], out[:, 1:-1] = BOS, flat.reshape(-1, body)
    return out.ravel()


def windows_of(n, length: int):
    """How many ``token_windows`` n ids give; ``n`` is a number or a column."""
    body = length - 2
    rest = n % body
    return (n - rest) / body + (rest + 1 >= MIN_TOKENS).cast("int") if isinstance(n, Column) else n // body + (rest + 1 >= MIN_TOKENS)


def sizes(n: Column, length: int) -> Column:
    """The ids but PAD of each of the ``token_windows`` of n ids: a piece and BOS."""
    body = length - 2
    starts_ = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(body))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts_, lambda s: F.least(n - s, F.lit(body)) + 1), lambda m: m >= MIN_TOKENS)


def batches(windows: DataFrame, batch: int, length: int, *keys: str) -> DataFrame:
    """batch_id, slot, input_ids, labels (PAD ignored), trust of repacked windows, after ``keys``."""
    labels = F.transform(F.slice("tokens", 2, length), lambda t: F.when(t == PAD, IGNORE).otherwise(t))
    return windows.select(
        *keys,
        F.floor(F.col("window") / batch).alias("batch_id"),
        (F.col("window") % batch).alias("slot"),
        F.slice("tokens", 1, length).alias("input_ids"),
        labels.alias("labels"),
        "trust",
    )


def validate(records: DataFrame, vocab: int, length: int | None = None) -> DataFrame:
    """Columns of ``records`` plus ``problem``: null where a record is sound; with ``length`` all must have it."""
    ids = F.forall("input_ids", lambda x: (x == PAD) | ((x >= 0) & (x < vocab)))
    labels = F.forall("labels", lambda x: (x == IGNORE) | ((x >= 0) & (x < vocab)))
    problem = (
        F.when(F.col("input_ids").isNull() | F.col("labels").isNull() | F.col("source").isNull() | F.col("trust_score").isNull(), "missing")
        .when(F.size("input_ids") != F.size("labels"), "lengths")
        .when(F.size("input_ids") == 0, "empty")
        .when(F.size("input_ids") != (F.size("input_ids") if length is None else F.lit(length)), "length")
        .when(F.exists("input_ids", lambda x: x.isNull()) | F.exists("labels", lambda x: x.isNull()), "null id")
        .when(~ids, "input id out of range")
        .when(~labels, "label out of range")
    )
    return records.withColumn("problem", problem)


def with_ordinal(df: DataFrame, keys: list[str], order: str | list[str], name: str = "k") -> DataFrame:
    """``df`` plus its 0-based place by ``order`` within ``keys``: see ``starts``."""
    return starts(df, keys, order, None, name)
