"""An endless stream of training batches over a finite corpus, in Spark's own sources and files.

``lay`` writes the corpus once, each record with its place among all tokens. What batch
b holds is then arithmetic: tokens ``b * batch * (length + 1)`` and on of the corpus
repeated for ever. A rate source counts batches, so a query's position is an offset in
its checkpoint, and a micro-batch is a function of its offsets: nothing is carried from
one to the next, and one that is repeated after a stop gives the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.windows import batches, starts
from quern.storage import Files

ABOUT = "about.json"
#: More ranges than this come only from a corpus that is shorter than a batch, which is read whole.
RANGES = 16


def lay(records: DataFrame, order: str | list[str], length: int, folder: str, part_tokens: int = 1 << 32) -> None:
    """Write ``records`` (input_ids, trust_score) by ``order`` with their place, k, and that of their first token, start.

    As in ``windows.repack`` each gives its first ``length`` + 1 ids if there are at
    least two; null ids give nothing, a null trust stays null, rows of equal or null
    order all stay. Records with txt and n in place of input_ids are texts that n ids
    will be made of, none of which is cut, when batches are read: a character travels
    in one byte, an id in four. All records go through one range shuffle. Files are
    sorted by start and lie in folders of ``part_tokens`` tokens, so a batch reads a few
    row groups. The folder counts once its description is there, which is written last.
    """
    spark, order = records.sparkSession, [order] if isinstance(order, str) else [*order]
    files = Files(spark, folder)
    files.delete(ABOUT)
    encoded = "input_ids" in records.columns
    held = F.slice("input_ids", 1, length + 1).alias("ids") if encoded else F.col("txt")
    named = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    rows = records.where(F.size("input_ids") >= 2 if encoded else F.col("n") >= 2)
    rows = rows.select(*named, held, F.col("trust_score").alias("trust"), *([] if encoded else [F.col("n").cast("long").alias("n")]))
    rows = rows.withColumn("n", F.size("ids").cast("long")) if encoded else rows
    placed = starts(rows, [], [f"_o{i}" for i in range(len(order))], "n", place="k").drop(*(f"_o{i}" for i in range(len(order))))
    placed = placed.withColumn("part", F.expr(f"start div {part_tokens}"))
    placed.sortWithinPartitions("part", "start").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/records")
    total = [F.count("*").alias("records"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.max("n"), F.lit(0)).alias("most")]
    told = spark.read.schema("n long").parquet(f"{folder}/records").agg(*total).first()
    files.write(ABOUT, json.dumps({**told.asDict(), "length": length, "part_tokens": part_tokens, "encoded": encoded}))


class Endless:
    """Batches of ``batch`` windows from a corpus that ``lay`` has written, epoch after epoch.

    Without ``seed`` an epoch begins at the first record; with it, at a record that seed
    and epoch draw, and goes on at the first after the last, as in ``jsonl.replay``.
    Of a corpus of texts ``encode`` puts ids in place of txt, as many as was said.
    """

    def __init__(self, spark: SparkSession, folder: str, batch: int, seed: int | None = None, encode: Callable[[DataFrame], DataFrame] | None = None):
        told = Files(spark, folder).read(ABOUT)
        if told is None:
            raise FileNotFoundError(f"no complete corpus at {folder}")
        about = json.loads(told)
        self.spark, self.batch, self.seed = spark, batch, seed
        self.records, self.tokens, self.length, self.part_tokens = about["records"], about["tokens"], about["length"], about["part_tokens"]
        self.most, self.encode = about["most"], None if about["encoded"] else encode
        if self.encode is None and not about["encoded"]:
            raise ValueError(f"{folder} has texts: encode is missing")
        if not self.tokens:
            raise ValueError(f"{folder} has no record of two ids or more")
        self.width = self.length + 1
        held = "ids array<int>" if about["encoded"] else "txt string"
        self.rows = spark.read.schema(f"k long, {held}, trust double, n long, start long, part long").parquet(f"{folder}/records")
        self._begins: dict[int, int] = {}

    def begin(self, epoch: int) -> int:
        """The token of the corpus with which an epoch begins."""
        if self.seed is None:
            return 0
        if epoch not in self._begins:
            drawn = F.pmod(F.xxhash64(F.lit(self.seed), F.lit(epoch)), F.lit(self.records)).alias("k")
            k = self.spark.range(1).select(drawn).first()["k"]
            self._begins = {epoch: self.rows.where(F.col("k") == k).first()["start"], **dict([*self._begins.items()][:RANGES])}
        return self._begins[epoch]

    def ranges(self, first: int, end: int) -> list[tuple[int, int, int]]:
        """Tokens [first, end) of the stream as ranges [a, b) of the corpus, each with what leads from the one to the other."""
        out, at = [], first
        while at < end:
            epoch, within = divmod(at, self.tokens)
            a = (self.begin(epoch) + within) % self.tokens
            b = min(a + end - at, a + self.tokens - within, self.tokens)
            out.append((a, b, at - a))
            at += b - a
        return out

    def batches(self, first: int, end: int) -> DataFrame:
        """batch_id, slot, input_ids, labels, trust of the batches from ``first`` to before ``end``."""
        each = self.batch * self.width
        ranges = self.ranges(first * each, end * each)
        rows = self.rows
        if len(ranges) <= RANGES:  # read what they touch: a record has ``most`` tokens at most
            parts = sorted({p for a, b, _ in ranges for p in range(max(a - self.most, 0) // self.part_tokens, (b - 1) // self.part_tokens + 1)})
            touched = F.lit(False)
            for a, b, _ in ranges:
                touched = touched | ((F.col("start") > a - self.most) & (F.col("start") < b))
            rows = rows.where(F.col("part").isin(parts)).where(touched)
        told = F.from_json(F.lit(json.dumps([{"a": a, "b": b, "shift": s} for a, b, s in ranges])), "array<struct<a: long, b: long, shift: long>>")
        meets = F.filter(told, lambda r: (F.col("start") < r["b"]) & (F.col("start") + F.col("n") > r["a"]))
        rows = self.encode(rows.drop("k", "part")) if self.encode else rows
        rows = rows.select("ids", "trust", "n", "start", F.explode(meets).alias("r"))
        begin, stop = F.greatest("start", "r.a"), F.least(F.col("start") + F.col("n"), F.col("r.b"))
        rows = rows.select("trust", (begin + F.col("r.shift")).alias("at"), F.slice("ids", (begin - F.col("start")).cast("int") + 1, (stop - begin).cast("int")).alias("ids"))
        return batches(self._windows(rows), self.batch, self.length)

    def _windows(self, rows: DataFrame) -> DataFrame:
        """window, tokens, trust. A window within one record is complete at once; only the pieces at the ends of records are grouped."""
        width, end = self.width, F.col("at") + F.size("ids")

        def pieces(windows: Column) -> DataFrame:
            def piece(w: Column) -> Column:
                begin = F.greatest(w * width, F.col("at"))
                stop = F.least((w + 1) * width, end)
                return F.struct(w.alias("window"), begin.alias("at"), F.slice("ids", (begin - F.col("at")).cast("int") + 1, (stop - begin).cast("int")).alias("ids"))

            return rows.select("trust", F.explode(F.transform(windows, piece)).alias("p")).select("p.*", "trust")

        first, last = F.expr(f"(at + {width - 1}) div {width}"), F.expr(f"(at + size(ids)) div {width} - 1")  # whole ones
        inner = F.when(first <= last, F.sequence(first, last))
        ends = F.filter(F.array_distinct(F.array(F.expr(f"at div {width}"), F.expr(f"(at + size(ids) - 1) div {width}"))), lambda w: (w < first) | (w > last))
        grouped = pieces(ends).groupBy("window").agg(F.array_sort(F.collect_list(F.struct("at", "ids", "trust"))).alias("p"))  # ``width`` tokens each
        joined = grouped.select("window", F.flatten(F.transform("p", lambda x: x["ids"])).alias("tokens"), F.col("p")[0]["trust"].alias("trust"))
        return pieces(inner).select("window", F.col("ids").alias("tokens"), "trust").unionByName(joined)

    def start(self, consume: Callable[[DataFrame, int], None], checkpoint: str, per_trigger: int = 64, once: bool = False) -> StreamingQuery:
        """Hand batches to ``consume(batches, micro_batch)``, at most ``per_trigger`` at a time and at most an epoch.

        The next micro-batch begins when ``consume`` returns, so a slow consumer holds the
        stream back. A query started again on ``checkpoint`` goes on with the batch after
        the last micro-batch that was consumed whole; one that was not is given once more,
        with the same number and rows. ``once`` takes one micro-batch and ends.
        """
        rows = max(1, min(per_trigger, self.tokens // (self.batch * self.width)))
        tickets = self.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows).option("numPartitions", 1).load()

        def push(df: DataFrame, micro_batch: int) -> None:
            told = df.agg(F.min("value").alias("first"), F.max("value").alias("last")).first()
            if told["first"] is not None:
                consume(self.batches(told["first"], told["last"] + 1), micro_batch)

        writer = tickets.writeStream.foreachBatch(push).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


def to_folder(path: str) -> Callable[[DataFrame, int], None]:
    """A consumer that writes each micro-batch below ``path``; a repeated one replaces what it wrote before."""
    return lambda df, micro_batch: df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/micro={micro_batch}")
