"""The corpus builder: from raw sources to one deduplicated, mixed and validated table of records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import windows as W
from quern.sources import catalog, jsonl
from quern.sources.catalog import Source
from quern.storage import Scratch

#: Columns of raw records that texts are extracted from; those that a source lacks are null.
FIELDS = ("text", "content", "problem", "question", "solution", "generated_solution", "lang")


def source_texts(records: DataFrame, source: Source, most: int | None = None, skip: int = 0) -> DataFrame:
    """ord, txt: a source's texts in the order in which it is read.

    ``records`` has ord and any of ``FIELDS``, score and conversations. The first
    ``skip`` records are passed over; then come the score filter (a missing score is 0;
    only where the source has a threshold), extraction by the source's format, the least
    length, and the first ``most`` texts that are left.
    """
    if skip > 0:
        records = W.skip_first(records, ["ord"], skip)
    if source.min_score > 0:
        score = F.coalesce("score", F.lit(0.0)) if "score" in records.columns else F.lit(0.0)
        records = records.where(score >= source.min_score)
    record: dict[str, Column] = {c: F.col(c) for c in FIELDS if c in records.columns}
    if "conversations" in records.columns:
        record["turns"] = F.col("conversations")
    texts = records.select("ord", T.extract(F.lit(source.fmt), record).alias("txt")).where(F.length("txt") >= T.MIN_CHARS)
    return texts if most is None else W.take_first(texts, ["ord"], most)


@dataclass(frozen=True)
class Built:
    """The records of a build, and what is to be said of them."""

    records: DataFrame  #: name, ord, window, k, slot, input_ids, labels, trust_score, source
    stats: DataFrame  #: name, n_records, n_tokens of the sources that were read

    def by_group(self) -> DataFrame:
        """source, n_records, pct of each group in the catalogue's order, empty ones too."""
        told = catalog.with_catalogue(self.stats).groupBy("group").agg(F.sum("n_records").alias("n"))
        fixed = self.stats.sparkSession.createDataFrame([*enumerate(catalog.GROUPS)], "ord int, source string")
        rows = fixed.join(told, F.col("source") == F.col("group"), "left").select("ord", "source", F.coalesce("n", F.lit(0)).alias("n_records"))
        total = rows.agg(F.sum("n_records").alias("_all"))
        pct = F.when(F.col("_all") > 0, F.col("n_records") * 100.0 / F.col("_all")).otherwise(0.0)
        return rows.crossJoin(F.broadcast(total)).select("ord", "source", "n_records", pct.alias("pct"))

    def totals(self) -> DataFrame:
        """n_records, n_tokens and tokens of a record, over all sources."""
        n, t = F.coalesce(F.sum("n_records"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))
        return self.stats.agg(n.alias("n_records"), t.alias("n_tokens"), F.when(n > 0, t / n).alias("mean_tokens"))


def flaws(records: DataFrame, vocab: int, length: int) -> DataFrame:
    """The records that a build must not give: see ``windows.validate``; also those of no known group."""
    judged = W.validate(records, vocab, length)
    known = F.col("source").isin([*catalog.GROUPS])
    return judged.withColumn("problem", F.coalesce("problem", F.when(~known, "group"))).where("problem is not null")


def build(
    readers: dict[str, DataFrame],
    encode: Callable[[DataFrame], DataFrame],
    n_samples: int,
    vocab: int,
    length: int,
    seed: int,
    sort: bool = False,
    sources: tuple[Source, ...] = catalog.SOURCES,
) -> Built:
    """Records of all sources in catalogue order, deduplicated, within quotas, shuffled into each other.

    ``readers`` has raw records by stream, ``encode`` puts ids in place of txt. A group
    gets its share of ``n_samples``; a source of it gets its scaled cap or what is left,
    of no more texts than its bound. A window counts as seen once it is emitted: what a
    full quota leaves out may come from a later source. What is emitted is written
    source by source; only its number comes to the driver, which the next quota needs.
    Slots shuffle sources into each other; ``sort`` orders by difficulty instead, equal
    ones by slot. A record that ``flaws`` finds is an error.
    """
    missing = [name for name, ok in catalog.verify(readers, sources).items() if not ok]
    if missing:
        raise ValueError(f"sources without records: {', '.join(missing)}")
    spark = next(iter(readers.values())).sparkSession
    scratch, order = Scratch(spark, "build"), ["ord", "window", "_t"]
    targets, done, whole = catalog.group_targets(n_samples), None, None
    written = dict.fromkeys(targets, 0)
    for source in sources:
        left = targets[source.group] - written[source.group]
        target = catalog.source_target(source, n_samples, left) if left > 0 else 0
        if target <= 0:
            continue
        texts = source_texts(readers[source.read_from], source, catalog.text_bound(source, target), catalog.source_skip(source, n_samples))
        rows = W.token_windows(encode(texts.withColumn("txt", F.substring("txt", 1, T.MAX_CHARS))), length)
        rows = rows.withColumn("trust_score", F.lit(float(source.trust))).withColumn("source", F.lit(source.group))
        rows = W.validate(rows, vocab, length).where("problem is null").drop("problem")
        reach = F.lit(True)
        # Steps carry a row's number, order and digest; whole rows are fetched at the end.
        rows = rows.select("*", W.difficulty(F.col("input_ids")).alias("difficulty"), W.prefix_digest(F.col("input_ids")).alias("_p"), F.xxhash64(*rows.columns).alias("_t"))
        rows = rows.withColumn("_m", F.array_position("labels", W.IGNORE) - 2).drop("labels")  # ids of the piece: labels are made of these again
        rows = scratch.save(rows.withColumn("name", F.lit(source.name)).withColumn("_row", F.monotonically_increasing_id()), f"windows-{source.name}")
        fresh = W.first_by(rows.select("name", *order, "_row", "_p"), "_p", order)
        if done is not None:
            fresh = fresh.join(done.select(F.col("_p").alias("_seen")), F.col("_p") == F.col("_seen"), "left_anti")
        step = scratch.save(fresh, f"fresh-{source.name}")
        n = step.count()
        if n > target:
            step, n = scratch.save(W.take_first(step, order, target), f"step-{source.name}"), target
            reach = W.reaches(step, "ord")
        rows = rows.where(reach)
        whole = rows if whole is None else whole.unionByName(rows, allowMissingColumns=True)
        written[source.group] += n
        done = step if done is None else done.unionByName(step)
    mixed = W.interleave(done.select(F.col("name").alias("source"), *order, "_row"), seed, order)
    chosen = mixed.select(F.col("source").alias("_name"), F.col("_row").alias("_chosen"), "k", "slot")
    records = whole.join(chosen, (F.col("name") == F.col("_name")) & (F.col("_row") == F.col("_chosen"))).drop("_name", "_chosen", "_row", "_p", "_t")
    labels = F.concat(F.slice("input_ids", F.lit(2), F.col("_m").cast("int")), F.array(F.lit(W.EOS)), F.array_repeat(F.lit(W.IGNORE), (length - 1 - F.col("_m")).cast("int")))
    records = scratch.save(records.withColumn("labels", labels).drop("_m"), "records")
    bad = flaws(records, vocab, length).groupBy("problem").agg(F.count("*").alias("n")).collect()  # a row for each kind
    if bad:
        raise ValueError(f"flawed records: {dict(map(tuple, bad))}")
    real = F.size(F.filter("input_ids", lambda x: x != 0)).cast("long")
    stats = records.groupBy("name").agg(F.count("*").alias("n_records"), F.sum(real).alias("n_tokens"))
    return Built(records.orderBy("difficulty", "slot") if sort else records.orderBy("slot"), stats)


def build_to(path: str, readers: dict[str, DataFrame], encode: Callable[[DataFrame], DataFrame], n_samples: int, vocab: int, length: int, seed: int, sort: bool = False) -> Built | None:
    """``build`` written to ``path`` as JSON lines; None, and nothing done, where that has as many records already."""
    spark = next(iter(readers.values())).sparkSession
    if jsonl.enough(spark, path, n_samples):
        return None
    built = build(readers, encode, n_samples, vocab, length, seed, sort)
    jsonl.write(built.records, path)
    return built


def source_mix(records: DataFrame) -> DataFrame:
    """source, n: how many records each source has, by source."""
    return records.groupBy("source").agg(F.count("*").alias("n")).orderBy("source")


def missing_tags(records: DataFrame, order: list[str], first: int = 1_000) -> DataFrame:
    """missing: the groups that the first records do not have, joined by commas."""
    head = W.take_first(records.select(*order, "source"), order, first)
    wanted = F.array(*(F.lit(g) for g in catalog.GROUPS))
    return head.agg(F.array_join(F.array_sort(F.array_except(wanted, F.collect_set("source"))), ",").alias("missing"))
