"""Mixing sources to target weights by Poisson replication.

Every row draws its number of copies from a Poisson distribution whose mean is its
source's repetition rate, by inverting the distribution function at a uniform number
hashed from seed and document: no state, no sampling pass, and the same draw in every
run. A mean over ``PART_RATE`` is the sum of draws of smaller means, so tables stay
short at any rate. Copies are exploded and dealt out by a hash of seed, document and copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.windows import with_ordinal
from quern.storage import Scratch

#: Tables of at most this many rows are broadcast: rates of sources, ids that repeat.
BROADCAST_SOURCES, BROADCAST_IDS = 10_000, 100_000
#: The largest mean of one draw.
PART_RATE = 64
#: Copies of one row that a task makes at a time where the rate is higher than half of it.
BLOCK = 256
SALTS = 64


def hash_unit(*parts: Column) -> Column:
    """A uniform number in [0, 1) with 48 bits, from the MD5 of the parts joined by ':'."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(2**48))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... up to twelve deviations and 30 beyond the mean."""
    last = F.ceil(rate + F.lit(12) * F.sqrt(rate) + F.lit(30)).cast("int")
    start = F.struct(
        (-rate).alias("log_p"), F.exp(-rate).alias("cum"), F.array(F.exp(-rate)).alias("cdf")
    )

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log(rate) - F.log(k.cast("double"))
        cum = acc["cum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), cum.alias("cum"), F.concat(acc["cdf"], F.array(cum)).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"]).otherwise(F.array(F.lit(1.0)))


def repetition_rates(docs: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """source, n_docs, rate, parts, cdf: mean copies per document of each source, as ``parts`` draws by ``cdf``.

    A source of weight w gets w / (sum of weights of the sources present) of as many
    rows as ``docs`` has. Without ``weights`` all sources weigh the same; with them,
    a source that is not named weighs 0 and leaves the mixture.
    """
    sizes = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    if weights is None:
        weighed = sizes.withColumn("w", F.lit(1.0))
    else:
        choice = F.lit(0.0)
        for source, weight in weights.items():
            same = F.col("source").isNull() if source is None else F.col("source") == source
            choice = F.when(same, F.lit(float(weight))).otherwise(choice)
        weighed = sizes.withColumn("w", choice)
    total = weighed.agg(F.sum("w").alias("all_w"), F.sum("n_docs").alias("all_docs"))
    rate = F.coalesce(F.col("w") * F.col("all_docs") / F.nullif(F.col("all_w"), F.lit(0.0)) / F.col("n_docs"), F.lit(0.0))
    rates = weighed.crossJoin(F.broadcast(total)).select("source", "n_docs", rate.alias("rate"))
    rates = rates.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART_RATE), F.lit(1)).cast("int"))
    return rates.withColumn("cdf", poisson_cdf(F.col("rate") / F.col("parts")))


def drawn_copies(seed: int, name: Column) -> Column:
    """The draw of a row with _parts and _cdf: the first part by the name, further ones by name and number."""

    def below(unit: Column) -> Column:
        return F.size(F.filter("_cdf", lambda c: c <= unit))

    def more(total: Column, part: Column) -> Column:
        return total + below(hash_unit(F.lit(f"{seed}"), name, F.lit("part"), part.cast("string")))

    rest = F.aggregate(F.sequence(F.lit(1), F.col("_parts") - 1), F.lit(0), more)
    return below(hash_unit(F.lit(f"{seed}"), name)) + F.when(F.col("_parts") > 1, rest).otherwise(0)


def with_names(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` plus _name, one for each row: the doc_id, with a number where ids repeat or are missing."""
    again = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    again = scratch.save(again.select(F.col("doc_id").alias("_id")), "again")
    name = F.col("doc_id").cast("string")
    n = again.count()
    if not n:
        return rows.withColumn("_name", name)
    ids = again.where("_id is not null")
    ids = F.broadcast(ids) if n <= BROADCAST_IDS else ids
    same = F.col("doc_id") == F.col("_id")
    once = rows.where("doc_id is not null").join(ids, same, "left_anti").withColumn("_name", name)
    more = rows.join(ids, same, "left_semi").unionByName(rows.where("doc_id is null"))
    more = with_ordinal(more.withColumn("_base", F.coalesce(name, F.lit("~"))), ["_base"], [], "_k")
    first = F.col("doc_id").isNotNull() & (F.col("_k") == 0)
    more = more.withColumn("_name", F.when(first, F.col("_base")).otherwise(F.concat_ws("#", "_base", F.col("_k").cast("string"))))
    return once.unionByName(more.drop("_base", "_k"))


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    seed: int = 7,
    partitions: int | None = None,
) -> DataFrame:
    """All columns of ``docs`` plus replica (from 0), rate and shuffle_key, in random order.

    The order of ``shuffle_key`` is the global order; rows are dealt out by it and
    sorted by it within partitions. Every row draws for itself: rows that repeat a
    doc_id, or have none, are told apart by a number in order of a hash of their
    content, so the set of copies is the same in every run. Null sources form a
    source; null and empty texts count like others; an empty table gives an empty
    result. Columns already called replica, rate or shuffle_key are replaced.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in {"replica", "rate", "shuffle_key"}]
    scratch = Scratch(spark, "mix")
    rates = scratch.save(repetition_rates(docs.select("source"), weights), "rates").select(
        F.col("source").alias("_source"), "rate", F.col("parts").alias("_parts"), F.col("cdf").alias("_cdf")
    )
    told = rates.agg(F.count("*"), F.max("rate")).first()
    rows = with_names(docs.select(*kept), scratch)

    def drawn(rates: DataFrame) -> DataFrame:
        same = F.col("source").eqNullSafe(F.col("_source"))
        if told[0] <= BROADCAST_SOURCES:
            joined = rows.join(F.broadcast(rates), same)
        else:
            salted = rates.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("_name"), F.lit(SALTS)).cast("int"))
            joined = dealt.join(salted, same & (F.col("_salt") == F.col("_slot")))
        return joined.withColumn("_copies", drawn_copies(seed, F.col("_name"))).where("_copies > 0")

    def exploded(rows: DataFrame, first: Column, last: Column) -> DataFrame:
        rows = rows.withColumn("replica", F.explode(F.sequence(first, last).cast("array<int>")))
        key = F.md5(F.concat_ws(":", F.lit(f"{seed}"), "_name", F.col("replica").cast("string")))
        return rows.withColumn("shuffle_key", key).select(*kept, "replica", "rate", "shuffle_key")

    often = F.col("rate") > BLOCK // 2
    copies = exploded(drawn(rates.where(~often)), F.lit(0), F.col("_copies") - 1)
    if (told[1] or 0) > BLOCK // 2:  # copies of such a row are made by several tasks
        blocks = F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / BLOCK).cast("int")))
        many = drawn(rates.where(often)).withColumn("_block", blocks).repartition("_name", "_block")
        copies = copies.unionByName(exploded(many, F.col("_block") * BLOCK, F.least((F.col("_block") + 1) * BLOCK, "_copies") - 1))
    width = [partitions] if partitions else []
    return copies.repartition(*width, "shuffle_key").sortWithinPartitions("shuffle_key")
