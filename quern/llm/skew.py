"""Joins on keys of which some may be very common.

A key that more than one in ``KEYS`` rows has is common, so there are fewer than
``KEYS`` common keys however large the table is: their list may be broadcast. Rows of
a common key are dealt over several ways, and what they are joined with is repeated
once for each way; all other rows are joined as usual. No row is dropped or capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = 10_000
#: Fewer rows of a key than this are never worth dealing out.
FLOOR = 100


def least_common(total: int) -> int:
    """Keys with more rows than this, of ``total``, are common."""
    return max(FLOOR, total // KEYS)


def common_keys(counts: DataFrame, keys: list[str], n: str, total: int) -> DataFrame | None:
    """keys and _ways of the common ones among ``counts`` (one row for each key); None if there are none.

    Their list, which is bounded, passes through the driver.
    """
    limit = least_common(total)
    if total <= limit:
        return None
    ways = F.ceil(F.col(n) / limit).cast("int").alias("_ways")
    wanted = counts.where(F.col(n) > limit).select(*keys, ways)
    found = wanted.toArrow()
    return counts.sparkSession.createDataFrame(found, wanted.schema) if found.num_rows else None


def common_in(rows: DataFrame, keys: list[str], total: int) -> DataFrame | None:
    """``common_keys`` of ``rows``, counted here."""
    return common_keys(rows.groupBy(*keys).agg(F.count("*").alias("_n")), keys, "_n", total)


def _same(pairs: list[tuple[str, str]]) -> Column:
    out = F.lit(True)
    for a, b in pairs:
        out = out & (F.col(a) == F.col(b))
    return out


def _listed(common: DataFrame) -> tuple[DataFrame, list[str]]:
    """The common keys under names of their own, to be broadcast."""
    keys = common.columns[:-1]
    names = [f"_c{i}" for i in range(len(keys))]
    return F.broadcast(common.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), "_ways")), names


def dealt(rows: DataFrame, common: DataFrame | None, by: list[str], salt: str = "_salt") -> DataFrame:
    """``rows`` plus the way that each takes: a hash of ``by`` where its key is common, else 0."""
    if common is None:
        return rows.withColumn(salt, F.lit(0))
    listed, names = _listed(common)
    way = F.pmod(F.xxhash64(*by), F.col("_ways").cast("long")).cast("int")
    found = rows.join(listed, _same([*zip(common.columns[:-1], names, strict=True)]), "left")
    return found.withColumn(salt, F.when(F.col("_ways").isNotNull(), way).otherwise(0)).drop("_ways", *names)


def repeated(rows: DataFrame, common: DataFrame | None, keys: list[str], slot: str = "_slot") -> DataFrame:
    """``rows``, with ``keys`` named in the order of ``common``, once for each way that their key is dealt over."""
    if common is None:
        return rows.withColumn(slot, F.lit(0))
    listed, names = _listed(common)
    found = rows.join(listed, _same([*zip(keys, names, strict=True)]), "left")
    return found.withColumn(slot, F.explode(F.sequence(F.lit(0), F.coalesce("_ways", F.lit(1)) - 1))).drop("_ways", *names)


def dealt_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], common: DataFrame | None, by: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` where left and right columns of ``on`` are equal; names must differ.

    Rows of ``left`` with a key in ``common`` (named as on the left) are dealt by a hash
    of the columns ``by``; ``right``, which has few rows for each key, is repeated.
    """
    if common is None:
        return left.join(right, _same(on), how)
    there = dict(on)
    right = repeated(right, common, [there[k] for k in common.columns[:-1]])
    return dealt(left, common, by).join(right, _same([*on, ("_salt", "_slot")]), how).drop("_salt", "_slot")
