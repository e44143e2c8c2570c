"""Connected components by alternating large-star and small-star over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.skew import least_common
from quern.storage import Scratch


def _star(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows u, v with m, the least v of their u; and w, m of each u.

    Nodes with more than ``limit`` rows, the centres of large stars, are fewer than
    10,000 (see ``skew``): their m is broadcast, and their rows never meet in a task.
    """
    found = rows.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"), F.count("*").alias("n"))
    busy = F.broadcast(found.where(F.col("n") > limit).select("w", "m"))
    rest = rows.join(busy.select(F.col("w").alias("_w")), F.col("u") == F.col("_w"), "left_anti")
    same = F.col("u") == F.col("w")
    near = rows.join(busy, same).select("u", "v", "m").union(rest.join(found, same).select("u", "v", "m"))
    return near, found.select("w", "m")


def _large_star(edges: DataFrame, limit: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near, _ = _star(both, limit)
    return near.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, limit: int) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    near, least = _star(down, limit)
    return near.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))


def _settled(edges: DataFrame) -> bool:
    """Whether edges u > v are stars already: each u once, and no u a v. Counted in one shuffle."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.union(edges.select(F.col("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    roles = ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return roles.where("below > 1 or (below > 0 and above > 0)").isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, root (the least node of its component) for every node that is not its own root.

    ``edges`` has long columns u and v; loops, repeated edges and null ends change
    nothing. Both steps of a round are written to ``scratch``, until stars are left; only
    a count and an answer come to the driver for each round.
    """
    both = edges.where("u is not null and v is not null")  # greatest and least pass over nulls
    down = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    now, turn = scratch.save(down.distinct(), f"{name}-0"), 0
    while not _settled(now):
        turn, limit = turn + 1, least_common(2 * now.count())
        mid = scratch.save(_large_star(now, limit).distinct(), f"{name}-mid")
        now = scratch.save(_small_star(mid, limit).distinct(), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}", f"{name}-mid")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
