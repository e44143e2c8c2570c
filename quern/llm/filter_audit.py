"""How filters interact: what each removes, at every place of every order.

Documents become bit masks of the filters that they fail, and masks are counted in
cells (part, mask). Cells are unpivoted against the steps of all orders; a running
bit-or over the steps before tells earlier failures, conditional sums over cells give
the counts of a step, and a total over each filter's rows its Shapley sum. Texts are
read once; after that only cells move.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.skew import common_in, dealt_join
from quern.storage import Scratch

FILTERS = "ABCDE"
#: The filter that looks at other documents: copies of a text with a smaller id.
COPIES = "E"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def bit(name: str, filters: str = FILTERS) -> int:
    return 1 << filters.index(name)


def own_failures() -> Column:
    """The mask of the filters that need a text alone, of rows with _n, _distinct, _capitals, _points and _signs."""
    tests = {
        "A": F.col("_n") < LEAST_WORDS,
        "B": F.col("_distinct") * 100 < F.col("_n") * LEAST_DISTINCT,
        "C": F.col("_capitals") * 100 > F.col("_points") * MOST_CAPITALS,
        "D": F.col("_signs"),
    }
    return sum((F.when(t, bit(k)).otherwise(0) for k, t in tests.items()), F.lit(0))


def masked(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (without ``COPIES``) and digest of each row; null texts are empty, null sources the part ''."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("_t"))
    words = F.array_remove(F.split("_t", r"[\x20\x09-\x0D]"), "")
    rows = rows.select(
        "doc_id", "part", F.unhex(F.sha2("_t", 256)).alias("digest"), words.alias("_w"), F.length("_t").cast("long").alias("_points"),
        F.length(F.regexp_replace("_t", "[^A-Z]+", "")).cast("long").alias("_capitals"), F.col("_t").rlike("[#$%&*|]").alias("_signs"),
    )
    n, distinct = F.size("_w").cast("long"), F.size(F.array_distinct("_w")).cast("long")
    rows = rows.withColumn("_n", n).withColumn("_distinct", distinct)
    return rows.select("doc_id", "part", own_failures().alias("mask"), "digest")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` plus good and toxic: whether any label of the doc_id says so. Common ids are dealt out, null ones have no label."""
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    named = rows.where("doc_id is not null")
    common = common_in(named, ["doc_id"], rows.count())
    found = dealt_join(named, told, [("doc_id", "_id")], common, ["digest"], "left").drop("_id")
    none = F.lit(None).cast("boolean")
    found = found.unionByName(rows.where("doc_id is null").select("*", none.alias("good"), none.alias("toxic")))
    return found.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: the rows of each mask in each source, and how many of them are labelled so.

    A row fails ``COPIES`` if its text is that of a smaller doc_id anywhere in the
    table; repeated rows of the smallest id do not, nor do rows without an id. Copies
    are counted by text, part and label before they meet, so a text that very many rows
    share is a few rows. Null texts are empty texts, null sources the part ``''``;
    other columns are not used; an empty table has no cells.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    rows = labelled(scratch.save(masked(docs), "masks"), labels)
    keys = ["digest", "mask", "part", "good", "toxic"]
    # Rows of an id are counted first, so that those of the smallest one are known.
    ids = rows.groupBy(*keys, "doc_id").agg(F.count("*").alias("k"))
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "k"))
    cells = ids.groupBy(*keys).agg(F.sum("k").alias("n"), F.min(named).alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("k")).otherwise(0)).alias("unnamed"))
    first = F.min("first.doc_id").over(W.partitionBy("digest"))
    cells = cells.withColumn("sound", F.col("unnamed") + F.when(F.col("first.doc_id") == first, F.col("first.k")).otherwise(0))
    halves = F.array(
        F.struct(F.col("mask"), F.col("sound").alias("n")),
        F.struct((F.col("mask") + bit(COPIES)).alias("mask"), (F.col("n") - F.col("sound")).alias("n")),
    )
    cells = cells.select("part", "good", "toxic", F.inline(halves)).where("n > 0")
    return cells.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )


def interactions(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step (from 1), ``METRICS`` and shapley: a row for each part, order of ``filters`` and step.

    ``cells`` has part, mask, n, good and toxic; bit i of a mask is the i-th filter's,
    one letter each. At a step, kept counts what no filter so far has failed, removed
    what this one is the first to fail, redundant what it fails after another,
    unique_fails what only it fails; shapley is its removed over all orders. Every part
    of ``cells`` has all its rows, zeros included; repeated cells add up. A part has
    len(filters)! * len(filters) rows for each of its masks on the way.
    """
    orders = ",".join("".join(p) for p in permutations(filters))
    rows = cells.withColumn("filter_order", F.explode(F.split(F.lit(orders), ",")))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    rows = rows.withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    rows = rows.withColumn("bit", F.expr(f"shiftleft(1, instr('{filters}', filter) - 1)"))
    rows = rows.withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    before = W.partitionBy("part", "mask", "filter_order").orderBy("step").rangeBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))

    fails, first = F.col("fails") != 0, F.col("earlier") == 0

    def total(when: Column, what: str = "n") -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0))

    told = rows.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & first).alias("kept"), total(fails & first).alias("removed"), total(fails & ~first).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(fails & first, "good").alias("good_lost"), total(fails & first, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(W.partitionBy("part", "filter"))
    return told.select("part", "filter_order", "step", *METRICS, shapley.alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``interactions`` of the five filters over all of ``docs`` (doc_id, text, source) and ``labels`` (doc_id, quality, toxic)."""
    return interactions(mask_cells(docs, labels))
