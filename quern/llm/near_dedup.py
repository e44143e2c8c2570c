"""MinHash near-dedup: banding, signature verification, exact confirmation, components.

1. Every text becomes the set of its distinct word shingles (64-bit hashes). Texts of
   equal sets collapse to one node; nodes are numbered by least doc_id.
2. Universal hash minima form bands, as many and as wide as the threshold needs: at 0.8
   there are 54 bands of 6, and two sets of that similarity share none of them with
   probability (1 - 0.8^6)^54 = 7e-8. ``banding`` keeps that below 1e-7 for others.
3. In each bucket every member is compared with the least one (a star, not pairs).
   A pair is confirmed on the full sets if sizes and one-bit signatures allow it.
4. Links give components. Buckets that still span several components compare their
   members outside the largest one with a few of its members, drawn by hash.
5. Buckets that span several components even then are searched whole, in blocks: each
   member outside the largest component against all members of others, in the first
   bucket that both share; small sets exactly, others by signature first. Dense groups
   are one component by then and cost nothing more.
6. Components of all links.

One-bit signatures (a bit of each of 2,048 further minima, of sets that share a bucket)
only rule pairs out: at similarity 0.8 a pair differs in 205 bits on average with
deviation 13.6. Beyond 95 of the first 512 or 293 of all it is dropped (six and a half
deviations), which befalls a pair at the threshold with probability 2e-9 in all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.rows import Columns, map_rows
from quern.llm.skew import common_in, common_keys, dealt, dealt_join, repeated
from quern.storage import Scratch

BITS, DEVIATIONS = 2048, 6.5
#: The chance that two sets at the threshold share no band, at most.
LOST = 1e-7
#: Draws of members of a bucket's largest component.
DRAWS = 16
#: Members of a bucket that are compared in one task, about, where a bucket is searched whole.
BLOCK_ROWS = 512
#: Sets of at most so many elements are compared exactly, not by signature, where buckets are searched whole.
SMALL = 128
_BLOCK = 4096
_P = np.uint64(0x9E3779B97F4A7C15)


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows of a band: about a quarter of the pairs at the threshold meet in each band."""
    share = percent / 100
    if share >= 1:
        return 1, 6
    rows = max(1, round(math.log(0.8**6) / math.log(share))) if share > 0 else 1
    return max(1, math.ceil(math.log(LOST) / math.log1p(-(share**rows)))) if share > 0 else 1, rows


@cache
def _hashes(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and offsets of n universal hash functions."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than ``words`` make one shingle, none make none.

    Words are runs without the characters x20 and x09 to x0D, A-Z lower-cased.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in found], np.uint64)
    span = min(words, len(h))
    out = np.full(len(h) - span + 1, span, np.uint64)
    for i in range(span):
        out = mixed(out * _P + h[i : len(h) - span + 1 + i])
    return np.unique(out)


def minima(found: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = _BLOCK) -> np.ndarray:
    """The least value of each hash function a * x + b over a non-empty set."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), block):
        part = a[:, None] * x[None, at : at + block] + b[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return best


def band_keys(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    best = minima(found, *_hashes(bands * rows, 20240229)).reshape(bands, rows).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        key = mixed(key * _P + best[:, i])
    return key.view(np.int64)


def signature(found: np.ndarray) -> np.ndarray:
    """``BITS`` bits, each a mixed bit of another minimum, as longs."""
    best = minima(found, *_hashes(BITS, 29022024), 512) * np.uint32(0x9E3779B1)
    return np.packbits((best >> np.uint32(31)).astype(np.uint8)).view(np.int64)


def _digest(found: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64).tolist())


SKETCH = "doc_id long, text_key long, n_shingles long, set_a long, set_b long, bands array<long>"


def _sketches(batches: Iterator[Columns], words: int, bands: int, width: int) -> Iterator[list[tuple]]:
    for batch in batches:
        rows = []
        for doc, key, text in zip(batch["doc_id"], batch["text_key"], batch["text"], strict=True):
            found = shingles(text, words)
            if len(found):
                rows.append((doc, key, len(found), *_digest(found), band_keys(found, bands, width)))
            else:
                rows.append((doc, key, 0, None, None, None))
        yield rows


SETS = "node long, size long, bits array<long>, elements binary, small array<long>"


def _sets(batches: Iterator[Columns], words: int) -> Iterator[list[tuple]]:
    """The sets of nodes; texts that share a node's doc_id but not its set are passed over."""
    for batch in batches:
        rows = []
        for node, a, b, text in zip(batch["node"], batch["set_a"], batch["set_b"], batch["text"], strict=True):
            found = shingles(text, words)
            if len(found) and _digest(found) == (a, b):
                small = found.view(np.int64) if len(found) <= SMALL else None
                rows.append((node, len(found), signature(found), found.tobytes(), small))
        yield rows


def _confirmed(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = []
        for a, b in zip(batch["set_u"], batch["set_v"], strict=True):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.loc[np.array(keep, bool), ["u", "v"]]


def _may_link(percent: int):
    """Sizes and signatures of sides a and b allow the similarity."""
    sizes = 100 * F.least("a.size", "b.size") >= percent * F.greatest("a.size", "b.size")
    share = (1 - percent / 100) / 2

    def within(longs: int):
        """The first so many longs differ in no more bits than chance explains."""
        n, apart = 64 * longs, F.lit(0)
        for i in range(longs):
            apart = apart + F.bit_count(F.col("a.bits")[i].bitwiseXOR(F.col("b.bits")[i]))
        return apart <= int(n * share + DEVIATIONS * max(1.0, (n * share * (1 - share)) ** 0.5))

    return sizes & within(8) & within(BITS // 64)


#: What each row of the input is told.
RESULT = ("doc_id", "n_shingles", "component_id", "kept", "text_key", "group", "first")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """``RESULT``: one row per row of ``docs`` (doc_id, text).

    Documents are linked where 100 * |A and B| >= percent * |A or B| over their sets of
    ``words``-word shingles (percent from 1 to 100). component_id is the least doc_id
    reachable; kept marks it. group names the component among sets, and first marks
    rows of its least doc_id and that one's least set; text_key is xxhash64 of the text.

    Null and wordless texts have n_shingles 0 and are linked with nothing. Rows with a
    null doc_id are counted but not linked: component_id null, kept true. Both have no
    group. Rows that repeat a doc_id each follow their own text: the id links nothing.
    Other columns are not used. An empty table gives an empty result.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "near-dedup")
    bands, width = banding(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    sketched = scratch.save(map_rows(keyed, lambda it: _sketches(it, words, bands, width), SKETCH), "sketches")

    linkable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    linked = sketched.where(linkable)
    # Equal sets have equal bands, signatures and sizes: they are one node, numbered in order of least doc_id.
    named = linked.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"))
    named = scratch.save(named.orderBy("rep", "set_a", "set_b").withColumn("node", F.monotonically_increasing_id()), "named")
    own = named.select(F.col("set_a").alias("_a"), F.col("set_b").alias("_b"), "rep", "node")
    same = (F.col("set_a") == F.col("_a")) & (F.col("set_b") == F.col("_b")) & (F.col("doc_id") == F.col("rep"))
    reps = scratch.save(linked.join(own, same).dropDuplicates(["_a", "_b", "rep"]).select("node", "bands"), "reps")

    rows = reps.select("node", F.explode("bands").alias("bucket"))
    centres = rows.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1")
    centres = scratch.save(centres.withColumnRenamed("bucket", "_bucket"), "centres")
    full = common_keys(centres.withColumnRenamed("_bucket", "bucket"), ["bucket"], "n", bands * reps.count())
    in_bucket = [("bucket", "_bucket")]
    members = dealt_join(rows, centres.drop("n"), in_bucket, full, ["node"])
    members = scratch.save(members.select("bucket", "node", "centre"), "members")

    asked = members.select(F.col("node").alias("_n")).distinct().join(named, F.col("_n") == F.col("node"))
    asked = scratch.save(asked.select("node", "rep", "set_a", "set_b"), "asked")
    texts = docs.join(asked.hint("shuffle_hash"), F.col("doc_id") == F.col("rep")).select("node", "set_a", "set_b", "text")
    sets = scratch.save(map_rows(texts, lambda it: _sets(it, words), SETS), "sets")
    if sets.count() > asked.count():  # rows repeat both doc_id and text
        sets = scratch.save(sets.dropDuplicates(["node"]), "sets-once")
    may = _may_link(percent)

    def links(pairs: DataFrame, name: str, often: tuple[str, ...] = ("v",), tested: bool = False) -> DataFrame:
        """The pairs u, v that reach the threshold on their full sets, ``tested`` ones by sizes and signatures already.

        Ends not in ``often`` have as many pairs as bands at most.
        """
        pairs = scratch.save(pairs.distinct(), f"{name}-pairs")
        total = pairs.count()
        if not total:
            return pairs
        busy = {c: common_in(pairs, [c], total) if c in often else None for c in ("u", "v")}
        pairs = dealt(dealt(pairs, busy["u"], ["v"], "way_u"), busy["v"], ["u"], "way_v")

        def with_side(rows: DataFrame, end: str, what, as_: str) -> DataFrame:
            side = repeated(sets.select(F.col("node").alias("_n"), what.alias(as_)), busy[end], ["_n"])
            same = F.col(end) == F.col("_n")
            return rows.join(side, same if busy[end] is None else same & (F.col(f"way_{end}") == F.col("_slot"))).drop("_n", "_slot")

        brief, elements = F.struct("size", "bits"), F.col("elements")
        near = pairs if tested else with_side(with_side(pairs, "u", brief, "a"), "v", brief, "b").where(may).select("u", "v", "way_u", "way_v")
        whole = with_side(with_side(near, "u", elements, "set_u"), "v", elements, "set_v")
        found = whole.select("u", "v", "set_u", "set_v").mapInPandas(lambda it: _confirmed(it, percent), "u long, v long")
        return scratch.save(found, f"{name}-links")

    def split(roots: DataFrame, name: str) -> DataFrame:
        """bucket, node, root, main, n of buckets that span components; main is the largest one's root."""
        placed = members.select("bucket", "node").join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
        placed = scratch.save(placed.select("bucket", "node", F.coalesce("root", "node").alias("root")), f"placed-{name}")
        counted = placed.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy(F.col("bucket").alias("_bucket"))
        mains = counted.agg(F.count("*").alias("roots"), F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n")).where("roots > 1")
        open_ = dealt_join(placed, mains.select("_bucket", F.col("most.root").alias("main"), "n"), in_bucket, full, ["node"])
        return open_.select("bucket", "node", "root", "main", "n")

    def up(roots: DataFrame) -> DataFrame:
        return roots.select(F.col("node").alias("u"), F.col("root").alias("v"))

    stars = members.where("node <> centre").select(F.col("node").alias("u"), F.col("centre").alias("v"))
    roots = components(links(stars, "star"), scratch, "first")

    open_ = scratch.save(split(roots, "first"), "open-first")
    draw = F.xxhash64("node", F.pmod("bucket", F.lit(DRAWS)))
    drawn = open_.where("root = main").groupBy(F.col("bucket").alias("_bucket")).agg(F.min(F.struct(draw.alias("h"), "node")).alias("d"))
    drawn = drawn.select("_bucket", F.col("d.node").alias("v"))
    pairs = dealt_join(open_.where("root <> main"), drawn, in_bucket, full, ["node"]).select(F.col("node").alias("u"), "v")
    roots = components(links(pairs, "drawn").union(up(roots)), scratch, "second")

    brief = sets.select(F.col("node").alias("_n"), "size", "bits", "small").join(reps.withColumnRenamed("node", "_m"), F.col("_n") == F.col("_m"))
    open_ = split(roots, "second").join(brief, F.col("node") == F.col("_n")).drop("_n", "_m")
    open_ = open_.withColumn("ways", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
    open_ = scratch.save(open_.withColumn("slot", F.pmod(F.xxhash64("node"), F.col("ways").cast("long")).cast("int")), "open")
    all_ways = F.explode(F.sequence(F.lit(0), F.col("ways") - 1))
    a = open_.where("root <> main").withColumn("other", all_ways).alias("a")
    b = open_.withColumn("other", all_ways).alias("b")
    met = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.slot") == F.col("b.other")) & (F.col("a.other") == F.col("b.slot"))
    once = (F.col("b.root") == F.col("b.main")) | (F.col("a.node") < F.col("b.node"))
    earliest = F.array_min(F.array_intersect("a.bands", "b.bands")) == F.col("a.bucket")
    both = F.size(F.array_intersect("a.small", "b.small"))
    exact = F.col("a.small").isNull() | F.col("b.small").isNull() | (100 * both >= percent * (F.col("a.size") + F.col("b.size") - both))
    rest = a.join(b, met & (F.col("a.root") != F.col("b.root")) & once & may & exact & earliest)
    rest = rest.select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    roots = components(links(rest, "rest", ("u", "v"), tested=True).union(up(roots)), scratch, "all")

    busy = common_in(roots, ["root"], roots.count())
    least = named.select(F.col("node").alias("_n"), F.col("rep").alias("least"))
    placed = dealt_join(roots, least, [("root", "_n")], busy, ["node"]).select(F.col("node").alias("_m"), "root", "least")
    renamed = named.join(placed, F.col("node") == F.col("_m"), "left").select(
        F.col("set_a").alias("_a"), F.col("set_b").alias("_b"), "rep", F.coalesce("root", "node").alias("group"),
        F.coalesce("least", "rep").alias("component_id"), F.col("root").isNull().alias("_top"),
    )
    full_sets = common_keys(named, ["set_a", "set_b"], "rows", linked.count())
    told = dealt_join(linked.drop("bands"), renamed, [("set_a", "_a"), ("set_b", "_b")], full_sets, ["doc_id", "text_key"])
    told = told.withColumn("kept", F.col("doc_id") == F.col("component_id")).withColumn("first", F.col("_top") & (F.col("doc_id") == F.col("rep")))
    alone = sketched.where(~linkable).select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "text_key",
        F.lit(None).cast("long").alias("group"), F.lit(False).alias("first"),
    )
    done = scratch.save(told.select(*RESULT).unionByName(alone), "result")
    scratch.drop("sketches", "named", "reps", "centres", "members", "asked", "sets", "sets-once", "open")
    scratch.drop("placed-first", "open-first", "placed-second")
    for name in ("star", "drawn", "rest"):
        scratch.drop(f"{name}-pairs", f"{name}-links")
    return done
