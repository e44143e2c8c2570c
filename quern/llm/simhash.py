"""SimHash near-dedup by covering locality-sensitive hashing.

A text's fingerprint is the bitwise majority of the hashes of its word shingles. Bits
are given the non-zero vectors of ``radius`` + 1 bits in turn; the mask of a vector v
keeps the bits whose vectors have an odd product with v. Any ``radius`` bits leave some
v orthogonal to all their vectors, so two fingerprints within the radius agree on the
whole of its mask: every such pair collides in a table, for certain (2^(radius+1) - 1
tables; at radius 2, seven tables of 36 or 37 bits).

Fingerprints that meet another one in a table are confirmed there without comparing
pairs: two are at most two bits apart if and only if some point is at most one bit from
both, and within a table that point differs from them in bits outside the mask only.
So each member names its points, and members that share a point are linked to the
least of them. A point has no more members than it has bits outside the mask, plus
itself: however large a bucket is, no task sees more than that of it at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.rows import Columns, map_rows
from quern.llm.skew import common_in, common_keys, dealt_join
from quern.storage import Scratch

BITS, RADIUS = 64, 2
#: Shingle hashes that are counted at a time.
_BLOCK = 1 << 15
_ALL = (1 << BITS) - 1


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def masks(radius: int = RADIUS) -> list[int]:
    """Masks of ``BITS`` bits of which one at least has none of any ``radius`` bits."""
    vectors = [1 + i % ((1 << radius + 1) - 1) for i in range(BITS)]
    return [sum(((v & m).bit_count() & 1) << i for i, m in enumerate(vectors)) for v in range(1, 1 << radius + 1)]


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Bits set in over half of the shingles' XXH64, repeats included; fewer words than ``words`` are one shingle, none give 0.

    Words are runs without the characters x20 and x09 to x0D, A-Z lower-cased.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    span = min(words, len(found))
    total, counts = len(found) - span + 1, np.zeros(BITS, np.int64)
    for at in range(0, total, _BLOCK):
        own = found[at : at + _BLOCK + span - 1]
        hashes = [xxhash.xxh64_intdigest(b" ".join(s), seed) for s in zip(*(own[i:] for i in range(span)))]  # noqa: B905
        counts += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fingerprint (a long) of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[Columns]) -> Iterator[list[tuple]]:
        for batch in batches:
            yield [(d, _signed(fingerprint(t, words))) for d, t in zip(batch["doc_id"], batch["text"], strict=True)]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(rows, run, "doc_id long, fingerprint long")


def _structs(options: list[tuple[int, int]]) -> Column:
    """A choice of the table, with its mask."""
    return F.array(*(F.struct(F.lit(t).alias("table"), F.lit(_signed(m)).alias("mask")) for t, m in options))


def links(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """u, v: pairs of different ``nodes`` (a column ``node``, each once) at most two bits apart, enough to connect all such pairs."""
    tables = list(enumerate(masks(RADIUS)))
    rows = nodes.select("node", F.inline(_structs(tables))).select("node", "table", F.col("node").bitwiseAND(F.col("mask")).alias("key"))
    sizes = rows.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    open_ = scratch.save(sizes, "open")
    total = open_.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = common_keys(open_, ["table", "key"], "n", total)
    there = open_.select(F.col("table").alias("_table"), F.col("key").alias("_key"))
    members = dealt_join(rows, there, [("table", "_table"), ("key", "_key")], common, ["node"]).select("table", "node")
    # The points of a member: itself, and each bit outside the mask turned.
    turned = [[_signed(1 << i) for i in range(BITS) if not m >> i & 1] for _, m in tables]
    flips = F.element_at(F.array(*(F.array(*map(F.lit, [0, *bits])) for bits in turned)), F.col("table") + 1)
    points = members.select("table", "node", F.explode(flips).alias("flip"))
    points = points.groupBy("table", F.col("node").bitwiseXOR(F.col("flip")).alias("point")).agg(F.collect_list("node").alias("near"))
    near = points.where(F.size("near") > 1).select(F.array_min("near").alias("v"), F.explode("near").alias("u"))
    return scratch.save(near.where("u <> v").select("u", "v").distinct(), "links")


def near_fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id of every row of ``docs`` (doc_id, text).

    Fingerprints at most ``RADIUS`` bits apart are linked, the fingerprint zero of
    texts without words (null, empty, blank) like any other. component_id is the least
    doc_id reachable, the own one included. Rows without a doc_id are linked by their
    text too but name no component: where no row of a component has an id, it is null.
    Repeated rows repeat. Other columns are not used; an empty table gives an empty
    result. Copies are one node, and common fingerprints and components are dealt out.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    told = scratch.save(fingerprints(docs, words), "fingerprints")
    nodes = told.groupBy(F.col("fingerprint").alias("node")).agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    nodes = scratch.save(nodes, "nodes")
    roots = components(links(nodes.select("node"), scratch), scratch, "stars").withColumnRenamed("node", "_node")
    placed = nodes.join(roots, F.col("node") == F.col("_node"), "left").select("node", "n", "least", F.coalesce("root", "node").alias("root"))
    placed = scratch.save(placed, "placed")
    least = placed.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    busy = common_in(placed, ["root"], placed.count())
    named = dealt_join(placed, least, [("root", "_root")], busy, ["node"]).select(F.col("node").alias("_node"), "component_id")
    copies = common_keys(nodes.select(F.col("node").alias("fingerprint"), "n"), ["fingerprint"], "n", told.count())
    done = dealt_join(told, named, [("fingerprint", "_node")], copies, ["doc_id"])
    done = scratch.save(done.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"), "result")
    scratch.drop("fingerprints", "nodes", "open", "links", "placed")
    return done
