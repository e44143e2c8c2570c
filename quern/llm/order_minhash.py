"""Order MinHash fingerprints, sensitive to edit distance.

Each k-mer of a text is numbered by how often it has occurred before. For each of
``SKETCHES`` hash functions the ``TUPLE`` least occurrence-numbered k-mers are chosen,
put back into text order, and hashed as a tuple. Texts agree in a position only where
they share these k-mers in the same order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from quern.llm.near_dedup import mixed
from quern.llm.rows import Columns, map_rows
from quern.storage import Scratch

K, TUPLE, SKETCHES = 6, 2, 96
_BLOCK = 4096
_rng = np.random.default_rng(19770604)
_A = _rng.integers(0, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, SKETCHES, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_POSITION = 24  # bits of a sort key that hold the position


def kmers(text: str, k: int = K) -> np.ndarray:
    """Hashes of the k-mers in text order; a shorter text is one k-mer."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    span = min(k, len(points))
    n = len(points) - span + 1
    out = np.full(n, span, np.uint64)
    for i in range(span):
        out *= _P
        out += points[i : n + i]
    return mixed(out)


def occurrences(h: np.ndarray) -> np.ndarray:
    """How often each element's value has occurred before it."""
    n = len(h)
    if n < 1 << _POSITION:
        position = np.uint64((1 << _POSITION) - 1)
        keys = np.sort((h & ~position) | np.arange(n, dtype=np.uint64))
        at, value = (keys & position).astype(np.int64), keys >> np.uint64(_POSITION)
    else:
        at = np.argsort(h, kind="stable")
        value = h[at]
    order = np.arange(n)
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(value[1:], value[:-1], out=fresh[1:])
    numbers = np.empty(n, np.uint64)
    numbers[at] = order - np.maximum.accumulate(np.where(fresh, order, 0))
    return numbers


def fingerprint(text: str) -> np.ndarray:
    """``SKETCHES`` 16-bit tuple hashes; of the empty text all zero."""
    if not text:
        return np.zeros(SKETCHES, np.uint16)
    h = kmers(text)
    x = mixed(h + occurrences(h) * _P)
    best = np.full((SKETCHES, TUPLE), _TOP, np.uint64)  # least hashes, and where they stand
    where = np.zeros((SKETCHES, TUPLE), np.int64)
    rows = np.arange(SKETCHES)
    for at in range(0, len(x), _BLOCK):
        part = _A[:, None] * x[None, at : at + _BLOCK]
        part += _B[:, None]
        values, places = [best], [where]
        for _ in range(min(TUPLE, part.shape[1])):
            i = part.argmin(axis=1)
            values.append(part[rows, i][:, None])
            places.append(i[:, None] + at)
            part[rows, i] = _TOP
        value, place = np.concatenate(values, 1), np.concatenate(places, 1)
        least = np.argsort(value, axis=1, kind="stable")[:, :TUPLE]
        best, where = np.take_along_axis(value, least, 1), np.take_along_axis(place, least, 1)
    where.sort(axis=1)
    out = rows.astype(np.uint64)
    for j in range(min(TUPLE, len(x))):
        out = mixed(out * _P + h[where[:, j]])
    return (out >> np.uint64(48)).astype(np.uint16)


def written(prints: np.ndarray) -> bytes:
    return prints.astype(">u2").tobytes()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of positions in which two fingerprints agree."""
    return float((a == b).mean())


def half_replaced(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as many first code points (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Digests are kept as bytes until the end: half the disk of their hex form.
ROW = (
    "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary,"
    " near_edited double, near_next double"
)
#: Rows of the first pass: results, and texts that stand at the edges of partitions.
_PASS = f"{ROW}, partition int, edge string, text string"
_NAMES = [x.split()[0] for x in ROW.replace(", ", ",").split(",")]


def _result(doc, text: str, prints: np.ndarray, following: str, next_prints: np.ndarray) -> tuple:
    edited = half_replaced(text, following)
    own = fingerprint(edited) if edited != text else prints
    return (
        doc,
        len(text),
        hashlib.sha256(edited.encode()).digest(),
        written(prints),
        written(own),
        likeness(prints, own),
        likeness(prints, next_prints),
    )


def _sorted_pass(batches: Iterator[Columns]) -> Iterator[list[tuple]]:
    """Results of all rows but a partition's last; its first and last text as edges."""
    part = TaskContext.get().partitionId()
    held = None
    for batch in batches:
        out = []
        for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
            prints = fingerprint(text)
            if held is None:
                out.append((doc, *[None] * 6, part, "first", text))
            else:
                out.append((*_result(*held, text, prints), part, None, None))
            held = (doc, text, prints)
        yield out
    if held is not None:
        yield [(held[0], *[None] * 6, part, "last", held[1])]


def _edge_pass(batches: Iterator[Columns]) -> Iterator[list[tuple]]:
    for batch in batches:
        rows = zip(batch["doc_id"], batch["text"], batch["following"], strict=True)
        yield [_result(doc, text, fingerprint(text), following, fingerprint(following)) for doc, text, following in rows]


def fingerprint_documents(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness: see ``ROW``, digests as lower-case hex.

    Texts follow each other by descending doc_id (null last; equal ones by text); the
    last is followed by the first, a single one by itself. Null texts are empty.
    Rows are range-partitioned once, by id and digest, so that rows of one id or none
    are dealt out too, and streamed in order; the last row of each partition is
    finished afterwards with the first text of the next one. Columns besides doc_id
    and text are not used. Repeated rows follow each other; an empty table gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "order-minhash")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.md5("text").asc()]
    width = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    dealt = rows.repartitionByRange(width, *order).sortWithinPartitions(*order)
    passed = scratch.save(map_rows(dealt, _sorted_pass, _PASS), "passed")

    edges = passed.where("edge is not null").select("doc_id", "partition", "edge", "text")
    # One row per partition: these windows see as many rows as there are partitions.
    parts = edges.where("edge = 'first'").select("partition")
    parts = parts.selectExpr("partition", "lead(partition) over (order by partition) as _after", "min(partition) over () as _start")
    parts = parts.select("partition", F.coalesce("_after", "_start").alias("_next"))
    first = edges.where("edge = 'first'").select(F.col("partition").alias("_p"), F.col("text").alias("following"))
    last = edges.where("edge = 'last'").join(parts, "partition").join(first, F.col("_next") == F.col("_p"))
    finished = map_rows(last.select("doc_id", "text", "following"), _edge_pass, ROW)
    whole = passed.where("edge is null").select(*_NAMES).unionByName(finished)
    digests = ("edited_sha256", "fingerprint", "edited_fingerprint")
    return whole.withColumns({c: F.lower(F.hex(c)) for c in digests})
