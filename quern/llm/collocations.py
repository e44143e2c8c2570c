"""Collocations: phrases whose words occur together more often than apart.

1. Texts are cut into blocks of one language. A block numbers its own words: its texts
   become codes, beside a list of its words with their counts, so the words of a corpus
   are counted, and later told their numbers, through blocks and not one by one.
2. Words that occur often enough get numbers from 1 (the dictionary). They come back to
   the blocks by a join; all other words, and the ends of pieces, become 0. A phrase
   that holds a rarer word is rarer than asked for, so nothing is lost by breaking there.
3. Each task packs its n-grams of numbers into keys of fixed width (4 bytes a word,
   shorter ones filled up with zeros), sorts them by 16-bit digits and counts runs, so a
   phrase that very many rows hold is one key from each task. Sorted keys are cut at the
   borders of ranges of first words. The words' counts tell where these lie, so that no
   range starts more than ``RANGE`` times; a word that alone starts more is dealt out by
   a hash of the words after it. The pieces of a range meet in one place, are sorted by
   digits again, and run lengths are the counts.
4. Counts of the parts of each cut are joined to the candidates.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.near_dedup import mixed
from quern.llm.rows import Columns, map_rows
from quern.llm.skew import common_in, common_keys, dealt_join
from quern.operators.windows import starts, with_ordinal
from quern.storage import Scratch

#: A block ends after so many codes, at the end of a piece.
BLOCK_CODES = 1 << 18
#: Blocks that a task has open at a time, one for each language.
OPEN_BLOCKS = 16
#: N-grams that a task sorts together, about, and occurrences of first words in a range.
SORTED_AT_ONCE, RANGE = 1 << 21, 1 << 20
BREAK = 0xFFFFFFFF
#: Ends of pieces become line ends, A-Z small letters.
_PLAIN = bytes.maketrans(b".,;:!?\x0b\x0c\r" + bytes(range(65, 91)), b"\n" * 9 + bytes(range(97, 123)))
NO_LANG = "und"
_P = np.uint64(0x9E3779B97F4A7C15)

BLOCKS = "block long, lang string, codes binary, words array<string>, counts array<int>"


def pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words of each piece of a text, A-Z lower-cased; pieces without words are passed over."""
    for piece in (text or "").encode().translate(_PLAIN).split(b"\n"):
        words = piece.split()
        if words:
            yield words


def _blocks(batches: Iterator[Columns], most: int) -> Iterator[list[tuple]]:
    """Blocks of ``most`` codes, up to the end of the piece."""
    base, made = TaskContext.get().partitionId() << 33, 0
    open_: dict[str, tuple[defaultdict, array]] = {}

    def close(lang: str) -> tuple:
        nonlocal made
        index, codes = open_.pop(lang)
        flat = np.frombuffer(codes, np.uint32)
        counts = np.bincount(flat[flat != BREAK], minlength=len(index))
        made += 1
        return base + made, lang, codes.tobytes(), [w.decode() for w in index], counts.tolist()

    for batch in batches:
        for text, lang in zip(batch["text"], batch["lang"], strict=True):
            lang = NO_LANG if lang is None else lang
            for words in pieces(text):
                if lang not in open_:
                    if len(open_) == OPEN_BLOCKS:
                        yield [close(max(open_, key=lambda k: len(open_[k][1])))]
                    index = defaultdict()
                    index.default_factory = index.__len__
                    open_[lang] = index, array("I")
                index, codes = open_[lang]
                codes.extend([index[w] for w in words])
                codes.append(BREAK)
                if len(codes) >= most:
                    yield [close(lang)]
    for lang in [*open_]:
        yield [close(lang)]


def packed(ids: np.ndarray, longest: int) -> np.ndarray:
    """Rows of ``longest`` numbers: every n-gram of 2 to ``longest`` positive ids in a row, filled up with zeros."""
    out = []
    for n in range(2, longest + 1):
        if len(ids) < n:
            break
        columns = [ids[i : len(ids) - n + 1 + i] for i in range(n)]
        sound = np.logical_and.reduce([c > 0 for c in columns])
        rows = np.zeros((int(sound.sum()), longest), np.uint32)
        for i, c in enumerate(columns):
            rows[:, i] = c[sound]
        out.append(rows)
    return np.concatenate(out) if out else np.zeros((0, longest), np.uint32)


def counted_runs(rows: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in order, and the sums of their counts (1 each without ``n``): a radix sort by 16-bit digits, last first."""
    order = np.arange(len(rows))
    for i in reversed(range(rows.shape[1])):
        for shift in (0, 16):
            digit = (rows[:, i] >> np.uint32(shift)).astype(np.uint16)
            if digit.any():
                order = order[np.argsort(digit[order], kind="stable")]
    rows, n = rows[order], np.ones(len(rows), np.int64) if n is None else n[order]
    if not len(rows):
        return rows, n
    begins = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    return rows[begins], np.add.reduceat(n, begins)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as big-endian keys, which sort like the rows."""
    width = 4 * rows.shape[1]
    data = rows.astype(">u4").tobytes()
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _way(rows: np.ndarray, ways: np.ndarray) -> np.ndarray:
    """Where the words after the first send a key of a word that is dealt over so many ways."""
    h = np.zeros(len(rows), np.uint64)
    for i in range(1, rows.shape[1]):
        h = mixed(h * _P + rows[:, i])
    return (h % ways.astype(np.uint64)).astype(np.int64)


#: A sorted piece of a range: distinct keys and their counts.
PIECES = "part long, way long, keys binary, counts binary"


def _pieces(batches: Iterator[pa.RecordBatch], longest: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """``PIECES`` of the n-grams of blocks (codes, and ``told``: place in the block's list, number, range and ways)."""
    held, size, places = [], 0, []
    names = [f.split()[0] for f in PIECES.split(", ")]

    def flush() -> pa.RecordBatch:
        rows, n = counted_runs(np.concatenate(held))
        words = np.concatenate(places, axis=1)
        _, first = np.unique(words[0], return_index=True)
        words = words[:, first]
        at = np.searchsorted(words[0], rows[:, 0])
        part, ways = words[1][at], words[2][at]
        way = np.zeros(len(rows), np.int64)
        hot = ways > 1
        way[hot] = _way(rows[hot], ways[hot])
        order = np.lexsort((way, part))
        rows, n, part, way = rows[order], n[order].astype(np.uint32), part[order], way[order]
        begins = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (way[1:] != way[:-1])]))
        cut = [*zip(begins.tolist(), [*begins[1:].tolist(), len(rows)], strict=True)]
        columns = part[begins], way[begins], [rows[a:b].tobytes() for a, b in cut], [n[a:b].tobytes() for a, b in cut]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=names)

    for batch in batches:
        told = batch.column("told")
        ends = told.offsets.to_numpy() - told.offsets[0].as_py()
        at, number, part, ways = (told.flatten().field(i).to_numpy().astype(np.int64) for i in range(4))
        for i, codes in enumerate(batch.column("codes")):
            flat = np.frombuffer(codes.as_py(), np.uint32)
            own = slice(ends[i], ends[i + 1])
            table = np.zeros(int(at[own].max()) + 2, np.uint32)
            table[at[own]] = number[own]
            found = packed(table[np.minimum(flat, len(table) - 1)], longest)
            held.append(found)
            places.append(np.array([number[own], part[own], ways[own]]))
            size += len(found)
            if size >= at_once:
                yield flush()
                held, size, places = [], 0, []
    if size:
        yield flush()


def _counted(batches: Iterator[pa.RecordBatch], longest: int, least: int) -> Iterator[pa.RecordBatch]:
    """key, size, n of keys that occur ``least`` times, from ``PIECES`` in order of range and way; holds one range at a time."""
    now, held = None, []

    def close() -> pa.RecordBatch:
        rows = np.concatenate([np.frombuffer(k, np.uint32) for k, _ in held]).reshape(-1, longest)
        rows, n = counted_runs(rows, np.concatenate([np.frombuffer(c, np.uint32) for _, c in held]).astype(np.int64))
        often = n >= least
        rows, n = rows[often], n[often]
        return pa.RecordBatch.from_arrays([_binary(rows), pa.array((rows > 0).sum(axis=1), pa.int32()), pa.array(n, pa.int64())], names=["key", "size", "n"])

    for batch in batches:
        for part, way, keys, counts in zip(*batch.columns, strict=True):
            if (part, way) != now:
                if held:
                    yield close()
                now, held = (part, way), []
            held.append((keys.as_py(), counts.as_py()))
    if held:
        yield close()


def _shifted(key: Column, words: int, width: int) -> Column:
    """The key without its first ``words`` words."""
    return F.concat(F.substring(key, 4 * words + 1, width - 4 * words), F.lit(bytearray(4 * words)))


def _start(key: Column, words: int, width: int) -> Column:
    """The key of the first ``words`` words."""
    return F.concat(F.substring(key, 1, 4 * words), F.lit(bytearray(width - 4 * words)))


def scored(candidates: DataFrame, counts: DataFrame, longest: int) -> DataFrame:
    """key, size, a, l, r, score of ``candidates`` (key, size, n) by their lowest-scoring cut.

    ``counts`` has key and n of all phrases that occur often enough, single words
    included. The score is floor(1,000,000 a a / (l r)) in decimals of 38 digits: exact
    for counts below 10^15.
    """
    width = 4 * longest
    key = F.col("key")
    cuts = F.array(*(F.struct(F.lit(k).alias("k"), _start(key, k, width).alias("left"), _shifted(key, k, width).alias("right")) for k in range(1, longest)))
    rows = candidates.select("key", "size", F.col("n").alias("a"), F.inline(cuts)).where("k < size")
    total = candidates.count() * (longest - 1)
    for side, count in (("left", "l"), ("right", "r")):
        parts = counts.select(F.col("key").alias("_key"), F.col("n").alias(count))
        rows = dealt_join(rows, parts, [(side, "_key")], common_in(rows, [side], total), ["key", "k"]).drop("_key", side)
    exact = {c: f"cast({c} as decimal(15, 0))" for c in "alr"}
    score = F.expr(f"(cast(1000000 as decimal(7, 0)) * {exact['a']} * {exact['a']}) div ({exact['l']} * {exact['r']})")
    rows = rows.withColumn("score", score)
    best = rows.groupBy("key", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("key", "size", "a", "b.l", "b.r", "b.score")


def uncontained(found: DataFrame, longest: int, percent: int = 50) -> DataFrame:
    """``found`` without phrases that lie in a longer one of it with at least ``percent`` of their count.

    A phrase one word longer occurs at least as often as any that holds it, so only
    those are looked at.
    """
    width, key = 4 * longest, F.col("key")
    parts = []
    for n in range(3, longest + 1):
        inner = F.explode(F.array(_start(key, n - 1, width), _shifted(key, 1, width))).alias("_inner")
        parts.append(found.where(F.col("size") == n).select(inner, "a"))
    if not parts:
        return found
    longer = parts[0]
    for p in parts[1:]:
        longer = longer.union(p)
    longer = longer.groupBy("_inner").agg(F.max("a").alias("_most"))
    left = found.join(longer, key == F.col("_inner"), "left")
    return left.where(F.col("_most").isNull() | (F.col("_most") * 100 < F.col("a") * percent)).drop("_inner", "_most")


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language in ``docs`` (text, lang).

    Phrases have 2 to ``longest`` words of one piece and occur ``least`` times or more;
    see ``scored`` and ``uncontained``. Ranks go by score, then count, both falling, then
    by the UTF-8 bytes of the phrase. n counts all words of the language. Null texts are
    empty; a null language is ``und``, together with rows that say so; repeated rows
    count again; other columns are not used. An empty table, or one of rare words only,
    gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    most, at_once = BLOCK_CODES, SORTED_AT_ONCE
    blocks = scratch.save(map_rows(docs.select("text", "lang"), lambda it: _blocks(it, most), BLOCKS), "blocks")
    words = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    words = words.select("block", "lang", "at", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    often = words.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).where(F.col("n") >= least)
    totals = scratch.save(words.groupBy(F.col("lang").alias("_lang")).agg(F.sum("n").alias("total")), "totals")
    often = scratch.save(often, "often")
    known = with_ordinal(often.select("lang", "word", "n", "blocks"), [], ["lang", "word"], "id").withColumn("id", F.col("id") + 1)
    known = starts(known, [], "id", "n", "before")
    place = (F.col("before") / RANGE).cast("long").alias("part"), F.ceil(F.col("n") / RANGE).alias("ways")
    known = scratch.save(known.select("lang", "word", "n", "blocks", "id", *place), "known")
    if known.count() >= 1 << 32:
        raise ValueError("more than 2^32 words: ask for more occurrences")

    rows = words.select("block", "lang", "at", "word")
    held = known.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    told = known.select(F.col("lang").alias("_l"), F.col("word").alias("_w"), "id", "part", "ways")
    busy = common_keys(known, ["lang", "word"], "blocks", held)
    told = dealt_join(rows, told, [("lang", "_l"), ("word", "_w")], busy, ["block"]).select("block", "at", "id", "part", "ways")
    told = told.groupBy(F.col("block").alias("_block")).agg(F.collect_list(F.struct("at", "id", "part", "ways")).alias("told"))
    coded = blocks.select("block", "codes").join(told, F.col("block") == F.col("_block")).select("codes", "told")
    made = coded.mapInArrow(lambda it: _pieces(it, longest, at_once), PIECES).repartition("part", "way").sortWithinPartitions("part", "way")
    found = scratch.save(made.mapInArrow(lambda it: _counted(it, longest, least), "key binary, size int, n long"), "found")
    scratch.drop("blocks", "often")
    number = F.unhex(F.lpad(F.hex("id"), 8, "0"))
    single = known.select(F.concat(number, F.lit(bytearray(4 * (longest - 1)))).alias("key"), "n")
    counts = found.select("key", "n").unionByName(single)
    kept = scratch.save(uncontained(scratch.save(scored(found, counts, longest), "scored"), longest), "kept")

    ids = kept.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.conv(F.hex(F.substring("key", i * 4 + 1, F.lit(4))), 16, 10).cast("long"))).alias("i", "id"))
    named = known.select(F.col("id").alias("_id"), "lang", "word")
    ids = dealt_join(ids, named, [("id", "_id")], common_in(ids, ["id"], kept.count() * longest), ["key"])
    phrases = ids.groupBy(F.col("key").alias("_key")).agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("i", "word"))).alias("p"))
    phrases = phrases.select("_key", "lang", F.array_join(F.transform("p", lambda x: x["word"]), " ").alias("phrase"))
    rows = kept.join(phrases, F.col("key") == F.col("_key")).select("lang", "phrase", "a", "l", "r", "score", (-F.col("score")).alias("_s"), (-F.col("a")).alias("_a"))
    ranked = with_ordinal(rows, ["lang"], ["_s", "_a", "phrase"], "rank").where(F.col("rank") < top)
    ranked = ranked.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, F.col("lang") == F.col("_lang"))
    return ranked.select("lang", (F.col("rank") + 1).alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")

