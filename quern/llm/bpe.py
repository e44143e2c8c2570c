"""BPE encoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last ``WINDOW`` code points has its low bits
zero, so equal passages are cut alike wherever they stand. Chunks that several texts
share are encoded once; texts put together what their chunks say, and repair each
joint: from the last piece boundary that the left chunk settles on its own, text is
encoded anew until a boundary agrees with one of the right chunk. Pieces of the
tokenizer's pattern are found left to right without looking back, so from an agreed
boundary on both encodings are equal for certain.

Texts that share no chunk with another text, and of which there is one copy, are
encoded where they are. Which chunks and texts are shared is counted over all rows; a
Bloom filter sized by their number tells mappers what may be. A false hit only sends a
text the longer way; so does a filter at its largest size that is too full, when more
and more texts travel, up to all. Copies of a text travel under its digest and are
encoded once. Passages and texts that very many rows share are dealt out in the joins.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from quern.llm.skew import common_in, dealt_join
from quern.storage import Scratch

WINDOW, CUT_BITS = 16, 9
#: Chunks end after so many code points at the latest; cuts less far apart are skipped.
LEAST_CHUNK, MOST_CHUNK = 128, 8192
#: A piece this near to the end of what was seen may still change with what follows.
LOOKAHEAD = 4
#: White space of so many code points is split off here: the rank encoder's own pattern runs out of stack on longer runs.
LONG_SPACE = 50_000
#: Marks the digest of a whole text among those of chunks.
_COPY = "\x00whole\x00"
_REMEMBERED = 100_000
#: Bits of the Bloom filter for each shared chunk or text, and powers of two between which all of them stay (16 MiB).
FILTER_EACH, FILTER_LEAST, FILTER_MOST = 32, 16, 27
#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The white space that the pattern means; other libraries add U+001C to U+001F.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = regex.compile(PATTERN.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]"))
_LONG = regex.compile(f"[{_SPACE}]{{{LONG_SPACE}}}")
_P = np.uint64(0x9E3779B97F4A7C15)


class Tokenizer:
    """A byte-level BPE vocabulary file of the tokenizers library, encoded by ranks."""

    _open: dict[str, Tokenizer] = {}

    @classmethod
    def of(cls, path: str) -> Tokenizer:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        kind = (told["pre_tokenizer"] or {}).get("type"), told["model"]["type"], told["normalizer"], told["pre_tokenizer"].get("add_prefix_space")
        if kind != ("ByteLevel", "BPE", None, False):
            raise ValueError(f"not a plain byte-level BPE: {path}")
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self._split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        byte = {c: b for b, c in self._alphabet().items()}
        self.bytes = {i: bytes(byte[c] for c in t) for t, i in told["model"]["vocab"].items() if t not in self.special}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        ranks = {b: i for i, b in self.bytes.items() if i not in self.special.values()}
        self._bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _alphabet() -> dict[int, str]:
        """The printable stand-in of each byte: itself if it is one, else from U+0100 on."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """The text around special tokens, and these with their ids."""
        if not self._split or not any(s in text for s in self.special):
            return [(text, None)]
        return [(x, self.special.get(x)) for x in self._split.split(text) if x]

    def encode_plain(self, text: str) -> list[int]:
        if len(text) < LONG_SPACE or not _LONG.search(text):
            return self._bpe.encode_ordinary(text)
        return [i for m in _PIECE.finditer(text) for i in self.encode_piece(m[0])]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of what the pattern takes as one piece."""
        return self._bpe._encode_single_piece(piece.encode()) if len(piece) >= LONG_SPACE else self._bpe.encode_ordinary(piece)

    def encode(self, text: str) -> np.ndarray:
        out: list[int] = []
        for part, special in self.segments(text):
            out += [special] if special is not None else self.encode_plain(part)
        return np.array(out, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def pieces(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece ends in the text, their token counts, and all ids."""
        ends, counts, ids = [], [], []
        for m in _PIECE.finditer(text):
            own = self.encode_piece(m[0])
            ends.append(m.end())
            counts.append(len(own))
            ids += own
        return np.array(ends, np.uint32), np.array(counts, np.uint32), np.array(ids, np.uint32)


def cuts(text: str) -> list[int]:
    """Ends of the chunks of a text, the last one being its length."""
    n = len(text)
    if n <= LEAST_CHUNK:
        return [n] if n else []
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(n - WINDOW + 1, np.uint64)
    for i in range(WINDOW):
        h *= _P
        h += points[i : n - WINDOW + 1 + i]
    marks = np.flatnonzero((h >> np.uint64(64 - CUT_BITS)) == 0) + WINDOW
    out, at = [], 0
    for m in [*marks.tolist(), n]:
        while m - at > MOST_CHUNK:
            at += MOST_CHUNK
            out.append(at)
        if m - at >= LEAST_CHUNK or m == n:
            out.append(m)
            at = m
    return out


def chunks(text: str) -> list[str]:
    ends = cuts(text)
    return [text[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905


def put_together(tok: Tokenizer, parts: list[tuple[str, tuple]]) -> list[tuple[str, tuple]]:
    """``parts`` with those that follow each other and are one piece each as one text: the joints of a very long run would each encode all before."""
    out, i = [], 0
    while i < len(parts):
        j = i + 1
        while j < len(parts) and len(parts[j - 1][1][0]) == len(parts[j][1][0]) == 1:
            j += 1
        text = "".join(p[0] for p in parts[i:j])
        out.append(parts[i] if j == i + 1 else (text, tok.pieces(text)))
        i = j
    return out


def join_chunks(tok: Tokenizer, parts: list[tuple[str, tuple]]) -> np.ndarray:
    """Ids of the texts in a row, from each one's ``pieces``; exact at the joints."""
    done: list[np.ndarray] = []  # settled ids
    tail, tail_ids, tail_ends, tail_counts = "", np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    # The tail is text that begins at a settled boundary, with its own pieces.
    for text, (ends, counts, ids) in put_together(tok, parts):
        if not tail:
            tail, tail_ends, tail_counts, tail_ids = text, ends, counts, ids
            continue
        keep = int(np.searchsorted(tail_ends, max(len(tail) - LOOKAHEAD, 0), "right"))
        begin = int(tail_ends[keep - 1]) if keep else 0
        used = int(tail_counts[:keep].sum())
        done.append(tail_ids[:used])
        left = tail[begin:]
        known = {0, *ends.tolist()}
        reach = 64
        while True:  # encode on until a boundary agrees, with ever more of the right chunk
            window = left + text[:reach]
            new_ends, new_counts, new_ids = tok.pieces(window)
            sure = len(window) - LOOKAHEAD
            agreed = next((i for i, e in enumerate(new_ends.tolist()) if len(left) <= e <= sure and (e - len(left) in known)), None)
            if agreed is not None or reach >= len(text):
                break
            reach *= 4
        if agreed is None:
            tail, tail_ends, tail_counts, tail_ids = left + text, *tok.pieces(left + text)
            continue
        done.append(new_ids[: int(new_counts[: agreed + 1].sum())])
        at = int(new_ends[agreed]) - len(left)
        first = int(np.searchsorted(ends, at, "right"))
        tail, tail_ends = text[at:], ends[first:] - np.uint32(at)
        tail_counts, tail_ids = counts[first:], ids[int(counts[:first].sum()) :]
    return np.concatenate([*done, tail_ids]) if done else tail_ids


def doc_chunks(tok: Tokenizer, text: str) -> Iterator[tuple[int, str]]:
    """The chunks between the special tokens of a text, each after its start, in order."""
    at = 0
    for part, special in tok.segments(text):
        if special is None:
            begin = 0
            for end in cuts(part):
                yield at + begin, part[begin:end]
                begin = end
        at += len(part)


def assembled(tok: Tokenizer, text: str, known: dict[int, tuple]) -> np.ndarray:
    """Ids of a text of which chunks ``known`` by their start have been encoded before; what is between them is encoded here."""
    if not known:
        return tok.encode(text)
    out, at, begins, i = [], 0, sorted(known), 0
    for part, special in tok.segments(text):
        if special is not None:
            out.append(np.array([special], np.uint32))
            at += len(part)
            continue
        parts: list[tuple[str, tuple]] = []
        done = 0
        while i < len(begins) and begins[i] < at + len(part):
            begin = begins[i] - at
            if begin > done:
                parts.append((part[done:begin], tok.pieces(part[done:begin])))
            done = begin + int(known[begins[i]][0][-1])
            parts.append((part[begin:done], known[begins[i]]))
            i += 1
        if done < len(part):
            parts.append((part[done:], tok.pieces(part[done:])))
        out.append(join_chunks(tok, parts))
        at += len(part)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _remember(seen: set, item: bytes) -> None:
    """A bounded memory: what it forgets is only repeated."""
    if len(seen) >= _REMEMBERED:
        seen.clear()
    seen.add(item)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def _short(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) & 0x7FFFFFFFFFFFFFFF


def filter_power(shared: int) -> int:
    """The filter's size for so many shared chunks and texts, as a power of two."""
    return min(FILTER_MOST, max(FILTER_LEAST, (FILTER_EACH * shared).bit_length()))


ENCODED = "n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"


def _row(tok: Tokenizer, ids: np.ndarray, keep_ids: bool) -> tuple:
    raw = ids.astype("<u4").tobytes()
    back = hashlib.sha256(tok.decode(ids).encode()).hexdigest()
    return len(ids), hashlib.sha256(raw).hexdigest(), back, raw if keep_ids else None


#: What is noted of a text that may share chunks: its digest, whether its task saw it first, and then its shared chunks.
_AWAY = "key binary, fresh boolean, starts array<int>, digests array<binary>, chunks array<string>"


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = True, keep_text: bool = True, in_order: bool = False) -> DataFrame:
    """All columns of ``docs`` plus n_tokens, ids_sha256, decoded_sha256 and ids (little-endian uint32).

    Equals the tokenizers library's ``encode(text, add_special_tokens=False)``:
    special tokens' strings in a text become their ids. Null texts are empty (no
    tokens). Results depend on the text alone, so repeated rows repeat them. Columns
    already called like a result are replaced. Without ``keep_ids`` the ids are null;
    without ``keep_text`` the result has no text. An empty table gives an empty result.
    Texts of any length and make-up are encoded, also very long runs of white space.

    Copies of a text are encoded together, so the rows come in no order of ``docs``;
    ``in_order`` brings them back into it: partitions in order, rows in each as read.
    """
    if in_order:
        place = next(f"_place{i}" for i in range(len(docs.columns) + 1) if f"_place{i}" not in docs.columns)
        done = encode_documents(docs.withColumn(place, F.monotonically_increasing_id()), path, keep_ids, keep_text)
        return done.repartitionByRange(place).sortWithinPartitions(place).drop(place)
    spark = docs.sparkSession
    scratch = Scratch(spark, "bpe")
    results = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    kept = [c for c in docs.columns if c not in results]
    docs = docs.select(*kept)

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = Tokenizer.of(path)
        for batch in batches:
            hashes, owners, whole = [], [], []
            for text in batch["text"]:
                own = [_short(c) for _, c in doc_chunks(tok, text or "")]
                name = _short(_COPY + (text or ""))
                hashes += [name, *own]
                owners += [name] * (1 + len(own))
                whole += [True] + [False] * len(own)
            yield pd.DataFrame({"chunk": np.array(hashes, np.int64), "owner": np.array(owners, np.int64), "whole": np.array(whole, bool)})

    # A chunk is shared if two different texts hold it, a text if two rows do.
    seen = docs.select("text").mapInPandas(digests, "chunk long, owner long, whole boolean")
    seen = seen.groupBy("chunk").agg(F.count("*").alias("n"), F.min("owner").alias("a"), F.max("owner").alias("b"), F.bool_or("whole").alias("whole"))
    held = scratch.save(seen.where("(whole and n > 1) or a <> b").select("chunk"), "shared")
    power = filter_power(held.count())
    slots = F.explode(F.array(F.col("chunk") % (1 << power), F.shiftright("chunk", power) % (1 << power)))
    words = held.select(slots.alias("slot")).groupBy(F.expr("slot div 32").cast("int").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(slot % 32 as int)))").alias("mask")
    )
    mask = np.zeros(1 << power - 5, np.uint32)  # of bounded size, so this many rows at most
    found = words.toArrow()
    mask[found["word"].to_numpy()] = found["mask"].to_numpy().astype(np.uint32)
    shared = spark.sparkContext.broadcast(mask)
    low = (1 << power) - 1

    def may(short: int) -> bool:
        bits = shared.value
        return all(bits[s >> 5] >> np.uint32(s & 31) & np.uint32(1) for s in (short & low, short >> power & low))

    fields = docs.schema.fields
    names = [f"c{i}" for i in range(len(fields))]
    plain = docs.select(*(F.col(f"`{f.name}`").alias(n) for f, n in zip(fields, names, strict=True)))
    body = F.struct(*(n for n, f in zip(names, fields, strict=True) if f.name != "text"))
    text_name = names[kept.index("text")]
    plain = plain.select(body.alias("body"), F.col(text_name).alias("text"))

    def settle(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        """Each text encoded, or its digest with its shared chunks: those once for each task, a chunk's own text at its first mention."""
        tok, texts, told = Tokenizer.of(path), set(), set()
        for batch in series:
            out = []
            for text in batch:
                text = text or ""
                parts = [(at, c) for at, c in doc_chunks(tok, text) if may(_short(c))]
                if not parts and not may(_short(_COPY + text)):
                    out.append((*_row(tok, tok.encode(text), keep_ids), None, None, None, None, None))
                    continue
                key = hashlib.sha256(text.encode()).digest()
                if key in texts:
                    out.append((None, None, None, None, key, False, None, None, None))
                    continue
                _remember(texts, key)
                names, own = [_digest(c) for _, c in parts], []
                for name, (_, chunk) in zip(names, parts, strict=True):
                    own.append(None if name in told else chunk)
                    _remember(told, name)
                out.append((None, None, None, None, key, True, [at for at, _ in parts], names, own))
            frame = pd.DataFrame(out, columns=[*results, "key", "fresh", "starts", "digests", "chunks"])
            yield frame.astype({"n_tokens": "Int64", "fresh": "boolean"})

    judged = plain.select("body", "text", _iter_udf(settle, f"{ENCODED}, {_AWAY}")("text").alias("r"))
    judged = judged.select("body", F.col("text"), "r.*")
    if not keep_text:
        judged = judged.withColumn("text", F.when(F.col("fresh"), F.col("text")))
    first = scratch.save(judged, "settled")
    fresh = first.where("fresh")
    refs = fresh.select("key", F.inline(F.arrays_zip(F.col("starts").alias("seq"), F.col("digests").alias("digest"), F.col("chunks").alias("chunk"))))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = Tokenizer.of(path)
        for batch in batches:
            made = [tok.pieces(c) for c in batch["chunk"]]
            yield pd.DataFrame(
                {
                    "digest": batch["digest"],
                    "ends": [m[0].astype(np.uint16).tobytes() for m in made],
                    "counts": [m[1].astype(np.uint16).tobytes() for m in made],
                    "ids": [m[2].astype("<u4").tobytes() for m in made],
                }
            )

    once = refs.where("chunk is not null").groupBy("digest", "chunk").agg(F.lit(1).alias("_1")).select("digest", "chunk")
    table = scratch.save(once.mapInPandas(encode, "digest binary, ends binary, counts binary, ids binary"), "chunks")
    mentions = scratch.save(refs.select("key", "seq", "digest").distinct(), "mentions")
    common = common_in(mentions, ["digest"], mentions.count())
    known = dealt_join(mentions, table.withColumnRenamed("digest", "_digest"), [("digest", "_digest")], common, ["key", "seq"])

    def by_key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a key: its text (seq -1, once from each task that saw it), then its shared chunks by start."""
        tok, now, text, known = Tokenizer.of(path), None, "", {}

        def close() -> tuple:
            return (now, *_row(tok, assembled(tok, text, known), keep_ids))

        for batch in batches:
            out = []
            for key, seq, own, ends, counts, ids in batch.itertuples(index=False, name=None):
                if key != now:
                    if now is not None:
                        out.append(close())
                    now, text, known = key, own, {}
                elif seq >= 0:
                    known[seq] = tuple(np.frombuffer(x, t).astype(np.uint32) for x, t in ((ends, np.uint16), (counts, np.uint16), (ids, "<u4")))
            if out:
                yield pd.DataFrame(out, columns=["key", *results])
        if now is not None:
            yield pd.DataFrame([close()], columns=["key", *results])

    nothing = F.lit(None).cast("binary")
    rows = fresh.select("key", F.lit(-1).alias("seq"), F.coalesce("text", F.lit("")).alias("text"), nothing.alias("ends"), nothing.alias("counts"), nothing.alias("ids"))
    rows = rows.unionByName(known.select("key", "seq", F.lit(None).cast("string").alias("text"), "ends", "counts", "ids"))
    rows = rows.repartition("key").sortWithinPartitions("key", "seq")
    joined = scratch.save(rows.mapInPandas(by_key, f"key binary, {ENCODED}"), "joined")
    scratch.drop("shared", "chunks", "mentions")

    back = [
        F.col(f"body.{n}").alias(f.name) if f.name != "text" else F.col("text")
        for n, f in zip(names, fields, strict=True)
        if keep_text or f.name != "text"
    ]
    here = first.where("key is null").select(*back, *results)
    away = first.where("key is not null")
    copies = common_in(away, ["key"], away.count())
    there = dealt_join(away.select("key", "body", "text"), joined.withColumnRenamed("key", "_key"), [("key", "_key")], copies, ["body"])
    return here.unionByName(there.select(*back, *results))


def _iter_udf(run, schema: str):
    return F.pandas_udf(run, schema, PandasUDFType.SCALAR_ITER)
