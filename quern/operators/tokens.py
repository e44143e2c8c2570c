"""Byte-pair encoding over pre-tokens, and the character-level case of it."""

from __future__ import annotations

import heapq
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from quern.functions.text import PRETOKEN, characters
from quern.storage import Scratch

PAD, UNK, BOS, EOS, IGNORE = 0, 1, 2, 3, -100
FIRST_ID = 4


def word_freq(docs: DataFrame) -> DataFrame:
    """word, freq over all pre-tokens of ``text``, counted by block first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _blocks(batch.column(0)):
                values, counts = _pieces(part)[0].value_counts().flatten()
                known: dict[str, int] = {}
                refs, ends = _words_of(values.to_pylist(), known)
                uses = np.zeros(len(known), np.int64)
                np.add.at(uses, refs, np.repeat(counts.to_numpy(), np.diff(ends)))
                yield pa.RecordBatch.from_arrays([pa.array([*known], pa.string()), pa.array(uses)], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("freq"))


def char_vocab(docs: DataFrame) -> DataFrame:
    """ch, id: distinct characters by code point, ids from 4. A task gives each character once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 21, bool)
        for batch in batches:
            for part in _blocks(batch.column(0)):
                seen[_points(part.to_pylist())[0]] = True
        yield pa.RecordBatch.from_arrays([pa.array([*map(chr, np.flatnonzero(seen).tolist())], pa.string())], names=["ch"])

    distinct = docs.where("text <> ''").select("text").mapInArrow(run, "ch string").distinct()
    # The alphabet has at most as many rows as Unicode, so it is ordered in one list.
    listed = distinct.agg(F.array_sort(F.collect_list("ch")).alias("all"))
    return listed.select(F.posexplode("all").alias("pos", "ch")).select("ch", (F.col("pos") + FIRST_ID).alias("id"))


#: Texts that are encoded at a time: their ids take four bytes a character.
TEXTS = 64


def encode_texts(
    docs: DataFrame,
    vocab: DataFrame,
    text: str = "txt",
    lay: Callable[[np.ndarray], np.ndarray] | None = None,
    then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None,
    gives: StructType | None = None,
) -> DataFrame:
    """``docs`` with ids, an array<int>, in place of ``text``: whole texts by a table over code points, then ``lay``.

    ``then`` makes rows of schema ``gives`` of a few encoded texts at a time, in the same task.
    """
    points = {ord(r["ch"]): r["id"] for r in vocab.collect()}
    table = np.full(max(points, default=0) + 2, UNK, np.int32)
    table[list(points)] = list(points.values())
    kept = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                few = batch.slice(at, TEXTS)
                ids = [table[np.minimum(np.frombuffer((t or "").encode("utf-32-le"), np.uint32), len(table) - 1)] for t in few.column(text).to_pylist()]
                ids = [lay(x) for x in ids] if lay else ids
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                made = pa.RecordBatch.from_arrays([*(few.column(c) for c in kept), listed], names=[*kept, "ids"])
                yield then(made) if then else made

    schema = StructType([*(docs.schema[c] for c in kept), StructField("ids", ArrayType(IntegerType()))])
    return docs.mapInArrow(run, gives or schema)


def pair_counts(words: DataFrame) -> DataFrame:
    """a, b, cnt: adjacent symbol pairs of words (word, freq), every position counted."""
    chars = characters(F.col("word"))
    pairs = F.transform(
        F.filter(F.arrays_zip(chars.alias("a"), F.slice(chars, 2, 1 << 30).alias("b")), lambda p: p["b"].isNotNull()),
        lambda p: p,
    )
    return (
        words.select(F.explode(pairs).alias("p"), "freq")
        .groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b"))
        .agg(F.sum("freq").alias("cnt"))
    )


def best_pair(pairs: DataFrame) -> DataFrame:
    """The most frequent pair; of equal ones the lexicographically largest. No row below 2."""
    best = pairs.agg(F.max(F.struct("cnt", "a", "b")).alias("p")).where("p.cnt >= 2")
    return best.select("p.a", "p.b", "p.cnt")


#: Pairs of one count that are put in order at a time.
FRONT = 1 << 16


class _Queue:
    """Pairs by count, the largest first, and of equal ones the larger pair of strings; eight bytes for each.

    A pair is added whenever its count changes; those that have changed since are passed
    over when their count comes up. Of the pairs of the largest count only ``FRONT`` are
    in order at a time, the largest ones.
    """

    def __init__(self, counts: dict[int, int], names: list[str]):
        self.counts, self.names = counts, names
        self.held: dict[int, array] = {}  # pairs by count
        self.levels: list[int] = []  # those counts, negated
        self.level, self.front, self.floor = 0, [], None
        for key, n in counts.items():
            self.add(key, n)

    def strings(self, key: int) -> tuple[str, str]:
        return self.names[key >> 32], self.names[key & 0xFFFFFFFF]

    def add(self, key: int, n: int) -> None:
        if n == self.level and self.front and self.strings(key) >= self.floor:
            heapq.heappush(self.front, _Pair(key, *self.strings(key)))
            return
        own = self.held.get(n)
        if own is None:
            own = self.held[n] = array("q")
            heapq.heappush(self.levels, -n)
        own.append(key)

    def pop(self) -> int | None:
        while self.front or self.levels:
            if self.front and not (self.levels and -self.levels[0] > self.level):
                key = heapq.heappop(self.front).key
                if self.counts.get(key) == self.level:
                    return key
                continue
            if self.front:  # a larger count has come up
                back, self.front = self.front, []
                for p in back:
                    self.add(p.key, self.level)
            self.level = -heapq.heappop(self.levels)
            keys = np.unique(np.frombuffer(self.held.pop(self.level), np.int64)).tolist()
            keys = [k for k in keys if self.counts.get(k) == self.level]
            if len(keys) > FRONT:
                first = heapq.nlargest(FRONT, keys, key=self.strings)
                taken = set(first)
                left = array("q", (k for k in keys if k not in taken))
                keys = first
                self.held[self.level] = left
                heapq.heappush(self.levels, -self.level)
                self.floor = self.strings(first[-1])
            else:
                self.floor = ("", "")
            self.front = [_Pair(k, *self.strings(k)) for k in keys]
            heapq.heapify(self.front)
        return None


class _Pair:
    """A pair in the queue: before smaller pairs."""

    __slots__ = ("key", "a", "b")

    def __init__(self, key: int, a: str, b: str):
        self.key, self.a, self.b = key, a, b

    def __lt__(self, other: _Pair) -> bool:
        return (self.a, self.b) > (other.a, other.b)


def train_bpe(freqs: dict[str, int], vocab_size: int, most: int | None = None) -> tuple[dict[str, int], list[tuple[str, str]], int]:
    """``train_words`` of word frequencies."""
    return train_words(*_points([*freqs]), np.fromiter(freqs.values(), np.int64, len(freqs)), vocab_size, most)


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of words, end to end, and the lengths of these."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.fromiter(map(len, words), np.int32, len(words))


def _first_pairs(symbols: np.ndarray, lengths: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Adjacent pairs of ``n`` symbols within words: pairs (left * n + right), their counts, where each begins in the last, the words of each."""
    inside = np.ones(len(symbols), bool)
    inside[np.cumsum(lengths, dtype=np.int64)[lengths > 0] - 1] = False
    left = np.flatnonzero(inside)
    del inside
    keys = symbols[left].astype(np.int64)
    keys *= n
    left += 1
    keys += symbols[left]
    del left
    listed = None
    if n * n >= 1 << 31:  # beside the number of a word only 31 bits are left
        listed = np.unique(keys)
        keys = np.searchsorted(listed, keys)
    keys <<= 32
    keys |= np.repeat(np.arange(len(lengths), dtype=np.int32), np.maximum(lengths - 1, 0))
    keys.sort()
    words = keys.astype(np.int32)  # the lower half
    keys >>= 32
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    pairs = keys[begins]
    del keys
    counts = np.add.reduceat(weights[words], begins) if len(begins) else np.zeros(0, np.int64)
    return pairs if listed is None else listed[pairs], counts, np.append(begins, len(words)), words


def train_words(points: np.ndarray, lengths: np.ndarray, weights: np.ndarray, vocab_size: int, most: int | None = None) -> tuple[dict[str, int], list[tuple[str, str]], int]:
    """vocab, merges and vocab_size from distinct words (code points end to end, lengths) and their frequencies.

    Ids 0 to 3 are special, then come the characters by code point, then merges. Ties
    go to the larger pair. Training stops at ``vocab_size`` (or after ``most`` merges),
    without pairs, or when the best pair occurs once. Two merges of equal string both count; the later id stays.

    Words are numbers of symbols in one array, four bytes each; a pair knows the words
    in which it came up, so a merge touches those words alone. Pairs that occur once are
    never merged and not kept: the occurrences of a pair are made by the merge that makes
    the later of its symbols, and go on from there only to get fewer, unless another merge
    makes an equal string. Then the pairs of that symbol are counted again, in the words
    that have held it.
    """
    if vocab_size < FIRST_ID:
        raise ValueError("the vocabulary needs room for four special tokens")
    vocab = {t: i for i, t in enumerate(("<PAD>", "<UNK>", "<BOS>", "<EOS>"))}
    alphabet = np.unique(points)
    names = [*map(chr, alphabet.tolist())]
    for ch in names:
        vocab[ch] = len(vocab)
    size = len(vocab)
    number = {ch: i for i, ch in enumerate(names)}  # of a string's first symbol; merges of equal string share it
    symbols = np.searchsorted(alphabet, points).astype(np.int32)
    del points
    begins = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=begins[1:])
    pairs, n, first, listed = _first_pairs(symbols, lengths, weights, max(1, len(names)))
    lengths = lengths.copy()
    keys = ((pairs // max(1, len(names))) << 32 | pairs % max(1, len(names))).tolist()
    spans = dict(zip(keys, zip(first[:-1].tolist(), first[1:].tolist(), strict=True), strict=True))  # of pairs of characters, in ``listed``
    counts: dict[int, int] = {k: c for k, c in zip(keys, n.tolist(), strict=True) if c >= 2}
    del pairs, n, first, keys
    where: dict[int, array] = {}
    holders: dict[int, array] = {}  # the words in which a merge has put its symbol

    def noted(key: int, word: int) -> None:
        own = where.get(key)
        if own is None:
            where[key] = array("i", (word,))
        elif own[-1] != word:
            own.append(word)

    def own_pairs(own: list[int], symbol: int) -> Iterator[int]:
        for j in range(len(own) - 1):
            if own[j] == symbol or own[j + 1] == symbol:
                yield own[j] << 32 | own[j + 1]

    merges: list[tuple[str, str]] = []
    queue = _Queue(counts, names)
    while size < vocab_size and len(merges) != most:
        best = queue.pop()
        if best is None:
            break
        a, b = best >> 32, best & 0xFFFFFFFF
        merges.append((names[a], names[b]))
        text = names[a] + names[b]
        vocab[text] = size
        size += 1
        delta: dict[int, int] = defaultdict(int)
        made = number.get(text)
        if made is None:
            made = number[text] = len(names)
            names.append(text)
            holders[made] = array("i")
        else:
            for i in {*holders[made]}:  # pairs that were not kept
                own = symbols[begins[i] : begins[i] + lengths[i]].tolist()
                for key in own_pairs(own, made):
                    if key not in counts:
                        delta[key] += int(weights[i])
                        noted(key, i)
        begin, end = spans.pop(best, (0, 0))
        inside = np.concatenate([listed[begin:end], np.frombuffer(where.pop(best, array("i")), np.int32)])
        if len(inside) > AT_ONCE:
            for some in np.array_split(inside := np.unique(inside), -(-len(inside) // STRIP)):
                changed, keys, sums, pairs, words = _merge(symbols, begins, lengths, weights, some, a, b, made)
                for key, change in zip(keys.tolist(), sums.tolist(), strict=True):
                    delta[key] += change
                firsts = np.flatnonzero(np.diff(pairs, prepend=-1))
                for key, first, last in zip(pairs[firsts].tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(pairs)], strict=False):
                    where.setdefault(key, array("i")).frombytes(words[first:last].tobytes())
                holders[made].frombytes(changed.tobytes())
            inside = inside[:0]
        for i in inside.tolist():
            at = begins[i]
            own = symbols[at : at + lengths[i]].tolist()
            out, j, last = [], 0, len(own) - 1
            while j <= last:
                if own[j] == a and j < last and own[j + 1] == b:
                    out.append(made)
                    j += 2
                else:
                    out.append(own[j])
                    j += 1
            if len(out) == len(own):
                continue  # the word has lost the pair since
            n = int(weights[i])
            for j in range(last):
                delta[own[j] << 32 | own[j + 1]] -= n
            symbols[at : at + len(out)] = out
            lengths[i] = len(out)
            for j in range(len(out) - 1):
                delta[out[j] << 32 | out[j + 1]] += n
            for key in own_pairs(out, made):
                noted(key, i)
            holders[made].append(i)
        for key, change in delta.items():
            held = counts.get(key)
            if held is None and key >> 32 != made and key & 0xFFFFFFFF != made:
                continue  # not kept before, and fewer now
            left = (held or 0) + change
            if left < 2:
                counts.pop(key, None)
                where.pop(key, None)
                spans.pop(key, None)
            elif left != held:
                counts[key] = left
                queue.add(key, left)
    return vocab, merges, size


#: More words than these are merged as arrays, in strips of so many.
AT_ONCE, STRIP = 256, 1 << 18


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of ``n`` over each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[begins], np.add.reduceat(n[order], begins) if len(begins) else np.zeros(0, np.int64)


def _merge(symbols: np.ndarray, begins: np.ndarray, lengths: np.ndarray, weights: np.ndarray, words: np.ndarray, a: int, b: int, made: int) -> tuple[np.ndarray, ...]:
    """``made`` in place of ``a``, ``b`` in distinct words, in their arrays.

    Gives the words that had the pair; the pairs whose counts change, and by how much; and
    pairs that hold ``made``, in order, with a word of each, every such (pair, word) once.
    """

    def gathered(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = lengths[words]
        ends = np.cumsum(n, dtype=np.int64)
        return np.repeat(begins[words] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0), np.repeat(np.arange(len(words), dtype=np.int32), n)

    def pairs_of(own: np.ndarray, of: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero((of[1:] == of[:-1]) & (chosen[1:] | chosen[:-1]))
        return own[at].astype(np.int64) << 32 | own[at + 1], of[at]

    places, of = gathered(words)
    own = symbols[places]
    at = np.flatnonzero((own[:-1] == a) & (own[1:] == b) & (of[1:] == of[:-1]))
    has = np.zeros(len(words), bool)
    has[of[at]] = True
    words = words[has]
    places, of = gathered(words)
    own = symbols[places]
    at = np.flatnonzero((own[:-1] == a) & (own[1:] == b) & (of[1:] == of[:-1]))
    at = at[_apart(at)]
    chosen = own == made
    chosen[at] = chosen[at + 1] = True
    gone, gone_of = pairs_of(own, of, chosen)
    own[at] = made
    left = np.ones(len(own), bool)
    left[at + 1] = False
    own, of = own[left], of[left]
    come, come_of = pairs_of(own, of, own == made)
    n = weights[words]
    keys, sums = _summed(np.concatenate([gone, come]), np.concatenate([-n[gone_of], n[come_of]]))
    lengths[words] = np.bincount(of, minlength=len(words))
    symbols[gathered(words)[0]] = own
    order = np.lexsort((come_of, come))
    pairs, held = come[order], words[come_of[order]]
    new = np.append(True, (pairs[1:] != pairs[:-1]) | (held[1:] != held[:-1])) if len(pairs) else np.zeros(0, bool)
    return words.astype(np.int32), keys, sums, pairs[new], held[new].astype(np.int32)


#: What training comes to, as one row.
TRAINED = "vocab map<string,int>, merges array<struct<a:string,b:string>>, size int"


def train_on(words: DataFrame, vocab_size: int, most: int | None = None) -> tuple[dict[str, int], list[tuple[str, str]], int]:
    """``train_words`` of a word table (word, freq), in one task; the driver only gets what is learned.

    The word table of the trainer's sample has to fit into a task: see ``catalog.tokenizer_texts``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, lengths, weights = [], [], []
        for batch in batches:
            p, n = _points(batch.column("word").to_pylist())
            points.append(p)
            lengths.append(n)
            weights.append(batch.column("freq").to_numpy())
        points, lengths, weights = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((points, np.uint32), (lengths, np.int32), (weights, np.int64)))
        vocab, merges, size = train_words(points, lengths, weights, vocab_size, most)
        row = [[[*vocab.items()]], [[{"a": a, "b": b} for a, b in merges]], [size]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, arrow, strict=True)], schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(TRAINED))
    made = Scratch(words.sparkSession, "bpe-train").save(words.select("word", "freq").repartition(1).mapInArrow(run, TRAINED), "learned")
    row = made.first()
    return row["vocab"], [tuple(m) for m in row["merges"]], row["size"]


def merge_pair(symbols: list[str], pair: tuple[str, str]) -> list[str]:
    """Left to right, without overlaps."""
    out, i = [], 0
    while i < len(symbols):
        if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
            out.append(symbols[i] + symbols[i + 1])
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def encode_word(word: str, merges: list[tuple[str, str]], ranks: dict[tuple[str, str], list[int]]) -> list[str]:
    """One pass over the merges in learned order; only merges whose pair is present are visited."""
    symbols, at = list(word), -1
    while len(symbols) > 1:
        later = (r for p in zip(symbols, symbols[1:]) for r in ranks.get(p, ()) if r > at)  # noqa: B905
        nxt = min(later, default=None)
        if nxt is None:
            return symbols
        symbols, at = merge_pair(symbols, merges[nxt]), nxt
    return symbols


def _ranks(merges: list[tuple[str, str]]) -> dict[tuple[str, str], list[int]]:
    ranks: dict[tuple[str, str], list[int]] = defaultdict(list)
    for i, m in enumerate(merges):
        ranks[tuple(m)].append(i)
    return ranks


def encode_text(text: str, vocab: dict[str, int], merges: list[tuple[str, str]]) -> list[int]:
    """The ids of one text, on the driver."""
    import regex

    ranks = _ranks(merges)
    return [vocab.get(s, UNK) for w in regex.findall(PRETOKEN, text) for s in encode_word(w, merges, ranks)]


#: Texts are encoded in blocks of so many characters at most, or one longer text; a block's words are encoded once.
BLOCK_CHARS = 4_000_000
#: Words of a task's first block, the most frequent ones, that stay encoded for its later blocks.
COMMON = 10_000

_WORD, _BLANK, _ALONE, _RETURN, _LINE = range(5)
#: Kinds of bytes. Those that are alone are in no longer pre-token.
_KINDS = np.full(256, _WORD, np.uint8)
_KINDS[[*range(32), 127, *b"\"#$'(),;?@[\\]`{}~"]] = _ALONE
_KINDS[[*b" \t"]], _KINDS[13], _KINDS[10] = _BLANK, _RETURN, _LINE


def _pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts cut where a pre-token always ends, end to end; and where each text ends in these pieces, after a 0.

    No pre-token holds characters of two kinds but for a line end, so the pre-tokens
    of a piece are those of the text there, and equal pieces have equal ones.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, places, held = texts.buffers()
    rows = np.frombuffer(places, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(held or b"", np.uint8)[rows[0] : rows[-1]]
    rows = rows - rows[0]
    kinds = _KINDS[data]
    left, right = kinds[:-1], kinds[1:]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = ((left != right) & ~((left == _RETURN) & (right == _LINE))) | (right == _ALONE) | (left == _LINE)
    cut[rows] = True
    at = np.flatnonzero(cut)
    pieces = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
    return pieces, np.searchsorted(at, rows)


def _words_of(pieces: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pre-tokens of pieces as numbers in ``known``, which grows, end to end; and where each piece ends in these, after a 0."""
    import regex

    found = [*map(regex.compile(PRETOKEN).findall, pieces)]
    ends = np.cumsum([0, *map(len, found)])
    return np.fromiter((known.setdefault(w, len(known)) for words in found for w in words), np.int32, ends[-1]), ends


def _blocks(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive parts of at most ``BLOCK_CHARS`` characters, or of one longer text."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_CHARS, "right")))
        yield texts.slice(at, end - at)
        at = end


def _listed(lists: pa.Array, refs: np.ndarray, ends: np.ndarray) -> pa.Array:
    """For each span of ``refs`` that ends at ``ends``, the lists that it names, as one list."""
    found = lists.take(pa.array(refs))
    sums = np.concatenate([[0], np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False), dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(sums[ends].astype(np.int32)), found.flatten())


class _Encoder:
    """Ids of texts by merges, for one task. What ``encode_word`` does to a word is done to all words of a block at once."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        chars = [s for s in vocab if len(s) == 1]
        number = {s: i for i, s in enumerate(dict.fromkeys([*chars, *(s for a, b in merges for s in (a, b, a + b))]), 1)}  # 0: any other character
        self.ids = np.array([UNK, *(vocab.get(s, UNK) for s in number)], np.int32)
        singles = [s for s in number if len(s) == 1]
        self.table = np.zeros(max(map(ord, singles), default=0) + 2, np.int32)
        self.table[[*map(ord, singles)]] = [number[s] for s in singles]
        self.n, self.steps = len(self.ids), len(merges) + 1
        self.made = np.array([number[a + b] for a, b in merges], np.int32)
        pairs = np.array([number[a] * self.n + number[b] for a, b in merges], np.int64)
        self.order = np.sort(pairs * self.steps + np.arange(len(merges)))  # by pair, then rank
        self.held: dict[str, int] = {}
        self.lists = pa.array([], pa.list_(pa.int32()))

    def words(self, words: list[str]) -> pa.Array:
        """One pass over the merges in learned order for each word; every round makes the next merge of each."""
        points, lengths = _points(words)
        symbols = self.table[np.minimum(points, len(self.table) - 1)]
        of, least = np.repeat(np.arange(len(words), dtype=np.int32), lengths), np.zeros(len(words), np.int64)
        done = []
        while len(of):
            pairs = np.flatnonzero(of[1:] == of[:-1])
            keys = (symbols[pairs].astype(np.int64) * self.n + symbols[pairs + 1]) * self.steps
            at = np.searchsorted(self.order, keys + least[of[pairs]])
            ranks = np.append(self.order, -1)[at] - keys
            hit = (ranks >= 0) & (ranks < self.steps)
            pairs, ranks = pairs[hit], ranks[hit]
            begins = np.flatnonzero(np.append(True, np.diff(of[pairs]) != 0)) if len(pairs) else pairs
            found = of[pairs[begins]]
            going = np.zeros(len(words), bool)
            going[found] = True
            still = going[of]
            done.append((of[~still], symbols[~still]))
            if not len(found):
                break
            least[found] = np.minimum.reduceat(ranks, begins) + 1
            mine = ranks + 1 == least[of[pairs]]
            pairs, ranks = pairs[mine], ranks[mine]
            taken = _apart(pairs)
            pairs, ranks = pairs[taken], ranks[taken]
            symbols[pairs] = self.made[ranks]
            still[pairs + 1] = False
            symbols, of = symbols[still], of[still]
        of, symbols = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (of, symbols)
        ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(words)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(self.ids[symbols[np.argsort(of, kind="stable")]]))

    def texts(self, texts: pa.Array) -> pa.Array:
        """The ids of a block of texts."""
        pieces, rows = _pieces(texts)
        coded = pieces.dictionary_encode()
        known = dict(self.held)
        refs, ends = _words_of(coded.dictionary.to_pylist(), known)
        lists = pa.concat_arrays([self.lists, self.words([*known][len(self.held) :])])
        places = coded.indices.to_numpy()
        if not self.held and len(known):
            uses = np.bincount(refs, np.repeat(np.bincount(places, minlength=len(ends) - 1), np.diff(ends)))
            often = np.argsort(-uses, kind="stable")[:COMMON]
            names = [*known]
            self.held, self.lists = {names[i]: j for j, i in enumerate(often)}, lists.take(pa.array(often))
        return _listed(_listed(lists, refs, ends), places, rows)


def _apart(places: np.ndarray) -> np.ndarray:
    """Which places, in order, do not follow a taken one: of a run the first, the third and so on."""
    runs = np.append(True, np.diff(places) != 1) if len(places) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(runs, np.arange(len(places)), 0))
    return (np.arange(len(places)) - first) % 2 == 0


def encode_words(docs: DataFrame, vocab: dict[str, int], merges: list[tuple[str, str]], text: str = "txt") -> DataFrame:
    """``docs`` with ids, an array<int>, in place of ``text``: a block's distinct words are encoded once, where its texts are.

    Nothing is shuffled or written, so the work grows with the characters. Texts are cut where
    pre-tokens always end, and only distinct pieces are searched for these.

    Null and empty texts have no ids. Repeated rows stay, other columns are passed through (not named
    ids); so is the order. An empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(vocab, merges)
        for batch in batches:
            at = 0
            for part in _blocks(batch.column(text)):
                few = batch.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays([*(few.column(c) for c in kept), encoder.texts(part)], names=[*kept, "ids"])

    return docs.mapInArrow(run, StructType([*(docs.schema[c] for c in kept), StructField("ids", ArrayType(IntegerType()))]))


def first_difference(a: Column, b: Column) -> Column:
    """The 0-based place of the first character in which two texts differ; null for equal ones."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    return F.when(a != b, F.array_position(pairs, False).cast("int") - 1)


def with_marks(ids: Column, bos: bool, eos: bool) -> Column:
    parts = [F.array(F.lit(BOS))] * bos + [ids] + [F.array(F.lit(EOS))] * eos
    return F.concat(*parts)


def decode(ids: Column, names: Column) -> Column:
    """Concatenation of names[id]; special and unknown ids give nothing. ``names`` is an array from id 0."""
    return F.array_join(
        F.transform(F.filter(ids, lambda i: (i >= FIRST_ID) & (i < F.size(names))), lambda i: F.element_at(names, i + 1)), ""
    )
