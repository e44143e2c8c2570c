"""Registered queries over documents and conversations."""

from __future__ import annotations

import hashlib
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quern.functions import text as T
from quern.operators import builder, tokens, windows
from quern.sources import catalog, jsonl
from quern.storage import Scratch
from quern.streaming import endless

LENGTH = 128
VOCAB = 40
#: Fixed value: the vocabulary that the tokenizer is trained to.
TRAINED = 32_768
#: Merges that the SQL beside the trainer follows.
FOLLOWED = 16
SEED = 42
#: Fixed value: records that a build aims at.
QUOTA = 1_000_000
SUBSET = 200
SAMPLE = 256
BATCH = 4
EPOCHS = 3
#: Windows that are put into strings at a time.
WINDOWS = 8_192
GROUPS = list(catalog.GROUPS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def group_of(source: Column) -> Column:
    """A group by the first number in a source's name; ``other`` where there is none."""
    n = F.regexp_extract(source, r"(\d+)", 1).try_cast("int") % 4
    return F.coalesce(F.element_at(F.array(*(F.lit(g) for g in GROUPS)), n + 1), F.lit("other"))


def trust_of(group: Column) -> Column:
    out = F.lit(jsonl.DEFAULT_TRUST)
    for name, trust in catalog.GROUP_TRUST.items():
        out = F.when(group == name, F.lit(trust)).otherwise(out)
    return out


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, txt, grp: extracted texts of every document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.plain_text(F.col("text"), F.lit(None).cast("string")).alias("txt"), group_of(F.col("source")).alias("grp"))


def joined_ids(ids: Column) -> Column:
    return F.md5(F.array_join(ids.cast("array<string>"), " "))


@F.arrow_udf(StringType())
def window_digest(ids: pa.Array) -> pa.Array:
    """``joined_ids`` of short lists, none of them or of their numbers null: each different number becomes a string once."""
    found = []
    for at in range(0, len(ids), WINDOWS):
        some = ids.slice(at, WINDOWS)
        coded = some.flatten().dictionary_encode()
        names = pc.binary_join_element_wise(coded.dictionary.cast(pa.string()), "", " ").take(coded.indices)  # end to end in one buffer
        places = np.frombuffer(names.buffers()[1], np.int32)[names.offset :]
        held = memoryview(names.buffers()[2] or b"")
        ends = places[np.append(0, np.cumsum(pc.list_value_length(some).to_numpy()))].tolist()
        found += [hashlib.md5(held[i : max(i, j - 1)]).hexdigest() for i, j in pairwise(ends)]
    return pa.array(found, pa.string())


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``base``, stripped once and written, for queries that read it more than once."""
    return Scratch(spark, name).save(base(spark, sf_dir), "texts")


def cut_texts(docs: DataFrame) -> DataFrame:
    """Texts of at least 50 characters, cut to what the window builder reads."""
    return docs.where(F.length("txt") >= T.MIN_CHARS).withColumn("txt", F.substring("txt", 1, T.MAX_CHARS))


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, grp, ids: character ids of the texts of at least 50 characters."""
    docs = texts(spark, sf_dir, "encoded")
    vocab = tokens.char_vocab(docs.select(F.col("txt").alias("text")))
    return tokens.encode_texts(cut_texts(docs), vocab)


def whole_texts(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, ids of every text, whole; and the vocabulary. Texts are stripped once."""
    docs = texts(spark, sf_dir, name).select("doc_id", "txt")
    vocab = tokens.char_vocab(docs.select(F.col("txt").alias("text")))
    return tokens.encode_texts(docs, vocab), vocab


def window_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, trust_score, n of each row of ``windowed``: its ids but PAD. A character is an id, so lengths are enough."""
    docs = base(spark, sf_dir).select("grp", F.least(F.length("txt"), F.lit(T.MAX_CHARS)).alias("_n")).where(F.col("_n") >= T.MIN_CHARS)
    rows = docs.select("grp", F.explode(windows.sizes(F.col("_n"), LENGTH)).alias("n"))
    return rows.select(F.col("grp").alias("source"), trust_of(F.col("grp")).alias("trust_score"), F.col("n").cast("long").alias("n"))


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, grp, window, input_ids, labels, trust_score, source."""
    rows = windows.token_windows(encoded(spark, sf_dir), LENGTH)
    return rows.withColumn("trust_score", trust_of(F.col("grp"))).withColumn("source", F.col("grp"))


def source_texts(spark, sf_dir):
    docs = base(spark, sf_dir).where(F.length("txt") >= T.MIN_CHARS)
    return docs.select("doc_id", "grp", F.length("txt").alias("n"), F.md5("txt").alias("digest"))


def extract_text(spark, sf_dir):
    return base(spark, sf_dir).select("doc_id", "txt")


def _solved_parts(docs):
    """``docs`` plus problem (the first line), solution (the rest) and, for even ids, generated_solution."""
    text = F.coalesce("text", F.lit(""))
    at = F.instr(text, "\n")
    first = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    rest = F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise("")
    made = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Generated: "), rest))
    return docs.withColumns({"problem": first, "solution": rest, "generated_solution": made})


def _parts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return _solved_parts(docs).drop("text")


def _extracted(spark, sf_dir, fmt):
    df = _parts(spark, sf_dir)
    record = {c: F.col(c) for c in ("problem", "solution", "generated_solution", "lang")}
    return df.select("doc_id", T.extract(F.lit(fmt), record).alias("txt"))


def extract_magicoder(spark, sf_dir):
    return _extracted(spark, sf_dir, "magicoder")


def extract_problem_solution(spark, sf_dir):
    return _extracted(spark, sf_dir, "problem_solution")


def extract_math_instruct(spark, sf_dir):
    return _extracted(spark, sf_dir, "math_instruct")


def extract_conversations(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("value"), F.lit("").alias("content")))).alias("turns")
    )
    return rows.select("conv_id", T.extract(F.lit("conversations"), {"turns": F.col("turns")}).alias("txt"))


def score_filter(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    docs = base(spark, sf_dir).join(labels, "doc_id", "left")
    return docs.where((F.coalesce("quality", F.lit(0.0)) >= 1.0) & (F.length("txt") >= T.MIN_CHARS)).select("doc_id", "quality")


def vocab_range(spark, sf_dir):
    rows = windows.validate(windowed(spark, sf_dir), VOCAB)
    return rows.select("doc_id", "window", F.col("problem").isNull().alias("ok"))


def _flawed(spark, sf_dir):
    rows = windowed(spark, sf_dir)
    return (
        rows.withColumn("source", F.when(F.col("doc_id") % 7 != 0, F.col("source")))
        .withColumn("trust_score", F.when(F.col("doc_id") % 11 != 0, F.col("trust_score")))
        .withColumn("labels", F.when(F.col("doc_id") % 13 == 0, F.slice("labels", 1, 50)).otherwise(F.col("labels")))
    )


def validate_records(spark, sf_dir):
    return windows.validate(_flawed(spark, sf_dir), 1 << 20).groupBy("problem").agg(F.count("*").alias("n"))


def valid_subset(spark, sf_dir):
    sound = windows.validate(_flawed(spark, sf_dir), 1 << 20).where("problem is null")
    return windows.take_first(sound.select("doc_id", "window", joined_ids(F.col("input_ids")).alias("digest")), ["doc_id", "window"], SUBSET)


def source_stats(spark, sf_dir):
    n = F.col("n")
    return window_sizes(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_records"), F.sum(n).alias("n_tokens"), F.round(F.avg(n), 6).alias("mean_tokens"))


def build_totals(spark, sf_dir):
    n = F.col("n")
    return window_sizes(spark, sf_dir).agg(F.count("*").alias("n_records"), F.coalesce(F.sum(n), F.lit(0)).alias("n_tokens"), F.round(F.avg(n), 6).alias("mean_tokens"))


def group_mix(spark, sf_dir):
    counts = window_sizes(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    fixed = spark.createDataFrame([(i, g) for i, g in enumerate([*GROUPS, "other"])], "ord int, source string")
    rows = fixed.join(counts, "source", "left").select("ord", "source", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    total = rows.agg(F.sum("n").alias("all_n"))
    share = F.when(F.col("all_n") > 0, F.col("n") * 100.0 / F.col("all_n")).otherwise(0.0)
    return rows.crossJoin(F.broadcast(total)).select("ord", "source", "n", F.round(share, 6).alias("pct"))


def _words(spark, sf_dir):
    return tokens.word_freq(base(spark, sf_dir).select(F.col("txt").alias("text")))


def word_freq(spark, sf_dir):
    return _words(spark, sf_dir)


def char_vocab(spark, sf_dir):
    return tokens.char_vocab(base(spark, sf_dir).select(F.col("txt").alias("text")))


def bpe_pair_counts(spark, sf_dir):
    return tokens.pair_counts(_words(spark, sf_dir))


def bpe_best_pair(spark, sf_dir):
    return tokens.best_pair(tokens.pair_counts(_words(spark, sf_dir)))


def _sample(spark, sf_dir, n):
    """The first int(n * share) texts of each group, cut to what the tokenizer reads."""
    docs = base(spark, sf_dir).where(F.length("txt") >= T.MIN_CHARS).select("doc_id", "grp", F.substring("txt", 1, T.TOKENIZER_CHARS).alias("text"))
    return windows.first_of_each(docs, "grp", ["doc_id"], {group: int(n * share) for group, share in catalog.GROUPS.items()})


def tokenizer_sample(spark, sf_dir):
    return _sample(spark, sf_dir, catalog.tokenizer_texts(QUOTA)).select("doc_id", "grp", F.md5("text").alias("digest"))


def _trained(spark, sf_dir, most=None):
    return tokens.train_on(tokens.word_freq(_sample(spark, sf_dir, catalog.tokenizer_texts(QUOTA))), TRAINED, most)


def bpe_merges(spark, sf_dir):
    vocab, merges, _ = _trained(spark, sf_dir)
    rows = [(i, a, b, vocab[a + b]) for i, (a, b) in enumerate(merges)]
    return spark.createDataFrame(rows, "rank int, a string, b string, id int")


def bpe_first_merges(spark, sf_dir):
    """The first merges of ``bpe_merges``, as many as SQL can follow step by step."""
    _, merges, _ = _trained(spark, sf_dir, FOLLOWED)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "rank int, a string, b string")


def _encoded(spark, sf_dir, most=None):
    vocab, merges, _ = _trained(spark, sf_dir, most)
    ids = tokens.encode_words(base(spark, sf_dir).select("doc_id", "txt"), vocab, merges)
    return ids.select("doc_id", F.size("ids").alias("n_tokens"), joined_ids(F.col("ids")).alias("digest"))


def encode_bpe(spark, sf_dir):
    return _encoded(spark, sf_dir)


def encode_bpe_first(spark, sf_dir):
    """``encode_bpe`` with the tokenizer of ``bpe_first_merges``."""
    return _encoded(spark, sf_dir, FOLLOWED)


def encode_char(spark, sf_dir):
    rows, _ = whole_texts(spark, sf_dir, "encode")
    ids = rows.select("doc_id", tokens.with_marks(F.col("ids"), True, True).alias("ids"))
    return ids.select("doc_id", F.size("ids").alias("n_tokens"), joined_ids(F.col("ids")).alias("digest"))


def decode_roundtrip(spark, sf_dir):
    ids, vocab = whole_texts(spark, sf_dir, "decode")
    names = vocab.agg(F.array_sort(F.collect_list(F.struct("id", "ch"))).alias("v")).select(
        F.concat(F.array_repeat(F.lit(""), tokens.FIRST_ID), F.transform("v", lambda x: x["ch"])).alias("names")
    )
    rows = ids.crossJoin(F.broadcast(names))  # one row, one name for each character
    return rows.select("doc_id", F.md5(tokens.decode(F.col("ids"), F.col("names"))).alias("digest"))


def round_trip(spark, sf_dir):
    """Texts against what a tokenizer that knows ASCII only makes of them: the first character that is lost."""
    docs = base(spark, sf_dir).select("doc_id", "txt")
    vocab = spark.createDataFrame([(chr(i), i + tokens.FIRST_ID) for i in range(128)], "ch string, id int")
    names = F.array(*(F.lit("") for _ in range(tokens.FIRST_ID)), *(F.lit(chr(i)) for i in range(128)))
    ids = tokens.encode_texts(docs.withColumn("whole", F.col("txt")), vocab)
    return ids.select("doc_id", tokens.first_difference(F.col("whole"), tokens.decode(F.col("ids"), names)).alias("differs"))


def pretokenize(spark, sf_dir):
    found = base(spark, sf_dir).select("doc_id", T.pretokens(F.col("txt")).alias("p"))
    return found.select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", "|")).alias("digest"))


def length_stats(spark, sf_dir):
    return window_sizes(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("rows"),
        F.round(F.avg("n"), 6).alias("mean_n"),
        F.round(F.stddev_samp("n"), 6).alias("std_n"),
        F.min("n").alias("min_n"),
        F.max("n").alias("max_n"),
        F.round(F.avg("trust_score"), 6).alias("mean_trust"),
    )


def missing_tags(spark, sf_dir):
    first = windows.take_first(base(spark, sf_dir).select("doc_id", "grp"), ["doc_id"], 1_000)
    wanted = F.array(*(F.lit(g) for g in [*GROUPS, "other"]))
    return first.agg(F.array_join(F.array_sort(F.array_except(wanted, F.collect_set("grp"))), ",").alias("missing"))


def token_windows(spark, sf_dir):
    ids = F.col("input_ids")
    return windowed(spark, sf_dir).select("doc_id", "window", joined_ids(ids).alias("ids"), joined_ids(F.col("labels")).alias("labels"))


def _unique(spark, sf_dir, *kept):
    return windows.dedup_prefix(windowed(spark, sf_dir), ["doc_id", "window"], *kept)


def dedup_prefix(spark, sf_dir):
    return _unique(spark, sf_dir, joined_ids(F.col("input_ids")).alias("digest"))


def difficulty_sort(spark, sf_dir):
    rows = _unique(spark, sf_dir, F.col("source"), windows.difficulty(F.col("input_ids")).alias("difficulty"))
    return rows.orderBy("difficulty", "doc_id", "window").withColumn("difficulty", F.round("difficulty", 9))


def quota_mix(spark, sf_dir):
    targets = list(catalog.group_targets(QUOTA).items())
    rows = windowed(spark, sf_dir).select("source", "doc_id", "window", "input_ids")
    mixed = windows.quota_mix(rows, targets, ["doc_id", "window"], Scratch(spark, "quota"))
    return mixed.select("source", "doc_id", "window", joined_ids(F.col("input_ids")).alias("digest"))


#: What stands for each stream of the catalogue, by the first number in a document's source.
STREAMS = list(dict.fromkeys(x.read_from for x in catalog.SOURCES))


def _raw(spark, sf_dir) -> dict[str, DataFrame]:
    """Documents as raw records of the catalogue's streams; a source without a number is of the last one."""
    docs = table(spark, sf_dir, "documents")
    n = F.coalesce(F.regexp_extract("source", r"(\d+)", 1).try_cast("int") % len(STREAMS), F.lit(len(STREAMS) - 1))
    rows = Scratch(spark, "raw").save(docs.select("doc_id", "text", "lang", n.alias("_stream")), "records")  # the fields are made of these when read
    turn = F.struct(F.lit("human").alias("from"), F.col("text").alias("value"), F.lit("").alias("role"), F.lit("").alias("content"))
    fields = [F.col("doc_id").alias("ord"), "text", "lang", "problem", "solution", "generated_solution", F.array(turn).alias("conversations")]
    return {s: _solved_parts(rows.where(F.col("_stream") == i)).select(*fields) for i, s in enumerate(STREAMS)}


def build(spark, sf_dir):
    """The corpus builder over all documents, at its production number of records."""
    docs = texts(spark, sf_dir, "build")
    vocab = Scratch(spark, "build-vocab").save(tokens.char_vocab(docs.select(F.col("txt").alias("text"))), "vocab")
    built = builder.build(_raw(spark, sf_dir), lambda rows: tokens.encode_texts(rows, vocab), QUOTA, TRAINED, LENGTH, SEED)
    return built.records.select("name", "source", F.col("ord").alias("doc_id"), "window", "k", "slot", joined_ids(F.col("input_ids")).alias("digest"), F.round("difficulty", 9).alias("difficulty"))


def sample_mix(spark, sf_dir):
    return builder.source_mix(windows.reservoir_sample(base(spark, sf_dir).select("doc_id", F.col("grp").alias("source")), SAMPLE, SEED, "doc_id"))


def _named(spark, sf_dir):
    """Documents under names of catalogue sources, and one that is not in it."""
    names = F.array(*(F.lit(x.name) for x in catalog.SOURCES), F.lit("elsewhere"))
    return table(spark, sf_dir, "documents").select("doc_id", F.element_at(names, (F.col("doc_id") % (len(catalog.SOURCES) + 1) + 1).cast("int")).alias("name"))


def catalogue_lookup(spark, sf_dir):
    """Records by catalogue source, with its group and trust: names that are not in the catalogue have none."""
    return catalog.with_catalogue(_named(spark, sf_dir)).groupBy("name", "group", "trust").agg(F.count("*").alias("n"))


def catalogue_streams(spark, sf_dir):
    """How many documents each stream feeds, through all sources that read it, and the first of these."""
    listed = catalog.frame(spark)
    own = F.broadcast(listed.select(F.col("name").alias("_name"), F.col("stream").alias("_stream")))
    read = _named(spark, sf_dir).join(own, F.col("name") == F.col("_name")).groupBy("_stream").agg(F.count("*").alias("n"))
    return catalog.streams(listed).join(read, F.col("stream") == F.col("_stream")).select("ord", "name", "stream", "n")


def skip_take(spark, sf_dir):
    docs = base(spark, sf_dir).select("doc_id", "grp", F.length("txt").alias("n"))
    sound = windows.with_ordinal(docs, [], "doc_id").where((F.col("k") >= 100) & (F.col("n") >= T.MIN_CHARS)).select("doc_id", "grp")
    return windows.take_first(sound, ["doc_id"], SUBSET)


def interleave(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(group_of(F.col("source")).alias("source"), "doc_id")
    return windows.interleave(rows, SEED, "doc_id").select("source", "k", "doc_id", "slot")


def reservoir_sample(spark, sf_dir):
    return windows.reservoir_sample(base(spark, sf_dir).select("doc_id", "grp"), SAMPLE, SEED, "doc_id")


def repack(spark, sf_dir):
    """The rows of windowed(), laid end to end by doc_id and window; none is cut, so a text's windows travel as one record."""
    docs, encode = _laid_texts(spark, sf_dir, "repack")
    placed = windows.starts(docs.withColumnRenamed("n", "_n"), [], "doc_id", "_n").select("txt", "trust_score", "start")
    packed = windows.batches(windows.cut_stream(placed, LENGTH, [], encode), BATCH, LENGTH)
    return packed.select("batch_id", "slot", window_digest("input_ids").alias("ids"), window_digest("labels").alias("labels"), "trust")


def _laid_texts(spark, sf_dir, name):
    """doc_id, txt, n, trust_score: texts and how many ids their windows have, laid end to end; and what puts these in place of txt."""
    docs = texts(spark, sf_dir, name)  # stripped once, read by each pass
    vocab = tokens.char_vocab(docs.select(F.col("txt").alias("text")))
    n = windows.windows_of(F.length("txt"), LENGTH) * LENGTH  # one id a character
    cut = cut_texts(docs).select("doc_id", "txt", n.cast("long").alias("n"), trust_of(F.col("grp")).alias("trust_score"))
    return cut, partial(tokens.encode_texts, vocab=vocab, lay=partial(windows.laid, length=LENGTH))


def endless_batches(spark, sf_dir):
    """Three epochs of the endless stream over the rows of windowed(), whole batches; a text's windows are one record."""
    records, encode = _laid_texts(spark, sf_dir, "endless")
    folder = Scratch(spark, "endless").path("corpus")
    endless.lay(records, "doc_id", LENGTH, folder)
    stream = endless.Endless(spark, folder, BATCH, encode=encode)
    found = stream.batches(0, EPOCHS * stream.tokens // (BATCH * stream.width))
    return found.select("batch_id", "slot", joined_ids(F.col("input_ids")).alias("ids"), joined_ids(F.col("labels")).alias("labels"), "trust")


def jsonl_scan(spark, sf_dir):
    """Lines that carry the texts and the lengths of their words, sound and unsound, read as records."""
    ids = F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.length(w))
    sound = F.to_json(F.struct(ids.alias("input_ids"), "text"))
    begun = F.expr("substring(line, 1, length(line) - 1)")
    kind = F.col("doc_id") % 6
    line = (
        F.when(kind == 0, F.concat(begun, F.lit(', "source": "code"}')))
        .when(kind == 1, F.concat(begun, F.lit(', "trust_score": null, "source": "code"}')))
        .when(kind == 2, begun)
        .when(kind == 3, F.concat(F.lit('{"input_ids": [], "trust_score": 5.0, '), F.expr("substring(line, 2)")))
        .otherwise(F.concat(begun, F.lit(', "trust_score": 95.5, "source": "math"}')))
    )
    lines = table(spark, sf_dir, "documents").select("doc_id", sound.alias("line")).select("doc_id", line.alias("value"))
    found = jsonl.parse_records(lines).where("problem is null")
    total = F.aggregate("input_ids", F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select("doc_id", F.size("input_ids").alias("n"), total.alias("total"), "trust_score", "source")


NAMES = [
    "source_texts", "extract_text", "extract_magicoder", "extract_problem_solution", "extract_math_instruct",
    "extract_conversations", "score_filter", "vocab_range", "validate_records", "valid_subset", "source_stats",
    "build_totals", "group_mix", "word_freq", "char_vocab", "bpe_pair_counts", "bpe_best_pair", "bpe_merges", "bpe_first_merges", "encode_bpe", "encode_bpe_first",
    "encode_char", "decode_roundtrip", "pretokenize", "tokenizer_sample", "length_stats", "missing_tags",
    "dedup_prefix", "quota_mix", "skip_take", "interleave", "difficulty_sort", "reservoir_sample", "token_windows",
    "repack", "endless_batches", "jsonl_scan", "build", "round_trip", "sample_mix", "catalogue_lookup", "catalogue_streams",
]


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}


# --- SQL ---------------------------------------------------------------------------


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_GRP = "coalesce([" + ", ".join(f"'{g}'" for g in GROUPS) + "][1 + TRY_CAST(regexp_extract(source, '(\\d+)', 1) AS INT) % 4], 'other')"
_TRUST = "CASE grp " + " ".join(f"WHEN '{g}' THEN {t}::DOUBLE" for g, t in catalog.GROUP_TRUST.items()) + f" ELSE {jsonl.DEFAULT_TRUST}::DOUBLE END"
_STRIP = _q(T.STRIP)
_BASE = f"""b AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), {_STRIP}, '', 'g') AS txt, {_GRP} AS grp FROM documents)"""
_CHARS = (
    _BASE
    + f""",
v AS (
  SELECT ch, row_number() OVER (ORDER BY unicode(ch)) + 3 AS id
  FROM (SELECT DISTINCT unnest(regexp_extract_all(txt, '(?s).')) AS ch FROM b)),
m AS (SELECT map_from_entries(list((ch, id))) AS m FROM v)"""
)
_ENC = (
    _CHARS
    + f""",
n AS (
  SELECT doc_id, grp, txt, list_transform(regexp_extract_all(txt[1:{T.MAX_CHARS}], '(?s).'), lambda c: m[c]::INT) AS ids
  FROM b, m WHERE length(txt) >= {T.MIN_CHARS})"""
)
_BODY = LENGTH - 2
_WIN = (
    _ENC
    + f""",
p AS (
  SELECT doc_id, grp, w AS win, ids[w * {_BODY} + 1 : (w + 1) * {_BODY}] AS c
  FROM n, unnest(range(0, (len(ids) + {_BODY} - 1) // {_BODY})) AS u(w)),
w AS (
  SELECT doc_id, grp, grp AS source, {_TRUST} AS trust_score, win::INT AS win, len(c) AS n_c,
    [2] || c || list_transform(range({LENGTH} - 1 - len(c)), lambda x: 0) AS input_ids,
    c || [3] || list_transform(range({LENGTH} - 1 - len(c)), lambda x: -100) AS labels
  FROM p WHERE len(c) + 1 >= 16)"""
)
_UNIQ = (
    _WIN
    + """,
o AS (
  SELECT *, row_number() OVER (PARTITION BY input_ids[1:64] ORDER BY doc_id, win) AS rn FROM w),
uq AS (SELECT * FROM o WHERE rn = 1)"""
)
_FLAW = (
    _WIN
    + """,
f AS (
  SELECT doc_id, win, input_ids, len(input_ids) AS n_i, CASE WHEN doc_id % 13 = 0 THEN 50 ELSE len(labels) END AS n_l,
    CASE WHEN doc_id % 7 <> 0 THEN source END AS s, CASE WHEN doc_id % 11 <> 0 THEN trust_score END AS t FROM w),
g AS (SELECT *, CASE WHEN s IS NULL OR t IS NULL THEN 'missing' WHEN n_i <> n_l THEN 'lengths' END AS problem FROM f)"""
)


def _ids(x: str) -> str:
    return f"md5(array_to_string({x}, ' '))"


def _solved(order: tuple[str, str], head: str = "''") -> str:
    problem = f"regexp_replace(problem, {_STRIP}, '', 'g')"
    solution = f"regexp_replace(coalesce(nullif({order[0]}, ''), nullif({order[1]}, ''), ''), {_STRIP}, '', 'g')"
    return f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS t, strpos(coalesce(text, ''), chr(10)) AS i FROM documents),
r AS (
  SELECT doc_id, lang, CASE WHEN i > 0 THEN t[1:i-1] ELSE t END AS problem, CASE WHEN i > 0 THEN t[i+1:] ELSE '' END AS solution FROM t),
x AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'Generated: ' || solution END AS generated FROM r),
y AS (SELECT doc_id, lang, {problem} AS p, {solution} AS s FROM x)
SELECT doc_id, CASE WHEN p <> '' AND s <> '' THEN {head} || 'Problem: ' || p || chr(10) || chr(10) || 'Solution:' || chr(10) || s ELSE '' END AS txt FROM y"""


def _sql_quota() -> str:
    ctes, seen = [], []
    for i, (group, target) in enumerate(catalog.group_targets(QUOTA).items()):
        fresh = f"SELECT *, row_number() OVER (PARTITION BY input_ids[1:64] ORDER BY doc_id, win) AS rn FROM w WHERE source = '{group}'"
        unseen = "".join(f" AND input_ids[1:64] NOT IN (SELECT input_ids[1:64] FROM q{j})" for j in seen)
        ctes.append(f"q{i} AS (SELECT * EXCLUDE (rn) FROM ({fresh}) WHERE rn = 1{unseen} ORDER BY doc_id, win LIMIT {target})")
        seen.append(i)
    union = " UNION ALL ".join(f"SELECT source, doc_id, win AS \"window\", {_ids('input_ids')} AS digest FROM q{i}" for i in seen)
    return f"WITH {_WIN}, {', '.join(ctes)} {union}"


def _sql_build() -> str:
    """Sources in catalogue order, each step reading the ones before it."""
    stream = f"coalesce(TRY_CAST(regexp_extract(source, '(\\d+)', 1) AS INT) % {len(STREAMS)}, {len(STREAMS) - 1})"
    strip = lambda x: f"regexp_replace({x}, {_STRIP}, '', 'g')"

    def solved(first: str, second: str, head: str = "''") -> str:
        told = strip(f"coalesce(nullif({first}, ''), nullif({second}, ''), '')")
        body = f"{head} || 'Problem: ' || {strip('problem')} || chr(10) || chr(10) || 'Solution:' || chr(10) || {told}"
        return f"CASE WHEN {strip('problem')} <> '' AND {told} <> '' THEN {body} ELSE '' END"

    made = {
        "text": strip("t"),
        "conversations": strip("t"),
        "magicoder": solved("solution", "''", "CASE WHEN coalesce(lang, '') <> '' THEN '# ' || lang || chr(10) ELSE '' END"),
        "problem_solution": solved("solution", "generated"),
        "math_instruct": solved("generated", "solution"),
    }
    groups, steps = catalog.group_targets(QUOTA), []
    before: dict[str, list[int]] = {g: [] for g in groups}
    seen: list[int] = []
    for i, x in enumerate(catalog.SOURCES):
        left = f"{groups[x.group]}" + "".join(f" - (SELECT count(*) FROM q{j})" for j in before[x.group])
        cap = max(1, int(x.cap * QUOTA / catalog.BASE))
        target = f"least({cap}, {left})" if x.cap else left
        unseen = "".join(f" AND input_ids[1:64] NOT IN (SELECT input_ids[1:64] FROM q{j})" for j in seen)
        steps.append(f"""
g{i} AS (SELECT greatest(0, {target}) AS n),
r{i} AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pl FROM y WHERE stream = {STREAMS.index(x.read_from)}),
t{i} AS (SELECT doc_id, {made[x.fmt]} AS txt FROM r{i} WHERE pl >= {catalog.source_skip(x, QUOTA)}),
l{i} AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS pl FROM t{i} WHERE length(txt) >= {T.MIN_CHARS}),
e{i} AS (
  SELECT doc_id, list_transform(regexp_extract_all(txt[1:{T.MAX_CHARS}], '(?s).'), lambda c: coalesce(m[c], {tokens.UNK})::INT) AS ids
  FROM l{i}, m WHERE pl <= {catalog.text_bound(x, 1)} * (SELECT n FROM g{i})),
p{i} AS (SELECT doc_id, w AS win, ids[w * {_BODY} + 1 : (w + 1) * {_BODY}] AS c FROM e{i}, unnest(range(0, (len(ids) + {_BODY} - 1) // {_BODY})) AS u(w)),
w{i} AS (SELECT doc_id, win::INT AS win, [2] || c || list_transform(range({LENGTH} - 1 - len(c)), lambda x: 0) AS input_ids FROM p{i} WHERE len(c) + 1 >= 16),
d{i} AS (SELECT *, row_number() OVER (PARTITION BY input_ids[1:64] ORDER BY doc_id, win) AS rn FROM w{i}),
f{i} AS (SELECT *, row_number() OVER (ORDER BY doc_id, win) AS pl FROM d{i} WHERE rn = 1{unseen}),
q{i} AS (SELECT '{x.name}' AS name, '{x.group}' AS source, doc_id, win, input_ids, pl - 1 AS k FROM f{i} WHERE pl <= (SELECT n FROM g{i}))""")
        before[x.group].append(i)
        seen.append(i)
    union = " UNION ALL ".join(f"SELECT * FROM q{i}" for i in seen)
    return f"""
WITH {_CHARS},
x AS (SELECT doc_id, lang, {stream} AS stream, coalesce(text, '') AS t, strpos(coalesce(text, ''), chr(10)) AS i FROM documents),
z AS (SELECT *, CASE WHEN i > 0 THEN t[1:i-1] ELSE t END AS problem, CASE WHEN i > 0 THEN t[i+1:] ELSE '' END AS solution FROM x),
y AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'Generated: ' || solution END AS generated FROM z),
{",".join(steps)},
al AS ({union}),
sl AS (SELECT name, md5('{SEED}:' || name || ':' || k) AS slot FROM al),
rk AS (SELECT name, slot, row_number() OVER (PARTITION BY name ORDER BY slot) - 1 AS k FROM sl)
SELECT name, source, doc_id, win AS "window", k::BIGINT AS k, slot, {_ids("input_ids")} AS digest,
  round(len(list_distinct(list_filter(input_ids, lambda x: x <> 0)))::DOUBLE / len(input_ids), 9) AS difficulty
FROM al JOIN rk USING (name, k)"""


_PRE = f"unnest(regexp_extract_all(txt, {_q(T.PRETOKEN)}))"
_FREQ = f"{_BASE}, wf AS (SELECT word, count(*)::BIGINT AS freq FROM (SELECT {_PRE} AS word FROM b) GROUP BY word)"
_PAIRS = f"""{_FREQ}, c AS (SELECT regexp_extract_all(word, '(?s).') AS s, freq FROM wf),
pc AS (SELECT s[i] AS a, s[i + 1] AS b, sum(freq)::BIGINT AS cnt FROM c, unnest(range(1, len(s))) AS u(i) GROUP BY ALL)"""
_OPEN, _CLOSE = "chr(2)", "chr(3)"


def _marked(word: str) -> str:
    """SQL of a word with each character between marks."""
    return f"regexp_replace({word}, '((?s).)', {_OPEN} || '\\1' || {_CLOSE}, 'g')"


def _merged(i: int) -> str:
    """SQL of marked symbols w after merge i, left to right."""
    return f"coalesce(replace(w, {_OPEN} || a || {_CLOSE} || {_OPEN} || b || {_CLOSE}, {_OPEN} || a || b || {_CLOSE}), w)"


def _sql_merge_steps() -> str:
    """Words as marked symbols; each step counts pairs, takes the best and replaces it."""
    a, b = _OPEN, _CLOSE
    steps = [f"""
w0 AS MATERIALIZED (SELECT {_marked("word")} AS w, count(*) AS n
  FROM (SELECT unnest(regexp_extract_all(txt[1:{T.TOKENIZER_CHARS}], {_q(T.PRETOKEN)})) AS word FROM k WHERE k <= CASE grp {_QUOTAS} END) GROUP BY word)"""]
    for i in range(FOLLOWED):
        steps.append(f"""
s{i} AS (SELECT regexp_extract_all(w, {a} || '([^' || {b} || ']*)' || {b}, 1) AS s, n FROM w{i}),
m{i} AS MATERIALIZED (SELECT s[j] AS a, s[j + 1] AS b, sum(n) AS c FROM s{i}, unnest(range(1, len(s))) AS u(j) GROUP BY ALL HAVING sum(n) >= 2 ORDER BY c DESC, a DESC, b DESC LIMIT 1),
w{i + 1} AS MATERIALIZED (SELECT {_merged(i)} AS w, n FROM w{i} LEFT JOIN m{i} ON TRUE)""")
    return f"""{_BASE}, k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id) AS k FROM b WHERE length(txt) >= 50), {",".join(steps)}"""


def _sql_merges() -> str:
    return " UNION ALL ".join(f"SELECT {i}::INT AS rank, a, b FROM m{i}" for i in range(FOLLOWED))


def _sql_first_merges() -> str:
    return f"WITH {_sql_merge_steps()}\n{_sql_merges()}"


def _sql_encode_first() -> str:
    """Ids by alphabet and merges of the sample; every word of every text goes through the same steps."""
    steps = [f"e0 AS MATERIALIZED (SELECT word, {_marked('word')} AS w FROM (SELECT DISTINCT unnest(regexp_extract_all(txt, {_q(T.PRETOKEN)})) AS word FROM b))"]
    steps += [f"e{i + 1} AS MATERIALIZED (SELECT word, {_merged(i)} AS w FROM e{i} LEFT JOIN m{i} ON TRUE)" for i in range(FOLLOWED)]
    return f"""WITH {_sql_merge_steps()}, {", ".join(steps)},
al AS (SELECT ch, row_number() OVER (ORDER BY unicode(ch)) + 3 AS id FROM (SELECT DISTINCT unnest(regexp_extract_all(w, {_OPEN} || '((?s).)' || {_CLOSE}, 1)) AS ch FROM w0)),
vc AS (SELECT name, max(id) AS id FROM (SELECT ch AS name, id FROM al UNION ALL
  SELECT a || b, 4 + (SELECT count(*) FROM al) + rank FROM ({_sql_merges()})) GROUP BY name),
sy AS (SELECT word, unnest(s) AS name, unnest(range(len(s))) AS j FROM (SELECT word, regexp_extract_all(w, {_OPEN} || '([^' || {_CLOSE} || ']*)' || {_CLOSE}, 1) AS s FROM e{FOLLOWED})),
wi AS (SELECT word, list(coalesce(id, 1)::INT ORDER BY j) AS ids FROM sy LEFT JOIN vc USING (name) GROUP BY word),
oc AS (SELECT doc_id, unnest(p) AS word, unnest(range(len(p))) AS pos FROM (SELECT doc_id, regexp_extract_all(txt, {_q(T.PRETOKEN)}) AS p FROM b)),
tx AS (SELECT doc_id, flatten(list(ids ORDER BY pos)) AS ids FROM oc JOIN wi USING (word) GROUP BY doc_id)
SELECT doc_id, coalesce(len(ids), 0)::INT AS n_tokens, {_ids('coalesce(ids, [])')} AS digest FROM b LEFT JOIN tx USING (doc_id)"""


_QUOTAS = " ".join(f"WHEN '{g}' THEN {int(catalog.tokenizer_texts(QUOTA) * s)}" for g, s in catalog.GROUPS.items())


def oracle_sql() -> dict[str, str]:
    real = "len(list_filter(input_ids, lambda x: x <> 0))::BIGINT"
    groups = ", ".join(f"({i}, '{g}')" for i, g in enumerate([*GROUPS, "other"]))
    listed = ", ".join(f"({i}, '{x.name}', '{x.group}', {x.trust}::DOUBLE)" for i, x in enumerate(catalog.SOURCES))
    sources = ", ".join(f"({i}, '{x.name}', '{x.read_from}')" for i, x in enumerate(catalog.SOURCES))
    return {
        "source_texts": f"WITH {_BASE} SELECT doc_id, grp, length(txt)::INT AS n, md5(txt) AS digest FROM b WHERE length(txt) >= 50",
        "extract_text": f"WITH {_BASE} SELECT doc_id, txt FROM b",
        "extract_magicoder": _solved(("solution", "''"), "CASE WHEN coalesce(lang, '') <> '' THEN '# ' || lang || chr(10) ELSE '' END"),
        "extract_problem_solution": _solved(("solution", "generated")),
        "extract_math_instruct": _solved(("generated", "solution")),
        "extract_conversations": f"""
WITH t AS (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), {_STRIP}, '', 'g') AS t FROM conversations)
SELECT conv_id, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY turn, role) FILTER (t <> ''), '') AS txt FROM t GROUP BY conv_id""",
        "score_filter": f"""WITH {_BASE} SELECT doc_id, quality::DOUBLE AS quality FROM b LEFT JOIN labels USING (doc_id)
WHERE coalesce(quality, 0) >= 1 AND length(txt) >= 50""",
        "vocab_range": f"""WITH {_WIN} SELECT doc_id, win AS "window",
  len(list_filter(input_ids, lambda x: x >= {VOCAB})) = 0 AND len(list_filter(labels, lambda x: x >= {VOCAB})) = 0 AS ok FROM w""",
        "validate_records": f"WITH {_FLAW} SELECT problem, count(*)::BIGINT AS n FROM g GROUP BY problem",
        "valid_subset": f"""WITH {_FLAW} SELECT doc_id, win AS "window", {_ids("input_ids")} AS digest FROM g WHERE problem IS NULL
ORDER BY doc_id, win LIMIT {SUBSET}""",
        "source_stats": f"""WITH {_WIN} SELECT source, count(*)::BIGINT AS n_records, sum({real})::BIGINT AS n_tokens,
  round(avg({real}), 6) AS mean_tokens FROM w GROUP BY source""",
        "build_totals": f"""WITH {_WIN} SELECT count(*)::BIGINT AS n_records, coalesce(sum({real}), 0)::BIGINT AS n_tokens,
  round(avg({real}), 6) AS mean_tokens FROM w""",
        "group_mix": f"""WITH {_WIN}, c AS (SELECT source, count(*)::BIGINT AS n FROM w GROUP BY source),
r AS (SELECT ord, source, coalesce(n, 0)::BIGINT AS n FROM (VALUES {groups}) AS f(ord, source) LEFT JOIN c USING (source))
SELECT ord::INT AS ord, source, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS pct FROM r""",
        "word_freq": f"WITH {_FREQ} SELECT word, freq FROM wf",
        "char_vocab": f"WITH {_ENC} SELECT ch, id::INT AS id FROM v",
        "bpe_pair_counts": f"WITH {_PAIRS} SELECT a, b, cnt FROM pc",
        "bpe_best_pair": f"WITH {_PAIRS} SELECT a, b, cnt FROM pc WHERE cnt >= 2 ORDER BY cnt DESC, a DESC, b DESC LIMIT 1",
        "bpe_first_merges": _sql_first_merges(),
        "encode_bpe_first": _sql_encode_first(),
        "encode_char": f"""WITH {_CHARS}, a AS (
  SELECT doc_id, list_transform(regexp_extract_all(txt, '(?s).'), lambda c: m[c]::INT) AS ids FROM b, m)
SELECT doc_id, (len(ids) + 2)::INT AS n_tokens, {_ids('[2] || ids || [3]')} AS digest FROM a""",
        "decode_roundtrip": f"WITH {_BASE} SELECT doc_id, md5(txt) AS digest FROM b",
        "pretokenize": f"""WITH {_BASE}, t AS (SELECT doc_id, regexp_extract_all(txt, {_q(T.PRETOKEN)}) AS p FROM b)
SELECT doc_id, len(p)::INT AS n, md5(array_to_string(p, '|')) AS digest FROM t""",
        "tokenizer_sample": f"""WITH {_BASE}, k AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id) AS k FROM b WHERE length(txt) >= 50)
SELECT doc_id, grp, md5(txt[1:{T.TOKENIZER_CHARS}]) AS digest FROM k WHERE k <= CASE grp {_QUOTAS} END""",
        "length_stats": f"""WITH {_WIN}, s AS (SELECT source, trust_score, {real} AS n FROM w)
SELECT source, count(*)::BIGINT AS rows, round(avg(n), 6) AS mean_n, round(stddev_samp(n), 6) AS std_n, min(n) AS min_n,
  max(n) AS max_n, round(avg(trust_score), 6) AS mean_trust FROM s GROUP BY source""",
        "missing_tags": f"""WITH {_BASE}, h AS (SELECT grp FROM b ORDER BY doc_id LIMIT 1000)
SELECT coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM (VALUES {", ".join(f"('{g}')" for g in [*GROUPS, "other"])}) AS x(t)
  WHERE t NOT IN (SELECT grp FROM h)), '') AS missing""",
        "dedup_prefix": f'WITH {_UNIQ} SELECT doc_id, win AS "window", {_ids("input_ids")} AS digest FROM uq',
        "quota_mix": _sql_quota(),
        "skip_take": f"""WITH {_BASE}, k AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS k FROM b)
SELECT doc_id, grp FROM k WHERE k > 100 AND length(txt) >= 50 ORDER BY doc_id LIMIT {SUBSET}""",
        "interleave": f"""WITH {_BASE}, r AS (SELECT grp AS source, doc_id, row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS k FROM b),
s AS (SELECT source, md5('{SEED}:' || source || ':' || k) AS slot FROM r),
t AS (SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS k FROM s)
SELECT source, k::BIGINT AS k, doc_id, slot FROM r JOIN t USING (source, k)""",
        "difficulty_sort": f"""WITH {_UNIQ} SELECT doc_id, win AS "window", source,
  round(len(list_distinct(list_filter(input_ids, lambda x: x <> 0)))::DOUBLE / len(input_ids), 9) AS difficulty FROM uq""",
        "build": _sql_build(),
        "round_trip": f"""WITH {_BASE}, o AS (SELECT doc_id, length(regexp_extract(txt, '^[\\x00-\\x7F]*')) AS n, length(txt) AS l FROM b)
SELECT doc_id, CASE WHEN n < l THEN n::INT END AS differs FROM o""",
        "sample_mix": f"""WITH {_BASE}, s AS (SELECT grp AS source FROM b ORDER BY md5('{SEED}:' || doc_id), doc_id LIMIT {SAMPLE})
SELECT source, count(*)::BIGINT AS n FROM s GROUP BY source""",
        "catalogue_lookup": f"""WITH c(i, name, "group", trust) AS (VALUES {listed}),
d AS (SELECT doc_id % {len(catalog.SOURCES) + 1} AS i FROM documents)
SELECT coalesce(name, 'elsewhere') AS name, "group", trust, count(*)::BIGINT AS n FROM d LEFT JOIN c USING (i) GROUP BY ALL""",
        "catalogue_streams": f"""WITH c(ord, name, stream) AS (VALUES {sources}),
d AS (SELECT doc_id % {len(catalog.SOURCES) + 1} AS ord, count(*) AS n FROM documents GROUP BY 1)
SELECT min(ord)::INT AS ord, arg_min(name, ord) AS name, stream, sum(n)::BIGINT AS n FROM c JOIN d USING (ord) GROUP BY stream""",
        "reservoir_sample": f"""WITH {_BASE} SELECT doc_id, grp FROM b ORDER BY md5('{SEED}:' || doc_id), doc_id LIMIT {SAMPLE}""",
        "token_windows": f'WITH {_WIN} SELECT doc_id, win AS "window", {_ids("input_ids")} AS ids, {_ids("labels")} AS labels FROM w',
        "repack": f"""WITH {_WIN}, z AS (SELECT trust_score AS trust, input_ids AS c, (row_number() OVER (ORDER BY doc_id, win) - 1) * {LENGTH} AS s FROM w),
tk AS (SELECT trust, c[j] AS t, (s + j - 1)::BIGINT AS pos FROM z, unnest(range(1, {LENGTH + 1})) AS u(j)),
l AS (SELECT pos // {LENGTH + 1} AS win, list(t ORDER BY pos) AS t, arg_min(trust, pos) AS trust FROM tk GROUP BY 1 HAVING count(*) = {LENGTH + 1})
SELECT (win // {BATCH})::BIGINT AS batch_id, (win % {BATCH})::BIGINT AS slot, {_ids(f"t[1:{LENGTH}]")} AS ids,
  {_ids(f"list_transform(t[2:{LENGTH + 1}], lambda x: CASE WHEN x = 0 THEN -100 ELSE x END)")} AS labels, trust FROM l""",
        "endless_batches": f"""WITH {_WIN}, z AS (SELECT trust_score AS trust, input_ids AS c, row_number() OVER (ORDER BY doc_id, win) - 1 AS k, count(*) OVER () AS n FROM w),
tk AS (SELECT n, trust, c[j] AS t, ((ep * n + k) * {LENGTH} + j - 1)::BIGINT AS pos FROM z, unnest(range(0, {EPOCHS})) AS v(ep), unnest(range(1, {LENGTH + 1})) AS u(j)),
l AS (SELECT pos // {LENGTH + 1} AS win, max(n) AS n, list(t ORDER BY pos) AS t, arg_min(trust, pos) AS trust FROM tk GROUP BY 1)
SELECT (win // {BATCH})::BIGINT AS batch_id, (win % {BATCH})::BIGINT AS slot, {_ids(f"t[1:{LENGTH}]")} AS ids,
  {_ids(f"list_transform(t[2:{LENGTH + 1}], lambda x: CASE WHEN x = 0 THEN -100 ELSE x END)")} AS labels, trust
FROM l WHERE win < {EPOCHS} * n * {LENGTH} // {BATCH * (LENGTH + 1)} * {BATCH}""",
        "jsonl_scan": """SELECT doc_id, len(w)::INT AS n, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS total,
  CASE WHEN doc_id % 6 = 0 THEN 1.0 ELSE 95.5 END::DOUBLE AS trust_score, CASE WHEN doc_id % 6 = 0 THEN 'code' ELSE 'math' END AS source
FROM (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS w FROM documents) WHERE doc_id % 6 IN (0, 4, 5)""",
    }
