"""Command lines: build a corpus, train or try a tokenizer, take a subset of records.

    python -m quern build --input raw --output out --tokenizer tok.json
    python -m quern tokenizer --train corpus.txt --output tok.json
    python -m quern subset --input records --output few --max-records 2048

``build`` reads one folder of JSON lines for each stream of the catalogue.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import builder, tokens, windows
from quern.sources import catalog, jsonl


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quern", description="Corpora for language models, on Spark.")
    sub = top.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="sources to training records")
    b.add_argument("--input", required=True, help="folder with a folder of JSON lines for each stream")
    b.add_argument("--output", default="data/train")
    b.add_argument("--tokenizer", default="tokenizer.json")
    b.add_argument("--n-samples", type=int, default=1_000_000)
    b.add_argument("--vocab-size", type=int, default=32_768)
    b.add_argument("--max-seq-len", type=int, default=512)
    b.add_argument("--seed", type=int, default=42)
    b.add_argument("--train-tokenizer", action="store_true")
    b.add_argument("--n-tokenizer-texts", type=int, default=500_000)
    b.add_argument("--sort-by-difficulty", action="store_true")
    b.add_argument("--verify-only", action="store_true")
    t = sub.add_parser("tokenizer", help="train, load and try a tokenizer")
    t.add_argument("--train", help="text file, a text in each line")
    t.add_argument("--output", default="tokenizer.json")
    t.add_argument("--vocab-size", type=int, default=16_000)
    t.add_argument("--load")
    t.add_argument("--test", help="a text to encode and decode")
    s = sub.add_parser("subset", help="a random sample of records")
    s.add_argument("--input", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--max-records", type=int, default=2_048)
    s.add_argument("--seed", type=int, default=42)
    return top


def readers(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Raw records of each stream that has a folder, in the order of its files and lines."""
    found = {}
    for stream in dict.fromkeys(s.read_from for s in catalog.SOURCES):
        path = f"{folder.rstrip('/')}/{stream}"
        if jsonl.exists(spark, path):
            at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("place"))
            found[stream] = spark.read.schema(jsonl.RAW).json(path).select("*", at.alias("ord"))
    return found


def train_tokenizer(sources: dict[str, DataFrame], path: str, vocab: int, n_texts: int) -> None:
    """Train on the first texts of each group's representative source, and write the tokenizer to ``path``."""
    texts = None
    for group, share in catalog.GROUPS.items():
        source = next(s for s in catalog.SOURCES if s.name == catalog.TOKENIZER_SOURCES[group])
        own = builder.source_texts(sources[source.read_from], source, int(n_texts * share)).select(F.substring("txt", 1, 4_096).alias("text"))
        texts = own if texts is None else texts.unionByName(own)
    jsonl.save_tokenizer(texts.sparkSession, path, *tokens.train_on(tokens.word_freq(texts), vocab))


def round_trip(text: str, vocab: dict[str, int], merges: list[tuple[str, str]]) -> tuple[list[int], str, int | None]:
    """Ids of a text, what they decode to, and the first character that differs (None: none does)."""
    ids = tokens.encode_text(text, vocab, merges)
    names = {i: t for t, i in vocab.items()}
    back = "".join(names.get(i, "") for i in ids if i >= tokens.FIRST_ID)
    if back == text:
        return ids, back, None
    return ids, back, next((i for i, (a, b) in enumerate(zip(text, back)) if a != b), min(len(text), len(back)))  # noqa: B905


def _build(spark: SparkSession, a: argparse.Namespace) -> int:
    sources = readers(spark, a.input)
    if a.verify_only:
        told = catalog.verify(sources)
        for name, ok in told.items():
            print(f"{name:<20} {'ok' if ok else 'no records'}")
        return 0 if all(told.values()) else 1
    if a.train_tokenizer:
        if jsonl.exists(spark, a.tokenizer):
            print(f"{a.tokenizer} exists already: not trained again")
        else:
            train_tokenizer(sources, a.tokenizer, a.vocab_size, catalog.tokenizer_texts(a.n_samples, a.n_tokenizer_texts))
    if a.n_samples <= 0:
        print("no samples wanted: nothing built")
        return 0
    vocab, merges, size = jsonl.load_tokenizer(spark, a.tokenizer)
    if size != a.vocab_size:
        raise ValueError(f"the tokenizer has {size} ids, not {a.vocab_size}")

    def encoded(texts: DataFrame) -> DataFrame:
        return tokens.encode_words(texts, vocab, merges)

    built = builder.build_to(a.output, sources, encoded, a.n_samples, size, a.max_seq_len, a.seed, a.sort_by_difficulty)
    if built is None:
        print(f"{a.output} has {a.n_samples} records already: not built again")
        return 0
    catalog.with_catalogue(built.stats).orderBy("ord").select("name", "n_records", "n_tokens", "trust").show(truncate=False)
    built.totals().show()
    built.by_group().orderBy("ord").show()
    missing = builder.missing_tags(built.records, ["slot"]).first()["missing"]
    if missing:
        print(f"no records of {missing} among the first 1,000", file=sys.stderr)
    return 0


def _tokenizer(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.train:
        if not jsonl.exists(spark, a.train):
            print(f"no such file: {a.train}", file=sys.stderr)
            return 1
        told = tokens.train_on(tokens.word_freq(jsonl.read_lines(spark, a.train)), a.vocab_size)
        jsonl.save_tokenizer(spark, a.output, *told)
    elif a.load:
        told = jsonl.load_tokenizer(spark, a.load)
    else:
        parser().print_help()
        return 0
    if a.test:
        ids, back, differs = round_trip(a.test, told[0], told[1])
        print(f"{len(ids)} ids: {ids[:32]}\ndecoded: {back!r}\nround trip: {'ok' if differs is None else f'differs from character {differs}'}")
    return 0


def _subset(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.max_records <= 0:
        raise ValueError("--max-records must be above 0")
    if not jsonl.exists(spark, a.input):
        raise FileNotFoundError(a.input)
    jsonl.check(spark, a.input)
    records = jsonl.read(spark, a.input)
    line = F.to_json(F.struct("input_ids", "labels", "trust_score", "source"))
    sample = windows.reservoir_sample(records.withColumn("_line", line), a.max_records, a.seed, "_line").drop("_line")
    jsonl.write(sample, a.output)
    for row in builder.source_mix(jsonl.read(spark, a.output)).collect():  # a row for each source of the sample
        print(f"{row['source']:<16} {row['n']:>6}")
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quern").getOrCreate()
    return {"build": _build, "tokenizer": _tokenizer, "subset": _subset}[a.command](spark, a)
