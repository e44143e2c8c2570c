"""The corpus pipeline: toxicity, near duplicates, secrets, source mixture, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept;
its result is written as Parquet and read again. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, mixing, near_dedup, secrets, toxicity
from quern.llm.queries import MIX_SEED, tokenizer_path
from quern.storage import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labels, scores below the threshold.

    Null, empty and wordless texts score 0 and stay; so do repeated rows and rows
    without an id, each by its text. An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity(docs.select(COLUMNS), labels).where("predicted = 0").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component at five words and similarity 0.8, also where rows repeat ids or texts.

    The row that stays has the component's least doc_id. Rows without words or without
    a doc_id are in no component and all stay. An empty table stays empty.
    """
    docs = docs.select(COLUMNS)
    judged = near_dedup.near_duplicates(docs, words=5, percent=80).where("first")
    keys = judged.groupBy("group", "text_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    keepers = keys.groupBy("group").agg(F.min(F.struct("text_key", "doc_id", "n")).alias("k"))
    keepers = Scratch(spark, "keepers").save(keepers.select("k.*"), "keepers")
    linkable = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    same = (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_key"))
    named = keepers.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "n")
    kept = docs.where(linkable).join(named.drop("n").hint("shuffle_hash"), same, "left_semi")
    repeated = named.where("n > 1")
    if not repeated.isEmpty():
        again = docs.where(linkable).join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(repeated, same, "left_anti").unionByName(again)
    return kept.unionByName(docs.where(~linkable))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts become ``[SECRET:kind]``; n_chars follows where a text changes.

    Null and empty texts, repeated rows and rows without an id stay as they are; very
    long texts are searched whole. An empty table stays empty.
    """
    found = secrets.scan(docs.select(COLUMNS))
    done = found.withColumn("text", secrets.redact(F.col("text"), F.col("spans")))
    length = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", length).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source weighs the same; documents repeat by their Poisson draw, in random order.

    Null sources are a source; repeated rows and rows without an id draw one by one;
    null, empty and very long texts count like others. An empty table stays empty.
    """
    return mixing.mix(docs.select(COLUMNS), seed=MIX_SEED).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining row (little-endian uint32), with their digests, in the order of ``docs``.

    Rows keep their places, so copies of a text stay apart as the mixture has dealt
    them. Null texts have no tokens; repeated rows repeat their ids; an empty table
    gives an empty result.
    """
    done = bpe.encode_documents(docs.select(COLUMNS), tokenizer_path(), keep_text=False, in_order=True)
    return done.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither the learned model nor MinHash components nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
