"""JSON-lines sources and sinks of training records, always with an explicit schema."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.windows import with_ordinal
from quern.storage import Files

RECORD = T.StructType(
    [
        T.StructField("input_ids", T.ArrayType(T.IntegerType())),
        T.StructField("labels", T.ArrayType(T.IntegerType())),
        T.StructField("trust_score", T.DoubleType()),
        T.StructField("source", T.StringType()),
    ]
)
RAW = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("text", "content", "problem", "question", "solution", "generated_solution", "lang")),
        T.StructField("score", T.DoubleType()),
        T.StructField("conversations", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("from", "value", "role", "content")]))),
    ]
)
DEFAULT_TRUST = 1.0


def parse_records(lines: DataFrame, line: str = "value") -> DataFrame:
    """Columns of ``lines`` plus the record's fields and ``problem``, null for a sound record.

    A missing trust score is 1.0; an explicit null, or anything but a number, makes
    the record bad, as do broken JSON, empty ids, and a source that is no string.
    """
    text = F.col(line)
    parsed = F.from_json(text, RECORD, {"mode": "PERMISSIVE"})
    trust = F.get_json_object(text, "$.trust_score")
    has_trust = text.rlike(r'"trust_score"\s*:')
    quoted = text.rlike(r'"trust_score"\s*:\s*"')
    told = text.rlike(r'"source"\s*:\s*[^"\s]')
    df = lines.withColumn("_r", parsed)
    score = F.when(~has_trust, F.lit(DEFAULT_TRUST)).otherwise(F.col("_r.trust_score"))
    problem = (
        F.when(F.trim(text) == "", "blank")
        .when(~text.rlike(r"(?s)^\s*\{.*\}\s*$") | F.try_parse_json(text).isNull(), "broken")
        .when(F.col("_r.input_ids").isNull() | (F.size("_r.input_ids") == 0), "no ids")
        .when(F.exists("_r.input_ids", lambda x: x.isNull()), "ids")
        .when(has_trust & (trust.isNull() | quoted | F.col("_r.trust_score").isNull()), "trust")
        .when(told, "source")
    )
    return df.select(*lines.columns, "_r.input_ids", "_r.labels", score.alias("trust_score"), "_r.source", problem.alias("problem"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Sound records; the rest is skipped."""
    return parse_records(spark.read.text(path)).where("problem is null").drop("value", "problem")


def read_strict(spark: SparkSession, path: str) -> DataFrame:
    """Records; any unsound line but a blank one fails the job that meets it."""
    rows = parse_records(spark.read.text(path)).where("coalesce(problem, '') <> 'blank'")
    check = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("invalid record: "), F.col("problem"))))
    return rows.withColumn("source", F.coalesce(check.cast("string"), F.col("source"))).drop("value", "problem")


def first_flaw(spark: SparkSession, path: str) -> tuple[str, int, str] | None:
    """File, line number from 1 and problem of the first unsound line but a blank one; None if all are sound.

    Lines are numbered within their files by the place of their split and their place
    in it, so no task reads more than its split. Records of another length than the
    first file's first record are unsound too.
    """
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")]
    rows = parse_records(spark.read.text(path).select("value", *at)).where("coalesce(problem, '') <> 'blank'")
    rows = rows.select("file", "block", "place", "problem", F.size("input_ids").alias("n"), F.size("labels").alias("n_labels"), "source", "labels")
    order = F.struct("file", "block", "place")
    told = rows.where("problem is null").agg(F.min_by("n", order).alias("n")).first()["n"]
    problem = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("labels").isNull() | F.col("source").isNull(), "missing")
        .when(F.col("n") != F.col("n_labels"), "lengths")
        .when(F.col("n") != told, "length")
    )
    worst = rows.withColumn("problem", problem).where("problem is not null").agg(F.min(F.struct("file", "block", "place", "problem")).alias("w")).first()["w"]
    if worst is None:
        return None
    lines = spark.read.text(path).select(*at).where(F.col("file") == worst["file"])
    before = lines.where((F.col("block") < worst["block"]) | ((F.col("block") == worst["block"]) & (F.col("place") < worst["place"]))).count()
    return worst["file"], before + 1, worst["problem"]


def check(spark: SparkSession, path: str) -> None:
    """An error that names the first unsound line, if there is one."""
    flaw = first_flaw(spark, path)
    if flaw:
        raise ValueError(f"invalid record at line {flaw[1]} of {flaw[0]}: {flaw[2]}")


def replay(records: DataFrame, order: str, epochs: int, seed: int | None = None) -> DataFrame:
    """``records`` read ``epochs`` times over, plus epoch and at, which order the stream.

    Each epoch goes through all records once. Without ``seed`` it begins at the first;
    with it, at a record that the seed and the epoch draw, and wraps around at the end.
    """
    numbered = with_ordinal(records, [], order, "_k")
    n = numbered.count()
    each = numbered.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    start = F.lit(0) if seed is None else F.pmod(F.xxhash64(F.lit(seed), F.col("epoch")), F.lit(max(n, 1)))
    return each.withColumn("at", F.col("epoch").cast("long") * n + F.pmod(F.col("_k") - start, F.lit(max(n, 1)))).drop("_k")


def write(df: DataFrame, path: str) -> None:
    df.select("input_ids", "labels", "trust_score", "source").write.mode("overwrite").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of text files for tokenizer training; all line ends of Unicode count."""
    lines = F.explode(F.split("value", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"))
    return spark.read.text(path).select(lines.alias("text")).where(F.trim("text") != "")


def enough(spark: SparkSession, path: str, rows: int) -> bool:
    """Whether a finished build has at least so many rows, so that it need not be repeated."""
    try:
        return spark.read.text(path).count() >= rows
    except Exception as e:  # the path does not exist yet
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise


def exists(spark: SparkSession, path: str) -> bool:
    """On any file system that Spark knows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


def bootstrap(spark: SparkSession, rows: int, length: int = 512, seed: int = 0) -> DataFrame:
    """Synthetic records of ids in [10, 32000]; labels are the ids that follow."""
    ids = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: (10 + F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(31_991))).cast("int"))
    df = spark.range(rows).select(ids.alias("input_ids"))
    labels = F.concat(F.slice("input_ids", 2, length), F.array(F.lit(-100)))
    return df.select("input_ids", labels.alias("labels"), F.lit(90.0).alias("trust_score"), F.lit("bootstrap").alias("source"))


def save_tokenizer(spark: SparkSession, path: str, vocab: dict[str, int], merges: list[tuple[str, str]], vocab_size: int) -> None:
    """On any file system that Spark knows; the file is there whole or not at all."""
    folder, _, name = path.rpartition("/")
    told = {"vocab": vocab, "merges": [list(m) for m in merges], "vocab_size": vocab_size}
    Files(spark, folder or ".").write(name, json.dumps(told))


def load_tokenizer(spark: SparkSession, path: str) -> tuple[dict[str, int], list[tuple[str, str]], int]:
    folder, _, name = path.rpartition("/")
    text = Files(spark, folder or ".").read(name)
    if text is None:
        raise FileNotFoundError(path)
    told = json.loads(text)
    return told["vocab"], [tuple(m) for m in told["merges"]], told["vocab_size"]
