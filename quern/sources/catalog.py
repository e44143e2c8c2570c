"""Training sources, their groups and quotas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Source:
    name: str
    group: str
    trust: float
    fmt: str
    cap: int  # records at 10,000,000 in all; 0: what is left of the group
    skip: int  # leading records at 10,000,000 in all
    min_score: float = 0.0
    stream: str = ""  # where its records come from; its own name if empty

    @property
    def read_from(self) -> str:
        return self.stream or self.name


#: The catalogue in processing order.
SOURCES = (
    Source("magicoder", "code", 95, "magicoder", 75_000, 0),
    Source("openmath_math", "math", 96, "math_instruct", 500_000, 0, stream="openmath"),
    Source("finemath", "math", 93, "text", 0, 0),
    Source("openthoughts3", "reasoning", 98, "conversations", 1_200_000, 0),
    Source("openr1_math", "reasoning", 95, "problem_solution", 220_000, 0),
    Source("openmath_reason", "reasoning", 95, "math_instruct", 0, 500_000, stream="openmath"),
    Source("fineweb_edu", "educational", 88, "text", 0, 0),
)
#: Shares of the groups; the last takes what rounding leaves.
GROUPS = {"code": 0.25, "math": 0.25, "reasoning": 0.30, "educational": 0.20}
#: Trust of a group's first source.
GROUP_TRUST = {"code": 95.0, "math": 96.0, "reasoning": 98.0, "educational": 88.0}
#: The source of each group that the tokenizer is trained on.
TOKENIZER_SOURCES = {"code": "magicoder", "math": "finemath", "reasoning": "openthoughts3", "educational": "fineweb_edu"}
BASE = 10_000_000


def group_targets(n: int) -> dict[str, int]:
    found = {g: int(n * share) for g, share in GROUPS.items()}
    found["educational"] += n - sum(found.values())
    return found


def source_target(source: Source, n: int, left: int) -> int:
    """Records wanted of a source when ``left`` of its group are still to be written."""
    return min(max(1, int(source.cap * n / BASE)), left) if source.cap else left


def source_skip(source: Source, n: int) -> int:
    return int(source.skip * n / BASE)


def text_bound(source: Source, target: int) -> int:
    """Texts that are read at most to fill ``target`` windows."""
    return target * (6 if source.fmt == "text" else 3)


def tokenizer_texts(n_samples: int, n_texts: int = 500_000) -> int:
    return min(n_texts, max(5_000, 5 * n_samples)) if n_samples < 100_000 else n_texts


def frame(spark: SparkSession, sources: tuple[Source, ...] = SOURCES) -> DataFrame:
    rows = [(i, s.name, s.group, float(s.trust), s.fmt, s.cap, s.skip, s.min_score, s.read_from) for i, s in enumerate(sources)]
    return spark.createDataFrame(rows, "ord int, name string, group string, trust double, fmt string, cap long, skip long, min_score double, stream string")


def streams(catalogue: DataFrame) -> DataFrame:
    """ord, name, stream: the first source of each stream, for sources that share one are read from it alike."""
    first = catalogue.groupBy("stream").agg(F.min(F.struct("ord", "name")).alias("s"))
    return first.select("s.ord", "s.name", "stream")


def verify(readers: dict[str, DataFrame], sources: tuple[Source, ...] = SOURCES) -> dict[str, bool]:
    """Whether each source yields a row: one probe for each stream. A stream without a reader yields none."""
    found = {s: s in readers and not readers[s].isEmpty() for s in dict.fromkeys(x.read_from for x in sources)}
    return {x.name: found[x.read_from] for x in sources}


def with_catalogue(rows: DataFrame, sources: tuple[Source, ...] = SOURCES) -> DataFrame:
    """``rows`` (name, ...) plus ord, group and trust of the source; null for names that are not in the catalogue."""
    listed = frame(rows.sparkSession, sources).select(F.col("name").alias("_name"), "ord", "group", "trust")  # a row for each source
    return rows.join(F.broadcast(listed), F.col("name") == F.col("_name"), "left").drop("_name")
