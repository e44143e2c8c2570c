"""Named parameters as tables, one folder for each step."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.storage import Files

#: Fixed value: the folder of a step.
FOLDER = "step_%08d"
_STEP = re.compile(r"step_(\d+)$")


def step_of(path: str) -> int | None:
    """The step that a folder is named after."""
    m = _STEP.search(path.rstrip("/"))
    return int(m[1]) if m else None


#: Written last: a step that has it is complete.
MANIFEST = "_manifest.json"


def told(df: DataFrame) -> dict:
    """Rows and a digest of a table, whatever the order of its rows."""
    h = F.xxhash64(*sorted(df.columns))
    row = df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(F.shiftrightunsigned(h, 24)), F.lit(0)).alias("s")).first()
    return {"rows": row["rows"], "digest": f"{row['x'] & (1 << 64) - 1:016x}{row['s'] & (1 << 64) - 1:016x}"}


def save(state: dict[str, DataFrame], root: str, step: int) -> str:
    """Write each table (name, value, ...) of a step, then its manifest; the folder of the step.

    The manifest names tables, rows and digests as they were read back, and is renamed
    into place last: a save that is cut short leaves a step that no reader takes. Saving
    a step again first takes its manifest away.
    """
    name = FOLDER % step
    path = f"{root.rstrip('/')}/{name}"
    if not state:
        raise ValueError("nothing to save")
    spark = next(iter(state.values())).sparkSession
    files = Files(spark, root)
    files.delete(f"{name}/{MANIFEST}")
    tables = {}
    for part, df in state.items():
        df.write.mode("overwrite").parquet(f"{path}/{part}")
        tables[part] = told(spark.read.schema(df.schema).parquet(f"{path}/{part}"))
    files.write(f"{name}/{MANIFEST}", json.dumps({"step": step, "tables": tables}))
    return path


def steps(spark: SparkSession, root: str) -> list[int]:
    """The complete steps below ``root``, in order; none if it does not exist."""
    files = Files(spark, root)
    found = ((step_of(n), n) for n in files.names())
    return sorted(s for s, n in found if s is not None and MANIFEST in files.names(n))


def latest(spark: SparkSession, root: str) -> str | None:
    """The folder of the newest complete step."""
    found = steps(spark, root)
    return f"{root.rstrip('/')}/{FOLDER % found[-1]}" if found else None


def load(spark: SparkSession, path: str, current: dict[str, DataFrame], verify: bool = False) -> tuple[dict[str, DataFrame], int | None]:
    """Each table of ``current`` with what the step's folder has of it, and the step; tables that it never had stay as they are.

    A folder without a manifest is an error, and so is a table of the manifest that is
    gone; with ``verify`` also one whose rows or digest differ.
    """
    files = Files(spark, path)
    manifest = files.read(MANIFEST)
    if manifest is None:
        raise FileNotFoundError(f"no complete checkpoint at {path}")
    tables = json.loads(manifest)["tables"]
    there = set(files.names())
    if gone := sorted(set(tables) - there):
        raise FileNotFoundError(f"{path} has lost {', '.join(gone)}")
    out = {}
    for part, df in current.items():
        if part not in tables:
            out[part] = df
            continue
        stored = spark.read.parquet(f"{path}/{part}")
        if verify and told(stored) != tables[part]:
            raise ValueError(f"{path}/{part} is not what was saved")
        out[part] = loaded(df, stored)
    return out, step_of(path)


def loaded(current: DataFrame, stored: DataFrame) -> DataFrame:
    """name, value: stored values where there are any, else the current ones; names that are only stored are left out."""
    there = stored.select(F.col("name").alias("_name"), F.col("value").alias("_value"))
    return current.join(there, F.col("name") == F.col("_name"), "left").select("name", F.coalesce("_value", "value").alias("value"))


def shadow_merge(shadow: DataFrame, main: DataFrame, decay: float) -> DataFrame:
    """block, name, value of ``shadow``: decay * own + (1 - decay) * main's where both have a value of equal size, else as it is."""

    def merged(old: Column, new: Column) -> Column:
        return F.zip_with(old, new, lambda s, m: decay * s + (1 - decay) * m)

    other = main.select(F.col("block").alias("_block"), F.col("name").alias("_name"), F.col("value").alias("_value"))
    same = (F.col("block") == F.col("_block")) & (F.col("name") == F.col("_name")) & (F.size("value") == F.size("_value"))
    value = F.when(F.col("_value").isNotNull(), merged(F.col("value"), F.col("_value"))).otherwise(F.col("value"))
    return shadow.join(other, same, "left").select("block", "name", value.alias("value"))
