"""Python over rows in Arrow batches, with values as they are.

pandas turns a column of long numbers with nulls into floating point, which changes
ids beyond 2^53; lists of Python values do not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: One batch: the values of each column by its name.
Columns = dict[str, list]


def map_rows(df: DataFrame, run: Callable[[Iterator[Columns]], Iterator[list[tuple]]], schema: str) -> DataFrame:
    """``run`` gets the batches of a partition one after the other, and yields lists of rows of ``schema``."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = ({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns, strict=True)} for b in batches)
        for rows in run(read):
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(task, schema)
