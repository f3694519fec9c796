"""What the Arrow-batch operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

#: Rows an Arrow batch holds at most, so that a batch of long texts stays in the tens of MB.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to ``BATCH_ROWS`` where it is larger."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def columns(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns under the operator's own names, so that other columns never clash: ``columns(docs, doc_id=id_col)``."""
    return df.select(*[df[c].alias(k) for k, c in names.items()])


def named(df: DataFrame, c: str) -> Column:
    """The column of ``df`` called ``c``, whatever stands in its name."""
    return df["`" + c.replace("`", "``") + "`"]


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with underscores ahead until no column of ``df`` has it, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples."""
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def batch(schema: pa.Schema, data: list[tuple]) -> pa.RecordBatch:
    """Tuples as an Arrow batch."""
    cols = zip(*data, strict=True) if data else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
