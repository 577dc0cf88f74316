"""Shared helpers for operators that read whole texts.

Texts travel to Python in Arrow batches. Nothing here keeps state between
tasks, so a task that is run again after an executor is lost gives the same
rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: ASCII white space; bytes.split() with no argument splits on these alone.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch of whole texts: a task holds a few such batches, whatever the texts' lengths.
BATCH_BYTES = 2 << 20


def small_batches(docs: DataFrame) -> DataFrame:
    """The same rows; the session's Arrow batches are set to at most BATCH_BYTES."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf.get(name, "64m")).lower().rstrip("b")
    factor = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
    if not 0 < int(now.rstrip("kmg")) * factor <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return docs


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that text operators read, whatever else the table holds."""
    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def map_rows(docs: DataFrame, rows, schema: T.StructType, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Apply ``rows(pairs) -> list of tuples`` to each Arrow batch of (id, text).

    A null text reaches ``rows`` as the empty string.
    """
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = rows([(i, t or "") for i, t in zip(ids, texts, strict=True)])
            columns = list(zip(*out, strict=True)) if out else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)
