"""Small helpers of this subpackage: Arrow slices, plain columns, block numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text handled at once inside a Python task; a single longer text makes a slice of its own.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``text`` fills about ``limit`` bytes in each, whole rows only."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(batch.schema.names.index(text))
        sizes = column.cast(pa.large_string()).cast(pa.large_binary()) if pa.types.is_string(column.type) else column
        ends = np.cumsum([0 if n is None else n for n in pc.binary_length(sizes).to_pylist()])
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def over_texts(
    docs: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text"
) -> DataFrame:
    """``work`` over bounded Arrow slices of ``docs``; no state crosses slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            yield work(part)

    return docs.mapInArrow(run, schema)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``docs`` has a column of that name in any case."""
    there = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in there:
            name += "_"
        out.append(name)
    return out


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_text(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names; other columns may be called anything."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
