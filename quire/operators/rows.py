"""Functions of a text applied to rows, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Bytes of text that a task makes Python's strings of at once; a longer text is alone.
MOST_BYTES = 1 << 20


def sliced(batches: Iterator[pa.RecordBatch], columns: Sequence[str], most: int = MOST_BYTES) -> Iterator[pa.RecordBatch]:
    """``batches`` cut, without copies, into parts of ``most`` bytes in ``columns`` at most, so that what a task holds does not grow with a batch."""
    for batch in batches:
        sizes = sum((pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(c))), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns), np.zeros(batch.num_rows, np.int64))
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def rewritten(docs: DataFrame, f: Callable[..., tuple], counters: Sequence[str], inputs: Sequence[str] = ("text",), into: str = "text") -> DataFrame:
    """``docs`` with ``into`` made by ``f`` from the columns ``inputs``, and its counts in the columns ``counters``.

    ``f`` gives (text, count) or (text, counts by name); a null input is an empty text.  All other columns pass through.
    """
    kept = [c for c in docs.schema.fields if c.name not in (into, *counters)]
    schema = StructType([*kept, StructField(into, StringType()), *[StructField(c, LongType()) for c in counters]])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, inputs):
            names = batch.schema.names
            done = [f(*[x or "" for x in row]) for row in zip(*[batch.column(names.index(c)).to_pylist() for c in inputs], strict=True)]
            counts = [[(d[1][c] if isinstance(d[1], dict) else d[1]) for d in done] for c in counters]
            cols = [batch.column(names.index(c.name)) for c in kept]
            yield pa.record_batch([*cols, pa.array([d[0] for d in done], pa.string()), *[pa.array(c, pa.int64()) for c in counts]], names=[c.name for c in schema.fields])

    return docs.mapInArrow(apply, schema)
