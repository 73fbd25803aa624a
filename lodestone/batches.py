"""Python steps over Arrow batches whose memory does not grow with the batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch that are Python objects at a time.
ROWS = 64


def give_back() -> None:
    """Return freed memory to the machine: allocators keep what a batch took, for as long as a worker lives."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def map_slices(df: DataFrame, f: Callable[..., tuple[list, ...]], schema: StructType) -> DataFrame:
    """mapInArrow by a function from the columns' values of ROWS rows to those of the schema."""
    kinds = to_arrow_schema(schema)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    out = f(*(c.to_pylist() for c in batch.slice(at, ROWS).columns))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(out, kinds, strict=True)], schema=kinds)
                give_back()
        finally:
            give_back()

    return df.mapInArrow(over, schema)
