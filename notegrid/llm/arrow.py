"""Arrow helpers of the operators that run Python on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Texts handled at once: bounds a worker's memory whatever the batch size.
BLOCK_BYTES = 4 << 20


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a block holds about BLOCK_BYTES of text or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > BLOCK_BYTES:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def added(docs: DataFrame, text: str, schema: str, make: Callable[[list], list[pa.Array]], read=strings) -> DataFrame:
    """``docs`` with columns of ``schema`` (a DDL string) that ``make`` derives
    from a block's texts; it returns one array for each."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)
    out = StructType([*docs.schema.fields, *fields.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            arrays = make(read(block.column(block.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays([*block.columns, *arrays], names=[*block.schema.names, *fields.names])

    return docs.mapInArrow(run, out)
