"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Text bytes that one Arrow slice hands to a Python function, so that a batch
#: of very long documents never stands in memory as Python objects at once.
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that ``column`` holds at most ``limit`` bytes (or one row)."""
    start, size = 0, 0
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    for i, n in enumerate(sizes):
        if i > start and size + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < len(sizes):
        yield batch.slice(start)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_text(
    df: DataFrame,
    column: str,
    outputs: str,
    setup: Callable[[], Callable[[list], list]],
) -> DataFrame:
    """Append columns computed from one text column, slice by slice.

    ``setup`` runs once a task and gives a function from a list of texts to one
    list or Arrow array per output. An output takes the place of an input column of its name.
    """
    new = T.StructType.fromDDL(outputs)
    taken = {n.lower() for n in new.names}
    keep = [f for f in df.schema.fields if f.name.lower() not in taken]
    schema = T.StructType([*keep, *new.fields])

    def run(batches):
        call, types, names = setup(), arrow_types(new), schema.names
        for batch in batches:
            for part in slices(batch, column):
                found = call(part.column(column).to_pylist())
                made = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(found, types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in keep] + made, names)

    return df.mapInArrow(tidy(run), schema)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` with its memory handed back at the task's end: Python workers live on between tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            released()

    return wrapped


def released() -> None:
    """Give freed memory back to the system."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def arrow_types(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]
