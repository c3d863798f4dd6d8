"""Many small groups at once: sorted rows stream through a task, which works on blocks of whole groups as arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

#: Cells of the arrays that are worked on at once.
CELLS = 1 << 18


def starts_of(table: pa.Table, keys: list[str], before: pa.Table | None = None) -> np.ndarray:
    """The rows of a table in the order of ``keys`` at which a group begins; the first does unless it goes on from the last row of ``before``."""
    n, both = table.num_rows, [table.select(keys)]
    if before is not None:
        both.insert(0, before.select(keys).slice(before.num_rows - 1))
    lead = len(both) - 1
    rows, new = pa.concat_tables(both), np.zeros(n - 1 + lead, bool)
    for key in keys:
        c = pa.chunked_array(rows.column(key)).combine_chunks()
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new |= other.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new if lead else np.concatenate([[True], new]))


def in_groups(rows: DataFrame, keys: list[str], order: list[Column | str], work: Callable[[pa.Table, np.ndarray], pa.Table], schema) -> DataFrame:
    """What ``work`` makes of ``rows``: it gets tables of whole groups in the order of ``keys`` and ``order``, and the row at which each group begins."""
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def done() -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(held).combine_chunks()
            yield from work(table, starts_of(table, keys)).to_batches()

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                new = starts_of(table, keys, held[-1] if held else None)
                last = int(new[-1]) if len(new) else 0
                if len(new) and (last or held):
                    held.append(table.slice(0, last))
                    yield from done()
                    held = []
                held.append(table.slice(last))
        if held:
            yield from done()

    return ordered.mapInArrow(run, schema)


def blocks(starts: np.ndarray, total: int, power: int = 1, most: int = CELLS) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of groups, last excluded, whose padded arrays (the largest size to a power, for each group) have at most ``most`` cells; a group at least."""
    sizes, first, widest = np.diff(starts, append=total).tolist(), 0, 0
    for i, size in enumerate(sizes):
        widest = max(widest, size)
        if i > first and (i + 1 - first) * widest**power > most:
            yield first, i
            first, widest = i, size
    if sizes:
        yield first, len(sizes)


class Padded:
    """The groups ``first`` to ``last`` as rows of arrays; ``own`` tells the cells that hold a row, ``at`` the row of the table."""

    def __init__(self, starts: np.ndarray, total: int, first: int, last: int):
        ends = np.append(starts[1:], total)[first:last]
        sizes = ends - starts[first:last]
        column = np.arange(sizes.max())
        self.own = column < sizes[:, None]
        self.at = np.where(self.own, starts[first:last, None] + column, 0)

    def of(self, values: np.ndarray, empty: float = np.nan) -> np.ndarray:
        return np.where(self.own, values[self.at], empty)


def numbers(table: pa.Table, column: str) -> np.ndarray:
    """A column of numbers as doubles, nulls as NaN."""
    return table.column(column).to_numpy().astype(float)


def half_up(values: np.ndarray, places: int) -> np.ndarray:
    """Rounded to ``places`` decimals, halves away from zero."""
    scaled = np.abs(values) * 10.0**places
    low = np.floor(scaled)
    return np.copysign((low + (scaled - low >= 0.5)) / 10.0**places, values)
