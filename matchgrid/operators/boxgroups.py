"""Connected components of very many small graphs at once: the groups of overlapping boxes in each frame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def labelled(graph: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(graph, node, smallest node of its component) for edges a - b of all graphs together, by pointer jumping.

    The number of rounds grows with the logarithm of the largest component; a round is a few numpy calls over all graphs.
    """
    ends = np.concatenate([np.stack([graph, a], 1), np.stack([graph, b], 1)])
    nodes, at = np.unique(ends, axis=0, return_inverse=True)  # sorted by graph, then node
    at = at.reshape(-1)
    left, right, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        for side in (label[left], label[right], left, right):  # also the labels' own labels: trees are hooked, not only nodes
            np.minimum.at(new, side, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes[:, 0], nodes[:, 1], nodes[label, 1]
        label = new


def components(edges: DataFrame, key: str) -> DataFrame:
    """(key, node, component): for edges (key, a_id, b_id) of integer nodes, the smallest node of each node's component.

    Edges are sorted by key inside partitions and pass as Arrow batches; only the last key of a batch waits for the next one. A key's edges
    (a frame's boxes) fit a task.
    """
    fields = edges.schema
    schema = T.StructType([fields[key], T.StructField("node", T.LongType()), T.StructField("component", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        def out(rows: np.ndarray) -> pa.RecordBatch:
            graph, node, component = labelled(*rows)
            return pa.RecordBatch.from_arrays([pa.array(graph).cast(to_arrow_type(fields[key].dataType)), pa.array(node), pa.array(component)], schema.names)

        held = np.zeros((3, 0), np.int64)
        for batch in batches:
            rows = np.hstack([held, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])])
            done = np.searchsorted(rows[0], rows[0, -1]) if rows.shape[1] else 0
            if done:
                yield out(rows[:, :done])
            held = rows[:, done:]
        if held.shape[1]:
            yield out(held)

    rows = edges.select(key, F.col("a_id").cast("long").alias("a_id"), F.col("b_id").cast("long").alias("b_id")).dropna()
    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def coloured(groups: DataFrame, key: str) -> DataFrame:
    """``groups`` with ``colour``: 0.. by the smallest node of each component of a key."""
    return groups.withColumn("colour", F.dense_rank().over(Window.partitionBy(key).orderBy("component")) - 1)
