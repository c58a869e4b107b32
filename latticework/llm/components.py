"""Connected components of an edge list, labelled in one task if it is small, else contracted first.

Up to `BOUNDED` edges meet in one task, a few MB, which labels them in one go. Of more, each partition
first keeps a spanning forest of its own edges, so at most one edge a node leaves it; what is still too
large is labelled by distributed large-star and small-star rounds. All give the same labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components as star_components
from .common import cut, map_arrow

#: Edges (16 bytes each) that one task labels.
BOUNDED = 300_000


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of each one's component), by hooking roots to lesser roots and pointer jumping."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    up = np.arange(len(nodes))
    while True:
        lo, hi = np.minimum(up[x], up[y]), np.maximum(up[x], up[y])
        apart = lo != hi
        if not apart.any():
            return nodes, nodes[up]
        np.minimum.at(up, hi[apart], lo[apart])
        while not np.array_equal(nxt := up[up], up):
            up = nxt


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) within this partition, for all nodes of its edges (a, b)."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if parts:
        nodes, least = least_labels(*(np.concatenate(c) for c in zip(*parts)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of a checkpointed edge list (a long, b long): component is its least node.

    Null ends and loops are left out. Nodes without an edge don't appear. Checkpointed.
    """
    edges = edges.where("a <> b").select("a", "b")
    n, schema = edges.count(), "node long, component long"
    if n > BOUNDED:
        own = map_arrow(edges.coalesce(-(-n // BOUNDED)), _labels, schema)
        edges = cut(own.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
        if edges.count() > BOUNDED:
            return cut(star_components(edges))
    return cut(map_arrow(edges.coalesce(1), _labels, schema))
