"""Connected components of an edge table by alternating large and small stars.

Each round is two aggregations (with map-side combining) and two joins whose long sides
adaptive execution may split, so a component with a third of all nodes is no obstacle,
and no node's neighbours are ever gathered in one row.  Before the first round, every
partition replaces its own edges by a spanning forest.  Lineage is cut every round in
the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from each node to the least node of its component among each run of edges."""
    for b in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (p := parent.setdefault(root, root)) != root:
                root = p
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
        pairs = [(x, r) for x in list(parent) if (r := find(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["u", "v"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node of each component, for every node that has an edge to another.

    ``a`` and ``b`` are longs; an edge of a node to itself says nothing; repeated edges count once.
    """
    given = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v")
    current = checkpointed(given.mapInArrow(_forest, "u long, v long").distinct())  # from larger to smaller
    mark = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == mark or state[0] == 0:
            break
        mark = tuple(state)
        current = checkpointed(_small_star(_large_star(current)))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
