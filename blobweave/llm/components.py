"""Connected components of an edge table by spreading minima with pointer jumping; up to ``FEW`` edges are joined within one task.

Defined cases: edges with a null end and loops are left out, repeated edges count once; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, heavy_keys, join_split

#: Edges that one task joins in memory, some hundred bytes each; more are spread over all tasks.
FEW = 100_000


def at_once(edges: DataFrame) -> DataFrame:
    """``components`` of a few edges (a, b), within one task."""
    kind = edges.schema["a"].dataType

    def run(batches):
        root: dict = {}

        def top(k):
            while root.setdefault(k, k) != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        own = None
        for batch in batches:
            own = batch.schema.field("a").type
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                low, high = sorted((top(a), top(b)))
                root[high] = low
        nodes = list(root)
        if nodes:
            cols = [pa.array(nodes, own), pa.array([top(k) for k in nodes], own)]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, T.StructType().add("node", kind).add("component", kind))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (node, component) for the nodes of edges (a, b): the smallest node that each reaches.

    Each round takes the least of a node's label, its neighbours' labels and its label's label; it ends when no label changes.
    Labels are written to the shared folder, so the plan does not grow. Nodes with many neighbours, and labels that
    many nodes have, are joined in parts.
    """
    once = scratch.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    n = once.count()
    if n <= FEW:
        return scratch.save(at_once(once))
    both = once.union(once.select("b", "a"))
    heavy = scratch.save(heavy_keys(both.groupBy("b").agg(F.count("*").alias("n")), ["b"], 2 * n))
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    nodes = labels.count()
    while True:
        crowd = heavy_keys(labels.groupBy("component").agg(F.count("*").alias("n")), ["component"], nodes)
        jump = join_split(labels, labels.select(F.col("node").alias("component"), F.col("component").alias("further")), "component", heavy=crowd)
        near = join_split(both, labels.withColumnRenamed("node", "b"), "b", heavy=heavy).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        new = jump.join(near, "node").select("node", F.least("component", "further", "near").alias("new"), "component")
        saved = scratch.save(new)
        scratch.drop(labels)
        labels = saved.select("node", F.col("new").alias("component"))
        if not saved.where("new <> component").limit(1).count():
            return labels
