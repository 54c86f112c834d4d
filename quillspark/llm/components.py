"""Connected components of an edge table, by alternating star contractions.

Every round rewrites the edges so that each node points at the smallest node
around it (large star: neighbours above a node; small star: neighbours below).
The edge table never grows beyond its size, so a hub with a third of all edges
costs no more than its edges; groups are reduced by map-side minima first.

A table of at most ``ONE_TASK`` edges, which is counted first unless a bound is known, is
cheaper to solve in one task by union-find (two dozen megabytes); beyond it the
contractions run.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import arrow_map, discard, materialize


#: Edges that one task may hold.
ONE_TASK = 500_000


def _union_find(batches):
    """(node, component) of all edges of the task; a root is its tree's least node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for k in range(0, len(nodes), 1 << 16):
        part = nodes[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["node", "component"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    up = both.where("b > a").join(least, "a")
    return up.select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b")
    return out.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def connected_components(edges: DataFrame, label: str = "components", at_most: int | None = None) -> DataFrame:
    """(node, component) of every node that an edge (a, b) touches; the component is its smallest node.

    Loops and repeated edges are ignored, an empty table gives an empty table,
    edges with a null end are ignored. ``at_most``: a bound of the number of edges, if known.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    if at_most is not None and at_most <= ONE_TASK:
        return materialize(arrow_map(edges.select("a", "b").coalesce(1), _union_find, "node long, component long"), label)
    cur = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), label)
    if cur.count() <= ONE_TASK:
        out = materialize(arrow_map(cur.coalesce(1), _union_find, "node long, component long"), label)
        discard(cur)
        return out
    before = None
    while True:
        nxt = materialize(_small_star(_large_star(cur)), label)
        sign = nxt.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.hash("b", "a").cast("long"))).first()
        discard(cur)
        cur = nxt
        if sign == before or not sign[0]:
            break
        before = sign
    out = cur.select(F.col("b").alias("node"), F.col("a").alias("component"))
    out = out.union(cur.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    out._quill_path = cur._quill_path
    return out
