"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, written


def _local(batches):
    """Spanning stars of the edges of one partition, by union-find: at most one edge a node leaves it."""
    import numpy as np
    import pyarrow as pa

    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    a = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in tables])
    b = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in tables])
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
    root = np.array(parent)
    while (root[root] != root).any():
        root = root[root]
    own = np.nonzero(root != np.arange(len(root)))[0]
    yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["a", "b"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): every node of the edges (a, b) and the least node of its component.  Nodes are BIGINT; loops and nulls are dropped."""
    plain = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).where("a <> b")
    star = written(mapped(plain, _local, "a bigint, b bigint").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        # large star: greater neighbours point to the least of the neighbourhood
        both = star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: lesser neighbours, and the node itself, point to the least of them
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        star = written(large.join(small, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")
        now = tuple(star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return star.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
