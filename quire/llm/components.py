"""Connected components of an edge table.

Each task first contracts the edges it reads to stars, wherever they lie: nothing is shuffled for
that, and a task holds HELD nodes at most. If SMALL edges at most remain, one task finishes
them; else nodes are hung on least neighbours in alternating star rounds until nothing changes,
so no task ever holds more than a share of the edges, or SMALL of them.
"""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


SMALL = 200_000
#: Nodes of a union-find; SMALL edges have no more.
HELD = 400_000


def _contract(batches, roots: bool = False):
    """Edges of one task to stars of its own union-find, of each HELD nodes. roots: the stars' centres are rows too."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(v, r) for v in parent if (r := root(v)) != v or roots]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for batch in batches:
        if len(parent) > HELD:
            yield stars()
            parent.clear()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    yield stars()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v. Large: every larger neighbour of a node is hung on its least neighbour; small: so are its smaller ones and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str, roots: bool = False) -> DataFrame:
    """(node, root) of every node that an edge touches; root: the component's least node. The roots themselves have a row if roots is set."""
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    now = stage(pairs.mapInArrow(_contract, "u long, v long"), "cc")
    if now.count() <= SMALL:
        now = stage(now.coalesce(1).mapInArrow(partial(_contract, roots=roots), "u long, v long"), "cc")
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    mark = None
    while True:
        now = stage(_star(stage(_star(now, True), "cc"), False), "cc")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            now = now.unionByName(now.select(F.col("v").alias("u"), "v").distinct()) if roots else now
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(new)
