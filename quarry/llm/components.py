"""Connected components of an edge table, entirely in Spark.

Each partition first contracts its own edges (union-find over that partition's rows only, in
bounded batches), apart from the tasks that made the edges, which may hold a Python worker of their own; then large-star and small-star steps alternate until the edges stay the same.
Every step is a partial aggregate and a join that adaptive execution can split; each round is
cut with a checkpoint in the shared folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import cut_lineage

EDGE = "a long, b long"
BATCH_EDGES = 500_000


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        x, y = (x, y) if x < y else (y, x)
        self.parent[y] = x
        self.parent.setdefault(x, x)
        return True

    def edges(self) -> pa.RecordBatch:
        found = [(x, r) for x in list(self.parent) if (r := self.find(x)) != x]
        return pa.record_batch([pa.array([x for x, _ in found], pa.int64()),
                                pa.array([y for _, y in found], pa.int64())], names=["a", "b"])


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fewer edges that connect the same nodes."""
    forest = Forest()
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(x, y)
        if len(forest.parent) > BATCH_EDGES:
            yield forest.edges()
            forest = Forest()
    yield forest.edges()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    return e.join(least, "a").select(F.explode(F.array(
        F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
        F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s")).select("s.*").where("a <> b")


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: columns a, b (long, not null; loops and repeats allowed).  Returns (node, component)
    for every node of an edge between two different nodes; component is the smallest node reachable."""
    e = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"))
    e = cut_lineage(e.mapInArrow(contract, EDGE).distinct())
    before = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        e = cut_lineage(_small_star(_large_star(e)).distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
