"""Connected components of an edge table, by star contraction.

Defined results: edges whose ends are equal are ignored, repeated ones count once, and their direction does not matter; an
empty table has no components; ends must not be null, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm._common import written

#: Edges that one task contracts at most.
EDGES_PER_TASK = 500_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of each node in the task's edges that is not its own root; roots are least ids."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    nodes = [x for x in above if root(x) != x]
    for at in range(0, len(nodes), 100_000):
        part = nodes[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["a", "b"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.distinct()


def components(edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(a, b): each node that is not the least of its component, and that least node.

    ``edges`` has long columns ``a`` and ``b``. Up to ``edges_per_task`` edges are contracted by one task; more are
    first contracted in tasks of that many, then by alternating large and small stars, until nothing changes.
    """
    edges = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    seen = None
    while True:
        n = edges.count()
        if n <= edges_per_task:
            return written(edges.coalesce(1).mapInArrow(_union_find, "a long, b long"), "stars")
        parts = -(-n // edges_per_task)
        local = edges.repartition(parts, F.least("a", "b")).mapInArrow(_union_find, "a long, b long")
        edges = written(_small_star(written(_large_star(written(local, "local")), "large")), "small")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges
        seen = now
