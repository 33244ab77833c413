"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import workers_can_import, written


def _forest(edges: DataFrame, chunk: int = 200_000) -> DataFrame:
    """The links of each partition replaced by stars of its own components,
    ``chunk`` links at a time: as many links as linked nodes at most."""
    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        def stars() -> pa.RecordBatch:
            pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
            parent.clear()
            return pa.record_batch([pa.array([p[i] for p in pairs], type=pa.int64()) for i in (0, 1)],
                                   names=["u", "v"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) >= chunk:
                yield stars()
        if parent:
            yield stars()

    return edges.mapInArrow(contract, "u long, v long")


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node has one link down, to a node that has none."""
    down = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    tops = edges.select(F.col("v").alias("u"), F.lit(True).alias("top")).distinct()
    wrong = down.join(tops, "u", "left").where("n > 1 or top")
    return wrong.limit(1).count() == 0


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node with a link: the smallest id reachable.

    Each round links every node to its smallest neighbour (large star: larger
    neighbours; small star: smaller ones), until only stars are left; O(log^2 n)
    rounds, each written to the shared folder. Null ends are ignored.
    """
    workers_can_import(links.sparkSession)
    pairs = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where(
        "u is not null and v is not null and u <> v")
    edges = written(_forest(pairs).distinct(), "links")
    while not _only_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(
            least.select("u", F.col("m").alias("v"))).distinct()
        edges = written(_forest(small).distinct(), "links")
    tops = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(tops)
