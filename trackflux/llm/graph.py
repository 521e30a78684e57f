"""Connected components of an edge table, without ever holding all links in one place."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackflux.llm.frames import staged

#: A task's union-find is written out and begun anew when it holds so many nodes.
FOREST_NODES = 1_000_000
#: So few links are finished by one task's union-find; more of them by rounds of joins, with the same result.
FEW_LINKS = 100_000


class Forest:
    """Union-find with path halving; the root of a tree is its smallest node."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, r) for x in self.up if (r := self.root(x)) != x]


def forests(edges: DataFrame) -> DataFrame:
    """Each task's edges (u, v) as a spanning forest of (node, smaller root)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(forest):
            pairs = forest.edges()
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

        forest = Forest()
        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                forest.join(a, b)
            if len(forest.up) > FOREST_NODES:
                yield out(forest)
                forest = Forest()
        yield out(forest)

    return edges.select("u", "v").mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame, rounds: int = 60, few: int | None = None) -> DataFrame:
    """(node, root) of every node that is not itself the smallest of its component.

    Rounds of "every node's neighbours follow its smallest neighbour", up and down, on the
    forests of the tasks. Minima are pre-aggregated and joined back, so a hub's links stay spread.
    """
    few = FEW_LINKS if few is None else few
    e = staged(forests(edges.where("u <> v")).distinct(), "forest")
    before = None
    for _ in range(rounds):
        if e.count() <= few:
            return staged(forests(e.repartition(1)), "components").select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small_star = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))
        e = staged(small_star.distinct(), "links")
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == (state["n"], state["h"]):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = (state["n"], state["h"])
    raise RuntimeError(f"no end after {rounds} rounds")
