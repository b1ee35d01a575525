"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecraft.plans.storage import remove_path, scope, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node around it; one link for each edge, repeats included."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component of all the edges a, b of one task."""
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(parent.setdefault(a, a)), root(parent.setdefault(b, b))
            parent[max(x, y)] = min(x, y)
    if parent:
        nodes = list(parent)
        yield pa.record_batch([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["node", "component"])


def connected_components(edges: DataFrame, max_rounds: int = 60, one_task: int = 200_000) -> DataFrame:
    """node, component for every node of the edges a, b; component is the smallest node of it. Nodes without an edge do not appear.

    At most `one_task` distinct edges are one task's union-find. Rounds of tiny jobs would follow each other so fast that the threads pile up which
    Spark's driver starts for every exchange and keeps for a minute. More edges, however many, take rounds.

    In a round minima are partial aggregates and hubs meet their neighbours in equi-joins that AQE can split, so no step holds a component
    in one task. Those joins are never broadcast, as each broadcast takes a thread and a table of the driver. Each round is written to the
    shared folder, where it takes the place of the one before; only counts and a checksum reach the driver.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    with scope() as made:
        edges = written(edges, "cc", compact=True)
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = mark(edges)
    if before[0] <= one_task:
        kind = dict(edges.dtypes)["a"]
        solved = written(edges.coalesce(1).mapInArrow(_solve, f"node {kind}, component {kind}"), "cc")
        for path in made:
            remove_path(edges.sparkSession, path)
        return solved
    files = max(1, before[0] // 200_000)  # rounds do not add edges to speak of
    for _ in range(max_rounds if before[0] else 0):
        old = made
        with scope() as made:
            edges = written(_small_star(_large_star(edges)), "cc", files=files)
        for path in old:
            remove_path(edges.sparkSession, path)
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
