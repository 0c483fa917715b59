"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.plans.store import join_small, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    # the least are written first: a join right above two exchanges is one that AQE splits where a node has many edges
    pairs = join_small(both, materialize(least), "u", "inner")
    if large:
        out = pairs.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def _joined(batches):
    """(u, v) of all edges, bounded by the caller -> (node, component), by union-find."""
    parent: dict = {}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    kind = None
    for b in batches:
        kind = b.schema.field(0).type
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a, c = find(parent.setdefault(u, u)), find(parent.setdefault(v, v))
            if a != c:
                parent[max(a, c)] = min(a, c)
    if parent:
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), kind), pa.array([find(x) for x in parent], kind)], names=["node", "component"])


def connected_components(edges: DataFrame, max_rounds: int = 60, one_task: int = 0) -> DataFrame:
    """(u, v) undirected edges -> (node, component): the smallest node reachable. Nodes without an edge don't appear; self-loops and repeats are ignored; an empty input gives an empty result. At most ``one_task`` edges, counted first, are joined in one task instead of rounds of many: the result is the same."""
    edges = materialize(edges.filter("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if one_task and edges.count() <= one_task:
        kind = dict(edges.dtypes)["u"]
        return edges.select("u", "v").coalesce(1).mapInArrow(_joined, f"node {kind}, component {kind}")
    seen = None
    for _ in range(max_rounds):
        edges = materialize(_star(_star(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v"))).groupBy("node").agg(F.min("component").alias("component"))
