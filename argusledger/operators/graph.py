"""Graph operators over edge tables: weak and strong components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argusledger.functions.tables import cut, drop_cut, skew_join, small

#: Up to so many edges one task settles the components (tens of MB); beyond it the star steps do, over all executors.
ONE_TASK_EDGES = 500_000
#: Edges that a task settles at a time before the components that it finds are merged with those of other tasks.
CHUNK_EDGES = 500_000


def _print(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return r.n, r.x or 0


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v) with u > v.  Large: every larger neighbour of u is linked to the smallest of
    u's neighbourhood; small: so are the smaller ones and u itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    least = least.select("u", F.least("u", "m").alias("m"), "n")
    rows = skew_join(both, least, "u", "n")
    if large:
        out = rows.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = rows.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _one_task(batches):
    """(node, component) of all edges (u, v): hooking of roots and pointer jumping."""
    parts = list(batches)
    table = pa.Table.from_batches(parts) if parts else None
    if table is None or not table.num_rows:
        return
    both = pa.chunked_array([*table.column("u").chunks, *table.column("v").chunks])
    names, place = np.unique(both.to_numpy(), return_inverse=True)
    u, v = place[: table.num_rows], place[table.num_rows :]
    label = np.arange(len(names))
    while (label[u] != label[v]).any():
        least = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u].copy(), least)
        np.minimum.at(label, label[v].copy(), least)
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(names, both.type), pa.array(names[label], both.type)], names=["node", "component"])


def _forests(batches):
    """(node, component) of the edges that a task sees, up to CHUNK_EDGES of them at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK_EDGES:
            yield from _one_task(held)
            held, n = [], 0
    yield from _one_task(held)


def _merged(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, p), p the smallest component that a node has in any task, and edges (u, v) between components that share a node."""
    kind = pairs.schema["u"].dataType.simpleString()
    found = cut(pairs.mapInArrow(_forests, f"node {kind}, component {kind}"))
    nodes = cut(found.groupBy("node").agg(F.min("component").alias("p"), F.max("component").alias("q")))
    shared = small(nodes.filter("p <> q").select("node", "p"))
    links = found.join(shared, "node").filter("component <> p").select(F.col("component").alias("u"), F.col("p").alias("v")).distinct()
    links = cut(links)
    drop_cut(found)
    return nodes.select("node", "p"), links


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, component) for every endpoint; the component is its smallest node.

    A graph of at most ``one_task_edges`` edges is settled in one task.  Of a larger one each task settles the edges that it has, CHUNK_EDGES
    at a time; the components found there that share a node are the edges of a smaller graph, and so on while they grow fewer by a quarter.
    What is left is settled by alternating large-star and small-star steps, whose rounds grow with the logarithm of the longest path.
    Each round is written to the shared folder, so a lost executor costs one round at most.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null")
    now = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    n, levels = now.count(), []
    while n > max(one_task_edges, 0):
        nodes, links = _merged(now)
        drop_cut(now)
        levels.append(nodes)
        before, n, now = n, links.count(), links
        if 4 * n > 3 * before:
            break
    if n <= max(one_task_edges, 0):
        kind = now.schema["u"].dataType.simpleString()
        labels = now.repartition(1).mapInArrow(_one_task, f"node {kind}, component {kind}")
    else:
        labels = _by_stars(now, max_rounds)
    for nodes in reversed(levels):
        held = nodes.groupBy("p").agg(F.count("*").alias("n")).join(labels.withColumnRenamed("node", "p"), "p")
        labels = skew_join(nodes, cut(held), "p", "n").select("node", F.coalesce("component", "p").alias("component"))
    return labels


def _by_stars(edges: DataFrame, max_rounds: int) -> DataFrame:
    """(node, component) of all edges (u, v), u > v or equal, by star steps over all executors."""
    all_pairs = cut(edges.distinct())
    nodes = cut(all_pairs.select(F.col("u").alias("node")).unionByName(all_pairs.select(F.col("v").alias("node"))).distinct())
    now = cut(all_pairs.filter("u <> v"))
    seen = _print(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        middle = cut(_star(now, large=True))
        after = cut(_star(middle, large=False))
        drop_cut(middle)
        drop_cut(now)
        now, mark = after, _print(after)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return nodes.join(now.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
