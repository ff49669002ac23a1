"""Connected components of a distributed graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import join_hot, map_pandas
from tidyloom.session import cut

#: Links that one task contracts: 16 bytes each, and about a hundred while it works.
LINKS_A_TASK = 1 << 20


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number that each of ``n`` numbers reaches over the links ``i``-``j``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def connected_components(links: DataFrame) -> DataFrame:
    """Label each node of ``links(a, b)`` with the smallest node that it reaches: ``(node, root)``.

    First the links are dealt to tasks of at most ``LINKS_A_TASK``, and each leaves a star for each
    component that it sees. What several tasks have seen is put together by rounds of large-star and
    small-star steps: every node hands its neighbours on to the smallest of them, so paths shrink by half
    or more in a round. Each round is cut into a table in the shared folder. Nodes without
    links are not returned; self-links and repeated links do no harm, nor do nulls, which are left out.
    """
    pairs = cut(links.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")))
    tasks = -(-pairs.count() // LINKS_A_TASK)
    edges = cut(map_pandas(pairs.repartition(max(1, tasks)), _contract, "u bigint, v bigint"))
    before = None
    while tasks > 1:
        edges = cut(_small_star(cut(_large_star(edges))))
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A star for each component of a task's links."""
    parts = [b.to_numpy() for b in batches]
    if parts:
        ends = np.concatenate(parts)
        nodes, at = np.unique(ends, return_inverse=True)
        at = at.reshape(ends.shape)
        root = local_roots(len(nodes), at[:, 0], at[:, 1])
        inner = np.flatnonzero(root != np.arange(len(nodes)))
        yield pd.DataFrame({"u": nodes[inner], "v": nodes[root[inner]]})


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the node's smallest neighbour or itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def smallest_members(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes(node, id, ...)`` with the smallest ``id`` of each node's component, ``component_id``.

    Nodes are unique. A component may hold any share of the nodes: its smallest identifier is found
    by a reduction and brought back by ``join_hot``.
    """
    roots = cut(connected_components(links))
    placed = cut(nodes.join(roots, "node", "left"))
    linked = placed.where("root is not null")
    least = cut(linked.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("size")))
    moved = join_hot(linked, least, "root", "size").select(*nodes.columns, "component_id")
    alone = placed.where("root is null").select(*nodes.columns, F.col("id").alias("component_id"))
    return moved.unionByName(alone)
