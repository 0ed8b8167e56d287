"""Connected components of an edge table, by joins and grouped minima only."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farpoint.session import materialize, release


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node``, ``root`` (smallest node reachable, itself included) for every node of an edge.

    Alternates two steps until nothing changes: each node ties its larger neighbours to the smallest
    node it sees, then ties itself and its smaller neighbours to the smallest of them. The number of
    rounds grows with the logarithm of the number of nodes. Only minima are gathered by node, so a
    node with many neighbours needs no list; each round is a written table, so lost executors cost
    no more than one round. Nodes may be of any type that has an order. Edges with a NULL end are
    ignored; a node that has only an edge to itself is its own root.
    """
    u, v = F.col("u"), F.col("v")
    given = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where(u.isNotNull() & v.isNotNull())
    current = materialize(given.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    before = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        following = materialize(_smaller(_larger(current)), "edges")
        release(current)
        current = following
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return current.select(u.alias("node"), v.alias("root")).union(roots).distinct()


def smallest_ties(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every node of the edges but the smallest of each component: that smallest node, and the node."""
    nodes, places = np.unique(np.stack([left, right], axis=1), return_inverse=True)
    a, b = places.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while (apart := root[a] != root[b]).any():
        x, y = root[a[apart]], root[b[apart]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    tied = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[tied]], nodes[tied]


def tied_to_smallest(edges: DataFrame, group: str, left: str = "a", right: str = "b") -> DataFrame:
    """Edges (``a``, ``b``) that tie each node to the smallest node its edges of the same ``group`` reach.

    They join the same nodes as ``edges``, but a path inside a group becomes a star, so that
    :func:`connected_components` needs fewer rounds. A group is held by one task: the caller bounds its edges.
    Ends are bigint and not NULL.
    """

    def tie(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(dict(zip("ab", smallest_ties(pdf["a"].to_numpy(), pdf["b"].to_numpy()))))

    named = edges.select(F.col(left).alias("a"), F.col(right).alias("b"), F.col(group).alias("_group"))
    return named.groupBy("_group").applyInPandas(tie, "a bigint, b bigint")


def _larger(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours, tied to the smallest among the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    tied = edges.select(F.col("u").alias("big"), F.col("v").alias("u")).join(least, "u")
    own = least.where(F.col("m") != F.col("u"))
    return tied.select(F.col("big").alias("u"), F.col("m").alias("v")).union(own.select("u", F.col("m").alias("v")))


def _smaller(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours, tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()
