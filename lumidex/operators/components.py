"""Connected components of an edge table, without collecting anything to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumidex.session import cut

#: Up to so many edges (of 16 bytes) one task settles them; more go through rounds of joins, with the same result.
FEW_EDGES = 100_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an undirected edge table; root is the least node reached.

    Alternating large-star / small-star contraction (Kiveris et al., SoCC 2014). Minima are
    partial aggregates, so a hub costs one row per map task. They are materialised before their
    joins, so that both sides of a join come from exchanges and a hub's rows can be split at
    runtime. Edges with a null end and self-loops are ignored; an empty table gives no rows.
    """
    e = (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    e = cut(e)
    seen = _signature(e)
    if 0 < seen[0] <= FEW_EDGES:
        kind = e.schema["u"].dataType.simpleString()
        return e.coalesce(1).mapInPandas(_settled, f"node {kind}, root {kind}")
    while seen[0]:
        e = cut(_small_star(_large_star(e)))
        now = _signature(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All edges in one task."""
    edges = pd.concat(list(batches), ignore_index=True)
    node, root = settled(edges["u"].to_numpy(), edges["v"].to_numpy())
    yield pd.DataFrame({"node": node, "root": root})


def settled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(node, root)`` of an edge list: every node takes the least label of its neighbours, and that one's own, until nothing changes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while (label[u] != label[v]).any():
        least = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], least)
        np.minimum.at(label, label[v], least)
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def _signature(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
        e.select(F.col("v").alias("x"), F.col("u").alias("y"))
    )
    least = cut(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))
    return both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    e = cut(e)
    least = cut(e.groupBy("u").agg(F.min("v").alias("m")))
    moved = e.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
