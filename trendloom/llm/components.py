"""Connected components of link tables, without collecting anything on the driver.

Chunks of a bounded number of links are contracted in numpy, each to one star per component of its own; where there
are several chunks, alternating stars join what they found."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import checkpoint


#: Links that one task contracts on average.
CHUNK = 2_000_000


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links and the smallest node each one reaches."""
    nodes, ends = np.unique(np.r_[a, b], return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        open_ = p != q
        if not open_.any():
            return nodes, nodes[root]
        x, y, p, q = x[open_], y[open_], p[open_], q[open_]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        nodes, roots = contract(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "component"])


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, component) of every linked node; component is the smallest node that can be reached.

    Each round hangs every node's larger neighbours, then its smaller ones, below its smallest neighbour; the
    number of rounds grows with the logarithm of the longest chain. Links in either direction, repeated ones and
    loops may occur; no links give no rows."""
    links = checkpoint(links.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).filter("u <> v"))
    chunks = links.count() // CHUNK + 1
    stars = links.coalesce(chunks).mapInArrow(_contracted, "node bigint, component bigint")
    if chunks == 1:
        return stars
    edges = checkpoint(stars.select(F.col("node").alias("u"), F.col("component").alias("v")).filter("u <> v").distinct())
    state = None
    for _ in range(most):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        edges = checkpoint(hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(pmod(xxhash64(v, u), 1000000007) as bigint))")).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components have not settled")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
