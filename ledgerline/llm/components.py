"""Connected components of an edge table by local contraction and alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, drop

#: Edges that a task contracts at a time.
CHUNK_EDGES = 1 << 21


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node and smallest node reachable, of the nodes of these edges that are not the smallest themselves."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, with the components of `edges`: each task turns what it reads into stars, without a shuffle."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def stars() -> pa.RecordBatch:
            u, v = forest(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v")))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= CHUNK_EDGES:
                yield stars()
                held, size = [], 0
        if size:
            yield stars()

    return edges.mapInArrow(work, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of `edges` (u long, v long).

    Each round contracts what a task reads, then hangs neighbours on the smallest node near them, by a grouped minimum and a join that Spark can split
    where a node has very many neighbours. Rounds end once every edge points from a node to its root; as every round that changes an edge
    replaces an end by a smaller node, they do end. Between rounds the edges are written to the shared folder; nothing of them
    reaches the driver. Null ends and loops are dropped; repeated edges count once; no edges give no rows.
    """

    def tidy(pairs: DataFrame) -> DataFrame:
        return pairs.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def unsettled(pairs: DataFrame) -> bool:
        ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("root")).union(pairs.select("v", F.lit(0), F.lit(1)))
        roles = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
        return not roles.filter("child > 1 or child = 1 and root = 1").isEmpty()

    now = cut(tidy(contracted(edges.filter("u is not null and v is not null"))), "edges")
    while unsettled(now):
        before = now
        pairs = contracted(before)
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = tidy(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # Edges point from the larger node to the smaller, so the small-star step takes them as they stand.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        now = cut(tidy(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))), "edges")
        drop(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
