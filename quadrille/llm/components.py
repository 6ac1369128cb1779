"""Connected components of an edge table: in one task while it is small, else by alternating star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written

#: Edges up to which one task joins them all; they take 16 bytes each.
FEW = 1 << 20


def _mark(df: DataFrame) -> tuple:
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def join_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges, and the smallest of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:  # each node takes its neighbours' least label, then labels are followed to their ends
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new[label], label):
            return nodes, nodes[label]
        label = new[label]


def _together(edges: DataFrame) -> DataFrame:
    def run(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            node, root = join_nodes(*(np.concatenate(x) for x in zip(*parts)))
            for i in range(0, len(node), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(node[i : i + (1 << 16)]), pa.array(root[i : i + (1 << 16)])], names=["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node long, root long")


def connected_components(edges: DataFrame, written: Written, few: int = FEW) -> DataFrame:
    """(u, v) links of long nodes to (node, root): each linked node with the smallest node of its component.

    Beyond `few` edges every round joins each edge with the smallest neighbour of one end, first over
    all neighbours, then over smaller ones, so no node's neighbours are ever gathered in
    one row or task; rounds go on until none changes anything, or so few edges are left. Nulls and loops are ignored; an empty table gives no rows.
    """
    now, path = written.table(
        edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    mark = _mark(now)
    while mark[0] > few:
        both = now.union(now.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        mid, mid_path = written.table(large)
        down = mid.groupBy("u").agg(F.min("v").alias("m"))
        small = mid.join(down, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new, new_path = written.table(small)
        written.drop(path)
        written.drop(mid_path)
        now, path, before, mark = new, new_path, mark, _mark(new)
        if mark == before:  # stars
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
    out = written(_together(now))
    written.drop(path)
    return out
