"""Connected regions of equal value, in two levels: tiles by a kernel, then the few links between them.

A region's id is its least row * width + column, so results don't depend on tiling.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import tile

CELL = ["row", "col"]


def _label(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id of each cell's 4-connected region of equal value."""
    place = {(r, c): i for i, (r, c) in enumerate(zip(rows.tolist(), cols.tolist()))}
    parent = list(range(len(rows)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (r, c) in enumerate(zip(rows.tolist(), cols.tolist())):
        for n in ((r, c + 1), (r + 1, c)):
            j = place.get(n)
            if j is not None and values[i] == values[j]:
                a, b = find(i), find(j)
                if ids[a] < ids[b]:
                    parent[b] = a
                elif a != b:
                    parent[a] = b
    return np.array([ids[find(i)] for i in range(len(rows))], np.int64)


def _cut(df: DataFrame, path: str) -> DataFrame:
    """Written and read again, so that lineage ends and lost executors cost nothing."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quadrille-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/regions-{uuid.uuid4().hex}"


def merge_labels(edges: DataFrame, folder: str) -> DataFrame:
    """(label, root) of linked labels (u, v): least neighbours, and then their least neighbours, until nothing changes."""
    e = edges.where("u <> v")
    both = _cut(e.select("u", "v").union(e.select("v", "u")).distinct(), f"{folder}/edges")
    now = _cut(both.groupBy(F.col("u").alias("label")).agg(F.least(F.min("v"), F.first("u")).alias("root")), f"{folder}/0")
    k, changed = 0, True
    while changed:  # every round at least doubles how far the least label has come
        k += 1
        near = both.join(now.toDF("v", "r"), "v").groupBy(F.col("u").alias("label")).agg(F.min("r").alias("r"))
        step = now.join(near, "label").select("label", F.least("root", "r").alias("root"))
        jump = step.join(step.select(F.col("label").alias("root"), F.col("root").alias("far")), "root", "left").select("label", F.least("root", F.coalesce("far", "root")).alias("new"))
        new = _cut(now.join(jump, "label").select("label", "root", "new"), f"{folder}/{k}")
        changed = new.where("new <> root").limit(1).count()
        now = new.select("label", F.col("new").alias("root"))
    return now


def components(wide: DataFrame, value: str, width: int, size: int = 32, nodata: float = 0.0) -> DataFrame:
    """(row, col, value, component) of cells that aren't nodata; neighbours along rows and columns of equal value belong together."""
    cells = wide.where(F.col(value) != nodata).select(*CELL, F.col(value).cast("double").alias("value"), (F.col("row").cast("long") * width + F.col("col")).alias("id"))
    keyed = cells.withColumns({"tr": tile(F.col("row"), size), "tc": tile(F.col("col"), size)})

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _label(pdf["row"].to_numpy(), pdf["col"].to_numpy(), pdf["value"].to_numpy(), pdf["id"].to_numpy())
        return pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "value": pdf["value"], "label": found})

    folder = shared_folder(wide.sparkSession)
    labelled = _cut(keyed.groupBy("tr", "tc").applyInPandas(label, "row int, col int, value double, label long"), f"{folder}/tiles")
    low = labelled.where((F.col("row") % size == size - 1) | (F.col("col") % size == size - 1))
    high = labelled.where((F.col("row") % size == 0) | (F.col("col") % size == 0)).toDF("row", "col", "v2", "l2")
    steps = low.select("value", "label", F.explode(F.array(F.struct((F.col("row") + 1).alias("row"), F.col("col").alias("col")), F.struct(F.col("row").alias("row"), (F.col("col") + 1).alias("col")))).alias("n"))
    edges = steps.select("value", "label", "n.row", "n.col").join(high, CELL).where("value = v2 and label <> l2").select(F.col("label").alias("u"), F.col("l2").alias("v")).distinct()
    roots = merge_labels(edges, folder)
    return labelled.join(roots, "label", "left").select(*CELL, "value", F.coalesce("root", "label").alias("component"))


def component_stats(regions: DataFrame) -> DataFrame:
    """Each region's value, cells and bounding box."""
    return regions.groupBy("component").agg(
        F.first("value").alias("value"), F.count("*").alias("cells"), F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max")
    )


def boundary_edges(regions: DataFrame) -> DataFrame:
    """(component, x0, y0, x1, y1): unit edges, in pixels, between a region and what isn't it, with the region on the right."""
    sides = {"n": (-1, 0, (0, 0), (1, 0)), "e": (0, 1, (1, 0), (1, 1)), "s": (1, 0, (1, 1), (0, 1)), "w": (0, -1, (0, 1), (0, 0))}
    options = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), *[F.lit(v).alias(n) for n, v in zip(("ax", "ay", "bx", "by"), (*a, *b))]) for dr, dc, a, b in sides.values()])
    e = regions.select("component", "row", "col", F.explode(options).alias("o"))
    beside = regions.select(F.col("row").alias("nr"), F.col("col").alias("nc"), F.col("component").alias("other"))
    open_ = e.withColumns({"nr": F.col("row") + F.col("o.dr"), "nc": F.col("col") + F.col("o.dc")}).join(beside, ["nr", "nc"], "left").where("other is null or other <> component")
    return open_.select("component", (F.col("col") + F.col("o.ax")).alias("x0"), (F.col("row") + F.col("o.ay")).alias("y0"), (F.col("col") + F.col("o.bx")).alias("x1"), (F.col("row") + F.col("o.by")).alias("y1"))


def polygonize(regions: DataFrame) -> DataFrame:
    """(component, n_rings, ring): outlines in pixels, chained from boundary edges region by region; ring is the longest, the outer one."""

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[tuple, list[tuple]] = {}
        for x0, y0, x1, y1 in pdf[["x0", "y0", "x1", "y1"]].itertuples(index=False):
            out.setdefault((x0, y0), []).append((x1, y1))
        rings = []
        while out:
            start = min(out)
            at, line, way = start, [start], None
            while True:
                ends = out[at]
                # at a point where two corners of a region touch, turn right, which keeps it 4-connected
                if len(ends) > 1 and way is not None:
                    ends.sort(key=lambda p: (p[0] - at[0]) * way[1] - (p[1] - at[1]) * way[0])  # noqa: B023
                to = ends.pop(0)
                if not ends:
                    del out[at]
                way = (to[0] - at[0], to[1] - at[1])
                line.append(to)
                at = to
                if at == start:
                    break
            rings.append(line)
        best = max(rings, key=len)
        return pd.DataFrame({"component": [pdf["component"].iloc[0]], "n_rings": [len(rings)], "ring": [[{"x": float(x), "y": float(y)} for x, y in best]]})

    return boundary_edges(regions).groupBy("component").applyInPandas(chain, "component long, n_rings int, ring array<struct<x:double,y:double>>")
