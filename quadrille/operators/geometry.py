"""Vector geometry as expressions on arrays of points; hulls and rectangles by Arrow functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import RING, Grid


def ring(*points: tuple[Column, Column]) -> Column:
    """A closed ring of (x, y) expressions."""
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in (*points, points[0])])


def rectangle(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return ring((xmin, ymin), (xmin, ymax), (xmax, ymax), (xmax, ymin))


def _pairs(r: Column) -> Column:
    n = F.size(r)
    return F.arrays_zip(F.slice(r, F.lit(1), n - 1).alias("a"), F.slice(r, F.lit(2), n - 1).alias("b"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _cross(p: Column) -> Column:
    return p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]


def _signed(r: Column) -> Column:
    return _sum(F.transform(_pairs(r), _cross)) / 2


def area(r: Column) -> Column:
    return F.abs(_signed(r))


def perimeter(r: Column) -> Column:
    return _sum(F.transform(_pairs(r), lambda p: F.hypot(p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"])))


def centroid(r: Column) -> tuple[Column, Column]:
    six = 6 * _signed(r)
    x = _sum(F.transform(_pairs(r), lambda p: (p["a"]["x"] + p["b"]["x"]) * _cross(p)))
    y = _sum(F.transform(_pairs(r), lambda p: (p["a"]["y"] + p["b"]["y"]) * _cross(p)))
    return F.when(six != 0, x / six), F.when(six != 0, y / six)


def bounds(r: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, by the monotone chain."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(seq):
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def shoelace(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2 if len(p) > 2 else 0.0


def min_rectangle(points: np.ndarray) -> tuple[float, float, float]:
    """(short side, long side, angle) of the rectangle of least area around points: one side lies on a hull edge."""
    h = hull(points)
    if len(h) < 3:
        side = float(np.hypot(*(h[-1] - h[0]))) if len(h) else 0.0
        return 0.0, side, 0.0
    edges = np.roll(h, -1, axis=0) - h
    angles = np.unique(np.round(np.mod(np.arctan2(edges[:, 1], edges[:, 0]), np.pi / 2), 12))
    best = None
    for a in angles:
        turned = h @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
        w, t = turned.max(0) - turned.min(0)
        if best is None or w * t < best[0] - 1e-9:
            best = (w * t, min(w, t), max(w, t), float(a))
    return best[1:]


def _points(r) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in r], float).reshape(-1, 2) if r is not None else np.zeros((0, 2))


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("hull_area", "short", "long", "angle")]))
def hull_measures(rings: pd.Series) -> pd.DataFrame:
    rows = []
    for r in rings:
        p = _points(r)
        rows.append((shoelace(hull(p)), *min_rectangle(p)))
    return pd.DataFrame(rows, columns=["hull_area", "short", "long", "angle"])


def shape_props(layer: DataFrame, props: list[str], geom: str = "ring") -> DataFrame:
    """layer with a column for each property of its rings.

    Eccentricity is the ratio of the short to the long side of the smallest rectangle, solidity that of the
    hull to the bounding box, as layers written before expect.
    """
    r = F.col(geom)
    xmin, ymin, xmax, ymax = bounds(r)
    box = (xmax - xmin) * (ymax - ymin)
    if {"MajorAxisLength", "MinorAxisLength", "Eccentricity", "Solidity"} & set(props):
        layer = layer.withColumn("_m", hull_measures(r))
    m, (cx, cy) = F.col("_m"), centroid(r)
    known = {
        "Area": {"Area": area(r)}, "Perimeter": {"Perim": perimeter(r)}, "MajorAxisLength": {"MjAxis": m["long"]}, "MinorAxisLength": {"MnAxis": m["short"]},
        "Eccentricity": {"Eccen": F.when(m["long"] > 0, m["short"] / m["long"])}, "Solidity": {"Solid": F.when(box > 0, m["hull_area"] / box)},
        "Extent": {"Extent": F.when(box > 0, area(r) / box)}, "AverageWidth": {"AvWidth": F.when(perimeter(r) > 0, 4 * area(r) / perimeter(r))}, "Centroid": {"cx": cx, "cy": cy},
    }
    if unknown := set(props) - set(known):
        raise ValueError(f"unknown properties {sorted(unknown)}")
    for p in props:
        layer = layer.withColumns(known[p])
    return layer.drop("_m")


def moments(cells: DataFrame, by: list[str]) -> DataFrame:
    """Orientation, in radians from the row axis, and principal spreads of each group's cells (row, col)."""
    rr, cc, rc = F.var_pop("row"), F.var_pop("col"), F.covar_pop("row", "col")
    m = cells.groupBy(*by).agg(rr.alias("a"), cc.alias("c"), rc.alias("b"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    root = F.sqrt(4 * b * b + (a - c) * (a - c))
    return m.select(*by, F.when(F.abs(a - c) + F.abs(b) < 1e-12, 0.0).otherwise(0.5 * F.atan2(2 * b, a - c)).alias("orientation"), ((a + c + root) / 2).alias("major_var"), ((a + c - root) / 2).alias("minor_var"))


# --- pixels and geometry ---


def pixel_offsets(layer: DataFrame, grid: Grid, extra: int = 0) -> DataFrame:
    """xoff, yoff, xcount, ycount of each bounding box (xmin, ymin, xmax, ymax); the pixel width serves both axes; counts truncate and are at least 1."""
    px = F.lit(grid.px)
    count = lambda a, b: F.greatest(((b - a) / px).cast("int") + extra, F.lit(1))
    return layer.withColumns({
        "xoff": ((F.col("xmin") - grid.x0) / px).cast("int"), "yoff": ((grid.y0 - F.col("ymax")) / px).cast("int"),
        "xcount": count(F.col("xmin"), F.col("xmax")), "ycount": count(F.col("ymin"), F.col("ymax")),
    })


def sample_points(points: DataFrame, pixels: DataFrame, grid: Grid, values: list[str], how: str = "left") -> DataFrame:
    """points (x, y) with the values of the pixels they lie in; null outside."""
    keyed = points.withColumns({"col": grid.col_of(F.col("x")), "row": grid.row_of(F.col("y"))})
    return keyed.join(pixels.select("row", "col", *values), ["row", "col"], how)


def inside_extent(points: DataFrame, grid: Grid) -> DataFrame:
    """Points in the half-open extent of a raster."""
    x1, y1 = grid.x0 + grid.px * grid.width, grid.y0 + grid.py * grid.height
    return points.where((F.col("x") >= grid.x0) & (F.col("x") < x1) & (F.col("y") >= y1) & (F.col("y") < grid.y0))


def pixel_points(pixels: DataFrame, grid: Grid, value: str, nodata: list[float]) -> DataFrame:
    """(fid, x, y, value): upper left corners of pixels that aren't nodata, fids from 1 by row and column."""
    from .tiles import sequential

    rows = pixels.where(~F.col(value).isin([float(x) for x in nodata])).select("row", "col", grid.x_of(F.col("col")).alias("x"), grid.y_of(F.col("row")).alias("y"), F.col(value).alias("value"))
    return sequential(rows, F.col("row"), ["row", "col"], "fid", 1).select("fid", "x", "y", "value")


def pixel_mesh(pixels: DataFrame, grid: Grid) -> DataFrame:
    """(fid, ring): each cell's square, fids from 1 by row and column of the full grid."""
    x, y = grid.x_of(F.col("col")), grid.y_of(F.col("row"))
    fid = (F.col("row").cast("long") * grid.width + F.col("col") + 1).alias("fid")
    return pixels.select(fid, rectangle(x, y + grid.py, x + grid.px, y).alias("ring"))


def mesh(spark, xmin: float, ymin: float, xmax: float, ymax: float, side: float, angle: float = 0.0) -> DataFrame:
    """(fid, ring): square cells that cover an extent, in column order from the upper left, turned by an angle in radians about the extent's centre."""
    import math

    cols, rows = math.ceil((xmax - xmin) / side), math.ceil((ymax - ymin) / side)
    cells = spark.range(cols * rows).select("id", F.expr(f"id div {rows}").alias("i"), F.expr(f"id % {rows}").alias("j"))
    ox, oy, s, k = (xmin + xmax) / 2, (ymin + ymax) / 2, math.sin(angle), math.cos(angle)

    def corner(di: int, dj: int) -> tuple[Column, Column]:
        x, y = xmin + (F.col("i") + di) * side - ox, ymax - (F.col("j") + dj) * side - oy
        return x * k - y * s + ox, x * s + y * k + oy

    return cells.select((F.col("id") + 1).alias("fid"), ring(corner(0, 1), corner(0, 0), corner(1, 0), corner(1, 1)).alias("ring"))


def buffer_box(layer: DataFrame, dist: float) -> DataFrame:
    """Bounding boxes grown by a distance on all sides, with mitred corners."""
    return layer.withColumns({"xmin": F.col("xmin") - dist, "ymin": F.col("ymin") - dist, "xmax": F.col("xmax") + dist, "ymax": F.col("ymax") + dist})


def buffer_point(points: DataFrame, dist: float, segments: int = 16) -> DataFrame:
    """Points as regular polygons of 4 * segments corners on a circle."""
    import math

    n = 4 * segments
    corners = [(F.col("x") + dist * math.cos(2 * math.pi * i / n), F.col("y") - dist * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return points.withColumn("ring", ring(*corners))


def box_tiles(layer: DataFrame, size: float) -> DataFrame:
    """A row for each tile of a size in map units that the box touches."""
    rows = layer.withColumn("_tx", F.explode(F.sequence(F.floor(F.col("xmin") / size), F.floor(F.col("xmax") / size))))
    return rows.withColumn("_ty", F.explode(F.sequence(F.floor(F.col("ymin") / size), F.floor(F.col("ymax") / size))))


def overlay_boxes(layer: DataFrame, clip: DataFrame, size: float) -> DataFrame:
    """(fid, clip_fid, box) of every pair of boxes with a common area, by tiles; each pair once, at the tile of the corner its boxes share."""
    names = ("xmin", "ymin", "xmax", "ymax")
    other = box_tiles(clip, size).select("_tx", "_ty", F.col("fid").alias("clip_fid"), *[F.col(c).alias(f"k_{c}") for c in names])
    both = box_tiles(layer, size).join(other, ["_tx", "_ty"])
    x0, y0 = F.greatest("xmin", "k_xmin"), F.greatest("ymin", "k_ymin")
    x1, y1 = F.least("xmax", "k_xmax"), F.least("ymax", "k_ymax")
    once = (F.col("_tx") == F.floor(x0 / size)) & (F.col("_ty") == F.floor(y0 / size))
    return both.where((x0 < x1) & (y0 < y1) & once).select("fid", "clip_fid", x0.alias("xmin"), y0.alias("ymin"), x1.alias("xmax"), y1.alias("ymax"))


def clip_convex(subject: np.ndarray, clipper: np.ndarray) -> np.ndarray:
    """A polygon clipped to a convex one (open rings), by Sutherland and Hodgman."""
    out = [tuple(p) for p in subject]
    k = hull(clipper)
    for a, b in zip(k, np.roll(k, -1, axis=0)):
        side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])  # noqa: B023, E731
        kept: list = []
        for p, q in zip(out, out[1:] + out[:1]):
            sp, sq = side(p), side(q)
            if sp >= 0:
                kept.append(p)
            if sp * sq < 0:
                t = sp / (sp - sq)
                kept.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        out = kept
    return np.array(out, float).reshape(-1, 2)


@F.pandas_udf(RING)
def clip_ring(subject: pd.Series, clipper: pd.Series) -> pd.Series:
    """Rings clipped to convex rings; null without a common area."""
    out = []
    for s, c in zip(subject, clipper):
        p = clip_convex(_points(s)[:-1], _points(c)[:-1])
        out.append([{"x": x, "y": y} for x, y in np.vstack([p, p[:1]])] if len(p) > 2 else None)
    return pd.Series(out)


def geojson(layer: DataFrame, geom: str = "ring", keep: list[str] | None = None) -> DataFrame:
    """(fid, feature): each ring as a GeoJSON polygon feature."""
    coords = F.array(F.transform(F.col(geom), lambda p: F.array(p["x"], p["y"])))
    shape = F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates"))
    return layer.select("fid", F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*(keep or ["fid"])).alias("properties"))).alias("feature"))
