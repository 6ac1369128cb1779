"""Neighbourhood operators.

A pixel's neighbours come to it by one exploded shift and one shuffle on the
cell; nothing depends on a global order, so tiles may be of any size. Cells beyond the
raster's edge are absent: each operator says what that means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ["row", "col"]


def square(k: int) -> list[tuple[int, int]]:
    h = k // 2
    return [(r, c) for r in range(-h, h + 1) for c in range(-h, h + 1)]


CROSS = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]


def shifted(wide: DataFrame, value: str, offsets: list[tuple[int, int]]) -> DataFrame:
    """(row, col, dr, dc, v): for each cell, the values at the offsets from it; only cells that are there."""
    around = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in offsets])
    moved = wide.select(*CELL, F.col(value).alias("v"), F.explode(around).alias("o"))
    return moved.select((F.col("row") - F.col("o.dr")).alias("row"), (F.col("col") - F.col("o.dc")).alias("col"), "o.dr", "o.dc", "v")


def focal(wide: DataFrame, value: str, offsets: list[tuple[int, int]], agg: dict[str, Column]) -> DataFrame:
    """Aggregates of v over the neighbourhood of each cell of wide; absent neighbours don't count."""
    found = shifted(wide, value, offsets).groupBy(*CELL).agg(*[e.alias(n) for n, e in agg.items()], F.count_if((F.col("dr") == 0) & (F.col("dc") == 0)).alias("_own"))
    return found.where("_own > 0").drop("_own")


def neighbourhood(wide: DataFrame, value: str, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each cell with a column n_<dr>_<dc> for each offset (m for minus); null where there is no neighbour."""
    name = lambda r, c: f"n_{r}_{c}".replace("-", "m")
    pick = {name(r, c): F.max(F.when((F.col("dr") == r) & (F.col("dc") == c), F.col("v"))) for r, c in offsets}
    return focal(wide, value, [*offsets, (0, 0)] if (0, 0) not in offsets else offsets, pick)


def box_mean(wide: DataFrame, value: str, k: int, name: str = "mean") -> DataFrame:
    """k by k mean in two passes, along rows and then along columns: 2 k rows a cell instead of k squared. Needs every cell of the raster; absent ones beyond the edge don't count."""
    h = k // 2
    lines = focal(wide, value, [(0, c) for c in range(-h, h + 1)], {"s": F.sum("v"), "n": F.count("v")})
    packed = lines.select(*CELL, F.struct("s", "n").alias("p"))
    moved = shifted(packed, "p", [(r, 0) for r in range(-h, h + 1)]).groupBy(*CELL).agg(F.sum("v.s").alias("s"), F.sum("v.n").alias("n"), F.count_if(F.col("dr") == 0).alias("own"))
    return moved.where("own > 0").select(*CELL, (F.col("s") / F.col("n")).alias(name))


def multitemp_filter(long: DataFrame, k: int = 7) -> DataFrame:
    """Speckle filter through a stack (band, row, col, value): each band's local mean times the bands' mean ratio of value to local mean.

    Bands are stretched to 0 to 255 first; bands without a value above zero are left out.
    """
    ends = long.groupBy("band").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("hi > 0 and hi > lo")
    scaled = long.join(ends, "band").select("band", *CELL, ((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255).alias("v"))
    around = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in square(k)])
    moved = scaled.select("band", "row", "col", "v", F.explode(around).alias("o")).select("band", (F.col("row") - F.col("o.dr")).alias("row"), (F.col("col") - F.col("o.dc")).alias("col"), "o", "v")
    local = moved.groupBy("band", *CELL).agg(F.avg("v").alias("m"), F.max(F.when((F.col("o.dr") == 0) & (F.col("o.dc") == 0), F.col("v"))).alias("v")).where("v is not null")
    ratio = F.when(F.col("m") > 0, F.col("v") / F.col("m"))
    return local.withColumn("ratio", F.avg(ratio).over(Window.partitionBy(*CELL))).select("band", *CELL, (F.col("m") * F.coalesce("ratio", F.lit(0.0))).alias("value"))


_EIGHT = [o for o in square(3) if o != (0, 0)]


def terrain(wide: DataFrame, z: str, px: float, scale: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """(row, col, slope, aspect, hillshade, tri, tpi, roughness) after Horn, in degrees; cells without all eight neighbours are left out."""
    n = neighbourhood(wide, z, square(3)).na.drop()
    a, b, c, d, e, f, g, h, i = (F.col(f"n_{r}_{k}".replace("-", "m")) for r, k in square(3))
    gx = ((c + 2 * f + i) - (a + 2 * d + g)) / (8 * px * scale)
    gy = ((g + 2 * h + i) - (a + 2 * b + c)) / (8 * px * scale)
    steep = F.sqrt(gx * gx + gy * gy)
    turn = F.degrees(F.atan2(gy, -gx))
    aspect = F.when(steep == 0, -9999.0).when(90 - turn < 0, 450 - turn).when(90 - turn >= 360, turn * 0).otherwise(90 - turn)
    import math

    alt, az = math.radians(altitude), math.radians(azimuth)
    light = (math.sin(alt) - math.cos(alt) * (gy * F.lit(math.cos(az)) * F.lit(-1.0) + gx * F.lit(math.sin(az)))) / F.sqrt(1 + steep * steep)
    others = [a, b, c, d, f, g, h, i]
    total = sum(others[1:], others[0])
    diffs = [F.abs(x - e) for x in others]
    return n.select(
        *CELL,
        F.degrees(F.atan(steep)).alias("slope"),
        aspect.alias("aspect"),
        F.greatest(F.lit(0.0), 255 * light).alias("hillshade"),
        (sum(diffs[1:], diffs[0]) / 8).alias("tri"),
        (e - total / 8).alias("tpi"),
        (F.greatest(*others, e) - F.least(*others, e)).alias("roughness"),
    )


def latitude_scale(lat: Column) -> tuple[Column, Column]:
    """Metres in a degree of longitude, and the vertical exaggeration that makes up for it."""
    s = F.lit(111320.0) * F.cos(F.radians(lat))
    return s, 1 / s


def fill_nodata(wide: DataFrame, value: str, distance: int, nodata: float = 0.0) -> DataFrame:
    """Nodata cells from the valid cells within a distance, weighted by inverse distance; those without any stay."""
    offsets = [(r, c) for r, c in square(2 * distance + 1) if 0 < r * r + c * c <= distance * distance]
    around = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc"), F.lit(1.0 / (r * r + c * c) ** 0.5).alias("w")) for r, c in offsets])
    valid = wide.where(F.col(value) != nodata).select(*CELL, F.col(value).alias("v"), F.explode(around).alias("o"))
    sums = valid.groupBy((F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col")).agg((F.sum(F.col("v") * F.col("o.w")) / F.sum("o.w")).alias("_fill"))
    holes = wide.where(F.col(value) == nodata).join(sums, CELL, "left").withColumn(value, F.coalesce("_fill", value)).drop("_fill")
    return wide.where(F.col(value) != nodata).unionByName(holes)


def sobel(wide: DataFrame, value: str) -> DataFrame:
    """(row, col, gx, gy, magnitude) with the usual kernels over 4, of cells that have all eight neighbours."""
    n = neighbourhood(wide, value, square(3)).na.drop()
    a, b, c, d, _, f, g, h, i = (F.col(f"n_{r}_{k}".replace("-", "m")) for r, k in square(3))
    gx, gy = ((c + 2 * f + i) - (a + 2 * d + g)) / 4, ((g + 2 * h + i) - (a + 2 * b + c)) / 4
    return n.select(*CELL, gx.alias("gx"), gy.alias("gy"), F.sqrt((gx * gx + gy * gy) / 2).alias("magnitude"))


def non_maximum(wide: DataFrame, value: str, gx: str, gy: str) -> DataFrame:
    """(row, col, value): magnitudes that neither neighbour along the gradient's direction (of four) exceeds, else 0; cells at the edge are 0."""
    n = neighbourhood(wide, value, square(3)).join(wide.select(*CELL, gx, gy), CELL)
    angle = F.degrees(F.atan2(F.col(gy), F.col(gx)))
    angle = F.when(angle < 0, angle + 180).otherwise(angle)
    at = lambda r, c: F.col(f"n_{r}_{c}".replace("-", "m"))
    first = F.when((angle < 22.5) | (angle >= 157.5), at(0, 1)).when(angle < 67.5, at(1, -1)).when(angle < 112.5, at(1, 0)).otherwise(at(-1, -1))
    second = F.when((angle < 22.5) | (angle >= 157.5), at(0, -1)).when(angle < 67.5, at(-1, 1)).when(angle < 112.5, at(-1, 0)).otherwise(at(1, 1))
    return n.select(*CELL, F.when((at(0, 0) >= first) & (at(0, 0) >= second), at(0, 0)).otherwise(0.0).alias("value"))


def dilate(wide: DataFrame, value: str, offsets: list[tuple[int, int]]) -> DataFrame:
    return focal(wide, value, offsets, {value: F.max("v")})


def erode(wide: DataFrame, value: str, offsets: list[tuple[int, int]]) -> DataFrame:
    return focal(wide, value, offsets, {value: F.min("v")})


def close_gaps(wide: DataFrame, value: str) -> DataFrame:
    """Grey closing with a cross: dilation, then erosion."""
    return erode(dilate(wide, value, CROSS), value, CROSS)


def perimeter(wide: DataFrame, value: str) -> DataFrame:
    """Foreground cells with a background cell, or the raster's edge, beside them."""
    n = focal(wide.withColumn(value, (F.col(value) != 0).cast("int")), value, CROSS, {"own": F.max(F.when((F.col("dr") == 0) & (F.col("dc") == 0), F.col("v"))), "n": F.sum("v")})
    return n.where("own = 1 and n < 5").select(*CELL)


def gaussian(wide: DataFrame, value: str, sigma: float, truncate: float = 4.0) -> DataFrame:
    """Separable Gaussian smoothing; weights of absent cells are left out."""
    import math

    h = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-h, h + 1)]

    def one(df: DataFrame, axis: str) -> DataFrame:
        around = F.array(*[F.struct(F.lit(i).alias("d"), F.lit(w).alias("w")) for i, w in zip(range(-h, h + 1), weights)])
        moved = df.select(*CELL, F.col(value).alias("v"), F.explode(around).alias("o"))
        sums = moved.groupBy(*[(F.col(c) - F.col("o.d")).alias(c) if c == axis else F.col(c) for c in CELL]).agg((F.sum(F.col("v") * F.col("o.w")) / F.sum("o.w")).alias(value), F.count_if(F.col("o.d") == 0).alias("own"))
        return sums.where("own > 0").drop("own")

    return one(one(wide, "row"), "col")


def local_maxima(wide: DataFrame, value: str, distance: int) -> DataFrame:
    """Non-zero cells that no cell within a square distance exceeds."""
    top = focal(wide, value, square(2 * distance + 1), {"top": F.max("v"), "own": F.max(F.when((F.col("dr") == 0) & (F.col("dc") == 0), F.col("v")))})
    return top.where("own = top and own > 0").select(*CELL, F.col("own").alias("value"))


def nearest_distance(wide: DataFrame, value: str, radius: int, px: float = 1.0) -> DataFrame:
    """Euclidean distance to the nearest zero cell within a radius, in map units; null beyond it."""
    offsets = sorted((r * r + c * c, r, c) for r, c in square(2 * radius + 1) if r * r + c * c <= radius * radius)
    around = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc"), F.lit(d).alias("d")) for d, r, c in offsets])
    zeros = wide.where(F.col(value) == 0).select(*CELL, F.explode(around).alias("o"))
    near = zeros.groupBy((F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col")).agg(F.min("o.d").alias("d"))
    return wide.select(*CELL).join(near, CELL, "left").select(*CELL, (F.sqrt(F.col("d").cast("double")) * px).alias("distance"))
