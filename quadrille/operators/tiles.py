"""Grids, tiles, chips and mosaics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import tile
from ..model import Grid

CELL = ["row", "col"]


def empty_grid(spark, grid: Grid) -> DataFrame:
    """Every cell of a grid, made on the executors."""
    cells = spark.range(grid.width * grid.height)
    return cells.select(F.expr(f"cast(id div {grid.width} as int)").alias("row"), F.expr(f"cast(id % {grid.width} as int)").alias("col"))


def densify(wide: DataFrame, grid: Grid, bands: list[str], fill: float = 0.0) -> DataFrame:
    return empty_grid(wide.sparkSession, grid).join(wide, CELL, "left").fillna(fill, bands)


def window(wide: DataFrame, row_off: int, col_off: int, n_rows: int, n_cols: int) -> DataFrame:
    return wide.where(F.col("row").between(row_off, row_off + n_rows - 1) & F.col("col").between(col_off, col_off + n_cols - 1))


def with_tiles(wide: DataFrame, size: int) -> DataFrame:
    return wide.withColumns({"tile_row": tile(F.col("row"), size), "tile_col": tile(F.col("col"), size)})


def tile_origin(wide: DataFrame, grid: Grid, size: int) -> DataFrame:
    """Each tile's map origin and extent in pixels; edge tiles are smaller."""
    t = with_tiles(wide, size).select("tile_row", "tile_col").distinct()
    row, col = F.col("tile_row") * size, F.col("tile_col") * size
    return t.select("tile_row", "tile_col", grid.x_of(col).alias("x"), grid.y_of(row).alias("y"), F.least(F.lit(size), grid.height - row).alias("n_rows"), F.least(F.lit(size), grid.width - col).alias("n_cols"))


def retile(wide: DataFrame, grid: Grid, size: int, overlap: int) -> DataFrame:
    """Pixels with every tile they belong to, when tiles reach overlap pixels into their right and lower neighbours."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be less than the tile size")

    def keys(x: str) -> Column:
        first = F.greatest(F.lit(0), F.ceil((F.col(x) - size + 1) / F.lit(step))).cast("int")
        return F.sequence(first, tile(F.col(x), step))

    rows = wide.withColumn("tile_row", F.explode(keys("row")))
    return rows.withColumn("tile_col", F.explode(keys("col"))).where((F.col("tile_row") * step < grid.height) & (F.col("tile_col") * step < grid.width))


def chip_summary(wide: DataFrame, value: str, size: int) -> DataFrame:
    """Each tile's greatest value, non-zero cells and cells."""
    return with_tiles(wide, size).groupBy("tile_row", "tile_col").agg(F.max(value).alias("top"), F.count_if(F.col(value) != 0).alias("nonzero"), F.count("*").alias("cells"))


def chip_name(base: str, tile_row: Column, tile_col: Column) -> Column:
    return F.concat(F.lit(base), tile_row.cast("string"), tile_col.cast("string"))


def pad(wide: DataFrame, grid: Grid, size: int, value: str, fill: float = 0.0) -> DataFrame:
    """Pixels of whole tiles: those that edge tiles lack are filled."""
    whole = Grid(grid.x0, grid.y0, grid.px, grid.py, -(-grid.width // size) * size, -(-grid.height // size) * size)
    return with_tiles(densify(wide.select(*CELL, value), whole, [value], fill), size)


def d4(row: Column, col: Column, n: int, which: int) -> tuple[Column, Column]:
    """Where a pixel of an n by n tile goes under one of the eight symmetries of the square: quarter turns, mirrored from 4 on."""
    last = n - 1
    if which >= 4:
        col = last - col
    for _ in range(which % 4):
        row, col = last - col, row
    return row, col


# --- mosaics ---


def stack(rasters: list[DataFrame]) -> DataFrame:
    """Long rasters one upon another: each one's bands follow those of the one before it. Band counts are read first."""
    out, base = None, 0
    for r in rasters:
        n = r.agg(F.max("band")).first()[0] or 0
        moved = r.withColumn("band", F.col("band") + base)
        out, base = moved if out is None else out.unionByName(moved), base + n
    return out


def mosaic(pixels: DataFrame, order: str, keep: list[str] = ["band", *CELL], nodata: float | None = None) -> DataFrame:  # noqa: B006
    """The value of the last raster, by order, of each cell; nodata never covers a value."""
    use = pixels if nodata is None else pixels.where(F.col("value") != nodata)
    return use.groupBy(*keep).agg(F.max_by("value", order).alias("value"))


def resample_mean(long: DataFrame, factor: int) -> DataFrame:
    """Blocks of factor by factor cells to one, by their mean."""
    return long.groupBy("band", tile(F.col("row"), factor).alias("row"), tile(F.col("col"), factor).alias("col")).agg(F.avg("value").alias("value"))


def resample_nearest(long: DataFrame, factor: int) -> DataFrame:
    """Blocks of factor by factor cells to the one nearest their centre: the lower right of the four around it."""
    half = factor // 2
    return long.where((F.col("row") % factor == half) & (F.col("col") % factor == half)).select("band", tile(F.col("row"), factor).alias("row"), tile(F.col("col"), factor).alias("col"), "value")


def sequential(df: DataFrame, group: Column, by: list[str], name: str, first: int = 0) -> DataFrame:
    """Gapless ids in the order of by, in two levels: within each group, and over the groups' counts.

    group must not decrease along by; only its counts pass a single window.
    """
    grouped = df.withColumn("_g", group)
    counts = grouped.groupBy("_g").agg(F.count("*").alias("_c"))
    base = counts.select("_g", (F.sum("_c").over(Window.orderBy("_g")) - F.col("_c")).alias("_base"))
    nth = F.row_number().over(Window.partitionBy("_g").orderBy(*by))
    return grouped.withColumn("_n", nth).join(base, "_g").withColumn(name, (F.col("_base") + F.col("_n") - 1 + first).cast("long")).drop("_g", "_n", "_base")
