"""The data model: rasters as rows of pixels, layers as rows of features, and the grid that ties them together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))

RASTER_META = T.StructType(
    [T.StructField("raster_id", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("n_bands", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "px", "py")]
    + [T.StructField("srs", T.StringType()), T.StructField("dtype", T.StringType()), T.StructField("nodata", T.ArrayType(T.DoubleType())), T.StructField("band_names", T.ArrayType(T.StringType()))]
)
PIXELS = T.StructType([T.StructField("raster_id", T.StringType())] + [T.StructField(c, T.IntegerType()) for c in ("row", "col", "band")] + [T.StructField("value", T.DoubleType())])
TILES = T.StructType(
    [T.StructField("raster_id", T.StringType())]
    + [T.StructField(c, T.IntegerType()) for c in ("tile_row", "tile_col", "row_off", "col_off", "n_rows", "n_cols", "band")]
    + [T.StructField("data", T.ArrayType(T.DoubleType()))]
)
FEATURES = T.StructType(
    [T.StructField("fid", T.LongType()), T.StructField("geom_type", T.StringType()), T.StructField("rings", T.ArrayType(RING))] + [T.StructField(c, T.DoubleType()) for c in ("xmin", "ymin", "xmax", "ymax")]
)


@dataclass(frozen=True)
class Grid:
    """A north-up raster grid: origin at the upper left corner, pixel sizes, and extent in pixels."""

    x0: float = 1000.0
    y0: float = 5000.0
    px: float = 10.0
    py: float = -10.0
    width: int = 64
    height: int = 64

    def col_of(self, x: Column) -> Column:
        """Pixel column of a map x; truncates towards zero."""
        return ((x - F.lit(self.x0)) / F.lit(self.px)).cast("int")

    def row_of(self, y: Column) -> Column:
        return ((y - F.lit(self.y0)) / F.lit(self.py)).cast("int")

    def x_of(self, col: Column) -> Column:
        """Map x of a pixel's left edge."""
        return F.lit(self.x0) + col * F.lit(self.px)

    def y_of(self, row: Column) -> Column:
        return F.lit(self.y0) + row * F.lit(self.py)
