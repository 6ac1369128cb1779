"""Raster sources and sinks: tiles as Parquet, ESRI ASCII grids, and GeoJSON layers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.numeric import tile
from ..model import Grid


def tiled(pixels: DataFrame, size: int) -> DataFrame:
    """Long pixels to tiles: (raster_id, band, tile_row, tile_col, cells), cells a sorted array of place and value."""
    place = ((F.col("row") % size) * size + F.col("col") % size).alias("at")
    keyed = pixels.select("raster_id", "band", tile(F.col("row"), size).alias("tile_row"), tile(F.col("col"), size).alias("tile_col"), F.struct(place, "value").alias("cell"))
    return keyed.groupBy("raster_id", "band", "tile_row", "tile_col").agg(F.array_sort(F.collect_list("cell")).alias("cells")).withColumn("size", F.lit(size))


def write_tiles(pixels: DataFrame, grid: Grid, size: int = 256, path: str | None = None) -> str:
    """Parquet tiles partitioned by raster and band, so that bands and rasters prune. Without a path, in the shared folder."""
    from ..operators.components import shared_folder

    path = path or f"{shared_folder(pixels.sparkSession)}/tiles-{uuid.uuid4().hex}"
    tiled(pixels, size).write.mode("overwrite").partitionBy("raster_id", "band").parquet(path)
    return path


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """(raster_id, band, row, col, value) of tiles."""
    t = spark.read.parquet(path).select("raster_id", "band", "tile_row", "tile_col", "size", F.explode("cells").alias("c"))
    row = F.col("tile_row") * F.col("size") + F.expr("cast(c.at div size as int)")
    col = F.col("tile_col") * F.col("size") + F.col("c.at") % F.col("size")
    return t.select("raster_id", "band", row.cast("int").alias("row"), col.cast("int").alias("col"), "c.value")


class _Lines(InputPartition):
    def __init__(self, path: str):
        self.path = path


class AsciiGridReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]

    def partitions(self):
        return [_Lines(p) for p in self.paths]

    def read(self, partition):
        import pyarrow as pa

        head: dict[str, float] = {}
        with open(partition.path) as f:
            row = 0
            for line in f:
                parts = line.split()
                if parts and parts[0][0].isalpha():
                    head[parts[0].lower()] = float(parts[1])
                    continue
                nodata = head.get("nodata_value")
                values = [None if nodata is not None and float(v) == nodata else float(v) for v in parts]
                n = len(values)
                yield pa.RecordBatch.from_pydict(
                    {
                        "raster_id": pa.array([partition.path.rsplit("/", 1)[-1]] * n), "row": pa.array([row] * n, pa.int32()), "col": pa.array(range(n), pa.int32()),
                        "band": pa.array([1] * n, pa.int32()), "value": pa.array(values, pa.float64()),
                    }
                )
                row += 1


class AsciiGrid(DataSource):
    """format("ascii_grid"): ESRI ASCII grids, one task a file; path may name several, by commas. For files that every executor has."""

    @classmethod
    def name(cls):
        return "ascii_grid"

    def schema(self):
        return "raster_id string, row int, col int, band int, value double"

    def reader(self, schema):
        return AsciiGridReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AsciiGrid)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(fid, ring) of the first rings of a file of GeoJSON features, one a line."""
    shape = "struct<geometry:struct<type:string,coordinates:array<array<array<double>>>>,properties:struct<fid:bigint>>"
    rows = spark.read.text(path).select(F.from_json("value", shape).alias("f"))
    return rows.select(F.col("f.properties.fid").alias("fid"), F.transform(F.col("f.geometry.coordinates")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("ring"))
