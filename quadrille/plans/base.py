"""Registration of queries, and the virtual rasters, zones and points over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Grid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
GRID = Grid()

#: Virtual inputs in SQL; r and c are a pixel's row and column.
CTES = {
    "grid": "SELECT CAST(l_orderkey % 64 AS INT) AS r, CAST(l_partkey % 64 AS INT) AS c, sum(l_quantity) AS b1, CAST(count(*) AS DOUBLE) AS b2, CAST(max(l_linenumber) AS DOUBLE) AS b3, sum(l_quantity) % 4 AS b4 FROM lineitem GROUP BY 1, 2",
    "pix": "SELECT r, c, 1 AS band, b1 AS value FROM grid UNION ALL SELECT r, c, 2, b2 FROM grid UNION ALL SELECT r, c, 3, b3 FROM grid UNION ALL SELECT r, c, 4, b4 FROM grid",
    "cube": "SELECT CAST(l_orderkey % 64 AS INT) AS r, CAST(l_partkey % 64 AS INT) AS c, CAST(year(l_shipdate) AS INT) AS band, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3",
    "full": "SELECT CAST(i // 64 AS INT) AS r, CAST(i % 64 AS INT) AS c FROM (SELECT unnest(range(0, 4096)) AS i)",
    "dense": "SELECT full_.r, full_.c, coalesce(b1, 0.0) AS b1, coalesce(b2, 0.0) AS b2, coalesce(b3, 0.0) AS b3, coalesce(b4, 0.0) AS b4 FROM full_ LEFT JOIN grid ON full_.r = grid.r AND full_.c = grid.c",
    "zones": "SELECT s_suppkey AS fid, CAST(s_suppkey * 7 % 56 + CASE WHEN s_suppkey % 10 = 9 THEN 64 ELSE 0 END AS INT) AS c0, CAST(s_suppkey * 11 % 56 AS INT) AS r0, CAST(3 + s_suppkey % 6 AS INT) AS w, CAST(2 + s_nationkey % 5 AS INT) AS h, s_nationkey, s_acctbal, s_name FROM supplier",
    "zpix": "SELECT fid, r, c, w, h, r0, c0, b1, b2, b3, b4 FROM zones JOIN grid ON c >= c0 AND c < c0 + w AND r >= r0 AND r < r0 + h",
    "diamonds": "SELECT fid, c0 + w AS cx, r0 + h AS cy, w, h FROM zones",
    "points": "SELECT event_id AS pid, 1000 + (event_id * 37 % 6400) / 10.0 AS x, 5000 - (event_id * 53 % 6400) / 10.0 AS y, value, event_type FROM events",
    "emb": "SELECT vec_id, CAST(vec_id // 25 AS INT) AS r, CAST(vec_id % 25 AS INT) AS c, embedding AS e, label FROM embeddings",
}
CTES["full_"] = CTES.pop("full")
_NEEDS = {"pix": ["grid"], "dense": ["grid", "full_"], "zpix": ["grid", "zones"], "diamonds": ["zones"]}


def with_(*names: str) -> str:
    """A WITH clause of virtual inputs and what they need; a query may go on with its own after a comma."""
    order: list[str] = []

    def add(n: str) -> None:
        for x in _NEEDS.get(n, []):
            add(x)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in order) + " "


def query(name: str, sql: str | None = None):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def grid(spark: SparkSession, d: str) -> DataFrame:
    """Wide pixels (row, col, b1..b4); cells without line items are absent."""
    items = table(spark, d, "lineitem")
    sums = items.groupBy((F.col("l_orderkey") % 64).cast("int").alias("row"), (F.col("l_partkey") % 64).cast("int").alias("col")).agg(
        F.sum("l_quantity").alias("b1"), F.count("*").cast("double").alias("b2"), F.max("l_linenumber").cast("double").alias("b3")
    )
    return sums.withColumn("b4", F.col("b1") % 4)


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Long pixels (row, col, band, value) of grid."""
    from ..operators.algebra import to_long

    return to_long(grid(spark, d), ["b1", "b2", "b3", "b4"])


def dense(spark: SparkSession, d: str) -> DataFrame:
    """grid with absent cells as zeros."""
    from ..operators.tiles import densify

    return densify(grid(spark, d), GRID, ["b1", "b2", "b3", "b4"])


def cube(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem")
    return items.groupBy((F.col("l_orderkey") % 64).cast("int").alias("row"), (F.col("l_partkey") % 64).cast("int").alias("col"), F.year("l_shipdate").cast("int").alias("band")).agg(F.sum("l_quantity").alias("value"))


def emb(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.expr("cast(vec_id div 25 as int)").alias("row"), (F.col("vec_id") % 25).cast("int").alias("col"), F.col("embedding").cast("array<double>").alias("e"), "label")


def zones(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles (fid, c0, r0, w, h) in pixels; every tenth lies outside the raster."""
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    return s.select(
        k.alias("fid"), (k * 7 % 56 + F.when(k % 10 == 9, 64).otherwise(0)).cast("int").alias("c0"), (k * 11 % 56).cast("int").alias("r0"), (3 + k % 6).cast("int").alias("w"), (2 + F.col("s_nationkey") % 5).cast("int").alias("h"),
        "s_nationkey", "s_acctbal", "s_name",
    )


def diamonds(spark: SparkSession, d: str) -> DataFrame:
    return zones(spark, d).select("fid", (F.col("c0") + F.col("w")).alias("cx"), (F.col("r0") + F.col("h")).alias("cy"), "w", "h")


def rectangles(spark: SparkSession, d: str) -> DataFrame:
    """zones as features: (fid, ring, xmin, ymin, xmax, ymax) in map units."""
    from ..operators.geometry import rectangle

    z = zones(spark, d)
    x, y = GRID.x_of(F.col("c0")), GRID.y_of(F.col("r0"))
    x1, y1 = GRID.x_of(F.col("c0") + F.col("w")), GRID.y_of(F.col("r0") + F.col("h"))
    return z.select("fid", rectangle(x, y1, x1, y).alias("ring"), x.alias("xmin"), y1.alias("ymin"), x1.alias("xmax"), y.alias("ymax"))


def diamond_rings(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.geometry import ring

    z, cx, cy, w, h = diamonds(spark, d), *(F.col(c).cast("double") for c in ("cx", "cy", "w", "h"))
    return z.select("fid", "w", "h", "cx", "cy", ring((cx - w, cy), (cx, cy + h), (cx + w, cy), (cx, cy - h)).alias("ring"))


def points(spark: SparkSession, d: str) -> DataFrame:
    e, k = table(spark, d, "events"), F.col("event_id")
    return e.select(k.alias("pid"), (1000 + (k * 37 % 6400) / F.lit(10.0)).alias("x"), (5000 - (k * 53 % 6400) / F.lit(10.0)).alias("y"), "value", "event_type")
