"""Map algebra: per-pixel expressions, masks, indices and recodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import divide, ieee_divide, tile

CELL = ["row", "col"]


def to_long(wide: DataFrame, bands: list[str], keep: list[str] = CELL) -> DataFrame:
    """Wide pixels to (keep, band, value); bands count from 1."""
    pairs = F.array(*[F.struct(F.lit(i).alias("band"), F.col(b).cast("double").alias("value")) for i, b in enumerate(bands, 1)])
    return wide.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.band", "p.value")


def to_wide(long: DataFrame, bands: list[int], keep: list[str] = CELL) -> DataFrame:
    """Long pixels to columns b<band>; one shuffle, no pivot job."""
    return long.groupBy(*keep).agg(*[F.max(F.when(F.col("band") == b, F.col("value"))).alias(f"b{b}") for b in bands])


def normalised_difference(a: Column, b: Column, ieee: bool = False) -> Column:
    """(a - b) / (a + b); where the sum is zero null, or the IEEE value."""
    return (ieee_divide if ieee else divide)(a - b, a + b)


def ndvi(wide: DataFrame, red: str, nir: str, name: str = "ndvi", ieee: bool = True) -> DataFrame:
    return wide.withColumn(name, normalised_difference(F.col(nir), F.col(red), ieee))


def chromatic(wide: DataFrame, r: str, g: str, b: str, legacy: bool = False) -> DataFrame:
    """Chromatic coordinates times 10000. legacy overwrites in turn, so green uses the new red and so on."""
    if not legacy:
        total = F.col(r) + F.col(g) + F.col(b)
        return wide.withColumns({r: divide(F.col(r), total) * 10000, g: divide(F.col(g), total) * 10000, b: divide(F.col(b), total) * 10000})
    for band in (r, b, g):
        wide = wide.withColumn(band, divide(F.col(band), F.col(r) + F.col(g) + F.col(b)) * 10000)
    return wide


def keep_value(value: Column, wanted: float) -> Column:
    return F.when(value == wanted, value).otherwise(0.0)


def mask_by_raster(long: DataFrame, mask: DataFrame, wanted: float) -> DataFrame:
    """Zero wherever mask (row, col, m) isn't wanted, in all bands; cells that mask lacks count as unwanted."""
    return long.join(mask, CELL, "left").withColumn("value", F.when(F.col("m") == wanted, F.col("value")).otherwise(0.0)).drop("m")


def mask_rule(value: Column, wanted: float, rule: str, out: float | None = None) -> Column:
    """'==' zeroes other values, '<' those below, '>' those above; wanted itself then becomes out, if given."""
    tests = {"==": value != wanted, "<": value < wanted, ">": value > wanted}
    if rule not in tests:
        raise ValueError(f"rule must be one of {sorted(tests)}")
    kept = F.when(tests[rule], 0.0).otherwise(value)
    return kept if out is None else F.when(kept == wanted, F.lit(float(out))).otherwise(kept)


def mask_blocks(wide: DataFrame, value: str, mask: str, wanted: float, size: int, rule: str = "==") -> DataFrame:
    """A block whose mask lacks wanted becomes zero; elsewhere the rule applies."""
    by = Window.partitionBy(tile(F.col("row"), size), tile(F.col("col"), size))
    has = F.max((F.col(mask) == wanted).cast("int")).over(by)
    return wide.withColumn(value, F.when(has == 1, mask_rule(F.col(value), wanted, rule)).otherwise(0.0))


def fill_blocks(wide: DataFrame, value: str, size: int) -> DataFrame:
    """Every block that holds a non-zero pixel becomes ones."""
    by = Window.partitionBy(tile(F.col("row"), size), tile(F.col("col"), size))
    return wide.withColumn(value, F.when(F.max(F.abs(F.col(value))).over(by) > 0, 1.0).otherwise(0.0))


def recode_scene(classes: DataFrame, scene: DataFrame) -> DataFrame:
    """Classes (row, col, scl) and scene (row, col, scene): above 6 is 2; then 6, or scene 4, is 3."""
    s = F.when(F.col("scl") > 6, 2.0).otherwise(F.col("scl"))
    return classes.join(scene, CELL).select(*CELL, F.when((F.col("scl") == 6) | (F.col("scene") == 4), 3.0).otherwise(s).alias("value"))


def lookup(value: Column, table: list[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(x)) for x in table]), value.cast("int") + 1)


def normalise(value: Column, mean: Column, std: Column, most: float = 255.0) -> Column:
    return (value - mean * most) / (std * most)


def unique_claims(claims: DataFrame) -> DataFrame:
    """Cells that one claimant alone has, of (row, col, id)."""
    return claims.withColumn("n", F.count("*").over(Window.partitionBy(*CELL))).where("n = 1").drop("n")


def class_of_planes(planes: DataFrame) -> DataFrame:
    """(row, col, plane, value) of one-hot planes to a class for each cell; the later plane wins, no plane is 0."""
    return planes.groupBy(*CELL).agg(F.coalesce(F.max(F.when(F.col("value") == 1, F.col("plane"))), F.lit(0)).alias("class"))


def rescale(long: DataFrame, top: float = 255.0) -> DataFrame:
    """Each band stretched from its least and greatest value to 0 and top; a flat band is 0."""
    ends = long.groupBy("band").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * top).otherwise(0.0)
    return long.join(ends, "band").withColumn("value", scaled).drop("lo", "hi")


def color_ramp(wide: DataFrame, value: str, stops: list[tuple[int, int, int]]) -> DataFrame:
    """red, green and blue by linear interpolation between stops spread evenly from the least to the greatest value."""
    ends = wide.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))  # one row
    at = F.when(F.col("hi") > F.col("lo"), (F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0) * (len(stops) - 1)
    i = F.least(F.floor(at), F.lit(len(stops) - 2)).cast("int")
    out = wide.crossJoin(F.broadcast(ends)).withColumns({"_i": i, "_f": at - i})
    for k, name in enumerate(("red", "green", "blue")):
        table = F.array(*[F.lit(float(s[k])) for s in stops])
        out = out.withColumn(name, F.round(F.element_at(table, F.col("_i") + 1) * (1 - F.col("_f")) + F.element_at(table, F.col("_i") + 2) * F.col("_f"), 6))
    return out.drop("_i", "_f", "lo", "hi")
