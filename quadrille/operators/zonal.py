"""Zonal statistics: which pixels lie in which zones, and what they say together.

Zones are joined by tile keys: each zone names the tiles that its bounding box
touches, each pixel lies in one tile, so the join is an equi-join that Spark can broadcast or shuffle, and
the exact predicate only sees candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import divide, tile

#: Tile edge in pixels, of the scale of a zone.
TILE = 16


def in_box() -> Column:
    return (F.col("col") >= F.col("c0")) & (F.col("col") < F.col("c0") + F.col("w")) & (F.col("row") >= F.col("r0")) & (F.col("row") < F.col("r0") + F.col("h"))


def join_zones(pixels: DataFrame, zones: DataFrame, inside: Column | None = None, size: int = TILE) -> DataFrame:
    """Each pixel with each zone (c0, r0, w, h in pixels) whose box holds it and for which inside is true."""
    last_c, last_r = F.col("c0") + F.col("w") - 1, F.col("r0") + F.col("h") - 1
    keyed = zones.withColumn("_tc", F.explode(F.sequence(tile(F.col("c0"), size), tile(last_c, size)))).withColumn("_tr", F.explode(F.sequence(tile(F.col("r0"), size), tile(last_r, size))))
    mine = pixels.withColumns({"_tc": tile(F.col("col"), size), "_tr": tile(F.col("row"), size)})
    return mine.join(keyed, ["_tc", "_tr"]).where(in_box() if inside is None else in_box() & inside).drop("_tc", "_tr")


def statistic(name: str, value: Column) -> Column:
    """The aggregate of a statistic's name; nodata is null here. median, skew and kurt leave zeros out."""
    nonzero = F.when(value != 0, value)
    known = {
        "mean": lambda: F.avg(value), "min": lambda: F.min(value), "max": lambda: F.max(value), "sum": lambda: F.sum(value), "count": lambda: F.count(value),
        "median": lambda: F.median(nonzero), "std": lambda: F.stddev_pop(value), "var": lambda: F.var_pop(value), "mode": lambda: F.mode(value, True),
        "skew": lambda: F.skewness(nonzero), "kurt": lambda: F.kurtosis(nonzero), "kurtosis": lambda: F.kurtosis(nonzero),
    }
    if name not in known:
        raise ValueError(f"unknown statistic {name!r}")
    return known[name]()


def zonal_stats(pixels: DataFrame, zones: DataFrame, value: str, stats: list[str], nodata: float | None = 0.0, inside: Column | None = None, expression: str | None = None) -> DataFrame:
    """One row (fid, a column for each statistic) for each zone that has a pixel; nodata pixels don't count."""
    zones = zones.where(expression) if expression else zones
    joined = join_zones(pixels, zones.select("fid", "c0", "r0", "w", "h"), inside)
    seen = joined if nodata is None else joined.where(F.col(value) != nodata)
    return seen.groupBy("fid").agg(*[statistic(s, F.col(value)).alias(s) for s in stats])


def zonal_all(pixels: DataFrame, zones: DataFrame, bands: list[str], stats: list[str], nodata: float | None = 0.0) -> DataFrame:
    """Every statistic of every band in one pass: columns <band>_<statistic>."""
    joined = join_zones(pixels, zones.select("fid", "c0", "r0", "w", "h"))
    col = lambda b: F.col(b) if nodata is None else F.when(F.col(b) != nodata, F.col(b))
    return joined.groupBy("fid").agg(*[statistic(s, col(b)).alias(f"{b}_{s}") for b in bands for s in stats])


def zonal_fractions(pixels: DataFrame, zones: DataFrame, value: str) -> DataFrame:
    """(fid, classes, counts): sorted classes of each zone and their counts; nodata is a class."""
    counts = join_zones(pixels, zones.select("fid", "c0", "r0", "w", "h")).groupBy("fid", value).count()
    pairs = counts.groupBy("fid").agg(F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), F.col("count").alias("n")))).alias("p"))
    return pairs.select("fid", F.col("p.v").alias("classes"), F.col("p.n").alias("counts"))


def coverage_percent(pixels: DataFrame, zones: DataFrame, value: str, inside: Column) -> DataFrame:
    """Non-zero pixels of the bounding window over the zone's pixels: 0 without any, at most 1, rounded to 2 places."""
    joined = join_zones(pixels, zones)
    hit, area = F.count_if(F.col(value) != 0), F.count_if(inside)
    return joined.groupBy("fid").agg(F.when(hit == 0, 0.0).when(hit > area, 1.0).otherwise(F.round(hit / area, 2)).alias("perc"))


def volume(pixels: DataFrame, zones: DataFrame, value: str, px: float) -> DataFrame:
    """Sum of values times pixel area over the bounding window."""
    return join_zones(pixels, zones.select("fid", "c0", "r0", "w", "h")).groupBy("fid").agg((F.sum(value) * px * px).alias("vol"))


def single_pixel(pixels: DataFrame, zones: DataFrame, value: str, stat: str) -> DataFrame:
    """A statistic, but the raw value (nodata too) of a window of one pixel."""
    joined = join_zones(pixels, zones.select("fid", "c0", "r0", "w", "h"))
    usual = statistic(stat, F.when(F.col(value) != 0, F.col(value)))
    return joined.groupBy("fid").agg(F.when(F.max(F.col("w") * F.col("h")) == 1, F.max(value)).otherwise(usual).alias(stat))


def rgb_indices(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Colour indices on chromatic coordinates; null where a divisor is zero."""
    total = r + g + b
    r, g, b = divide(r, total), divide(g, total), divide(b, total)
    return {
        "ExG": 2 * g - (r - b), "ExR": 1.4 * r - g, "ExGR": 2 * g - (r - b) - (1.4 * r - g), "CIVE": 0.441 * r - 0.811 * g + 0.385 * b + 18.78745, "NDI": divide(g - r, g + r),
        "RGBVI": divide((g * g - b) * r, (g * g + b) * r), "VARI": divide(g - r, g + r) - b, "ARI": divide(F.lit(1.0), g * r), "RGBI": divide(r, g),
        "GLI": divide((g - r) + (g - b), 2 * g) + r + b, "TGL": (g - 0.39) * (r - 0.61) * b,
    }


def zonal_rgb(pixels: DataFrame, zones: DataFrame, r: str, g: str, b: str) -> DataFrame:
    joined = join_zones(pixels, zones.select("fid", "c0", "r0", "w", "h"))
    return joined.groupBy("fid").agg(*[F.avg(e).alias(n) for n, e in rgb_indices(F.col(r), F.col(g), F.col(b)).items()])


def entropy(pixels: DataFrame, zones: DataFrame, value: str, nodata: float = 0.0) -> DataFrame:
    """Base 2 entropy of each zone's values, nodata left out."""
    counts = join_zones(pixels, zones.select("fid", "c0", "r0", "w", "h")).where(F.col(value) != nodata).groupBy("fid", value).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("fid"))
    return counts.withColumn("p", share).groupBy("fid").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def cooccurrence(pixels: DataFrame, zones: DataFrame, value: str, offset: int, angle: int) -> DataFrame:
    """(fid, i, j, p): symmetric, normalised co-occurrence of grey levels in each zone's window at an offset along 0, 45, 90 or 135 degrees."""
    dr, dc = {0: (0, 1), 45: (-1, 1), 90: (-1, 0), 135: (-1, -1)}[angle]
    cells = join_zones(pixels, zones.select("fid", "c0", "r0", "w", "h")).select("fid", "row", "col", F.col(value).alias("i"))
    other = cells.select("fid", (F.col("row") - dr * offset).alias("row"), (F.col("col") - dc * offset).alias("col"), F.col("i").alias("j"))
    pairs = cells.join(other, ["fid", "row", "col"]).select("fid", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("p"))
    counts = pairs.groupBy("fid", "p.i", "p.j").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("fid"))).drop("n")


def texture(glcm: DataFrame, prop: str) -> DataFrame:
    """A property of each zone's co-occurrence table."""
    d = F.col("i") - F.col("j")
    sums = {
        "contrast": F.sum(F.col("p") * d * d), "dissimilarity": F.sum(F.col("p") * F.abs(d)), "homogeneity": F.sum(F.col("p") / (1 + d * d)),
        "asm": F.sum(F.col("p") * F.col("p")), "energy": F.sqrt(F.sum(F.col("p") * F.col("p"))),
    }
    if prop in sums:
        return glcm.groupBy("fid").agg(sums[prop].alias(prop))
    if prop != "correlation":
        raise ValueError(f"unknown texture property {prop!r}")
    i, j, p = F.col("i"), F.col("j"), F.col("p")
    moments = glcm.groupBy("fid").agg(F.sum(p * i).alias("mi"), F.sum(p * j).alias("mj"), F.sum(p * i * i).alias("ii"), F.sum(p * j * j).alias("jj"), F.sum(p * i * j).alias("ij"))
    vi, vj = F.col("ii") - F.col("mi") * F.col("mi"), F.col("jj") - F.col("mj") * F.col("mj")
    flat = (vi < 1e-12) | (vj < 1e-12)
    return moments.select("fid", F.when(flat, 1.0).otherwise((F.col("ij") - F.col("mi") * F.col("mj")) / F.sqrt(F.greatest(vi * vj, F.lit(1e-24)))).alias("correlation"))
