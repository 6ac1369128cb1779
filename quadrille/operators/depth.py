"""Statistics through a stack, cell by cell, and over whole bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running_sums

CELL = ["row", "col"]


def depth_statistic(name: str, value: Column, q: float = 95) -> Column:
    """mean, std, median or perc (the q-th percentile, interpolated); NaN counts as absent."""
    v = F.when(~F.isnan(value), value)
    known = {"mean": F.avg(v), "std": F.stddev_pop(v), "median": F.median(v), "perc": F.percentile(v, q / 100)}
    if name not in known:
        raise ValueError(f"unknown statistic {name!r}")
    return known[name]


def temporal(long: DataFrame, stat: str, q: float = 95, by: list[str] = CELL) -> DataFrame:  # noqa: B006
    """A statistic of all values of a cell; absent layers of a sparse cube don't count."""
    return long.groupBy(*by).agg(depth_statistic(stat, F.col("value"), q).alias(stat))


def classes(long: DataFrame, by: str = "band") -> DataFrame:
    """The non-zero values of each raster, sorted, and how many different values it has, zero included."""
    return long.groupBy(by).agg(F.array_sort(F.collect_set(F.when(F.col("value") != 0, F.col("value")))).alias("classes"), F.countDistinct("value").alias("n"))


def band_stats(long: DataFrame) -> DataFrame:
    """(band, lo, hi, empty): empty bands have no value above zero."""
    return long.groupBy("band").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).withColumn("empty", F.col("hi") == 0)


def ecdf(wide: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Each different value with the share of cells up to it."""
    by = by or []
    counts = wide.groupBy(*by, value).agg(F.count("*").alias("_n"))
    summed = running_sums(counts, {"_upto": F.col("_n")}, [value], by)
    totals = wide.groupBy(*by).agg(F.count("*").alias("_all"))
    joined = summed.join(totals, by) if by else summed.crossJoin(F.broadcast(totals))  # one row
    return joined.select(*by, value, (F.col("_upto") / F.col("_all")).alias("q"))


def histogram_match(source: DataFrame, template: DataFrame, value: str = "value") -> DataFrame:
    """source with matched: its value's quantile read off the template's distribution, between values linearly.

    Both distributions are reduced to different values. Quantiles are looked up in buckets of equal width, and what
    a bucket lacks comes from the nearest bucket that has template values.
    """
    s, t = ecdf(source, value).withColumnRenamed(value, "sv"), ecdf(template, value).withColumnRenamed(value, "tv")
    both = s.select("q", "sv", F.lit(None).cast("double").alias("tv"), F.lit(1).alias("k")).unionByName(t.select("q", F.lit(None).cast("double").alias("sv"), "tv", F.lit(0).alias("k")))
    n = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.withColumn("_b", F.floor(F.col("q") * n).cast("int"))
    pair = F.when(F.col("tv").isNotNull(), F.struct("q", "tv"))
    ends = both.groupBy("_b").agg(F.min(pair).alias("_first"), F.max(pair).alias("_last"))
    along = Window.orderBy("_b")  # a row a bucket
    ends = ends.select("_b", F.max("_last").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.min("_first").over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    both = both.join(ends, "_b")
    w = Window.partitionBy("_b").orderBy("q", "k")
    below = F.coalesce(F.last(pair, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_before")
    # a template value at the same quantile stands before the source's, so it is found below
    above = F.coalesce(F.first(pair, True).over(w.rowsBetween(0, Window.unboundedFollowing)), "_after")
    found = both.select("sv", "q", below.alias("lo"), above.alias("hi")).where("sv is not null")
    lo, hi = F.col("lo"), F.col("hi")
    value_of = (
        F.when(lo.isNull(), hi["tv"]).when(hi.isNull() | (lo["q"] == F.col("q")), lo["tv"]).otherwise(lo["tv"] + (F.col("q") - lo["q"]) / F.greatest(hi["q"] - lo["q"], F.lit(1e-300)) * (hi["tv"] - lo["tv"]))
    )
    lut = found.select(F.col("sv").alias(value), value_of.alias("matched"))
    return source.join(lut, value)
