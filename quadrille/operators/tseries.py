"""Series kept as date columns named <band>-YY-MM, one row a site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(wide: DataFrame, site: str, columns: list[str]) -> DataFrame:
    """(site, band, date, value): dates are month ends."""
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
    rows = wide.select(F.col(site).alias("site"), F.explode(pairs).alias("p")).select("site", "p.k", "p.value")
    part = F.split("k", "-")
    return rows.select("site", part[0].alias("band"), F.last_day(F.to_date(F.concat(F.lit("20"), part[1], F.lit("-"), part[2], F.lit("-01")))).alias("date"), "value")


def to_wide(long: DataFrame, names: list[str]) -> DataFrame:
    """Back to a column for each of names."""
    key = F.concat_ws("-", "band", F.date_format("date", "yy-MM"))
    return long.groupBy("site").agg(*[F.max(F.when(key == n, F.col("value"))).alias(n) for n in names])


def extract_by_date(wide: DataFrame, site: str, columns: list[str], start: str, end: str, band: str) -> DataFrame:
    """One band between two dates, both included, as date columns again."""
    months = [c for c in columns if c.startswith(band + "-") and start[2:7] <= c[len(band) + 1 :] <= end[2:7]]
    long = to_long(wide, site, [c for c in columns if c.startswith(band + "-")]).where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return to_wide(long, months)


def band_stats(long: DataFrame, by: str = "date") -> DataFrame:
    """Mean, median, least, greatest, and two deviations either side, of all sites on each date."""
    v = F.col("value")
    out = long.groupBy(by).agg(F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.stddev_pop(v).alias("sd"))
    return out.withColumns({"upper": F.col("mean") + 2 * F.col("sd"), "lower": F.col("mean") - 2 * F.col("sd")})


def stages(long: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows with the stage (stage, first, last) that their date falls in; a handful of spans."""
    return long.join(F.broadcast(spans), F.col("date").between(F.col("first"), F.col("last"))).drop("first", "last")
