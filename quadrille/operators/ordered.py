"""Running sums along an order, in two levels, so that no task sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of an order at most; there are as many as shuffle partitions.
MOST = 512


def buckets(df: DataFrame, order: str) -> Column:
    """A number that does not decrease along a numeric column and deals rows about evenly; nulls come first, NaN last."""
    n = max(1, min(MOST, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    x = F.col(order).cast("double")
    ends = df.select(F.percentile_approx(F.when(~F.isnan(x), x), [k / n for k in range(1, n)], F.lit(20 * n)).alias("e")).first().e if n > 1 else None
    ends = sorted(set(ends or []))
    if not ends:
        return F.lit(0)
    return F.when(x.isNull(), -1).otherwise(F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e < x)))


def running_sums(df: DataFrame, amounts: dict[str, Column], order: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """df with sums of amounts over the rows up to and with each, by order, whose first column is numeric.

    Each bucket's rows pass one window, and the buckets' sums another.
    """
    rows = df.withColumns({f"_a_{n}": a for n, a in amounts.items()}).withColumn("_b", buckets(df, order[0]))
    sums = rows.groupBy(*by, "_b").agg(*[F.sum(f"_a_{n}").alias(f"_s_{n}") for n in amounts])
    along = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    base = sums.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_b").alias("_k"), *[F.coalesce(F.sum(f"_s_{n}").over(along), F.lit(0)).alias(f"_z_{n}") for n in amounts])
    inside = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumns({f"_i_{n}": F.sum(f"_a_{n}").over(inside) for n in amounts})
    same = F.col("_b") == F.col("_k")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    out = within.join(base, same)
    return out.select(*df.columns, *[(F.col(f"_z_{n}") + F.col(f"_i_{n}")).alias(n) for n in amounts])
