"""Accuracy of predictions, as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import divide, sigmoid
from .ordered import running_sums


def regression(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Explained variance, r2, mean and median absolute error, mean squared error and its root, in one row."""
    e = F.col(truth) - F.col(pred)
    row = df.agg(F.var_pop(e).alias("ve"), F.var_pop(truth).alias("vt"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.median(F.abs(e)).alias("medae"))
    return row.select((1 - divide(F.col("ve"), F.col("vt"))).alias("explained"), (1 - divide(F.col("mse"), F.col("vt"))).alias("r2"), "mae", "mse", "medae", F.sqrt("mse").alias("rmse"))


def rmse(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.sqrt(F.avg(F.pow(F.col(a) - F.col(b), 2))).alias("rmse"))


def class_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Precision, recall and F1 of each class, and their plain and support-weighted means ('macro avg', 'weighted avg'). One shuffle of class pairs."""
    pairs = df.groupBy(F.col(truth).cast("string").alias("t"), F.col(pred).cast("string").alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.col("n").alias("s"), F.lit(0).cast("long").alias("g")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("s"), F.col("n").alias("g")))).alias("x"), "t", "p", "n")
    per = sides.groupBy("x.c").agg(F.sum("x.s").alias("support"), F.sum("x.g").alias("guessed"), F.sum(F.when((F.col("t") == F.col("p")) & (F.col("x.s") > 0), F.col("n")).otherwise(0)).alias("hits"))
    p, r = F.coalesce(divide(F.col("hits"), F.col("guessed")), F.lit(0.0)), F.coalesce(divide(F.col("hits"), F.col("support")), F.lit(0.0))
    rows = per.select(F.col("c").alias("class"), p.alias("precision"), r.alias("recall"), "support").withColumn("f1", F.coalesce(divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    seen = rows.where("support > 0")
    mean = seen.agg(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    heavy = seen.agg(F.lit("weighted avg").alias("class"), *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")])
    return rows.select("class", "precision", "recall", "f1").unionByName(mean).unionByName(heavy)


def confusion(df: DataFrame, truth: str, pred: str, labels: list) -> DataFrame:
    """Rows are truth, a column p_<label> for each prediction."""
    return df.groupBy(F.col(truth).alias("truth")).agg(*[F.count_if(F.col(pred) == x).alias(f"p_{x}") for x in labels])


def accuracy(df: DataFrame, logit: str, target: str) -> DataFrame:
    hit = (sigmoid(F.col(logit)) >= 0.5).cast("int") == F.col(target)
    return df.agg(F.avg(hit.cast("double")).alias("accuracy"))


def running_mean(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """df with running: the mean of value over the rows of by up to each, along an order whose first column is numeric."""
    sums = running_sums(df, {"_total": F.coalesce(F.col(value).cast("double"), F.lit(0.0)), "_count": F.col(value).isNotNull().cast("long")}, order, [by])
    return sums.withColumn("running", F.when(F.col("_count") > 0, F.col("_total") / F.col("_count"))).drop("_total", "_count")


def multi_loss(df: DataFrame, outputs: list[str], target: str, weight: float = 0.0, class_weights: list[float] | None = None, eps: float = 1e-15) -> DataFrame:
    """(1 - weight) times the mean negative log likelihood, less weight times the log of each class's soft Jaccard index. outputs are log probabilities by class."""
    t, own = F.col(target), F.lit(None).cast("double")
    heavy = F.lit(None).cast("double")
    for k, c in enumerate(outputs):
        own, heavy = F.when(t == k, F.col(c)).otherwise(own), F.when(t == k, F.lit(float((class_weights or [1.0] * len(outputs))[k]))).otherwise(heavy)
    loss = -(1 - weight) * F.sum(heavy * own) / F.sum(heavy)
    for k, c in enumerate(outputs if weight else []):
        p, hit = F.exp(c), (t == k).cast("double")
        both, total = F.sum(p * hit), F.sum(p) + F.sum(hit)
        loss = loss - weight * F.log((both + eps) / (total - both + eps))
    return df.agg(loss.alias("loss"))


def binary_loss(df: DataFrame, logit: str, target: str, weight: float = 0.3, eps: float = 1e-15) -> DataFrame:
    """(1 - weight) times cross entropy, less weight times the log of the soft Jaccard index."""
    p, t = sigmoid(F.col(logit)), F.col(target).cast("double")
    x = F.col(logit)
    bce = F.avg(F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x))))
    both, total = F.sum(p * t), F.sum(p) + F.sum(t)
    return df.agg(((1 - weight) * bce - weight * F.log((both + eps) / (total - both + eps))).alias("loss"))
