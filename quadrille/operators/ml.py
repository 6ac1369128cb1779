"""Training sets, scaling, folds, models and prediction, on pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import MaxAbsScaler, MinMaxScaler, Normalizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite
from .ordered import running_sums
from .zonal import join_zones

# --- training sets ---


def training_pixels(pixels: DataFrame, zones: DataFrame, label: str, bands: list[str], legacy: bool = False) -> DataFrame:
    """(label, bands) of each pixel of each zone; legacy takes the whole bounding window, as rectangles do anyway."""
    inside = None if legacy or "inside" not in zones.columns else F.col("inside")
    return join_zones(pixels, zones, inside).select(F.col(label).cast("double").alias("label"), *bands)


def clean(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Rows of a class other than 0 whose features are all finite."""
    good = F.col(label) != 0
    for f in features:
        good &= finite(F.col(f).cast("double"))
    return df.where(good)


def group_fold(key: Column, k: int) -> Column:
    """A fold from 0 to k - 1 that depends on the group alone."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(k)).cast("int")


def stratified_fold(df: DataFrame, label: str, order: list[str], k: int, name: str = "fold") -> DataFrame:
    """Folds dealt in turn within each class, along an order whose first column is numeric."""
    placed = running_sums(df, {"_place": F.lit(1)}, order, [label])
    return placed.withColumn(name, ((F.col("_place") - 1) % k).cast("int")).drop("_place")


def split(key: Column, test: float, validation: float) -> Column:
    """'test', 'val' or 'train', by a multiplicative hash of an integer key; validation is a share of what isn't test."""
    u = F.pmod(F.pmod(key.cast("long"), F.lit(1 << 31)) * F.lit(2654435761), F.lit(1 << 32)) / F.lit(4294967296.0)
    return F.when(u < test, "test").when(u < test + (1 - test) * validation, "val").otherwise("train")


# --- scaling, on columns ---


def scaled(df: DataFrame, features: list[str], kind: str) -> DataFrame:
    """Columns standardised, stretched to 0 and 1, or divided by their greatest absolute value; constants become 0."""
    if kind == "l2":
        norm = F.sqrt(sum((F.col(f) * F.col(f) for f in features[1:]), F.col(features[0]) * F.col(features[0])))
        return df.withColumn("_n", norm).withColumns({f: F.when(F.col("_n") > 0, F.col(f) / F.col("_n")).otherwise(0.0) for f in features}).drop("_n")
    if kind == "quantile":
        total = df.count()
        for f in features:
            counts = df.groupBy(f).agg(F.count("*").alias("_n"))
            below = running_sums(counts, {"_upto": F.col("_n")}, [f]).select(F.col(f).alias("_v"), ((F.col("_upto") - F.col("_n")) / max(1, total - 1)).alias("_r"))
            others = [c for c in df.columns if c != f]
            df = df.join(below, F.col(f).eqNullSafe(F.col("_v"))).select(*others, F.col("_r").alias(f)).select(*df.columns)
        return df
    known = {"standard": lambda f: (F.avg(f), F.stddev_pop(f)), "minmax": lambda f: (F.min(f), F.max(f) - F.min(f)), "maxabs": lambda f: (F.lit(0.0), F.max(F.abs(f)))}
    if kind not in known:
        raise ValueError(f"unknown scaler {kind!r}")
    ends = df.agg(*[e.alias(f"_{n}_{f}") for f in features for n, e in zip("ab", known[kind](f))])  # one row
    out = df.crossJoin(F.broadcast(ends))
    return out.withColumns({f: F.when(F.col(f"_b_{f}") > 0, (F.col(f) - F.col(f"_a_{f}")) / F.col(f"_b_{f}")).otherwise(0.0) for f in features}).drop(*ends.columns)


# --- models ---

CLASSIFIERS = {
    "rf": lambda seed: RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed),
    "logit": lambda seed: LogisticRegression(maxIter=30),
    "gb": lambda seed: OneVsRest(classifier=GBTClassifier(maxIter=5, seed=seed)),
    "linsvc": lambda seed: OneVsRest(classifier=LinearSVC(maxIter=20)),
    "mlp": lambda seed: MultilayerPerceptronClassifier(seed=seed),
}
REGRESSORS = {"rf": lambda seed: RandomForestRegressor(numTrees=20, seed=seed), "gb": lambda seed: GBTRegressor(maxIter=10, seed=seed), "linear": lambda seed: LinearRegression()}
#: Kinds that pyspark.ml has no learner for, and the one nearest to each.
NEAREST = {"erf": "rf", "xgb": "gb", "lgbm": "gb", "hgb": "gb", "svm": "linsvc", "nusvc": "linsvc"}
#: Rows of a training set in a task, about. Learners keep a task's rows in memory; a forest of 20 trees on 3 features takes some 200 bytes for each.
TASK_ROWS = 1 << 17
SCALERS = {"standard": StandardScaler, "minmax": MinMaxScaler, "l2": Normalizer, "maxabs": MaxAbsScaler}


def pipeline(features: list[str], kind: str = "rf", scaler: str | None = None, regression: bool = False, seed: int = 0) -> Pipeline:
    models = REGRESSORS if regression else CLASSIFIERS
    if kind in NEAREST:
        raise ValueError(f"there is no learner {kind!r} here; {NEAREST[kind]!r} is the nearest")
    if kind not in models:
        raise ValueError(f"unknown model {kind!r}")
    stages = [VectorAssembler(inputCols=features, outputCol="raw" if scaler else "features")]
    if scaler:
        stages.append(SCALERS[scaler](inputCol="raw", outputCol="features"))
    return Pipeline(stages=[*stages, models[kind](seed)])


def spread(train: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """train in as many tasks as its rows need: a join of small tables may leave all of its many rows to one task.

    Rows are dealt in turn, so equal ones don't meet in a task, and lie in order there, so when they arrive makes no odds.
    What is enough for one task stays as it is. Rows are counted first.
    """
    n = -(-train.count() // TASK_ROWS)
    return train if n < 2 else train.repartition(n).sortWithinPartitions(label, *features)


def fit(train: DataFrame, features: list[str], kind: str = "rf", scaler: str | None = None, regression: bool = False, seed: int = 0) -> PipelineModel:
    """The model of pipeline() on all rows of train."""
    plan, rows = pipeline(features, kind, scaler, regression, seed), spread(train, features)
    if rows is train:
        return plan.fit(train)
    rows = rows.persist()  # learners go over them several times
    model = plan.fit(rows)
    rows.unpersist()
    return model


def create_model(train: DataFrame, features: list[str], kind: str = "rf", scalers: tuple = (None, "standard"), regression: bool = False, folds: int = 3, group: str | None = None, seed: int = 0) -> tuple[PipelineModel, list[dict]]:
    """The best of the scalers by cross-validated score, fitted on all rows, and every score. Folds come from hashes of group, or of the rows."""
    key = F.col(group) if group else F.concat_ws("|", *[F.col(f).cast("string") for f in features])
    data = spread(train, features).withColumn("_fold", group_fold(key, folds)).cache()
    judge = RegressionEvaluator(metricName="r2") if regression else MulticlassClassificationEvaluator(metricName="accuracy")
    scores = []
    for s in scalers:
        got = []
        for k in range(folds):
            part = data.where(F.col("_fold") == k)
            if not part.limit(1).count():
                continue
            model = pipeline(features, kind, s, regression, seed).fit(data.where(F.col("_fold") != k))
            got.append(judge.evaluate(model.transform(part)))
        scores.append({"scaler": s or "none", "score": sum(got) / max(1, len(got))})
    best = max(scores, key=lambda r: r["score"])["scaler"]
    model = pipeline(features, kind, None if best == "none" else best, regression, seed).fit(data)
    data.unpersist()
    return model, scores


def search(train: DataFrame, features: list[str], settings: dict[str, list], kind: str = "rf", regression: bool = False, folds: int = 3, group: str | None = None, seed: int = 0) -> tuple[PipelineModel, list[dict]]:
    """The best of all combinations of a learner's parameters by cross-validated score, fitted on all rows, and every combination's score.

    settings maps names of pyspark.ml parameters to their values; of equal scores the first combination wins.
    """
    from itertools import product

    key = F.col(group) if group else F.concat_ws("|", *[F.col(f).cast("string") for f in features])
    train = spread(train, features)
    data = train.withColumn("_fold", group_fold(key, folds))
    judge = RegressionEvaluator(metricName="r2") if regression else MulticlassClassificationEvaluator(metricName="accuracy")
    used = [r["_fold"] for r in data.groupBy("_fold").count().collect()]  # a row a fold
    scores = []

    def fitted(chosen: dict, rows: DataFrame) -> PipelineModel:
        plan = pipeline(features, kind, None, regression, seed)
        learner = plan.getStages()[-1]
        for name, value in chosen.items():
            learner.set(learner.getParam(name), value)
        return plan.fit(rows)

    for values in product(*settings.values()):
        chosen = dict(zip(settings, values))
        got = [judge.evaluate(fitted(chosen, data.where(F.col("_fold") != k)).transform(data.where(F.col("_fold") == k))) for k in sorted(used)] if len(used) > 1 else [0.0]
        scores.append(chosen | {"score": sum(got) / len(got)})
    best = max(scores, key=lambda r: r["score"])
    return fitted({k: v for k, v in best.items() if k != "score"}, train), scores


def save_model(model: PipelineModel, path: str) -> None:
    """A fitted model in a folder; replaces one that is there."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_training(train: DataFrame, path: str) -> DataFrame:
    """A training set as Parquet, read again."""
    train.write.mode("overwrite").parquet(path)
    return train.sparkSession.read.schema(train.schema).parquet(path)


def columns_with(df: DataFrame, parts: list[str]) -> list[str]:
    """The columns whose names hold one of the parts, in their order, such as those of a polarisation."""
    return [c for c in df.columns if any(p in c for p in parts)]


def predict(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """df with a prediction; features that aren't finite count as 0."""
    return model.transform(df.withColumns({f: F.when(finite(F.col(f).cast("double")), F.col(f).cast("double")).otherwise(0.0) for f in features})).drop("raw", "features", "rawPrediction")


def probabilities(model: PipelineModel, df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """(keep, band, value): a band for each class, from 1."""
    out = predict(model, df, features)
    return out.select(*keep, F.posexplode(vector_to_array("probability")).alias("band", "value")).withColumn("band", F.col("band") + 1)


def importances(model: PipelineModel, features: list[str]) -> DataFrame:
    from pyspark.sql import SparkSession

    values = model.stages[-1].featureImportances.toArray().tolist()
    return SparkSession.active().createDataFrame(list(zip(features, values)), "feature string, importance double")


def eliminate(train: DataFrame, features: list[str], keep: int, seed: int = 0) -> DataFrame:
    """(feature, rank): features dropped one by one, the least important first; those kept have rank 1."""
    train, left, out = spread(train, features), list(features), []
    while len(left) > keep:
        model = pipeline(left, "rf", seed=seed).fit(train)
        weights = model.stages[-1].featureImportances.toArray().tolist()
        worst = min(range(len(left)), key=lambda i: (weights[i], left[i]))
        out.append((left.pop(worst), len(features) - keep - len(out) + 1))
    return train.sparkSession.createDataFrame([(f, 1) for f in left] + out, "feature string, rank int")


def permutation_importance(model: PipelineModel, df: DataFrame, features: list[str], key: str, seeds: tuple = (0,)) -> DataFrame:
    """(feature, drop): how much accuracy falls when a column's values are dealt to other rows, by the order of seeded hashes."""
    judge = MulticlassClassificationEvaluator(metricName="accuracy")
    base = judge.evaluate(predict(model, df, features))
    rows = []
    own = df.select(key, *features, "label")
    for f in features:
        drops = []
        for s in seeds:
            n = max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
            bucket = F.pmod(F.xxhash64(F.col(key), F.lit(s)), F.lit(n))
            left = own.drop(f).withColumn("_b", bucket).withColumn("_k", F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64(F.col(key)))))
            right = own.select(F.col(f), bucket.alias("_b"), F.row_number().over(Window.partitionBy(bucket).orderBy(F.xxhash64(F.col(key), F.lit(s + 1)))).alias("_k"))
            drops.append(base - judge.evaluate(predict(model, left.join(right, ["_b", "_k"]).drop("_b", "_k"), features)))
        rows.append((f, sum(drops) / len(drops)))
    return df.sparkSession.createDataFrame(rows, "feature string, drop double")


def centroids(train: DataFrame, label: str, features: Column | str) -> DataFrame:
    """(label, pos, mean): the mean vector of each class, element by element."""
    rows = train.select(F.col(label).alias("label"), F.posexplode(features).alias("pos", "v"))
    return rows.groupBy("label", "pos").agg(F.avg("v").alias("mean"))


def nearest_centroid(df: DataFrame, centres: DataFrame, key: str, features: Column | str) -> DataFrame:
    """(key, predicted): the class whose mean vector is nearest, the least of equally near ones.

    All centres are one row, as many as a legend has classes, so no row meets them in a shuffle.
    """
    vectors = centres.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"]).alias("m"))
    one = vectors.agg(F.collect_list(F.struct("label", "m")).alias("_all"))
    rows = df.select(F.col(key), F.col(features).alias("f") if isinstance(features, str) else features.alias("f")).crossJoin(F.broadcast(one))

    def far(c: Column) -> Column:
        return F.aggregate(F.zip_with(F.col("f"), c["m"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)

    near = F.array_min(F.transform("_all", lambda c: F.struct(F.round(far(c), 9).alias("d"), c["label"].alias("label"))))
    return rows.select(key, near["label"].alias("predicted"))


def vote(predictions: list[DataFrame], key: str, value: str) -> DataFrame:
    """The mean of several predictions of the same rows."""
    out = predictions[0]
    for p in predictions[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.avg(value).alias(value))


def best_setting(scores: DataFrame, setting: str, error: str) -> DataFrame:
    return scores.agg(F.min_by(setting, F.struct(error, setting)).alias(setting), F.min(error).alias(error))
