"""Queries over training sets, models, accuracy and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import metrics, ml, tiles
from .base import emb, grid, query, table, with_, zones

CELL = ["row", "col"]
FEATURES = [f"f{i}" for i in range(1, 9)]


def embedded(spark, d):
    """(vec_id, label, f1..f8) of the embeddings' first eight values."""
    return emb(spark, d).select("vec_id", "label", *[F.col("e")[i].alias(f"f{i + 1}") for i in range(8)])


WIDE = "WITH v AS (SELECT vec_id, label, " + ", ".join(f"embedding[{i}]::DOUBLE AS f{i}" for i in range(1, 9)) + " FROM embeddings) "


# --- training sets ---


@query("training_pixels", with_("zpix", "zones") + "SELECT CAST(1 + fid % 3 AS DOUBLE) AS label, count(*) AS n, round(sum(b1), 6) AS s1, round(sum(b2), 6) AS s2, round(sum(b3), 6) AS s3 FROM zpix GROUP BY 1")
def training_pixels(spark, d):
    z = zones(spark, d).withColumn("class", 1 + F.col("fid") % 3)
    t = ml.training_pixels(grid(spark, d), z, "class", ["b1", "b2", "b3"])
    return t.groupBy("label").agg(F.count("*").alias("n"), *[r6(F.sum(f"b{i}")).alias(f"s{i}") for i in (1, 2, 3)])


@query("training_attrs", with_("zones") + "SELECT s_nationkey AS label, w, h, s_acctbal FROM zones")
def training_attrs(spark, d):
    return zones(spark, d).select(F.col("s_nationkey").alias("label"), "w", "h", "s_acctbal")


@query("training_clean", "SELECT vec_id, label, embedding[1]::DOUBLE AS f1 FROM embeddings WHERE label <> 0")
def training_clean(spark, d):
    return ml.clean(embedded(spark, d), FEATURES).select("vec_id", "label", "f1")


# --- scaling ---

_SCALED = {
    "scale_standard": ("standard", "(f{i} - avg(f{i}) OVER ()) / stddev_pop(f{i}) OVER ()"),
    "scale_minmax": ("minmax", "(f{i} - min(f{i}) OVER ()) / (max(f{i}) OVER () - min(f{i}) OVER ())"),
    "scale_l2": ("l2", "f{i} / sqrt(" + " + ".join(f"f{j} * f{j}" for j in range(1, 9)) + ")"),
    "scale_maxabs": ("maxabs", "f{i} / max(abs(f{i})) OVER ()"),
    "scale_quantile": ("quantile", "percent_rank() OVER (ORDER BY f{i})"),
}
for _key, (_kind, _sql) in _SCALED.items():

    @query(_key, WIDE + "SELECT vec_id, " + ", ".join(f"round({_sql.format(i=i)}, 6) + 0.0 AS f{i}" for i in (1, 2, 3)) + " FROM v")
    def scale(spark, d, kind=_kind):
        features = FEATURES if kind == "l2" else FEATURES[:3]
        return ml.scaled(embedded(spark, d), features, kind).select("vec_id", *[r6(F.col(f)).alias(f) for f in FEATURES[:3]])


# --- folds and splits ---


@query("folds_group", "SELECT vec_id, fold FROM (SELECT vec_id, label % 10 AS g FROM embeddings) JOIN (VALUES " + ", ".join(f"({g}, {__import__('zlib').crc32(str(g).encode()) % 5})" for g in range(10)) + ") AS t(h, fold) ON g = h")
def folds_group(spark, d):
    return emb(spark, d).select("vec_id", ml.group_fold(F.col("label"), 5).alias("fold"))


@query("folds_strat", "SELECT vec_id, CAST((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 5 AS INT) AS fold FROM embeddings")
def folds_strat(spark, d):
    return ml.stratified_fold(emb(spark, d), "label", ["vec_id"], 5).select("vec_id", "fold")


@query("split_train_val_test", "WITH u AS (SELECT vec_id, vec_id * 2654435761 % 4294967296 / 4294967296.0 AS u FROM embeddings) SELECT vec_id, CASE WHEN u < 0.25 THEN 'test' WHEN u < 0.4375 THEN 'val' ELSE 'train' END AS part FROM u")
def split_train_val_test(spark, d):
    return emb(spark, d).select("vec_id", ml.split(F.col("vec_id"), 0.25, 0.25).alias("part"))


# --- models ---


def _halves(spark, d):
    rows = embedded(spark, d).withColumn("label", F.col("label").cast("double"))
    return rows.where("vec_id % 4 <> 0"), rows.where("vec_id % 4 = 0")


@query("rf_predictions")
def rf_predictions(spark, d):
    train, test = _halves(spark, d)
    model, _ = ml.create_model(train, FEATURES, "rf", (None, "standard"), folds=2)
    return ml.predict(model, test, FEATURES).select("vec_id", "label", "prediction")


@query("rf_regress")
def rf_regress(spark, d):
    train, test = _halves(spark, d)
    model, _ = ml.create_model(train.withColumn("label", F.col("f1") + 2 * F.col("f2")), FEATURES, "rf", (None,), regression=True, folds=2)
    return ml.predict(model, test, FEATURES).select("vec_id", "prediction")


@query("prob_pixels")
def prob_pixels(spark, d):
    train, test = _halves(spark, d)
    return ml.probabilities(ml.fit(train, FEATURES), test, FEATURES, ["vec_id"])


@query("classify_pixels")
def classify_pixels(spark, d):
    """Cells by a forest fitted on zones' cells; cells of zeros are left out, as empty blocks are."""
    z = zones(spark, d).withColumn("class", 1 + F.col("fid") % 3)
    bands = ["b1", "b2", "b3"]
    model = ml.fit(ml.clean(ml.training_pixels(grid(spark, d), z, "class", bands), bands), bands)
    return ml.predict(model, grid(spark, d).where("b1 <> 0"), bands).select(*CELL, "prediction")


@query("classify_objects")
def classify_objects(spark, d):
    rows = zones(spark, d).withColumn("label", (F.col("s_nationkey") % 3).cast("double"))
    model = ml.fit(rows, ["w", "h", "s_acctbal"])
    return ml.predict(model, rows, ["w", "h", "s_acctbal"]).select("fid", "prediction")


@query("feature_importance")
def feature_importance(spark, d):
    train, _ = _halves(spark, d)
    return ml.importances(ml.fit(train, FEATURES), FEATURES)


@query("permutation_importance")
def permutation_importance(spark, d):
    train, test = _halves(spark, d)
    features = FEATURES[:3]
    return ml.permutation_importance(ml.fit(train, features), test, features, "vec_id")


@query("rfe")
def rfe(spark, d):
    train, _ = _halves(spark, d)
    return ml.eliminate(train, FEATURES[:5], 3)


@query("importance_rank", WIDE + "SELECT feature, row_number() OVER (ORDER BY spread DESC, feature) AS rank FROM (" + " UNION ALL ".join(f"SELECT 'f{i}' AS feature, round(var_pop(f{i}), 9) AS spread FROM v" for i in range(1, 9)) + ")")
def importance_rank(spark, d):
    """Features ranked by a weight; here their variance."""
    from pyspark.sql import Window

    spread = embedded(spark, d).agg(*[F.round(F.var_pop(f), 9).alias(f) for f in FEATURES])
    long = spread.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("spread")) for f in FEATURES])).alias("x")).select("x.*")
    return long.select("feature", F.row_number().over(Window.orderBy(F.desc("spread"), "feature")).alias("rank"))  # a row a feature


@query("cv_sort", "SELECT o_orderkey AS setting, row_number() OVER (ORDER BY o_orderpriority, o_totalprice, o_orderkey) AS place FROM orders")
def cv_sort(spark, d):
    """Results ordered by rank and then fitting time."""
    group = F.struct("o_orderpriority", F.floor(F.col("o_totalprice") / 1000))
    rows = tiles.sequential(table(spark, d, "orders"), group, ["o_orderpriority", "o_totalprice", "o_orderkey"], "place", first=1)
    return rows.select(F.col("o_orderkey").alias("setting"), "place")


@query("best_param", "SELECT arg_min(p_size, (e, p_size)) AS setting, round(min(e), 6) AS error FROM (SELECT p_size, round(avg(p_retailprice), 6) AS e FROM part GROUP BY p_size)")
def best_param(spark, d):
    scores = table(spark, d, "part").groupBy(F.col("p_size").alias("setting")).agg(r6(F.avg("p_retailprice")).alias("error"))
    return ml.best_setting(scores, "setting", "error")


CENTROID = "WITH v AS (SELECT vec_id, label, unnest(range(1, 65)) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, p, avg(x) AS m FROM v WHERE vec_id % 4 <> 0 GROUP BY 1, 2), d AS (SELECT vec_id, m.label, round(sum((x - m) * (x - m)), 9) AS d FROM v JOIN m USING (p) GROUP BY 1, 2) SELECT vec_id, arg_min(label, (d, label)) AS predicted FROM d GROUP BY 1"


@query("classify_centroid", CENTROID)
def classify_centroid(spark, d):
    rows = emb(spark, d)
    return ml.nearest_centroid(rows, ml.centroids(rows.where("vec_id % 4 <> 0"), "label", "e"), "vec_id", "e")


@query("vote_mean", WIDE + "SELECT vec_id, round((f1 + f2 + f3) / 3, 6) + 0.0 AS prediction FROM v")
def vote_mean(spark, d):
    parts = [embedded(spark, d).select("vec_id", F.col(f).alias("prediction")) for f in FEATURES[:3]]
    return ml.vote(parts, "vec_id", "prediction").select("vec_id", r6(F.col("prediction")).alias("prediction"))


# --- accuracy ---

PAIRS = "WITH p AS (SELECT o_totalprice / 1000 AS t, avg(o_totalprice) OVER (PARTITION BY o_custkey) / 1000 AS p FROM orders) "


def price_pairs(spark, d):
    from pyspark.sql import Window

    o = table(spark, d, "orders")
    return o.select((F.col("o_totalprice") / 1000).alias("t"), (F.avg("o_totalprice").over(Window.partitionBy("o_custkey")) / 1000).alias("p"))


@query("regression_metrics", PAIRS + "SELECT round(1 - var_pop(t - p) / var_pop(t), 6) AS explained, round(1 - avg((t - p) ^ 2) / var_pop(t), 6) AS r2, round(avg(abs(t - p)), 6) AS mae, round(avg((t - p) ^ 2), 5) AS mse, round(median(abs(t - p)), 6) AS medae, round(sqrt(avg((t - p) ^ 2)), 6) AS rmse FROM p")
def regression_metrics(spark, d):
    m = metrics.regression(price_pairs(spark, d), "t", "p")
    return m.select(*[F.round(c, 5 if c == "mse" else 6).alias(c) for c in m.columns])


@query("rmse", PAIRS + "SELECT round(sqrt(avg((t - p) ^ 2)), 6) AS rmse FROM p")
def rmse(spark, d):
    return metrics.rmse(price_pairs(spark, d), "t", "p").select(r6(F.col("rmse")).alias("rmse"))


_L = "WITH p AS (SELECT quality AS t, CASE WHEN doc_id % 5 = 0 THEN toxic ELSE quality END AS p FROM labels)"


def label_pairs(spark, d):
    return table(spark, d, "labels").select(F.col("quality").alias("t"), F.when(F.col("doc_id") % 5 == 0, F.col("toxic")).otherwise(F.col("quality")).alias("p"))


@query(
    "classif_report",
    _L
    + ", c AS (SELECT t AS k FROM p UNION SELECT p FROM p), n AS (SELECT k, count(*) FILTER (t = k) AS s, count(*) FILTER (p = k) AS g, count(*) FILTER (t = k AND p = k) AS h FROM p, c GROUP BY k), "
    + "m AS (SELECT CAST(k AS VARCHAR) AS class, CASE WHEN g > 0 THEN h / g ELSE 0 END AS pr, CASE WHEN s > 0 THEN h / s ELSE 0 END AS re, s FROM n), f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM m), "
    + "a AS (SELECT class, pr, re, f1 FROM f UNION ALL SELECT 'macro avg', avg(pr), avg(re), avg(f1) FROM f WHERE s > 0 UNION ALL SELECT 'weighted avg', sum(pr * s) / sum(s), sum(re * s) / sum(s), sum(f1 * s) / sum(s) FROM f WHERE s > 0) SELECT class, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1 FROM a",
)
def classif_report(spark, d):
    return metrics.class_report(label_pairs(spark, d), "t", "p").select("class", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query("confusion", _L + " SELECT t AS truth, count(*) FILTER (p = 0) AS p_0, count(*) FILTER (p = 1) AS p_1 FROM p GROUP BY t")
def confusion(spark, d):
    return metrics.confusion(label_pairs(spark, d), "t", "p", [0, 1])


LOGITS = "WITH z AS (SELECT doc_id, quality AS t, (doc_id % 11 - 5) / 2.0 + quality AS x FROM labels) "


def logits(spark, d):
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("t"), ((F.col("doc_id") % 11 - 5) / 2.0 + F.col("quality")).alias("x"))


@query("accuracy", LOGITS + "SELECT round(avg(CASE WHEN (CASE WHEN 1 / (1 + exp(-x)) >= 0.5 THEN 1 ELSE 0 END) = t THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM z")
def accuracy(spark, d):
    return metrics.accuracy(logits(spark, d), "x", "t").select(r6(F.col("accuracy")).alias("accuracy"))


@query("loss_binary", LOGITS + ", s AS (SELECT t, x, 1 / (1 + exp(-x)) AS p FROM z) SELECT round(0.7 * avg(greatest(x, 0) - x * t + ln(1 + exp(-abs(x)))) - 0.3 * ln((sum(p * t) + 1e-15) / (sum(p) + sum(t) - sum(p * t) + 1e-15)), 6) AS loss FROM s")
def loss_binary(spark, d):
    return metrics.binary_loss(logits(spark, d), "x", "t").select(r6(F.col("loss")).alias("loss"))


MULTI = "WITH z AS (SELECT vec_id, label % 3 AS t, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings), n AS (SELECT *, ln(exp(a) + exp(b) + exp(c)) AS s FROM z), p AS (SELECT t, a - s AS l0, b - s AS l1, c - s AS l2 FROM n) "
_JACCARD = " - 0.3 * ln((sum(CASE WHEN t = {k} THEN exp(l{k}) ELSE 0 END) + 1e-15) / (sum(exp(l{k})) + count(*) FILTER (t = {k}) - sum(CASE WHEN t = {k} THEN exp(l{k}) ELSE 0 END) + 1e-15))"


@query("loss_multi", MULTI + "SELECT round(-0.7 * sum(CASE t WHEN 0 THEN l0 WHEN 1 THEN 2 * l1 ELSE 3 * l2 END) / sum(t + 1)" + "".join(_JACCARD.format(k=k) for k in range(3)) + ", 6) AS loss FROM p")
def loss_multi(spark, d):
    """The loss of many classes, on the log softmax of three values."""
    x = [F.col("e")[i] for i in range(3)]
    total = F.log(sum((F.exp(v) for v in x[1:]), F.exp(x[0])))
    rows = emb(spark, d).select((F.col("label") % 3).alias("t"), *[(v - total).alias(f"l{i}") for i, v in enumerate(x)])
    return metrics.multi_loss(rows, ["l0", "l1", "l2"], "t", 0.3, [1.0, 2.0, 3.0]).select(r6(F.col("loss")).alias("loss"))


@query("running_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS running FROM events")
def running_mean(spark, d):
    return metrics.running_mean(table(spark, d, "events"), "event_type", ["event_id"], "value").select("event_id", r6(F.col("running")).alias("running"))


@query("grid_linearity", "SELECT p_brand, round(corr(p_size, p_retailprice), 6) + 0.0 AS r, abs(corr(p_size, p_retailprice)) < 0.86 AS log_axis FROM part GROUP BY p_brand")
def grid_linearity(spark, d):
    r = table(spark, d, "part").groupBy("p_brand").agg(F.corr("p_size", "p_retailprice").alias("r"))
    return r.select("p_brand", r6(F.col("r")).alias("r"), (F.abs("r") < 0.86).alias("log_axis"))
