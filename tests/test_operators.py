"""Operators against numpy, and what the query tests don't reach: sources, streams, errors, edge cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions.numeric import ieee_divide
from quadrille.model import Grid
from quadrille.operators import algebra, components, depth, focal, geometry, kernels, metrics, ml, tiles, tseries, zonal
from quadrille.sources import rasters
from quadrille.streaming.rasters import daily_stats, sample_stream


def raster(spark, array, name="v"):
    rows = [(r, c, float(array[r, c])) for r in range(array.shape[0]) for c in range(array.shape[1])]
    return spark.createDataFrame(rows, f"row int, col int, {name} double")


def array(df, shape, name="value"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.row, r.col] = r[name]
    return out


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(3).integers(0, 9, (21, 17)).astype(float)


def test_box_mean_and_morphology(spark, image):
    df, (h, w) = raster(spark, image), image.shape
    want, top = np.zeros(image.shape), np.zeros(image.shape)
    for r in range(h):
        for c in range(w):
            near = image[max(0, r - 2) : r + 3, max(0, c - 2) : c + 3]
            want[r, c], top[r, c] = near.mean(), near.max()
    assert np.allclose(array(focal.box_mean(df, "v", 5), image.shape, "mean"), want)
    assert np.allclose(array(focal.dilate(df, "v", focal.square(5)), image.shape, "v"), top)


def test_terrain_of_a_plane(spark):
    r, c = np.mgrid[0:6, 0:6]
    t = focal.terrain(raster(spark, 2.0 * c), "v", 1.0).collect()
    assert len(t) == 16 and all(abs(x.slope - np.degrees(np.arctan(2))) < 1e-9 and abs(x.aspect - 270) < 1e-9 and abs(x.tpi) < 1e-12 for x in t)


@pytest.mark.parametrize("size", [3, 8, 64])
def test_components_do_not_depend_on_tiles(spark, image, size):
    blobs = (image > 5).astype(float)
    got = {(r.row, r.col): r.component for r in components.components(raster(spark, blobs), "v", 17, size).collect()}
    label = kernels.regions(blobs > 0)
    want = {}
    for r, c in zip(*np.nonzero(label)):
        want.setdefault(label[r, c], []).append((r, c))
    assert len(got) == int(blobs.sum())
    for cells in want.values():
        assert {got[x] for x in cells} == {min(int(r * 17 + c) for r, c in cells)}


def test_spiral_is_one_region(spark):
    n = 33
    a = np.zeros((n, n))
    r = c = 0
    dr, dc = 0, 1
    while True:
        a[r, c] = 1
        x, y = r + dr, c + dc
        if not (0 <= x < n and 0 <= y < n) or (0 <= x + dr < n and 0 <= y + dc < n and a[x + dr, y + dc]):
            dr, dc = dc, -dr
            x, y = r + dr, c + dc
            if not (0 <= x < n and 0 <= y < n) or (0 <= x + dr < n and 0 <= y + dc < n and a[x + dr, y + dc]):
                break
        r, c = x, y
    found = components.components(raster(spark, a), "v", n, 4)
    assert found.select("component").distinct().count() == 1
    rings = components.polygonize(found).collect()
    assert len(rings) == 1 and rings[0].n_rings == 1
    p = np.array([(q.x, q.y) for q in rings[0].ring])
    assert geometry.shoelace(p[:-1]) == a.sum()


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "row int, col int, v double")
    assert components.components(none, "v", 5).count() == 0
    assert focal.box_mean(none, "v", 3).count() == 0
    z = spark.createDataFrame([], "fid long, c0 int, r0 int, w int, h int")
    assert zonal.zonal_stats(none, z, "v", ["mean"]).count() == 0
    assert kernels.by_zone(none, z, "v", lambda a: a).count() == 0


def test_unknown_names(spark):
    for call in (lambda: zonal.statistic("nope", F.lit(1)), lambda: algebra.mask_rule(F.lit(1), 1, "!="), lambda: depth.depth_statistic("nope", F.lit(1.0)), lambda: ml.pipeline(["a"], "nope"), lambda: ml.scaled(spark.range(1), ["id"], "nope")):
        with pytest.raises(ValueError):
            call()


def test_zone_tiles_equal_plain_join(spark, image):
    rng = np.random.default_rng(1)
    zs = [(i, int(rng.integers(-3, 15)), int(rng.integers(-3, 18)), int(rng.integers(1, 9)), int(rng.integers(1, 9))) for i in range(40)]
    z = spark.createDataFrame(zs, "fid long, c0 int, r0 int, w int, h int")
    for size in (1, 4, 100):
        got = sorted((r.fid, r.row, r.col) for r in zonal.join_zones(raster(spark, image), z, size=size).collect())
        want = sorted((f, r, c) for f, c0, r0, w, h in zs for r in range(max(0, r0), min(21, r0 + h)) for c in range(max(0, c0), min(17, c0 + w)))
        assert got == want


def test_ieee_divide(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 4.0), (None, 1.0)], "a double, b double").select(ieee_divide(F.col("a"), F.col("b")).alias("x")).collect()
    x = [r.x for r in rows]
    assert x[0] == float("inf") and x[1] == -float("inf") and x[2] != x[2] and x[3] == 0.25 and x[4] is None


def test_geometry():
    p = np.random.default_rng(2).normal(size=(60, 2))
    h = geometry.hull(p)
    for q in p:
        for a, b in zip(h, np.roll(h, -1, axis=0)):
            assert (b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0]) > -1e-9
    turn = np.array([[np.cos(0.3), -np.sin(0.3)], [np.sin(0.3), np.cos(0.3)]])
    box = np.array([(0, 0), (4, 0), (4, 1), (0, 1)], float) @ turn.T
    assert np.allclose(geometry.min_rectangle(box)[:2], (1, 4))
    square = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float)
    assert abs(geometry.shoelace(geometry.clip_convex(square, square + 1)) - 1) < 1e-9
    assert len(geometry.clip_convex(square, square + 5)) == 0


def test_histogram_match_is_interpolation(spark, image):
    other = image[::2] ** 2
    got = depth.histogram_match(raster(spark, image, "value"), raster(spark, other, "value")).collect()
    sv, sc = np.unique(image, return_counts=True)
    tv, tc = np.unique(other, return_counts=True)
    want = dict(zip(sv.tolist(), np.interp(np.cumsum(sc) / sc.sum(), np.cumsum(tc) / tc.sum(), tv).tolist()))
    assert len(got) == image.size and all(abs(r.matched - want[r.value]) < 1e-9 for r in got)


def test_ascii_grid_and_tiles(spark, tmp_path):
    path = tmp_path / "a.asc"
    path.write_text("ncols 3\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 10\nNODATA_value -9\n1 2 3\n4 -9 6\n")
    rasters.register(spark)
    df = spark.read.format("ascii_grid").load(str(path))
    assert sorted((r.row, r.col, r.value) for r in df.where("value is not null").collect()) == [(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0), (1, 0, 4.0), (1, 2, 6.0)]
    out = rasters.write_tiles(df, Grid(), 2, str(tmp_path / "tiles"))
    back = rasters.read_tiles(spark, out)
    assert sorted((r.row, r.col, r.value or -1) for r in back.collect()) == sorted((r.row, r.col, r.value or -1) for r in df.collect())


def test_geojson_round_trip(spark, tmp_path):
    layer = spark.range(3).select(F.col("id").alias("fid"), geometry.rectangle(F.col("id") * 1.0, F.lit(0.0), F.col("id") + 2.0, F.lit(1.0)).alias("ring"))
    geometry.geojson(layer).select("feature").write.text(str(tmp_path / "g"))
    back = rasters.read_geojson(spark, str(tmp_path / "g"))
    assert sorted((r.fid, [tuple(p) for p in r.ring]) for r in back.collect()) == sorted((r.fid, [tuple(p) for p in r.ring]) for r in layer.collect())
    assert json.loads(geometry.geojson(layer).first().feature)["geometry"]["type"] == "Polygon"


def test_series_round_trip(spark):
    wide = spark.createDataFrame([(1, 0.5, None, 2.0), (2, 1.0, 1.5, 3.0)], "site int, `b-24-01` double, `b-24-02` double, `b-24-03` double")
    names = ["b-24-01", "b-24-02", "b-24-03"]
    assert sorted(tseries.to_wide(tseries.to_long(wide, "site", names), names).collect()) == sorted(wide.collect())
    cut = tseries.extract_by_date(wide, "site", names, "2024-02-01", "2024-03-30", "b")
    assert {r.site: r["b-24-02"] for r in cut.collect()} == {2: 1.5, 1: None} and all(r["b-24-03"] is None for r in cut.collect())


def test_symmetries_are_permutations(spark):
    cells = tiles.empty_grid(spark, Grid(width=5, height=5))
    for k in range(8):
        r, c = tiles.d4(F.col("row"), F.col("col"), 5, k)
        assert cells.select(r.alias("r"), c.alias("c")).distinct().count() == 25


def test_sequential_is_gapless(spark):
    df = spark.range(1000).where("id % 7 <> 0").repartition(9)
    got = tiles.sequential(df, F.expr("id div 64"), ["id"], "n", 1).orderBy("id").collect()
    assert [r.n for r in got] == list(range(1, len(got) + 1))


def test_kernels():
    a = np.zeros((20, 20))
    a[5:15, 6:14] = 10
    assert ((kernels.level_set(a, 20, smoothing=0) > 0) == (a > 0)).all()
    smooth = kernels.level_set(a, 20) > 0  # smoothing takes the corners
    assert not (smooth & (a == 0)).any() and smooth.sum() == 76
    edges = kernels.canny(a, 1.0)
    assert edges[4:16, 5:8].any() and not edges[9:11, 9:11].any()
    x = np.arange(40.0)
    y = 2 * x + 1
    y[::5] += 30
    slope, intercept, n = kernels.ransac_line(x, y, 0.5)
    assert abs(slope - 2) < 1e-6 and abs(intercept - 1) < 1e-6 and n == 32
    assert kernels.threshold_array(a, "otsu", 2).max() == 1
    assert 0 <= kernels.phase_congruency(a).min() and kernels.phase_congruency(a).max() <= 1
    assert kernels.snake(np.zeros((2, 2))).sum() == 0


def test_models(spark):
    rows = [(i, float(i % 2), float(i % 2) * 3 + (i % 5) / 10, float(i % 7)) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, label double, a double, b double")
    model, scores = ml.create_model(df, ["a", "b"], "logit", (None, "minmax"), folds=2)
    assert len(scores) == 2 and ml.predict(model, df, ["a", "b"]).where("prediction = label").count() == 120
    ranks = {r.feature: r["rank"] for r in ml.eliminate(df, ["a", "b"], 1).collect()}
    assert ranks == {"a": 1, "b": 2}
    assert metrics.confusion(df, "label", "label", [0, 1]).count() == 2


def test_streams(spark, tmp_path):
    schema = "id long, ts timestamp, value double, x double, y double"
    spark.sql("SELECT id, timestamp'2024-01-01' + make_dt_interval(0, id) AS ts, double(id) AS value, 1005.0D AS x, 4995.0D AS y FROM range(100)").write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        cell = spark.createDataFrame([(0, 0, 7.0)], "row int, col int, b1 double")
        q = sample_stream(stream, cell, Grid(), ["b1"]).writeStream.format("memory").queryName("sampled").option("checkpointLocation", str(tmp_path / "c1")).start()
        q.processAllAvailable()
        q.stop()
        assert spark.sql("SELECT count(*) n, max(b1) b FROM sampled").first() == (100, 7.0)
        q = daily_stats(stream, "ts", "value").writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "c2")).start()
        q.processAllAvailable()
        q.stop()
        assert spark.sql("SELECT count(*) c, sum(n) n FROM daily").first() == (5, 100)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_search_saving_and_refused_learners(spark, tmp_path):
    from quadrille.operators import ml

    rows = [(float(i % 7), float(i % 3), float(i % 7 > 3)) for i in range(80)]
    train = spark.createDataFrame(rows, "a double, b double, label double")
    model, scores = ml.search(train, ["a", "b"], {"maxDepth": [0, 3], "numTrees": [3]})
    assert len(scores) == 2 and scores[1]["score"] > scores[0]["score"]
    ml.save_model(model, str(tmp_path / "m"))
    again = ml.predict(ml.load_model(str(tmp_path / "m")), train, ["a", "b"])
    assert again.where("prediction <> label").count() == 0
    assert ml.save_training(train, str(tmp_path / "t")).count() == 80
    assert ml.columns_with(train.toDF("VV1", "x", "VH"), ["VV", "VH"]) == ["VV1", "VH"]
    try:
        ml.pipeline(["a"], "svm")
        raise AssertionError("svm is no learner here")
    except ValueError as refused:
        assert "linsvc" in str(refused)


def test_training_rows_are_spread(spark, monkeypatch):
    """No task of a fit holds many more rows than TASK_ROWS, none is lost, and a small set is left as it is."""
    from collections import Counter

    from pyspark.ml import Pipeline

    from quadrille.plans import learning

    d, seen, plain = "/root/testdata/sf0.01", [], Pipeline.fit

    def fit(self, train, *a):
        seen.append([r["count"] for r in train.groupBy(F.spark_partition_id()).count().collect()])
        return plain(self, train, *a)

    monkeypatch.setattr(Pipeline, "fit", fit)
    learning.classify_pixels(spark, d).count()
    total = sum(seen[-1])
    assert len(seen[-1]) == 1 and total > 1000  # a join of small tables, in one task
    monkeypatch.setattr(ml, "TASK_ROWS", 100, raising=False)
    assert learning.classify_pixels(spark, d).count() == 4096
    assert sum(seen[-1]) == total and max(seen[-1]) <= 101
    monkeypatch.setattr(ml, "TASK_ROWS", 30)
    for name in ("prob_pixels", "classify_objects", "feature_importance", "permutation_importance", "rf_predictions", "rfe"):
        seen.clear()
        assert getattr(learning, name)(spark, d).count() > 0
        assert seen and max(map(max, seen)) <= 32, name
    same = spark.createDataFrame([(1.0, 2.0, i % 2 + 0.0) for i in range(500)] + [(None, float("nan"), 1.0)], "a double, b double, label double").coalesce(1)
    dealt = ml.spread(same, ["a", "b"])
    assert max(dealt.rdd.glom().map(len).collect()) <= 31  # equal rows too
    assert Counter(map(str, dealt.collect())) == Counter(map(str, same.collect()))
    monkeypatch.setattr(ml, "TASK_ROWS", 501)
    assert ml.spread(same, ["a", "b"]) is same and ml.spread(same.limit(0), ["a", "b"]).count() == 0
