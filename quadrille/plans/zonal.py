"""Queries over rasters and zones together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..model import Grid
from ..operators import geometry, kernels, tiles, zonal
from .base import GRID, ORACLES, grid, points, query, with_, zones

RC = 'r AS "row", c AS col'
CELL = ["row", "col"]


def _stats(name: str, sql: str, value: str, stats: list[str], where: str = "TRUE"):
    @query(name, with_("zpix") + f"SELECT fid, {sql} FROM zpix WHERE {where} GROUP BY fid")
    def run(spark, d):
        out = zonal.zonal_stats(grid(spark, d), zones(spark, d), value, stats)
        return out.select("fid", *[(r6(F.col(s)) if s not in ("count",) else F.col(s)).alias(s) for s in stats])


@query("zonal_basic", with_("zpix") + "SELECT fid, count(*) AS n, round(min(b1), 6) AS v_min, round(max(b1), 6) AS v_max, round(sum(b1), 6) AS v_sum, round(avg(b1), 6) AS v_mean FROM zpix WHERE b1 <> 0 GROUP BY fid")
def zonal_basic(spark, d):
    out = zonal.zonal_stats(grid(spark, d), zones(spark, d), "b1", ["count", "min", "max", "sum", "mean"])
    return out.select("fid", F.col("count").alias("n"), *[r6(F.col(s)).alias(f"v_{s}") for s in ("min", "max", "sum", "mean")])


_stats("zonal_spread", "round(stddev_pop(b1), 6) + 0.0 AS std, round(var_pop(b1), 6) + 0.0 AS var", "b1", ["std", "var"], "b1 <> 0")
_stats("zonal_count", "count(*) AS count", "b4", ["count"], "b4 <> 0")
_stats("zonal_median", "round(median(b1), 6) AS median", "b1", ["median"], "b1 <> 0")
_stats("zonal_mode", "round(mode_, 6) AS mode", "b3", ["mode"])


def _mode_sql() -> str:
    return with_("zpix") + ", n AS (SELECT fid, b3, count(*) AS k FROM zpix WHERE b3 <> 0 GROUP BY 1, 2), o AS (SELECT fid, b3, row_number() OVER (PARTITION BY fid ORDER BY k DESC, b3) AS i FROM n) SELECT fid, b3 AS mode FROM o WHERE i = 1"



ORACLES["zonal_mode"] = _mode_sql()


@query(
    "zonal_shape",
    with_("zpix")
    + ", m AS (SELECT fid, avg(b1) AS a, count(*) AS n FROM zpix GROUP BY fid), p AS (SELECT fid, avg((b1 - a) ^ 2) AS m2, avg((b1 - a) ^ 3) AS m3, avg((b1 - a) ^ 4) AS m4 FROM zpix JOIN m USING (fid) GROUP BY fid) SELECT fid, round(m3 / m2 ^ 1.5, 6) + 0.0 AS skew, round(m4 / m2 ^ 2 - 3, 6) + 0.0 AS kurt FROM p",
)
def zonal_shape(spark, d):
    return zonal.zonal_stats(grid(spark, d), zones(spark, d), "b1", ["skew", "kurt"]).select("fid", r6(F.col("skew")).alias("skew"), r6(F.col("kurt")).alias("kurt"))


DIAMOND = "abs(c - (c0 + w // 2)) * h + abs(r - (r0 + h // 2)) * w <= w * h // 2"


def in_diamond():
    """Cells of the diamond inscribed in a zone's box."""
    return F.abs(F.col("col") - (F.col("c0") + F.expr("w div 2"))) * F.col("h") + F.abs(F.col("row") - (F.col("r0") + F.expr("h div 2"))) * F.col("w") <= F.expr("w * h div 2")


@query("zonal_diamond", with_("zpix") + f"SELECT fid, count(*) AS n, round(avg(b1), 6) AS mean FROM zpix WHERE {DIAMOND} GROUP BY fid")
def zonal_diamond(spark, d):
    out = zonal.zonal_stats(grid(spark, d), zones(spark, d), "b1", ["count", "mean"], inside=in_diamond())
    return out.select("fid", F.col("count").alias("n"), r6(F.col("mean")).alias("mean"))


@query("zonal_perc", with_("zpix") + f", k AS (SELECT fid, count(*) FILTER (b4 <> 0) AS hit, count(*) FILTER ({DIAMOND}) AS area FROM zpix GROUP BY fid) SELECT fid, CASE WHEN hit = 0 THEN 0.0 WHEN hit > area THEN 1.0 ELSE round(hit / area, 2) END AS perc FROM k")
def zonal_perc(spark, d):
    return zonal.coverage_percent(grid(spark, d), zones(spark, d), "b4", in_diamond())


@query("zonal_volume", with_("zpix") + "SELECT fid, round(sum(b1) * 100.0, 6) AS vol FROM zpix GROUP BY fid")
def zonal_volume(spark, d):
    return zonal.volume(grid(spark, d), zones(spark, d), "b1", GRID.px).select("fid", r6(F.col("vol")).alias("vol"))


@query("zonal_single", with_("grid", "zones") + ", z AS (SELECT fid, c0, r0, CASE WHEN fid % 2 = 0 THEN 1 ELSE w END AS w, CASE WHEN fid % 2 = 0 THEN 1 ELSE h END AS h FROM zones) SELECT fid, CASE WHEN max(w * h) = 1 THEN max(b4) ELSE round(avg(CASE WHEN b4 <> 0 THEN b4 END), 6) END AS mean FROM z JOIN grid ON c >= c0 AND c < c0 + w AND r >= r0 AND r < r0 + h GROUP BY fid")
def zonal_single(spark, d):
    z = zones(spark, d).withColumns({"w": F.when(F.col("fid") % 2 == 0, 1).otherwise(F.col("w")), "h": F.when(F.col("fid") % 2 == 0, 1).otherwise(F.col("h"))})
    return zonal.single_pixel(grid(spark, d), z, "b4", "mean").select("fid", r6(F.col("mean")).alias("mean"))


@query("zonal_frac", with_("zpix") + ", k AS (SELECT fid, CAST(b4 AS INT) AS v, count(*) AS n FROM zpix GROUP BY 1, 2) SELECT fid, string_agg(v, ',' ORDER BY v) AS classes, string_agg(n, ',' ORDER BY v) AS counts FROM k GROUP BY fid")
def zonal_frac(spark, d):
    out = zonal.zonal_fractions(grid(spark, d), zones(spark, d), "b4")
    return out.select("fid", F.expr("array_join(transform(classes, x -> cast(cast(x as int) as string)), ',')").alias("classes"), F.expr("array_join(transform(counts, x -> cast(x as string)), ',')").alias("counts"))


ALL = ["mean", "min", "max", "median", "std", "var"]


@query(
    "zonal_all",
    with_("zpix") + "SELECT fid, " + ", ".join(f"round({e.format(b)}, 6) + 0.0 AS {b}_{s}" for b in ("b1", "b2", "b3") for s, e in zip(ALL, ("avg({})", "min({})", "max({})", "median({})", "stddev_pop({})", "var_pop({})"))) + " FROM zpix GROUP BY fid",
)
def zonal_all(spark, d):
    out = zonal.zonal_all(grid(spark, d), zones(spark, d), ["b1", "b2", "b3"], ALL)
    return out.select("fid", *[r6(F.col(c)).alias(c) for c in out.columns if c != "fid"])


@query("zonal_filtered", with_("zpix") + "SELECT fid, round(avg(b1), 6) AS mean FROM zpix JOIN (SELECT fid FROM zones WHERE s_acctbal > 1000) USING (fid) GROUP BY fid")
def zonal_filtered(spark, d):
    return zonal.zonal_stats(grid(spark, d), zones(spark, d), "b1", ["mean"], expression="s_acctbal > 1000").select("fid", r6(F.col("mean")).alias("mean"))


_RGB = {
    "ExG": "2 * g - (r_ - b)", "ExR": "1.4 * r_ - g", "ExGR": "2 * g - (r_ - b) - (1.4 * r_ - g)", "CIVE": "0.441 * r_ - 0.811 * g + 0.385 * b + 18.78745", "NDI": "(g - r_) / (g + r_)",
    "RGBVI": "((g * g - b) * r_) / ((g * g + b) * r_)", "VARI": "(g - r_) / (g + r_) - b", "ARI": "1 / (g * r_)", "RGBI": "r_ / g", "GLI": "((g - r_) + (g - b)) / (2 * g) + r_ + b", "TGL": "(g - 0.39) * (r_ - 0.61) * b",
}


@query("zonal_rgb_idx", with_("zpix") + ", x AS (SELECT fid, b1 / (b1 + b2 + b3) AS r_, b2 / (b1 + b2 + b3) AS g, b3 / (b1 + b2 + b3) AS b FROM zpix) SELECT fid, " + ", ".join(f"round(avg({e}), 6) + 0.0 AS {n}" for n, e in _RGB.items()) + " FROM x GROUP BY fid")
def zonal_rgb_idx(spark, d):
    out = zonal.zonal_rgb(grid(spark, d), zones(spark, d), "b1", "b2", "b3")
    return out.select("fid", *[r6(F.col(n)).alias(n) for n in _RGB])


@query("texture_entropy", with_("zpix") + ", k AS (SELECT fid, b3, count(*) AS n FROM zpix GROUP BY 1, 2), p AS (SELECT fid, n / sum(n) OVER (PARTITION BY fid) AS p FROM k) SELECT fid, round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM p GROUP BY fid")
def texture_entropy(spark, d):
    return zonal.entropy(grid(spark, d), zones(spark, d), "b3").select("fid", r6(F.col("entropy")).alias("entropy"))


GLCM = with_("zpix") + ", q AS (SELECT a.fid, a.b3 AS i, b.b3 AS j FROM zpix a JOIN zpix b ON a.fid = b.fid AND a.r = b.r AND a.c + 1 = b.c), s AS (SELECT fid, i, j FROM q UNION ALL SELECT fid, j, i FROM q), n AS (SELECT fid, i, j, count(*) AS n FROM s GROUP BY 1, 2, 3), p AS (SELECT fid, i, j, n / sum(n) OVER (PARTITION BY fid) AS p FROM n) "
for _n, _e in (("contrast", "sum(p * (i - j) ^ 2)"), ("dissimilarity", "sum(p * abs(i - j))"), ("homogeneity", "sum(p / (1 + (i - j) ^ 2))")):

    @query(f"glcm_{_n}", GLCM + f"SELECT fid, round({_e}, 6) + 0.0 AS {_n} FROM p GROUP BY fid")
    def glcm(spark, d, prop=_n):
        return zonal.texture(zonal.cooccurrence(grid(spark, d), zones(spark, d), "b3", 1, 0), prop).select("fid", r6(F.col(prop)).alias(prop))


@query("glcm_asm_energy", GLCM + "SELECT fid, round(sum(p * p), 6) + 0.0 AS asm, round(sqrt(sum(p * p)), 6) + 0.0 AS energy FROM p GROUP BY fid")
def glcm_asm_energy(spark, d):
    table_ = zonal.cooccurrence(grid(spark, d), zones(spark, d), "b3", 1, 0)
    out = zonal.texture(table_, "asm").join(zonal.texture(table_, "energy"), "fid")
    return out.select("fid", r6(F.col("asm")).alias("asm"), r6(F.col("energy")).alias("energy"))


@query("glcm_correlation", GLCM + ", m AS (SELECT fid, sum(p * i) AS mi, sum(p * j) AS mj, sum(p * i * i) AS ii, sum(p * j * j) AS jj, sum(p * i * j) AS ij FROM p GROUP BY fid) SELECT fid, CASE WHEN ii - mi * mi < 1e-12 OR jj - mj * mj < 1e-12 THEN 1.0 ELSE round((ij - mi * mj) / sqrt((ii - mi * mi) * (jj - mj * mj)), 6) + 0.0 END AS correlation FROM m")
def glcm_correlation(spark, d):
    return zonal.texture(zonal.cooccurrence(grid(spark, d), zones(spark, d), "b3", 1, 0), "correlation").select("fid", r6(F.col("correlation")).alias("correlation"))


# --- masks, clips and rasters from zones ---


def _covered(spark, d):
    return zonal.join_zones(grid(spark, d).select(*CELL), zones(spark, d).select("fid", "c0", "r0", "w", "h"), in_diamond()).select(*CELL).distinct()


@query("mask_poly_inside", with_("grid", "zpix") + f', i AS (SELECT DISTINCT r, c FROM zpix WHERE {DIAMOND}) SELECT g.r AS "row", g.c AS col, CASE WHEN i.r IS NULL THEN b1 ELSE 0 END AS value FROM grid g LEFT JOIN i ON g.r = i.r AND g.c = i.c')
def mask_poly_inside(spark, d):
    hit = _covered(spark, d).withColumn("hit", F.lit(True))
    return grid(spark, d).join(hit, CELL, "left").select(*CELL, F.when(F.col("hit"), 0.0).otherwise(F.col("b1")).alias("value"))


@query("mask_poly_outside", with_("grid", "zpix") + f', i AS (SELECT DISTINCT r, c FROM zpix WHERE {DIAMOND}) SELECT g.r AS "row", g.c AS col, CASE WHEN i.r IS NULL THEN 0 ELSE b1 END AS value FROM grid g LEFT JOIN i ON g.r = i.r AND g.c = i.c')
def mask_poly_outside(spark, d):
    hit = _covered(spark, d).withColumn("hit", F.lit(True))
    return grid(spark, d).join(hit, CELL, "left").select(*CELL, F.when(F.col("hit"), F.col("b1")).otherwise(0.0).alias("value"))


_BOX = ", e AS (SELECT min(c0) AS c_lo, max(c0 + w) AS c_hi, min(r0) AS r_lo, max(r0 + h) AS r_hi FROM zones WHERE {})"


def _clip(spark, d, where: str):
    """Pixels in the common bounding box of the zones chosen: one row to broadcast."""
    box = zones(spark, d).where(where).agg(F.min("c0").alias("c_lo"), F.max(F.col("c0") + F.col("w")).alias("c_hi"), F.min("r0").alias("r_lo"), F.max(F.col("r0") + F.col("h")).alias("r_hi"))
    return grid(spark, d).crossJoin(F.broadcast(box)).where("col >= c_lo and col < c_hi and row >= r_lo and row < r_hi").drop("c_lo", "c_hi", "r_lo", "r_hi")


@query("clip_bbox", with_("grid", "zones") + _BOX.format("fid % 10 = 3") + f" SELECT {RC}, b1 AS value FROM grid, e WHERE c >= c_lo AND c < c_hi AND r >= r_lo AND r < r_hi")
def clip_bbox(spark, d):
    return _clip(spark, d, "fid % 10 = 3").select(*CELL, F.col("b1").alias("value"))


@query("clip_cutline", with_("grid", "zones", "zpix") + _BOX.format("fid % 10 = 3") + ', i AS (SELECT DISTINCT r, c FROM zpix WHERE fid % 10 = 3) SELECT g.r AS "row", g.c AS col, CASE WHEN i.r IS NULL THEN 0 ELSE b1 END AS value FROM grid g CROSS JOIN e LEFT JOIN i ON g.r = i.r AND g.c = i.c WHERE g.c >= c_lo AND g.c < c_hi AND g.r >= r_lo AND g.r < r_hi')
def clip_cutline(spark, d):
    z = zones(spark, d).where("fid % 10 = 3").select("fid", "c0", "r0", "w", "h")
    hit = zonal.join_zones(grid(spark, d).select(*CELL), z).select(*CELL).distinct().withColumn("hit", F.lit(True))
    return _clip(spark, d, "fid % 10 = 3").join(hit, CELL, "left").select(*CELL, F.when(F.col("hit"), F.col("b1")).otherwise(0.0).alias("value"))


@query("clip_select", with_("grid", "zones") + f", z AS (SELECT * FROM zones WHERE s_name = 'Supplier#000000004' ORDER BY fid LIMIT 1) SELECT {RC}, b1 AS value FROM grid, z WHERE c >= c0 AND c < c0 + w AND r >= r0 AND r < r0 + h")
def clip_select(spark, d):
    z = zones(spark, d).where("s_name = 'Supplier#000000004'").select("fid", "c0", "r0", "w", "h").orderBy("fid").limit(1)
    return zonal.join_zones(grid(spark, d), z).select(*CELL, F.col("b1").alias("value"))


@query("rasterize_const", with_("full_", "zones") + f', i AS (SELECT DISTINCT f.r, f.c FROM full_ f JOIN zones ON f.c >= c0 AND f.c < c0 + w AND f.r >= r0 AND f.r < r0 + h) SELECT f.r AS "row", f.c AS col, CASE WHEN i.r IS NULL THEN 0.0 ELSE 1.0 END AS value FROM full_ f LEFT JOIN i ON f.r = i.r AND f.c = i.c')
def rasterize_const(spark, d):
    cells = tiles.empty_grid(spark, GRID)
    hit = zonal.join_zones(cells, zones(spark, d).select("fid", "c0", "r0", "w", "h")).select(*CELL).distinct().withColumn("value", F.lit(1.0))
    return cells.join(hit, CELL, "left").fillna(0.0, ["value"])


@query("rasterize_attr", with_("full_", "zones") + f', i AS (SELECT f.r, f.c, max_by(s_acctbal, fid) AS v FROM full_ f JOIN zones ON f.c >= c0 AND f.c < c0 + w AND f.r >= r0 AND f.r < r0 + h GROUP BY 1, 2) SELECT f.r AS "row", f.c AS col, coalesce(v, 0.0) AS value FROM full_ f LEFT JOIN i ON f.r = i.r AND f.c = i.c')
def rasterize_attr(spark, d):
    cells = tiles.empty_grid(spark, GRID)
    hit = zonal.join_zones(cells, zones(spark, d).select("fid", "c0", "r0", "w", "h", "s_acctbal")).groupBy(*CELL).agg(F.max_by("s_acctbal", "fid").alias("value"))
    return cells.join(hit, CELL, "left").fillna(0.0, ["value"])


@query("paint_labels", with_("zpix") + 'SELECT r AS "row", c AS col, max_by(w * 10 + h, fid) AS label FROM zpix GROUP BY 1, 2')
def paint_labels(spark, d):
    own = zonal.join_zones(grid(spark, d).select(*CELL), zones(spark, d).select("fid", "c0", "r0", "w", "h"))
    return kernels.paint(own.select(*CELL, "fid", (F.col("w") * 10 + F.col("h")).alias("label")), F.col("fid"))


@query("extent_semi", with_("zones") + "SELECT fid FROM zones WHERE c0 < 64 AND c0 + w > 0 AND r0 < 64 AND r0 + h > 0")
def extent_semi(spark, d):
    return zones(spark, d).where(f"c0 < {GRID.width} and c0 + w > 0 and r0 < {GRID.height} and r0 + h > 0").select("fid")


@query("extent_anti", with_("zones") + "SELECT fid FROM zones WHERE NOT (c0 < 64 AND c0 + w > 0 AND r0 < 64 AND r0 + h > 0)")
def extent_anti(spark, d):
    return zones(spark, d).where(f"not (c0 < {GRID.width} and c0 + w > 0 and r0 < {GRID.height} and r0 + h > 0)").select("fid")


@query("raster_extent", "SELECT 1000.0 AS xmin, 4360.0 AS ymin, 1640.0 AS xmax, 5000.0 AS ymax")
def raster_extent(spark, d):
    g = Grid()
    return spark.range(1).select(F.lit(g.x0).alias("xmin"), F.lit(g.y0 + g.py * g.height).alias("ymin"), F.lit(g.x0 + g.px * g.width).alias("xmax"), F.lit(g.y0).alias("ymax"))


@query("layer_extent", with_("zones") + "SELECT 1000.0 + min(c0) * 10.0 AS xmin, 5000.0 - max(r0 + h) * 10.0 AS ymin, 1000.0 + max(c0 + w) * 10.0 AS xmax, 5000.0 - min(r0) * 10.0 AS ymax FROM zones")
def layer_extent(spark, d):
    from .base import rectangles

    return rectangles(spark, d).agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


@query("colorscale", with_("grid") + f', m AS (SELECT b4, count(*) AS area FROM grid GROUP BY b4) SELECT {RC}, CASE WHEN g.b4 = 0 THEN 0 ELSE area END AS area FROM grid g JOIN m ON g.b4 = m.b4')
def colorscale(spark, d):
    g = grid(spark, d)
    return g.join(g.groupBy("b4").agg(F.count("*").alias("area")), "b4").select(*CELL, F.when(F.col("b4") == 0, 0).otherwise(F.col("area")).alias("area"))


@query("zone_orientation", with_("zpix") + f", m AS (SELECT fid, var_pop(r) AS a, var_pop(c) AS b, covar_pop(r, c) AS k FROM zpix WHERE b4 > 1 GROUP BY fid) SELECT fid, CASE WHEN abs(a - b) + abs(k) < 1e-12 THEN 0.0 ELSE round(0.5 * atan2(2 * (round(k, 9) + 0.0), round(a - b, 9) + 0.0), 5) + 0.0 END AS orientation FROM m")
def zone_orientation(spark, d):
    cells = zonal.join_zones(grid(spark, d).where("b4 > 1"), zones(spark, d).select("fid", "c0", "r0", "w", "h"))
    m = cells.groupBy("fid").agg(F.var_pop("row").alias("a"), F.var_pop("col").alias("b"), F.covar_pop("row", "col").alias("k"))
    angle = F.when(F.abs(F.col("a") - F.col("b")) + F.abs("k") < 1e-12, 0.0).otherwise(F.round(0.5 * F.atan2(2 * (F.round("k", 9) + 0.0), F.round(F.col("a") - F.col("b"), 9) + 0.0), 5) + 0.0)
    return m.select("fid", angle.alias("orientation"))


@query("image_angle", with_("grid") + ", m AS (SELECT var_pop(r) AS a, var_pop(c) AS b, covar_pop(r, c) AS k FROM grid WHERE b4 = 3), o AS (SELECT 0.5 * atan2(2 * k, a - b) AS t FROM m) SELECT round(t, 5) AS first, round(t + pi() / 2, 5) AS second FROM o")
def image_angle(spark, d):
    m = geometry.moments(grid(spark, d).where("b4 = 3").withColumn("g", F.lit(1)), ["g"])
    return m.select(F.round("orientation", 5).alias("first"), F.round(F.col("orientation") + F.lit(3.141592653589793) / 2, 5).alias("second"))


# --- points ---


@query("point_sample", with_("points", "grid") + "SELECT pid, b1 AS sampled FROM points LEFT JOIN grid ON c = CAST(trunc((x - 1000) / 10) AS INT) AND r = CAST(trunc((y - 5000) / -10) AS INT)")
def point_sample(spark, d):
    return geometry.sample_points(points(spark, d), grid(spark, d), GRID, ["b1"]).select("pid", F.col("b1").alias("sampled"))


@query("point_stack", with_("points", "grid") + "SELECT pid, coalesce(b1, 0) AS b1, coalesce(b2, 0) AS b2, coalesce(b3, 0) AS b3 FROM points LEFT JOIN grid ON c = CAST(trunc((x - 1000) / 10) AS INT) AND r = CAST(trunc((y - 5000) / -10) AS INT) AND b4 <> 2")
def point_stack(spark, d):
    return geometry.sample_points(points(spark, d), grid(spark, d).where("b4 <> 2"), GRID, ["b1", "b2", "b3"]).fillna(0.0, ["b1", "b2", "b3"]).select("pid", "b1", "b2", "b3")


@query("point_sample_inside", with_("points", "grid") + "SELECT pid, b2 AS sampled FROM points LEFT JOIN grid ON c = CAST(trunc((x - 1000) / 10) AS INT) AND r = CAST(trunc((y - 5000) / -10) AS INT) WHERE x >= 1000 AND x < 1320 AND y >= 4680 AND y < 5000")
def point_sample_inside(spark, d):
    half = Grid(width=32, height=32)
    return geometry.sample_points(geometry.inside_extent(points(spark, d), half), grid(spark, d), GRID, ["b2"]).select("pid", F.col("b2").alias("sampled"))


# --- kernels by zone ---


@query("otsu_threshold", with_("zpix") + ", h AS (SELECT fid, b3 AS v, count(*) AS n FROM zpix GROUP BY 1, 2), p AS (SELECT fid, v, sum(n) OVER u AS w0, sum(v * n) OVER u AS s0, sum(n) OVER a AS w, sum(v * n) OVER a AS s FROM h WINDOW u AS (PARTITION BY fid ORDER BY v), a AS (PARTITION BY fid)), g AS (SELECT fid, v, CASE WHEN w > w0 THEN round(w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)), 6) END AS g FROM p), o AS (SELECT fid, v, row_number() OVER (PARTITION BY fid ORDER BY g DESC NULLS LAST, v) AS i FROM g) SELECT fid, v AS threshold FROM o WHERE i = 1")
def otsu_threshold(spark, d):
    cells = zonal.join_zones(grid(spark, d), zones(spark, d).select("fid", "c0", "r0", "w", "h"))
    return kernels.otsu(cells, "b3", ["fid"])


for _algo in ("otsu", "niblack", "sauvola"):

    @query("thresh_seg" if _algo == "otsu" else f"thresh_seg_{_algo}")
    def thresh_seg(spark, d, algo=_algo):
        """Objects of each zone by a threshold, small holes filled and small objects dropped."""
        return kernels.by_zone(grid(spark, d), zones(spark, d), "b1", lambda a: kernels.threshold_array(a, algo, 2))


@query("level_set")
def level_set(spark, d):
    return kernels.by_zone(grid(spark, d), zones(spark, d), "b1", kernels.level_set)


@query("snake")
def snake(spark, d):
    return kernels.by_zone(grid(spark, d), zones(spark, d), "b1", kernels.snake)


@query("toposeg")
def toposeg(spark, d):
    return kernels.by_zone(grid(spark, d), zones(spark, d), "b1", kernels.seeded_segments)


@query("toposnakes")
def toposnakes(spark, d):
    return kernels.by_zone(grid(spark, d), zones(spark, d), "b4", lambda a: kernels.topology_level_set(a, kernels.regions(a > 1)))


