"""Queries over neighbourhoods, regions, geometry, attributes and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import components, focal, geometry, kernels, tiles, tseries
from .base import GRID, cube, dense, diamond_rings, grid, points, query, rectangles, table, with_, zones

RC = 'r AS "row", c AS col'
CELL = ["row", "col"]
NEAR = "JOIN dense b ON abs(a.r - b.r) <= {k} AND abs(a.c - b.c) <= {k}"


# --- neighbourhoods ---


@query("focal_mean3", with_("dense") + f'SELECT a.r AS "row", a.c AS col, round(avg(b.b1), 6) AS value FROM dense a {NEAR.format(k=1)} GROUP BY 1, 2')
def focal_mean3(spark, d):
    return focal.box_mean(dense(spark, d), "b1", 3).select(*CELL, r6(F.col("mean")).alias("value"))


@query(
    "multitemp_filter",
    with_("cube")
    + ", e AS (SELECT band, min(value) AS lo, max(value) AS hi FROM cube GROUP BY band), s AS (SELECT r, c, band, (value - lo) / (hi - lo) * 255 AS v FROM cube JOIN e USING (band)), "
    + "l AS (SELECT a.r, a.c, a.band, max(a.v) AS v, avg(b.v) AS m FROM s a JOIN s b ON a.band = b.band AND abs(a.r - b.r) <= 3 AND abs(a.c - b.c) <= 3 GROUP BY 1, 2, 3), "
    + f"q AS (SELECT *, avg(CASE WHEN m > 0 THEN v / m END) OVER (PARTITION BY r, c) AS ratio FROM l) SELECT {RC}, band, round(m * coalesce(ratio, 0), 6) + 0.0 AS value FROM q",
)
def multitemp_filter(spark, d):
    return focal.multitemp_filter(cube(spark, d)).withColumn("value", r6(F.col("value")))


_N = ", ".join(f"max(CASE WHEN b.r - a.r = {r} AND b.c - a.c = {c} THEN b.b1 END) AS {n}" for n, (r, c) in zip("abcdefghi", focal.square(3)))
NINE = with_("dense") + f", n AS (SELECT a.r, a.c AS cc, {_N.replace(' AS c,', ' AS c_,')} FROM dense a {NEAR.format(k=1)} GROUP BY 1, 2 HAVING count(*) = 9), g AS (SELECT *, ((c_ + 2 * f + i) - (a + 2 * d + g)) / 80.0 AS gx, ((g + 2 * h + i) - (a + 2 * b + c_)) / 80.0 AS gy FROM n) "
_TERRAIN = {
    "dem_slope": ("slope", "degrees(atan(sqrt(gx * gx + gy * gy)))"),
    "dem_aspect": ("aspect", "CASE WHEN sqrt(gx * gx + gy * gy) = 0 THEN -9999.0 WHEN 90 - degrees(atan2(gy, -gx)) < 0 THEN 450 - degrees(atan2(gy, -gx)) WHEN 90 - degrees(atan2(gy, -gx)) >= 360 THEN 0 ELSE 90 - degrees(atan2(gy, -gx)) END"),
    "dem_hillshade": ("hillshade", "greatest(0.0, 255 * (sin(radians(45)) - cos(radians(45)) * (-gy * cos(radians(315)) + gx * sin(radians(315)))) / sqrt(1 + gx * gx + gy * gy))"),
    "dem_tri": ("tri", "(abs(a - e) + abs(b - e) + abs(c_ - e) + abs(d - e) + abs(f - e) + abs(g - e) + abs(h - e) + abs(i - e)) / 8"),
    "dem_tpi": ("tpi", "e - (a + b + c_ + d + f + g + h + i) / 8"),
    "dem_roughness": ("roughness", "greatest(a, b, c_, d, e, f, g, h, i) - least(a, b, c_, d, e, f, g, h, i)"),
}
for _key, (_name, _sql) in _TERRAIN.items():

    @query(_key, NINE + f'SELECT r AS "row", cc AS col, round({_sql}, 6) + 0.0 AS {_name} FROM g')
    def terrain(spark, d, name=_name):
        return focal.terrain(dense(spark, d), "b1", GRID.px).select(*CELL, r6(F.col(name)).alias(name))


@query("dem_scale_lat", "SELECT n_nationkey, round(111320.0 * cos(radians(n_nationkey * 2.5)), 6) AS metres, round(1 / (111320.0 * cos(radians(n_nationkey * 2.5))), 12) AS z FROM nation")
def dem_scale_lat(spark, d):
    s, z = focal.latitude_scale(F.col("n_nationkey") * 2.5)
    return table(spark, d, "nation").select("n_nationkey", F.round(s, 6).alias("metres"), F.round(z, 12).alias("z"))


@query("fill_nodata", with_("dense") + ', f AS (SELECT a.r, a.c, sum(b.b4 / sqrt((a.r - b.r) ^ 2 + (a.c - b.c) ^ 2)) / sum(1 / sqrt((a.r - b.r) ^ 2 + (a.c - b.c) ^ 2)) AS v FROM dense a JOIN dense b ON abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2 AND (a.r - b.r) ^ 2 + (a.c - b.c) ^ 2 BETWEEN 1 AND 4 WHERE a.b4 = 0 AND b.b4 <> 0 GROUP BY 1, 2) SELECT dense.r AS "row", dense.c AS col, round(CASE WHEN b4 = 0 THEN coalesce(v, 0) ELSE b4 END, 6) AS value FROM dense LEFT JOIN f ON dense.r = f.r AND dense.c = f.c')
def fill_nodata(spark, d):
    return focal.fill_nodata(dense(spark, d).select(*CELL, "b4"), "b4", 2).select(*CELL, r6(F.col("b4")).alias("value"))


@query("sobel", NINE + 'SELECT r AS "row", cc AS col, round(sqrt((gx * gx + gy * gy) * 400 / 2), 6) AS magnitude FROM g')
def sobel(spark, d):
    return focal.sobel(dense(spark, d), "b1").select(*CELL, r6(F.col("magnitude")).alias("magnitude"))


@query(
    "nms",
    NINE
    + ", t AS (SELECT r, cc, b, d, f, h, a, c_, g, i, e, degrees(atan2(n_y, n_x)) AS deg FROM (SELECT *, e - d AS n_x, e - b AS n_y FROM g)), u AS (SELECT *, CASE WHEN deg < 0 THEN deg + 180 ELSE deg END AS an FROM t) "
    + 'SELECT r AS "row", cc AS col, CASE WHEN e >= CASE WHEN an < 22.5 OR an >= 157.5 THEN f WHEN an < 67.5 THEN g WHEN an < 112.5 THEN h ELSE a END AND e >= CASE WHEN an < 22.5 OR an >= 157.5 THEN d WHEN an < 67.5 THEN c_ WHEN an < 112.5 THEN b ELSE i END THEN e ELSE 0 END AS value FROM u',
)
def nms(spark, d):
    n = focal.neighbourhood(dense(spark, d), "b1", focal.square(3)).na.drop()
    g = n.select(*CELL, (F.col("n_0_0") - F.col("n_0_m1")).alias("gx"), (F.col("n_0_0") - F.col("n_m1_0")).alias("gy"))
    wide = dense(spark, d).select(*CELL, "b1").join(g, CELL, "left").fillna(0.0, ["gx", "gy"])
    return focal.non_maximum(wide, "b1", "gx", "gy").join(g.select(*CELL), CELL, "left_semi")


CROSS_ON = "abs(a.r - b.r) + abs(a.c - b.c) <= 1"


@query("morph_close", with_("dense") + f', x AS (SELECT a.r, a.c, max(b.b4) AS v FROM dense a JOIN dense b ON {CROSS_ON} GROUP BY 1, 2) SELECT a.r AS "row", a.c AS col, min(b.v) AS value FROM x a JOIN x b ON {CROSS_ON} GROUP BY 1, 2')
def morph_close(spark, d):
    return focal.close_gaps(dense(spark, d).select(*CELL, F.col("b4").alias("value")), "value")


@query("morph_dilate", with_("dense") + f'SELECT a.r AS "row", a.c AS col, max(b.b4) AS value FROM dense a {NEAR.format(k=2)} GROUP BY 1, 2')
def morph_dilate(spark, d):
    return focal.dilate(dense(spark, d).select(*CELL, F.col("b4").alias("value")), "value", focal.square(5))


@query("perimeter_mask", with_("dense") + f'SELECT a.r AS "row", a.c AS col FROM dense a JOIN dense b ON {CROSS_ON} WHERE a.b4 <> 0 GROUP BY 1, 2 HAVING count(*) FILTER (b.b4 <> 0) < 5')
def perimeter_mask(spark, d):
    return focal.perimeter(dense(spark, d), "b4")


_SMOOTH = "SELECT {t}.r, {t}.c, sum(b.{v} * w) / sum(w) AS v FROM {t} CROSS JOIN w JOIN {t} b ON b.r = {t}.r + {dr} AND b.c = {t}.c + {dc} GROUP BY 1, 2"


@query(
    "gaussian",
    with_("dense")
    + ", w AS (SELECT k, exp(-0.5 * k * k) AS w FROM (SELECT unnest(range(-4, 5)) AS k)), "
    + f"down AS ({_SMOOTH.format(t='dense', v='b1', dr='k', dc=0)}), across AS ({_SMOOTH.format(t='down', v='v', dr=0, dc='k')}) SELECT {RC}, round(v, 6) + 0.0 AS b1 FROM across",
)
def gaussian(spark, d):
    return focal.gaussian(dense(spark, d), "b1", 1.0).withColumn("b1", r6(F.col("b1")))


@query("canny")
def canny(spark, d):
    return kernels.by_tile(dense(spark, d), "b1", 32, kernels.canny, halo=8)


@query("edt_bounded", with_("dense") + ', n AS (SELECT a.r, a.c, min((a.r - b.r) ^ 2 + (a.c - b.c) ^ 2) AS d FROM dense a JOIN dense b ON abs(a.r - b.r) <= 4 AND abs(a.c - b.c) <= 4 WHERE b.b4 = 0 AND (a.r - b.r) ^ 2 + (a.c - b.c) ^ 2 <= 16 GROUP BY 1, 2) SELECT x.r AS "row", x.c AS col, round(sqrt(d) * 10.0, 6) AS distance FROM dense x LEFT JOIN n ON x.r = n.r AND x.c = n.c')
def edt_bounded(spark, d):
    return focal.nearest_distance(dense(spark, d), "b4", 4, GRID.px).select(*CELL, r6(F.col("distance")).alias("distance"))


@query("local_max", with_("dense") + f'SELECT a.r AS "row", a.c AS col, max(a.b1) AS value FROM dense a {NEAR.format(k=2)} GROUP BY 1, 2 HAVING max(a.b1) = max(b.b1) AND max(a.b1) > 0')
def local_max(spark, d):
    return focal.local_maxima(dense(spark, d), "b1", 2)


# --- regions ---

REACH = """WITH RECURSIVE grid AS (SELECT CAST(l_orderkey % 64 AS INT) AS r, CAST(l_partkey % 64 AS INT) AS c, sum(l_quantity) AS b1, max(l_linenumber) AS b3, sum(l_quantity) % 4 AS b4 FROM lineitem GROUP BY 1, 2),
cells AS (SELECT r, c, {v} AS v, r * 64 + c AS id FROM grid WHERE {v} <> 0),
links AS (SELECT a.id AS x, b.id AS y FROM cells a JOIN cells b ON abs(a.r - b.r) + abs(a.c - b.c) = 1 AND a.v = b.v),
reach AS (SELECT id AS x, id AS y FROM cells UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
comp AS (SELECT x AS id, min(y) AS component FROM reach GROUP BY x) """
PRODUCT = "CASE WHEN b4 >= 2 AND b3 >= 7 THEN 1.0 ELSE 0.0 END"


@query("components", REACH.format(v="b4") + f"SELECT {RC}, v AS value, CAST(component AS BIGINT) AS component FROM cells JOIN comp USING (id)")
def components_(spark, d):
    return components.components(grid(spark, d), "b4", GRID.width, 16)


@query("component_stats", REACH.format(v="b4") + "SELECT CAST(component AS BIGINT) AS component, max(v) AS value, count(*) AS cells, min(r) AS row_min, max(r) AS row_max, min(c) AS col_min, max(c) AS col_max FROM cells JOIN comp USING (id) GROUP BY 1")
def component_stats(spark, d):
    return components.component_stats(components_(spark, d))


@query("area_filter", REACH.format(v="b4") + "SELECT CAST(component AS BIGINT) AS component, count(*) * 100.0 AS area FROM comp GROUP BY 1 HAVING count(*) * 100.0 > 300")
def area_filter(spark, d):
    return components.component_stats(components_(spark, d)).select("component", (F.col("cells") * 100.0).alias("area")).where("area > 300")


@query("combine_grid", REACH.format(v=PRODUCT) + "SELECT CAST(component AS BIGINT) AS component, count(*) AS cells FROM comp GROUP BY 1 HAVING count(*) >= 2")
def combine_grid(spark, d):
    g = grid(spark, d)
    a, b = g.select(*CELL, (F.col("b4") >= 2).cast("double").alias("x")), g.select(*CELL, (F.col("b3") >= 7).cast("double").alias("y"))
    both = a.join(b, CELL).select(*CELL, (F.col("x") * F.col("y")).alias("v"))
    return components.component_stats(components.components(both, "v", GRID.width, 16)).select("component", "cells").where("cells >= 2")


@query("polygonize_rings")
def polygonize_rings(spark, d):
    return components.polygonize(components_(spark, d))


@query("relabel_sequential", with_("grid") + f", k AS (SELECT DISTINCT b1 AS b FROM grid WHERE b1 > 200), n AS (SELECT b, row_number() OVER (ORDER BY b) AS i FROM k) SELECT {RC}, CAST(coalesce(i, 0) AS INT) AS label FROM grid LEFT JOIN n ON b1 = b")
def relabel_sequential(spark, d):
    return kernels.relabel(grid(spark, d).select(*CELL, F.when(F.col("b1") > 200, F.col("b1")).otherwise(0.0).alias("label")))


RAG = with_("grid") + ", p AS (SELECT a.b4 AS x, b.b4 AS y, (a.b1 + b.b1) / 2 AS w FROM grid a JOIN grid b ON (a.r = b.r AND a.c + 1 = b.c) OR (a.c = b.c AND a.r + 1 = b.r) WHERE a.b4 <> b.b4) "


@query("rag_edges", RAG + "SELECT least(x, y) AS src, greatest(x, y) AS dst, round(avg(w), 6) AS weight, count(*) AS n FROM p GROUP BY 1, 2")
def rag_edges(spark, d):
    g = grid(spark, d).withColumn("label", F.col("b4"))
    return kernels.adjacency(g, "b1").withColumn("weight", r6(F.col("weight")))


@query("rag_merge")
def rag_merge(spark, d):
    regions = components_(spark, d).join(grid(spark, d).select(*CELL, "b1"), CELL).withColumnRenamed("component", "label")
    return kernels.merge_regions(kernels.adjacency(regions, "b1"), 250.0)


@query("threshold_sweep", with_("grid") + "SELECT CAST(l AS INT) AS level, count(*) FILTER (b2 > l) AS n FROM grid, range(0, 40) AS t(l) GROUP BY 1")
def threshold_sweep(spark, d):
    return kernels.threshold_sweep(grid(spark, d), "b2", 40)


ANGLES = [0, 30, 45, 60, 90, 120, 135, 150]


@query("hough_votes", with_("grid") + f", v AS (SELECT theta, CAST(floor(c * round(cos(radians(theta)), 9) + r * round(sin(radians(theta)), 9) + 0.000001 + 0.5) AS INT) AS rho FROM grid, (SELECT unnest({ANGLES}) AS theta) WHERE b4 = 3) SELECT theta, rho, count(*) AS votes FROM v GROUP BY 1, 2")
def hough_votes(spark, d):
    return kernels.hough_votes(grid(spark, d).withColumn("m", (F.col("b4") == 3).cast("int")), "m", ANGLES)


@query("strip_lsq_line", with_("grid") + "SELECT CAST(r // 8 AS INT) AS strip, round(regr_slope(r, c), 6) + 0.0 AS slope, round(regr_intercept(r, c), 6) AS intercept, count(*) AS n FROM grid WHERE b4 <> 0 GROUP BY 1")
def strip_lsq_line(spark, d):
    return kernels.strip_lines(grid(spark, d), "b4", 8).select("strip", r6(F.col("slope")).alias("slope"), r6(F.col("intercept")).alias("intercept"), "n")


@query("ransac_lines")
def ransac_lines(spark, d):
    return kernels.ransac_strips(grid(spark, d), "b4", 8)


@query("phasecong")
def phasecong(spark, d):
    return kernels.by_tile(dense(spark, d), "b1", 64, kernels.phase_congruency)


@query("template_corr", with_("dense") + ", t AS (SELECT r - 5 AS tr, c - 7 AS tc, b1 AS t FROM dense WHERE r BETWEEN 5 AND 7 AND c BETWEEN 7 AND 9), p AS (SELECT r - tr AS y, c - tc AS x, b1 AS v, t FROM dense, t) SELECT CAST(y AS INT) AS \"row\", CAST(x AS INT) AS col, round(corr(v, t), 6) + 0.0 AS r FROM p GROUP BY 1, 2 HAVING count(*) = 9")
def template_corr(spark, d):
    g = dense(spark, d)
    t = g.where("row between 5 and 7 and col between 7 and 9").select((F.col("row") - 5).alias("tr"), (F.col("col") - 7).alias("tc"), F.col("b1").alias("t"))
    return kernels.template_scores(g, t, "b1").withColumn("r", r6(F.col("r")))


# --- geometry ---


def _shape(name: str, sql: str, props: list[str], columns: list[str]):
    @query(name, with_("zones") + f"SELECT fid, {sql} FROM zones")
    def run(spark, d):
        return geometry.shape_props(rectangles(spark, d), props).select("fid", *[r6(F.col(c)).alias(c) for c in columns])


_shape("geom_area", "w * h * 100.0 AS Area", ["Area"], ["Area"])
_shape("geom_perimeter", "(w + h) * 20.0 AS Perim", ["Perimeter"], ["Perim"])
_shape("geom_axes", "greatest(w, h) * 10.0 AS MjAxis, least(w, h) * 10.0 AS MnAxis", ["MajorAxisLength", "MinorAxisLength"], ["MjAxis", "MnAxis"])
_shape("geom_eccentricity", "round(least(w, h) / greatest(w, h), 6) AS Eccen", ["Eccentricity"], ["Eccen"])
_shape("geom_solidity", "1.0 AS Solid", ["Solidity"], ["Solid"])
_shape("geom_avgwidth", "round(4 * w * h * 100.0 / ((w + h) * 20.0), 6) AS AvWidth", ["AverageWidth"], ["AvWidth"])
_shape("geom_centroid", "1000 + (c0 + w / 2) * 10.0 AS cx, 5000 - (r0 + h / 2) * 10.0 AS cy", ["Centroid"], ["cx", "cy"])


@query("geom_extent", with_("diamonds") + "SELECT fid, 0.5 AS Extent, 2.0 * w * h AS Area, round(4 * sqrt(w * w + h * h), 6) AS Perim FROM diamonds")
def geom_extent(spark, d):
    out = geometry.shape_props(diamond_rings(spark, d), ["Extent", "Area", "Perimeter"])
    return out.select("fid", *[r6(F.col(c)).alias(c) for c in ("Extent", "Area", "Perim")])


@query("min_rect")
def min_rect(spark, d):
    m = diamond_rings(spark, d).withColumn("m", geometry.hull_measures("ring"))
    return m.select("fid", *[r6(F.col(f"m.{c}")).alias(c) for c in ("short", "long", "angle", "hull_area")])


@query("pixel_offsets", with_("zones") + "SELECT fid, CAST(c0 AS INT) AS xoff, CAST(r0 AS INT) AS yoff, w AS xcount, h AS ycount FROM zones")
def pixel_offsets(spark, d):
    return geometry.pixel_offsets(rectangles(spark, d), GRID).select("fid", "xoff", "yoff", "xcount", "ycount")


@query("pixel_bbox", with_("zones") + "SELECT 'grid.tif' AS image_path, c0 AS xmin, r0 AS ymin, c0 + w AS xmax, r0 + h AS ymax, s_nationkey AS label FROM zones")
def pixel_bbox(spark, d):
    z = geometry.pixel_offsets(rectangles(spark, d), GRID).join(zones(spark, d).select("fid", "s_nationkey"), "fid")
    return z.select(F.lit("grid.tif").alias("image_path"), F.col("xoff").alias("xmin"), F.col("yoff").alias("ymin"), (F.col("xoff") + F.col("xcount")).alias("xmax"), (F.col("yoff") + F.col("ycount")).alias("ymax"), F.col("s_nationkey").alias("label"))


@query("raster2points", with_("grid") + "SELECT row_number() OVER (ORDER BY r, c) AS fid, 1000.0 + c * 10 AS x, 5000.0 - r * 10 AS y, b4 AS value FROM grid WHERE b4 NOT IN (0, 2)")
def raster2points(spark, d):
    return geometry.pixel_points(grid(spark, d), GRID, "b4", [0, 2])


@query("pixel_mesh", with_("full_") + "SELECT CAST(r * 64 + c + 1 AS BIGINT) AS fid, 1000.0 + c * 10 AS xmin, 4990.0 - r * 10 AS ymin, 1010.0 + c * 10 AS xmax, 5000.0 - r * 10 AS ymax FROM full_")
def pixel_mesh(spark, d):
    m = geometry.pixel_mesh(tiles.empty_grid(spark, GRID), GRID)
    return m.select("fid", *[e.alias(n) for n, e in zip(("xmin", "ymin", "xmax", "ymax"), geometry.bounds(F.col("ring")))])


@query("meshgrid", "SELECT i // 11 * 11 + i % 11 + 1 AS fid, round(1000 + (i // 11 + 0.5) * 60, 6) AS cx, round(5000 - (i % 11 + 0.5) * 60, 6) AS cy FROM range(0, 121) AS t(i)")
def meshgrid(spark, d):
    m = geometry.mesh(spark, 1000.0, 4360.0, 1640.0, 5000.0, 60.0)
    cx, cy = geometry.centroid(F.col("ring"))
    return m.select("fid", r6(cx).alias("cx"), r6(cy).alias("cy"))


@query("buffer_bbox", with_("zones") + "SELECT fid, 975.0 + c0 * 10 AS xmin, 4975.0 - (r0 + h) * 10 AS ymin, 1025.0 + (c0 + w) * 10 AS xmax, 5025.0 - r0 * 10 AS ymax FROM zones")
def buffer_bbox(spark, d):
    return geometry.buffer_box(rectangles(spark, d), 25.0).select("fid", "xmin", "ymin", "xmax", "ymax")


@query("buffer_point", with_("points") + "SELECT pid, round(0.5 * 64 * 25 * sin(2 * pi() / 64), 6) AS area, round(64 * 2 * 5 * sin(pi() / 64), 6) AS perim FROM points")
def buffer_point(spark, d):
    b = geometry.buffer_point(points(spark, d), 5.0)
    return b.select("pid", r6(geometry.area(F.col("ring"))).alias("area"), r6(geometry.perimeter(F.col("ring"))).alias("perim"))


@query("clip_poly", with_("zones") + "SELECT a.fid, b.fid AS clip_fid, 1000.0 + greatest(a.c0, b.c0) * 10 AS xmin, 5000.0 - least(a.r0 + a.h, b.r0 + b.h) * 10 AS ymin, 1000.0 + least(a.c0 + a.w, b.c0 + b.w) * 10 AS xmax, 5000.0 - greatest(a.r0, b.r0) * 10 AS ymax FROM zones a JOIN zones b ON a.fid % 2 = 0 AND b.fid % 2 = 1 AND greatest(a.c0, b.c0) < least(a.c0 + a.w, b.c0 + b.w) AND greatest(a.r0, b.r0) < least(a.r0 + a.h, b.r0 + b.h)")
def clip_poly(spark, d):
    z = rectangles(spark, d)
    return geometry.overlay_boxes(z.where("fid % 2 = 0"), z.where("fid % 2 = 1"), 160.0)


@query("clip_rings")
def clip_rings(spark, d):
    """Diamonds clipped to the diamond of the next zone, as general convex polygons."""
    a = diamond_rings(spark, d)
    b = a.select((F.col("fid") - 1).alias("fid"), F.col("ring").alias("other"))
    return a.join(b, "fid").select("fid", r6(geometry.area(geometry.clip_ring("ring", "other"))).alias("area"))


@query("to_geojson", with_("zones") + """SELECT fid, '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[' || list_aggregate(list_transform([[c0, r0 + h], [c0, r0], [c0 + w, r0], [c0 + w, r0 + h], [c0, r0 + h]], lambda p: '[' || CAST(1000.0::DOUBLE + p[1] * 10 AS VARCHAR) || ',' || CAST(5000.0::DOUBLE - p[2] * 10 AS VARCHAR) || ']'), 'string_agg', ',') || ']]},"properties":{"fid":' || fid || '}}' AS feature FROM zones""")
def to_geojson(spark, d):
    return geometry.geojson(rectangles(spark, d))


@query("geom_json", with_("points") + """SELECT pid, '{"type":"Point","coordinates":[' || CAST(x::DOUBLE AS VARCHAR) || ',' || CAST(y::DOUBLE AS VARCHAR) || ']}' AS geometry FROM points""")
def geom_json(spark, d):
    return points(spark, d).select("pid", F.to_json(F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))).alias("geometry"))


# --- attributes ---


@query("sql_filter", with_("zones") + "SELECT fid, w * h AS cells FROM zones WHERE w > 4 AND s_acctbal BETWEEN 0 AND 5000")
def sql_filter(spark, d):
    return spark.sql("SELECT fid, w * h AS cells FROM {z} WHERE w > 4 AND s_acctbal BETWEEN 0 AND 5000", z=zones(spark, d))


@query("filter_label", with_("zones") + "SELECT fid, CASE WHEN w * h > 20 THEN 'large' END AS label FROM zones")
def filter_label(spark, d):
    return zones(spark, d).select("fid", F.when(F.expr("w * h > 20"), "large").alias("label"))


@query("const_field", with_("zones") + "SELECT fid, 'field' AS kind FROM zones")
def const_field(spark, d):
    return zones(spark, d).select("fid", F.lit("field").alias("kind"))


@query("id_field", with_("zones") + "SELECT fid, row_number() OVER (ORDER BY fid) - 1 AS id FROM zones WHERE w > 3")
def id_field(spark, d):
    return tiles.sequential(zones(spark, d).where("w > 3").select("fid"), F.expr("fid div 1024"), ["fid"], "id")


# --- series ---

MONTHS = [f"value-24-{m:02d}" for m in range(1, 7)]


def site_columns(spark, d):
    """One row a site with a column for each month: the events' mean, at a made-up month of each event."""
    e = table(spark, d, "events").select((F.col("user_id") % 20).alias("site"), (F.col("event_id") % 6 + 1).alias("m"), "value")
    return e.groupBy("site").agg(*[F.round(F.avg(F.when(F.col("m") == i + 1, F.col("value"))), 6).alias(c) for i, c in enumerate(MONTHS)])


SITES = "WITH sites AS (SELECT user_id % 20 AS site, CAST(event_id % 6 + 1 AS INT) AS m, round(avg(value), 6) AS value FROM events GROUP BY 1, 2), dated AS (SELECT site, last_day(make_date(2024, m, 1)) AS date, value FROM sites) "


@query("extract_by_date", SITES + "SELECT site, " + ", ".join(f"max(CASE WHEN m = {m} THEN value END) AS \"value-24-{m:02d}\"" for m in (2, 3, 4)) + " FROM sites GROUP BY site")
def extract_by_date(spark, d):
    return tseries.extract_by_date(site_columns(spark, d), "site", MONTHS, "2024-02-01", "2024-04-30", "value")


@query("ts_group", SITES + "SELECT site, CAST(date AS VARCHAR) AS date, value FROM dated WHERE site IN (1, 3, 5) AND year(date) = 2024")
def ts_group(spark, d):
    long = tseries.to_long(site_columns(spark, d), "site", MONTHS).where(F.col("site").isin(1, 3, 5) & (F.year("date") == 2024))
    return long.select("site", F.col("date").cast("string").alias("date"), "value")


@query("ts_band_stats", SITES + "SELECT CAST(date AS VARCHAR) AS date, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS lo, max(value) AS hi, round(avg(value) + 2 * stddev_pop(value), 6) AS upper, round(avg(value) - 2 * stddev_pop(value), 6) + 0.0 AS lower FROM dated GROUP BY 1")
def ts_band_stats(spark, d):
    out = tseries.band_stats(tseries.to_long(site_columns(spark, d), "site", MONTHS))
    return out.select(F.col("date").cast("string").alias("date"), *[r6(F.col(c)).alias(c) for c in ("mean", "median", "lo", "hi", "upper", "lower")])


@query("ts_stage", SITES + "SELECT stage, round(avg(value), 6) AS mean, count(*) AS n FROM dated JOIN (VALUES ('sown', DATE '2024-01-01', DATE '2024-02-29'), ('green', DATE '2024-03-01', DATE '2024-05-31')) AS s(stage, a, b) ON date BETWEEN a AND b GROUP BY stage")
def ts_stage(spark, d):
    spans = spark.sql("SELECT * FROM VALUES ('sown', DATE '2024-01-01', DATE '2024-02-29'), ('green', DATE '2024-03-01', DATE '2024-05-31') AS s(stage, first, last)")
    long = tseries.to_long(site_columns(spark, d), "site", MONTHS).where("value is not null")
    return tseries.stages(long, spans).groupBy("stage").agg(r6(F.avg("value")).alias("mean"), F.count("*").alias("n"))

