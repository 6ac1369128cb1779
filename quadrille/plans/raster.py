"""Queries over rasters: scans, algebra, masks, tiles, mosaics, stacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import algebra, depth, tiles
from .base import GRID, cube, dense, emb, grid, pixels, query, table, with_

RC = 'r AS "row", c AS col'
CELL = ["row", "col"]


@query("scan_raster", with_("pix") + f"SELECT {RC}, band, value FROM pix WHERE band IN (1, 3)")
def scan_raster(spark, d):
    return pixels(spark, d).where(F.col("band").isin(1, 3))


@query("scan_raster_wide", with_("grid") + f"SELECT {RC}, b2, b4 FROM grid")
def scan_raster_wide(spark, d):
    return algebra.to_wide(pixels(spark, d).where("band in (2, 4)"), [2, 4])


@query("window_read", with_("grid") + f"SELECT {RC}, b1, b2 FROM grid WHERE r BETWEEN 10 AND 25 AND c BETWEEN 20 AND 51")
def window_read(spark, d):
    return tiles.window(grid(spark, d), 10, 20, 16, 32).select(*CELL, "b1", "b2")


@query("bbox_georef", with_("grid") + "SELECT 1000.0 + min(c) * 10.0 AS x0, 5000.0 - min(r) * 10.0 AS y0, 10.0 AS px, -10.0 AS py, CAST(max(c) - min(c) + 1 AS INT) AS width, CAST(max(r) - min(r) + 1 AS INT) AS height FROM grid")
def bbox_georef(spark, d):
    g = grid(spark, d).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    return g.select(GRID.x_of(F.col("c0")).alias("x0"), GRID.y_of(F.col("r0")).alias("y0"), F.lit(10.0).alias("px"), F.lit(-10.0).alias("py"), (F.col("c1") - F.col("c0") + 1).alias("width"), (F.col("r1") - F.col("r0") + 1).alias("height"))


@query("empty_grid", with_("full_") + f"SELECT {RC}, CAST(0 AS INT) AS value FROM full_")
def empty_grid(spark, d):
    return tiles.empty_grid(spark, GRID).withColumn("value", F.lit(0))


@query("chip_origin", with_("grid") + "SELECT DISTINCT CAST(r // 24 AS INT) AS tile_row, CAST(c // 24 AS INT) AS tile_col, 1000.0 + (c // 24) * 24 * 10.0 AS x, 5000.0 - (r // 24) * 24 * 10.0 AS y, CAST(least(24, 64 - (r // 24) * 24) AS INT) AS n_rows, CAST(least(24, 64 - (c // 24) * 24) AS INT) AS n_cols FROM grid")
def chip_origin(spark, d):
    return tiles.tile_origin(grid(spark, d), GRID, 24)


@query("retile_overlap", with_("grid") + "SELECT CAST(tr AS INT) AS tile_row, CAST(tc AS INT) AS tile_col, count(*) AS cells, sum(b1) AS total FROM grid, range(0, 6) AS a(tr), range(0, 6) AS b(tc) WHERE r >= tr * 12 AND r < tr * 12 + 16 AND c >= tc * 12 AND c < tc * 12 + 16 GROUP BY 1, 2")
def retile_overlap(spark, d):
    return tiles.retile(grid(spark, d), GRID, 16, 4).groupBy("tile_row", "tile_col").agg(F.count("*").alias("cells"), F.sum("b1").alias("total"))


@query("band_names", with_("pix") + "SELECT band, name, sum(value) AS total FROM pix JOIN (VALUES (1, 'quantity'), (2, 'lines'), (3, 'number'), (4, 'class')) AS n(b, name) ON band = b GROUP BY 1, 2")
def band_names(spark, d):
    names = spark.range(1).select(F.posexplode(F.array(*map(F.lit, ("quantity", "lines", "number", "class")))).alias("pos", "name")).select((F.col("pos") + 1).alias("band"), "name")
    return pixels(spark, d).groupBy("band").agg(F.sum("value").alias("total")).join(F.broadcast(names), "band")  # a row a band


@query("resample_avg", with_("pix") + 'SELECT band, CAST(r // 4 AS INT) AS "row", CAST(c // 4 AS INT) AS col, round(avg(value), 6) AS value FROM pix GROUP BY 1, 2, 3')
def resample_avg(spark, d):
    return tiles.resample_mean(pixels(spark, d), 4).withColumn("value", r6(F.col("value")))


@query("resample_nearest", with_("pix") + 'SELECT band, CAST(r // 4 AS INT) AS "row", CAST(c // 4 AS INT) AS col, value FROM pix WHERE r % 4 = 2 AND c % 4 = 2')
def resample_nearest(spark, d):
    return tiles.resample_nearest(pixels(spark, d), 4)


STOPS = [(0, 0, 128), (0, 128, 255), (0, 255, 0), (255, 255, 0), (255, 128, 0), (255, 0, 0)]


def _ramp_sql() -> str:
    parts = []
    for k, name in enumerate(("red", "green", "blue")):
        at = "[" + ", ".join(f"{s[k]}.0::DOUBLE" for s in STOPS) + "]"
        parts.append(f"round({at}[i + 1] * (1 - f) + {at}[i + 2] * f, 6) AS {name}")
    return (
        with_("grid") + ", e AS (SELECT min(b1) AS lo, max(b1) AS hi FROM grid), p AS (SELECT r, c, CASE WHEN hi > lo THEN (b1 - lo) / (hi - lo) ELSE 0 END * 5 AS a FROM grid, e), "
        f"q AS (SELECT r, c, CAST(least(floor(a), 4) AS INT) AS i, a - CAST(least(floor(a), 4) AS INT) AS f FROM p) SELECT {RC}, {', '.join(parts)} FROM q"
    )


@query("color_ramp", _ramp_sql())
def color_ramp(spark, d):
    return algebra.color_ramp(grid(spark, d), "b1", STOPS).select(*CELL, "red", "green", "blue")


@query("rescale_u8", with_("pix") + f', e AS (SELECT band, min(value) AS lo, max(value) AS hi FROM pix GROUP BY band) SELECT {RC}, band, CAST(floor(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) * 255 ELSE 0 END) AS INT) AS value FROM pix JOIN e USING (band)')
def rescale_u8(spark, d):
    return algebra.rescale(pixels(spark, d)).withColumn("value", F.floor("value").cast("int"))


@query("write_roundtrip", with_("pix") + "SELECT band, count(*) AS cells, sum(value) AS total FROM pix GROUP BY band")
def write_roundtrip(spark, d):
    from ..sources.rasters import read_tiles, write_tiles

    path = write_tiles(pixels(spark, d).withColumn("raster_id", F.lit("grid")), GRID, 16)
    return read_tiles(spark, path).groupBy("band").agg(F.count("*").alias("cells"), F.sum("value").alias("total"))


@query("tile_by_zone", with_("zpix") + "SELECT s_name AS name, count(*) AS cells, sum(b1) AS total FROM zpix JOIN (SELECT fid, s_name FROM zones) n USING (fid) GROUP BY 1")
def tile_by_zone(spark, d):
    from ..operators.zonal import join_zones
    from .base import zones

    return join_zones(grid(spark, d), zones(spark, d)).groupBy(F.col("s_name").alias("name")).agg(F.count("*").alias("cells"), F.sum("b1").alias("total"))


@query("stack_bands", with_("cube") + f"SELECT {RC}, CAST(band - 1994 AS INT) AS band, value FROM cube WHERE band IN (1995, 1996, 1997)")
def stack_bands(spark, d):
    layers = [cube(spark, d).where(F.col("band") == y).withColumn("band", F.lit(1)) for y in (1995, 1996, 1997)]
    return tiles.stack(layers)


@query("mosaic_last", with_("cube") + f"SELECT {RC}, max_by(value, band) AS value FROM cube GROUP BY r, c")
def mosaic_last(spark, d):
    return tiles.mosaic(cube(spark, d), "band", CELL)


@query("mosaic_nodata", with_("cube") + f"SELECT {RC}, max_by(value, band) AS value FROM (SELECT r, c, band, value % 3 AS value FROM cube) WHERE value <> 0 GROUP BY r, c")
def mosaic_nodata(spark, d):
    return tiles.mosaic(cube(spark, d).withColumn("value", F.col("value") % 3), "band", CELL, 0.0)


@query("mosaic_mask", with_("cube", "grid") + f"SELECT cube.r AS \"row\", cube.c AS col, max_by(value, band) AS value FROM cube JOIN grid ON cube.r = grid.r AND cube.c = grid.c AND b4 <> 0 GROUP BY 1, 2")
def mosaic_mask(spark, d):
    mask = grid(spark, d).where("b4 <> 0").select(*CELL)
    return tiles.mosaic(cube(spark, d).join(mask, CELL, "left_semi"), "band", CELL)


# --- algebra ---


@query("ndvi", with_("emb") + f"SELECT {RC}, CASE WHEN e[2]::DOUBLE + e[1]::DOUBLE <> 0 THEN round((e[2]::DOUBLE - e[1]::DOUBLE) / (e[2]::DOUBLE + e[1]::DOUBLE), 6) + 0.0 END AS ndvi FROM emb")
def ndvi(spark, d):
    wide = emb(spark, d).select(*CELL, F.col("e")[0].alias("red"), F.col("e")[1].alias("nir"))
    return algebra.ndvi(wide, "red", "nir", ieee=False).select(*CELL, r6(F.col("ndvi")).alias("ndvi"))


@query("rgb_chromatic", with_("grid") + f"SELECT {RC}, round(b1 / (b1 + b2 + b3) * 10000, 6) AS b1, round(b2 / (b1 + b2 + b3) * 10000, 6) AS b2, round(b3 / (b1 + b2 + b3) * 10000, 6) AS b3 FROM grid")
def rgb_chromatic(spark, d):
    return algebra.chromatic(grid(spark, d), "b1", "b2", "b3").select(*CELL, *[r6(F.col(b)).alias(b) for b in ("b1", "b2", "b3")])


@query("rgb_chromatic_legacy", with_("grid") + f", x AS (SELECT r, c, b1 / (b1 + b2 + b3) * 10000 AS r1, b2, b3 FROM grid), y AS (SELECT *, b3 / (r1 + b2 + b3) * 10000 AS b FROM x) SELECT {RC}, round(r1, 6) AS b1, round(b2 / (r1 + b2 + b) * 10000, 6) AS b2, round(b, 6) AS b3 FROM y")
def rgb_chromatic_legacy(spark, d):
    return algebra.chromatic(grid(spark, d), "b1", "b2", "b3", legacy=True).select(*CELL, *[r6(F.col(b)).alias(b) for b in ("b1", "b2", "b3")])


@query("mask_value", with_("grid") + f"SELECT {RC}, CASE WHEN b4 = 2 THEN b4 ELSE 0 END AS value FROM grid")
def mask_value(spark, d):
    return grid(spark, d).select(*CELL, algebra.keep_value(F.col("b4"), 2.0).alias("value"))


@query("mask_by_raster", with_("pix", "grid") + 'SELECT pix.r AS "row", pix.c AS col, band, CASE WHEN g.b4 = 1 THEN value ELSE 0 END AS value FROM pix JOIN grid g ON pix.r = g.r AND pix.c = g.c')
def mask_by_raster(spark, d):
    return algebra.mask_by_raster(pixels(spark, d), grid(spark, d).select(*CELL, F.col("b4").alias("m")), 1.0)


for _name, _rule, _test in (("eq", "==", "b3 <> 5"), ("lt", "<", "b3 < 5"), ("gt", ">", "b3 > 5")):

    @query(f"mask_rule_{_name}", with_("grid") + f"SELECT {RC}, CASE WHEN {_test} THEN 0 ELSE b3 END AS value FROM grid")
    def mask_rule(spark, d, rule=_rule):
        return grid(spark, d).select(*CELL, algebra.mask_rule(F.col("b3"), 5.0, rule).alias("value"))


@query("mask_rule_out", with_("grid") + f"SELECT {RC}, CASE WHEN b3 < 5 THEN 0.0 WHEN b3 = 5 THEN 9.0 ELSE b3 END AS value FROM grid")
def mask_rule_out(spark, d):
    return grid(spark, d).select(*CELL, algebra.mask_rule(F.col("b3"), 5.0, "<", 9.0).alias("value"))


@query("mask_block", with_("grid") + f", m AS (SELECT r // 2 AS tr, c // 2 AS tc, max(CASE WHEN b4 = 3 THEN 1 ELSE 0 END) AS has FROM grid GROUP BY 1, 2) SELECT {RC}, CASE WHEN has = 1 AND NOT b3 < 3 THEN b3 ELSE 0 END AS value FROM grid JOIN m ON r // 2 = tr AND c // 2 = tc")
def mask_block(spark, d):
    return algebra.mask_blocks(grid(spark, d), "b3", "b4", 3.0, 2, "<").select(*CELL, F.col("b3").alias("value"))


@query("recode_scene", with_("grid") + f"SELECT {RC}, CASE WHEN b3 = 6 OR b4 = 3 THEN 3.0 WHEN b3 > 6 THEN 2.0 ELSE b3 END AS value FROM grid")
def recode_scene(spark, d):
    g = grid(spark, d)
    return algebra.recode_scene(g.select(*CELL, F.col("b3").alias("scl")), g.select(*CELL, F.when(F.col("b4") == 3, 4.0).otherwise(F.col("b4") % 3).alias("scene")))


@query("tiles_full", with_("grid") + "SELECT CAST(r // 10 AS INT) AS tile_row, CAST(c // 10 AS INT) AS tile_col, count(*) AS cells FROM grid GROUP BY 1, 2 HAVING count(*) = 100")
def tiles_full(spark, d):
    return tiles.chip_summary(grid(spark, d), "b4", 10).where("cells = 100").select("tile_row", "tile_col", "cells")


@query("tiles_nonempty", with_("grid") + "SELECT CAST(r // 2 AS INT) AS tile_row, CAST(c // 2 AS INT) AS tile_col, max(b4) AS top FROM grid GROUP BY 1, 2 HAVING max(b4) <> 0")
def tiles_nonempty(spark, d):
    return tiles.chip_summary(grid(spark, d), "b4", 2).where("top <> 0").select("tile_row", "tile_col", "top")


@query("path_rebase", "SELECT url AS path, concat('tiles/', regexp_extract(url, '[^/]*$')) AS rebased FROM pages")
def path_rebase(spark, d):
    return table(spark, d, "pages").select(F.col("url").alias("path"), F.concat(F.lit("tiles/"), F.substring_index("url", "/", -1)).alias("rebased"))


@query("mask_to_blocks", with_("grid") + f", m AS (SELECT r // 2 AS tr, c // 2 AS tc, max(b4) AS top FROM grid GROUP BY 1, 2) SELECT {RC}, CASE WHEN top > 0 THEN 1.0 ELSE 0.0 END AS value FROM grid JOIN m ON r // 2 = tr AND c // 2 = tc")
def mask_to_blocks(spark, d):
    return algebra.fill_blocks(grid(spark, d), "b4", 2).select(*CELL, F.col("b4").alias("value"))


@query("lut", with_("grid") + f"SELECT {RC}, [5.0::DOUBLE, 7.0::DOUBLE, 11.0::DOUBLE, 13.0::DOUBLE][CAST(b4 AS INT) + 1] AS value FROM grid")
def lut(spark, d):
    return grid(spark, d).select(*CELL, algebra.lookup(F.col("b4"), [5, 7, 11, 13]).alias("value"))


MEANS = {1: (0.485, 0.229), 2: (0.456, 0.224), 3: (0.406, 0.225)}  # fixed values: usual image means and deviations


@query("normalize_band", with_("pix") + f"SELECT {RC}, band, round((value - m * 255) / (s * 255), 6) + 0.0 AS value FROM pix JOIN (VALUES (1, 0.485, 0.229), (2, 0.456, 0.224), (3, 0.406, 0.225)) AS t(b, m, s) ON band = b")
def normalize_band(spark, d):
    table_ = spark.createDataFrame([(b, m, s) for b, (m, s) in MEANS.items()], "band int, m double, s double")
    return pixels(spark, d).join(F.broadcast(table_), "band").select(*CELL, "band", r6(algebra.normalise(F.col("value"), F.col("m"), F.col("s"))).alias("value"))


@query("fix_overlap", with_("zpix") + 'SELECT r AS "row", c AS col, min(fid) AS id FROM zpix GROUP BY r, c HAVING count(*) = 1')
def fix_overlap(spark, d):
    from ..operators.zonal import join_zones
    from .base import zones

    return algebra.unique_claims(join_zones(grid(spark, d), zones(spark, d)).select(*CELL, F.col("fid").alias("id")))


@query("onehot_to_class", with_("grid") + f", planes AS (SELECT r, c, p AS plane, CASE WHEN (CAST(b1 AS INT) + p) % 3 = 0 THEN 1 ELSE 0 END AS value FROM grid, range(1, 5) AS t(p)) SELECT {RC}, CAST(coalesce(max(CASE WHEN value = 1 THEN plane END), 0) AS INT) AS class FROM planes GROUP BY r, c")
def onehot_to_class(spark, d):
    planes = grid(spark, d).select(*CELL, "b1", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("plane"))
    return algebra.class_of_planes(planes.withColumn("value", ((F.col("b1").cast("int") + F.col("plane")) % 3 == 0).cast("int")))


@query("raster_product", with_("grid") + f"SELECT {RC}, b2 * b4 AS value FROM grid")
def raster_product(spark, d):
    g = grid(spark, d)
    return g.select(*CELL, "b2").join(g.select(*CELL, "b4"), CELL).select(*CELL, (F.col("b2") * F.col("b4")).alias("value"))


@query("zip_lists", "WITH a AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS n FROM benchmark), b AS (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS n FROM region) SELECT item_id, r_name FROM a JOIN b USING (n)")
def zip_lists(spark, d):
    """Two ordered lists, of files in practice, by position."""
    a = table(spark, d, "benchmark").agg(F.sort_array(F.collect_list("item_id")).alias("l")).select(F.posexplode("l").alias("n", "item_id"))
    b = table(spark, d, "region").agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("l")).select(F.posexplode("l.r_name").alias("n", "r_name"))
    return a.join(b, "n").select("item_id", "r_name")


# --- through stacks ---

for _stat, _sql in (("mean", "avg(value)"), ("std", "stddev_pop(value)"), ("median", "median(value)"), ("p95", "quantile_cont(value, 0.95)")):

    @query(f"temporal_{_stat}", with_("cube") + f"SELECT {RC}, round({_sql}, 6) + 0.0 AS value FROM cube GROUP BY r, c")
    def temporal(spark, d, stat="perc" if _stat == "p95" else _stat):
        return depth.temporal(cube(spark, d), stat, 95).select(*CELL, r6(F.col(stat)).alias("value"))

    @query(f"band_{_stat}", with_("pix") + f"SELECT {RC}, round({_sql}, 6) + 0.0 AS value FROM pix WHERE band IN (1, 2, 3) GROUP BY r, c")
    def band(spark, d, stat="perc" if _stat == "p95" else _stat):
        return depth.temporal(pixels(spark, d).where("band in (1, 2, 3)"), stat, 95).select(*CELL, r6(F.col(stat)).alias("value"))


@query("raster_classes", with_("pix") + "SELECT band, array_to_string(list_sort(list(DISTINCT CAST(value AS INT)) FILTER (value <> 0)), ',') AS classes, count(DISTINCT value) AS n FROM pix WHERE band IN (3, 4) GROUP BY band")
def raster_classes(spark, d):
    return depth.classes(pixels(spark, d).where("band in (3, 4)")).select("band", F.expr("array_join(transform(classes, x -> cast(cast(x as int) as string)), ',')").alias("classes"), "n")


@query("band_stats", with_("pix") + "SELECT band, min(value) AS lo, max(value) AS hi, max(value) = 0 AS empty FROM pix GROUP BY band")
def band_stats(spark, d):
    return depth.band_stats(pixels(spark, d))


@query("ecdf", with_("grid") + "SELECT b1 AS value, round(sum(count(*)) OVER (ORDER BY b1) / sum(count(*)) OVER (), 6) AS q FROM grid GROUP BY b1")
def ecdf(spark, d):
    return depth.ecdf(grid(spark, d).select(F.col("b1").alias("value")), "value").withColumn("q", r6(F.col("q")))


HIST_SQL = with_("grid") + """, s AS (SELECT b1 AS v, sum(count(*)) OVER (ORDER BY b1) / sum(count(*)) OVER () AS q FROM grid GROUP BY b1),
t AS (SELECT b2 AS v, sum(count(*)) OVER (ORDER BY b2) / sum(count(*)) OVER () AS q FROM grid GROUP BY b2),
near AS (SELECT s.v, s.q, (SELECT max(t.q) FROM t WHERE t.q <= s.q) AS lq, (SELECT min(t.q) FROM t WHERE t.q > s.q) AS hq FROM s)
SELECT near.v AS value, round(CASE WHEN lq IS NULL THEN h.v WHEN hq IS NULL OR lq = near.q THEN l.v ELSE l.v + (near.q - lq) / (hq - lq) * (h.v - l.v) END, 6) AS matched
FROM near LEFT JOIN t l ON l.q = lq LEFT JOIN t h ON h.q = hq"""


@query("hist_match", HIST_SQL)
def hist_match(spark, d):
    g = grid(spark, d)
    out = depth.histogram_match(g.select(*CELL, F.col("b1").alias("value")), g.select(F.col("b2").alias("value")))
    return out.groupBy("value").agg(r6(F.first("matched")).alias("matched"))


@query("distinct_values", with_("pix") + "SELECT DISTINCT band, value FROM pix")
def distinct_values(spark, d):
    return pixels(spark, d).select("band", "value").distinct()


# --- chips ---


@query("chips_nonzero", with_("grid") + "SELECT concat('chip_', CAST(r // 2 AS INT), CAST(c // 2 AS INT)) AS name, CAST(r // 2 AS INT) AS tile_row, CAST(c // 2 AS INT) AS tile_col, count(*) FILTER (b4 <> 0) AS nonzero FROM grid GROUP BY 1, 2, 3 HAVING count(*) FILTER (b4 <> 0) > 0")
def chips_nonzero(spark, d):
    return tiles.chip_summary(grid(spark, d), "b4", 2).where("nonzero > 0").select(tiles.chip_name("chip_", F.col("tile_row"), F.col("tile_col")).alias("name"), "tile_row", "tile_col", "nonzero")


@query("chip_name", with_("grid") + "SELECT DISTINCT concat('base', CAST(r // 16 AS INT), CAST(c // 16 AS INT)) AS name FROM grid")
def chip_name(spark, d):
    return tiles.with_tiles(grid(spark, d), 16).select(tiles.chip_name("base", F.col("tile_row"), F.col("tile_col")).alias("name")).distinct()


@query("chip_labels", with_("grid") + "SELECT CAST(r // 4 AS INT) AS tile_row, CAST(c // 4 AS INT) AS tile_col, max(b4) AS label FROM grid GROUP BY 1, 2")
def chip_labels(spark, d):
    return tiles.chip_summary(grid(spark, d), "b4", 4).select("tile_row", "tile_col", F.col("top").alias("label"))


@query("pad_tiles", with_("dense") + "SELECT CAST(i // 72 // 24 AS INT) AS tile_row, CAST(i % 72 // 24 AS INT) AS tile_col, count(*) AS cells, sum(coalesce(b1, 0)) AS total FROM range(0, 5184) AS t(i) LEFT JOIN dense ON r = i // 72 AND c = i % 72 GROUP BY 1, 2")
def pad_tiles(spark, d):
    return tiles.pad(grid(spark, d), GRID, 24, "b1").groupBy("tile_row", "tile_col").agg(F.count("*").alias("cells"), F.sum("b1").alias("total"))


@query("d4_transform", with_("grid") + f", t AS (SELECT r, c, b1, 0 AS k, r AS nr, c AS nc FROM grid UNION ALL SELECT r, c, b1, 1, 63 - c, r FROM grid UNION ALL SELECT r, c, b1, 2, 63 - r, 63 - c FROM grid UNION ALL SELECT r, c, b1, 3, c, 63 - r FROM grid UNION ALL SELECT r, c, b1, 4, r, 63 - c FROM grid UNION ALL SELECT r, c, b1, 5, c, r FROM grid UNION ALL SELECT r, c, b1, 6, 63 - r, c FROM grid UNION ALL SELECT r, c, b1, 7, 63 - c, 63 - r FROM grid) SELECT CAST(k AS INT) AS which, sum(b1 * (nr * 64 + nc)) AS moment FROM t GROUP BY 1")
def d4_transform(spark, d):
    g, out = grid(spark, d), None
    for k in range(8):
        r, c = tiles.d4(F.col("row"), F.col("col"), 64, k)
        part = g.select(F.lit(k).alias("which"), (F.col("b1") * (r * 64 + c)).alias("m"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("which").agg(F.sum("m").alias("moment"))


@query("sample_tile")
def sample_tile(spark, d):
    """One tile at random: the least seeded hash."""
    keys = tiles.with_tiles(grid(spark, d), 16).select("tile_row", "tile_col").distinct()
    return keys.orderBy(F.xxhash64("tile_row", "tile_col", F.lit(7))).limit(1)


@query("tile_predict")
def tile_predict(spark, d):
    """A pluggable model over padded tiles; here a mean filter stands in for a network."""
    from ..operators.kernels import box, by_tile

    return by_tile(dense(spark, d), "b1", 16, lambda a: box(a, 3), halo=1)


@query("mask_union", with_("grid") + f"SELECT {RC}, max(v) AS value FROM (SELECT r, c, CASE WHEN b3 > 6 THEN 1 ELSE 0 END AS v FROM grid UNION ALL SELECT r, c, CASE WHEN b4 = 3 THEN 1 ELSE 0 END FROM grid) GROUP BY r, c")
def mask_union(spark, d):
    g = grid(spark, d)
    a, b = (g.select(*CELL, F.when(t, 1).otherwise(0).alias("value")) for t in (F.col("b3") > 6, F.col("b4") == 3))
    return a.unionByName(b).groupBy(*CELL).agg(F.max("value").alias("value"))


@query("finite_filter", with_("grid") + f"SELECT {RC}, b1 / b4 AS ratio FROM grid WHERE b4 <> 0 AND abs(b1 / nullif(b4, 0)) < 1e300")
def finite_filter(spark, d):
    from ..functions.numeric import finite, ieee_divide

    g = grid(spark, d).select(*CELL, ieee_divide(F.col("b1"), F.col("b4")).alias("ratio"))
    return g.where(finite(F.col("ratio")))


