"""Segmentation kernels: numpy on one zone's window or tile at a time, and what of them is relational.

Windows are grouped by zone, so each task holds single windows, never a raster.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import tile
from .ordered import running_sums
from .zonal import join_zones

CELL = ["row", "col"]


def window_of(pdf: pd.DataFrame, value: str, fill: float = 0.0) -> tuple[np.ndarray, int, int]:
    """A zone's pixels as an array, and the row and column of its upper left."""
    r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
    out = np.full((int(pdf["row"].max()) - r0 + 1, int(pdf["col"].max()) - c0 + 1), fill)
    out[pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0] = pdf[value].to_numpy()
    return out, r0, c0


def by_zone(pixels: DataFrame, zones: DataFrame, value: str, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(fid, row, col, value): a kernel's result on each zone's window; zeros are left out."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        array, r0, c0 = window_of(pdf, value)
        found = np.asarray(kernel(array), float)
        r, c = np.nonzero(found)
        return pd.DataFrame({"fid": key[0], "row": (r + r0).astype("int32"), "col": (c + c0).astype("int32"), "value": found[r, c]})

    cells = join_zones(pixels, zones.select("fid", "c0", "r0", "w", "h")).select("fid", "row", "col", value)
    return cells.groupBy("fid").applyInPandas(run, "fid long, row int, col int, value double")


def by_tile(wide: DataFrame, value: str, size: int, kernel: Callable[[np.ndarray], np.ndarray], halo: int = 0) -> DataFrame:
    """(row, col, value): a kernel's result on each tile, which sees halo pixels beyond it."""
    step = lambda x: F.explode(F.sequence(tile(F.col(x) - halo, size), tile(F.col(x) + halo, size)))
    keyed = wide.select(*CELL, F.col(value).cast("double").alias("v")).withColumn("tr", step("row")).withColumn("tc", step("col"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = (pdf["row"] // size == key[0]) & (pdf["col"] // size == key[1])
        if not own.any():
            return pd.DataFrame({"row": [], "col": [], "value": []}).astype({"row": "int32", "col": "int32", "value": "float64"})
        array, r0, c0 = window_of(pdf, "v")
        found = np.asarray(kernel(array), float)
        r, c = pdf.loc[own, "row"].to_numpy(), pdf.loc[own, "col"].to_numpy()
        return pd.DataFrame({"row": r.astype("int32"), "col": c.astype("int32"), "value": found[r - r0, c - c0]})

    return keyed.groupBy("tr", "tc").applyInPandas(run, "row int, col int, value double")


def otsu(wide: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, threshold): the value that splits each group with the greatest variance between the parts; the smallest of equals. A histogram and a window over different values."""
    h = wide.groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    up, whole = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    w0, s0 = F.sum("n").over(up), F.sum(F.col("v") * F.col("n")).over(up)
    w, s = F.sum("n").over(whole), F.sum(F.col("v") * F.col("n")).over(whole)
    parts = h.select(*by, "v", w0.alias("w0"), s0.alias("s0"), w.alias("w"), s.alias("s"))
    gap = F.col("s0") / F.col("w0") - F.when(F.col("w") > F.col("w0"), (F.col("s") - F.col("s0")) / F.greatest(F.col("w") - F.col("w0"), F.lit(1)))
    scored = parts.withColumn("g", F.round(F.col("w0") * (F.col("w") - F.col("w0")) * gap * gap, 6))
    return scored.groupBy(*by).agg(F.coalesce(F.max_by("v", F.struct(F.col("g"), -F.col("v"))), F.max("v")).alias("threshold"))


def box(array: np.ndarray, k: int) -> np.ndarray:
    """k by k mean with edges repeated."""
    h = k // 2
    s = np.pad(np.cumsum(np.cumsum(np.pad(array, h, mode="edge"), 0), 1), ((1, 0), (1, 0)))
    return (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / (k * k)


def local_threshold(array: np.ndarray, algo: str, k: int = 5, weight: float = 0.2, spread: float = 128.0) -> np.ndarray:
    """Where a pixel exceeds its neighbourhood's threshold, after Niblack or Sauvola."""
    m = box(array, k)
    sd = np.sqrt(np.maximum(box(array * array, k) - m * m, 0))
    t = m - weight * sd if algo == "niblack" else m * (1 + weight * (sd / spread - 1))
    return array > t


def regions(mask: np.ndarray) -> np.ndarray:
    """4-connected regions of a mask, numbered from 1 in reading order."""
    out, n = np.zeros(mask.shape, int), 0
    for r, c in zip(*np.nonzero(mask)):
        if out[r, c]:
            continue
        n += 1
        todo = [(r, c)]
        out[r, c] = n
        while todo:
            a, b = todo.pop()
            for x, y in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= x < mask.shape[0] and 0 <= y < mask.shape[1] and mask[x, y] and not out[x, y]:
                    out[x, y] = n
                    todo.append((x, y))
    return out


def clean_mask(mask: np.ndarray, hole: int = 4, least: int = 2) -> np.ndarray:
    """Holes smaller than hole filled, then regions smaller than least removed."""
    back = regions(~mask)
    for i, n in zip(*np.unique(back[back > 0], return_counts=True)):
        inside = not {0, mask.shape[0] - 1} & set(np.nonzero(back == i)[0].tolist()) and not {0, mask.shape[1] - 1} & set(np.nonzero(back == i)[1].tolist())
        if n < hole and inside:
            mask = mask | (back == i)
    front = regions(mask)
    for i, n in zip(*np.unique(front[front > 0], return_counts=True)):
        if n < least:
            mask = mask & (front != i)
    return mask


def threshold_array(array: np.ndarray, algo: str, least: int) -> np.ndarray:
    if algo == "otsu":
        values = np.unique(array)
        best, t = -1.0, values[0]
        for v in values[:-1]:
            lo, hi = array[array <= v], array[array > v]
            g = len(lo) * len(hi) * (lo.mean() - hi.mean()) ** 2
            if g > best + 1e-9:
                best, t = g, v
        mask = array > t
    else:
        mask = local_threshold(array, algo)
    return regions(clean_mask(mask, 4, least))


def level_set(array: np.ndarray, iterations: int = 10, smoothing: int = 1, inner: float = 1.0, outer: float = 1.0, start: np.ndarray | None = None) -> np.ndarray:
    """Morphological active contours without edges, from a centred box."""
    u = np.zeros(array.shape, int) if start is None else start.astype(int)
    if start is None:
        r, c = array.shape
        u[r // 4 : max(r // 4 + 1, r - r // 4), c // 4 : max(c // 4 + 1, c - c // 4)] = 1
    lines = [np.eye(3), np.fliplr(np.eye(3)), np.array([[0, 1, 0]] * 3), np.array([[0, 0, 0], [1, 1, 1], [0, 0, 0]])]

    def over(a: np.ndarray, pick, join) -> np.ndarray:
        p = np.pad(a, 1, mode="edge")
        found = [pick([p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(3) for j in range(3) if s[i, j]]) for s in lines]
        return join(found)

    stack = lambda f: lambda xs: f(np.stack(xs), axis=0)
    inf_sup = lambda a: over(a, stack(np.max), stack(np.min))
    sup_inf = lambda a: over(a, stack(np.min), stack(np.max))
    for k in range(iterations):
        c1 = array[u > 0].mean() if (u > 0).any() else 0.0
        c0 = array[u == 0].mean() if (u == 0).any() else 0.0
        gr, gc = np.gradient(u.astype(float)) if min(u.shape) > 1 else (np.zeros(u.shape), np.zeros(u.shape))
        force = (np.abs(gr) + np.abs(gc)) * (inner * (array - c1) ** 2 - outer * (array - c0) ** 2)
        u = np.where(force < 0, 1, np.where(force > 0, 0, u))
        for s in range(smoothing):
            u = inf_sup(sup_inf(u)) if (k + s) % 2 == 0 else sup_inf(inf_sup(u))
    return u


def topology_level_set(array: np.ndarray, seeds: np.ndarray, iterations: int = 5) -> np.ndarray:
    """Level sets grown from labelled seeds, each kept clear of its neighbours."""
    out = seeds.astype(int)
    for _ in range(iterations):
        for n in np.unique(out[out > 0]):
            grown = level_set(array, 1, 0, start=out == n)
            out = np.where((grown > 0) & ((out == 0) | (out == n)), n, np.where((out == n) & (grown == 0), 0, out))
    return out


def seeded_segments(array: np.ndarray, distance: int = 2) -> np.ndarray:
    """Local maxima, grown by a level set each."""
    p = np.pad(array, distance, mode="constant", constant_values=-np.inf)
    k = 2 * distance + 1
    top = np.max([p[i : i + array.shape[0], j : j + array.shape[1]] for i in range(k) for j in range(k)], axis=0)
    return topology_level_set(array, regions((array == top) & (array > 0)), 3)


def snake(array: np.ndarray, alpha: float = 0.1, beta: float = 0.1, gamma: float = 0.1, steps: int = 50) -> np.ndarray:
    """An open active contour from left to right through the middle, drawn to edges; its pixels are 1."""
    rows, n = array.shape
    if n < 3 or rows < 3:
        return np.zeros(array.shape)
    smooth = box(array, 3)
    edge = np.hypot(*np.gradient(smooth))
    pull = np.gradient(edge)[0]
    y = np.full(n, (rows - 1) / 2)
    d = np.eye(n)
    second = np.roll(d, 1, 0) + np.roll(d, -1, 0) - 2 * d
    second[0] = second[-1] = 0
    stiff = np.linalg.inv((alpha * -second + beta * second @ second) + d / gamma)
    for _ in range(steps):
        at = np.clip(np.round(y).astype(int), 0, rows - 1)
        y = np.clip(stiff @ (y / gamma + pull[at, np.arange(n)] / max(1e-9, np.abs(pull).max())), 0, rows - 1)
    out = np.zeros(array.shape)
    out[np.round(y).astype(int), np.arange(n)] = 1
    return out


def canny(array: np.ndarray, sigma: float = 1.0, low: float = 0.1, high: float = 0.2) -> np.ndarray:
    """Edges: smoothing, gradient, thinning across it, hysteresis. Thresholds are shares of the greatest gradient."""
    h = max(1, int(4 * sigma + 0.5))
    w = np.exp(-0.5 * (np.arange(-h, h + 1) / sigma) ** 2)
    w /= w.sum()
    s = np.pad(array.astype(float), h, mode="edge")
    s = np.apply_along_axis(lambda v: np.convolve(v, w, "valid"), 0, s)
    s = np.apply_along_axis(lambda v: np.convolve(v, w, "valid"), 1, s)
    if min(s.shape) < 3:
        return np.zeros(array.shape)
    gr, gc = np.gradient(s)
    m = np.hypot(gr, gc)
    angle = (np.degrees(np.arctan2(gr, gc)) + 180) % 180
    p = np.pad(m, 1)
    part = lambda r, c: p[1 + r : 1 + r + m.shape[0], 1 + c : 1 + c + m.shape[1]]
    bins = [((angle < 22.5) | (angle >= 157.5), (0, 1)), ((angle >= 22.5) & (angle < 67.5), (1, 1)), ((angle >= 67.5) & (angle < 112.5), (1, 0)), ((angle >= 112.5) & (angle < 157.5), (1, -1))]
    thin = np.zeros(m.shape, bool)
    for where, (r, c) in bins:
        thin |= where & (m >= part(r, c)) & (m >= part(-r, -c))
    weak, strong = thin & (m >= low * m.max()), thin & (m >= high * m.max()) & (m > 0)
    label = regions(weak)
    return np.isin(label, np.unique(label[strong])) & (label > 0)


def phase_congruency(array: np.ndarray, scales: int = 3, orientations: int = 4, shortest: float = 3.0, mult: float = 2.1, sigma: float = 0.55) -> np.ndarray:
    """Phase congruency from log-Gabor filters, 0 to 1."""
    rows, cols = array.shape
    fy, fx = np.meshgrid(np.fft.fftfreq(rows), np.fft.fftfreq(cols), indexing="ij")
    radius = np.hypot(fx, fy)
    radius[0, 0] = 1
    theta, image = np.arctan2(-fy, fx), np.fft.fft2(array)
    energy, total = np.zeros(array.shape), np.zeros(array.shape)
    for o in range(orientations):
        d = theta - o * np.pi / orientations
        spread = np.exp(-(np.arctan2(np.sin(d), np.cos(d)) ** 2) / (2 * (np.pi / orientations) ** 2))
        even, odd = np.zeros(array.shape), np.zeros(array.shape)
        for s in range(scales):
            gabor = np.exp(-(np.log(radius * shortest * mult**s) ** 2) / (2 * np.log(sigma) ** 2)) * spread
            gabor[0, 0] = 0
            r = np.fft.ifft2(image * gabor)
            even, odd, total = even + r.real, odd + r.imag, total + np.abs(r)
        energy += np.hypot(even, odd)
    return np.clip(energy / np.maximum(total, 1e-9), 0, 1)


def ransac_line(x: np.ndarray, y: np.ndarray, tolerance: float = 1.0, trials: int = 50, seed: int = 0) -> tuple[float, float, int]:
    """Slope, intercept and inliers of the line most points agree with."""
    rng, best = np.random.default_rng(seed), (0.0, float(np.mean(y)) if len(y) else 0.0, 0)
    for _ in range(trials if len(x) > 1 else 0):
        i, j = rng.choice(len(x), 2, replace=False)
        if x[i] == x[j]:
            continue
        a = (y[j] - y[i]) / (x[j] - x[i])
        b = y[i] - a * x[i]
        near = np.abs(y - a * x - b) <= tolerance
        if near.sum() > best[2]:
            best = (float(a), float(b), int(near.sum()))
    if best[2] > 1:
        near = np.abs(y - best[0] * x - best[1]) <= tolerance
        if np.ptp(x[near]) > 0:
            a, b = np.polyfit(x[near], y[near], 1)
            best = (float(a), float(b), best[2])
    return best


def ransac_strips(wide: DataFrame, value: str, height: int, tolerance: float = 1.0) -> DataFrame:
    """(strip, slope, intercept, inliers) of the non-zero cells of each strip of rows."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"])
        a, b, n = ransac_line(pdf["col"].to_numpy(float), pdf["row"].to_numpy(float), tolerance, seed=int(key[0]))
        return pd.DataFrame({"strip": [key[0]], "slope": [a], "intercept": [b], "inliers": [n]})

    cells = wide.where(F.col(value) != 0).select(tile(F.col("row"), height).alias("strip"), "row", "col")
    return cells.groupBy("strip").applyInPandas(run, "strip int, slope double, intercept double, inliers int")


def strip_lines(wide: DataFrame, value: str, height: int) -> DataFrame:
    """Least-squares line, row from column, of the non-zero cells of each strip of rows."""
    cells = wide.where(F.col(value) != 0).withColumn("strip", tile(F.col("row"), height))
    y, x = F.col("row").cast("double"), F.col("col").cast("double")
    return cells.groupBy("strip").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))


def hough_votes(wide: DataFrame, value: str, angles: list[int]) -> DataFrame:
    """(theta, rho, votes): how many non-zero cells each line, at whole degrees and distances, passes."""
    cells = wide.where(F.col(value) != 0).select("row", "col", F.explode(F.array(*[F.lit(a) for a in angles])).alias("theta"))
    rho = F.round(F.col("col") * F.round(F.cos(F.radians(F.col("theta"))), 9) + F.col("row") * F.round(F.sin(F.radians(F.col("theta"))), 9) + F.lit(1e-6), 0).cast("int")
    return cells.groupBy("theta", rho.alias("rho")).agg(F.count("*").alias("votes"))


def template_scores(wide: DataFrame, template: DataFrame, value: str) -> DataFrame:
    """(row, col, r): correlation of a template (tr, tc, t), of bounded size, with the window that begins at each cell; whole windows only."""
    cells = wide.select("row", "col", F.col(value).alias("v"))
    pairs = cells.crossJoin(F.broadcast(template)).select((F.col("row") - F.col("tr")).alias("row"), (F.col("col") - F.col("tc")).alias("col"), "v", "t")
    v, t, n = F.col("v"), F.col("t"), F.count("*")
    m = pairs.groupBy("row", "col").agg(n.alias("n"), F.sum(v).alias("sv"), F.sum(t).alias("st"), F.sum(v * v).alias("vv"), F.sum(t * t).alias("tt"), F.sum(v * t).alias("vt"))
    size = template.agg(F.count("*").alias("k"))
    whole = m.crossJoin(F.broadcast(size)).where("n = k")
    dv, dt = F.col("n") * F.col("vv") - F.col("sv") * F.col("sv"), F.col("n") * F.col("tt") - F.col("st") * F.col("st")
    return whole.select("row", "col", F.when((dv > 1e-9) & (dt > 1e-9), (F.col("n") * F.col("vt") - F.col("sv") * F.col("st")) / F.sqrt(F.greatest(dv * dt, F.lit(1e-18)))).alias("r"))


def adjacency(labels: DataFrame, weight: str) -> DataFrame:
    """(src, dst, weight, n): mean weight of the cells along the border of each two neighbouring labels (row, col, label)."""
    a = labels.select("row", "col", F.col("label").alias("src"), F.col(weight).alias("wa"))
    steps = F.array(F.struct(F.lit(0).alias("dr"), F.lit(1).alias("dc")), F.struct(F.lit(1).alias("dr"), F.lit(0).alias("dc")))
    moved = a.select("src", "wa", (F.col("row")).alias("r"), F.col("col").alias("c"), F.explode(steps).alias("o")).select("src", "wa", (F.col("r") + F.col("o.dr")).alias("row"), (F.col("c") + F.col("o.dc")).alias("col"))
    b = labels.select("row", "col", F.col("label").alias("dst"), F.col(weight).alias("wb"))
    pairs = moved.join(b, CELL).where("src <> dst")
    return pairs.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.avg((F.col("wa") + F.col("wb")) / 2).alias("weight"), F.count("*").alias("n"))


def merge_regions(edges: DataFrame, threshold: float) -> DataFrame:
    """(label, root): labels joined by edges below a threshold, the least label naming each. Of borders between merged regions the
    count-weighted mean decides again, until none is below."""
    from .components import merge_labels, shared_folder

    folder, k = shared_folder(edges.sparkSession), 0
    current, total = edges.select("src", "dst", "weight", "n"), None
    while True:
        k += 1
        low = current.where(F.col("weight") < threshold)
        if not low.limit(1).count():
            break
        roots = merge_labels(low.select(F.col("src").alias("u"), F.col("dst").alias("v")), f"{folder}/{k}").toDF("label", "root")
        total = roots if total is None else total.join(roots.toDF("root", "next"), "root", "left").select("label", F.coalesce("next", "root").alias("root")).unionByName(roots.join(total, "label", "left_anti"))
        named = current.join(roots.toDF("src", "s"), "src", "left").join(roots.toDF("dst", "d"), "dst", "left")
        named = named.select(F.coalesce("s", "src").alias("a"), F.coalesce("d", "dst").alias("b"), "weight", "n").where("a <> b")
        current = named.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg((F.sum(F.col("weight") * F.col("n")) / F.sum("n")).alias("weight"), F.sum("n").alias("n"))
    return total if total is not None else edges.select(F.col("src").alias("label"), F.col("src").alias("root")).limit(0)


def relabel(labels: DataFrame) -> DataFrame:
    """Labels numbered from 1 in their order; only different labels are ordered."""
    names = running_sums(labels.select("label").where("label <> 0").distinct(), {"new": F.lit(1)}, ["label"])
    return labels.join(names, "label", "left").withColumn("label", F.coalesce("new", F.lit(0)).cast("int")).drop("new")


def threshold_sweep(wide: DataFrame, value: str, levels: int) -> DataFrame:
    """(level, n): cells above each level from 0 up, from one histogram."""
    h = wide.where(F.col(value) > 0).groupBy(F.least(F.ceil(F.col(value)) - 1, F.lit(levels - 1)).cast("int").alias("level")).agg(F.count("*").alias("c"))
    steps = wide.sparkSession.range(levels).select(F.col("id").cast("int").alias("level"))
    joined = steps.join(h, "level", "left").fillna(0, ["c"])
    return joined.select("level", F.sum("c").over(Window.orderBy(F.desc("level"))).cast("long").alias("n"))  # a row a level


def paint(labels: DataFrame, order: Column) -> DataFrame:
    """(row, col, label) of several painters: the last by order stays."""
    return labels.groupBy(*CELL).agg(F.max_by("label", order).alias("label"))
