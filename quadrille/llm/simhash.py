"""SimHash near-duplicates found with vantage-point trees.

Distinct fingerprints are split into three bit blocks. Two fingerprints that differ in
at most k bits differ in at most r = k // 3 bits in one block, and Hamming distance in
a block is a metric, so a vantage-point tree for each block partitions them: a
fingerprint lives in one shard and visits only those shards that a ball of radius r
overlaps by the triangle inequality. Pairs inside a shard and between visitors and
residents are then checked exactly over all 64 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, id_type, map_slices, texts
from .components import connected_components

BLOCKS = ((0, 22), (22, 21), (43, 21))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = (np.arange(8) * 256).astype(np.int64)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Unsigned XXH64 of a text's shingles in order, repeats included; with fewer words than width, of the whole sequence."""
    import xxhash

    words = text.lower().split()  # bytes.lower and bytes.split know ASCII only, as the word pattern does
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return np.array([digest(line, 42)], np.uint64)
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    m = n - width + 1
    starts = [0, *(spaces[: m - 1] + 1).tolist()]
    ends = [*spaces[width - 1 :].tolist(), len(line)]
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends)), np.uint64, m)


def majority(hashes: np.ndarray) -> int:
    """The unsigned number of the bits that over half of the hashes have; zero for none."""
    m = len(hashes)
    if m < 2:
        return int(hashes[0]) if m else 0
    ones = np.bincount((hashes.view(np.uint8).reshape(m, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * ones.ravel() > m, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, width: int = 4) -> int:
    """The unsigned fingerprint of one text."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id_col, fp): a signed 64-bit fingerprint for each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t, width) for t in texts(batch.column(1))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=[id_col, "fp"])

    return map_slices(docs.select(id_col, text_col), 1, f"`{id_col}` {id_type(docs, id_col)}, fp long", run)


def block_of(fps: np.ndarray, block: int) -> np.ndarray:
    at, size = BLOCKS[block]
    return (fps >> np.uint64(at)) & np.uint64((1 << size) - 1)


def build_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a complete binary tree, in heap order, from a bounded sample of block values."""
    nodes = (1 << depth) - 1
    vantage, radius = np.zeros(nodes, np.uint64), np.zeros(nodes, np.int64)
    rest = {0: sample}
    for node in range(nodes):
        own = rest.pop(node, sample[:0])
        if not len(own):
            own = sample[node % max(len(sample), 1) :][:64] if len(sample) else np.zeros(1, np.uint64)
        tried = own[:: max(1, len(own) // 8)][:8]
        # the vantage point whose median splits the sample most evenly
        best = None
        for v in tried:
            d = np.bitwise_count(own ^ v).astype(np.int64)
            for mu in {int(np.median(d)), int(np.median(d)) - 1}:
                inner = int((d <= mu).sum())
                uneven = abs(2 * inner - len(own))
                if best is None or uneven < best[0]:
                    best = (uneven, v, mu, d)
        _, vantage[node], radius[node], d = best
        rest[2 * node + 1], rest[2 * node + 2] = own[d <= radius[node]], own[d > radius[node]]
    return vantage, radius


def route(values: np.ndarray, tree: tuple[np.ndarray, np.ndarray], depth: int, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each value's shard, then indices and shards of visits. Of two neighbours whose paths part at a node, the one outside visits the other's shard."""
    vantage, radius = tree
    home = np.zeros(len(values), np.int64)
    who, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for _ in range(depth):
        d = np.bitwise_count(values ^ vantage[home]).astype(np.int64) - radius[home]
        v = np.bitwise_count(values[who] ^ vantage[at]).astype(np.int64) - radius[at]
        near = np.flatnonzero((d > 0) & (d <= r))
        into, out = v <= r, v > -r
        who, at = np.concatenate([who[into], who[out], near]), np.concatenate([2 * at[into] + 1, 2 * at[out] + 2, 2 * home[near] + 1])
        home = 2 * home + 1 + (d > 0)
    if len(who):
        pairs = np.unique(np.stack([who, at]), axis=1)
        who, at = pairs
    return home, who, at


def shard_links(resident: np.ndarray, visitor: np.ndarray, k: int, inside: bool = True) -> np.ndarray:
    """Links (u, v) that join all points within k bits, among residents and between them and visitors.

    Each point is linked with the smallest of its component here.
    """
    everything = np.unique(np.concatenate([resident, visitor]))
    mine = np.unique(resident)
    place = np.searchsorted(everything, mine)
    rows = everything if inside else np.unique(visitor)
    label = np.arange(len(everything))
    step = max(1, (1 << 21) // max(len(mine), 1))
    for a in range(0, len(rows), step):
        some = rows[a : a + step]
        close = np.bitwise_count(some[:, None] ^ mine[None, :]) <= k
        where = np.searchsorted(everything, some)
        for i in np.flatnonzero(close.sum(1) > np.isin(some, mine)):  # each finds itself
            others = place[close[i]]
            got = np.unique(np.append(label[where[i]], label[others]))
            if len(got) > 1:
                label[np.isin(label, got)] = got[0]
    linked = np.flatnonzero(label != np.arange(len(everything)))
    return np.stack([everything[linked], everything[label[linked]]])


def near_links(fps: DataFrame, written: Written, k: int = 4, shard_rows: int = 2048, cell_rows: int = 8192, sample_rows: int = 16384) -> DataFrame:
    """Links (u, v) between distinct fingerprints in column fp that join those within k bits.

    The trees are fitted on about sample_rows fingerprints, told by a hash, but route every one.
    A shard of more than cell_rows residents or visitors is compared cell by cell, in tasks of its own, so a dense cluster is no task's alone.
    """
    total = fps.count()
    some = fps.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(max(1, total // sample_rows))) == 0).select("fp").limit(2 * sample_rows)
    sample = np.array(sorted(x.fp for x in some.collect()), np.int64).view(np.uint64)
    depth = max(0, min(13, int(np.ceil(np.log2(max(total, 1) / shard_rows)))))
    trees = [build_tree(block_of(sample, b), depth) for b in range(3)]
    r = k // 3

    def run(batches):
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for b in range(3):
                home, who, at = route(block_of(x, b), trees[b], depth, r)
                kind = np.concatenate([np.ones(len(x), bool), np.zeros(len(who), bool)])
                shard = np.concatenate([home, at]) * 3 + b
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(kind), pa.array(np.concatenate([x, x[who]]).view(np.int64))], names=["shard", "home", "fp"])

    routed = fps.select("fp").mapInArrow(run, "shard long, home boolean, fp long")
    sizes = routed.groupBy("shard").agg(
        F.ceil(F.count_if("home") / cell_rows).cast("int").alias("nr"), F.ceil(F.count_if(~F.col("home")) / cell_rows).cast("int").alias("nv")
    )
    sizes = written(sizes.where("nr > 0"))  # nobody lives in the others
    piece = F.pmod(F.xxhash64("fp"), F.when(F.col("home"), F.col("nr")).otherwise(F.col("nv"))).cast("int")
    whole = (F.col("nr") <= 1) & (F.col("nv") <= 1)
    # cells: a resident piece with another or itself (kind 0), a visitor piece with a resident piece (kind 1), or the whole shard (kind 2)
    cells = F.expr(
        "case when whole then array(struct(2 as kind, 0 as i, 0 as j)) "
        "when home then concat(transform(sequence(0, nr - 1), x -> struct(0 as kind, least(x, piece) as i, greatest(x, piece) as j)),"
        " case when nv > 0 then transform(sequence(0, nv - 1), x -> struct(1 as kind, x as i, piece as j)) else array() end) "
        "else transform(sequence(0, nr - 1), x -> struct(1 as kind, piece as i, x as j)) end"
    )
    dealt = routed.join(sizes, "shard").select("shard", "home", "fp", "nr", "nv", piece.alias("piece"), whole.alias("whole")).select("shard", "home", "fp", "piece", F.explode(cells).alias("cell"))

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, kind, i, j = key
        x, home = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["home"].to_numpy(bool)
        if kind == 2:
            got = shard_links(x[home], x[~home], k)
        elif kind == 1:
            got = shard_links(x[home], x[~home], k, inside=False)
        elif i == j:
            got = shard_links(x, x[:0], k)
        else:
            first = pdf["piece"].to_numpy() == i
            got = shard_links(x[first], x[~first], k, inside=False)
        return pd.DataFrame({"u": got[0].view(np.int64), "v": got[1].view(np.int64)})

    return dealt.select("shard", "cell.kind", "cell.i", "cell.j", "piece", "home", "fp").groupBy("shard", "kind", "i", "j").applyInPandas(compare, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, k: int = 4) -> DataFrame:
    """(id_col, fp, fingerprint, component_id) for each row: components of fingerprints that differ in at most k bits.

    component_id is the smallest id reachable. A null or wordless text has fingerprint
    zero and links like any other; a null id is kept, but names a component only if it
    has no other. Repeated rows come back as often.
    """
    spark = docs.sparkSession
    written = Written(spark)
    own = written(fingerprints(docs, id_col, text_col, width))
    distinct = written(own.groupBy("fp").agg(F.min(id_col).alias("least")))
    found = connected_components(near_links(distinct, written, k), written)
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return own.join(classes, "fp").select(id_col, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
