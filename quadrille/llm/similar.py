"""Groups of similar texts: SimHash fingerprints propose, shingle sets decide, and a prefix join finds what fingerprints miss.

Vantage-point trees over fingerprints find most copies at once, but no radius that they can
search guarantees a Jaccard similarity of 0.8. So an exact set join follows. With shingles in one order
for all texts, rare ones first, two sets that similar share at least l of their first
(1 - similarity) n + l shingles; pairs that share fewer need no check. l grows with
a text, so unrelated texts with a few shingles in common are no candidates. Shingles
that turn out to be common to many unjoined texts go to the end of the order, and these texts begin anew.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, id_type, map_slices, texts
from .components import connected_components
from .simhash import majority, near_links, shingle_hashes

#: Texts of a shingle beyond which its pairs are not listed but compared cell by cell, and texts of one side of a cell.
HOT, CELL = 32, 512
#: Crowded shingles that are moved to the end of the order at most; others are left to the cells.
MOVED = 1 << 18
#: Shingles for each of a text's that a pair must share beyond the first.
SHARE = 0.05


def shingles(text: bytes, width: int) -> np.ndarray:
    """Hashes of a text's different shingles, as signed numbers."""
    return np.unique(shingle_hashes(text, width).view(np.int64))


def common_shingles(docs: DataFrame, text_col: str, width: int, written: Written, one_in: int = 4, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of texts shows to be common, sorted, and how often it has them.

    They only order shingles, rare ones first; any order gives the same pairs, a good one fewer to check. The sample is one text
    in so many, told by a hash, so that a shingle of more than HOT texts is hardly missed; of shingles, the `most` commonest are gathered.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t, width) for t in texts(batch.column(0))]))], names=["gram"])

    some = docs.select(text_col).where(F.pmod(F.xxhash64(text_col, F.lit(1)), F.lit(one_in)) == 0)
    counts, path = written.table(map_slices(some, 0, "gram long", run).groupBy("gram").agg(F.count("*").alias("n")).where("n > 2"))
    left, least = most, 3
    for row in sorted(counts.groupBy("n").agg(F.count("*").alias("grams")).collect(), key=lambda r: -r.n):
        left -= row.grams
        if left < 0:
            least = row.n + 1
            break
    got = counts.where(F.col("n") >= least).toArrow()
    written.drop(path)
    grams, n = got.column("gram").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(grams)
    return grams[order], n[order]


def needed(size: np.ndarray) -> np.ndarray:
    """How many of its first shingles a text of so many shares at least with a similar one that is no smaller."""
    return 1 + (size * SHARE).astype(np.int64)


def prefix(grams: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of a set, in their order."""
    size = len(grams)
    often = np.zeros(size, np.int64)
    if len(common[0]) and size:
        at = np.minimum(np.searchsorted(common[0], grams), len(common[0]) - 1)
        often = np.where(common[0][at] == grams, common[1][at], 0)
    first = size - int(np.ceil(similarity * size - 1e-9)) + int(needed(np.array([size]))[0])
    return grams[np.lexsort((grams, often))][:first]


def listed_pairs(gram: np.ndarray, key: np.ndarray, size: np.ndarray, similarity: float, hot: int = HOT):
    """(u, v, need) for pairs of texts that begin with a shingle and whose sizes allow the similarity; (shingle, text, -1) for shingles of more than hot texts."""
    order = np.lexsort((key, gram))
    gram, key = gram[order], key[order]
    new = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])])) if len(gram) else np.zeros(0, np.int64)
    gram, key, size = gram[new], key[new], size[order][new]
    begin = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else new
    many = np.diff(np.append(begin, len(gram)))
    for m in np.unique(many[many > 1]).tolist():
        starts = begin[many == m]
        if m > hot:
            at = (starts[:, None] + np.arange(m)).ravel()
            yield gram[at], key[at], np.full(len(at), -1)
            continue
        i, j = np.triu_indices(m, 1)
        step = max(1, (1 << 20) // len(i))
        for a in range(0, len(starts), step):
            x, y = (starts[a : a + step, None] + i).ravel(), (starts[a : a + step, None] + j).ravel()
            small, large = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
            ok = small >= large * similarity - 1e-9
            x, y = x[ok], y[ok]
            yield np.maximum(key[x], key[y]), np.minimum(key[x], key[y]), needed(small[ok])


def set_links(a: list[np.ndarray], b: list[np.ndarray], similarity: float, columns: int = 4096) -> np.ndarray:
    """Indices (of a, of b) of the pairs of sets of at least the similarity."""
    na, nb = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    ta, tb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(ta, tb)
    shared = np.zeros((len(a), len(b)))
    sides = []
    for t, n in ((ta, na), (tb, nb)):
        own, at = np.repeat(np.arange(len(n)), n), np.searchsorted(both, t)
        ok = at < len(both)
        ok[ok] = both[at[ok]] == t[ok]
        own, at = own[ok], at[ok]
        order = np.argsort(at, kind="stable")
        sides.append((own[order], at[order], len(n)))
    for c in range(0, len(both), columns):
        parts = []
        for own, at, n in sides:
            x, y = np.searchsorted(at, (c, c + columns))
            part = np.zeros((n, columns), np.float32)
            part[own[x:y], at[x:y] - c] = 1
            parts.append(part)
        shared += parts[0] @ parts[1].T
    union = na[:, None] + nb[None, :] - shared
    return np.stack(np.nonzero(union * similarity <= shared + 1e-9))


def forest(links: np.ndarray, n: int) -> np.ndarray:
    """Those of the links among n nodes that join what those before have not joined."""
    root, keep = list(range(n)), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for k, (u, v) in enumerate(links.T.tolist()):
        u, v = top(u), top(v)
        if u != v:
            root[max(u, v)] = min(u, v)
            keep.append(k)
    return links[:, keep]


def cell_links(held: DataFrame, grams: DataFrame, similarity: float, written: Written, cell_rows: int) -> DataFrame | None:
    """Links (u, v) of similar texts among those of a block with different roots, of (text_key, block, root); None if all blocks have one root.

    The texts of a block's largest root are residents, which need no links with each other. Every
    cell holds the sets of two pieces, compares all their pairs and sends links that join what they join.
    """
    counts = written(held.groupBy("block", "root").agg(F.count("*").alias("n")))
    largest = counts.groupBy("block").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("total"), F.max("n").alias("most")).where("total > most")
    largest = written(largest.select("block", "main", F.ceil(F.col("most") / cell_rows).cast("int").alias("nr"), F.ceil((F.col("total") - F.col("most")) / cell_rows).cast("int").alias("nv")))
    if not largest.limit(1).count():
        return None
    placed = held.join(largest, "block").withColumn("home", F.expr("root = main")).withColumn("piece", F.expr("cast(pmod(xxhash64(text_key), if(home, nr, nv)) as int)"))
    # kind 0: a piece of the others with another or itself; kind 1: a piece of the others with one of residents
    cells = F.expr(
        "case when home then transform(sequence(0, nv - 1), x -> struct(1 as kind, x as i, piece as j)) "
        "else concat(transform(sequence(0, nv - 1), x -> struct(0 as kind, least(x, piece) as i, greatest(x, piece) as j)), transform(sequence(0, nr - 1), x -> struct(1 as kind, piece as i, x as j))) end"
    )
    dealt = placed.select("text_key", "block", "home", "piece", F.explode(cells).alias("cell")).join(grams, "text_key")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, kind, i, j = key
        sets = [np.asarray(x, np.int64) for x in pdf["grams"]]
        home, piece = pdf["home"].to_numpy(bool), pdf["piece"].to_numpy()
        left = np.flatnonzero(~home if kind == 1 else piece == i)
        right = np.flatnonzero(home if kind == 1 else piece == j)
        if not len(left) or not len(right):
            return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
        x, y = set_links([sets[p] for p in left], [sets[p] for p in right], similarity)
        got = forest(np.stack([left[x], right[y]]), len(sets))
        names = pdf["text_key"].to_numpy(np.int64)
        return pd.DataFrame({"u": names[got[0]], "v": names[got[1]]})

    return dealt.select("block", "cell.kind", "cell.i", "cell.j", "piece", "home", "text_key", "grams").groupBy("block", "kind", "i", "j").applyInPandas(compare, "u long, v long")


def text_keys(docs: DataFrame, text_col: str, written: Written, most: int = 10_000) -> Column:
    """A 64-bit key of each different text: its hash, or another where two texts have one hash. Raises beyond `most` such hashes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key, other = F.xxhash64(text), F.xxhash64(text, F.lit(2))
    pairs = docs.select(key.alias("k"), other.alias("o")).groupBy("k").agg(F.min("o").alias("least"), F.max("o").alias("most")).where("least < most")
    found = [r.k for r in pairs.select("k").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError("too many texts share their hashes")
    return F.when(key.isin(found), other).otherwise(key) if found else key


def moved_last(common: tuple[np.ndarray, np.ndarray], gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of common_shingles with some shingles after all others, by their counts."""
    stay = ~np.isin(common[0], gram)
    grams, often = np.concatenate([common[0][stay], gram]), np.concatenate([common[1][stay], n + (1 << 40)])
    order = np.argsort(grams)
    return grams[order], often[order]


def _both(u, v) -> list[Column]:
    return [F.greatest(u, v).alias("u"), F.least(u, v).alias("v")]


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, k: int = 4, hot: int = HOT, cell_rows: int = CELL) -> DataFrame:
    """(id, text_key, group_key, kept) for each row: groups linked by shingle sets of at least that Jaccard similarity.

    Fingerprints within k bits, fewer pairs of the prefix join that cover every text once, and a few pairs of
    crowded shingles are checked first; of the other pairs, those whose texts are not joined by then. Texts of a shingle
    that more than hot texts begin with are compared cell by cell, unless they are joined. Only links that the sets
    confirm join anything. Of each group the row of smallest id stays; equal texts are one text, and texts
    without words link with each other only.
    """
    written = Written(docs.sparkSession)
    key = text_keys(docs, text_col, written)
    rows = docs.select(F.col(id_col).alias("id"), key.alias("text_key"), F.col(text_col).alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(rows, "text", width, written))

    def begin(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints, sizes, firsts = [], [], []
        for t in texts(batch.column(2)):
            hashes = shingle_hashes(t, width)
            own = np.unique(hashes.view(np.int64))
            prints.append(majority(hashes))
            sizes.append(len(own))
            firsts.append(prefix(own, common.value, similarity) if len(own) else np.zeros(1, np.int64))  # texts without words share one shingle of their own
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64()))], names=["id", "text_key", "fp", "size", "first"]
        )

    own, own_path = written.table(map_slices(rows, 2, f"id {id_type(docs, id_col)}, text_key long, fp long, size long, first array<long>", begin))

    def listed(rows: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
        """(u, v) of pairs that share what they need, (gram, text_key) of crowded shingles, and whether there are any, from (gram, text_key, size)."""

        def run(batches):
            parts = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches]
            if not parts:
                return
            gram, name, size = np.concatenate(parts, axis=1)
            parts.clear()
            for u, v, need in listed_pairs(gram, name, size, similarity, hot):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(need)], names=["u", "v", "need"])

        dealt = rows.repartition("gram").mapInArrow(run, "u long, v long, need long")
        found = written(dealt.groupBy("u", "v", "need").agg(F.count("*").alias("n")).where("need < 0 or n >= need").select("u", "v", (F.col("need") < 0).alias("hot")))
        written.release()
        members = found.where("hot").select(F.col("u").alias("gram"), F.col("v").alias("text_key"))
        return found.where("not hot").select("u", "v"), members, members.limit(1).count() > 0

    pairs, members, crowded = listed(own.select(F.explode("first").alias("gram"), "text_key", "size"))

    # what is checked first: neighbours by fingerprint, one pair of each text, a few of each text of a crowded shingle
    prints = written(own.groupBy("fp").agg(F.min("text_key").alias("least")))
    trees = near_links(prints, written, k)
    names = prints.select(F.col("fp").alias("v"), F.col("least").alias("b"))
    close = trees.join(prints.withColumnRenamed("fp", "u"), "u").join(names, "v").select(*_both("least", "b"))
    same = own.join(prints, "fp").where("text_key <> least").select(*_both("text_key", "least"))
    proposed = close.union(same).union(pairs.groupBy("u").agg(F.min("v").alias("v"))).union(pairs.groupBy("v").agg(F.max("u").alias("u")).select("u", "v"))
    if crowded:
        heads = written(members.groupBy("gram").agg(F.min("text_key").alias("head"), F.min_by("text_key", F.xxhash64("gram", "text_key")).alias("one")))
        few = members.groupBy("text_key").agg(F.slice(F.array_sort(F.collect_set("gram")), 1, 3).alias("grams")).select("text_key", F.explode("grams").alias("gram")).join(heads, "gram")
        proposed = proposed.union(few.where("text_key <> one").select(*_both("text_key", "one")))
    proposed = written(proposed.distinct())
    nodes = proposed.union(pairs).select(F.explode(F.array("u", "v")).alias("text_key")).union(members.select("text_key")).distinct()

    def sets_of(nodes: DataFrame) -> DataFrame:
        """(text_key, grams) of the texts of (text_key)."""

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, width) for t in texts(batch.column(1))], pa.list_(pa.int64()))], names=["text_key", "grams"])

        some = rows.select("text_key", "text").join(nodes, "text_key", "left_semi").dropDuplicates(["text_key"])  # here, as the join has dealt texts by it
        return map_slices(some, 1, "text_key long, grams array<long>", run)

    grams = written(sets_of(nodes))
    written.release()

    def confirmed(some: DataFrame) -> DataFrame:
        both = some.join(grams.toDF("u", "gu"), "u").join(grams.toDF("v", "gv"), "v")
        shared, union = F.size(F.array_intersect("gu", "gv")), F.size("gu") + F.size("gv")
        out = written(both.where((union - shared) * similarity <= shared + 1e-9).select("u", "v"))
        written.release()
        return out

    def rooted(some: DataFrame, by: str, name: str) -> DataFrame:
        return some.join(roots.toDF(by, name), by, "left").withColumn(name, F.coalesce(name, by))

    def across(some: DataFrame) -> DataFrame:
        return written(rooted(rooted(some, "u", "ru"), "v", "rv").where("ru <> rv").select("u", "v"))

    def open_grams(members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """members with their roots, and (gram, head, n) of those shingles whose texts are not all joined."""
        held = written(rooted(members, "text_key", "root"))
        return held, written(held.groupBy("gram").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.min("text_key").alias("head"), F.count("*").alias("n")).where("a <> b").select("gram", "head", "n"))

    links = confirmed(proposed)
    roots = connected_components(links, written).toDF("text_key", "root")
    rest = across(pairs)
    if rest.limit(1).count():
        links = links.union(confirmed(rest))
        roots = connected_components(links, written).toDF("text_key", "root")
    if crowded:
        held, open_ = open_grams(members)
        late = open_.orderBy(F.desc("n"), "gram").limit(MOVED).toArrow()
        if len(late):
            moved = docs.sparkSession.sparkContext.broadcast(moved_last(common.value, late.column("gram").to_numpy(), late.column("n").to_numpy()))
            again = held.join(open_, "gram", "left_semi").select("text_key").distinct()

            def anew(batches):
                for batch in batches:
                    own = [np.asarray(x, np.int64) for x in batch.column(1).to_pylist()]
                    firsts = [prefix(x, moved.value, similarity) for x in own]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array(firsts, pa.list_(pa.int64()))], names=["text_key", "size", "first"])

            fresh = written(grams.join(again, "text_key", "left_semi").where("size(grams) > 0").mapInArrow(anew, "text_key long, size long, first array<long>"))
            # among themselves only: a pair with any other text shares its first shingles in the old order, and all of them are either listed or of joined texts
            pairs, members, crowded = listed(fresh.select(F.explode("first").alias("gram"), "text_key", "size"))
            rest = across(pairs)
            if rest.limit(1).count():
                links = links.union(confirmed(rest))
                roots = connected_components(links, written).toDF("text_key", "root")
    if crowded:
        held, open_ = open_grams(members)
        if open_.limit(1).count():
            mixed = held.join(open_, "gram")
            blocks = connected_components(mixed.select(F.col("text_key").alias("u"), F.col("head").alias("v")), written).toDF("text_key", "block")
            more = cell_links(written(mixed.select("text_key", "root").distinct().join(blocks, "text_key").select("text_key", "block", "root")), grams, similarity, written, cell_rows)
            if more is not None:
                roots = connected_components(links.union(written(more)), written).toDF("text_key", "root")
    written.release()
    grouped = written(own.select("id", "text_key").join(roots, "text_key", "left").select("id", "text_key", F.coalesce("root", "text_key").alias("group_key")))
    written.drop(own_path)
    stay = written(grouped.groupBy("group_key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("first")))
    return grouped.join(stay, "group_key").select("id", "text_key", "group_key", (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_key") == F.col("first.text_key"))).alias("kept"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each group of similar texts, all columns kept whatever their names; a row that repeats the one that stays, id and text, stays once."""
    written = Written(docs.sparkSession)
    found = written(similar_groups(docs, id_col, text_col, **how))
    # columns by place, so that no name of docs can clash
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at, text_at = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    mine = plain.withColumn("key", text_keys(plain, text_at, written))
    gone = found.where("not kept").select(F.col("id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    out = mine.join(gone, mine[at].eqNullSafe(gone["gone_id"]) & (mine["key"] == gone["gone_key"]), "left_anti")
    if found.where("kept").groupBy("id", "text_key").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates([at, "key"])
    return out.drop("key").toDF(*docs.columns)
