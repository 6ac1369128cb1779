"""Exact substring deduplication: what earlier text already says, in strings of a fixed length.

A string of 100 bytes is told by its anchor: the leftmost least hash of a 32-byte gram
inside it. Equal strings have equal anchors, so strings whose anchors are unique in the corpus
are unique. An occurrence of a repeated anchor stands for the run of strings it anchors; whole
runs that are equal are settled by their first occurrence. Where different runs share an
anchor, tasks sort the suffixes that begin at their anchors, exchange them as front-coded runs (the
length of the prefix that a suffix shares with the one before it, and the rest), and merge
each range with a loser tree that knows these lengths and never compares a known prefix again.
Strings are equal if their suffixes share enough and so do the bytes before the anchors. An anchor
with very many different runs has its strings sorted one by one instead, over all ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, map_slices, texts

GRAM = 32
#: Different runs of one anchor beyond which its strings are dealt out one by one.
CROWD = 20_000
_TABLE = np.random.Generator(np.random.PCG64(100)).integers(0, 2**64, 256, dtype=np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15], np.uint64)[0]
_LAST = 2**63 - 1


def _rolled(values: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hashes of all grams of a length, by doubling; entries past the end cover less."""
    power, step, out, done, scale = _ODD, 1, None, 0, np.uint64(1)
    block = values
    with np.errstate(over="ignore"):
        while True:
            if length & step:
                if out is None:
                    out, done, scale = block.copy(), step, power
                else:  # the bits from low to high: earlier bytes first
                    moved = np.zeros_like(block)
                    moved[: len(block) - done] = block[done:]
                    out, done, scale = out * power + moved, done + step, scale * power
            if 2 * step > length:
                return out
            moved = np.zeros_like(block)
            moved[: max(0, len(block) - step)] = block[step:]
            block, power, step = block * power + moved, power * power, 2 * step


def _slid(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each window of a width that begins at a place; shorter at the end."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[: len(out) - step] = pick(out[: len(out) - step], out[step:].copy())
        have += step
    return out


def anchors(buffer: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: (gram hash, place of the anchor, first and last string it anchors) of each run of strings."""
    n = len(buffer)
    starts = np.arange(n)
    good = np.flatnonzero(ends[np.searchsorted(ends, starts, side="right")] - starts >= length) if n else starts
    if not len(good):
        return good.astype(np.uint64), good, good, good
    h = _rolled(_TABLE[buffer], GRAM)
    h ^= h >> np.uint64(29)
    with np.errstate(over="ignore"):
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    # the place in the low bits: the least is then the leftmost of equal hashes
    bits = np.uint64(max(1, n.bit_length()))
    packed = (h >> bits << bits) | starts.astype(np.uint64)
    place = (_slid(packed, length - GRAM + 1, np.minimum)[good] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (good[1:] != good[:-1] + 1)]))
    last = np.concatenate([head[1:], [len(good)]]) - 1
    return h[place[head]], place[head], good[head], good[last]


def _laid(column: pa.Array) -> tuple[bytes, np.ndarray]:
    many = texts(column)
    return b"".join(many), np.cumsum([len(t) for t in many]).astype(np.int64)


def runs(docs: DataFrame, length: int) -> DataFrame:
    """(gram, run, k, at) of each run of strings of docs (k, tid, text). at packs the first string's place, how far the anchor is from it, how many strings follow, and tid."""
    import xxhash

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        joined, ends = _laid(batch.column(2))
        gram, place, lo, hi = anchors(np.frombuffer(joined, np.uint8), ends, length)
        row = np.searchsorted(ends, lo, side="right")
        begin = np.concatenate([[0], ends])[row]
        digest = xxhash.xxh3_64_intdigest
        seen = np.fromiter((digest(joined[a:b], c) for a, b, c in zip(lo.tolist(), (hi + length).tolist(), (place - lo).tolist())), np.uint64, len(lo))
        k, tid = batch.column(0).to_numpy()[row], batch.column(1).to_numpy().astype(np.int64)[row]
        at = (lo - begin) << 32 | (place - lo) << 24 | (hi - lo) << 16 | tid
        return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(seen.view(np.int64)), pa.array(k), pa.array(at)], names=["gram", "run", "k", "at"])

    return map_slices(docs, 2, "gram long, run long, k long, at long", run, slice_bytes=1 << 20)


def grams(docs: DataFrame, length: int) -> DataFrame:
    """(gram, n) of the anchors of docs (k, tid, text), once a slice."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        joined, ends = _laid(batch.column(2))
        gram, counts = np.unique(anchors(np.frombuffer(joined, np.uint8), ends, length)[0].view(np.int64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(np.minimum(counts, 2).astype(np.int8))], names=["gram", "n"])

    return map_slices(docs, 2, "gram long, n byte", run, slice_bytes=1 << 20)


# --- the distributed merge sort ---


def front_code(strings: list[bytes], ks: np.ndarray, starts: np.ndarray, befores: list[bytes] | None = None) -> dict:
    """A sorted run of strings: shared prefix lengths, the rest of each string, where each begins, and the bytes before it."""
    shared, sizes, rest, last = bytearray(), bytearray(), [], b""
    for t in strings:
        n = _against(last, t, 0)[1]
        shared.append(n)
        sizes.append(len(t) - n)
        rest.append(t[n:])
        last = t
    befores = befores or []
    return {
        "shared": bytes(shared), "sizes": bytes(sizes), "rest": b"".join(rest), "ks": ks.astype(np.int64).tobytes(), "starts": starts.astype(np.int64).tobytes(),
        "before_sizes": bytes(map(len, befores)), "befores": b"".join(befores),
    }


RUN = ("shared", "sizes", "rest", "ks", "starts", "before_sizes", "befores")


def _decoded(run: dict) -> Iterator[tuple[bytes, int, int, int, bytes]]:
    """(string, prefix shared with the one before, k, start, bytes before it) of a run."""
    last, at, left, rest, befores = b"", 0, 0, run["rest"], run["befores"]
    before_sizes = run["before_sizes"] or bytes(len(run["shared"]))
    for n, m, k, start, size in zip(run["shared"], run["sizes"], np.frombuffer(run["ks"], np.int64).tolist(), np.frombuffer(run["starts"], np.int64).tolist(), before_sizes):
        last = last[:n] + rest[at : at + m]
        at += m
        yield last, n, k, start, befores[left : left + size]
        left += size


def _against(a: bytes, b: bytes, known: int) -> tuple[bool, int]:
    """Whether a comes before b (or equals it), and how long a prefix they share, given that they share `known`."""
    x, y = a[known:], b[known:]
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return len(x) <= len(y), known + n
    differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return x < y, known + n - (differ.bit_length() + 7) // 8


def merge(runs_: list[dict]) -> Iterator[tuple[bytes, int, int, int, bytes]]:
    """(string, prefix shared with the one before, k, start, bytes before it) of all runs in order; equal strings by k and start.

    A loser tree. Each loser keeps the prefix it shares with the winner that beat it.
    The next candidate knows, from its run's coding, what it shares with the last winner,
    so a longer known prefix wins without a look at a byte, and equal ones are compared from there on.
    """
    sources = [_decoded(r) for r in runs_]
    m = 1
    while m < len(sources):
        m *= 2
    heads: list[tuple | None] = [None] * m
    known = [0] * m  # what each head shares with the last string out

    def advance(i: int) -> None:
        got = next(sources[i], None) if i < len(sources) else None
        heads[i], known[i] = (None, -1) if got is None else (got, got[1])

    def beats(i: int, j: int) -> bool:
        """Whether head i goes before head j; sets what the loser shares with the winner."""
        if heads[j] is None or heads[i] is None:
            return heads[j] is None
        if known[i] != known[j]:
            return known[i] > known[j]  # the loser's stays true of the new winner
        first, shared = _against(heads[i][0], heads[j][0], known[i])
        if shared == len(heads[i][0]) == len(heads[j][0]):
            first = heads[i][2:4] <= heads[j][2:4]
        known[j if first else i] = shared
        return first

    losers = [-1] * m
    for i in range(m):
        advance(i)

    def play(node: int) -> int:
        if node >= m:
            return node - m
        a, b = play(2 * node), play(2 * node + 1)
        if beats(a, b):
            losers[node] = b
            return a
        losers[node] = a
        return b

    winner = play(1) if m > 1 else 0
    while heads[winner] is not None:
        string, _, k, start, before = heads[winner]
        yield string, known[winner], k, start, before
        advance(winner)
        node = (winner + m) // 2
        while node:
            if not beats(winner, losers[node]):
                winner, losers[node] = losers[node], winner
            node //= 2


RUN_SCHEMA = "range int, " + ", ".join(f"{c} binary" for c in RUN)


def _run_rows(out: list[tuple[int, dict]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int32()), *(pa.array([x[c] for _, x in out], pa.binary()) for c in RUN)], names=["range", *RUN])


def _runs_of(pdf: pd.DataFrame) -> list[dict]:
    return [{c: bytes(v) for c, v in r.items()} for r in pdf[list(RUN)].to_dict("records")]


def _sorted_runs(batches, length: int, cuts: list[bytes], most: int):
    """Front-coded runs by range, of at most `most` suffixes each, and the repeats found on the way."""
    from bisect import bisect_left

    strings: list[bytes] = []
    ks: list[int] = []
    starts: list[int] = []

    def flush():
        order = sorted(range(len(strings)), key=lambda i: (strings[i], ks[i], starts[i]))
        own, where, again = [], [], []
        for i in order:
            if own and own[-1] == strings[i]:
                if (ks[i], starts[i]) != (ks[where[-1]], starts[where[-1]]):
                    again.append(i)
            else:
                own.append(strings[i])
                where.append(i)
        bounds = [0, *(bisect_left(own, c) for c in cuts), len(own)]
        k, start = np.array(ks, np.int64), np.array(starts, np.int64)
        out = [(-1, dict.fromkeys(RUN, b"") | {"ks": k[again].tobytes(), "starts": start[again].tobytes()})] if again else []
        for r, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            if b > a:
                out.append((r, front_code(own[a:b], k[where[a:b]], start[where[a:b]])))
        strings.clear(), ks.clear(), starts.clear()
        return _run_rows(out)

    for batch in batches:
        for k, tid, raw, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), batch.column(3).to_pylist()):
            for at in sorted(set(own)):
                lo, more = at >> 32, at >> 16 & 255
                for i in range(lo, lo + more + 1):
                    strings.append(raw[i : i + length])
                    ks.append(k)
                    starts.append(i << 16 | tid)
            if len(strings) >= most:
                yield flush()
    if strings:
        yield flush()


def repeated_strings(reps: DataFrame, length: int, written: Written, most: int = 200_000) -> DataFrame:
    """(k, start, tid) of the strings of docs (k, tid, text, ats) that occur earlier among them too."""
    spark = reps.sparkSession

    def first(batches):
        for batch in batches:
            found = [t[a >> 32 :][:length] for t, a in zip(texts(batch.column(0)), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["s"])

    total = reps.agg(F.sum(F.expr("aggregate(ats, 0L, (a, x) -> a + (shiftright(x, 16) & 255) + 1)"))).first()[0] or 0
    # splitters: a bounded sample of the runs' first strings
    own = reps.select("k", "text", F.explode("ats").alias("at")).where(F.pmod(F.xxhash64("k", "at"), F.lit(max(1, total // 40_000))) == 0)
    keys = sorted({bytes(r.s) for r in own.select("text", "at").mapInArrow(first, "s binary").limit(8000).collect()})
    ranges = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // most)))
    cuts = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []
    table = written(reps.mapInArrow(lambda batches: _sorted_runs(batches, length, cuts, most), RUN_SCHEMA))

    def merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ks, starts, first = [], [], None
        for _, shared, k, start, _ in merge(_runs_of(pdf)):
            if shared == length:
                if (k, start >> 16) != first:
                    ks.append(k)
                    starts.append(start)
            else:
                first = (k, start >> 16)
        return pd.DataFrame({"k": np.array(ks, np.int64), "at": np.array(starts, np.int64)})

    def unpacked(batches):
        for batch in batches:
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k, np.int64)), pa.array(np.frombuffer(s, np.int64))], names=["k", "at"])

    across = table.where("range >= 0").groupBy("range").applyInPandas(merged, "k long, at long")
    within = table.where("range < 0").select("ks", "starts").mapInArrow(unpacked, "k long, at long")
    return across.union(within).select("k", F.shiftright("at", 16).alias("start"), F.col("at").bitwiseAND(65535).cast("int").alias("tid"))


def _shared_strings(items: list[tuple[bytes, int, int, int, bytes]], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(k, tid, from, to) of the bytes that repeat earlier ones, among suffixes of one anchor in their order.

    An item's string begins at its anchor, its start packs place, strings that follow the first, and tid; before it are the bytes from its first string on.
    """
    most = max(len(b) for *_, b in items)
    need = length - np.arange(most + 1)  # bytes that strings with so many before the anchor need of the suffix
    shared = np.array([n for _, n, *_ in items])
    shared[0] = 0
    block = np.cumsum(shared[:, None] < need[None, :], axis=0).tolist()
    seen: dict[tuple, tuple[int, int]] = {}
    places = [((start >> 24), start >> 16 & 255, start & 65535) for *_, start, _ in items]
    for i in sorted(range(len(items)), key=lambda i: (items[i][2], places[i][0])):
        _, _, k, _, before = items[i]
        at, more, tid = places[i]
        own, begin, end = block[i], -1, -1
        for e in range(len(before), len(before) - more - 1, -1):  # so many bytes before the anchor
            key = (e, own[e], before[len(before) - e :])
            first = seen.setdefault(key, (k, at - e))
            if first != (k, at - e):
                if at - e > end:
                    if end >= 0:
                        yield k, tid, begin, end
                    begin = at - e
                end = at - e + length
        if end >= 0:
            yield k, tid, begin, end


def repeated_segments(reps: DataFrame, length: int, written: Written, most: int = 100_000) -> DataFrame:
    """(k, tid, a, b): the bytes that repeat earlier strings, for runs of docs (k, tid, text, ats) that share their anchors."""
    spark = reps.sparkSession

    def suffixes(batches):
        for batch in batches:
            ks, starts, befores, strings = [], [], [], []
            for k, tid, raw, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), batch.column(3).to_pylist()):
                for at in own:
                    lo, off, more = at >> 32, at >> 24 & 255, at >> 16 & 255
                    ks.append(k)
                    starts.append((lo + off) << 24 | more << 16 | tid)
                    befores.append(raw[lo : lo + off])
                    strings.append(raw[lo + off : lo + more + length])
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(starts, pa.int64()), pa.array(befores, pa.binary()), pa.array(strings, pa.binary())], names=["k", "start", "before", "string"])

    table = written(reps.mapInArrow(suffixes, "k long, start long, before binary, string binary"))
    written.release()
    total = table.count()
    # splitters: grams of a bounded sample, so that suffixes of one anchor stay together
    some = table.where(F.pmod(F.xxhash64("string", "k"), F.lit(max(1, total // 4000))) == 0)
    sample = some.select(F.substring("string", 1, GRAM).alias("s")).limit(8000).collect()
    keys = sorted({bytes(r.s) for r in sample})
    ranges = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // most)))
    cuts = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []

    def sort(batches):
        from bisect import bisect_left

        for batch in batches:
            ks, starts = (batch.column(i).to_numpy() for i in (0, 1))
            befores, strings = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            order = sorted(range(len(strings)), key=lambda i: (strings[i], ks[i], starts[i]))
            own, left = [strings[i] for i in order], [befores[i] for i in order]
            bounds = [0, *(bisect_left(own, c) for c in cuts), len(own)]
            out = [(r, front_code(own[a:b], ks[order[a:b]], starts[order[a:b]], left[a:b])) for r, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a]
            if out:
                yield _run_rows(out)

    def merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found, group = [], []
        for item in merge(_runs_of(pdf)):
            if item[1] < GRAM and group:
                found += _shared_strings(group, length)
                group = []
            group.append(item)
        if group:
            found += _shared_strings(group, length)
        return pd.DataFrame(found, columns=["k", "tid", "a", "b"])

    return table.mapInArrow(sort, RUN_SCHEMA).groupBy("range").applyInPandas(merged, "k long, tid int, a long, b long")


def text_number(docs: DataFrame, k: Column, text: Column, tries: int = 64) -> Column:
    """A number of 16 bits that tells the different texts of one id apart; raises if an id has so many that no hash does."""
    for seed in range(tries):
        number = F.pmod(F.xxhash64(text, F.lit(seed)), F.lit(65536)).cast("int")
        both = docs.select(k.alias("k"), number.alias("n"), F.xxhash64(text, F.lit(-1)).alias("h")).groupBy("k", "n").agg((F.min("h") < F.max("h")).alias("clash"))
        if not both.where("clash").limit(1).count():
            return number
    raise ValueError("an id has too many different texts")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, crowd: int = CROWD) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept, kept_sha256) of each row.

    A byte goes if a string of length bytes covers it that also starts earlier: in a row of
    smaller id, or earlier in its own. Ids are integers; null ones count as the
    largest. Rows of one id are one document: the same place in them is not earlier. Null texts are empty.
    Whole runs count as equal if two 64-bit hashes of different kinds are, of their anchor and of all their bytes.
    """
    if not GRAM < length <= GRAM + 255:
        raise ValueError(f"length must be from {GRAM + 1} to {GRAM + 255}")
    written = Written(docs.sparkSession)
    k = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    text = F.coalesce(F.col(text_col), F.lit(""))
    repeated_ids = docs.groupBy(k).count().where("count > 1").limit(1).count() > 0
    tid_of = text_number(docs, k, text) if repeated_ids else F.lit(0)
    own = docs.select(k.alias("k"), tid_of.alias("tid"), text.alias("text"))
    often, often_path = written.table(grams(own, length).groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram"))
    found = written(runs(own, length).join(often, "gram", "left_semi"))
    written.drop(often_path)
    written.release()
    firsts = written(found.groupBy("gram", "run").agg(F.min(F.struct("k", "at")).alias("first")))
    # runs that are equal: all but the first go whole
    later = (F.col("k") > F.col("first.k")) | ((F.col("k") == F.col("first.k")) & (F.shiftright("at", 32) > F.shiftright("first.at", 32)))
    place, more, tid = F.shiftright("at", 32), F.shiftright("at", 16).bitwiseAND(255), F.col("at").bitwiseAND(65535).cast("int")
    whole = found.join(firsts, ["gram", "run"]).where(later).select("k", tid.alias("tid"), place.alias("a"), (place + more + length).alias("b"))
    several = written(firsts.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"))
    reps = firsts.join(several, "gram").select("first.k", "first.at", (F.col("n") > crowd).alias("crowded")).withColumn("tid", tid)

    def with_text(some: DataFrame) -> DataFrame:
        by_text = some.groupBy("k", "tid").agg(F.collect_set("at").alias("ats"))  # at most as many as the text has bytes
        found = own.join(by_text, ["k", "tid"]).select("k", "tid", "text", "ats")
        return found.dropDuplicates(["k", "tid"]) if repeated_ids else found

    single = repeated_segments(with_text(reps.where(~F.col("crowded"))), length, written)
    if several.where(F.col("n") > crowd).limit(1).count():
        crowded = repeated_strings(written(with_text(reps.where("crowded"))), length, written)
        single = single.union(crowded.select("k", "tid", F.col("start").alias("a"), (F.col("start") + length).alias("b")))
    spans = whole.union(single).groupBy("k", "tid").agg(F.collect_list(F.struct("a", "b")).alias("spans"))  # at most as many as the text has bytes
    spans = written(spans)
    written.release()
    base = docs.select(F.col(id_col).alias("id"), k.alias("k"), tid_of.alias("tid"), text.alias("text"))
    joined = base.join(spans, ["k", "tid"], "left").select("id", "text", "spans")
    kind = dict(base.dtypes)["id"]

    def cut(batches):
        from .common import slices

        for batch in batches:
            for piece in slices(batch, 1):
                many, kept, gone, count = texts(piece.column(1)), [], [], []
                for raw, own_spans in zip(many, piece.column(2).to_pylist()):
                    parts, at, n, total = [], 0, 0, 0
                    begin = end = -1
                    for a, b in sorted((x["a"], x["b"]) for x in own_spans or ()):
                        if a > end:
                            if end >= 0:
                                parts.append(raw[at:begin])
                                at, n, total = end, n + 1, total + end - begin
                            begin, end = a, b
                        else:
                            end = max(end, b)
                    if end >= 0:
                        parts.append(raw[at:begin])
                        at, n, total = end, n + 1, total + end - begin
                    kept.append(b"".join([*parts, raw[at:]]))
                    gone.append(total)
                    count.append(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        pa.array([len(t) for t in many], pa.int64()),
                        pa.array(gone, pa.int64()),
                        pa.array(count, pa.int64()),
                        pa.array(kept, pa.binary()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string()),
                    ],
                    names=[id_col, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
                )

    return joined.mapInArrow(cut, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
