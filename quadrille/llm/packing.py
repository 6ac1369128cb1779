"""Packing documents into sequences as a cutting-stock problem.

Each document is cut at the sequence length; what is left over goes by length class
into a histogram. A linear program over patterns of classes that fit a sequence is
solved by column generation: the simplex keeps a basis of patterns, and a knapsack by
dynamic programming finds the pattern that the dual prices value most. The rounded-down
solution is dealt to documents by their rank in their class; the few that rounding leaves are packed best-fit.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, id_type, map_slices, on_worker


def _gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of a pool one after another, and where each begins and the last ends."""
    ends = np.concatenate([[0], np.cumsum(size)])
    return pool[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])], ends


class WordEncoder:
    """Ids of whole texts under a BPE with word ends, whose file splits at white space and lowers case.

    Each different word of a slice of texts is encoded once, and words that differ only in a
    last comma or stop count as one. Words are cut as the file's own pattern cuts
    them, and their pieces merged by the model alone; words for which that cut isn't plainly the same
    (marks of other scripts, control characters) and texts that may hold special tokens go through the whole tokenizer.
    """

    CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each task has a core; threads only cost memory
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.whole.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        rest = iter(range(256, 512))
        self.letter = {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}
        self.marks = [np.array(self.whole.encode(x, add_special_tokens=False).ids, np.uint32) for x in ("", ",", ".")]

    def cut(self, word: str) -> list[str] | None:
        """The pieces of a word in lower case, as bytes' letters; None if only the whole tokenizer can tell."""
        if word.isascii():
            return self.CUT.findall(word) if word.isprintable() and "<|" not in word else None
        tail = ""
        if word[-1] in ",.;:!?":
            word, tail = word[:-1], word[-1]
        if word.isalpha() and word.lower() == word and unicodedata.is_normalized("NFC", word):
            own = word.encode().decode("latin-1").translate(self.letter)
            return [own, tail] if tail else [own]
        return None

    def merged(self, lines: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of n pieces, several a line with spaces between, and how many each has."""
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        got = self.bare.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in got])
        ends = np.flatnonzero(self.final[ids]) + 1
        if len(ends) != n:
            raise ValueError("a word of this vocabulary does not end in a final piece")
        return ids, np.diff(ends, prepend=0)

    def others(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that are not plain ASCII letters."""
        cuts = [self.cut(w) if w else [] for w in words]
        pieces = list({p for x in cuts if x for p in x})
        ids, sizes = self.merged([" ".join(pieces[i : i + 256]) for i in range(0, len(pieces), 256)], len(pieces))
        hard = [w for w, x in zip(words, cuts) if x is None]
        lists = [e.ids for a in range(0, len(hard), 1000) for e in self.whole.encode_batch_fast(hard[a : a + 1000], add_special_tokens=False)]
        place = dict(zip(pieces, range(len(pieces))))
        nth = iter(range(len(pieces), len(pieces) + len(hard)))
        parts = [[next(nth)] if x is None else [place[p] for p in x] for x in cuts]
        ids = np.concatenate([ids, np.array([i for x in lists for i in x], np.uint32)])
        sizes = np.concatenate([sizes, np.array([len(x) for x in lists], np.int64)])
        at = np.array([i for x in parts for i in x], np.int64)
        out, ends = _gather(ids, (np.cumsum(sizes) - sizes)[at], sizes[at])
        return out, np.diff(ends[np.cumsum([0, *map(len, parts)])])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a string column, one after another, and how many each has."""
        column = pc.fill_null(column, "")
        special = pc.match_substring(column, "<|")  # a special token could come of capitals: only the whole tokenizer can tell
        if pc.any(special).as_py():
            mine = special.to_numpy(zero_copy_only=False)
            ids, counts = self.encode(column.filter(pc.invert(special)))
            whole = column.filter(special).to_pylist()
            lists = [np.array(e.ids, np.uint32) for a in range(0, len(whole), 100) for e in self.whole.encode_batch_fast(whole[a : a + 100], add_special_tokens=False)]
            sizes, starts = np.empty(len(column), np.int64), np.empty(len(column), np.int64)
            sizes[~mine], sizes[mine] = counts, [len(x) for x in lists]
            starts[~mine] = np.cumsum(counts) - counts
            starts[mine] = len(ids) + np.cumsum(sizes[mine]) - sizes[mine]
            return _gather(np.concatenate([ids, *lists]), starts, sizes)[0], sizes
        column = pc.ascii_lower(column)
        lists = pc.ascii_split_whitespace(column)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        core = pc.ascii_rtrim(words, characters=",.")
        one = pc.equal(pc.subtract(pc.binary_length(words), pc.binary_length(core)), 1)
        tailed = pc.and_(one, pc.ascii_is_alpha(core))
        mark = np.where(tailed.to_numpy(zero_copy_only=False), np.where(pc.ends_with(words, ",").to_numpy(zero_copy_only=False), 1, 2), 0)
        cores = pc.if_else(tailed, core, words).dictionary_encode()
        kinds = cores.dictionary
        plain = pc.ascii_is_alpha(kinds)
        easy = kinds.filter(plain)
        bounds = [*range(0, len(easy), 256), len(easy)]
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), easy), " ").to_pylist() if len(easy) else []
        ids, sizes = self.merged(lines, len(easy))
        more, counts = self.others(kinds.filter(pc.invert(plain)).to_pylist())
        pool = np.concatenate([ids, more, *self.marks])
        all_sizes = np.concatenate([sizes, counts, [len(x) for x in self.marks]]).astype(np.int64)
        starts = np.cumsum(all_sizes) - all_sizes
        order = np.empty(len(kinds), np.int64)  # of kinds among plain ones and then others
        easy_at = plain.to_numpy(zero_copy_only=False)
        order[easy_at], order[~easy_at] = np.arange(len(easy)), np.arange(len(easy), len(kinds))
        pairs = np.stack([order[cores.indices.to_numpy()], len(kinds) + mark], axis=1).ravel()
        pool, ends = _gather(pool, starts[pairs], all_sizes[pairs])
        at = coded.indices.to_numpy()
        ids, ends = _gather(pool, ends[:-1:2][at], (ends[2::2] - ends[:-1:2])[at])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)])


_ENCODERS: dict[str, WordEncoder] = {}


def pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    """(id, start, length, crc, doc_tokens[, ids]): every document cut at the sequence length."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = WordEncoder(tokenizer)
        encoder = _ENCODERS[tokenizer]
        ids, counts = encoder.encode(batch.column(1))
        tail = np.array([end_id], np.uint32)
        row, start, length, crc, total, kept, at = [], [], [], [], [], [], 0
        for k, n in enumerate(counts.tolist()):
            own = np.concatenate([ids[at : at + n], tail]).astype("<u4")
            at += n
            for a in range(0, n + 1, capacity):
                part = own[a : a + capacity]
                row.append(k)
                start.append(a)
                length.append(len(part))
                crc.append(zlib.crc32(part.tobytes()))
                total.append(n + 1)
                if keep_ids:
                    kept.append(part.astype(np.int32))
        out = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
        names = ["id", "start", "length", "crc", "doc_tokens"]
        if keep_ids:
            out.append(pa.array(kept, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(out, names=names)

    schema = f"id {id_type(docs, id_col)}, start long, length long, crc long, doc_tokens long" + ", ids array<int>" * keep_ids
    return map_slices(docs.select(id_col, text_col), 1, schema, run, slice_bytes=8 << 20)


def best_pattern(price: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of classes that fits, by the unbounded knapsack's dynamic program."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(size, np.arange(capacity + 1), side="right")
    for w in range(1, capacity + 1):
        value[w] = value[w - 1]
        if k := upto[w]:
            gain = value[w - size[:k]] + price[:k]
            best = int(gain.argmax())
            if gain[best] > value[w] + 1e-12:
                value[w], last[w] = gain[best], best
    take, w = np.zeros(len(size)), capacity
    while w > 0:
        if last[w] < 0:
            w -= 1
        else:
            take[last[w]] += 1
            w -= size[last[w]]
    return value[capacity], take


def first_basis(size: np.ndarray, need: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A feasible basis: each pattern fills a sequence around the largest class left, and is used until a class runs out.

    A pattern holds no class that ran out before it, so the columns are triangular up to order and therefore independent.
    """
    m = len(size)
    left, open_, basis, often = need.astype(float), np.ones(m, bool), np.zeros((m, m)), np.zeros(m)
    for _ in range(m):
        rest = np.flatnonzero(open_)
        big = rest[-1]
        _, take = best_pattern(size[rest] * (1 + 1e-3 * size[rest] / capacity), size[rest], int(capacity - size[big]))
        pattern = np.zeros(m)
        pattern[rest] = take
        pattern[big] += 1
        used = np.flatnonzero(pattern)
        out = used[(left[used] / pattern[used]).argmin()]
        n = left[out] / pattern[out]
        left[used] -= n * pattern[used]
        basis[:, out], often[out], open_[out] = pattern, n, False
    return basis, often


def generate(size: np.ndarray, need: np.ndarray, capacity: int, rounds: int = 3000, gap: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a column) and how often the linear program uses each. size ascends.

    Prices are drawn towards those with the best bound so far, which steadies them. It
    ends within gap of that bound; rounds bounds its effort, never what is packed.
    """
    basis, x = first_basis(size, need, capacity)
    inverse = np.linalg.inv(basis)
    best = size / capacity
    bound, pull = best @ need, 0.7
    for k in range(rounds):
        if x.sum() <= bound * (1 + gap):
            break
        price = inverse.sum(0)
        mixed = np.maximum(pull * best + (1 - pull) * price, 0)
        worth, take = best_pattern(mixed, size, capacity)
        if (mixed @ need) / max(worth, 1) > bound:
            best = mixed / max(worth, 1)
            bound = best @ need
        if price @ take <= 1 + 1e-9:  # no gain at the true prices
            if not pull:
                break
            pull = pull - 0.2 if pull > 0.2 else 0.0
            continue
        pull = 0.7
        way = inverse @ take
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        x -= step * way
        x[out] = step
        basis[:, out] = take
        if k % 100 == 99:
            inverse = np.linalg.inv(basis)
            x = inverse @ need
        else:
            row = inverse[out] / way[out]
            inverse -= np.outer(way, row)
            inverse[out] = row
    return basis, np.maximum(x, 0)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[np.ndarray, int, int]]:
    """Patterns as (classes, first sequence, sequences): every counted item gets a place. Classes are sizes from 1 to capacity."""
    sizes = np.array(sorted(c for c in histogram if histogram[c]), np.int64)
    out: list[tuple[np.ndarray, int, int]] = []
    base = 0
    if not len(sizes):
        return out
    left = np.array([histogram[c] for c in sizes.tolist()], np.int64)
    basis, often = generate(sizes, left.astype(float), capacity)
    for j in np.flatnonzero(often >= 1):
        take = basis[:, j].astype(np.int64)
        fits = left[take > 0] // take[take > 0]
        n = min(int(often[j] + 1e-6), int(fits.min()))
        if n:
            out.append((np.repeat(sizes, take), base, n))
            base += n
            left -= n * take
    room: dict[int, list[list[int]]] = {}
    for c, n in zip(sizes[::-1].tolist(), left[::-1].tolist()):
        for _ in range(n):
            free = min((r for r in room if r >= c), default=None)
            items = room[free].pop() if free is not None else []
            if free is not None and not room[free]:
                del room[free]
            items.append(c)
            room.setdefault((capacity if free is None else free) - c, []).append(items)
    for items in (x for r in sorted(room) for x in room[r]):
        out.append((np.array(items), base, 1))
        base += 1
    return out


def slots(patterns: list[tuple[np.ndarray, int, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each class: first ranks, places in a sequence, first sequences and first positions, by which a rank finds its slot."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    for classes, base, n in patterns:
        kinds, first, many = np.unique(classes, return_index=True, return_counts=True)
        for c, p, a in zip(kinds.tolist(), first.tolist(), many.tolist()):
            rows.setdefault(c, []).append((used.get(c, 0), a, base, p))
            used[c] = used.get(c, 0) + a * n
    return {c: tuple(np.array(x, np.int64) for x in zip(*r)) for c, r in rows.items()}


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, unit: int = 8, keep_ids: bool = False) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) for each piece.

    A document is its ids and then end_id, cut at every capacity ids; a null text is
    empty, so it is end_id alone. Lengths are planned in steps of unit, so a pattern
    never exceeds a sequence. Null ids and repeated rows are packed like any other.
    """
    if capacity % unit:
        raise ValueError("capacity must be a multiple of unit")
    written = Written(docs.sparkSession)
    own = written(pieces(docs, tokenizer, id_col, text_col, capacity, end_id, keep_ids))
    salted = own.withColumn("class", F.ceil(F.col("length") / unit).cast("int")).withColumn("salt", F.pmod(F.xxhash64("id", "start", "crc"), F.lit(1024)).cast("int"))
    counts = written(salted.groupBy("class", "salt").count())
    histogram = {r["class"]: r.n for r in counts.groupBy("class").agg(F.sum("count").alias("n")).collect()}  # a row a class
    found = slots(on_worker(docs.sparkSession, lambda: plan(histogram, capacity // unit)))
    before = counts.select("class", "salt", (F.sum("count").over(Window.partitionBy("class").orderBy("salt")) - F.col("count")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("class", "salt").orderBy("length", "id", "start", "crc"))
    ranked = salted.withColumn("nth", nth).join(before, ["class", "salt"]).withColumn("rank", F.col("nth") - 1 + F.col("before")).drop("nth", "before", "salt")

    def place(batches):
        for batch in batches:
            kind, rank = batch.column(batch.schema.get_field_index("class")).to_numpy(), batch.column(batch.schema.get_field_index("rank")).to_numpy()
            seq, pos = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for c in np.unique(kind).tolist():
                mine = np.flatnonzero(kind == c)
                first, a, base, p = found[c]
                k = np.searchsorted(first, rank[mine], side="right") - 1
                inner = rank[mine] - first[k]
                seq[mine], pos[mine] = base[k] + inner // a[k], p[k] + inner % a[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seq), pa.array(pos)], names=[*batch.schema.names, "sequence_id", "pos"])

    ranked = ranked.select(*own.columns, "class", "rank")
    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes) + ", sequence_id long, pos long"
    placed = ranked.mapInArrow(place, schema)
    offset = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    out = placed.withColumn("offset", F.coalesce(offset, F.lit(0)).cast("long"))
    return out.select(F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else []))
