"""Quality classification by votes of near neighbours in a latent-semantic space.

Terms are what a text looks like (runs of letters by case, digits, punctuation), what
it says (words) and how it repeats itself, hashed into a fixed number of columns. A
bounded sample of labelled texts gives term weights and a truncated singular value decomposition;
its vectors are broadcast. Every document's vector is multiplied with all of them, in
blocks, and the labels of the nearest vote by similarity.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, map_slices, texts

SHAPES, WORDS, HABITS = 768, 1024, 64
WIDTH = SHAPES + WORDS + HABITS
_KIND = np.arange(256, dtype=np.uint8)
_KIND[128:] = ord("a")
for _a, _b, _c in ((65, 90, "A"), (97, 122, "a"), (48, 57, "9")):
    _KIND[_a : _b + 1] = ord(_c)
_RUNS = np.zeros(256, bool)
_RUNS[[ord(c) for c in "aA9"]] = True


def shapes(text: bytes) -> bytes:
    """The text with each run of letters of one case, or of digits, as one character."""
    kinds = _KIND[np.frombuffer(text, np.uint8)]
    return kinds[np.concatenate([[True], (kinds[1:] != kinds[:-1]) | ~_RUNS[kinds[1:]]])].tobytes() if len(kinds) else b""


def terms(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Columns and weights of one text's terms."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.array([SHAPES + WORDS]), np.array([1.0])
    looks, says = Counter(shapes(text).split()), Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = {
        "distinct": len(says) / n,
        "twice": sum(map(eq, words, words[1:])) / n,
        "top": max(says.values()) / n,
        "lines": len(set(lines)) / max(1, len(lines)),
        "long": min(1.0, len(text) / n / 40),
        "plain": looks[b"a"] / n,
    }
    at, much = [], []
    for first, size, counts in ((0, SHAPES, looks), (SHAPES, WORDS, says)):
        at += [first + zlib.crc32(t) % size for t in counts]
        much += [c / n for c in counts.values()]
    for k, v in enumerate(share.values()):
        at.append(SHAPES + WORDS + 1 + 8 * k + min(7, int(8 * v)))
        much.append(0.25)
    at.append(SHAPES + WORDS + 56 + min(7, int(np.log10(n) * 2)))
    much.append(0.02)
    return np.array(at), np.array(much)


def rows_of(many: list[bytes]) -> np.ndarray:
    """Term weights, a row for each text: square roots of the shares of its words."""
    out = np.zeros((len(many), WIDTH), np.float32)
    for row, t in zip(out, many):
        at, much = terms(t)
        np.add.at(row, at, much)
    return np.sqrt(out)


class Space:
    """Term weights, axes, and labelled vectors."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, rank: int = 48, nearest: int = 25, power: float = 8.0):
        self.nearest, self.power, self.base = nearest, power, float(labels.mean()) if len(labels) else 0.5
        n = max(1, len(rows))
        self.weight = np.log((1 + n) / (1 + (rows > 0).sum(0))).astype(np.float32) + 1
        self.weight[SHAPES : SHAPES + WORDS] *= 0.3
        scaled = rows * self.weight
        values, axes = np.linalg.eigh(scaled.T @ scaled) if len(rows) else (np.zeros(1), np.zeros((WIDTH, 1)))
        self.axes = axes[:, ::-1][:, :rank].astype(np.float32)
        self.vectors, self.labels = self.project(rows), labels.astype(np.float32)

    def project(self, rows: np.ndarray) -> np.ndarray:
        out = (rows * self.weight) @ self.axes
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The share of label 1 among the nearest, by similarity."""
        if not len(self.labels):
            return np.full(len(rows), self.base)
        like = np.maximum(self.project(rows) @ self.vectors.T, 0)
        k = min(self.nearest, len(self.labels))
        least = -np.partition(-like, k - 1, axis=1)[:, k - 1 : k]
        vote = np.where(like >= least, like.astype(np.float64) ** self.power + 1e-9, 0)  # with all that tie for the last place
        return np.clip(vote @ self.labels / vote.sum(1), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 4096, **how) -> Space:
    """A space from at most `most` labelled texts of those in labels, chosen by a hash of their ids.

    Rows of labels with a null id or label are ignored, and of several for one id the
    largest label counts. most bounds what is gathered and broadcast.
    """
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("_label"))
    chosen = own.orderBy(F.xxhash64("_id"), "_id").limit(most)
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_text", "_label")  # most rows of 16 bytes

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = rows_of(texts(batch.column(0)))
        return pa.RecordBatch.from_arrays([pa.array([r.astype(np.float16).tobytes() for r in rows], pa.binary()), batch.column(1)], names=["row", "label"])

    def build(batches):
        got = [pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        rows = np.array([np.frombuffer(r, np.float16) for r, _ in got], np.float32).reshape(-1, WIDTH)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Space(rows, np.array([n for _, n in got]), **how))], pa.binary())], names=["space"])
        del got, rows
        give_back()

    # at most `most` rows of 4 kB, in one task; the driver only gets the axes and the vectors
    rows = map_slices(found, 0, "row binary, label double", run).orderBy("row", "label").limit(most).coalesce(1)
    made = rows.mapInArrow(build, "space binary").collect()
    return pickle.loads(made[0].space) if made else Space(np.zeros((0, WIDTH), np.float32), np.zeros(0), **how)


def score(docs: DataFrame, space: Space, text_col: str = "text", score_col: str = "score", block: int = 512) -> DataFrame:
    """docs with score_col, from the text alone; null and empty texts are scored as texts without words.

    All labelled vectors that tie for the last place vote. Repeated rows are scored each; a column of docs named score_col is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(space)
    names = [c for c in docs.columns if c != score_col]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        many, out = texts(batch.column(names.index(text_col))), []
        for a in range(0, len(many), block):
            out.append(shared.value.score(rows_of(many[a : a + block])))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], names=[*names, score_col])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{score_col}` double"
    return map_slices(docs, names.index(text_col), schema, run)
