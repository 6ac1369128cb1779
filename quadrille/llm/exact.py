"""Exact deduplication by content-defined chunk recipes.

A text is cut where a rolling hash of its last 32 bytes says so. Its recipe is the ordered
list of its chunks' identifiers. Texts are equal if their recipes are, so long texts
themselves are never compared or grouped: chunk bytes move once for each distinct
chunk of a map task, only to verify that an identifier stands for one content.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, give_back, id_type, map_slices, texts

_GEAR = np.random.Generator(np.random.PCG64(2048)).integers(0, 2**32, 256, dtype=np.uint32)


def cut(text: bytes, least: int = 1024, mean_bits: int = 12, most: int = 16384) -> list[bytes]:
    """Content-defined chunks of a text; an empty text has none."""
    if len(text) <= least:
        return [text] if text else []
    h = _GEAR[np.frombuffer(text, np.uint8)]
    for s in (1, 2, 4, 8, 16):  # after each step h covers the last 2 s bytes
        h[s:] += h[:-s] << np.uint32(s)
    marks = np.flatnonzero(h >> np.uint32(32 - mean_bits) == 0) + 1
    out, at, i, end = [], 0, 0, len(text)
    marks = marks.tolist()
    while end - at > least:
        while i < len(marks) and marks[i] < at + least:
            i += 1
        to = min(marks[i] if i < len(marks) else end, at + most, end)
        out.append(text[at:to])
        at = to
    if at < end:
        out.append(text[at:])
    return out


def _digest(chunk: bytes, size: int) -> bytes:
    return hashlib.sha256(chunk).digest()[:size]


def recipes(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, uid, recipe, sha, n_bytes) for each row; uid tells rows apart once the table is written."""

    def run(batches):
        from .common import slices

        seen = TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece in slices(batch, 1):
                all_texts = texts(piece.column(1))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        pa.array(range(seen, seen + len(all_texts)), pa.int64()),
                        pa.array([b"".join(_digest(c, size) for c in cut(t)) for t in all_texts], pa.binary()),
                        pa.array([hashlib.sha256(t).digest() for t in all_texts], pa.binary()),
                        pa.array([len(t) for t in all_texts], pa.int64()),
                    ],
                    names=["id", "uid", "recipe", "sha", "n_bytes"],
                )
                seen += len(all_texts)
                del piece, all_texts
                give_back()

    return docs.select(id_col, text_col).mapInArrow(run, f"id {id_type(docs, id_col)}, uid long, recipe binary, sha binary, n_bytes long")


def chunks(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """(sha, at, chunk_id, chunk): every chunk of every text."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        shas, ats, ids, found = [], [], [], []
        for t in texts(piece.column(0)):
            own = cut(t)
            shas += [hashlib.sha256(t).digest()] * len(own)
            ats += range(len(own))
            ids += [_digest(c, size) for c in own]
            found += own
        return pa.RecordBatch.from_arrays([pa.array(shas, pa.binary()), pa.array(ats, pa.int32()), pa.array(ids, pa.binary()), pa.array(found, pa.binary())], names=["sha", "at", "chunk_id", "chunk"])

    return map_slices(docs.select(text_col), 0, "sha binary, at int, chunk_id binary, chunk binary", run)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bytes: int = 16) -> DataFrame:
    """(id_col, uid, keep_id, group_size, kept, text_sha256, n_bytes) for each row.

    Of equal texts the row with the largest id stays; of repeated rows with that id,
    one. Null counts as empty text; a null id stays only if its group has no other.
    """
    written = Written(docs.sparkSession)
    own = written(recipes(docs, id_col, text_col, id_bytes))
    parts = chunks(docs, text_col, id_bytes)
    shared = written(parts.select("chunk_id", "chunk").distinct().groupBy("chunk_id").agg(F.count("*").alias("contents")).where("contents > 1"))
    if shared.limit(1).count():  # an identifier stands for several contents: number them
        several = parts.join(shared, "chunk_id", "left_semi").select("chunk_id", "chunk").distinct()
        numbered = several.withColumn("nth", F.row_number().over(Window.partitionBy("chunk_id").orderBy("chunk")))
        verified = parts.join(numbered, ["chunk_id", "chunk"], "left").select("sha", "at", F.concat("chunk_id", F.unhex(F.lpad(F.hex(F.coalesce("nth", F.lit(0))), 8, "0"))).alias("part"))
        lists = verified.distinct().groupBy("sha").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))
        lists = lists.select("sha", F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.part))").alias("recipe"))
        own = written(own.drop("recipe").join(lists, "sha", "left").withColumn("recipe", F.coalesce("recipe", F.lit(b""))))
    groups = written(own.groupBy("recipe").agg(F.max(F.struct("id", "uid")).alias("last"), F.count("*").alias("group_size")))  # so the join can split a hot recipe
    return own.join(groups, "recipe").select(
        F.col("id").alias(id_col),
        "uid",
        F.col("last.id").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("last.uid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "n_bytes",
    )


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their hash as sha, whose id and text kept has as id_col and text_sha256; columns are called c0, c1 and so on, so no name can clash."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at, text_at = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    mine = plain.withColumn("sha", F.sha2(F.coalesce(F.col(text_at), F.lit("")).cast("binary"), 256))
    chosen = kept.select(F.col(id_col).alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    return mine.join(chosen, mine[at].eqNullSafe(chosen["kept_id"]) & (mine["sha"] == chosen["kept_sha"]), "left_semi")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without exact duplicates, all columns kept whatever their names; equal rows of one id stay once."""
    written = Written(docs.sparkSession)
    found = written(exact_duplicates(docs, id_col, text_col))
    stay = found.where("kept")
    out = keep_rows(docs, stay, id_col, text_col)
    repeated = found.where("group_size > 1").groupBy(id_col, "text_sha256").count().where("count > 1")
    if repeated.limit(1).count():
        out = out.dropDuplicates([f"c{docs.columns.index(id_col)}", "sha"])
    return out.drop("sha").toDF(*docs.columns)
