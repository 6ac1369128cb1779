"""SentencePiece models on the tokenizers library.

The model file is read by its protobuf wire format; normaliser, metaspace marker,
scores (as unigram scores, or as merge ranks of a BPE model) and byte fallback are
rebuilt as a tokenizers pipeline. A text is cut before each run of spaces, which no
piece crosses; each different part of a batch is then encoded once, by the batch encoder's threads.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, map_slices, texts

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)


def _fields(data: bytes):
    """(field, value) of a protobuf message; nested messages and strings stay bytes."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 1:
            at += 8
            yield key >> 3, data[at - 8 : at]
        elif kind == 2:
            n = varint()
            at += n
            yield key >> 3, data[at - n : at]
        elif kind == 5:
            at += 4
            yield key >> 3, data[at - 4 : at]
        else:
            raise ValueError(f"wire type {kind} in a model file")


def parse(data: bytes) -> dict:
    """pieces [(text, score, type)], kind (1 unigram, 2 BPE), charsmap, dummy_prefix, trim and byte_fallback of a model."""
    out = {"pieces": [], "kind": 1, "charsmap": b"", "dummy_prefix": True, "trim": True, "byte_fallback": False}
    for field, value in _fields(data):
        if field == 1:
            piece = dict(_fields(value))
            out["pieces"].append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif field == 2:
            spec = dict(_fields(value))
            out["kind"], out["byte_fallback"] = spec.get(3, 1), bool(spec.get(35, 0))
        elif field == 3:
            spec = dict(_fields(value))
            out["charsmap"] = spec.get(2, b"")
            out["dummy_prefix"], out["trim"] = bool(spec.get(3, 1)), bool(spec.get(4, 1))
    return out


def rebuild(model: dict):
    """The tokenizers pipeline of a parsed model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    pieces = model["pieces"]
    unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
    if model["kind"] == 1:
        core = models.Unigram([(p, s) for p, s, _ in pieces], unknown, model["byte_fallback"])
    elif model["kind"] == 2:
        vocabulary = {p: i for i, (p, _, _) in enumerate(pieces)}
        whole = {p: s for p, s, t in pieces if t in (NORMAL, USER, UNUSED)}
        merges = [(-s, vocabulary[p], p[:k], p[k:]) for p, s in whole.items() for k in range(1, len(p)) if p[:k] in whole and p[k:] in whole]
        core = models.BPE(vocabulary, [(a, b) for *_, a, b in sorted(merges)], unk_token=pieces[unknown][0], fuse_unk=True, byte_fallback=model["byte_fallback"])
    else:
        raise ValueError(f"model type {model['kind']} has no counterpart")
    steps = [normalizers.Precompiled(model["charsmap"])] if model["charsmap"] else []
    if model["trim"]:
        steps += [normalizers.Strip(left=True, right=True), normalizers.Replace(Regex(" {2,}"), " ")]
    if model["dummy_prefix"]:
        steps.append(normalizers.Prepend(MARK))
    tokenizer = Tokenizer(core)
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model["dummy_prefix"] else [])])
    return tokenizer


def _gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of a pool, one after another."""
    ends = np.cumsum(size)
    return pool[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Codec:
    """Encodes and decodes texts; checks every different part against the sentencepiece library if told to."""

    #: parts that are encoded as one line: their ids are told apart by the marker that begins each
    LINE = 256

    def __init__(self, data: bytes, verify: bool = True):
        self.model = parse(data)
        self.tokenizer = rebuild(self.model)
        pieces = self.model["pieces"]
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p, _, t in pieces if t in (NORMAL, USER, UNUSED))
        #: parts may be encoded apart if white space is kept and no piece crosses their left edges
        self.by_part = self.tokenizer.token_to_id(MARK) is not None and not crossing and not self.model["charsmap"] and not self.model["trim"] and self.model["dummy_prefix"]
        self.first = np.array([p.startswith(MARK) for p, *_ in pieces])
        shown = [bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode() for p, _, t in pieces]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_size = np.array([len(x) for x in shown], np.int64)
        self.shown_start = np.cumsum(self.shown_size) - self.shown_size
        self.plain = np.array([t not in (UNKNOWN, CONTROL) for *_, t in pieces])
        self.other = None
        if verify:
            import sentencepiece

            self.other = sentencepiece.SentencePieceProcessor(model_proto=data)

    def _whole(self, many: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(many, add_special_tokens=False)]
        same = [a == b for a, b in zip(lists, self.other.encode(many))] if self.other else [True] * len(many)
        return np.array([i for x in lists for i in x], np.uint32), np.array([len(x) for x in lists], np.int64), np.array(same, bool)

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of each part, none of which is empty or has a space."""
        bounds = [*range(0, len(parts), self.LINE), len(parts)]
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), parts), " ").to_pylist()
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
        starts = np.flatnonzero(self.first[ids])
        if len(starts) != len(parts):
            return self._whole(parts.to_pylist())
        same = np.ones(len(parts), bool)
        if self.other:
            want = np.concatenate([np.array(x, np.uint32) for x in self.other.encode(lines)])
            if not np.array_equal(ids, want):
                return self._whole(parts.to_pylist())
        return ids, np.diff(starts, append=len(ids)), same

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts of a string column, one after another, how many each has, and whether sentencepiece gives the same (true where it isn't asked)."""
        column = pc.fill_null(column, "")
        n = len(column)
        easy = pc.match_substring_regex(column, f"^ | $|  |{MARK}|^$") if self.by_part else pa.array([True] * n)
        easy = ~easy.to_numpy(zero_copy_only=False)
        counts, same = np.zeros(n, np.int64), np.ones(n, bool)
        pools = []
        if easy.any():
            lists = pc.split_pattern(column.filter(pa.array(easy)), " ")
            coded = lists.flatten().dictionary_encode()
            ids, sizes, agree = self._parts(coded.dictionary)
            at = coded.indices.to_numpy()
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
            pools.append(_gather(ids, (np.cumsum(sizes) - sizes)[at], sizes[at]))
            counts[easy] = np.diff(np.concatenate([[0], np.cumsum(sizes[at])])[bounds])
            same[easy] = np.diff(np.concatenate([[0], np.cumsum(~agree[at])])[bounds]) == 0
        if not easy.all():
            ids, counts[~easy], same[~easy] = self._whole(column.filter(pa.array(~easy)).to_pylist())
            pools.append(ids)
        if easy.all() or not easy.any():
            return pools[0] if pools else np.zeros(0, np.uint32), counts, same
        order = np.concatenate([np.flatnonzero(easy), np.flatnonzero(~easy)])
        starts = np.empty(n, np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return _gather(np.concatenate(pools), starts, counts), counts, same

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts of ids, in UTF-8; bytes that are no UTF-8 become replacement characters."""
        out, ends = [], np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            own = ids[a:b]
            if len(own) and not self.plain[own].all():
                out.append(self.tokenizer.decode(own.tolist(), skip_special_tokens=False).encode())
                continue
            sizes = self.shown_size[own]
            text = _gather(self.shown, self.shown_start[own], sizes).tobytes()
            if self.model["dummy_prefix"] and text[:1] == b" ":
                text = text[1:]
            try:
                text.decode()
            except UnicodeDecodeError:
                text = self.tokenizer.decode(own.tolist(), skip_special_tokens=False).encode()
            out.append(text)
        return out


_CODECS: dict[tuple[str, bool], Codec] = {}


def _codec(path: str, verify: bool) -> Codec:
    if (path, verify) not in _CODECS:
        with open(path, "rb") as f:
            _CODECS[path, verify] = Codec(f.read(), verify)
    return _CODECS[path, verify]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", verify: bool = True) -> DataFrame:
    """(id_col, ids, parity): the model's ids of each whole text; a null text has none. path is a file that every executor has."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts, same = _codec(path, verify).encode(batch.column(1))
        ends = np.concatenate([[0], np.cumsum(counts)])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32))), pa.array(same)], names=[id_col, "ids", "parity"])

    return map_slices(docs.select(id_col, text_col), 1, f"`{id_col}` {id_type(docs, id_col)}, ids array<int>, parity boolean", run)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) from ids; null ids give an empty text."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                many = [np.array(x or [], np.int64) for x in part.column(1).to_pylist()]
                found = _codec(path, False).decode(np.concatenate(many), np.array([len(x) for x in many]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t.decode() for t in found], pa.string())], names=[id_col, "text"])

    return rows.select(id_col, F.col(ids_col).alias("ids")).mapInArrow(run, f"`{id_col}` {id_type(rows, id_col)}, text string")


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_crc32, parity, decoded_sha256, round_trip): encode and decode in one pass, for checks of a corpus."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec, raw = _codec(path, True), texts(batch.column(1))
        ids, counts, same = codec.encode(batch.column(1))
        back, ends = codec.decode(ids, counts), np.cumsum(counts)
        little = ids.astype("<u4")
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(counts),
                pa.array([zlib.crc32(little[e - n : e].tobytes()) for e, n in zip(ends.tolist(), counts.tolist())], pa.int64()),
                pa.array(same),
                pa.array([hashlib.sha256(t).hexdigest() for t in back], pa.string()),
                pa.array([a == b for a, b in zip(raw, back)], pa.bool_()),
            ],
            names=[id_col, "n_tokens", "ids_crc32", "parity", "decoded_sha256", "round_trip"],
        )

    return map_slices(docs.select(id_col, text_col), 1, f"`{id_col}` {id_type(docs, id_col)}, n_tokens long, ids_crc32 long, parity boolean, decoded_sha256 string, round_trip boolean", run, slice_bytes=12 << 20)
