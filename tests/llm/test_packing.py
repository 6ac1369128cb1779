import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quadrille.llm import packing

PATH = "/opt/tokenizers/word_bpe_49k.json"


def check(rows, out, capacity=2048):
    tok = Tokenizer.from_file(PATH)
    want = sorted(tuple(tok.encode(t or "", add_special_tokens=False).ids) + (1,) for _, t in rows)
    docs, seqs = {}, {}
    for r in out:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert sum(r.length for r in out) == sum(map(len, want))
    return docs, seqs


def test_pack(spark):
    rng = random.Random(3)
    words = ["the", "Straße", "naïve", "été", "it's", "<|endoftext|>", "a b", "x\x1cy", "漢字", "9,81", "don't", "İx"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 900)))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "word " * 20000), (903, " \n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as class", "2 as rank")
    out = packing.pack(df, PATH, keep_ids=True).collect()
    docs, seqs = check(rows, out)
    tok = Tokenizer.from_file(PATH)
    for i, t in rows:
        ids, own = [], sorted(docs[i], key=lambda r: r.start)
        for r in own:
            assert r.start == len(ids)
            ids += r.ids
        assert ids == tok.encode(t or "", add_special_tokens=False).ids + [1] and own[0].doc_tokens == len(ids)
    assert len(seqs) <= sum(r.length for r in out) / 2048 * 1.03 + 1
    assert packing.pack(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, PATH, capacity=2047)


def test_capitals_beside_special_tokens():
    import pyarrow as pa

    rows = ["Hello The World, Straße", "Hello <|endoftext|> The World. <|ENDOFTEXT|>", "f <| x |> The", None, "The END", ""]
    ids, counts = packing.WordEncoder(PATH).encode(pa.array(rows))
    tok = Tokenizer.from_file(PATH)
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in rows]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


def test_repeated_rows(spark):
    rows = [(1, "a b c")] * 50 + [(None, "d")] * 3
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH, keep_ids=True).collect()
    assert len(out) == 53
    check(rows, out)


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(5)
    for n in (0, 1, 3000, 100000):
        histogram = {int(c): int(k) for c, k in zip(*np.unique(np.minimum(256, 1 + rng.gamma(2, 50, n).astype(int)), return_counts=True))}
        patterns = packing.plan(histogram, 256)
        used = {}
        for classes, _, k in patterns:
            assert classes.sum() <= 256
            for c in classes.tolist():
                used[c] = used.get(c, 0) + k
        assert used == histogram
        if n:
            assert sum(k for *_, k in patterns) <= sum(c * k for c, k in histogram.items()) / 256 * 1.01 + 1
