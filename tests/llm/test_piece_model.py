import io
import random
import zlib

import numpy as np
import pyarrow as pa
import sentencepiece

from quadrille.llm import piece_model

PATH = "/opt/tokenizers/piece_bpe_32k.model"
TEXTS = ["", " ", "  ", "a", " a", "a ", "a  b", "Hello world", "été naïve Straße", "tabs\tand\nlines \n  x", "漢字 かな 😀 ▁x", "a▁ b", "x " * 3000, "<s> </s> <0x0A> <unk>", "\x00\x01", "     spaces     in   runs ", "http://example.com/?q=1&x=%20", "aaaaaaaaaaaaaaa", "word " * 20000]


def test_wire_format_equals_protobuf():
    data = open(PATH, "rb").read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    got = piece_model.parse(data)
    assert [p[0] for p in got["pieces"]] == [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    assert np.allclose([p[1] for p in got["pieces"]], [sp.get_score(i) for i in range(sp.get_piece_size())])
    assert got["kind"] == 2 and got["byte_fallback"] and not got["trim"]


def test_parity_of_whole_texts():
    data = open(PATH, "rb").read()
    codec, sp = piece_model.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    assert codec.by_part
    rng = random.Random(4)
    many = TEXTS + ["".join(rng.choice("abcdeétion  \n▁.漢") for _ in range(rng.randint(1, 80))) for _ in range(2000)]
    ids, counts, same = codec.encode(pa.array(many))
    for t, x, s in zip(many, np.split(ids, np.cumsum(counts)[:-1]), same):
        assert x.tolist() == sp.encode(t) and s
    back = codec.decode(ids, counts)
    assert [b for b, t in zip(back, many) if b.decode() != sp.decode(sp.encode(t))] == []
    lists = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert [b.decode() for b in back] == codec.tokenizer.decode_batch(lists, skip_special_tokens=False)
    # bytes that are no UTF-8, as the library shows them
    odd = np.array([sp.piece_to_id("<0xE6>"), sp.piece_to_id("▁the")])
    assert codec.decode(odd, np.array([2]))[0].decode() == codec.tokenizer.decode(odd.tolist(), skip_special_tokens=False)


def test_unigram_model():
    out = io.BytesIO()
    lines = ["the quick brown fox jumps over the lazy dog", "pack my box with five dozen jugs", "how vexingly quick daft zebras jump"] * 40

    def field(n, kind, payload):
        def varint(v):
            b = b""
            while v > 127:
                b, v = b + bytes([v & 127 | 128]), v >> 7
            return b + bytes([v])

        return varint(n << 3 | kind) + (varint(len(payload)) + payload if kind == 2 else payload if kind == 5 else varint(payload))

    # a model file built by hand: pieces with scores, unigram, byte fallback
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    words = sorted({w for line in lines for w in line.split()})
    pieces += [("▁" + w, -5.0 - i / 50, 1) for i, w in enumerate(words)] + [(c, -9.0 - i / 90, 1) for i, c in enumerate("▁abcdefghijklmnopqrstuvwxyz")]
    data = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, np.float32(s).tobytes()) + field(3, 0, t)) for p, s, t in pieces)
    data += field(2, 2, field(3, 0, 1) + field(35, 0, 1)) + field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0) + field(5, 0, 1))
    out.write(data)
    codec, sp = piece_model.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    many = ["the lazy fox", "thequick zz é", " boxes  jump\n", ""]
    ids, counts, same = codec.encode(pa.array(many))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [sp.encode(t) for t in many] and all(same)
    assert [t.decode() for t in codec.decode(ids, counts)] == [sp.decode(sp.encode(t)) for t in many]


def test_rows(spark):
    rows = list(enumerate([None, *TEXTS])) + [(None, "x"), (3, "a"), (3, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as parity")
    ids = piece_model.encode(df, PATH)
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = ids.collect()
    assert sorted(map(str, (r.ids for r in got))) == sorted(str(sp.encode(t or "")) for _, t in rows) and all(r.parity for r in got)
    back = piece_model.decode(ids, PATH).collect()
    assert sorted(r.text for r in back) == sorted(sp.decode(sp.encode(t or "")) for _, t in rows)
    trips = piece_model.round_trips(df, PATH).collect()
    assert all(r.parity for r in trips) and sorted(r.ids_crc32 for r in trips) == sorted(zlib.crc32(np.array(sp.encode(t or ""), "<u4").tobytes()) for _, t in rows)
    assert piece_model.encode(df.limit(0), PATH).count() == 0
