import random
import zlib

import numpy as np

from quadrille.llm import neighbours


def sample(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 200))]
        kind = i % 4
        if kind == 1:
            words = [w + rng.choice(["***", "%%%", "###"]) for w in words]
        if kind == 3:
            words = [w.upper() + "!!" for w in words]
        out.append((i, " ".join(words), int(kind in (0, 2))))
    return out


def test_shapes():
    assert neighbours.shapes("Étaient ABC12 a-b  !!".encode()) == b"a A9 a-a  !!"
    assert neighbours.shapes(b"") == b""


def test_blocks_equal_whole():
    rows = sample(300)
    x = neighbours.rows_of([t.encode() for _, t, _ in rows])
    space = neighbours.Space(x[:200], np.array([y for *_, y in rows[:200]]))
    whole = space.score(x)
    assert np.allclose(whole, np.concatenate([space.score(x[a : a + 7]) for a in range(0, 300, 7)]), atol=1e-6)
    # against plain cosines
    v = space.project(x)
    cos = np.maximum(v @ space.vectors.T, 0)
    for i in range(0, 300, 17):
        near = np.argsort(-cos[i])[:25]
        w = cos[i][near].astype(float) ** 8 + 1e-9
        assert abs((w * space.labels[near]).sum() / w.sum() - whole[i]) < 0.05
    assert ((whole >= 0.7) == [y for *_, y in rows]).mean() > 0.97


def test_held_out(spark):
    rows = sample(800, 1)
    docs = spark.createDataFrame([(i, t, 7.0) for i, t, _ in rows] + [(None, None, 1.0), (5000, "", 1.0), (5001, "w " * 60000, 1.0), (3, "again", 2.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 != 2] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    out = neighbours.score(docs, neighbours.fit(docs, labels)).collect()
    assert len(out) == len(rows) + 4 and all(0 <= r.score <= 1 for r in out)
    truth = {i: y for i, _, y in rows}
    held = [r for r in out if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([(r.score >= 0.7) == truth[r.doc_id] for r in held]) > 0.97
    empty = neighbours.score(docs.limit(0), neighbours.fit(docs.limit(0), labels.limit(0)))
    assert empty.count() == 0 and neighbours.score(docs.limit(3), neighbours.fit(docs, labels.limit(0))).count() == 3
