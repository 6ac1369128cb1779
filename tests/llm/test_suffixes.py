import hashlib
import random

import numpy as np
import pytest

from quadrille.llm import suffixes


def plain(rows, length=100):
    """Rows of (id, text) to (n_bytes, n_removed, n_spans, sha)."""
    key = lambda i: 2**63 - 1 if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for a in range(len(b) - length + 1):
            w = b[a : a + length]
            first[w] = min(first.get(w, (2**64, 0)), (key(i), a))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for a in range(len(b) - length + 1):
            if first[b[a : a + length]] < (key(i), a):
                gone[a : a + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(15, 60))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, 3), rng.choice(passages))
        rows.append((i * 3 % 101 * 7 + i, " ".join(parts)))
    for i in range(30):  # near copies
        t = list(rng.choice(rows)[1])
        for _ in range(rng.randint(0, 3)):
            if t:
                t[rng.randrange(len(t))] = "x"
        rows.append((5000 + i, "".join(t)))
    rows += [(6000, "ab" * 400), (6001, "a" * 700), (6002, "a" * 100), (6003, "a" * 99), (6004, None), (6005, ""), (None, passages[0]), (None, passages[1]), (7, passages[0] + "\x00" + passages[1])]
    return rows


def test_rolled_equals_plain():
    x = np.random.default_rng(0).integers(0, 2**64, 60, dtype=np.uint64)
    for n in (1, 2, 3, 5, 8, 24, 32):
        got = suffixes._rolled(x, n)
        for i in range(60 - n + 1):
            want = 0
            for v in x[i : i + n].tolist():
                want = (want * int(suffixes._ODD) + v) % 2**64
            assert int(got[i]) == want


def test_merge_is_sorted_and_knows_prefixes():
    rng = random.Random(1)
    pool = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(3, 12))) for _ in range(1500)})
    runs, all_ = [], []
    for r in range(7):
        own = sorted(rng.sample(pool, 200))
        ks, starts = np.arange(len(own)) * 7 + r, np.arange(len(own))
        runs.append(suffixes.front_code(own, ks, starts))
        all_ += list(zip(own, ks.tolist(), starts.tolist()))
    all_.sort()
    got = list(suffixes.merge(runs))
    assert [(t, k, s) for t, _, k, s, _ in got] == all_
    for (a, *_), (b, *_), (_, n, *_) in zip(all_, all_[1:], got[1:]):
        assert a[:n] == b[:n] and (a[n : n + 1] != b[n : n + 1] or a == b)
    assert list(suffixes.merge([])) == []


@pytest.mark.parametrize("seed, crowd", [(1, 20000), (2, 20000), (1, 2)])
def test_equals_brute_force(spark, seed, crowd):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k", "2 as tid", "3 as kept").repartition(5)
    got = suffixes.remove_repeats(df, crowd=crowd).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(plain(rows))


def test_edges(spark):
    long = " ".join(f"w{i % 9973}x{i}" for i in range(40000))
    rows = [(1, long), (2, long[1000:]), (1, "other " * 3), (3, "short"), (3, "short"), (9, long), (9, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.remove_repeats(df).collect())
    n = len(long)
    assert got == sorted([(1, n, 0, 0), (2, n - 1000, n - 1000, 1), (1, 18, 0, 0), (3, 5, 0, 0), (3, 5, 0, 0), (9, n, n, 1), (9, n, n, 1)])
    assert suffixes.remove_repeats(df.limit(0)).count() == 0
