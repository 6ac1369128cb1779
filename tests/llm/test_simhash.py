import numpy as np
import xxhash

from quadrille.llm import simhash


def plain(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, k=4):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= k:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def test_fingerprint_equals_plain():
    for text in ("", " \n", "A", "a b c", "a b c d", "The quick\tbrown fox\njumps over the É ß dog " * 30, "x\x0by\x0cz w v"):
        assert simhash.fingerprint(text.encode()) == plain(text)


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 60, dtype=np.uint64)
    rows = [int(c) for c in centres]
    for c in centres:
        for _ in range(8):
            flips = rng.choice(64, rng.integers(1, 8), replace=False)
            rows.append(int(c) ^ sum(1 << int(b) for b in flips))
    rows = sorted(set(rows))
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in rows], "fp long")
    from quadrille.llm.common import Written
    from quadrille.llm.components import connected_components

    w = Written(spark)
    for shard, cell in ((16, 8192), (16, 8), (100000, 64)):
        got = connected_components(simhash.near_links(df, w, 4, shard_rows=shard, cell_rows=cell), w)
        root = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in got.collect()}
        want = classes(rows)
        by = {}
        for x, c in zip(rows, want):
            by.setdefault(c, set()).add(x)
        mine = {}
        for x in rows:
            mine.setdefault(root.get(x, x), set()).add(x)
        assert sorted(map(sorted, by.values())) == sorted(map(sorted, mine.values()))


def test_rows(spark):
    rows = [(5, None, 1), (3, "", 2), (9, "a b c d e f", 3), (2, "A B C D E F", 4), (2, "A B C D E F", 4), (None, "zz", 5), (7, " ".join(f"w{i}" for i in range(60000)), 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    out = simhash.near_duplicates(df).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, r)
    assert len(out) == 7
    assert by[5].component_id == by[3].component_id == 3 and by[5].fingerprint == "0" * 16
    assert by[9].component_id == by[2].component_id == 2
    assert by[None].component_id is None and by[7].component_id == 7
    assert simhash.near_duplicates(df.limit(0)).count() == 0
