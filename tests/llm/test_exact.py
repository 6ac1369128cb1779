import hashlib

from quadrille.llm import exact


def test_cut_is_whole():
    for n in (0, 1, 1024, 1025, 5000, 200000):
        t = hashlib.shake_256(str(n).encode()).digest(n)
        parts = exact.cut(t)
        assert b"".join(parts) == t and all(len(p) <= 16384 for p in parts) and all(len(p) >= 1024 for p in parts[:-1])
    a = hashlib.shake_256(b"x").digest(100000)
    shared = set(exact.cut(a)) & set(exact.cut(b"inserted" + a))
    assert len(shared) > len(exact.cut(a)) / 2


def want(rows):
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    return by


def test_groups(spark):
    long = "lorem ipsum " * 9000
    rows = [(1, None), (2, ""), (3, "a"), (4, "a "), (5, "a"), (5, "a"), (6, long), (7, long), (8, long + "x"), (None, "a"), (None, "only null")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as uid", "2 as recipe", "3 as sha")
    for size in (16, 1, 0):  # fewer bytes: identifiers collide and get numbers
        out = exact.exact_duplicates(df, id_bytes=size).collect()
        assert len(out) == len(rows)
        by = want(rows)
        for r in out:
            text = next(t or "" for t in by if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
            ids = [i for i in by[text] if i is not None]
            assert r.group_size == len(by[text]) and r.keep_id == max(ids, default=None)
        assert sum(r.kept for r in out) == len(by)
        assert len({(r.text_sha256) for r in out if r.kept}) == len(by)
    kept = exact.drop_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 4, 5, 7, 8]
    assert exact.exact_duplicates(df.limit(0)).count() == 0
