import random

import corpus_pipeline
from quadrille.llm import similar


def plain_groups(rows, width=5, similarity=0.8):
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "") or not sets[i] and not sets[j]
            if same or sets[i] | sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def test_similar_groups_equal_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(60):
        base = [word() for _ in range(rng.randint(40, 200))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(1, 8)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, " "), (1003, "two words"), (1004, "words two"), (1003, "two words"), (None, "alone"), (1005, "x y " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as text_key", "2 as group_key", "3 as key", "4 as gone_id")
    got = similar.similar_groups(df).collect()
    want = plain_groups(rows)
    by = {}
    for r, c in zip(rows, want):
        by.setdefault(c, set()).add(r[0])
    mine = {}
    for r in got:
        mine.setdefault(r.group_key, set()).add(r.id)
    wanted, found = set(map(frozenset, by.values())), set(map(frozenset, mine.values()))
    assert wanted == found
    kept = similar.drop_similar(df)
    assert kept.columns == df.columns and kept.count() == len(found)
    assert similar.drop_similar(df.limit(0)).count() == 0


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == columns and out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert len({r.doc_id for r in rows}) == len(rows) <= n
        n, docs = len(rows), spark.createDataFrame(rows, out.schema)
        if name == "exact":
            assert len({r.text for r in rows}) == n
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows}


def same_groups(spark, texts, **how):
    rows = list(enumerate(texts))
    got = {r.id: r.group_key for r in similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()}
    by, mine = {}, {}
    for i, c in enumerate(plain_groups(rows)):
        by.setdefault(c, set()).add(i)
        mine.setdefault(got[i], set()).add(i)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, mine.values()))
    return len(by)


def test_variants_of_one_text_that_are_far_from_each_other(spark):
    rng = random.Random(4)
    fresh = iter(range(10**6))
    base = [f"b{i}" for i in range(250)]
    variants = []
    for _ in range(320):
        copy = list(base)
        for at in rng.sample(range(5, 245), 4):
            copy[at] = f"x{next(fresh)}"
        variants.append(" ".join(copy))
    assert same_groups(spark, [*variants[:200], " ".join(base), *variants[200:]]) == 1
    others = [" ".join(f"o{next(fresh)}" for _ in range(60)) for _ in range(20)]
    assert same_groups(spark, [*variants, *others], hot=16, cell_rows=50) == len(others) + same_groups(spark, variants, hot=10**6)


def test_appended_and_truncated_copies(spark):
    rng = random.Random(6)
    fresh = iter(range(10**6))
    texts = []
    for n in range(80, 400, 4):
        base = [f"w{rng.randrange(3000)}" for _ in range(n)]
        more = [f"x{next(fresh)}" for _ in range(int(n * rng.uniform(0.1, 0.27)))]
        texts += [" ".join(base), " ".join(base + more), " ".join(base[: int(n * rng.uniform(0.78, 0.9))])]
    same_groups(spark, texts)


def test_same_words_in_another_order(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(300)}" for _ in range(300)]
    swapped = [*base[:-2], base[-1], base[-2]]
    shuffled = [" ".join(rng.sample(base, len(base))) for _ in range(10)]
    assert same_groups(spark, [" ".join(base), *shuffled, " ".join(swapped)]) == 11


def test_components_in_one_task_and_in_rounds(spark):
    from quadrille.llm.common import Written
    from quadrille.llm.components import connected_components

    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)] + [(7, 7), (None, 3)]
    root = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}
    for _ in root:
        for u, v in edges:
            if u in root and v in root and u != v:
                root[u] = root[v] = min(root[u], root[v])
    df = spark.createDataFrame(edges, "u long, v long")
    for few in (0, 1 << 20):
        got = {r.node: r.root for r in connected_components(df, Written(spark), few).collect()}
        assert got == {x: r for x, r in root.items() if any(x in e and None not in e and e[0] != e[1] for e in edges)}
