import re

from quadrille.llm import quality


def plain(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = {}
    for k in range(len(w) - 2):
        at.setdefault(tuple(w[k : k + 3]), []).append(k)
    covered = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    rows = [None, "", " \n\t", "a", "a a a a a", "a b c a b c", "x y z\nx y z\n\nx y z \n", "漢字 ### é|<>\x0b\x0c\r", "a b c d " * 20000, "p q r s p q r t u p q", "\xa0 b\x85c"]
    df = spark.createDataFrame([(i, t, None if i % 2 else "h", 1, 2, 3) for i, t in enumerate(rows)], "doc_id long, text string, source string, n_words int, host int, `_id` int")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    for i, t in enumerate(rows):
        r, want = got[i], plain(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (t or "")[:20]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not r.kept
    assert quality.judge(df.limit(0)).count() == 0


def test_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    rows = [(i, bad if i % 10 else good, "bad") for i in range(100)] + [(100 + i, good, f"g{i % 5}") for i in range(400)] + [(900, bad, "new"), (901, good, "new")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert not any(r.kept for i, r in got.items() if i < 100)
    assert all(got[100 + i].kept for i in range(400)) and got[901].kept and not got[900].kept
    # one failure of two shrinks towards the corpus
    assert got[900].host_rate < 0.5 and got[0].host_rate > 0.8
