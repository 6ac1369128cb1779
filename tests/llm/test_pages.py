import numpy as np

from quadrille.llm import pages


def text(page):
    return "\n\n".join(t for t, state in zip(*pages.states(page)) if state == pages.CLEAN)


def test_blocks():
    page = """<!DOCTYPE html><html class="sidebar"><head><title>T &amp; x</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body>
    <nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- <article>ad</article> --><div class="ad">buy</div><header>top</header>
    <article><h1>Title&nbsp;here &lt;1&gt;</h1><p><b>bold text<br>more<p>second   para\n graph</p><div class="cookie-notice">accept</div>
    <form>name <input> <p>send</p></form><ul><li>one<li>two</ul><p>in<i>li</i>ne a &eacute;&#233;&#x41;</p>tail <aside>side</aside>
    <section id="comments"><p>first!</p></section><table><tr><td>c1<td>c2</table><footer>by</footer><p data-x="a > b">last</article><footer>&copy; f</footer></body></html>"""
    assert text(page).split("\n\n") == ["Title here <1>", "bold text more", "second para graph", "one", "two", "inline a ééA", "tail", "c1", "c2", "last"]
    assert text("<article><p>cut off <b>he") == "cut off he"
    assert text("<main>a < b</main>") == "a < b" and text("") == ""
    assert text("<article>" + "<p>x y</p>" * 30000 + "</article>").count("x y") == 30000


def test_suffix_array():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 50, 300):
        t = rng.integers(0, 3, n)
        order = pages.suffix_array(t)
        want = sorted(range(n), key=lambda i: t[i:].tolist())
        assert order.tolist() == want
        lcp = pages.common_prefixes(t, order)
        for a, b, k in zip(want, want[1:], lcp[1:].tolist()):
            x, y = t[a:].tolist(), t[b:].tolist()
            assert x[:k] == y[:k] and x[k : k + 1] != y[k : k + 1]


def test_rows(spark):
    shared = "this very long notice stands on each and every page of the host"
    rows = [(i, "http://H.example.com/%d" % i, f"<body><div>{shared}</div><div>unique words of page number {i} only</div><p>Home</p></body>") for i in range(6)]
    rows += [(10, "http://h.example.com/a", f"<body><p>{shared}</p><article><p>{shared}</p></article></body>"), (11, "http://other.example.com/", f"<div>{shared}</div>"), (12, None, None), (13, "x", ""), (None, "http://h.example.com/n", "<article>n</article>"), (14, "http://e.example.com", "<article>" + "<p>long text</p>" * 20000)]
    rows += [rows[-1], (15, "http://h.example.com/z", "<nav>only menu</nav>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as id", "2 as host", "3 as text")
    got = pages.extract(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    for i in range(6):
        assert f"{i} only" in by[i] and "notice" not in by[i]
    assert by[10] == shared and by[11] == shared and by[12] == by[13] == by[15] == "" and by[None] == "n" and by[14].count("long") == 20000
    assert pages.extract(df.limit(0)).count() == 0


def test_markup_is_parsed_and_weighed():
    assert pages.states("<body><!-- <main> old --><p>the real body</p><script>'<article>'</script></body>") == (["the real body"], [pages.OPEN])
    page = "<article><div class='related-work'>prose</div><div class='article-header'>intro</div><div class='comments'>no</div><div class='cookie-notice box'>no</div><div class='user-comments-list'>no</div><p>end</p></article>"
    assert [(t, s) for t, s in zip(*pages.states(page)) if s != pages.NOISY] == [("prose", pages.OPEN), ("intro", pages.OPEN), ("end", pages.CLEAN)]


def brute(rows, length=8, share=0.3):
    """Per page: the text by comparing every window with every page of the host."""
    hosts, out = {}, []
    for _, url, html in rows:
        own, marks = pages.states(html or "")
        stream = [w for t, m in zip(own, marks) if m for w in ["\x02", *t.split(), "\x03"]]
        hosts.setdefault(pages.host_of(url), []).append({tuple(stream[i : i + length]) for i in range(len(stream) - length + 1)})
    for _, url, html in rows:
        own, marks = pages.states(html or "")
        stream, home = [], []
        for k, (t, m) in enumerate(zip(own, marks)):
            if m:
                stream += ["\x02", *t.split(), "\x03"]
                home += [k] * (len(t.split()) + 2)
        others = hosts[pages.host_of(url)]
        unique = set()
        covered = set()
        for i in range(len(stream) - length + 1):
            n = sum(tuple(stream[i : i + length]) in x for x in others)
            if n > 1 and n >= share * len(others):
                covered |= set(range(i, i + length))
        unique = {home[i] for i in range(len(stream)) if i not in covered}
        out.append("\n\n".join(t for k, (t, m) in enumerate(zip(own, marks)) if m == 0 or m == 1 and k in unique))
    return out


def test_extract_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    word = lambda: "w%d" % rng.integers(0, 4000)
    para = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for h in range(3):
        legal, menu = para(30), "<ul>" + "".join(f"<li>{word()}</li>" for _ in range(8)) + "</ul>"
        twin = para(40)
        for i in range(17):
            quote = legal[: len(legal) // 2] if i % 5 == 0 else ""
            body = f"<p>{para(25)} {quote}</p><p>{twin if i < 2 else para(12)}</p>"
            if i % 4 == 0:
                body = f"<article>{body}<div class='related-work'>{legal if i % 8 else para(20)}</div></article>"
            rows.append((len(rows), f"http://h{h}.org/{i}", f"<body>{menu}<p>Home</p>{body}<div>{legal}</div></body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in pages.extract(df).collect()}
    want = brute(rows)
    assert [got[i] for i in range(len(rows))] == want
    assert all("w" in t for t in want) and sum("\n\n" in t for t in want) > 40


def menus(n, hosts=2):
    """Marked pages whose menus and notices repeat, the last of each host with an open block that repeats outside main parts."""
    notice = "you may read all of these pages only if you keep to our rules"
    page = "<body><ul>" + "<li>Home</li><li>News</li><li>About us</li>" + "</ul><article><p>text number %d of this page</p>%s</article><div>" + notice + "</div></body>"
    return [(i, f"http://H{i % hosts}.org/{i}", page % (i, f"<div class='related-work'>{notice}</div><div class='related-work'>own words {i}</div>" if i >= n - hosts else "")) for i in range(n)]


def test_repeats_are_found_on_marked_pages():
    rows = [r for r in menus(12) if r[0] % 2]
    found = [pages.states(html) for _, _, html in rows]
    streams = pages.Streams(found)
    places, group, held = streams.repeats(8)
    assert held.max() == len(rows)
    unique = streams.unique(places[(held >= 2)[group]], 8)
    assert unique == [[False] * 3 + [True] + ([False, True] if r[0] >= 10 else []) + [False] for r in rows]  # menu, text, open blocks, notice
    assert [len(x) - sum(pages.checked(found, unique)[k]) for k, x in enumerate(unique)] == [4] * 5 + [5]


def test_every_page_goes_through_the_suffix_arrays(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.org/", f"<nav>menu</nav><article>text {i}</article>") for i in range(30)] + [(30, None, None)]
    sorted_, real = [], pages.judged_shards

    def judged(parsed, *how):
        shards = real(parsed, *how)
        sorted_.append(sum(len(r.ids) for r in shards.collect()))
        return shards

    monkeypatch.setattr(pages, "judged_shards", judged)
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert sorted_ == [31] and got == {i: f"text {i}" for i in range(30)} | {30: ""}


def test_shards_of_a_host_count_together(spark):
    rng = np.random.default_rng(7)
    para = lambda n: " ".join("w%d" % rng.integers(0, 500) for _ in range(n))
    rows = menus(40)
    for h in range(2):  # pages without marks; notices on about the share of the host's pages
        notices = [para(12) for _ in range(4)]
        for i in range(60):
            shown = [x for k, x in enumerate(notices) if rng.random() < 0.26 + 0.03 * k]
            rows.append((len(rows), f"http://h{h}.org/p{i}", "".join(f"<div>{x}</div>" for x in [para(15), *shown, para(9)])))
    rows += [(len(rows), "http://h0.org/x", ""), (len(rows) + 1, "http://h0.org/y", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    want = brute([(i, u, h) for i, u, h in rows])
    for size in (1 << 22, 4000, 700):  # one, several, many shards of each host
        got = {r.page_id: r.text for r in pages.extract(df, shard_bytes=size).collect()}
        assert [got[i] for i in range(len(rows))] == want, size
    assert pages.extract(df, shard_bytes=10**6).count() == len(rows)
