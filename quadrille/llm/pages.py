"""Main text of web pages, with boilerplate found by suffix arrays over a host's pages.

The token streams of a host's pages, each block begun and ended by a mark, are concatenated and their suffixes
sorted. Neighbours in that order with a long common prefix are repeats; those that enough distinct pages hold overlap
to the maximal repeated runs, and a block that such runs cover as a whole is boilerplate. So is every page of
every host judged. A check of the markup follows, since pages legitimately share passages and not all boilerplate
repeats: blocks of a page's marked main part come back, and blocks outside it, or named as noise, go. What markup leaves
open stays as the repeats have it: the blocks of pages that mark no main part, and blocks inside one whose class only hints at boilerplate.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Written, id_type, slices, texts

# Elements by role, and words of class, id and role that mark what isn't main text.
MAIN = {"article", "main"}
NOISE = {"nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "svg", "canvas", "button", "select", "option", "textarea", "input", "label", "fieldset", "dialog", "menu", "head", "title", "object", "embed", "audio", "video", "map"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
NOISE_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "adslot", "banner", "banners", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disclaimer", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav",
    "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "paywall", "popup", "promo", "promoted", "promotion", "recommended", "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toc", "toolbar", "widget", "widgets", "alert", "complementary", "contentinfo", "search",
}

# Words that say nothing beside those above.
FILLER = {"area", "bar", "block", "bottom", "box", "button", "buttons", "container", "content", "group", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "panel", "post", "reader", "right", "section", "site", "slot", "text", "title", "top", "user", "wrap", "wrapper"}
CLEAN, OPEN, NOISY = 0, 1, 2

#: Windows of candidates, 16 bytes each, up to which their table is broadcast.
MOST_BROADCAST = 1 << 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|(?P<text>[^<]+|<)", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_CLOSES_P = BLOCKS - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "dd", "dt", "li"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "div", "article", "section", "body", "main", "select"}


def _noise(tag: str, attrs: str) -> int:
    """Whether an element isn't main text: NOISY by its tag, or if all words of a name say so; OPEN if only some do."""
    if tag in NOISE:
        return NOISY
    worst = CLEAN
    for kind, *values in _ATTR.findall(attrs or ""):
        value = "".join(values).lower()
        if kind.lower() == "hidden" or kind.lower() == "aria-hidden" and value == "true":
            return NOISY
        for name in value.split() if tag not in ("html", "body") else ():
            words = [w for w in re.split(r"[^a-z]+", name) if w]
            if NOISE_WORDS.intersection(words):
                worst = max(worst, NOISY if all(w in NOISE_WORDS or w in FILLER for w in words) else OPEN)
    return worst


def blocks(page: str) -> Iterator[tuple[str, bool, int]]:
    """(text, whether in the main part, CLEAN, OPEN or NOISY) of each block of a page, in order."""
    stack: list[tuple[str, bool, int]] = [("", False, CLEAN)]
    buffer: list[str] = []

    def flush():
        text = " ".join(entities.unescape("".join(buffer)).split())
        buffer.clear()
        return text

    at = 0
    for m in iter(lambda: _TOKEN.match(page, at), None):
        at = m.end()
        if m["text"] is not None or m["cdata"] is not None:
            buffer.append(m["text"] or m["cdata"] or "")
            continue
        close, open_ = (m["close"] or "").lower(), (m["open"] or "").lower()
        tag = close or open_
        if not tag:
            continue
        if tag in BLOCKS or tag in NOISE:
            if text := flush():
                yield text, stack[-1][1], stack[-1][2]
        elif tag == "br":
            buffer.append(" ")
        if open_:
            same = {"p"} if tag in _CLOSES_P else set()
            same |= _SAME.get(tag, set())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in same:
                    del stack[i:]
                    break
                if stack[i][0] in _SCOPE and stack[i][0] not in same:
                    break
            if tag in VOID or m["attrs"].endswith("/"):
                continue
            top = stack[-1]
            stack.append((tag, top[1] or tag in MAIN, max(top[2], _noise(tag, m["attrs"]))))
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
                stack.pop()
        else:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if tag not in BLOCKS and tag not in NOISE and stack[i][0] in BLOCKS:
                    break  # a stray inline end tag closes no block
    if text := flush():
        yield text, stack[-1][1], stack[-1][2]


def host_of(url: str | None) -> str:
    url = url or ""
    return re.split(r"[/?#]", url.split("://", 1)[1])[0].lower() if "://" in url else ""


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Places of a token stream in the order of their suffixes, by prefix doubling of those that still tie."""
    n = len(tokens)
    order = np.argsort(tokens, kind="stable")
    if not n:
        return order
    new = np.concatenate([[True], tokens[order][1:] != tokens[order][:-1]])  # where a group of ties begins
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    k = 1
    while len(at := np.flatnonzero(~(new & np.append(new[1:], True)))):
        tied = order[at]
        second = np.where(tied + k < n, rank[np.minimum(tied + k, n - 1)], -1)
        key = rank[tied] * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        order[at], key = tied[by], key[by]
        new[at] = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[at]] = np.maximum.accumulate(np.where(new[at], at, 0))
        k *= 2
    return order


def common_prefixes(tokens: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many tokens each suffix has in common with the one before it in order (Kasai's algorithm)."""
    n = len(order)
    rank, out, h, t = np.empty(n, np.int64), np.zeros(n, np.int64), 0, tokens.tolist()
    rank[order] = np.arange(n)
    before = order.tolist()
    for i, r in enumerate(rank.tolist()):
        if r:
            j = before[r - 1]
            while i + h < n and j + h < n and t[i + h] == t[j + h]:
                h += 1
            out[r] = h
            h = max(0, h - 1)
        else:
            h = 0
    return out


def states(page: str) -> tuple[list[str], list[int]]:
    """The blocks of a page, and which are main text (CLEAN), left to repetition (OPEN) or not main text (NOISY)."""
    found = list(blocks(page))
    marked = any(inside and noise != NOISY for _, inside, noise in found)
    return [t for t, *_ in found], [(noise if inside else NOISY) if marked else max(noise, OPEN) for _, inside, noise in found]


class Streams:
    """The concatenated token streams of some pages, given the blocks and states of each.

    A block is begun and ended by a mark, so that a short one can be a long substring. Each page has two
    streams, what isn't certain main text and what is, and each ends in a token that matches no other.
    """

    def __init__(self, found: list[tuple[list[str], list[int]]]):
        self.code: dict[str, int] = {"\x02": 0, "\x03": 1}
        flat: list[int] = []
        self.first, self.size, self.begins = [], [], [0]  # of each block, by page; of each stream
        code = self.code
        for own, marks in found:
            at, long = [0] * len(own), [0] * len(own)
            for certain in (False, True):
                for k, mark in enumerate(marks):
                    if (mark == CLEAN) == certain:
                        at[k] = len(flat)
                        flat.append(0)
                        flat += [code.setdefault(t, len(code)) for t in own[k].split()]
                        flat.append(1)
                        long[k] = len(flat) - at[k]
                flat.append(-len(self.begins))
                self.begins.append(len(flat))
            self.first.append(at)
            self.size.append(long)
        self.tokens = np.array(flat, np.int64)
        sizes = np.diff(self.begins)
        self.stream = np.repeat(np.arange(len(sizes)), sizes)  # page k has streams 2 k and 2 k + 1
        self.room = np.repeat(np.array(self.begins[1:]) - 1, sizes) - np.arange(len(flat))

    def repeats(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, group, pages): the places with room for length tokens by the group of those that share them, and how many pages hold each group outside their certain main text."""
        order = suffix_array(self.tokens)
        group = np.cumsum(common_prefixes(self.tokens, order) < length)
        has = self.room[order] >= length
        places, group = order[has], group[has]
        group = np.cumsum(np.diff(group, prepend=group[:1]) > 0)
        outside = self.stream[places] % 2 == 0
        n = len(self.begins)
        held = np.unique(group[outside] * n + self.stream[places[outside]]) // n
        return places, group, np.bincount(held, minlength=int(group.max(initial=-1)) + 1)

    def unique(self, places: np.ndarray, length: int) -> list[list[bool]]:
        """For each block of each page whether it has a token that no repeat covers, where repeats of length tokens begin at places."""
        edge = np.zeros(len(self.tokens) + 1, np.int64)
        np.add.at(edge, places, 1)
        np.add.at(edge, places + length, -1)
        free = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) == 0)]).tolist()
        return [[free[a + n] > free[a] for a, n in zip(at, long)] for at, long in zip(self.first, self.size)]

    def digests(self, places: np.ndarray, length: int) -> np.ndarray:
        """16 bytes, as two numbers, for the length tokens from each place on; the same in all tasks."""
        used = np.zeros(len(self.code), bool)
        taken = self.tokens[places[:, None] + np.arange(length)]
        used[taken] = True
        values = np.zeros((len(self.code), 2), np.uint64)
        for word, c in self.code.items():
            if used[c]:
                values[c] = np.frombuffer(hashlib.blake2b(word.encode(), digest_size=16).digest(), np.uint64)
        out = np.zeros((len(places), 2), np.uint64)
        for j in range(length):
            out = out * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64) + values[taken[:, j]]
        return out


def checked(found: list[tuple[list[str], list[int]]], unique: list[list[bool]]) -> list[bytes]:
    """For each block of each page whether it stays: unique ones do, unless markup decides."""
    return [bytes([mark == CLEAN or mark == OPEN and stays for mark, stays in zip(marks, own)]) for (_, marks), own in zip(found, unique)]


def _wrap(found: list[tuple[list[str], list[int]]]) -> bytes:
    """Blocks, in which white space is single spaces, and states of some pages."""
    raw = "\f".join("\n".join(["".join(map(str, marks)), *own]) for own, marks in found).encode()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def _unwrap(body: bytes) -> list[tuple[list[str], list[int]]]:
    raw = pa.Codec("zstd").decompress(body[8:], int.from_bytes(body[:8], "little"), asbytes=True)
    lines = [page.split("\n") for page in raw.decode().split("\f")]
    return [(own, [int(m) for m in marks]) for marks, *own in lines]


def host_column(url):
    """host_of as a column."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def parse(pages: DataFrame) -> DataFrame:
    """(id, url, host, shard, total, body) of each page of (id, url, host, shard, total, html); body has its blocks and states."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, 5):
                bodies = [_wrap([states(raw.decode())]) for raw in texts(piece.column(5))]
                yield pa.RecordBatch.from_arrays([*piece.columns[:5], pa.array(bodies, pa.binary())], names=["id", "url", "host", "shard", "total", "body"])

    kinds = f"id {id_type(pages, 'id')}, url {id_type(pages, 'url')}"
    return pages.select("id", "url", "host", "shard", "total", "html").mapInArrow(run, f"{kinds}, host string, shard long, total long, body binary")


def judged_shards(parsed: DataFrame, length: int, share: float) -> DataFrame:
    """(host, total, ids, urls, body, kept, windows) for each shard of a host's pages, off one suffix array over all of them.

    kept tells the blocks that stay if the shard has all pages of its host, and is null otherwise. Then windows
    has the digests of the repeats that the share of the shard's pages hold: what the share of all the host's pages
    holds, the share of some shard's pages holds.
    """
    kinds = f"ids array<{id_type(parsed, 'id')}>, urls array<{id_type(parsed, 'url')}>"

    def run(key, rows):
        found = [page for body in rows.column("body").to_pylist() for page in _unwrap(body)]
        total = rows.column("total")[0].as_py()
        whole = total is None
        streams = Streams(found)
        places, group, held = streams.repeats(length)
        enough = held >= max(2 if whole else 1, share * len(found))
        chosen = enough[group]
        kept = checked(found, streams.unique(places[chosen], length)) if whole else None
        first = np.unique(group[chosen], return_index=True)[1]
        windows = b"" if whole else streams.digests(places[chosen][first], length).astype("<u8").tobytes()
        lists = [pa.array([c.to_pylist()], pa.list_(c.type)) for c in (rows.column("id"), rows.column("url"))]
        return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([total], pa.int64()), *lists, pa.array([_wrap(found)], pa.binary()), pa.array([kept], pa.list_(pa.binary())), pa.array([windows], pa.binary())], names=["host", "total", "ids", "urls", "body", "kept", "windows"])

    return parsed.groupBy("host", "shard").applyInArrow(run, f"host string, total long, {kinds}, body binary, kept array<binary>, windows binary")


def repeated_windows(shards: DataFrame, length: int, share: float) -> DataFrame:
    """(host, windows) of the windows that two pages and the share of all pages hold, for hosts of several shards."""

    def split(batches):
        for batch in batches:
            for host, windows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = [windows[i : i + 16] for i in range(0, len(windows), 16)]
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(found), pa.string()), pa.array(found, pa.binary())], names=["host", "window"])

    def joined(rows: DataFrame) -> DataFrame:
        return rows.groupBy("host").agg(F.array_sort(F.collect_list("window")).alias("windows"))

    def count(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                host, total, body, windows = (batch.column(i)[row].as_py() for i in range(4))
                known = _known(windows)
                streams = Streams(_unwrap(body))
                places = np.flatnonzero((streams.room >= length) & (streams.stream % 2 == 0))
                at, hit = _look(known, streams, places, length)
                n = len(streams.begins)
                held = np.bincount(np.unique(at[hit] * n + streams.stream[places[hit]]) // n, minlength=len(known))
                some = np.flatnonzero(held)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([host] * len(some), pa.string()), pa.array([total] * len(some), pa.int64()), pa.array([known[i].tobytes() for i in some], pa.binary()), pa.array(held[some], pa.int64())], names=["host", "total", "window", "n"]
                )

    candidates = shards.where("octet_length(windows) > 0").select("host", "windows").mapInArrow(split, "host string, window binary").distinct()
    counts = with_windows(shards, joined(candidates), "inner").select("host", "total", "body", "found").mapInArrow(count, "host string, total long, window binary, n long")
    enough = counts.groupBy("host", "window").agg(F.sum("n").alias("n"), F.first("total").alias("total")).where((F.col("n") > 1) & (F.col("n") >= share * F.col("total")))
    return joined(enough)


def with_windows(shards: DataFrame, windows: DataFrame, how: str) -> DataFrame:
    """shards with the windows of their hosts as found."""
    windows = Written(shards.sparkSession)(windows.select("host", F.col("windows").alias("found")))
    many = windows.agg(F.sum(F.size("found"))).first()[0] or 0
    return shards.join(F.broadcast(windows) if many <= MOST_BROADCAST else windows, "host", how)


def _known(windows) -> np.ndarray:
    """Digests as rows of two numbers, in the order of the first."""
    rows = np.frombuffer(b"".join(windows), "<u8").reshape(-1, 2)
    return rows[np.argsort(rows[:, 0])]


def _look(known: np.ndarray, streams: Streams, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows at places, where in known they are, and which of them are there."""
    if not len(known):
        return np.zeros(len(places), np.int64), np.zeros(len(places), bool)
    own = streams.digests(places, length)
    at = np.minimum(np.searchsorted(known[:, 0], own[:, 0]), len(known) - 1)
    return at, (known[at] == own).all(1)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", length: int = 8, share: float = 0.3, shard_bytes: int = SLICE_BYTES) -> DataFrame:
    """(id_col, url_col, text, n_chars): the main text of each page.

    A null page is empty. Boilerplate by repetition are blocks that runs of at least length tokens cover that two pages and
    a share of the host's pages hold outside their certain main text; blocks are never cut. Each row is a page, repeated rows too; other
    columns are left out. The pages of a host are sorted in shards of about shard_bytes; if there are several, their repeats are counted over all of them.
    """
    written = Written(pages.sparkSession)
    plain = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host_column(F.col("url")))
    sizes = plain.groupBy("host").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0))).alias("bytes"), F.count("*").alias("total"))
    large = written(sizes.where(F.col("bytes") > shard_bytes).select("host", "total", F.ceil(F.col("bytes") / shard_bytes).alias("shards")))  # at most one in shard_bytes of input
    dealt = plain.withColumn("row", F.xxhash64(F.monotonically_increasing_id())).join(F.broadcast(large), "host", "left")
    dealt = dealt.withColumn("shard", F.pmod("row", F.coalesce("shards", F.lit(1))).cast("long"))
    shards = written(judged_shards(parse(dealt), length, share))
    several = shards.where("kept is null")
    kinds = f"id {id_type(plain, 'id')}, url {id_type(plain, 'url')}, text string"

    def tell(batches):
        for batch in batches:
            ids, urls = batch.column(0), batch.column(1)
            for row in range(batch.num_rows):
                body, kept, windows = (batch.column(i)[row].as_py() for i in (2, 3, 4))
                found = _unwrap(body)
                if kept is None:
                    streams = Streams(found)
                    places = np.flatnonzero(streams.room >= length)
                    _, hit = _look(_known(windows or ()), streams, places, length)
                    kept = checked(found, streams.unique(places[hit], length))
                out = ["\n\n".join(b for b, stays in zip(own, stay) if stays) for (own, _), stay in zip(found, kept)]
                yield pa.RecordBatch.from_arrays([ids[row].values, urls[row].values, pa.array(out, pa.string())], names=["id", "url", "text"])

    told = shards.withColumn("found", F.lit(None).cast("array<binary>"))
    if large.limit(1).count():
        told = told.where("kept is not null").unionByName(with_windows(several, repeated_windows(several, length, share), "left"))
    told = told.select("ids", "urls", "body", "kept", "found").mapInArrow(tell, kinds)
    return told.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
