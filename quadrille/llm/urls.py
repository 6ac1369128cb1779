"""URL filtering: host and path rules first, then naive Bayes over words that hosts are made of.

Names run words together. A Viterbi search splits each run of letters of a host and path into
its likeliest words. Their unigram frequencies come from all the table's texts; a word outside the
lexicon is likely by its length, so a name that is no chain of common words stays whole. A multinomial naive Bayes model,
trained on labelled names, scores the words; words that no labelled name has say nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_type

# Labelled names that train the classifier; other names are judged by the words that they share with these.
BLOCKED = """casino bonus|online casino slots|poker room|sports betting|best bets|jackpot slots|roulette casino|bingo bonus win|adult video|x rated movies|sex chat|xxx porn|porn tube|nude cams|escort girls|hot girls live|adult dating
link farm|seo spam|spam mail|click farm|free pills|cheap viagra|pharma pills|diet pills|payday loan|instant cash loan|crypto doubler|free money|win prize now|lottery prize|win money|warez crack|serial keygen|torrent warez|hacked accounts|fake watches|replica bags|get rich quick|ad server|banner ads|pop ads|ads network|click track|track pixel"""
ALLOWED = """news blog|daily news|world news|science news|city library|public library|art museum|history museum|school book|university press|research lab|open data|health guide|travel guide|travel blog|food blog|garden blog|recipe book|music school|film review
book review|sports news|football club|tech blog|code docs|user docs|open source|free software|wiki page|photo art|weather report|local paper|green energy|water works|farm shop|family farm|home garden|game review|video lesson|online course|adult education|best practice|live music|prize essay|people search|race track"""


def rule_parts(rules: list[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """(verdict, rule, host, path) of (verdict, rule), longest rules first."""
    return [(v, r, r.split("/", 1)[0], "/" + r.split("/", 1)[1] if "/" in r else "") for v, r in sorted(rules, key=lambda x: (-len(x[1]), x[1], x[0]))]


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def seeds() -> list[tuple[bool, list[str]]]:
    return [(blocked, line.split()) for blocked, text in ((True, BLOCKED), (False, ALLOWED)) for line in text.replace("\n", "|").split("|")]


class Model:
    """counts: how often each word of the lexicon occurs; labelled: (whether blocked, words) of each name; prior: the share of URLs to block."""

    #: what a labelled word counts at least, and letters of the longest word
    FLOOR, LONGEST = 50, 20

    def __init__(self, counts: dict[str, int] | None = None, labelled: list[tuple[bool, list[str]]] | None = None, prior: float = 0.3, names: set[str] = frozenset()):
        labelled = seeds() if labelled is None else labelled
        words = {c: Counter(w for blocked, line in labelled if blocked == c for w in line) for c in (True, False)}
        known = set(words[True]) | set(words[False])
        counts = {w: n for w, n in (counts or {}).items() if len(w) <= self.LONGEST} | {w: max(self.FLOOR, (counts or {}).get(w, 0)) for w in known}
        self.total = max(1_000_000, sum(counts.values()))
        self.cost = {w: math.log(n / self.total) for w, n in counts.items()}
        self.longest = max(map(len, self.cost))
        self.prior = math.log(prior / (1 - prior))
        size = {c: sum(x.values()) + len(known) for c, x in words.items()}
        self.odds = {w: math.log((words[True][w] + 1) / size[True]) - math.log((words[False][w] + 1) / size[False]) for w in known}
        self.seen: dict[str, list[str]] = {}
        # texts name hosts: such a name is no word of its own if other words of three letters or more make it up
        for name in sorted((names & set(counts)) - known, key=lambda w: (len(w), w)):
            own = self.cost.pop(name)
            if not all(w in self.cost and len(w) > 2 for w in self.split(name)):
                self.cost[name] = own

    def unknown(self, length: int) -> float:
        """The log probability of a word outside the lexicon: a tenth for each letter."""
        return math.log(10 / self.total) - length * math.log(10)

    def split(self, name: str) -> list[str]:
        """The likeliest words of a name; of equally likely splits the one whose last word is longest."""
        best: list[tuple[float, int]] = [(0.0, 0)]
        strange: list[tuple[float, int]] = [(-math.inf, 0)]  # the best that ends in an unknown word, by the place where that begins
        for end in range(1, len(name) + 1):
            # an unknown word goes on from the letter before, or begins here
            choice = max((strange[-1][0] - math.log(10), -strange[-1][1]), (best[end - 1][0] + self.unknown(1), 1 - end))
            strange.append((choice[0], -choice[1]))
            top = strange[-1]
            for start in range(max(0, end - self.longest), end):
                cost = self.cost.get(name[start:end])
                if cost is not None and best[start][0] + cost > top[0]:
                    top = (best[start][0] + cost, start)
            best.append(top)
        out, end = [], len(name)
        while end:
            start = best[end][1]
            out.append(name[start:end])
            end = start
        return out[::-1]

    def score(self, host: str, path: str) -> float:
        """The model's probability that a URL is to be blocked."""
        if len(self.seen) > 100_000:
            self.seen.clear()
        total = self.prior
        for name in (n for n in re.split(r"[^a-z]+", host + " " + path.lower()) if n):
            if name not in self.seen:
                self.seen[name] = self.split(name)
            total += sum(self.odds.get(w, 0.0) for w in self.seen[name])
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, total))))


def word_counts(pages: DataFrame, url_col: str, text_cols: tuple[str, ...], most: int = 1 << 15) -> tuple[dict[str, int], set[str]]:
    """How often the most frequent runs of the letters a to z occur in text_cols of all rows, and which of them are names of hosts; most bounds what is gathered."""
    if not text_cols:
        return {}, set()
    text = F.lower(F.concat_ws(" ", *[F.col(f"`{c}`") for c in text_cols]))
    said = pages.select(F.explode(F.split(text, "[^a-z]+")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    hosts = pages.select(F.explode(F.split(host_path(F.col(f"`{url_col}`"))[0], "[^a-z]+")).alias("w")).groupBy("w").agg(F.lit(0).cast("long").alias("n"))
    both = said.withColumn("host", F.lit(0)).union(hosts.withColumn("host", F.lit(1))).where(F.length("w").between(2, Model.LONGEST))
    got = both.groupBy("w").agg(F.sum("n").alias("n"), F.max("host").alias("host")).where("n > 0").orderBy(F.desc("n"), "w").limit(most).collect()
    return {r.w: r.n for r in got}, {r.w for r in got if r.host}


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", text_cols: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """(id_col, host, path, rule, verdict, score) of each row.

    The longest rule that fits decides; without one the model does: score is its
    probability of a block, and threshold or more blocks. A null url or one without "://" has empty host and path.
    text_cols give the lexicon its words beside the labelled ones. Repeated rows are judged each; other columns are left out.
    """
    counts, hosts = word_counts(pages, url_col, text_cols)
    host, path = host_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, text, h, p in reversed(rule_parts(rules)):
        fits = (F.col("host") == h) | F.col("host").endswith("." + h)
        if p:
            fits &= F.col("path").startswith(p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, v).otherwise(verdict)
    parts = parts.select("*", rule.alias("rule"), verdict.alias("own"))

    def run(batches):
        model = Model(counts, names=hosts)
        for batch in batches:
            scores = [model.score(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            verdicts = [v or ("block" if x >= threshold else "allow") for v, x in zip(batch.column(4).to_pylist(), scores)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())], names=["id", "host", "path", "rule", "verdict", "score"])

    out = parts.mapInArrow(run, f"id {id_type(pages, id_col)}, host string, path string, rule string, verdict string, score double")
    return out.withColumnRenamed("id", id_col)
