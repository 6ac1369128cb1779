"""Quality rules on texts and on their hosts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written

#: The white space that separates words.
BLANK = r" \t\n\x0B\f\r"
SYMBOLS = "#*$%&|<>"


def word_array(text: Column) -> Column:
    """The runs of characters other than BLANK."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{BLANK}]+"))


def measures(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """keep, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row; a null text has none of each.

    Windows of three words are hashed to 64 bits. Where a text has equal ones, their
    hashes are sorted with their places and neighbours compared, so the work grows as
    n log n with a text; nothing is exploded or shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = docs.select(*keep, text.alias("_text"), word_array(text).alias("_w"))
    lines = "filter(split(_text, '\\n', -1), x -> x rlike '[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]')"
    second = first.select(
        *[F.col(c) for c in first.columns if c not in ("_text", "_w")],
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.translate("_text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.expr(lines).alias("_l"),
        F.expr("case when size(_w) < 3 then array() else transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) end").alias("_h"),
    )
    plain = [c for c in second.columns if c not in ("_l", "_h")]
    third = second.select(
        *plain,
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr("case when size(array_distinct(_h)) = size(_h) then array() else sort_array(transform(_h, (h, i) -> struct(h, i))) end").alias("_s"),
    )
    plain = [c for c in third.columns if c != "_s"]
    fourth = third.select(
        *plain,
        F.expr("sort_array(transform(filter(_s, (x, k) -> (k > 0 and x.h = _s[greatest(k - 1, 0)].h) or (k < size(_s) - 1 and x.h = _s[least(k + 1, size(_s) - 1)].h)), x -> x.i))").alias("_p"),
    )
    covered = "aggregate(transform(_p, (p, k) -> least(3, if(k = size(_p) - 1, 3, _p[least(k + 1, size(_p) - 1)] - p))), 0L, (a, x) -> a + x)"
    return fourth.select(*plain, F.expr(covered).alias("n_repeat_words"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 50, max_repeat_percent: int = 50, max_host_rate: float = 0.6) -> DataFrame:
    """(id_col, host, the measures, base_failed, host_rate, kept) for each row.

    The share of failures of each host is shrunk towards the corpus by a beta prior,
    whose two parameters the hosts' counts give by moments weighted by their rows. A host beyond
    max_host_rate loses all its documents. A null host is a host of its own.
    """
    written = Written(docs.sparkSession)
    rows = measures(docs, text_col, [F.col(id_col).alias("_id"), F.col(host_col).alias("_host")])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    own = written(rows.withColumn("base_failed", failed))
    hosts = written(own.groupBy("_host").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("bad")))
    rate = F.col("bad") / F.col("n")
    # moments: mean m, and the variance between hosts beyond what counting alone gives
    prior = hosts.agg((F.sum("bad") / F.sum("n")).alias("m"), F.sum("n").alias("all"), F.count("*").alias("hosts"), F.sum(F.col("n") * rate * rate).alias("sq"))
    m, spread = F.col("m"), F.greatest(F.col("sq") / F.col("all") - F.col("m") * F.col("m"), F.lit(0.0))
    within = m * (1 - m) * F.col("hosts") / F.col("all")
    between = F.greatest(spread - within, F.lit(0.0))
    strength = F.when(between > 0, F.least(F.greatest(m * (1 - m) / between - 1, F.lit(1.0)), F.lit(1e6))).otherwise(F.lit(1e6))
    prior = prior.select((m * strength).alias("alpha"), (strength).alias("strength")).first()  # one row
    alpha, strength = (prior.alpha or 0.0, prior.strength or 1.0) if prior else (0.0, 1.0)
    rated = hosts.select("_host", ((F.col("bad") + F.lit(alpha)) / (F.col("n") + F.lit(strength))).alias("host_rate"))
    joined = own.join(rated.withColumnRenamed("_host", "_h"), own["_host"].eqNullSafe(F.col("_h")))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return joined.select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), *counts, "base_failed", "host_rate", (~F.col("base_failed") & (F.col("host_rate") <= max_host_rate)).alias("kept")
    )
