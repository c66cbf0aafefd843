"""Quality rules with verdicts on hosts (operator 5).

Each text is measured against rules.  Failures are aggregated by host, and the
hosts' rates are shrunk towards a beta prior that is fitted to the rates of all
hosts by their moments, so that few documents can't condemn a host.  A host
with too high a shrunk rate in any rule fails, and its documents with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_checked, stored, words

#: A window that is looked for again, in words.
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: The further rules, which only count against hosts: symbols in a hundred words, repeated lines in a hundred.
MAX_SYMBOLS_PERCENT = 30
MAX_DUP_LINES_PERCENT = 50
#: A host fails above this shrunk rate.
MAX_HOST_RATE = 0.5
RULES = ("few_words", "repeated_words", "symbols", "dup_lines")

BLANK_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measured(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(id, host, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words), all counts long.

    n_repeat_words counts the words within windows of five that stand twice or
    more in the text.  Windows are compared by a 64-bit hash of their words;
    in a text of a million words two different ones meet with a probability of
    about 3 in 100 million.  Sorted hashes show whether any repeats; only then
    places are followed up.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    line = F.filter(F.split(t, "\n"), lambda x: _without(x, BLANK_CHARS) != "")
    base = docs.select(
        F.col(id).alias("id"), F.col(host).alias("host"), words(t).alias("w"),
        F.length(_without(t, BLANK_CHARS)).cast("long").alias("word_chars"),
        (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
        line.alias("lines"),
    )
    hashed = base.select(
        "id", "host", "word_chars", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") > WINDOW, F.expr(f"transform(sequence(1, size(w) - {WINDOW - 1}), i -> xxhash64(w[i - 1], w[i], w[i + 1], w[i + 2], w[i + 3]))"))
        .otherwise(F.array().cast("array<long>")).alias("h"),
    )
    flagged = hashed.withColumn("again", F.size(F.array_distinct("h")) < F.size("h"))
    placed = flagged.withColumn("s", F.when(F.col("again"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    hits = placed.withColumn(
        "p", F.expr("array_sort(transform(filter(s, (x, k) -> (k > 0 and s[k - 1].h = x.h) or (k + 1 < size(s) and s[k + 1].h = x.h)), x -> x.i))")
    )
    covered = F.expr(f"aggregate(transform(p, (x, k) -> if(k + 1 < size(p), least(p[k + 1] - x, {WINDOW}), {WINDOW})), 0L, (n, x) -> n + x)")
    return hits.select("id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", F.when(F.col("again"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"))


def failures() -> dict[str, Column]:
    return {
        "few_words": F.col("n_words") < MIN_WORDS,
        "repeated_words": 100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOLS_PERCENT * F.col("n_words"),
        "dup_lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINES_PERCENT * F.col("n_lines"),
    }


def host_verdicts(rows: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n_docs, <rule>_rate ..., host_ok) from measured rows; null is a host like others.

    The prior of a rule has the mean and the variance between hosts of its
    rates, what sampling alone explains taken off the latter (method of
    moments, hosts counting alike).  Where rates don't differ more than
    sampling explains, every host gets nearly the common rate.
    """
    fails = failures()
    hosts = stored(rows.groupBy("host").agg(F.count("*").alias("n_docs"), *[F.count_if(fails[r]).alias(r) for r in RULES]), "host-failures")
    rate = {r: F.col(r) / F.col("n_docs") for r in RULES}
    moments = hosts.agg(
        *[F.avg(rate[r]).alias(f"{r}_m") for r in RULES], *[F.var_samp(rate[r]).alias(f"{r}_v") for r in RULES],
        F.avg(1 / F.col("n_docs")).alias("inv"),
    ).first()
    shrunk = []
    for r in RULES:
        m = min(max(moments[f"{r}_m"] or 0.0, 1e-6), 1 - 1e-6)
        spread = (moments[f"{r}_v"] or 0.0) - m * (1 - m) * (moments["inv"] or 0.0)
        weight = min(max(m * (1 - m) / spread - 1, 1.0), 1e6) if spread > 0 else 1e6  # alpha + beta
        shrunk.append(((F.col(r) + m * weight) / (F.col("n_docs") + weight)).alias(f"{r}_rate"))
    return hosts.select("host", "n_docs", *shrunk).withColumn("host_ok", F.greatest(*[F.col(f"{r}_rate") for r in RULES]) <= max_rate)


def apply_rules(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """measured() with base_failed, host_ok and kept, one row for each row of docs.

    A document is kept if it fails no base rule (too few words, too many
    repeated ones) and its host doesn't fail.  Null texts have no words and
    fail.  Ids may be null or repeat; an empty table gives an empty result;
    other columns are ignored.

    Failures are summed in each task before they are shuffled, and verdicts are
    broadcast only if counted to be few; else adaptive execution splits hot hosts.
    """
    rows = stored(measured(docs, id, text, host), "rule-measures")
    verdicts = host_verdicts(rows, max_rate).select(F.xxhash64("host").alias("__key"), F.col("host").alias("__host"), "host_ok")
    verdicts = stored(verdicts, "host-verdicts")
    fails = failures()
    joined = join_checked(rows.withColumn("__key", F.xxhash64("host")), verdicts, ["__key"]).filter(F.col("host").eqNullSafe(F.col("__host")))
    return joined.withColumn("base_failed", fails["few_words"] | fails["repeated_words"]).select(
        F.col("id").alias(id), F.col("host").alias(host), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "host_ok", (~F.col("base_failed") & F.col("host_ok")).alias("kept"),
    )
