"""Comparing texts and corpora: tokens, coverage, multisets, n-grams, baselines."""

from __future__ import annotations

import difflib
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import settled

#: N-grams that are broadcast at most.
MOST_SENT = 200_000
#: At least two letters in a row.
LETTERS = r"\p{L}{2,}"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS), 0)


def folded_tokens(text: Column) -> Column:
    """NFKC and case folding first."""

    @F.arrow_udf("string")
    def fold(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else unicodedata.normalize("NFKC", v).casefold() for v in values.to_pylist()], pa.string())

    return tokens(fold(text))


def without_marks(text: Column) -> Column:
    """NFKD less combining marks."""

    @F.arrow_udf("string")
    def strip(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)) for v in values.to_pylist()], pa.string())

    return strip(text)


def distinct_tokens(docs: DataFrame, id: list[str], text: str) -> DataFrame:
    return docs.select(*id, F.explode(F.array_distinct(tokens(F.col(text)))).alias("token"))


def token_counts(docs: DataFrame, id: list[str], text: str) -> DataFrame:
    return docs.select(*id, F.explode(tokens(F.col(text))).alias("token")).groupBy(*id, "token").agg(F.count("*").alias("n"))


def pair_counts(docs: DataFrame, id: list[str], text: str, pattern: str = r"\p{IsHan}") -> DataFrame:
    """Adjacent characters of a pattern, counted."""
    runs = F.explode(F.regexp_extract_all(F.col(text), F.lit(f"({pattern})+"), 0))
    pairs = F.explode(F.expr("transform(sequence(1, greatest(length(run) - 1, 1)), i -> substring(run, i, 2))"))
    return docs.select(*id, runs.alias("run")).filter(F.length("run") > 1).select(*id, pairs.alias("token")).groupBy(*id, "token").agg(F.count("*").alias("n"))


def coverage(left: Column, right: Column) -> Column:
    """Percent of the distinct elements of one array that another has; none for an empty one."""
    own = F.array_distinct(left)
    return F.when(F.size(own) > 0, 100.0 * F.size(F.array_intersect(own, right)) / F.size(own))


def missing_sample(left: Column, right: Column, n: int = 12) -> Column:
    return F.slice(F.array_sort(F.array_except(left, right)), 1, n)


def multiset_scores(left: DataFrame, right: DataFrame, id: list[str], token: str = "token") -> DataFrame:
    """(id, shared, of_left, of_right, only_left, only_right, jaccard, recall, precision) of counted tokens (token, n)."""
    both = left.withColumnRenamed("n", "l").join(right.withColumnRenamed("n", "r"), [*id, token], "full")
    l, r = F.coalesce("l", F.lit(0)), F.coalesce("r", F.lit(0))
    sums = both.groupBy(*id).agg(
        F.sum(F.least(l, r)).alias("shared"), F.sum(l).alias("of_left"), F.sum(r).alias("of_right"),
        F.sum(F.greatest(l - r, F.lit(0))).alias("only_left"), F.sum(F.greatest(r - l, F.lit(0))).alias("only_right"), F.sum(F.greatest(l, r)).alias("__all"),
    )
    part = lambda a, b: F.when(b > 0, a / b)
    return sums.select(
        "*", part(F.col("shared"), F.col("__all")).alias("jaccard"), part(F.col("shared"), F.col("of_left")).alias("recall"), part(F.col("shared"), F.col("of_right")).alias("precision")
    ).drop("__all")


def char_coverage(left: DataFrame, right: DataFrame, id: list[str], text: str) -> DataFrame:
    """Share of the characters, counted, that the other text of the same id has too."""
    chars = lambda d: d.select(*id, F.explode(F.split(F.regexp_replace(F.col(text), r"\s", ""), "")).alias("token")).filter("token <> ''").groupBy(*id, "token").agg(F.count("*").alias("n"))
    return multiset_scores(chars(left), chars(right), id).select(*id, "shared", "of_left", F.col("recall").alias("coverage"))


def lost_tokens(source: DataFrame, output: DataFrame, id: list[str]) -> DataFrame:
    """Tokens of the source that the output lacks, whole or as a fragment: one or two letters longer at either end is forgiven."""
    n = F.length("token")
    cut = lambda a, b: F.expr(f"substring(token, {1 + a}, greatest(length(token) - {a + b}, 0))")
    # what each token of the output forgives, so that tokens are looked up and never compared in pairs
    forms = F.array(F.col("token"), *[F.when(n > k, form) for k in (1, 2) for form in (cut(k, 0), cut(0, k))])
    forgiven = output.select(*id, "token").distinct().select(*id, F.explode(F.array_compact(F.array_distinct(forms))).alias("token"))
    return source.select(*id, "token").distinct().join(forgiven, [*id, "token"], "left_anti")


def deficits(source: DataFrame, output: DataFrame, id: list[str]) -> DataFrame:
    """Counted tokens that the output has, but less often: (id, token, n, found)."""
    both = source.join(output.withColumnRenamed("n", "found"), [*id, "token"])
    return both.filter(F.col("found") < F.col("n"))


def unique_ngrams(docs: DataFrame, id: list[str], text: str, n: int = 5, among: DataFrame | None = None) -> DataFrame:
    """(gram, id, at): n-grams that stand once in the whole table; with among(gram) only those, and no others are shuffled if they are few."""
    t = tokens(F.col(text))
    grams = docs.select(*id, t.alias("t")).filter(F.size("t") >= n).select(
        *id, F.posexplode(F.expr(f"transform(sequence(1, size(t) - {n - 1}), i -> array_join(slice(t, i, {n}), ' '))")).alias("at", "gram")
    )
    if among is not None:
        few = among.limit(MOST_SENT + 1).count() <= MOST_SENT
        grams = grams.join(F.broadcast(among) if few else among, "gram", "left_semi")
    return grams.groupBy("gram").agg(F.count("*").alias("__n"), *[F.min(c).alias(c) for c in id], F.min("at").alias("at")).filter("__n = 1").drop("__n")


def aligned(left: DataFrame, right: DataFrame, id: list[str], text: str, n: int = 5) -> DataFrame:
    """The first n-gram by place that each left id shares with a right one, unique on both sides; ids without one stay."""
    l = settled(unique_ngrams(left, id, text, n), "grams")
    r = unique_ngrams(right, id, text, n, l.select("gram")).select("gram", *[F.col(c).alias(f"to_{c}") for c in id], F.col("at").alias("to_at"))
    first = l.join(r, "gram").groupBy(*id).agg(F.min_by(F.struct("gram", *[f"to_{c}" for c in id], "at", "to_at"), "at").alias("m"))
    return left.select(*id).distinct().join(first, id, "left").select(*id, "m.*")


def sequence_ratio(a: Column, b: Column, most: int = 4000) -> Column:
    """difflib's ratio of the first so many words of two texts."""

    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        cut = lambda t: (t or "").split()[:most]
        return pa.array([difflib.SequenceMatcher(None, cut(p), cut(q), autojunk=False).ratio() for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    return run(a, b)


def top_tokens(counts: DataFrame, n: int) -> DataFrame:
    """The commonest tokens; ties by the token."""
    return counts.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "token").limit(n)


def duplicate_ids(rows: DataFrame, scope: list[str], id: str) -> DataFrame:
    return rows.groupBy(*scope, id).agg(F.count("*").alias("n")).filter("n > 1")


def differences(a: DataFrame, b: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Keys whose values two runs don't agree on, or that one of them lacks."""
    x = a.select(*key, F.struct(*values).alias("__a"))
    y = b.select(*key, F.struct(*values).alias("__b"))
    return x.join(y, key, "full").filter(~F.col("__a").eqNullSafe(F.col("__b"))).select(
        *key, F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").otherwise("changed").alias("change")
    )


def scoreboard(before: DataFrame, now: DataFrame, key: list[str], value: str) -> DataFrame:
    """new, changed and fixed entries against a baseline."""
    both = before.select(*key, F.col(value).alias("before")).join(now.select(*key, F.col(value).alias("now")), key, "full")
    status = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "fixed").when(F.col("before") != F.col("now"), "changed")
    return both.withColumn("status", status).filter("status is not null")


def bands(value: Column) -> Column:
    """The bands of coverage reports."""
    return F.when(value >= 100, "100").when(value >= 90, "90-99").when(value >= 50, "50-89").otherwise("<50")


def delta_histogram(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    both = a.select(*key, F.col(value).alias("a")).join(b.select(*key, F.col(value).alias("b")), key)
    return both.groupBy((F.col("b") - F.col("a")).alias("delta")).agg(F.count("*").alias("n"))


def counters(rows: DataFrame, by: list[str], total: bool = True) -> DataFrame:
    """Counts for each combination and, with total, rolled up."""
    return (rows.rollup(*by) if total else rows.groupBy(*by)).agg(F.count("*").alias("n"))


def triage(rows: DataFrame, code: str, id: str, score: str, delta: str) -> DataFrame:
    """Each code's ids, worst first: least score (unknown last), largest change, id."""
    item = F.struct(F.col(score).isNull().alias("u"), F.col(score).alias("s"), (-F.abs(F.col(delta))).alias("d"), F.col(id).alias("id"))
    return rows.groupBy(code).agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["id"]).alias("ids"), F.count("*").alias("n"))


def losses(rows: DataFrame, sets: list[list[str]], flags: list[str]) -> DataFrame:
    """Several groupings at once, with how often each flag is set."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in every]).agg(F.count("*").alias("n"), *[F.count_if(F.col(f)).alias(f) for f in flags])


def worst_page(rows: DataFrame, id: list[str], page: str, score: str) -> DataFrame:
    return rows.groupBy(*id).agg(F.min_by(page, F.struct(score, page)).alias(page), F.min(score).alias(score))


def drops(now: DataFrame, before: DataFrame, key: list[str], score: str, n: int) -> DataFrame:
    """The n largest losses against a baseline."""
    both = now.join(before.select(*key, F.col(score).alias("before")), key, "left").withColumn("lost", F.col("before") - F.col(score))
    return both.orderBy(F.col("lost").desc_nulls_last(), *key).limit(n)


def manifest_problems(expected: DataFrame, found: DataFrame, name: str, content: str, digest: str) -> DataFrame:
    """Files that are missing, extra or of another SHA-256 than expected."""
    have = found.select(name, F.sha2(F.col(content), 256).alias("__have"))
    both = expected.select(name, digest).join(have, name, "full")
    problem = F.when(F.col("__have").isNull(), "missing").when(F.col(digest).isNull(), "extra").when(F.col("__have") != F.col(digest), "changed")
    return both.withColumn("problem", problem).filter("problem is not null").select(name, "problem")


def lost_links(links: DataFrame, parts: DataFrame, id: list[str], url: str, content: str) -> DataFrame:
    """(id, url) of the http(s) links that stand in no part of the output with their id; entities in parts are read as what they stand for."""
    plain = F.col(content)
    # the ampersand last, so that nothing is read twice
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    wanted = links.filter(F.col(url).rlike("^https?:")).select(*id, url).distinct()
    texts = parts.select(*id, plain.alias("__content"))
    found = F.coalesce(F.contains("__content", url), F.lit(False))
    return wanted.join(texts, id, "left").groupBy(*id, url).agg(F.bool_or(found).alias("__found")).filter(~F.col("__found")).drop("__found")


def tile_agreement(pixels: DataFrame, id: list[str], width: int, height: int, columns: int = 4, rows: int = 6) -> DataFrame:
    """(id, agreement, worst) of pixels(id, x, y, a, b) from 0 to 255: 1 for equal pictures, over all and in the tile that agrees least.

    A mean over a picture hides a defect in one place; a grid of tiles shows it.
    """
    tile = [F.floor(F.col("y") * rows / height).alias("__r"), F.floor(F.col("x") * columns / width).alias("__c")]
    apart = F.sum(F.abs(F.col("a") - F.col("b"))).alias("__apart")
    tiles = pixels.groupBy(*id, *tile).agg(apart, F.count("*").alias("__n"))
    near = lambda total, n: 1 - total / (255.0 * n)
    return tiles.groupBy(*id).agg(near(F.sum("__apart"), F.sum("__n")).alias("agreement"), F.min(near(F.col("__apart"), F.col("__n"))).alias("worst"))


def logged_totals(lines: DataFrame, text: str, mark: str, keys: list[str], amount: str) -> DataFrame:
    """(keys, n, amount) of log lines such as "RASTERIZE kind=image reason=clip text_chars=12"; other lines don't count."""
    value = lambda k: F.regexp_extract(text, rf"\b{k}=(\S+)", 1)
    marked = lines.filter(F.col(text).contains(f"{mark} ")).select(*[value(k).alias(k) for k in keys], value(amount).cast("bigint").alias(amount))
    return marked.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(amount).alias(amount))
