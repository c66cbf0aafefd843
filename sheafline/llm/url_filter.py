"""URL verdicts by rules and gradient-boosted trees on lexical features (operator 8)."""

from __future__ import annotations

import math
import string
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the labelled URLs that trees are trained on, the first of each label by a hash.
MOST_BAD = 10_000
MOST_GOOD = 10_000
TREES = 40
DEPTH = 3
RATE = 0.3
BINS = 32
RIDGE = 1.0
#: Buckets in which host suffixes are counted.
SUFFIX_BUCKETS = 4096
THRESHOLD = 0.5

#: Parts of host names that label a URL as bad where no labels are given.
BAD_PARTS = ("ads", "bets", "casino", "cheap", "farm", "free", "pills", "poker", "spam", "track", "viagra", "win")

FEATURES = (
    "length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "host_entropy", "params", "has_fragment",
    "host_labels", "host_hyphens", "host_digits", "longest_label", "path_hyphens", "file_ending", "secure",
    "suffix_share", "suffix_bad",
)


def host_of(url: Column) -> Column:
    """What is between the first :// and the next /, ?, # or end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def _after_scheme(url: Column) -> Column:
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    return F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What is between the host and the next ?, # or end; else empty."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def parse_rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def matching_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        text = F.when(r.fits(host, path), F.lit(r.text)).otherwise(text)
        verdict = F.when(r.fits(host, path), F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def suffix_of(host: str) -> str:
    """The last two labels."""
    return ".".join(host.rsplit(".", 2)[-2:])


def lexical(url: str | None, suffixes: np.ndarray) -> list[float]:
    """The features of a URL; suffixes: (SUFFIX_BUCKETS, 2) with the share of all URLs and the rate of bad ones."""
    u = url or ""
    _, found, rest = u.partition("://")
    if not found:
        rest = ""
    end = min((k for c in "/?#" if (k := rest.find(c)) >= 0), default=len(rest))
    host, tail = rest[:end].lower(), rest[end:]
    tail, hash_, _ = tail.partition("#")
    path, ask, query = tail.partition("?")
    labels = host.split(".")
    digits = sum(map(str.isdigit, u))
    share, bad = suffixes[zlib.crc32(suffix_of(host).encode("utf-8", "replace")) % SUFFIX_BUCKETS]
    last = path.rsplit("/", 1)[-1]
    return [
        len(u), len(host), len(path), sum(map(bool, path.split("/"))), digits / max(len(u), 1), _entropy(u), _entropy(host),
        query.count("&") + 1 if ask and query else 0, float(bool(hash_)), len(labels), host.count("-"), sum(map(str.isdigit, host)),
        max(map(len, labels)), path.count("-"), float("." in last), float(u.startswith("https:")), share, bad,
    ]


@dataclass
class Trees:
    """Boosted trees; a tree is (features, thresholds, leaves) of a full binary tree, level by level."""

    base: float = 0.0
    trees: list[tuple[list[int], list[float], list[float]]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in self.trees:
            f, t, v = np.array(feature), np.array(threshold), np.array(leaf)
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**DEPTH - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def train(x: np.ndarray, y: np.ndarray) -> Trees:
    """Second-order boosting of the logistic loss on binned features; deterministic.

    With one class only, or no rows, the trees are none and say that class (or good).
    """
    n = len(y)
    if not n or y.min() == y.max():
        return Trees(-20.0 if not n or y.max() == 0 else 20.0)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    edges = [np.unique(np.r_[e, (np.unique(x[:, k])[:-1] + np.unique(x[:, k])[1:]) / 2]) if len(np.unique(x[:, k])) <= BINS else e for k, e in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1)
    wide = max(map(len, edges)) + 1
    model = Trees(float(np.log(y.mean() / (1 - y.mean()))))
    raw = np.full(n, model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        feature, threshold = [0] * (2**DEPTH - 1), [math.inf] * (2**DEPTH - 1)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, m = 2**level - 1, 2**level
            best = np.zeros(m)
            for k, e in enumerate(edges):
                if not len(e):
                    continue
                at = (node - first) * wide + binned[:, k]
                gs = np.bincount(at, g, m * wide).reshape(m, wide).cumsum(axis=1)
                hs = np.bincount(at, h, m * wide).reshape(m, wide).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
                gain = gain[:, : len(e)]
                for j in range(m):
                    c = int(gain[j].argmax())
                    if gain[j, c] > best[j] + 1e-9:
                        best[j] = gain[j, c]
                        feature[first + j], threshold[first + j] = k, float(e[c])
            f, t = np.array(feature), np.array(threshold)
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
        at = node - (2**DEPTH - 1)
        leaf = RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + RIDGE)
        raw += leaf[at]
        model.trees.append((feature, threshold, leaf.tolist()))
    return model


def label_by_parts(host: Column, parts: tuple[str, ...] = BAD_PARTS) -> Column:
    """1 if the host has one of the parts between dots and hyphens, else 0; null without a host."""
    return F.when(host != "", F.arrays_overlap(F.split(host, r"[.-]"), F.array(*map(F.lit, parts))).cast("int"))


@dataclass
class UrlModel:
    trees: Trees
    suffixes: np.ndarray


def fit(urls: DataFrame, url: str = "url", label: str = "label") -> UrlModel:
    """urls(url, label 1 bad, 0 good or null).

    Suffix statistics are counted over all URLs, in a fixed number of buckets;
    trees are trained on MOST_BAD and MOST_GOOD labelled URLs at most.
    """
    u, y = F.coalesce(F.col(url), F.lit("")), F.col(label)
    host = host_of(F.col(url))
    bucket = F.pmod(F.crc32(F.regexp_extract(host, r"[^.]*(?:\.[^.]*)?$", 0).cast("binary")), F.lit(SUFFIX_BUCKETS)).cast("int")
    counts = urls.groupBy(bucket.alias("k")).agg(F.count("*").alias("n"), F.count(y).alias("m"), F.sum(y).alias("bad")).collect()  # SUFFIX_BUCKETS rows at most
    total, known, bad = (sum(r[c] or 0 for r in counts) for c in ("n", "m", "bad"))
    rate = bad / known if known else 0.0
    suffixes = np.zeros((SUFFIX_BUCKETS, 2))
    suffixes[:, 1] = rate
    for r in counts:
        suffixes[r.k] = (r.n / total, ((r.bad or 0) + 20 * rate) / (r.m + 20))
    first = lambda v, most: urls.filter(y == v).select(u.alias("u"), y.alias("y")).distinct().orderBy(F.xxhash64("u"), "u").limit(most).collect()
    rows = first(1, MOST_BAD) + first(0, MOST_GOOD)
    x = np.array([lexical(r.u, suffixes) for r in rows], float).reshape(-1, len(FEATURES))
    return UrlModel(train(x, np.array([float(r.y) for r in rows])), suffixes)


def bad_probability(url: Column, model: UrlModel) -> Column:
    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            x = np.array([lexical(u, model.suffixes) for u in b.to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.array(model.trees.probability(x))

    return scored(url)


def judge(pages: DataFrame, rules: list[Rule], labels: Column | None = None, url: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """pages with host, path, rule, probability (of being bad) and verdict ('allow' or 'block').

    A rule fits its host and all subdomains if the path starts with the rule's;
    the longest wins, and without one the trees decide.  labels is a column
    with 1 (bad), 0 (good) or null; by default hosts with a part of BAD_PARTS
    are bad.  Null urls, and those without ://, have an empty host and path
    and are judged by their (empty or odd) text.  Rows may repeat; an empty
    table stays empty; other columns pass through, those with the names of
    new ones are replaced.  Nothing is shuffled but counts of suffixes and the
    bounded sample.
    """
    new = ("host", "path", "rule", "probability", "verdict")
    clear = pages.drop(*[c for c in new if c != url])
    host, path = host_of(F.col(url)), path_of(F.col(url))
    model = fit(clear.select(F.col(url).alias("url"), (labels if labels is not None else label_by_parts(host)).alias("label")))
    text, verdict = matching_rule(rules, F.col("host"), F.col("path"))
    return (
        clear.withColumns({"host": host, "path": path, "probability": bad_probability(F.col(url), model)})
        .withColumn("rule", text)
        .withColumn("verdict", F.coalesce(verdict, F.when(F.col("probability") >= threshold, "block").otherwise("allow")))
    )
