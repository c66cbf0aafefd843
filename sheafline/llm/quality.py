"""Quality scores by co-training on two views (operator 3).

One classifier sees what a text consists of, the other a page's metadata
(language, source, length).  Over rounds each labels the documents of an
unlabelled pool that it is sure of for the other one.  Both are then
calibrated on labelled documents that neither was trained on, and combined.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Bounds of what is fitted on: labelled documents and the unlabelled pool, both the first by a hash of the id.
MOST_LABELLED = 20_000
MOST_POOL = 20_000
ROUNDS = 4
#: Pseudo-labels a view gives in a round, at most, and how sure it has to be.
GIVEN = 1_000
SURE = 0.98
BINS = 8
SOURCE_BUCKETS = 64
LANG_BUCKETS = 16

_SYMBOLS = b"#*$%&|<>{}[]~^@=+\\_"
TEXT_FEATURES = (
    "log_words", "mean_word", "upper_words", "symbols", "exclamations", "digits", "ends_odd", "short_words",
    "distinct_words", "distinct_pairs", "same_next", "repeated_lines", "middle_word",
)


def text_features(text: str | None) -> list[float]:
    """What a text consists of; all zeros without words.  Long texts are read whole."""
    w = (text or "").split()
    n = len(w)
    if not n:
        return [0.0] * len(TEXT_FEATURES)
    b = text.encode("utf-8", "replace")
    pairs = set(zip(w, w[1:], strict=False))
    same = sum(a == c for a, c in pairs)  # distinct words that follow themselves
    lines = [x for x in text.split("\n") if x.strip()]
    size = len(b)
    return [
        math.log(n),
        sum(map(len, w)) / n,
        sum(map(str.isupper, w)) / n,
        (size - len(b.translate(None, _SYMBOLS))) / size,
        b.count(b"!") / size,
        (size - len(b.translate(None, b"0123456789"))) / size,
        1 - sum(map(str.isalnum, [x[-1] for x in w])) / n,
        sum(x < 4 for x in map(len, w)) / n,
        len(set(w)) / n,
        len(pairs) / max(n - 1, 1),
        same / n,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        w.count(w[n // 2]) / n,  # of the word in the middle, a draw that is likely to hit what a text is stuffed with
    ]


@dataclass
class Logistic:
    """Logistic regression on one-hot columns: for each feature, which bin or bucket it falls in."""

    edges: list[np.ndarray | int]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: tuple[float, float] = (1.0, 0.0)

    def widths(self) -> list[int]:
        return [e + 1 if isinstance(e, int) else len(e) + 2 for e in self.edges]

    def columns(self, x: np.ndarray) -> np.ndarray:
        """(rows, features) column numbers; what is not a number has a column of its own."""
        out, at = np.empty(x.shape, np.int64), 1
        for k, (e, width) in enumerate(zip(self.edges, self.widths(), strict=True)):
            v = x[:, k]
            bad = np.isnan(v)
            place = np.where(bad, 0, v).astype(np.int64) % e if isinstance(e, int) else np.searchsorted(e, np.where(bad, 0, v), "right")
            out[:, k] = at + np.where(bad, width - 1, place)
            at += width
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> None:
        c, m = self.columns(x), 1 + sum(self.widths())
        a = np.zeros((len(x), m))
        a[:, 0] = 1
        a[np.arange(len(x))[:, None], c] = 1
        w = np.zeros(m)
        keep = np.full(m, ridge)
        keep[0] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-a @ w))
            step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(keep), a.T @ (y - p) - keep * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.weights[0] + self.weights[self.columns(x)].sum(axis=1) if len(x) else np.zeros(0)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.scale[0] * self.raw(x) + self.scale[1]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling."""
        w = _newton(np.c_[self.raw(x), np.ones(len(x))], y)
        self.scale = (float(max(w[0], 0.0)), float(w[1]))


def _newton(a: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    y = (y * len(y) + 0.5) / (len(y) + 1)  # smoothed targets: separable classes keep finite weights
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    """Two calibrated views and how they are combined; without one kind of labels everything is kept."""

    text: Logistic | None = None
    meta: Logistic | None = None
    mix: tuple[float, float, float] = (0.0, 0.0, 0.0)
    threshold: float = 0.0
    held_out: dict[str, float] = field(default_factory=dict)

    def scores(self, texts: np.ndarray, metas: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None or self.meta is None:
            one = np.ones(len(texts))
            return one, one, one
        t, m = self.text.logit(texts), self.meta.logit(metas)
        s = lambda z: 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        return s(t), s(m), s(self.mix[0] * t + self.mix[1] * m + self.mix[2])


def _edges(x: np.ndarray) -> np.ndarray:
    x = x[~np.isnan(x)]
    return np.unique(np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0)


def co_train(texts: np.ndarray, metas: np.ndarray, labels: np.ndarray, pool_texts: np.ndarray, pool_metas: np.ndarray) -> Model:
    """Every fourth labelled row is held out for calibration, combination and threshold.

    A view gives pseudo-labels only where it is calibrated to be sure, and in
    the proportion of the classes, so a weak view gives few or none.
    """
    held = np.arange(len(labels)) % 4 == 0
    if any(len(set(labels[part])) < 2 for part in (held, ~held)):
        return Model()
    views = [
        Logistic([_edges(texts[:, k]) for k in range(texts.shape[1])]),
        Logistic([_edges(metas[:, 0]), SOURCE_BUCKETS, LANG_BUCKETS]),
    ]
    own, pool = [texts, metas], [pool_texts, pool_metas]
    given_x: list[list[np.ndarray]] = [[], []]
    given_y: list[list[np.ndarray]] = [[], []]
    free = [np.ones(len(pool_texts), bool), np.ones(len(pool_texts), bool)]
    share = float(labels[~held].mean())
    for k in range(ROUNDS + 1):
        for v in (0, 1):
            views[v].fit(np.concatenate([own[v][~held], *given_x[v]]), np.concatenate([labels[~held], *given_y[v]]))
            views[v].calibrate(own[v][held], labels[held])
        if k == ROUNDS:
            break
        for v in (0, 1):
            z, to = views[v].logit(pool[v]), 1 - v
            sure = math.log(SURE / (1 - SURE))
            for sign, y, part in ((1, 1.0, share), (-1, 0.0, 1 - share)):
                found = np.flatnonzero(free[to] & (sign * z >= sure))
                best = found[np.argsort(-sign * z[found], kind="stable")][: max(1, round(GIVEN * part))]
                given_x[to].append(pool[to][best])
                given_y[to].append(np.full(len(best), y))
                free[to][best] = False
    a = np.c_[views[0].logit(texts[held]), views[1].logit(metas[held]), np.ones(held.sum())]
    model = Model(views[0], views[1], tuple(map(float, _newton(a, labels[held]))))
    score, y = model.scores(texts[held], metas[held])[2], labels[held]
    cuts = np.unique(score)
    balanced = [((score[y == 1] >= c).mean() + (score[y == 0] < c).mean()) / 2 for c in cuts]
    k = int(np.argmax(balanced))
    model.threshold = float((cuts[k] + (cuts[k - 1] if k else 0.0)) / 2)
    model.held_out = {"good_kept": float((score[y == 1] >= model.threshold).mean()), "bad_rejected": float((score[y == 0] < model.threshold).mean()), "rows": int(len(y))}
    return model


def _bucket(x: str | None) -> float:
    return float("nan") if x is None else float(zlib.crc32(x.encode("utf-8", "replace")))


def _features(text: pa.Array, source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    t = np.array([text_features(x) for x in text.to_pylist()]).reshape(-1, len(TEXT_FEATURES))
    m = [
        [float("nan") if n is None or n < 0 else math.log1p(n), _bucket(s), _bucket(g)]
        for s, g, n in zip(source.to_pylist(), lang.to_pylist(), n_chars.to_pylist(), strict=True)
    ]
    return t, np.array(m, float).reshape(-1, 3)


def _inputs(docs: DataFrame, columns: dict[str, str]) -> list[Column]:
    return [F.col(columns[k]).cast("double" if k == "n_chars" else "string") for k in ("text", "source", "lang", "n_chars")]


COLUMNS = {"id": "doc_id", "text": "text", "source": "source", "lang": "lang", "n_chars": "n_chars"}


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", columns: dict[str, str] = COLUMNS) -> Model:
    """The model from docs and labels(id, label 1 good or 0 bad).

    Labelled and pool documents are the first by a hash of the id, MOST_LABELLED
    and MOST_POOL at most; their features (20 numbers each) go to the driver.
    Null labels and ids are no labels; of labels that disagree the lower counts,
    and of rows that repeat an id one.
    """
    small_batches(docs.sparkSession)
    id = columns["id"]
    known = labels.select(F.col(id).alias("__id"), F.col(label).cast("int").alias("__label")).filter("__id is not null and __label in (0, 1)")
    known = known.groupBy("__id").agg(F.min("__label").alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(MOST_LABELLED)
    rest = docs.select(F.col(id).alias("__id")).filter("__id is not null").orderBy(F.xxhash64("__id", F.lit("pool")), "__id").limit(MOST_POOL)
    chosen = known.unionByName(rest.withColumn("__label", F.lit(None).cast("int"))).groupBy("__id").agg(F.max("__label").alias("__label"))

    @F.arrow_udf("struct<t: array<double>, m: array<double>>")
    def seen(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for b in batches:
            t, m = _features(*b)
            yield pa.array([{"t": x.tolist(), "m": y.tolist()} for x, y in zip(t, m, strict=True)], pa.struct({"t": pa.list_(pa.float64()), "m": pa.list_(pa.float64())}))

    rows = (
        docs.join(F.broadcast(chosen), F.col(id) == F.col("__id"))  # MOST_LABELLED + MOST_POOL narrow rows at most
        .dropDuplicates(["__id"])  # the bound is on rows, too
        .select("__id", "__label", seen(*_inputs(docs, columns)).alias("x")).select("__id", "__label", "x.t", "x.m").collect()
    )
    rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[2]))
    part = lambda want: [r for r in rows if (r[1] is not None) == want]
    matrix = lambda of, k, width: np.array([r[k] for r in of], float).reshape(-1, width)
    known_rows, pool_rows = part(True), part(False)
    y = np.array([float(r[1]) for r in known_rows])
    width = len(TEXT_FEATURES)
    return co_train(matrix(known_rows, 2, width), matrix(known_rows, 3, 3), y, matrix(pool_rows, 2, width), matrix(pool_rows, 3, 3))


def score(docs: DataFrame, model: Model, columns: dict[str, str] = COLUMNS) -> DataFrame:
    """docs with `quality_scores` (text_score, meta_score, score, kept), for every row and whole texts.

    Null or empty texts and null metadata have bins of their own.  Nothing is
    shuffled; rows may repeat; an empty table stays empty; other columns pass
    through (one named quality_scores is replaced).
    """
    kinds = pa.struct({"text_score": pa.float64(), "meta_score": pa.float64(), "score": pa.float64(), "kept": pa.bool_()})

    @F.arrow_udf("struct<text_score: double, meta_score: double, score: double, kept: boolean>")
    def scored(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for b in batches:
            t, m, s = model.scores(*_features(*b))
            yield pa.StructArray.from_arrays([pa.array(t), pa.array(m), pa.array(s), pa.array(s >= model.threshold)], fields=list(kinds))

    return docs.withColumn("quality_scores", scored(*_inputs(docs, columns)))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", columns: dict[str, str] = COLUMNS) -> DataFrame:
    """fit() and score() in one; see there for nulls, repeats and bounds."""
    return score(docs, fit(docs, labels, label, columns), columns)


