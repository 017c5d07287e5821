"""Toxicity by a chain of linear classifiers.

The categories are label columns in a fixed order; the model of each category gets
the text's features and the probabilities that the chain gave the earlier
categories.  In training these are out-of-fold predictions, so that a later model
sees earlier probabilities as uncertain as it will see them on new texts.

Features of a text are the presence of words and of word beginnings of 4, 5 and 6
letters (lower case), chosen per category by the G statistic.  Presence, not
frequency, so that a few words are found in a very long text too.

The models are fitted on at most ``max_rows`` labelled rows (those whose doc_id
hashes lowest); everything else covers all documents and whole texts.

Defined cases: a null or empty text has no features and gets the intercepts' probability; labels that are null
leave their row out of training; with no labelled rows, or one class only, the
category's probability is its share of positives (0 without rows); repeated rows
are scored one by one; extra columns are ignored by `score`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_ROWS, FOLDS, MAX_FEATURES, LEAST_DOCS = 6_000, 5, 3_000, 4
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    out = {w[:n] + "*" for w in words if len(w) > 3 for n in (4, 5, 6) if len(w) >= n}
    return out | words


@dataclass
class Linear:
    """A logistic model over named features and ``extra`` further inputs."""

    names: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    extra: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -30.0

    def __post_init__(self):
        self.by_name = dict(zip(self.names, self.weights.tolist()))


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(rows: np.ndarray, cols: np.ndarray, names: list[str], extra: np.ndarray, y: np.ndarray, steps: int = 300, l2: float = 0.02) -> Linear:
    """Logistic regression on the features that the G statistic ranks highest.

    ``rows`` and ``cols`` list which feature (by place in ``names``) which row has.
    """
    n = len(y)
    positives = float(y.sum())
    k = extra.shape[1]
    if not n or positives in (0.0, float(n)):
        share = positives / n if n else 0.0
        return Linear(extra=np.zeros(k), bias=float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -30, 30)))
    has = np.bincount(cols, minlength=len(names)).astype(float)
    has_pos = np.bincount(cols, weights=y[rows], minlength=len(names))
    expected = has * positives / n
    with np.errstate(divide="ignore", invalid="ignore"):
        g = np.nan_to_num(has_pos * np.log(has_pos / expected)) + np.nan_to_num((has - has_pos) * np.log((has - has_pos) / (has - expected)))
    g[has < LEAST_DOCS] = 0
    chosen = np.argsort(-g, kind="stable")[:MAX_FEATURES]
    chosen = np.sort(chosen[g[chosen] > 6.0])
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[cols] >= 0
    r, c = rows[keep], place[cols[keep]]
    w, v, b = np.zeros(len(chosen)), np.zeros(k), np.log(positives / (n - positives))
    moments = [np.zeros(len(chosen) + k + 1) for _ in range(2)]
    for t in range(1, steps + 1):
        p = _sigmoid(np.bincount(r, weights=w[c], minlength=n) + extra @ v + b)
        d = p - y
        grad = np.concatenate([np.bincount(c, weights=d[r], minlength=len(w)) / n + l2 * w / n * 10, extra.T @ d / n + l2 * v / n, [d.mean()]])
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.999 * moments[1] + 0.001 * grad * grad
        step = 0.1 * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.999**t)) + 1e-8)
        w, v, b = w - step[: len(w)], v - step[len(w) : -1], b - step[-1]
    return Linear([names[i] for i in chosen], w, v, float(b))


def predict(model: Linear, rows: np.ndarray, cols: np.ndarray, names: list[str], extra: np.ndarray, n: int) -> np.ndarray:
    weight = np.array([model.by_name.get(x, 0.0) for x in names])
    return _sigmoid(np.bincount(rows, weights=weight[cols], minlength=n) + extra @ model.extra + model.bias)


def fit_chain(sets: list[list[int]], names: list[str], labels: np.ndarray) -> list[Linear]:
    """One model per column of ``labels``; ``sets`` has the features of each row by place in ``names``."""
    n = len(sets)
    rows = np.repeat(np.arange(n), [len(s) for s in sets]) if n else np.zeros(0, np.int64)
    cols = np.concatenate([np.asarray(s, np.int64) for s in sets]) if n else np.zeros(0, np.int64)
    fold = np.arange(n) % FOLDS
    extra = np.zeros((n, 0))
    chain = []
    for j in range(labels.shape[1]):
        y = labels[:, j].astype(float)
        chain.append(fit_linear(rows, cols, names, extra, y))
        if j + 1 < labels.shape[1]:
            held_out = np.zeros(n)
            for f in range(FOLDS):
                train = np.flatnonzero(fold != f)
                to = np.full(n, -1)
                to[train] = np.arange(len(train))
                inside = to[rows] >= 0
                model = fit_linear(to[rows[inside]], cols[inside], names, extra[train], y[train])
                held_out = np.where(fold == f, predict(model, rows, cols, names, extra, n), held_out)
            extra = np.column_stack([extra, held_out])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: list[str], max_rows: int = MAX_ROWS) -> list[Linear]:
    """Fit the chain on at most ``max_rows`` labelled rows."""
    known = labels.where(" and ".join(f"{c} is not null" for c in ["doc_id", *categories])).select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in categories])
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", *categories).limit(max_rows)  # a bounded table
    common.arrow_rows(docs.sparkSession)

    @common.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(features(t)) for t in batch.column(-1 + batch.num_columns).to_pylist()]
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(["\n".join(f) for f in found], pa.string())], [*batch.schema.names[:-1], "features"])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).join(F.broadcast(known), "doc_id").select("doc_id", *categories, "text")
    schema = ", ".join(["doc_id long", *[f"{c} int" for c in categories], "features string"])
    place: dict[str, int] = {}
    sets, y = [], []
    found = joined.mapInArrow(run, schema).orderBy(F.xxhash64("doc_id"), "doc_id", *categories)
    for row in found.toLocalIterator():
        sets.append(np.array([place.setdefault(f, len(place)) for f in row.features.split("\n") if f], np.int32))
        y.append([row[c] for c in categories])
    return fit_chain(sets, list(place), np.array(y).reshape(len(sets), len(categories)))


class Scorer:
    """The chain in the form in which a task applies it."""

    def __init__(self, chain: list[Linear]):
        self.models = [(m.by_name, m.extra.tolist(), m.bias) for m in chain]
        self.known = frozenset().union(*(m.by_name for m in chain)) if chain else frozenset()
        self.begins = frozenset(f[:-1] for f in self.known if f.endswith("*"))

    def __call__(self, text: str) -> list[float]:
        """The probability of each category."""
        words = set(_WORD.findall(text.lower()))
        present = words & self.known
        for n in (4, 5, 6):
            present |= {b + "*" for b in self.begins & {w[:n] for w in words} if len(b) == n}
        present = sorted(present)
        out: list[float] = []
        for by_name, extra, bias in self.models:
            out.append(float(_sigmoid(bias + sum(by_name.get(f, 0.0) for f in present) + sum(a * b for a, b in zip(extra, out)))))
        return out


def score(docs: DataFrame, chain: list[Linear], categories: list[str]) -> DataFrame:
    """(doc_id, p_<category> ...) of every row of ``docs``."""
    common.arrow_rows(docs.sparkSession)
    scorer = Scorer(chain)
    names = ["doc_id", *[f"p_{c}" for c in categories]]

    @common.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [scorer(text) for text in batch.column(1).to_pylist()]
            columns = list(zip(*out)) if out else [[] for _ in categories]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.float64()) for c in columns]], names)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return narrow.mapInArrow(run, ", ".join(["doc_id long", *[f"p_{c} double" for c in categories]]))


CATEGORIES = ["low_quality", "toxic"]


def document_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_low_quality, p_toxic, toxic) of every row of ``docs``."""
    chain = train(docs, document_labels(labels), CATEGORIES)
    return score(docs, chain, CATEGORIES).withColumn("toxic", F.col("p_toxic") >= threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text is not toxic."""
    chain = train(docs, document_labels(labels), CATEGORIES)
    common.arrow_rows(docs.sparkSession)
    scorer = Scorer(chain)

    @F.pandas_udf("double")
    def last(texts):
        return texts.map(lambda t: scorer(t)[-1]).astype("float64")

    return docs.where(last(F.coalesce(F.col("text").cast("string"), F.lit(""))) < threshold)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
