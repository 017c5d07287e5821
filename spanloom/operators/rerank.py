"""Re-ranking: a cascade of scorers, each of which may be absent or fail.

A scorer takes (ids, texts, query) and returns a score for each id it knows.  The
cascade calls scorers in order, in Arrow batches, and falls back to the word overlap of
`heuristic_rerank` for what none has scored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.operators import scoring

BATCH, MOST = 32, 200
Scorer = Callable[[list[str], list[str], str], dict[str, float]]


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-x)) if x >= 0 else math.exp(x) / (1.0 + math.exp(x))


def cross_encoder(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> Scorer:
    """A scorer over (query, text) pairs; ``load`` gives the model, once for each worker."""
    held: list = []

    def score(ids: list[str], texts: list[str], query: str) -> dict[str, float]:
        if not held:
            held.append(load())
        out: dict[str, float] = {}
        for at in range(0, len(ids), BATCH):
            found = held[0]([(query, t) for t in texts[at : at + BATCH]])
            out |= {i: sigmoid(x) for i, x in zip(ids[at : at + BATCH], found)}
        return out

    return score


def cascade(hits: DataFrame, query: str, top_k: int, scorers: tuple[Scorer, ...] = (), unit: str = "window_id") -> DataFrame:
    """(unit, score, reranked, by, rank) of (unit, score, text): at most MOST of the best are scored; ``by`` is the scorer's place, -1 for word overlap."""
    best = hits.withColumn("__r", F.row_number().over(Window.orderBy(F.desc("score"), unit))).where(F.col("__r") <= MOST).drop("__r")
    plain = best.select(unit, "score", "text", scoring.heuristic_rerank(F.col("score"), F.col("text"), query).alias("plain"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            left, found = rows, {}
            for no, scorer in enumerate(scorers):
                try:
                    got = scorer(left[unit].tolist(), left.text.tolist(), query)
                except Exception:  # any failure of a model or a service means the next scorer
                    continue
                found |= {i: (x, no) for i, x in got.items()}
                left = left[~left[unit].isin(list(found))]
                if not len(left):
                    break
            picked = [found.get(i, (p, -1)) for i, p in zip(rows[unit], rows.plain)]
            yield pd.DataFrame({unit: rows[unit], "score": rows.score, "reranked": [float(x) for x, _ in picked], "by": [n for _, n in picked]})

    kind = hits.schema[unit].dataType.simpleString()
    scored = plain.mapInPandas(run, f"{unit} {kind}, score double, reranked double, by int") if scorers else plain.select(unit, "score", F.col("plain").alias("reranked"), F.lit(-1).alias("by"))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("reranked"), unit)).cast("long")).where(F.col("rank") <= top_k)
