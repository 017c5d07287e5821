"""Structured Streaming: search over arriving text, ingest totals, request quotas."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import scoring

WINDOW_SECONDS = 60


def scored_lines(stream: DataFrame, query: str, key: str = "stream_id", text: str = "text") -> DataFrame:
    """Lines of arriving texts with an exact score for the query; stateless, so it starts with the first batch."""
    lines = stream.withColumn(text, F.explode(F.split(text, r"\r\n|\n|\r"))).where(F.col(text).rlike(r"\S"))
    return lines.withColumn("score", scoring.exact_score(F.col(text), query)).where("score > 0")


def progress(stream: DataFrame, key: str = "stream_id", text: str = "text") -> DataFrame:
    """Bytes and windows taken in so far, by stream."""
    windows = F.size(F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: x.rlike(r"\S")))
    return stream.groupBy(key).agg(F.sum(F.octet_length(text)).alias("bytes"), F.sum(windows).alias("windows"))


def first_hits(stream: DataFrame, query: str, at: str, key: str = "stream_id", text: str = "text") -> DataFrame:
    """When each stream first had a line that the query hits."""
    return scored_lines(stream, query, key, text).groupBy(key).agg(F.min(at).alias("first_hit"))


def search_batches(stream: DataFrame, search: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a search plan on every micro-batch and hand its results to ``sink``."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, epoch: sink(search(batch), epoch)).start()


def admit(times: list[float], costs: list[float], held: list[tuple[float, float]], limit: float, requests: int) -> tuple[list[bool], list[tuple[float, float]]]:
    """Which requests a quota over the last WINDOW_SECONDS, both ends included, admits; refused ones do not count."""
    out = []
    used = sum(c for _, c in held)
    held = list(held)
    for t, c in zip(times, costs):
        while held and held[0][0] < t - WINDOW_SECONDS:
            used -= held.pop(0)[1]
        ok = used + c <= limit and len(held) + 1 <= requests
        if ok:
            held.append((t, c))
            used += c
        out.append(ok)
    return out, held


def quota(stream: DataFrame, limit: float, requests: int) -> DataFrame:
    """(key, request_id, admitted) of a stream (key, request_id, ts double, cost); state: what was admitted lately, by key.

    The state of a key is bounded by ``requests``; a key's requests of one batch are
    taken in order of time.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "request_id"])
        held = list(zip(*state.get)) if state.exists else []
        ok, held = admit(rows.ts.tolist(), rows.cost.tolist(), held, limit, requests)
        state.update(([t for t, _ in held], [c for _, c in held]))
        yield pd.DataFrame({"key": key[0], "request_id": rows.request_id, "admitted": ok})

    return stream.groupBy("key").applyInPandasWithState(step, "key string, request_id long, admitted boolean", "times array<double>, costs array<double>", "append", "NoTimeout")
