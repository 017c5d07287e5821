"""Joining and re-ranking the results of several scorers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_K, SPS_ALPHA = 60, 0.6


def rrf(heads: dict[str, DataFrame], unit: str, k: int, constant: int = RRF_K) -> DataFrame:
    """(unit, score, channels, rank): reciprocal rank fusion of (unit, score) tables, channels in the order of ``heads``."""
    ranked = []
    for no, (name, hits) in enumerate(heads.items()):
        order = Window.orderBy(F.desc("score"), unit)
        ranked.append(hits.select(unit, F.lit(no).alias("no"), F.lit(name).alias("head"), F.row_number().over(order).alias("r")))
    union = reduce(DataFrame.unionByName, ranked)
    fused = union.groupBy(unit).agg(
        F.round(F.sum(1.0 / (F.lit(constant) + F.col("r"))), 6).alias("score"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "head"))), lambda x: x["head"]), ",").alias("channels"),
    )
    return fused.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), unit)).cast("long")).where(F.col("rank") <= k)


def sps(bm25: DataFrame, cosine: DataFrame, unit: str, k: int) -> DataFrame:
    """(unit, score, rank): BM25 over its maximum and cosine, weighed; the best 3k of each take part."""
    best = lambda df: df.withColumn("__r", F.row_number().over(Window.orderBy(F.desc("score"), unit))).where(F.col("__r") <= 3 * k).drop("__r")
    b, c = best(bm25).select(unit, F.col("score").alias("b")), best(cosine).select(unit, F.col("score").alias("c"))
    top = b.agg(F.max("b").alias("m"))  # one row
    both = b.join(c, unit, "full").join(F.broadcast(top)).select(unit, F.round(F.lit(SPS_ALPHA) * F.when(F.col("m") > 0, F.coalesce("b", F.lit(0.0)) / F.col("m")).otherwise(0.0) + F.lit(1 - SPS_ALPHA) * F.coalesce("c", F.lit(0.0)), 6).alias("score"))
    return both.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), unit)).cast("long")).where(F.col("rank") <= k)


def adaptive(fused: DataFrame, top_k: int, pool: int, budget: str = "auto") -> DataFrame:
    """Keep ``pool`` of the ranked hits, or three times as many if the best do not stand out.

    They do not if the first and the fifth are less than 0.15 apart or there are fewer than ``top_k``.
    """
    facts = fused.agg(F.count("*").alias("hits"), (F.max(F.when(F.col("rank") == 1, F.col("score"))) - F.coalesce(F.max(F.when(F.col("rank") == 5, F.col("score"))), F.lit(0.0))).alias("spread"))
    wide = F.lit(budget == "thorough") | ((F.col("spread") < 0.15) | (F.col("hits") < top_k)) & F.lit(budget != "fast")
    return fused.join(F.broadcast(facts.select(wide.alias("widened")))).where(F.col("rank") <= F.when(F.col("widened"), 3 * pool).otherwise(pool))
