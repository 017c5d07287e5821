"""Relevance spread over a graph of neighbouring units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_EDGES, STEPS = 8, 3


def sequence_edges(units: DataFrame, group: str, position: str, node: str, reach: int = 1) -> DataFrame:
    """(src, dst, w): units at most ``reach`` apart in their group, by shifted equi-joins instead of a self join of the group."""
    left = units.select(F.col(node).alias("src"), F.col(group).alias("g"), F.explode(F.array(*[F.struct((F.col(position) + d).alias("p"), F.lit(1.0 / abs(d)).alias("w")) for d in range(-reach, reach + 1) if d])).alias("x")).select("src", "g", "x.p", "x.w")
    right = units.select(F.col(node).alias("dst"), F.col(group).alias("g"), F.col(position).alias("p"))
    return left.join(right, ["g", "p"]).where("src <> dst").groupBy("src", "dst").agg(F.max("w").alias("w"))


#: Weights of the rules by which units of a source are neighbours.
RULES = {"chunk": 1.0, "row": 0.8, "page": 0.6, "section": 0.5, "explicit": 1.0}


def rule_edges(units: DataFrame, node: str = "node", source: str = "source") -> DataFrame:
    """(src, dst, w) of units with any of the columns chunk, row, page, section and explicit (an array of nodes).

    Successive chunks and rows, units of one page or section, and those named are
    neighbours; the heaviest rule counts.  As a node keeps MOST_EDGES edges, each
    needs only the first MOST_EDGES + 1 nodes of its page and section, so groups are not
    joined with themselves.
    """
    parts = []
    for rule in ("chunk", "row"):
        if rule in units.columns:
            steps = sequence_edges(units.where(F.col(rule).isNotNull()), source, rule, node)
            parts.append(steps.select("src", "dst", F.lit(RULES[rule]).alias("w")))
    for rule in ("page", "section"):
        if rule in units.columns:
            held = units.where(F.col(rule).isNotNull()).select(F.col(source).alias("g"), F.col(rule).alias("p"), F.col(node).alias("n"))
            nth = F.row_number().over(Window.partitionBy("g", "p").orderBy("n"))
            first = held.withColumn("nth", nth).where(F.col("nth") <= MOST_EDGES + 1).select("g", "p", F.col("n").alias("dst"))
            parts.append(held.withColumnRenamed("n", "src").join(first, ["g", "p"]).where("src <> dst").select("src", "dst", F.lit(RULES[rule]).alias("w")))
    if "explicit" in units.columns:
        named = units.select(F.col(node).alias("src"), F.col(source).alias("g"), F.explode("explicit").alias("dst"))
        known = units.select(F.col(source).alias("g"), F.col(node).alias("dst"))
        parts.append(named.join(known, ["g", "dst"], "left_semi").where("src <> dst").select("src", "dst", F.lit(RULES["explicit"]).alias("w")))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy("src", "dst").agg(F.max("w").alias("w"))


def normalized(edges: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """The heaviest edges of each node, weights summing to one."""
    kept = edges.withColumn("__r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))).where(F.col("__r") <= most).drop("__r")
    return kept.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("src")))


def diffuse(nodes: DataFrame, edges: DataFrame, steps: int = STEPS) -> DataFrame:
    """(node, l, s, c): c = clip(tanh(0.5 A c + 0.3 l + 0.2 s), -5, 5), from c = 0."""
    clip = lambda x: F.greatest(F.lit(-5.0), F.least(F.lit(5.0), F.tanh(x)))
    state = nodes.withColumn("c", clip(0.3 * F.col("l") + 0.2 * F.col("s")))  # nothing flows in the first step
    for _ in range(steps - 1):
        inflow = edges.join(state.select(F.col("node").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("w") * F.col("c")).alias("inflow"))
        state = nodes.join(inflow, "node", "left").withColumn("c", clip(0.5 * F.coalesce("inflow", F.lit(0.0)) + 0.3 * F.col("l") + 0.2 * F.col("s"))).drop("inflow")
    return state


def gate(state: DataFrame, cost: str, k: int) -> DataFrame:
    """The ``k`` best of 0.35 l + 0.35 s + 0.20 c - 0.10 cost; the cost is over its maximum."""
    top = state.agg(F.max(cost).alias("m"))  # one row
    r = 0.35 * F.col("l") + 0.35 * F.col("s") + 0.20 * F.col("c") - 0.10 * F.when(F.col("m") > 0, F.col(cost) / F.col("m")).otherwise(0.0)
    scored = state.join(F.broadcast(top)).withColumn("score", F.round(r, 6))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "node")).cast("long")).where(F.col("rank") <= k)
