"""Connected components of a link table, with no group or table gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected_components(links: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Return (node, component): the smallest node that each linked node reaches.

    Each round a node points to the smallest among itself and its neighbours, pointers
    are followed to their ends by doubling, and the links between different ends are
    the links of the next round, so that a large group's many links are read once and not
    in every round.  Every round is written to the shared folder, which cuts the
    lineage.  Self links and repeated links do no harm; links with a null end are left
    out; an empty table gives an empty result.
    """
    spark = links.sparkSession
    kind = links.schema[src].dataType
    edges = links.select(F.col(src).alias("a"), F.col(dst).cast(kind).alias("b")).where("a is not null and b is not null")
    edges = common.materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    out = None
    while True:
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("up")))
        above = common.materialize(ends.groupBy("node").agg(F.min("up").alias("up")), "labels")
        while True:
            over = above.select(F.col("node").alias("up"), F.col("up").alias("top"))
            after = common.materialize(above.join(over, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "labels")
            common.discard(spark, above)
            above = after.drop("moved")
            above._scratch_path = after._scratch_path
            if after.where("moved").limit(1).count() == 0:
                break
        if out is None:
            out = above.withColumnRenamed("up", "component")
            out._scratch_path = above._scratch_path
        else:
            tops = above.select(F.col("node").alias("component"), F.col("up").alias("top"))
            joined = common.materialize(out.join(tops, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "labels")
            common.discard(spark, out)
            out = joined
        of_a, of_b = (above.select(F.col("node").alias(c), F.col("up").alias(f"top_{c}")) for c in ("a", "b"))
        between = edges.where("a <> b").join(of_a, "a").join(of_b, "b").where("top_a <> top_b")
        after = common.materialize(between.select(F.greatest("top_a", "top_b").alias("a"), F.least("top_a", "top_b").alias("b")).distinct(), "links")
        common.discard(spark, edges, *([above] if above._scratch_path != out._scratch_path else []))
        edges = after
        if edges.limit(1).count() == 0:
            common.discard(spark, edges)
            return out
