"""Sets of documents and judgements: scripted changes, evaluation cases, projections on disk, result events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def mutate(docs: DataFrame, steps: list[dict]) -> DataFrame:
    """(doc_id, place, text) after the steps of a script, one after the other.

    A step has ``op``: ``add`` (doc_id, text, at the end), ``delete`` (doc_id), ``change`` (doc_id,
    text) or ``reorder`` (order: the doc_ids that come first).  Unknown steps, and changes of what is not there, are errors.
    """
    spark = docs.sparkSession
    for step in steps:
        op, doc = step["op"], F.lit(step.get("doc_id"))
        if op == "add":
            place = docs.agg(F.coalesce(F.max("place") + 1, F.lit(0)).alias("place"))  # one row
            docs = docs.unionByName(place.select(doc.alias("doc_id"), "place", F.lit(step["text"]).alias("text")))
        elif op == "delete":
            docs = docs.where(F.col("doc_id") != doc)
        elif op == "change":
            docs = docs.withColumn("text", F.when(F.col("doc_id") == doc, step["text"]).otherwise(F.col("text")))
        elif op == "reorder":
            first = spark.createDataFrame(list(enumerate(step["order"])), "first long, doc_id string")
            order = Window.orderBy(F.col("first").asc_nulls_last(), "place", "doc_id")  # a scripted set is small
            docs = docs.join(first, "doc_id", "left").withColumn("place", F.row_number().over(order).cast("long") - 1).select("doc_id", "place", "text")
        else:
            raise ValueError(f"a step is add, delete, change or reorder, not {op}")
    return docs


def load_cases(spark: SparkSession, path: str, profile: str | None = None) -> DataFrame:
    """(case_id, query, profiles, documents, expected) of the cases in JSON files under ``path``; a case without id or query is an error."""
    document = "struct<name: string, content: string>"
    shape = f"cases array<struct<case_id: string, query: string, profiles: array<string>, documents: array<{document}>, expected: array<struct<source: string, text: string>>>>"
    rows = spark.read.schema(shape).json(path, multiLine=True).select(F.inline("cases"))
    complete = F.col("case_id").isNotNull() & (F.length(F.trim(F.coalesce("query", F.lit("")))) > 0)
    checked = rows.withColumn("case_id", F.when(complete, F.col("case_id")).otherwise(F.raise_error(F.lit("a case needs case_id and query"))))
    return checked.where(F.array_contains("profiles", profile)) if profile else checked


def save_projection(weights: DataFrame, path: str) -> None:
    """(feature, dim, v) as a table, in the order of the features."""
    weights.select(F.col("feature").cast("long").alias("feature"), F.col("dim").cast("long").alias("dim"), F.col("v").cast("double").alias("v")).sortWithinPartitions("feature", "dim").write.mode("overwrite").parquet(path)


def project(features: DataFrame, weights: DataFrame, unit: str) -> DataFrame:
    """(unit, dim, x): (unit, feature, w) times (feature, dim, v), normalised; a unit without any known feature has no rows."""
    sums = features.join(weights, "feature").groupBy(unit, "dim").agg(F.sum(F.col("w") * F.col("v")).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(unit)))
    return sums.withColumn("x", F.when(norm > 0, F.col("x") / norm).otherwise(0.0))


def events(results: DataFrame, payload: Column) -> DataFrame:
    """(phase, nth, data) of results with phase and rank: exact ones first, then by proxy, then how many there were."""
    rows = results.select(F.concat("phase", F.lit("_results")).alias("phase"), F.col("rank").cast("long").alias("nth"), F.to_json(payload).alias("data"))
    done = results.agg(F.lit("done").alias("phase"), F.lit(0).cast("long").alias("nth"), F.to_json(F.struct(F.count("*").alias("results"))).alias("data"))
    return rows.unionByName(done)
