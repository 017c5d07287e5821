"""Records: what a source's payload becomes before it is cut in windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a request may ask for.
LIMITS = {"top_k": 50, "raw_sources": 20, "connectors": 3, "raw_bytes": 1 << 20}
MEDIA = {"markdown": "text/markdown", "html": "text/html", "json": "application/json", "csv": "text/csv", "pdf": "application/pdf", "plaintext": "text/plain"}


def merged(first: Column, last: Column, defaults: Column) -> Column:
    """One map: ``last`` wins over ``first``; ``defaults`` only for keys that neither has."""
    missing = lambda a, b: F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
    both = F.map_concat(missing(first, last), last)
    return F.map_concat(both, missing(defaults, both))


def placed(df: DataFrame, text: str = "text") -> DataFrame:
    """Add source_start and source_end: the first of source, char and byte places that is there; the end is not before the start."""
    have = lambda side: [F.col(c) for c in (f"source_{side}", f"char_{side}", f"byte_{side}") if c in df.columns]
    start = F.coalesce(*have("start"), F.lit(0)).cast("long")
    end = F.greatest(start, F.coalesce(*have("end"), start + F.length(text)).cast("long"))
    return df.withColumns({"source_start": start, "source_end": end})


def records(docs: DataFrame) -> DataFrame:
    """A record for each parsed document (source_id, ordinal, text, metadata, parsed_metadata, parser, ...) that has text."""
    defaults = F.create_map(F.lit("parser"), F.col("parser"), F.lit("media_type"), F.try_element_at(F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv]), "parser"))
    kept = placed(docs.where(F.length(F.trim("text")) > 0))
    return kept.withColumn("metadata", merged(F.col("metadata"), F.col("parsed_metadata"), F.map_filter(defaults, lambda k, v: v.isNotNull()))).withColumn("record_id", F.concat_ws(":", "source_id", F.lit("record"), F.col("ordinal").cast("string"))).drop("parsed_metadata")


def raw_sources(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of raw sources (id, name, content, media_type): empty contents are errors, not documents."""
    named = rows.withColumn("source_id", F.concat_ws(":", F.lit("raw"), F.col("id").cast("string"), "name"))
    empty = F.length(F.trim(F.coalesce("content", F.lit("")))) == 0
    is_json = F.col("content").rlike(r"^\s*[\[{]") & F.try_parse_json("content").isNotNull()
    media = F.coalesce("media_type", F.when(is_json, MEDIA["json"]).otherwise(MEDIA["plaintext"]))
    docs = named.where(~empty).withColumns({"media_type": media, "source_origin": F.lit("raw")})
    return docs, named.where(empty).select("source_id", F.lit("raw").alias("source_origin"), F.lit("the source is empty").alias("error"))


def marked(docs: DataFrame, connector: str) -> DataFrame:
    """Documents of a connector with where they come from; what they say themselves stays."""
    have = lambda c, default: F.coalesce(F.col(c), default) if c in docs.columns else default
    return docs.withColumns({
        "source_id": have("source_id", F.concat_ws(":", F.lit(f"connector:{connector}"), F.col("nth").cast("string"), "name")),
        "source_origin": have("source_origin", F.lit("connector")),
        "source_type": have("source_type", F.lit(connector)),
    })


def webhook_documents(configs: DataFrame) -> DataFrame:
    """(connector_id, nth, name, content) of the documents in each configuration (connector_id, config); blank ones are left out."""
    shape = "struct<documents: array<struct<name: string, content: string>>>"
    listed = configs.select("connector_id", F.posexplode(F.from_json("config", shape)["documents"]).alias("nth", "x"))
    return listed.where(F.length(F.trim("x.content")) > 0).select("connector_id", F.col("nth").cast("long").alias("nth"), F.coalesce("x.name", F.lit("webhook")).alias("name"), F.col("x.content").alias("content"))


def limit_errors(asked: dict[str, Column]) -> Column:
    """The first limit of a request that is passed, as a text; null if none is."""
    found = F.lit(None).cast("string")
    for name in reversed(list(asked)):
        found = F.when(asked[name] > LIMITS[name], f"{name} is over {LIMITS[name]}").otherwise(found)
    return found


def check_limits(**asked: int) -> None:
    for name, value in asked.items():
        if value > LIMITS[name]:
            raise ValueError(f"{name} is over {LIMITS[name]}")


def generated_lines(spark, n: int, target_at: int, target: str) -> DataFrame:
    """(line_no, text): ``n`` lines of noise, one of them the target."""
    return spark.range(1, n + 1).select(F.col("id").alias("line_no"), F.when(F.col("id") == target_at, target).otherwise(F.format_string("noise line %04d without meaning", "id")).alias("text"))
