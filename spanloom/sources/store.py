"""Sources, their documents and corpora as Parquet tables, with listing, expiry and deletion.

A change writes a new version of a table beside the old one and then moves the
pointer, a file with the version's name, so readers see one version or the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources import parsers

SOURCES = "source_id string, corpus_id string, name string, parser string, bytes long, windows long, created_at timestamp"
DOCUMENTS = "source_id string, order_index long, text string"
CORPORA = "corpus_id string, name string, status string, created_at timestamp, ttl_seconds long"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.shapes = {"sources": SOURCES, "documents": DOCUMENTS, "corpora": CORPORA}

    # ---- versions

    def _pointer(self, table: str) -> str:
        return f"{self.path}/{table}/current"

    def _version(self, table: str) -> str | None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self._pointer(table))
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return None
        return self.spark.read.text(self._pointer(table)).first()[0]

    def table(self, name: str) -> DataFrame:
        version = self._version(name)
        return self.spark.read.schema(self.shapes[name]).parquet(f"{self.path}/{name}/{version}") if version else self.spark.createDataFrame([], self.shapes[name])

    def replace(self, name: str, rows: DataFrame) -> None:
        version = uuid.uuid4().hex
        wanted = self.spark.createDataFrame([], self.shapes[name]).schema
        rows.select([F.col(f.name).cast(f.dataType) for f in wanted]).write.parquet(f"{self.path}/{name}/{version}")
        self.spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(self._pointer(name))

    # ---- corpora

    def create_corpus(self, corpus_id: str, name: str, created_at, ttl_seconds: int | None = None) -> None:
        one = self.spark.createDataFrame([(corpus_id, name, "active", created_at, ttl_seconds)], CORPORA)
        self.replace("corpora", self.table("corpora").where(F.col("corpus_id") != corpus_id).unionByName(one))

    def corpora(self, now) -> DataFrame:
        """Corpora, the latest first, with what they hold; one whose time is over is expired."""
        over = F.col("created_at") + F.make_dt_interval(secs=F.col("ttl_seconds")) <= F.lit(now)
        held = self.table("sources").groupBy("corpus_id").agg(F.count("*").alias("n_sources"), F.sum("bytes").alias("bytes"), F.sum("windows").alias("windows"))
        status = F.when(F.coalesce(over, F.lit(False)), "expired").otherwise(F.col("status"))
        out = self.table("corpora").withColumn("status", status).join(held, "corpus_id", "left")
        return out.fillna(0, ["n_sources", "bytes", "windows"]).orderBy(F.desc("created_at"), "corpus_id")

    def delete_corpus(self, corpus_id: str) -> None:
        """The corpus, its sources and their documents go."""
        sources = self.table("sources").where(F.col("corpus_id") == corpus_id).select("source_id")
        self.delete_sources([r.source_id for r in sources.collect()])  # a corpus's sources are listed to its owner
        self.replace("corpora", self.table("corpora").where(F.col("corpus_id") != corpus_id))

    # ---- sources

    def ingest(self, docs: DataFrame, created_at, corpus_id: str | None = None) -> DataFrame:
        """Parse (source_id, name, media_type, content), write sources and their ordered documents; returns the error rows."""
        parsed = parsers.parse_documents(docs)
        good = parsed.where("error is null")
        windows = F.size(F.filter(F.split("text", r"\r\n|\n|\r"), lambda x: x.rlike(r"\S")))
        per = F.when(F.col("parser") == "plaintext", F.greatest(F.lit(1), windows)).otherwise(1)
        sums = good.groupBy("source_id").agg(F.sum(per).alias("windows"), F.first("parser").alias("parser"))
        sources = docs.join(sums, "source_id").select("source_id", F.lit(corpus_id).alias("corpus_id"), "name", "parser", F.octet_length("content").alias("bytes"), "windows", F.lit(created_at).alias("created_at"))
        self.replace("sources", self.table("sources").join(docs.select("source_id"), "source_id", "left_anti").unionByName(sources.withColumn("created_at", F.col("created_at").cast("timestamp")), allowMissingColumns=True))
        documents = good.select("source_id", F.col("ordinal").alias("order_index"), "text")
        self.replace("documents", self.table("documents").join(docs.select("source_id"), "source_id", "left_anti").unionByName(documents))
        return parsed.where("error is not null").select("source_id", "error")

    def list_sources(self, now, corpus_id: str | None = None) -> DataFrame:
        """Sources whose corpus is active or that have none, the latest first."""
        live = self.corpora(now).where("status = 'active'").select("corpus_id")
        rows = self.table("sources").join(live.withColumn("live", F.lit(True)), "corpus_id", "left").where("corpus_id is null or live").drop("live")
        return (rows.where(F.col("corpus_id") == corpus_id) if corpus_id else rows).orderBy(F.desc("created_at"), "source_id")

    def delete_sources(self, ids: list[str]) -> None:
        for name in ("documents", "sources"):
            self.replace(name, self.table(name).where(~F.col("source_id").isin(ids)) if ids else self.table(name))

    def documents(self, now, corpus_id: str | None = None) -> DataFrame:
        """The documents of the listed sources, in order."""
        return self.list_sources(now, corpus_id).select("source_id", "corpus_id", "name").join(self.table("documents"), "source_id").orderBy("source_id", "order_index")
