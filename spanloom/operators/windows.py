"""Lines, windows, chunks: units of text with exact code-point offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Line separators: CRLF, LF, CR, and the other characters that end a line in Unicode.
SEPARATOR = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, source, pos, text, start): every line with its offset; rows keep no separator."""
    parts = docs.select("doc_id", "source", F.split("text", SEPARATOR).alias("__lines"), F.regexp_extract_all("text", F.lit(SEPARATOR), F.lit(0)).alias("__ends"))
    flat = parts.select("doc_id", "source", F.posexplode(F.arrays_zip("__lines", "__ends")).alias("pos", "__x")).select("doc_id", "source", "pos", F.col("__x.__lines").alias("text"), F.coalesce(F.length("__x.__ends"), F.lit(0)).alias("__sep"))
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return flat.withColumn("start", F.coalesce(F.sum(F.length("text") + F.col("__sep")).over(before), F.lit(0)).cast("long")).drop("__sep")


def line_windows(docs: DataFrame) -> DataFrame:
    """One window per line that is not blank.

    ``n`` counts the non-empty lines from 1, ``line_no`` the physical ones.
    """
    full = lines(docs).where(F.length("text") > 0)
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return full.withColumn("n", n.cast("long")).where(F.col("text").rlike(r"\S")).select(
        F.concat(F.lit("source:"), F.col("doc_id").cast("string"), F.lit(":record:0:window:"), F.col("n").cast("string")).alias("window_id"),
        "doc_id", "source", "text", "n", (F.col("pos") + 1).cast("long").alias("line_no"), "start", (F.col("start") + F.length("text")).cast("long").alias("end"),
    )


def windows_unplaced(docs: DataFrame) -> DataFrame:
    """The windows without offsets: no shuffle."""
    parts = F.filter(F.split("text", SEPARATOR), lambda x: F.length(x) > 0)
    flat = docs.select("doc_id", "source", F.posexplode(parts).alias("pos", "text")).where(F.col("text").rlike(r"\S"))
    return flat.select(
        F.concat(F.lit("source:"), F.col("doc_id").cast("string"), F.lit(":record:0:window:"), (F.col("pos") + 1).cast("string")).alias("window_id"),
        "doc_id", "source", "text", (F.col("pos") + 1).cast("long").alias("n"),
    )


def with_neighbors(windows: DataFrame, source: str = "doc_id") -> DataFrame:
    """Add the ids of the windows before and after in the same source."""
    order = Window.partitionBy(source).orderBy("start", "end", "window_id")
    return windows.withColumns({"prev_id": F.lag("window_id").over(order), "next_id": F.lead("window_id").over(order)})


#: Rows whose chunks are held at once.
ROWS = 512
# Fixed value: a word ends at ASCII white space.
WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


def token_chunks(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Chunks of ``size`` words that overlap; the text is the slice of the original. Cut inside each row."""
    step = size - overlap if overlap < size else max(1, size // 2)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                row, chunk, content, count, start, end = [], [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    words = [m.start() for m in WORD.finditer(text or "")]
                    for k, first in enumerate(range(0, len(words), step)):
                        if k and first - step + size >= len(words):
                            break
                        last = min(first + size, len(words))
                        begin, until = words[first], WORD.match(text, words[last - 1]).end()
                        row.append(i), chunk.append(k), content.append(text[begin:until]), count.append(last - first), start.append(begin), end.append(until)
                numbers = [pa.array(x, pa.int64()) for x in (chunk, count, start, end)]
                ids = part.column(0).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, numbers[0], pa.array(content, pa.string()), *numbers[1:]], ["doc_id", "chunk", "content", "token_count", "start", "end"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, chunk long, content string, token_count long, start long, end long")
    return placed.select(F.concat(F.col("doc_id").cast("string"), F.lit(":0:0:"), F.col("chunk").cast("string")).alias("chunk_id"), "doc_id", "chunk", "content", "token_count", "start", "end")


def chunk_neighbors(chunks: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("chunk")
    return chunks.withColumns({"prev_id": F.lag("chunk_id").over(order), "next_id": F.lead("chunk_id").over(order)})


def merge_spans(spans: DataFrame, key: str) -> DataFrame:
    """(key, start, end): overlapping or touching spans become one."""
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("__new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    grouped = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(key, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")
