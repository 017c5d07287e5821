"""Sharding by sampled splitters, in DataFrame operations only.

Law ``bytes``: rows are put in one total order and the order is cut where the bytes
pass each shard's part, so shard sizes differ by no more than about one text.  The
order is by the hash of the text and then doc_id, which keeps equal texts together
save where a cut goes through them.

1. A sample of about `SAMPLE` keys is drawn, each row with a chance that grows with
   its size; the quantiles of the sampled bytes are the splitters of `RANGES` ranges.
2. Rows are ranged by binary-like search in the splitters (two levels of small
   literal arrays), and the exact bytes and rows of each range are summed.  A range
   with more than `OVERFULL` times the mean is subdivided by a hash of the row's number, as
   one key, one row many times or a poor splitter may fill it.
3. Running sums inside the (sub)ranges, each a small part of the rows, plus the
   offsets of the ranges give every row its exact place in the order.

Only the sample, the splitters and the sums of the ranges are gathered; their
number is fixed by SAMPLE and RANGES, not by the input.  Texts are never shuffled.

Defined cases: a null text has size 1 and CRC 0; a null doc_id sorts first;
repeated rows take one slot each; an empty table gives no rows; columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SAMPLE, RANGES, OVERFULL = 8_192, 256, 2


def _literal(key) -> Column:
    return F.struct(F.lit(key.k).cast("long").alias("k"), F.lit(key.d).cast("long").alias("d"))


def _splitters(base: DataFrame, total: int) -> list:
    """Rows (k, d) that cut the sampled bytes in RANGES parts, in order."""
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(SAMPLE / total))
    draw = F.pmod(F.xxhash64("k", "d", "u", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = base.where(draw < chance).select("k", "d", F.greatest("size", F.lit(total // SAMPLE)).alias("w"))
    order = Window.orderBy("k", "d")  # over the sample only
    part = F.floor(F.sum("w").over(order) * RANGES / F.sum("w").over(Window.partitionBy()))
    rows = sample.withColumn("part", part).groupBy("part").agg(F.min(F.struct("k", "d")).alias("key")).where("part > 0").select("key.*").orderBy("k", "d").collect()
    return rows


def _range_of(splitters: list) -> Column:
    """How many splitters are at or below (k, d)."""
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    groups = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    key = F.struct("k", "d")
    coarse = F.size(F.filter(F.array(*[_literal(g[0]) for g in groups]), lambda s: s <= key))
    fine = F.element_at(F.array(*[F.array(*map(_literal, g)) for g in groups]), coarse)
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(fine, lambda s: s <= key)))


def shard_rows(rows: DataFrame, shards: int) -> DataFrame:
    """Add shard (0 to shards - 1) and slot (gapless from 0 in each shard) to (k, d, u, size, ...); u is a number of each row."""
    spark = rows.sparkSession
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return rows.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranged = common.materialize(rows.withColumn("range", _range_of(_splitters(rows, total)).cast("int")), "ranged")
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes")).collect()
    mean = total / RANGES
    pieces = {r.range: -(-int(r.bytes) // int(mean + 1)) if r.bytes > OVERFULL * mean else 1 for r in sums}
    overfull = {r: n for r, n in pieces.items() if n > 1}
    sub = F.lit(0)
    if overfull:
        parts = F.element_at(F.create_map(*[F.lit(x) for kv in overfull.items() for x in kv]), F.col("range"))
        sub = F.coalesce(F.pmod(F.xxhash64("u", F.lit(3)), parts), F.lit(0))
    ranged = ranged.withColumn("sub", sub.cast("int"))
    stats = ranged.groupBy("range", "sub").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("range", "sub").collect()
    offsets, at_bytes, at_rows = [], 0, 0
    for r in stats:  # at most twice RANGES and a few
        offsets.append((r.range, r.sub, at_bytes, at_rows))
        at_bytes, at_rows = at_bytes + r.bytes, at_rows + r.n
    offsets = spark.createDataFrame(offsets, "range int, sub int, bytes_before long, rows_before long")
    order = Window.partitionBy("range", "sub").orderBy("k", "d", "u")
    placed = (
        ranged.withColumn("__upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("__nth", F.row_number().over(order))
        .join(F.broadcast(offsets), ["range", "sub"])
        .withColumn("__rank", F.col("rows_before") + F.col("__nth") - 1)
        # the middle of the row decides, so that each shard is off by half a row at most at either end
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor((F.col("bytes_before") + F.col("__upto") - F.col("size") / 2) * shards / total)).cast("int"))
    )
    placed = common.materialize(placed.drop("range", "sub", "__upto", "__nth", "bytes_before", "rows_before"), "placed")
    starts = F.broadcast(placed.groupBy("shard").agg(F.min("__rank").alias("__first")))  # a row for each shard
    out = placed.join(starts, "shard").withColumn("slot", F.col("__rank") - F.col("__first")).drop("__rank", "__first")
    common.discard(spark, ranged)
    return out


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("d"),
        F.xxhash64(text).alias("k"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.monotonically_increasing_id().alias("u"),  # parts rows that are equal; the table is written, so it stays
    )
    return shard_rows(common.materialize(rows, "sizes"), shards).select(
        F.col("d").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Write the rows of ``docs`` under ``path``, in a folder ``shard=N`` each."""
    # equal rows on both sides of a cut go to the first of their shards
    placed = shard_documents(docs, shards).groupBy("doc_id", "text_crc32").agg(F.min("shard").alias("shard"))
    crc = F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    both = docs.withColumn("__crc", crc).alias("x").join(
        placed.withColumnsRenamed({"doc_id": "__doc"}), (F.col("x.doc_id").eqNullSafe(F.col("__doc"))) & (F.col("__crc") == F.col("text_crc32"))
    )
    both.select(*[F.col(f"x.{c}") for c in docs.columns], "shard").write.partitionBy("shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.finished(spark, lambda: shard_documents(common.table(spark, sf_dir, "documents")))
