"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of one Arrow batch handed to Python; texts may be very long, and a
#: batch is held in memory as a whole.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local folder is made only where the setting is missing (tests, local mode).
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    held = getattr(shared_dir, "_own", None)
    if held is None:
        held = shared_dir._own = "file://" + tempfile.mkdtemp(prefix="spanloom-")
    return held


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/spanloom/{uuid.uuid4().hex}/{name}"


#: Lists of the paths that `finished` is to delete, one for each call that goes on.
_open: list[list[str]] = []


def finished(spark: SparkSession, make: Callable[[], DataFrame], name: str = "result") -> DataFrame:
    """What ``make`` returns, written; every other table that was written meanwhile is deleted."""
    _open.append(made := [])
    try:
        out = materialize(make(), name)
    finally:
        _open.remove(made)
        keep = made[-1:] if made and made[-1].endswith(f"/{name}") else []
        discard(spark, *[p for p in made if p not in keep])
    return out


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    The written table cuts the lineage and outlives lost executors.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    for made in _open:
        made.append(path)
    df.write.parquet(path)
    give_back()
    out = spark.read.schema(schema).parquet(path)
    out._scratch_path = path
    return out


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete materialized tables that no later result reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "_scratch_path", None)
        if path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def arrow_rows(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small enough that a batch of long texts fits a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(key))
    if held <= 0 or held > rows:
        spark.conf.set(key, str(rows))


def utf8(name: str):
    """Column ``name`` as UTF-8 bytes; null becomes the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for `mapInArrow` in a worker that gives memory back: workers go on from stage to stage.

    Before it, the tokenizer that an earlier stage has left in the worker goes, with its
    memos; after it, memory that is free goes back to the system.
    """

    @functools.wraps(run)
    def tidy(batches: Iterator) -> Iterator:
        if (left := sys.modules.get(f"{__package__}.byte_bpe")) is not None and left._loaded:
            left._loaded.clear()
            give_back()
        yield from run(batches)
        give_back()

    return tidy


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


#: Bits of the filter of `member` for each key, and the fewest and most bits of a filter.
KEY_BITS, LEAST_BITS, MOST_BITS = 10, 1 << 20, 1 << 29


def member(keys: DataFrame, column: str):
    """A function from a column to a boolean: true for every key in ``keys``, false for most others.

    A Bloom filter sized by the number of keys and broadcast, 64 MB at most.  It keeps
    rows that a join would drop out of the join's shuffle.  With more keys than a quarter
    of the most bits there is none: all rows pass, and the join after it shuffles them all.
    """
    spark = keys.sparkSession
    n, size = keys.count(), LEAST_BITS
    if n > MOST_BITS // 4:
        return lambda c: F.lit(True)
    while size < KEY_BITS * n and size < MOST_BITS:
        size *= 2

    def places(c):
        return [F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(size)) for salt in (1, 2, 3)]

    found = (
        keys.select(F.explode(F.array(*places(F.col(column)))).alias("p"))
        .groupBy(F.floor(F.col("p") / 32768).alias("part")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("bits"))
        .collect()  # size / 32768 rows at most
    )
    table = np.zeros((size // 32768, 4096), np.uint8)
    for r in found:
        table[r.part] = np.frombuffer(bytes(r.bits), np.uint8)
    shared = spark.sparkContext.broadcast(table.ravel())

    @F.pandas_udf("boolean")
    def has(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        bits = shared.value
        out = np.ones(len(a), bool)
        for p in (a.to_numpy(), b.to_numpy(), c.to_numpy()):
            out &= (bits[p >> 3] >> (p & 7)) & 1 == 1
        return pd.Series(out)

    return lambda c: has(*places(c))
