"""Bloom filter and count-min sketch as tables of fixed size."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOOM_BITS, BLOOM_HASHES = 1 << 20, 7
CMS_WIDTH, CMS_DEPTH = 1 << 17, 4
#: Items above which a sketch is started anew (`GhostSketch`); a full filter is taken to hold one more.
ROTATE_AT = 150_000


def word(value: Column, at: int) -> Column:
    return F.conv(F.substring(F.md5(value), at, 8), 16, 10).cast("long")


def positions(value: Column, size: int, count: int) -> Column:
    """``count`` places in a table of ``size``, by double hashing."""
    a, b = word(value, 1), word(value, 9)
    return F.array(*[(a + F.lit(i) * b) % size for i in range(count)])


def bloom(items: DataFrame, column: str) -> DataFrame:
    """(bit): the set bits, BLOOM_BITS rows at most; different items are found first, then hashed."""
    return items.select(column).distinct().select(F.explode(positions(F.col(column), BLOOM_BITS, BLOOM_HASHES)).alias("bit")).distinct()


def bloom_estimate(bits: DataFrame, full: float = ROTATE_AT + 1) -> DataFrame:
    """(set_bits, estimate): how many different items made the filter; ``full`` for a full one."""
    n = F.count("*")
    estimate = F.round(-F.lit(BLOOM_BITS / BLOOM_HASHES) * F.log(1 - n / BLOOM_BITS), 4)
    return bits.agg(n.alias("set_bits"), F.when(n >= BLOOM_BITS, F.lit(float(full))).otherwise(estimate).alias("estimate"))


def bloom_contains(probes: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """The distinct probes whose bits are all set."""
    asked = probes.select(column).distinct().select(column, F.explode(F.array_distinct(positions(F.col(column), BLOOM_BITS, BLOOM_HASHES))).alias("bit"))
    met = asked.join(bits.withColumn("set", F.lit(True)), "bit", "left").groupBy(column).agg(F.bool_and(F.coalesce("set", F.lit(False))).alias("all"))
    return met.where("all").select(column)


def count_min(items: DataFrame, column: str) -> DataFrame:
    """(row, cell, n): CMS_DEPTH * CMS_WIDTH rows at most."""
    counted = items.groupBy(column).agg(F.count("*").alias("n"))
    return counted.select("n", F.posexplode(positions(F.col(column), CMS_WIDTH, CMS_DEPTH)).alias("row", "cell")).groupBy("row", "cell").agg(F.sum("n").alias("n"))


def count_min_estimate(probes: DataFrame, column: str, sketch: DataFrame) -> DataFrame:
    """(column, estimate) for the distinct probes."""
    asked = probes.select(column).distinct().select(column, F.posexplode(positions(F.col(column), CMS_WIDTH, CMS_DEPTH)).alias("row", "cell"))
    return asked.join(sketch, ["row", "cell"], "left").groupBy(column).agg(F.min(F.coalesce("n", F.lit(0))).cast("long").alias("estimate"))


# ---- sketches of a stream, held as state


class GhostSketch:
    """A Bloom filter and a count-min sketch of the words of one stream, started anew when the filter is full."""

    def __init__(self, bits: bytes | None = None, counts: bytes | None = None, rotations: int = 0, rotate_at: int = ROTATE_AT):
        self.bits = np.frombuffer(bits, np.uint8).copy() if bits else np.zeros(BLOOM_BITS // 8, np.uint8)
        self.counts = np.frombuffer(zlib.decompress(counts), np.uint32).reshape(CMS_DEPTH, CMS_WIDTH).copy() if counts else np.zeros((CMS_DEPTH, CMS_WIDTH), np.uint32)
        self.rotations, self.rotate_at = rotations, rotate_at

    @staticmethod
    def places(word: str, size: int, count: int) -> list[int]:
        digest = hashlib.md5(word.encode()).hexdigest()
        a, b = int(digest[:8], 16), int(digest[8:16], 16)
        return [(a + i * b) % size for i in range(count)]

    def estimate(self) -> float:
        n = int(np.bitwise_count(self.bits).sum())
        return float(ROTATE_AT + 1) if n >= BLOOM_BITS else -BLOOM_BITS / BLOOM_HASHES * math.log(1 - n / BLOOM_BITS)

    def add(self, word: str) -> None:
        if self.estimate_is_over():
            self.bits[:] = 0
            self.counts[:] = 0
            self.rotations += 1
        for p in self.places(word, BLOOM_BITS, BLOOM_HASHES):
            self.bits[p >> 3] |= 1 << (p & 7)
        for row, p in enumerate(self.places(word, CMS_WIDTH, CMS_DEPTH)):
            self.counts[row, p] += 1
        self._since = getattr(self, "_since", 0) + 1

    def estimate_is_over(self) -> bool:
        """Looked at once in a while: the estimate cannot grow by more than the words added."""
        if getattr(self, "_since", 0) < getattr(self, "_pause", 0):
            return False
        e = self.estimate()
        self._since, self._pause = 0, max(1, int((self.rotate_at - e) / 2))
        return e > self.rotate_at

    def holds(self, word: str) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.places(word, BLOOM_BITS, BLOOM_HASHES))

    def count(self, word: str) -> int:
        return min(int(self.counts[row, p]) for row, p in enumerate(self.places(word, CMS_WIDTH, CMS_DEPTH)))

    def state(self) -> tuple[bytes, bytes, int]:
        return self.bits.tobytes(), zlib.compress(self.counts.tobytes(), 1), self.rotations


def sketched(stream: DataFrame, probes: list[str], rotate_at: int = ROTATE_AT) -> DataFrame:
    """(key, estimate, rotations, verdict, found) after each batch of a stream (key, text): one sketch for each key, as state.

    verdict says whether any probe may have been seen, found the sum of their counts.
    """

    def step(key, batches, state):
        sketch = GhostSketch(*state.get, rotate_at=rotate_at) if state.exists else GhostSketch(rotate_at=rotate_at)
        for rows in batches:
            for text in rows.text.dropna():
                for word in re.findall("[a-z0-9]+", text.lower()):
                    sketch.add(word)
        state.update(sketch.state())
        yield pd.DataFrame({"key": [key[0]], "estimate": [sketch.estimate()], "rotations": [sketch.rotations], "verdict": [any(map(sketch.holds, probes))], "found": [sum(sketch.count(p) for p in probes if sketch.holds(p))]})

    return stream.groupBy("key").applyInPandasWithState(step, "key string, estimate double, rotations int, verdict boolean, found long", "bits binary, counts binary, rotations int", "append", "NoTimeout")
