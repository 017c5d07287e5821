"""Tables that searches share: kept by the content they come from, for a time, a few at once."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame

TTL_SECONDS, MOST = 300, 10


class IndexCache:
    """Persisted DataFrames under a key: the oldest goes when there are too many, and each after its time.

    The key is the plan and the files that it reads with their sizes and times, so a changed input is another key.
    Blocks that are lost with an executor are made again from the plan.
    """

    def __init__(self, most: int = MOST, ttl: float = TTL_SECONDS, clock: Callable[[], float] = time.monotonic):
        self.most, self.ttl, self.clock = most, ttl, clock
        self.held: OrderedDict[tuple, tuple[float, DataFrame]] = OrderedDict()
        self.lock = threading.Lock()
        self.hits = self.misses = 0

    def key(self, df: DataFrame) -> tuple:
        spark = df.sparkSession
        conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
        files = []
        for f in sorted(df.inputFiles()):
            path = jvm.org.apache.hadoop.fs.Path(f)
            status = path.getFileSystem(conf).getFileStatus(path)
            files.append((f, status.getLen(), status.getModificationTime()))
        return spark.sparkContext.applicationId, df.semanticHash(), tuple(files)

    def _drop(self, key: tuple) -> None:
        _, kept = self.held.pop(key)
        if kept.sparkSession.sparkContext._jsc is not None and key[0] == kept.sparkSession.sparkContext.applicationId:
            kept.unpersist()

    def get(self, df: DataFrame) -> DataFrame:
        """``df``, persisted."""
        key, now = self.key(df), self.clock()
        with self.lock:
            for k in [k for k, (t, _) in self.held.items() if now - t > self.ttl]:
                self._drop(k)
            if key in self.held:
                self.hits += 1
                self.held.move_to_end(key)
                return self.held[key][1]
            self.misses += 1
            kept = df.persist(StorageLevel.MEMORY_AND_DISK)
            self.held[key] = now, kept
            while len(self.held) > self.most:
                self._drop(next(iter(self.held)))
            return kept


shared = IndexCache()
