"""Tables that several queries of a session share, kept in Spark's cache up to a number of them."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable, Hashable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


class Context:
    """Persisted tables by key, the least recently used dropped first. Spark fills a table's cache when it is first read,
    and computes lost parts anew. A table is told by its key alone: files that change under a path are not noticed, so
    forget() it, or use another key."""

    def __init__(self, most: int = 8):
        if most < 1:
            raise ValueError("a context must hold at least one table")
        self.most, self.tables, self.lock = most, OrderedDict[tuple, DataFrame](), threading.Lock()
        self.hits = self.misses = 0

    def held(self, spark: SparkSession, key: Hashable, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of a key, made if it is not there."""
        whole = (spark.sparkContext.applicationId, key)
        with self.lock:
            if whole in self.tables:
                self.hits += 1
                self.tables.move_to_end(whole)
                return self.tables[whole]
        table = make().persist(StorageLevel.MEMORY_AND_DISK)
        with self.lock:
            if whole in self.tables:  # made by another thread meanwhile: of the same plan, so also the same cache
                return self.tables[whole]
            self.misses += 1
            self.tables[whole] = table
            gone = [k for k in self.tables if k[0] != whole[0]]  # of sessions that have ended
            for k in gone:
                del self.tables[k]
            spare = [self.tables.popitem(last=False)[1] for _ in range(len(self.tables) - self.most)]
        for old in spare:
            old.unpersist()
        return table

    def forget(self, spark: SparkSession, key: Hashable | None = None) -> None:
        """Drop the table of a key, or all of the session."""
        with self.lock:
            mine = [k for k in self.tables if k[0] == spark.sparkContext.applicationId and (key is None or k[1] == key)]
            old = [self.tables.pop(k) for k in mine]
        for table in old:
            table.unpersist()


#: The context of the registered queries.
SHARED = Context()
