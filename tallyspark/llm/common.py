"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar, Token

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.ship import ship  # noqa: F401  (for the operators)

#: What separates words: space and the ASCII controls 9 to 13.
GAP = r"[\x20\x09-\x0D]+"

#: Rows that a table may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    """Words of a text in order; none for a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir. Where that is unset and all runs on this machine,
    as in tests, a folder of the session; on a cluster there is no such folder to fall back on."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), f"tallyspark-{spark.sparkContext.applicationId}")
    return base.rstrip("/") + "/tallyspark"


def made_dir(spark: SparkSession, path: str) -> str:
    """path, made if need be, with the scheme that Hadoop gives a path without one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(where)
    return store.makeQualified(where).toString()


class Scope:
    """Owns the tables and folders that are staged while it is open in this thread, and drops them when it closes, but for
    those it is told to keep: `with Scope(): query(...).write...` leaves nothing behind. Scopes nest; what is staged
    belongs to the innermost one. Other threads have scopes of their own."""

    def __init__(self) -> None:
        self.held: list[Staged | Folder] = []

    def __enter__(self) -> Scope:
        self._token = _OPEN.set(self)
        return self

    def __exit__(self, *_) -> None:
        _OPEN.reset(self._token)
        for s in self.held:
            s.drop()

    def keep(self, *some: Staged | Folder) -> None:
        """Leave some to the scope around this one."""
        for s in some:
            if s in self.held:
                self.held.remove(s)
                if (outer := self._token.old_value) is not Token.MISSING and outer is not None:
                    outer.held.append(s)
                else:
                    _LOOSE.append(s)


_OPEN: ContextVar[Scope | None] = ContextVar("open", default=None)
#: What was staged outside of any scope and has not been dropped yet.
_LOOSE: list[Staged | Folder] = []


def _own(s: Staged | Folder) -> None:
    scope = _OPEN.get()
    (_LOOSE if scope is None else scope.held).append(s)


def drop_staged() -> None:
    """Drop what was staged outside of any scope, once results are written: what is still to be computed may read it."""
    while _LOOSE:
        _LOOSE.pop().drop()


class Folder:
    """A folder of files that an operator writes by itself, dropped like a staged table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        _own(self)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


class Staged:
    """A table written to the shared folder and read back, which cuts the lineage. It stays there until it is dropped."""

    def __init__(self, df: DataFrame, label: str, codec: str = "zstd"):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        _own(self)
        df.write.option("compression", codec).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Remove the files; only once nothing reads them any more. A second time it does nothing."""
        drop_path(self.spark, self.path)


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has few enough rows (counted by the caller), else as it is."""
    return F.broadcast(df) if rows <= most else df


def table_bytes(df: DataFrame) -> int:
    """Bytes that Spark expects of a plan; for a scan the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from all columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without(text: Column, chars: str) -> Column:
    """text less every one of chars."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text
