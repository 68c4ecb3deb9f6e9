"""Several tables that are replaced together: each write makes a folder of its own, and one small file says which holds."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _numbers(spark: SparkSession, path: str) -> list[int]:
    store, where = _store(spark, f"{path}/_manifests")
    if not store.exists(where):
        return []
    names = [f.getPath().getName() for f in store.listStatus(where)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def _read(spark: SparkSession, path: str, number: int) -> dict:
    store, where = _store(spark, f"{path}/_manifests/{number:09d}.json")
    stream = store.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def current(spark: SparkSession, path: str) -> str:
    """The folder that the newest manifest names; the path itself where there are none."""
    numbers = _numbers(spark, path)
    return f"{path}/{_read(spark, path, numbers[-1])['folder']}" if numbers else path


def commit(spark: SparkSession, path: str, write: Callable[[str], None], keep: int = 2) -> str:
    """Let write(folder) fill a new folder under path, then name it in a new manifest; returns the folder.

    Readers see either all tables of one write or all of another: a write that fails names nothing, and the manifest is
    put in place by one rename, under a number that no other write has taken (else this raises, and what was there still
    holds). Of older writes, keep - 1 stay for readers that have begun.
    """
    if keep < 1:
        raise ValueError("the written version itself must be kept")
    numbers = _numbers(spark, path)
    folder = f"version-{uuid.uuid4().hex}"
    try:
        write(f"{path}/{folder}")
    except BaseException:
        store, where = _store(spark, f"{path}/{folder}")
        store.delete(where, True)
        raise
    number = numbers[-1] + 1 if numbers else 1
    store, draft = _store(spark, f"{path}/_manifests/.{folder}")
    stream = store.create(draft, True)
    stream.write(bytearray(json.dumps({"folder": folder, "number": number}).encode()))
    stream.close()
    _, final = _store(spark, f"{path}/_manifests/{number:09d}.json")
    if store.exists(final) or not store.rename(draft, final):
        store.delete(draft, False)
        store.delete(_store(spark, f"{path}/{folder}")[1], True)
        raise RuntimeError(f"another write to {path} came first")
    for old in (numbers + [number])[:-keep]:
        gone = _read(spark, path, old)["folder"]
        store.delete(_store(spark, f"{path}/_manifests/{old:09d}.json")[1], False)
        store.delete(_store(spark, f"{path}/{gone}")[1], True)
    return f"{path}/{folder}"
