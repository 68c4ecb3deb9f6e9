"""A Spark data source for coordinate (matrix market) files: spark.read.format("coordinate").load(path).

Rows are gene, cell (both from 0) and value. A file is read in ranges of bytes, a task each; conditions on gene and cell
are taken over by the source, which then parses no values and makes no rows of other entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tallyspark.functions.ship import ship

SCHEMA = "gene long, cell long, value double"
#: Bytes of a range, and of the piece of it that is parsed at once.
RANGE, PIECE = 64 << 20, 4 << 20


def _opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    if urlparse(path).scheme in ("", "file"):
        return pa.fs.LocalFileSystem(), urlparse(path).path
    return pa.fs.FileSystem.from_uri(path)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def _tests(filters: list[Filter]) -> list[tuple[str, str, object]]:
    signs = {EqualTo: "equal", GreaterThan: "greater", GreaterThanOrEqual: "greater_equal", LessThan: "less", LessThanOrEqual: "less_equal", In: "is_in"}
    return [(f.attribute[0], signs[type(f)], f.value) for f in filters]


class CoordinateReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("a path is needed")
        self.path, self.range = options["path"], int(options.get("rangebytes", options.get("rangeBytes", RANGE)))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes conditions on gene and cell; leaves the rest to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)) and f.attribute in (("gene",), ("cell",)):
                self.tests += _tests([f])
            else:
                yield f

    def partitions(self) -> list[Range]:
        store, path = _opened(self.path)
        found = [store.get_file_info(path)]
        if found[0].type == pa.fs.FileType.Directory:
            found = sorted((i for i in store.get_file_info(pa.fs.FileSelector(path)) if i.is_file and not i.base_name.startswith(("_", "."))), key=lambda i: i.path)
        if not found or found[0].type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        first = self._size_line(store, found)
        out = [Range(i.path, at, min(at + self.range, i.size)) for i in found for at in range(0, i.size, self.range)]
        out = [r for r in out if r.end > (first[1] if r.path == first[0] else 0) and not self._before(found, r.path, first[0])]
        return [Range(r.path, max(r.start, first[1]) if r.path == first[0] else r.start, r.end) for r in out] or [Range(found[-1].path, found[-1].size, found[-1].size)]

    @staticmethod
    def _before(found: list, path: str, other: str) -> bool:
        names = [i.path for i in found]
        return names.index(path) < names.index(other)

    @staticmethod
    def _size_line(store, found: list) -> tuple[str, int]:
        """The file and the byte at which entries begin: behind comments, blank lines and the size line."""
        for info in found:
            at = 0
            with store.open_input_stream(info.path) as f:
                rest = b""
                while block := f.read(1 << 16):
                    rest += block
                    while (end := rest.find(b"\n")) >= 0:
                        line, rest, at = rest[:end].strip(), rest[end + 1 :], at + end + 1
                        if line and not line.startswith(b"%"):
                            if len(line.split()) != 3:
                                raise ValueError(f"{info.path} has no size line")
                            return info.path, at
        raise ValueError("no size line")

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        """Entries of lines that begin within the range."""
        store = _opened(self.path)[0]
        with store.open_input_file(part.path) as f:
            at = part.start
            if at and part.end > at:
                f.seek(at - 1)
                at += len(_line(f)) - 1  # the line that begins earlier is the range's before
            f.seek(at)
            rest = b""
            while at < part.end:
                block = f.read(min(PIECE, part.end - at))
                if not block:
                    break
                at += len(block)
                rest += block
                if at >= part.end and not rest.endswith(b"\n"):
                    rest += _line(f)
                cut = rest.rfind(b"\n") + 1 if at < part.end else len(rest)
                yield from self._parsed(rest[:cut])
                rest = rest[cut:]

    def _parsed(self, lines: bytes) -> Iterator[pa.RecordBatch]:
        fields = lines.split()
        if len(fields) % 3:
            raise ValueError("an entry has not three fields")
        if not fields:
            return
        ids = {"gene": pc.subtract(pa.array(fields[0::3]).cast(pa.string()).cast(pa.int64()), 1), "cell": pc.subtract(pa.array(fields[1::3]).cast(pa.string()).cast(pa.int64()), 1)}
        keep = None
        for name, sign, value in self.tests:
            one = pc.is_in(ids[name], pa.array(list(value), pa.int64())) if sign == "is_in" else getattr(pc, sign)(ids[name], value)
            keep = one if keep is None else pc.and_(keep, one)
        values = pa.array(fields[2::3])
        if keep is not None:
            ids, values = {k: v.filter(keep) for k, v in ids.items()}, values.filter(keep)
        if len(values):
            yield pa.RecordBatch.from_arrays([ids["gene"], ids["cell"], values.cast(pa.string()).cast(pa.float64())], ["gene", "cell", "value"])


def _line(f) -> bytes:
    """What is left of the line at the file's place."""
    out = b""
    while block := f.read(4096):
        end = block.find(b"\n")
        if end >= 0:
            return out + block[: end + 1]
        out += block
    return out


class CoordinateSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "coordinate"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CoordinateReader:
        return CoordinateReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters handed to it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CoordinateSource)
