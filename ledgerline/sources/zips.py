"""Zipped tables and documents as a Spark data source: a partition for each member, read as a stream.

The driver reads the archives' directories, a few bytes at their ends, and plans a task for each member; a task inflates its member a chunk at a time and hands on
batches of about CHUNK bytes, so that an archive of any size, with any number of members, needs no more memory than that. The archives can
be in any store that pyarrow opens by its URI, or in a folder that all executors see.

Kinds: `csv` gives the schema's columns as strings (empty cells are NULL), after file, member and row; `features` gives properties and geometry (JSON) of a feature
collection's features; `digest` gives bytes and sha256. A member without one of the columns raises, and so does one whose bytes don't
have its recorded checksum, or that is cut short: nothing of it is silently left out. An archive without a matching member gives no rows.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

CHUNK = 1 << 18
_BY_KIND = {"csv": "file string, member string, row long", "features": "file string, member string, properties string, geometry string", "digest": "file string, member string, bytes long, sha256 string"}


def array_items(text: io.TextIOBase, key: str) -> Iterator[object]:
    """The items of the array under `key`, read a chunk at a time, whatever the layout of the file."""
    decoder, held = json.JSONDecoder(), ""
    while (at := held.find(f'"{key}"')) < 0 or (start := held.find("[", at)) < 0:
        more = text.read(CHUNK)
        if not more:
            return
        held += more
    held = held[start + 1 :]
    while True:
        held = held.lstrip(" \t\r\n,")
        if held.startswith("]"):
            while text.read(CHUNK):  # to the end, where the checksum is compared
                pass
            return
        try:
            item, end = decoder.raw_decode(held)
            if end == len(held):
                raise ValueError  # a number may go on
        except ValueError:
            more = text.read(CHUNK)
            if not more:
                raise
            held += more
            continue
        yield item
        held = held[end:]


def opened(path: str) -> io.IOBase:
    """A file to seek in, by URI or plain path."""
    where, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return where.open_input_file(name)


def listed(path: str) -> list[str]:
    """The .zip files of a folder, or the one file, in order of name."""
    where, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    info = where.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [name] if info.type == fs.FileType.File else [f.path for f in where.get_file_info(fs.FileSelector(name)) if f.type == fs.FileType.File and f.path.endswith(".zip")]
    prefix = path[: path.index(name)] if name in path else ""
    return sorted(f"{prefix}{f}" for f in found)


@dataclass
class Member(InputPartition):
    path: str
    name: str


class ZipSource(DataSource):
    """Options: path, kind, suffix (of the members to read), single (true: an archive with several matching members raises)."""

    @classmethod
    def name(cls) -> str:
        return "ledgerline_zip"

    def schema(self) -> str:
        return _BY_KIND[self.options.get("kind", "digest")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZipReader(dict(self.options), schema)


class ZipReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.columns = options, schema.names

    def partitions(self) -> list[InputPartition]:
        found = []
        for path in listed(self.options["path"]):
            with opened(path) as file, zipfile.ZipFile(file) as z:
                members = [i.filename for i in z.infolist() if not i.is_dir() and i.filename.endswith(self.options.get("suffix", ""))]
            if self.options.get("single") == "true" and len(members) != 1:
                raise ValueError(f"{path} has {len(members)} members, not one")
            found += [Member(path, m) for m in members]
        return found

    def read(self, partition: Member | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no member at all
            return
        rows: list[list] = []
        size = 0
        types = {"row": pa.int64(), "bytes": pa.int64()}
        with opened(partition.path) as file, zipfile.ZipFile(file) as z, z.open(partition.name) as raw:
            for row in getattr(self, f"_{self.options.get('kind', 'digest')}")(raw):
                rows.append([partition.path, partition.name, *row])
                size += sum(len(v) for v in row if isinstance(v, str)) + 64
                if size >= CHUNK:
                    yield self._batch(rows, types)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows, types)

    def _batch(self, rows: list[list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(self.columns, columns, strict=True)], self.columns)

    def _csv(self, raw: io.IOBase) -> Iterable[list]:
        rows = csv.DictReader(io.TextIOWrapper(raw, "utf-8-sig", newline=""))
        wanted = self.columns[3:]
        if absent := [c for c in wanted if c not in (rows.fieldnames or [])]:
            raise ValueError(f"columns are missing: {', '.join(absent)}")
        for n, row in enumerate(rows, 1):
            yield [n, *[row[c] or None for c in wanted]]

    def _features(self, raw: io.IOBase) -> Iterable[list]:
        for item in array_items(io.TextIOWrapper(raw, "utf-8-sig"), "features"):
            yield [json.dumps(item.get(k), ensure_ascii=False) for k in ("properties", "geometry")]

    def _digest(self, raw: io.IOBase) -> Iterable[list]:
        size, seen = 0, hashlib.sha256()
        while part := raw.read(CHUNK):
            size += len(part)
            seen.update(part)
        yield [size, seen.hexdigest()]


def _load(spark: SparkSession, path: str, kind: str, schema: str | None = None, **options: str) -> DataFrame:
    spark.dataSource.register(ZipSource)
    reader = spark.read.format(ZipSource.name()).options(path=path, kind=kind, **options)
    return (reader.schema(schema) if schema else reader).load()


def zipped_csv(spark: SparkSession, path: str, columns: list[str], several: bool = False, suffix: str = "") -> DataFrame:
    """file, member, row and `columns` (strings, empty cells NULL) of the archives' CSV members, with or without a byte-order mark; one member of that suffix each, unless `several`."""
    return _load(spark, path, "csv", ", ".join([_BY_KIND["csv"], *[f"`{c}` string" for c in columns]]), single=str(not several).lower(), suffix=suffix)


def zipped_features(spark: SparkSession, path: str, suffix: str = "json") -> DataFrame:
    """file, member, properties and geometry (JSON) of the features in the archives' members of that suffix."""
    return _load(spark, path, "features", suffix=suffix)


def members(spark: SparkSession, path: str) -> DataFrame:
    """file, member, bytes, sha256 of all members; one whose checksum is wrong raises."""
    return _load(spark, path, "digest")
