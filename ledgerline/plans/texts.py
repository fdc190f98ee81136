"""One text, or one archive of texts, from rows in order: range-sorted parts that a Spark data source writes, laid side by side in one file.

The rows are range-partitioned and sorted; each task writes its part through the sink and reports rows, bytes and checksum; the commit keeps these reports in a
manifest beside the parts, or, where a task was lost for good, removes what there is. The manifest gives each part's place in the file, so a second job of
one task per part copies them there, a chunk at a time: no row and no text passes through the driver, nothing is read again to be counted, and the
bytes are the same at any partitioning. Only then does the file get its name.

An archive's members are such texts. Each part is deflated by itself up to a full flush, so that the parts of a member are one stream when laid side by
side; its checksum is made from those of the parts. Members are dated 1980 and stand in order of name, with 64-bit sizes, so neither their number nor
their size is limited.

`path` is in a folder that driver and executors share as a mounted file system, since writing at a place is not what object stores offer; others raise.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

CHUNK = 1 << 20
#: Tasks at most that copy parts to their places.
TASKS = 10_000
END = "\r\n"


def mounted(path: str) -> str:
    """The plain path of a file: URI or a path; any other scheme raises."""
    if "://" in path and not path.startswith("file://") or path.startswith(("s3:", "hdfs:", "viewfs:")):
        raise ValueError(f"{path} is not in a mounted file system")
    return path.removeprefix("file://").removeprefix("file:")


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: its place in the order, and for each member (or the one text) rows, bytes, stored bytes and crc32."""

    place: int
    file: str
    members: list[list]


class TextSink(DataSource):
    """Takes columns member and line; options: path (a folder for the parts), deflate."""

    @classmethod
    def name(cls) -> str:
        return "ledgerline_text"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return TextWriter(self.options["path"], self.options.get("deflate") == "true")


class TextWriter(DataSourceArrowWriter):
    def __init__(self, path: str, deflate: bool):
        self.path, self.deflate = path, deflate

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        place = TaskContext.get().partitionId()
        file = f"{self.path}/part-{place}-{uuid.uuid4().hex}"  # an attempt has a file of its own
        found: list[list] = []
        packer = None
        os.makedirs(self.path, exist_ok=True)
        with open(file, "wb") as out:

            def close() -> None:
                if packer is not None and found:
                    found[-1][3] += out.write(packer.flush(zlib.Z_FULL_FLUSH))

            for batch in iterator:
                names, lines = batch.column("member").to_pylist(), batch.column("line").to_pylist()
                at = 0
                while at < len(lines):
                    end = at + 1
                    while end < len(lines) and names[end] == names[at]:
                        end += 1
                    if not found or found[-1][0] != names[at]:
                        close()
                        found.append([names[at], 0, 0, 0, 0])
                        packer = zlib.compressobj(9, zlib.DEFLATED, -15) if self.deflate else None
                    data = "".join(f"{line}{END}" for line in lines[at:end]).encode()
                    own = found[-1]
                    own[1] += end - at
                    own[2] += len(data)
                    own[3] += out.write(packer.compress(data) if packer is not None else data)
                    own[4] = zlib.crc32(data, own[4])
                    at = end
            close()
        return Part(place, file, found)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.place)
        os.makedirs(self.path, exist_ok=True)
        with open(f"{self.path}/_manifest.json", "w") as out:
            json.dump([[p.file, p.members] for p in parts], out)

    def abort(self, messages: list[Part | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.file):
                os.remove(m.file)


def _parts(rows: DataFrame, path: str, deflate: bool) -> list[list]:
    """Writes the rows (member, line, in their order) as parts: [file, [[member, rows, bytes, stored bytes, crc32], ...]] in order."""
    rows.sparkSession.dataSource.register(TextSink)
    rows.select("member", "line").write.format(TextSink.name()).mode("append").options(path=path, deflate=str(deflate).lower()).save()
    with open(f"{path}/_manifest.json") as found:
        return json.load(found)


def _laid(rows: DataFrame, pieces: list[tuple], path: str, fixed: list[tuple[int, bytes]]) -> None:
    """Copies pieces (file, from, to, bytes) and the few `fixed` bytes into the file at `path`, which appears once all are there."""
    hidden = f"{os.path.dirname(path)}/.{os.path.basename(path)}-{uuid.uuid4().hex}"
    with open(hidden, "wb") as out:
        for at, data in fixed:
            out.seek(at)
            out.write(data)

    def copy(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.to_pylist():
                left = piece["bytes"]
                with open(piece["file"], "rb") as source, open(hidden, "r+b") as out:
                    source.seek(piece["source"])
                    out.seek(piece["target"])
                    while left:
                        data = source.read(min(CHUNK, left))
                        if not data:
                            raise OSError(f"{piece['file']} is cut short")
                        left -= out.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], ["n"])

    if pieces:
        table = rows.sparkSession.createDataFrame(pieces, "file string, source long, target long, bytes long")  # a row for each part
        done = table.repartition(min(len(pieces), TASKS), F.monotonically_increasing_id()).mapInArrow(copy, "n long").agg(F.sum("n")).first()[0]
        if done != len(pieces):
            raise OSError(f"{done} of {len(pieces)} parts were laid")
    os.replace(hidden, path)


def _clear(path: str) -> None:
    for name in os.listdir(path):
        os.remove(f"{path}/{name}")
    os.rmdir(path)


def lines_of(rows: DataFrame, columns: list[str], field, cells: str | None = None) -> F.Column:
    """The CSV line of a row's columns, or of its array `cells`, which must have as many; field() quotes a column. A row of another width raises when it is written."""
    if cells is None:
        return F.concat_ws(",", *[field(F.col(c)) for c in columns])
    wrong = F.raise_error(F.concat(F.lit(f"a row has not {len(columns)} cells but "), F.coalesce(F.size(cells).cast("string"), F.lit("none"))))
    return F.when(F.size(cells) == len(columns), F.array_join(F.transform(cells, field), ",")).otherwise(wrong.cast("string"))


def write_text(rows: DataFrame, path: str, order: list[str], line: F.Column, lead: list[str], mark: bool = True) -> dict[str, int]:
    """The lines of the rows in `order` as one text with `lead` in front and a byte order mark: {"rows": .., "bytes": ..}, as counted while writing.

    Rows that tie in `order` are ordered by their line, so that the bytes don't depend on the partitioning.
    """
    path = mounted(path)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    sorted_ = rows.withColumn("line", line).withColumn("member", F.lit("")).orderBy(*order, "line")
    folder = f"{path}-parts-{uuid.uuid4().hex}"
    front = ("\ufeff" * mark + "".join(f"{x}{END}" for x in lead)).encode()
    pieces, at, n = [], len(front), 0
    for file, members in _parts(sorted_, folder, False):
        for _, count, size, _, _ in members:
            pieces.append((file, 0, at, size))
            at, n = at + size, n + count
    _laid(rows, pieces, path, [(0, front)])
    _clear(folder)
    return {"rows": n, "bytes": at}


def _times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """The crc32 of two byte strings side by side, from theirs and the second one's length: the first is shifted by squaring the operator of one zero bit."""
    operator = [0xEDB88320, *[1 << i for i in range(31)]]
    for _ in range(3):
        operator = [_times(operator, column) for column in operator]
    while length:
        if length & 1:
            first = _times(operator, first)
        operator = [_times(operator, column) for column in operator]
        length >>= 1
    return first ^ second


def write_archive(rows: DataFrame, path: str, member: str, order: list[str], line: F.Column) -> list[dict]:
    """A ZIP with a text for each value of `member`, of its lines in `order`: [{"member", "rows", "bytes", "crc32"}, ...], as counted while writing."""
    path = mounted(path)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    sorted_ = rows.withColumn("line", line).withColumn("member", F.col(member).cast("string")).filter("member is not null").orderBy("member", *order, "line")
    folder = f"{path}-parts-{uuid.uuid4().hex}"
    found: list[dict] = []
    for file, members in _parts(sorted_, folder, True):
        place = 0
        for name, count, size, stored, crc in members:
            if not found or found[-1]["member"] != name:
                found.append({"member": name, "rows": 0, "bytes": 0, "crc32": 0, "stored": 0, "parts": []})
            own = found[-1]
            own["crc32"] = joined_crc(own["crc32"], crc, size)
            own["parts"].append((file, place, stored))
            own["rows"], own["bytes"], own["stored"], place = own["rows"] + count, own["bytes"] + size, own["stored"] + stored, place + stored
    last = b"\x03\x00"  # an empty block that ends a deflated stream
    fixed, pieces, at, directory = [], [], 0, b""
    for own in found:
        name, stored = own["member"].encode(), own["stored"] + len(last)
        # Version 4.5 with 64-bit sizes, UTF-8 names, deflate, the first of January 1980.
        about = struct.pack("<HHHHHIII", 45, 0x800, 8, 0, 33, own["crc32"], 0xFFFFFFFF, 0xFFFFFFFF)
        header = b"PK\x03\x04" + about + struct.pack("<HH", len(name), 20) + name + struct.pack("<HHQQ", 1, 16, own["bytes"], stored)
        directory += b"PK\x01\x02" + struct.pack("<H", 45) + about + struct.pack("<HHHHHII", len(name), 28, 0, 0, 0, 0, 0xFFFFFFFF) + name + struct.pack("<HHQQQ", 1, 24, own["bytes"], stored, at)
        fixed.append((at, header))
        at += len(header)
        for file, source, size in own["parts"]:
            pieces.append((file, source, at, size))
            at += size
        fixed.append((at, last))
        at += len(last)
    n, size = len(found), len(directory)
    end = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, at) + b"PK\x06\x07" + struct.pack("<IQI", 0, at + size, 1)
    end += b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, 0xFFFFFFFF), 0xFFFFFFFF, 0)
    _laid(rows, pieces, path, [*fixed, (at, directory + end)])
    _clear(folder)
    return [{k: own[k] for k in ("member", "rows", "bytes", "crc32")} for own in found]
