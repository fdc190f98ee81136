"""One file from many tasks, archives of texts, and archives read a member a task."""

import hashlib
import io
import json
import os
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerline.plans import exports, texts
from ledgerline.sources import zips

ROWS = [(i, f'a "{i}", é', None if i % 7 == 0 else i / 4) for i in range(500)] + [(3, "tie", 1.0), (3, "tie", 1.0), (3, None, None)]


def test_one_text_at_any_partitioning(spark, tmp_path):
    seen = set()
    for n in (1, 3, 9):
        rows = spark.createDataFrame(ROWS, "k int, t string, v double").repartition(n)
        path = f"file://{tmp_path}/out/{n}.csv"
        counts = exports.write_csv_text(rows, path, ["k", "t", "v"], {"title": "a\nb"}, ["k"])
        data = (tmp_path / "out" / f"{n}.csv").read_bytes()
        seen.add(data)
        assert counts == {"rows": len(ROWS), "bytes": len(data)}
    (data,) = seen
    lines = data.decode().split("\r\n")
    assert lines[:2] == ["﻿# title: a b", "k,t,v"] and lines[-1] == "" and lines[3] == '1,"a ""1"", é",0.25'
    assert [x.split(",")[0] for x in lines[2:-1]] == [str(k) for k in sorted(k for k, _, _ in ROWS)]
    assert sorted(os.listdir(tmp_path / "out")) == ["1.csv", "3.csv", "9.csv"]  # no parts and no unfinished file


def test_no_rows_and_no_mounted_folder(spark, tmp_path):
    none = spark.createDataFrame([], "k int, t string")
    assert exports.write_csv_text(none, f"{tmp_path}/none.csv", ["k", "t"], {}, ["k"], mark=False) == {"rows": 0, "bytes": 5}
    assert (tmp_path / "none.csv").read_bytes() == b"k,t\r\n"
    with pytest.raises(ValueError, match="mounted"):
        exports.write_csv_text(none, "s3://bucket/x.csv", ["k", "t"], {}, ["k"])


def test_rows_of_another_width_raise(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a", None]), (2, ["b", "c,d"])], "k int, cells array<string>")
    exports.write_csv_text(rows, f"{tmp_path}/w.csv", ["x", "y"], {}, ["k"], mark=False, cells="cells")
    assert (tmp_path / "w.csv").read_bytes() == b'x,y\r\na,\r\nb,"c,d"\r\n'
    wrong = rows.union(spark.createDataFrame([(3, ["only"])], rows.schema))
    with pytest.raises(Exception, match="not 2 cells but 1"):
        exports.write_csv_text(wrong, f"{tmp_path}/bad.csv", ["x", "y"], {}, ["k"], cells="cells")
    assert not (tmp_path / "bad.csv").exists()


def test_checksums_side_by_side():
    rnd = random.Random(1)
    for n in (0, 1, 7, 64, 1000, 100_003):
        a, b = rnd.randbytes(50), rnd.randbytes(n)
        assert texts.joined_crc(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


def test_archive_at_any_partitioning(spark, tmp_path):
    """Members of one row and of many parts; the same bytes, which the standard library reads and checks."""
    rows = [("big", i, f"line {i} é" * 3) for i in range(3000)] + [("small", 0, "x"), ("é/ü", 1, "y"), (None, 1, "lost")]
    seen = {}
    for n in (1, 6):
        table = spark.createDataFrame(rows, "m string, k int, t string").repartition(n)
        spark.conf.set("spark.sql.shuffle.partitions", str(n + 1))
        found = texts.write_archive(table, f"{tmp_path}/{n}.zip", "m", ["k"], F.col("t"))
        with zipfile.ZipFile(tmp_path / f"{n}.zip") as z:
            assert z.testzip() is None
            seen[n] = {i.filename: (z.read(i), i.date_time) for i in z.infolist()}
            assert [(f["member"], f["bytes"], f["crc32"]) for f in found] == [(i.filename, i.file_size, i.CRC) for i in z.infolist()]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[1] == seen[6] and list(seen[1]) == ["big", "small", "é/ü"] and seen[1]["small"] == (b"x\r\n", (1980, 1, 1, 0, 0, 0))
    assert seen[1]["big"][0].decode() == "".join(f"line {i} é" * 3 + "\r\n" for i in range(3000))
    digests = {r["member"]: (r["bytes"], r["sha256"]) for r in zips.members(spark, f"{tmp_path}/6.zip").collect()}
    assert digests == {m: (len(data), hashlib.sha256(data).hexdigest()) for m, (data, _) in seen[1].items()}


def test_members_are_read_by_tasks_of_their_own(spark, tmp_path):
    for a in range(2):
        with zipfile.ZipFile(tmp_path / f"{a}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for m in range(3):
                z.writestr(f"t{m}.csv", "﻿k,v\r\n" + "".join(f'{i},"{a}\n{m}"\r\n' for i in range(20_000 if m == 0 else 3)))
            z.writestr("note.txt", "no table")
            z.writestr("folder/", "")
    rows = zips.zipped_csv(spark, str(tmp_path), ["k", "v"], several=True, suffix=".csv")
    assert rows.rdd.getNumPartitions() == 6
    counts = {(r["file"][-5:], r["member"]): (r["n"], r["k"], r["v"]) for r in rows.groupBy("file", "member").agg(F.count("*").alias("n"), F.max(F.col("row")).alias("k"), F.min("v").alias("v")).collect()}
    assert counts == {(f"{a}.zip", f"t{m}.csv"): (n := 20_000 if m == 0 else 3, n, f"{a}\n{m}") for a in range(2) for m in range(3)}
    with pytest.raises(Exception, match="4 members, not one"):
        zips.zipped_csv(spark, f"{tmp_path}/0.zip", ["k"]).count()
    with pytest.raises(Exception, match="columns are missing: z"):
        zips.zipped_csv(spark, f"{tmp_path}/0.zip", ["k", "z"], several=True, suffix=".csv").count()
    assert zips.zipped_features(spark, f"{tmp_path}/0.zip").count() == 0


def test_batches_are_bounded():
    """A long member comes in many batches of about a chunk."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.csv", "k\n" + "".join(f"{'x' * 1000}{i}\n" for i in range(3000)))
    reader = zips.ZipReader({"kind": "csv"}, type("Schema", (), {"names": ["file", "member", "row", "k"]}))
    original, zips.opened = zips.opened, lambda path: io.BytesIO(held.getvalue())
    try:
        batches = list(reader.read(zips.Member("p", "a.csv")))
    finally:
        zips.opened = original
    assert len(batches) > 5 and max(b.nbytes for b in batches) < 2 * zips.CHUNK and sum(len(b) for b in batches) == 3000


@pytest.mark.parametrize("kind", ["csv", "features", "digest"])
def test_broken_members_raise(spark, tmp_path, kind):
    text = "k\r\n" + "abc\r\n" * 5000 if kind == "csv" else json.dumps({"features": [{"properties": {"k": i}, "geometry": None} for i in range(2000)], "after": "z" * 5000})
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("b", text)
    data = bytearray((tmp_path / "b.zip").read_bytes())
    at = data.index(b"abc") if kind == "csv" else data.index(b"zzzz")
    data[at + 1] ^= 1
    (tmp_path / "b.zip").write_bytes(data)
    with pytest.raises(Exception, match="(?i)crc"):
        zips._load(spark, f"{tmp_path}/b.zip", kind, "file string, member string, row long, k string" if kind == "csv" else None).collect()
