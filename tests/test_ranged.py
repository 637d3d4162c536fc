"""Members of archives and files by name."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerine.sources import ranged, readers


def archive(path, members, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, data in members:
            z.writestr(name, data)


def counting():
    """An opener that notes in a file beside each archive how many bytes are read; made here, as workers do not know this module."""

    class Counted(io.FileIO):
        def read(self, n=-1):
            data = super().read(n)
            with open(f"{self.name}.read", "a") as f:
                f.write(f"{len(data)}\n")
            return data

    return lambda path: Counted(path)


def test_members_by_ranges(spark, tmp_path):
    big = [(f"m{i:04d}", bytes([i % 251]) * 20_000) for i in range(1000)]
    archive(tmp_path / "a.zip", big, zipfile.ZIP_STORED)
    archive(tmp_path / "b.zip", [("x", b"1"), ("dir/y", b"2")])
    (tmp_path / "c.zip").write_bytes(b"no archive")
    wanted = [(1, f"{tmp_path}/a.zip", "m0007"), (2, f"file:{tmp_path}/a.zip", "m0999"), (3, f"{tmp_path}/b.zip", "dir/y"), (4, f"{tmp_path}/b.zip", "z"), (5, f"{tmp_path}/c.zip", "x"), (6, f"{tmp_path}/d.zip", "x"), (7, None, "x"), (8, f"{tmp_path}/b.zip", None), (3, f"{tmp_path}/b.zip", "dir/y")]
    rows = spark.createDataFrame(wanted, "k int, a string, m string")
    found = {r["k"]: r for r in ranged.members(rows, F.col("a"), F.col("m"), ["k"]).collect()}
    assert [found[k]["content"] for k in (1, 2, 3)] == [bytes([7]) * 20_000, bytes([999 % 251]) * 20_000, b"2"]
    assert found[4]["error"] == "no such member" and found[6]["error"].startswith("FileNotFoundError")
    assert all(found[k]["content"] is None and found[k]["error"] for k in (4, 5, 6, 7, 8)) and ranged.members(rows.limit(0), F.col("a"), F.col("m"), ["k"]).count() == 0
    own = spark.createDataFrame([(f"{tmp_path}/a.zip", f"m{i:04d}") for i in range(20)], "a string, m string")
    got = ranged.members(own, F.col("a"), F.col("m"), [], opener=counting(), spread=1).select(F.sum(F.octet_length("content"))).first()[0]
    read = sum(map(int, (tmp_path / "a.zip.read").read_text().split()))
    assert got == 400_000 and read < 1_500_000 < (tmp_path / "a.zip").stat().st_size == pytest.approx(20_100_000, rel=0.01)


def test_contents_by_path(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    rows = spark.createDataFrame([(1, f"{tmp_path}/x"), (2, f"{tmp_path}/y"), (3, None)], "k int, p string")
    found = {r["k"]: (r["content"], (r["error"] or "").split(":")[0]) for r in ranged.contents(rows, F.col("p"), ["k"], tasks=2).collect()}
    assert found == {1: (b"abc", ""), 2: (None, "FileNotFoundError"), 3: (None, "ValueError")}


def test_archives_are_a_source_and_a_sink(spark, tmp_path):
    rows = spark.range(500).select(F.format_string("a%d.zip", F.col("id") % 3).alias("archive"), F.format_string("f/%03d.txt", "id").alias("member"), F.repeat(F.col("id").cast("string"), 400).alias("content"))
    ranged.write_archives(rows, f"{tmp_path}/out")
    for stripe in ("64000000", "3000", "1"):
        found = ranged.read_archives(spark, f"{tmp_path}/out", stripeBytes=stripe) if stripe != "1" else ranged.read_archives(spark, f"{tmp_path}/out/a1.zip", stripeBytes="5000")
        got = sorted((r["archive"].rsplit("/", 1)[1], r["member"], r["size"], bytes(r["content"]).decode()) for r in found.where("error is null").collect())
        want = sorted((r["archive"], r["member"], len(r["content"]), r["content"]) for r in rows.collect() if stripe != "1" or r["archive"] == "a1.zip")
        assert got == want and (stripe != "3000" or found.rdd.getNumPartitions() > 9)
    listed = ranged.read_archives(spark, f"{tmp_path}/out", content="false")
    assert listed.agg(F.count("*"), F.count("content"), F.sum("size")).first()[0:2] == (500, 0)
    ranged.write_archives(rows.where("archive = 'a2.zip'").limit(5), f"{tmp_path}/out")  # replaces one
    assert ranged.read_archives(spark, f"{tmp_path}/out").count() == 500 - 166 + 5
    ranged.write_archives(rows.limit(7), f"{tmp_path}/out", "overwrite")
    assert ranged.read_archives(spark, f"{tmp_path}/out").count() == 7 and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
    (tmp_path / "out" / "bad.zip").write_bytes(b"x")
    assert ranged.read_archives(spark, f"{tmp_path}/out").where("error is not null").count() == 1
    with pytest.raises(Exception, match="more than one partition"):
        one = rows.where("archive = 'a1.zip'").select("archive", "member", F.lit(1).cast("bigint").alias("size"), F.col("content").cast("binary"), F.lit("").alias("error"))
        one.repartition(3).write.format("zip_members").mode("append").save(f"{tmp_path}/two")
    with pytest.raises(Exception, match="FileNotFound"):
        ranged.read_archives(spark, f"{tmp_path}/none").count()


def test_whole_archives_are_opened_once(spark, tmp_path):
    archive(tmp_path / "a.zip", [(f"m{i}", str(i)) for i in range(50)])
    wanted = spark.createDataFrame([(f"{tmp_path}/a.zip", f"m{i}") for i in range(60)] + [(f"{tmp_path}/b.zip", "x"), (f"{tmp_path}/a.zip", None)], "zip_path string, member string")
    files = readers.documents(spark, str(tmp_path)).withColumn("path", F.regexp_replace("path", "^file:", ""))
    found = readers.archive_members(wanted, files)
    assert "binary" not in [t for c, t in wanted.dtypes] and found.count() == 62
    assert sorted((r["member"] or "", bytes(r["content"]).decode()) for r in found.where("content is not null").collect()) == sorted((f"m{i}", str(i)) for i in range(50))


def test_directories_are_streamed(spark, tmp_path):
    """A listing reads each directory once, whatever the stripes, and no member of it is kept."""
    rows = spark.range(3000).select(F.format_string("a%d.zip", F.col("id") % 3).alias("archive"), F.format_string("f/é%04d.txt", "id").alias("member"), F.col("id").cast("string").alias("content"))
    ranged.write_archives(rows, f"{tmp_path}/out")
    listed = ranged.read_archives(spark, f"{tmp_path}/out", stripeBytes="1000", content="false")
    assert listed.rdd.getNumPartitions() == 3 and listed.count() == 3000
    assert ranged.read_archives(spark, f"{tmp_path}/out", stripeBytes="1").rdd.getNumPartitions() <= 3 * (ranged.STRIPES + 1)
    with zipfile.ZipFile(tmp_path / "out" / "a1.zip") as own, open(tmp_path / "out" / "a1.zip", "rb") as f:
        assert own.testzip() is None and [x[:2] for x in ranged._records(f)] == [(x.filename, x.header_offset) for x in own.infolist()]


def test_the_last_member_of_a_name_and_every_method(spark, tmp_path):
    for k, method in enumerate((zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA)):
        archive(tmp_path / f"{k}.zip", [("x", b"first"), ("é", b"y" * 100), ("x", b"last")], method)
    data = bytearray((tmp_path / "0.zip").read_bytes())
    data[31 + 0] ^= 1  # the first byte of a member that no name leads to
    (tmp_path / "0.zip").write_bytes(data)
    wanted = spark.createDataFrame([(f"{tmp_path}/{k}.zip", m) for k in range(4) for m in ("x", "é", "x")], "a string, m string")
    found = [bytes(r["content"]) for r in ranged.members(wanted, F.col("a"), F.col("m"), []).collect()]
    assert sorted(found) == [b"last"] * 8 + [b"y" * 100] * 4


def test_directories_are_not_broadcast(spark, tmp_path):
    """What meets the rows grows with the archives' members, so it passes by no driver."""
    archive(tmp_path / "a.zip", [(f"m{i}", str(i)) for i in range(50)])
    rows = spark.createDataFrame([(i, f"{tmp_path}/a.zip", f"m{i}") for i in range(60)], "id int, a string, m string")
    found = ranged.members(rows, F.col("a"), F.col("m"), ["id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [archive" in plan and plan.count("BroadcastExchange") == 1  # archives that cannot be read
    got = {r["id"]: (r["content"], r["error"]) for r in found.collect()}
    assert got == {i: (str(i).encode(), None) if i < 50 else (None, "no such member") for i in range(60)}
