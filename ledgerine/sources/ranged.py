"""Files and members of archives by name: a task opens what its rows ask for and reads those ranges alone.

``opener`` gives a file that can seek; by default any store that pyarrow knows by its URI. Members of ZIP archives are found by the
directory at the archive's end, so of an archive of any size its directory and the wanted members are read, and nothing of it travels.
For stores that only Spark reads, ``readers.archive_members`` takes archives as bytes.
"""

from __future__ import annotations

import io
import re
import struct
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby, islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..session import kept

Opener = Callable[[str], object]
#: What an archive or a member may raise besides what a store does.
BAD = (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError)
#: MB of an archive that are one task's to read, and parts of an archive at most.
SPREAD, STRIPES = 32, 64


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path in it; Hadoop writes local files with one slash."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def opened(path: str):
    store, inner = located(path)
    return store.open_input_file(inner)


def _named(keys: list[str], types: list[str], more: str) -> str:
    return ", ".join([*(f"`{k}` {t}" for k, t in zip(keys, types, strict=True)), more])


def contents(rows: DataFrame, path: Column, keys: list[str], opener: Opener = opened, tasks: int | None = None) -> DataFrame:
    """``keys``, path, content and error: each row's file, null with the reason where it cannot be read or the path is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, at in enumerate(batch.column(batch.num_columns - 1).to_pylist()):  # a file may be large: a batch for each
                content, error = None, None
                try:
                    if at is None:
                        raise ValueError("no path")
                    with opener(at) as f:
                        content = f.read()
                except (OSError, ValueError, pa.ArrowException) as e:
                    error = f"{type(e).__name__}: {e}"
                own = batch.slice(i, 1).columns
                yield pa.RecordBatch.from_arrays([*own, pa.array([content], pa.binary()), pa.array([error], pa.string())], [*keys, "path", "content", "error"])

    given = rows.select(*keys, path.alias("path"))
    given = given.repartition(tasks) if tasks else given
    return given.mapInArrow(run, _named(keys, [rows.schema[k].dataType.simpleString() for k in keys], "path string, content binary, error string"))


# Directories of archives are streamed: zipfile holds an object for each member, and an archive may have millions.
RECORD = struct.Struct("<4s4xHH4xLLLHHHHHLL")  # of a directory: mark, flags, method, CRC, sizes stored and real, lengths of name, extra and comment, disk, two attributes, place
LOCAL = struct.Struct("<4s22xHH")  # before a member: mark, lengths of name and extra
CHUNK = 1 << 20
MANY, LARGE = 0xFFFF, 0xFFFFFFFF


def _bounds(f) -> tuple[int, int, int]:
    """(start, size, bytes before the archive) of the directory of an open archive."""
    n = f.seek(0, 2)
    low = max(0, n - 22 - MANY - 76)
    f.seek(low)
    tail = f.read(n - low)
    at = tail.rfind(b"PK\5\6", 0, max(0, len(tail) - 18))
    if at < 0:
        raise zipfile.BadZipFile("File is not a zip file")
    size, offset = struct.unpack_from("<LL", tail, at + 12)
    end = at
    if at >= 76 and tail[at - 20 : at - 16] == b"PK\6\7" and tail[at - 76 : at - 72] == b"PK\6\6":
        size, offset = struct.unpack_from("<QQ", tail, at - 36)
        end = at - 76
    before = low + end - size - offset
    if before < 0:
        raise zipfile.BadZipFile("Bad offset for central directory")
    return offset + before, size, before


def _records(f) -> Iterator[tuple]:
    """(name, place, length of mark and name there, size stored, size, method, flags, CRC) of each member, read by a chunk at a time."""
    start, left, before = _bounds(f)
    held, at = b"", 0
    while left or at < len(held):
        f.seek(start)
        more = f.read(min(CHUNK, left))
        start, left = start + len(more), left - len(more)
        held, at = held[at:] + more, 0
        full = len(held)
        while at + 46 <= full:
            mark, flags, method, crc, stored, size, names, extras, comments, _, _, _, place = RECORD.unpack_from(held, at)
            if mark != b"PK\1\2":
                raise zipfile.BadZipFile("Bad magic number for central directory")
            end = at + 46 + names + extras + comments
            if end > full:
                break
            raw = held[at + 46 : at + 46 + names]
            if extras:
                size, stored, place = _large(held[at + 46 + names : at + 46 + names + extras], size, stored, place)
            yield raw.decode("utf-8" if flags & 0x800 else "cp437").split("\0")[0], place + before, 30 + names, stored, size, method, flags, crc
            at = end
        if not more and at < len(held):
            raise zipfile.BadZipFile("Truncated central directory")


def _large(extra: bytes, size: int, stored: int, place: int) -> tuple[int, int, int]:
    """Sizes and place from the extra field where they do not fit the record."""
    at, own = 0, [size, stored, place]
    while at + 4 <= len(extra):
        tag, n = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            more = at + 4
            for k in range(3):
                if own[k] == LARGE:
                    if more + 8 > at + 4 + n:
                        raise zipfile.BadZipFile("Corrupt zip64 extra field")
                    own[k] = struct.unpack_from("<Q", extra, more)[0]
                    more += 8
        at += 4 + n
    return own[0], own[1], own[2]


def _unpacked(data: bytes, name: str, size: int, method: int, flags: int, crc: int) -> bytes:
    if method == zipfile.ZIP_DEFLATED and not flags & 0x61:
        out = zlib.decompressobj(-15).decompress(data, size) if size else b""
    elif method == zipfile.ZIP_STORED and not flags & 0x61:
        out = data[:size]
    else:
        if flags & 0x60:
            raise NotImplementedError("patched data or strong encryption")
        if flags & 1:
            raise RuntimeError(f"File {name!r} is encrypted, password required for extraction")
        info = zipfile.ZipInfo(name)
        info.compress_type, info.compress_size, info.file_size, info.CRC, info.flag_bits = method, len(data), size, crc, flags
        return zipfile.ZipExtFile(io.BytesIO(data), "r", info).read()
    if len(out) < size:
        raise EOFError(f"{name!r} ends early")
    if zlib.crc32(out) != crc:
        raise zipfile.BadZipFile(f"Bad CRC-32 for file {name!r}")
    return out


class _Archive:
    """The archive that was asked for last stays open."""

    def __init__(self, opener: Opener):
        self.opener, self.path, self.file, self.error = opener, None, None, None

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.file = None

    def at(self, path: str):
        if path != self.path:
            self.close()
            self.path, self.error = path, None
            try:
                self.file = self.opener(path)
            except (OSError, ValueError, pa.ArrowException) as e:
                self.error = f"{type(e).__name__}: {e}"
        return self.file

    def contents(self, path: str, wanted: list[tuple]) -> list[tuple[bytes | None, str | None]]:
        """Members (as ``_records`` gives them) by their places, those that stand close to each other by one range."""
        if (f := self.at(path)) is None:
            return [(None, self.error)] * len(wanted)
        out: list = [None] * len(wanted)
        order, k = sorted(range(len(wanted)), key=lambda i: wanted[i][1]), 0
        end = lambda i: wanted[i][1] + wanted[i][2] + wanted[i][3] + SLACK
        while k < len(order):
            low, high, last = wanted[order[k]][1], end(order[k]), k + 1
            while last < len(order) and wanted[order[last]][1] <= high + GAP and end(order[last]) - low <= BLOCK:
                high, last = max(high, end(order[last])), last + 1
            try:
                f.seek(low)
                block = f.read(high - low)
            except (OSError, ValueError, pa.ArrowException) as e:
                block, failed = None, f"{type(e).__name__}: {e}"
            for i in order[k:last]:
                out[i] = (None, failed) if block is None else self._member(f, block, low, wanted[i])
            k = last
        return out

    @staticmethod
    def _member(f, block: bytes, low: int, wanted: tuple) -> tuple[bytes | None, str | None]:
        name, place, _, stored, size, method, flags, crc = wanted
        try:
            if len(block) < place - low + 30:
                raise EOFError(f"{name!r} ends early")
            mark, names, extras = LOCAL.unpack_from(block, place - low)
            if mark != b"PK\3\4":
                raise zipfile.BadZipFile("Bad magic number for file header")
            start = place - low + 30 + names + extras
            data = block[start : start + stored]
            if len(data) < stored:  # what stands before the data is longer than thought
                f.seek(low + start)
                data = f.read(stored)
            raw = block[place - low + 30 : place - low + 30 + names]
            if len(raw) == names and raw.decode("utf-8" if flags & 0x800 else "cp437", "replace").split("\0")[0] != name:
                raise zipfile.BadZipFile(f"File name in directory {name!r} and header differ.")
            return _unpacked(data, name, size, method, flags, crc), None
        except (OSError, ValueError, *BAD) as e:
            return None, f"{type(e).__name__}: {e}"


def _gathered(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], content: int) -> Iterator[pa.RecordBatch]:
    """Batches of 2,000 rows, or fewer where the contents are large."""
    held, size = [], 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
    for row in rows:
        held.append(row)
        size += len(row[content] or b"")
        if len(held) == 2000 or size > BATCH:
            yield make()
            held, size = [], 0
    if held:
        yield make()


SLACK, GAP, BLOCK, BATCH = 64, 1 << 16, 8 << 20, 16 << 20
_PLACE = {"place": "bigint", "head": "bigint", "stored": "bigint", "real": "bigint", "method": "int", "flags": "int", "crc": "bigint"}


def _checked(archives: DataFrame, opener: Opener) -> DataFrame:
    """(archive, _bad): why an archive cannot be opened or its directory cannot be read, null if it can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = []
            for path in batch.column(0).to_pylist():
                error = None
                try:
                    with opener(path) as f:
                        for _ in _records(f):
                            pass
                except (OSError, ValueError, pa.ArrowException, *BAD) as e:
                    error = f"{type(e).__name__}: {e}"
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(errors, pa.string())], ["archive", "_bad"])

    return archives.mapInArrow(run, "archive string, _bad string")


def _listed(archives: DataFrame, opener: Opener) -> DataFrame:
    """(archive, member, _at, where and how it is stored) of the members of archives; ``_at`` counts them."""
    names, types = ["archive", "member", "_at", *_PLACE], [pa.string(), pa.string(), pa.int64(), *(pa.int32() if x == "int" else pa.int64() for x in _PLACE.values())]

    def members_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opener(path) as f:
                    for i, (name, *more) in enumerate(_records(f)):
                        yield path, name, i, *more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = members_of(batches)
        while own := list(islice(held, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own, strict=True), types, strict=True)], names)

    return archives.mapInArrow(run, ", ".join(["archive string, member string, _at bigint", *(f"{k} {v}" for k, v in _PLACE.items())]))


def members(rows: DataFrame, archive: Column, member: Column, keys: list[str], opener: Opener = opened, spread: int = SPREAD) -> DataFrame:
    """``keys``, archive, member, content and error for each row: null content with the reason where there is no such member.

    The directories of the archives are streamed, an archive by a task, and meet the rows in a join; of members with one name the last counts. Rows are then dealt out by
    ranges of ``spread`` MB of an archive and sorted by place, so a large archive is many tasks' and no task holds a directory.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = _Archive(opener)
        try:
            for batch in batches:
                n = len(keys)
                own = list(zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True)) if batch.num_rows else []
                for path, group in groupby(own, key=lambda x: x[n]):
                    group = list(group)
                    there = [x for x in group if x[n + 3] is not None]
                    read, at = held.contents(path, [x[n + 1 : n + 2] + x[n + 3 :] for x in there]) if there else [], 0
                    for x in group:
                        if x[n + 3] is not None:
                            yield *x[: n + 2], *read[at]
                            at += 1
                        else:
                            yield *x[: n + 2], None, "no archive or member named" if path is None or x[n + 1] is None else x[n + 2] or "no such member"
        finally:
            held.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            types = [*(first.schema.field(k).type for k in range(len(keys) + 2)), pa.binary(), pa.string()]
            yield from _gathered(found(small for batch in chain([first], batches) for small in (batch.slice(lo, 500) for lo in range(0, batch.num_rows, 500))), [*keys, "archive", "member", "content", "error"], types, len(keys) + 2)

    tasks = rows.sparkSession.sparkContext.defaultParallelism
    given = rows.select(*keys, archive.alias("archive"), member.alias("member"))
    heads = kept(_checked(given.select("archive").where("archive is not null").distinct().repartition(tasks), opener))
    listed = _listed(heads.where("_bad is null").select("archive").repartition(tasks), opener)
    last = listed.groupBy("archive", "member").agg(F.max(F.struct("_at", *_PLACE)).alias("_p")).select("archive", "member", *[F.col(f"_p.{k}").alias(k) for k in _PLACE])
    met = given.join(heads.where("_bad is not null"), "archive", "left").join(last.hint("merge"), ["archive", "member"], "left").select(*keys, "archive", "member", "_bad", *_PLACE)  # the directories are thought as small as the list of archives, and would be broadcast
    part = F.coalesce(F.floor(F.col("place") / (spread << 20)), F.pmod(F.xxhash64("member"), F.lit(1024)))
    dealt = met.withColumn("_part", part).repartition("archive", "_part").sortWithinPartitions("archive", "place").drop("_part")
    return dealt.mapInArrow(run, _named(keys, [rows.schema[k].dataType.simpleString() for k in keys], "archive string, member string, content binary, error string"))


# Archives as a data source ----------------------------------------------------------------------------------------------


@dataclass
class Stripe(InputPartition):
    """The members of an archive whose data begin in a range of its bytes."""

    archive: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class Archives(DataSource):
    """``spark.read.format("zip_members").load(folder)``: archive, member, size, content, error of all archives below a folder (or one archive).

    Options: ``stripeBytes`` (64 MB), the part of an archive that is one partition, more in archives of over 64 such parts, as each streams the directory;
    ``content`` ("false": members are listed and not read, an archive by a task).
    Writing takes rows of archive (a file name), member and content; rows of one archive must stand together in one partition, as ``write_archives`` puts them.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, member string, size bigint, content binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(self.options["path"], int(self.options.get("stripeBytes", 64_000_000)), self.options.get("content", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _ArchiveWriter(self.options["path"], overwrite)


class _ArchiveReader(DataSourceReader):
    def __init__(self, path: str, stripe: int, content: bool):
        if stripe < 1:
            raise ValueError("a stripe holds a byte at least")
        self.path, self.stripe, self.content = path, stripe, content

    def partitions(self) -> list[Stripe]:
        store, inner = located(self.path)
        info = store.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [x for x in store.get_file_info(fs.FileSelector(inner, recursive=True)) if x.is_file and x.base_name.lower().endswith(".zip") and "/_" not in x.path[len(inner) :]]
        base = self.path.rstrip("/")
        uri = lambda x: base + x.path[len(inner.rstrip("/")) :]
        step = lambda n: max(self.stripe, -(-n // STRIPES)) if self.content else n + 1
        return [Stripe(uri(x), lo, lo + step(x.size)) for x in sorted(found, key=lambda x: x.path) for lo in range(0, max(1, x.size), step(x.size))]

    def read(self, part: Stripe) -> Iterator[pa.RecordBatch]:
        return _gathered(self._members(part), ["archive", "member", "size", "content", "error"], [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()], 3)

    def _members(self, part: Stripe) -> Iterator[tuple]:
        held = _Archive(opened)
        try:
            if (f := held.at(part.archive)) is None:
                if part.start == 0:
                    yield part.archive, None, None, None, held.error
                return
            own = (x for x in _records(f) if part.start <= x[1] < part.end and not x[0].endswith("/"))
            while some := list(islice(own, 500)):
                read = held.contents(part.archive, some) if self.content else [(None, None)] * len(some)
                for x, (content, error) in zip(some, read, strict=True):
                    yield part.archive, x[0], x[4], content, error
        except (OSError, ValueError, pa.ArrowException, *BAD) as e:
            if part.start == 0:
                yield part.archive, None, None, None, f"{type(e).__name__}: {e}"
        finally:
            held.close()


class _Zip:
    """An archive as it is written: members go out at once, and the directory waits in a file."""

    def __init__(self, out):
        self.out, self.at, self.n, self.directory = out, 0, 0, tempfile.TemporaryFile(buffering=CHUNK)

    def add(self, name: str, content: bytes) -> None:
        raw, flags = (name.encode(), 0) if name.isascii() else (name.encode(), 0x800)
        if len(raw) > MANY:
            raise ValueError(f"too long for the name of a member: {name[:100]!r}")
        deflate = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -15)
        data = deflate.compress(content) + deflate.flush()
        own = struct.pack("<HHHHHLLLHH", 20, flags, zipfile.ZIP_DEFLATED, 0, 33, zlib.crc32(content), len(data), len(content), len(raw), 0)  # 33: the first of January 1980
        self.out.write(b"PK\3\4" + own + raw + data)
        extra = struct.pack("<HHQ", 1, 8, self.at) if self.at >= LARGE else b""
        version = struct.pack("<BBB", 45, 3, 45) if extra else struct.pack("<BBB", 20, 3, 20)
        self.directory.write(b"PK\1\2" + version + b"\0" + own[2:24] + struct.pack("<HHHHLL", len(extra), 0, 0, 0, 0o600 << 16, min(self.at, LARGE)) + raw + extra)
        self.at += 30 + len(raw) + len(data)
        self.n += 1

    def close(self) -> None:
        size = self.directory.tell()
        self.directory.seek(0)
        while some := self.directory.read(CHUNK):
            self.out.write(some)
        self.directory.close()
        if self.n >= MANY or size >= LARGE or self.at >= LARGE:
            self.out.write(b"PK\6\6" + struct.pack("<QHHLLQQQQ", 44, 45, 45, 0, 0, self.n, self.n, size, self.at) + b"PK\6\7" + struct.pack("<LQL", 0, self.at + size, 1))
        self.out.write(b"PK\5\6" + struct.pack("<HHHHLLH", 0, 0, min(self.n, MANY), min(self.n, MANY), min(size, LARGE), min(self.at, LARGE), 0))
        self.out.close()


class _ArchiveWriter(DataSourceArrowWriter):
    """Archives are written aside and move to their names when all tasks are done."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.aside = path.rstrip("/"), overwrite, f"_temporary-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, inner = located(self.path)
        aside = f"{inner}/{self.aside}/{uuid.uuid4().hex}"
        store.create_dir(aside)
        moves, last, out = [], None, None
        try:
            for batch in batches:
                for name, member, content in zip(*(batch.column(k).to_pylist() for k in ("archive", "member", "content")), strict=True):
                    if out is None or name != last:
                        if out is not None:
                            out.close()
                        last = name
                        if not name or "/" in name:
                            raise ValueError(f"no name of a file: {name!r}")
                        moves.append((f"{aside}/{name}", f"{inner}/{name}"))
                        out = _Zip(store.open_output_stream(moves[-1][0], buffer_size=CHUNK))
                    out.add(member, content or b"")
        finally:
            if out is not None:
                out.close()
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        store, inner = located(self.path)
        moves = [m for x in messages if x is not None for m in x.moves]
        if len({to for _, to in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("an archive stands in more than one partition")
        if self.overwrite:
            for x in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
                if x.is_file:
                    store.delete_file(x.path)
        for source, to in moves:
            store.move(source, to)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, inner = located(self.path)
        if store.get_file_info(f"{inner}/{self.aside}").type == fs.FileType.Directory:
            store.delete_dir(f"{inner}/{self.aside}")


def write_archives(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Rows of archive, member and content as ZIP archives of a folder; members stand in the order of their names."""
    rows.sparkSession.dataSource.register(Archives)
    given = rows.select("archive", "member", F.octet_length("content").cast("bigint").alias("size"), F.col("content").cast("binary").alias("content"), F.lit(None).cast("string").alias("error"))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a count that is named is kept: small archives would share a task
    given.repartition(tasks, "archive").sortWithinPartitions("archive", "member").write.format("zip_members").mode(mode).save(path)


def read_archives(spark, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(Archives)
    return spark.read.format("zip_members").options(**options).load(path)
