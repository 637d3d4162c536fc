"""Keyed tables on Parquet: upserts, staleness, lists, the search corpus."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions.identity import facts_key
from ..functions.records import conformed
from ..schemas import FACTS, FILING, SUBMISSIONS

#: The two unique keys of filings.
FILING_KEYS = (["accession_number"], ["cik", "form_name"])
#: The tables and the columns of their keys; a row replaces those that agree in any of them.
TABLES: dict[str, tuple[list[str], ...]] = {"submissions": (["cik"],), "filings": FILING_KEYS, "facts": (["id"],), "irs_returns": (["ein"],), "answers": (["url"],), "search_cache": (), "postings": (), "corpus_size": ()}
#: Columns of the tables that have fixed ones, as ``Store.create`` makes them.
_TIMES = "created_at timestamp, updated_at timestamp"
SCHEMAS = {
    "submissions": f"{SUBMISSIONS}, created_at timestamp", "filings": f"accession_number string, cik string, form_name string, filing {FILING}, document binary, filing_date string, created_at timestamp",
    "facts": f"id string, source_type string, {FACTS}, {_TIMES}", "irs_returns": f"ein string, return_type string, tax_year int, xml string, {_TIMES}",
    "answers": "url string, content binary, error string, asked_at timestamp", "search_cache": f"title string, path string, source_type string, {_TIMES}",
}
MAX_AGE_DAYS = 30
#: Characters of a term by which its postings are put into files.
LETTERS = 2


def first_letters(term: str) -> str:
    """The bucket of a term: its first characters in hexadecimal digits."""
    return term[:LETTERS].encode().hex().upper()


def last_wins(batch: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Within a batch the row of largest ``order`` per key."""
    rest = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*").select(*batch.columns)


def upsert(old: DataFrame, new: DataFrame, *keys: list[str]) -> DataFrame:
    """``new`` (one row a key) replaces old rows that agree in any of the keys."""
    kept = reduce(lambda df, key: df.join(new.select(*key).distinct(), key, "left_anti"), keys, old)
    return kept.unionByName(new)


def last_of_batch(batch: DataFrame, keys: tuple[list[str], ...], order: Column) -> DataFrame:
    """Rows that no later row of the whole batch agrees with in any of the keys: what is left if each row replaces those before it."""
    names = batch.columns
    rows = batch.dropDuplicates().withColumn("_order", F.struct(order.alias("by"), F.xxhash64(*names).alias("tie")))
    for key in keys:
        rows = rows.join(batch.withColumn("_order", F.struct(order.alias("by"), F.xxhash64(*names).alias("tie"))).groupBy(*key).agg(F.max("_order").alias("_last")), key)
        rows = rows.withColumn("_stays", F.coalesce(F.col("_stays"), F.lit(True)) & (F.col("_order") == F.col("_last")) if "_stays" in rows.columns else F.col("_order") == F.col("_last")).drop("_last")
    return rows.where("_stays").select(*names)


def filings_upsert(old: DataFrame | None, new: DataFrame, order: Column) -> DataFrame:
    """Rows are replaced on either unique key, one after the other: a row of the batch stays if it is the last on both, an old row if no row of the batch shares a key."""
    last = last_of_batch(new, FILING_KEYS, order)
    if old is None:
        return last
    return reduce(lambda df, key: df.join(new.select(*key).distinct(), key, "left_anti"), FILING_KEYS, old).select(*new.columns).unionByName(last)


def facts_rows(facts: DataFrame, strict: bool = True, now: Column | None = None) -> DataFrame:
    """Facts with id and source_type; neither a CIK nor an EIN is an error, or dropped unless ``strict``. With ``now``, created_at and updated_at too: a replaced row begins anew."""
    out = facts.withColumn("k", facts_key(F.col("cik"), F.col("ein"))).select("k.*", *facts.columns)
    out = out if now is None else out.withColumns({"created_at": now, "updated_at": now})
    if not strict:
        return out.where("id is not null")
    return out.withColumn("id", F.coalesce("id", F.raise_error(F.lit("facts need a CIK or an EIN")).cast("string")))


def stale(ids: DataFrame, table: DataFrame, key: str, now: Column, days: int = MAX_AGE_DAYS) -> DataFrame:
    """(key, stale): no row, no time, or older than ``days`` days; exactly that age is fresh."""
    age = now - F.col("updated_at")
    joined = ids.join(table.groupBy(key).agg(F.max("updated_at").alias("updated_at")), key, "left")
    return joined.select(key, F.coalesce(age > F.expr(f"interval {int(days)} days"), F.lit(True)).alias("stale"))


def ids_of(facts: DataFrame, source: str) -> DataFrame:
    return facts.where(F.col("source_type") == source).orderBy("company_name", "id").select("id")


def ciks(filings: DataFrame) -> DataFrame:
    return filings.select("cik").distinct()


def eins(returns: DataFrame) -> DataFrame:
    return returns.select("ein").distinct().orderBy("ein")


def filings_of(filings: DataFrame, cik: str) -> DataFrame:
    return filings.where(F.col("cik") == cik).orderBy(F.desc("filing_date"), "accession_number")


class Store:
    """Tables below a folder, in buckets by the hashes of their keys. A version is a file that lists the folders of each bucket.

    A write puts its rows beside the others and then creates the next version's file, so readers and failed jobs never see half a
    write. An upsert rewrites the buckets that its batch touches; the next version lists the others' folders as they are. Tables
    with two keys have a bucket for each pair of hashes, and a batch touches the rows and the columns of that square. A file is created
    only where there is none (which the store must grant), so of two writers that began with one version the later fails, and no rows
    are lost silently. A version remembers the last number of each numbered source of batches; a batch that comes again adds nothing.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        if buckets < 1:
            raise ValueError("a table has a bucket at least")
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _list(self, *parts: str) -> list[str]:
        fs, path = self._path(*parts)
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def _load(self, table: str, name: str) -> dict | None:
        fs, path = self._path(table, name)
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        except ValueError:  # its writer has not finished it
            return None
        finally:
            stream.close()

    def versions(self, table: str) -> list[str]:
        """Names of all versions, the last one at the end."""
        return [n for n in self._list(table) if n.endswith(".json")]

    def _last(self, table: str) -> tuple[str | None, dict | None]:
        for name in reversed(self.versions(table)):
            if (found := self._load(table, name)) is not None:
                return name, found
        return None, None

    def _commit(self, table: str, base: str | None, version: dict) -> None:
        name = f"v{int(base[1:10]) + 1 if base else 0:09d}.json"
        fs, path = self._path(table, name)
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            raise RuntimeError(f"another writer changed {table}") from e
        out.write(bytearray(json.dumps(version).encode()))
        out.close()

    def _buckets(self, table: str, n: int) -> dict[str, Column]:
        if table == "postings":
            return {"bucket_0": F.hex(F.encode(F.substring("term", 1, LETTERS), "UTF-8"))}
        return {f"bucket_{i}": F.pmod(F.xxhash64(*key), F.lit(n)).cast("int") for i, key in enumerate(TABLES[table])} or {"bucket_0": F.lit(0)}

    def _put(self, table: str, df: DataFrame, n: int) -> dict[str, list[str]]:
        """Writes rows by bucket; the new folder of each bucket that has any."""
        folder, cells = f"data/{uuid.uuid4().hex}", self._buckets(table, n)
        df.withColumns(cells).hint("rebalance", *cells).write.partitionBy(*cells).parquet(f"{self.root}/{table}/{folder}")
        found = [[folder]]
        for _ in cells:
            found = [[*p, name] for p in found for name in self._list(table, *p) if name.startswith("bucket_")]
        return {".".join(x.split("=")[1] for x in p[1:]): ["/".join(p)] for p in found}

    def _rows(self, table: str, version: dict, cells: list[str]) -> DataFrame:
        schema = StructType.fromJson(version["schema"])
        paths = [f"{self.root}/{table}/{p}" for c in sorted(cells) for p in version["buckets"].get(c, ())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, table: str, name: str | None = None) -> DataFrame | None:
        """The last version, or the one of a name; None if there is none."""
        version = self._load(table, name) if name else self._last(table)[1]
        return None if version is None else self._rows(table, version, list(version["buckets"]))

    def create(self, table: str) -> None:
        """An empty table with its fixed columns, unless there is a table. Rows that come later are brought into them; a column that they have not is an error."""
        if self._last(table)[1] is None:
            self._commit(table, None, {"n": self.buckets, "schema": _parse_datatype_string(SCHEMAS[table]).jsonValue(), "buckets": {}, "batches": {}})

    def write(self, table: str, df: DataFrame, base: str | None = None) -> None:
        """The whole table anew, made from version ``base`` (the last one unless given)."""
        last, old = self._last(table)
        n = old["n"] if old else self.buckets
        self._commit(table, base or last, {"n": n, "schema": df.schema.jsonValue(), "buckets": self._put(table, df, n), "batches": old["batches"] if old else {}})

    def _seen(self, old: dict | None, batch: tuple[str, int] | None) -> bool:
        return bool(old and batch and old["batches"].get(batch[0], -1) >= batch[1])

    def append(self, table: str, df: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Adds rows; nothing is read or rewritten. Rows that are there already are added again, but for a ``batch`` (source, number) that was added before."""
        base, old = self._last(table)
        if self._seen(old, batch):
            return
        if old is None:
            old = {"n": self.buckets, "schema": df.schema.jsonValue(), "buckets": {}, "batches": {}}
        new = self._put(table, conformed(df, StructType.fromJson(old["schema"])), old["n"])
        buckets = {c: [*old["buckets"].get(c, ()), *new.get(c, ())] for c in {*old["buckets"], *new}}
        self._commit(table, base, old | {"buckets": buckets, "batches": old["batches"] | (dict([batch]) if batch else {})})

    def clear(self, table: str) -> None:
        """An empty version, if there is a table."""
        base, old = self._last(table)
        if old is not None:
            self._commit(table, base, old | {"buckets": {}})

    def store(self, table: str, new: DataFrame, order: Column | None = None, batch: tuple[str, int] | None = None) -> None:
        """Replaces rows by key; of a batch the last by ``order``. Only buckets that the batch touches are read and written."""
        base, old = self._last(table)
        if self._seen(old, batch):
            return
        keys, order = TABLES[table], F.lit(0) if order is None else order
        new = last_of_batch(new, keys, order) if len(keys) > 1 else last_wins(new, keys[0], order)
        if old is None:
            n, names, gone = self.buckets, new.columns, []
            out = new
        else:
            n, names = old["n"], StructType.fromJson(old["schema"]).names
            new = conformed(new, StructType.fromJson(old["schema"]))
            cells = self._buckets(table, n)
            touched = new.select(*cells.values()).distinct().collect()  # n at most, or its square
            hit = [{str(r[i]) for r in touched} for i in range(len(cells))]
            gone = [c for c in old["buckets"] if any(x in h for x, h in zip(c.split("."), hit, strict=True))]
            out = upsert(self._rows(table, old, gone), new, *keys).select(*names)
        buckets = {c: p for c, p in (old["buckets"] if old else {}).items() if c not in gone} | self._put(table, out, n)
        self._commit(table, base, {"n": n, "schema": old["schema"] if old else out.schema.jsonValue(), "buckets": buckets, "batches": (old["batches"] if old else {}) | (dict([batch]) if batch else {})})

    def rebucket(self, table: str, buckets: int) -> None:
        """The same rows in another number of buckets, as a table grows."""
        base, old = self._last(table)
        if old is not None:
            out = self._put(table, self._rows(table, old, list(old["buckets"])), buckets)
            self._commit(table, base, old | {"n": buckets, "buckets": out})

    def vacuum(self, table: str, keep: int = 2) -> None:
        """Removes all but the last ``keep`` versions and the folders that only those removed list. Readers of removed versions fail."""
        names = self.versions(table)
        loaded = [(n, self._load(table, n) or {"buckets": {}}) for n in names]
        folders = lambda found: {"/".join(p.split("/")[:2]) for _, v in found for ps in v["buckets"].values() for p in ps}
        old, kept = loaded[: max(0, len(names) - max(1, keep))], loaded[max(0, len(names) - max(1, keep)) :]
        for name, _ in old:
            fs, path = self._path(table, name)
            fs.delete(path, False)
        for folder in folders(old) - folders(kept):
            fs, path = self._path(table, folder)
            fs.delete(path, True)

    def rows_where(self, table: str, wanted: Callable[[str], bool]) -> DataFrame | None:
        """Rows of the last version in the buckets whose name is wanted; None without a version."""
        version = self._last(table)[1]
        return None if version is None else self._rows(table, version, [c for c in version["buckets"] if wanted(c)])

    def _lookup(self, table: str, which: int, values: list[str]) -> DataFrame | None:
        """Rows of a key, from its bucket alone."""
        version = self._last(table)[1]
        if version is None:
            return None
        marks = ", ".join(f":k{i}" for i in range(len(values)))
        own = str(self.spark.sql(f"select pmod(xxhash64({marks}), {int(version['n'])}) as b", args={f"k{i}": v for i, v in enumerate(values)}).first()["b"])
        rows = self._rows(table, version, [c for c in version["buckets"] if c.split(".")[which] == own])
        return rows.where(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(TABLES[table][which], values, strict=True)]))

    def matching(self, table: str, keys: DataFrame) -> DataFrame | None:
        """Rows of the table's first key that ``keys`` holds, a column of the same name; only their buckets are read."""
        version = self._last(table)[1]
        if version is None:
            return None
        name = TABLES[table][0][0]
        touched = {str(r[0]) for r in keys.select(F.pmod(F.xxhash64(name), F.lit(version["n"]))).distinct().collect()}  # n at most
        return self._rows(table, version, [c for c in version["buckets"] if c.split(".")[0] in touched]).join(keys.select(name).distinct(), name, "left_semi")

    def get(self, table: str, key: str) -> DataFrame:
        """The row of a key; LookupError without one."""
        found = self._lookup(table, 0, [key])
        if found is None or found.isEmpty():
            raise LookupError(f"{table}: no {key}")
        return found

    def get_filing(self, cik: str, form: str) -> DataFrame:
        """The filing of an organisation and form; LookupError without one."""
        found = self._lookup("filings", 1, [cik, form])
        if found is None or found.isEmpty():
            raise LookupError(f"filings: no {form} of {cik}")
        return found
