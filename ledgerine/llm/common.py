"""Pieces shared by the training-data operators.

* Row identity: ``doc_id`` (or the given id column). A null id counts as one document whose id is smaller than all others;
  rows that repeat an id are the same document for decisions that name documents, and each of them is returned.
* Scratch tables: lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it again, so a lost executor
  costs a reread and never a recomputation of earlier rounds.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside the operators.
NULL_ID = -(2**63)

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLD = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _own_folder() -> str:
    out = tempfile.mkdtemp(prefix="ledgerine-scratch-")
    atexit.register(shutil.rmtree, out, ignore_errors=True)
    return out


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. A temporary one, deleted at exit, only where the setting is absent and all tasks run on the driver's machine."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


#: Bounds of what is in hand at once, by setting: texts are long, and buffers of batches, most of them outside the heap, double as they grow.
#: Rows and bytes that go to Python together, and rows that are read from Parquet together.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 4_000_000, "spark.sql.parquet.columnarReaderBatchSize": 1024}


def small_batches(spark: SparkSession) -> None:
    """Keeps batches of the session within ``BATCHES`` from now on. Batches are made when the caller runs what an operator returns, so this must outlast the call. Smaller settings stay, and no result depends on them."""
    for name, most in BATCHES.items():
        given = re.fullmatch(r"(\d+)b?", spark.conf.get(name))  # other units are those of large sizes
        if not given or not 0 < int(given[1]) <= most:
            spark.conf.set(name, most)


def written(df: DataFrame) -> DataFrame:
    """``df``, written once to the shared folder and read again."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{scratch_dir(spark)}/ledgerine-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def known_id(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def shown_id(col: Column) -> Column:
    return F.when(col != NULL_ID, col)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that hash order is unrelated to value order."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


def mixed_int(x: int) -> int:
    return int(mixed(np.array([x & (2**64 - 1)], np.uint64))[0])


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null is the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def flat_texts(column: pa.Array, most: int):
    """(first row, row after the last, bytes, offsets) for runs of whole rows of about ``most`` bytes; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


@functools.cache
def _libc():
    try:
        found = ctypes.CDLL(None)
        return found if hasattr(found, "malloc_trim") else None
    except OSError:
        return None


def tidy(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, giving freed memory back when a task ends: workers outlive tasks and wait while others run."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if (libc := _libc()) is not None:
                libc.malloc_trim(0)

    return out


def fields_of(df: DataFrame, *names: str) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


#: Rows of keys and a few numbers that may be broadcast, about 100 bytes each in memory; longer tables are exchanged.
SMALL = 100_000


def if_small(df: DataFrame) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it is short."""
    return F.broadcast(df) if df.count() <= SMALL else df


#: Keys that may be broadcast for holding many rows: at most this many hold a share of one in HOT or more.
HOT = 4096


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """``rows`` joined with ``keys``, in which ``on`` is unique and ``n`` is the number of its rows among the ``total`` ones.

    Keys that hold one row in ``HOT`` or more are broadcast: there are ``HOT`` at most, so this has a bound at any size, and their
    rows stay where they are. What is left is exchanged; none of its keys holds more than a share of one in ``HOT``.
    """
    hot = F.col(n) * F.lit(HOT) >= F.lit(total)
    few = F.broadcast(keys.where(hot))
    return rows.join(few, on).unionByName(rows.join(F.broadcast(keys.where(hot).select(*on)), on, "left_anti").join(keys.where(~hot), on))


def components(edges: DataFrame, scratch=written, most_rounds: int = 60) -> DataFrame:
    """(node, root): for each node of ``edges`` (a, b) the smallest node that it can reach.

    Small-star and large-star steps by turns; the first gathers the many links that one node may have to nodes near each other. Each step is a minimum per node, which is combined before the exchange, and
    an equi-join that the runtime may split when a node is hot, so no task ever holds the neighbours of one node together.
    The minima of a round also show whether all links are stars by now, so links that come as stars cost no round.
    ``edges`` is read twice, so it should be a written table. Self links and nulls are ignored; with no links the result is empty. Only DataFrame operations are used.
    """
    def small_star(links: DataFrame) -> DataFrame:
        """The smaller neighbours of a node, and the node, linked to the smallest of them."""
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        rest = links.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return scratch(rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct())

    e = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    e = small_star(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    for _ in range(most_rounds):
        both = e.withColumn("down", F.lit(1)).unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0).alias("down")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.sum("down").alias("downs"), F.count("*").alias("n"))
        low = scratch(low.select("a", F.least("a", "m").alias("m"), ((F.col("downs") > 0) & (F.col("n") > 1)).alias("open")))  # so that the runtime can split the join
        if low.where("open").isEmpty():  # a node has either one smaller neighbour and no other, or larger ones alone
            break
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        e = small_star(large)
    else:
        raise RuntimeError("components did not settle")
    return low.select(F.col("a").alias("node"), F.col("m").alias("root"))


class Forest:
    """Union-find over 0 .. n-1; roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def stars(forest: Forest, names: list) -> list[tuple]:
    """A link from each name to the smallest one of its tree: the same links whatever the order, so equal ones from other tasks fall together."""
    low: dict[int, object] = {}
    roots = [forest.find(i) for i in range(len(names))]
    for r, x in zip(roots, names, strict=True):
        if r not in low or x < low[r]:
            low[r] = x
    return list({(x, low[r]) for r, x in zip(roots, names, strict=True) if x != low[r]})


def paired_blocks(df: DataFrame, group: str, size: Column, member: Column, block: int) -> DataFrame:
    """Deal groups to tasks so that every two members of a group meet, however large the group.

    A group of ``size`` rows is cut by the hash of ``member`` into c = ceil(size / block) blocks; a row goes to the c block
    pairs that hold its block: column ``cell`` (group, low, high) and ``side`` (0 low, 1 high; both when low = high is 0).
    Rows of one cell number about two blocks at most.
    """
    c = F.greatest(F.lit(1), F.ceil(size / F.lit(float(block)))).cast("int")
    own = F.pmod(F.xxhash64(member, F.lit(17)), c.cast("long")).cast("int")
    out = df.withColumn("_c", c).withColumn("_own", own).withColumn("_other", F.explode(F.expr("sequence(0, _c - 1)")))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    return (
        out.withColumn("cell", F.struct(F.col(group).alias("g"), low.alias("low"), high.alias("high")))
        .withColumn("side", F.when(F.col("_own") == low, 0).otherwise(1))
        .drop("_c", "_own", "_other")
    )
