"""Sharding by a hypergeometric communication matrix: exact counts, a local permutation, one exchange, a second permutation.

The rows of each input partition are dealt to the cells of all shards with counts drawn from the multivariate hypergeometric law,
whose row sums are the partitions and whose column sums are the cells. A partition permutes its rows and deals them out by its counts;
a cell permutes what it receives. The result is a uniform shuffle with exact sizes: shards differ by one row at most. A shard is a
run of cells, so a task permutes a cell, not a shard.

No task or driver holds the matrix: every partition walks down the same seeded binary tree over the partitions, splitting the column
sums in two at each node, and so draws its own row. The draws are exact at any number of rows.

The input must give the same rows in the same order when it is read again, as tables do (``materialize=True`` writes any other one
down first); a partition that changes its count between the two passes is an error, never a lost row.

Edge cases: null texts and ids are rows like others; equal rows are separate rows; an empty table gives an empty result; names that
clash with the result's are replaced. Equal texts are not kept together: under the
law on rows a group of equal texts is dealt out like any rows, and its members may stand in several shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Up to this number rows are drawn one by one.
FEW = 64


def split_counts(rng: np.random.Generator, columns: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows, drawn without replacement, come from each column. Exact at any total.

    Independent binomial counts with one probability follow, given their sum s, the law of s draws without replacement, whatever
    the probability. If s differs from n, that many of the drawn rows go back, or are drawn from those left, by the same law; the
    difference is about the root of n, so few rounds are needed.
    """
    total = int(columns.sum())
    if n > total - n:
        return columns - split_counts(rng, columns, total - n)
    if n <= FEW:
        spots: set[int] = set()
        while len(spots) < n:
            spots.add(int(rng.integers(total)))
        at = np.searchsorted(np.cumsum(columns), sorted(spots), "right")
        return np.bincount(at, minlength=len(columns)).astype(columns.dtype)
    drawn = rng.binomial(columns, n / total)
    over = int(drawn.sum()) - n
    return drawn - split_counts(rng, drawn, over) if over > 0 else drawn + split_counts(rng, columns - drawn, -over)


def matrix_row(seed: int, before: np.ndarray, cells: np.ndarray, p: int) -> np.ndarray:
    """Row p of the matrix; ``before``: rows before each partition, and the total."""
    lo, hi, columns = 0, len(before) - 1, cells
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split_counts(np.random.default_rng([seed, lo, hi]), columns, int(before[mid] - before[lo]))
        lo, hi, columns = (lo, mid, left) if p < mid else (mid, hi, columns - left)
    return columns


def cell_sizes(rows: int, shards: int, cells: int) -> np.ndarray:
    """Rows of each cell: ``cells`` a shard, shards and cells as equal as they can be."""
    sizes = [rows // shards + (i < rows % shards) for i in range(shards)]
    return np.array([s // cells + (j < s % cells) for s in sizes for j in range(cells)], np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = sum(b.num_rows for b in batches)
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], ["part", "n"])


def shuffle_shards(docs: DataFrame, shards: int = 16, seed: int = 20240607, cell_rows: int = 1024, materialize: bool = False) -> DataFrame:
    """All columns of ``docs``, and shard and slot (gapless from 0). The driver gets one count for each input partition."""
    docs = written(docs) if materialize else docs
    counts = {r["part"]: r["n"] for r in docs.mapInArrow(_count, "part int, n long").collect()}
    before = np.concatenate([[0], np.cumsum([counts.get(p, 0) for p in range(max(counts, default=0) + 1)])]).astype(np.int64)
    rows = int(before[-1])
    # About cell_rows a cell, but no more cells than partitions while cells stay below 64 times that: a row of the matrix is short.
    fewest = -(-rows // (shards * 64 * cell_rows))
    each = max(1, min(-(-rows // (shards * cell_rows)), max(fewest, -(-(len(before) - 1) // shards))))
    sizes = cell_sizes(rows, shards, each)
    names = [n for n in docs.columns if n not in ("shard", "slot")]
    fields = T.StructType([*[T.StructField(f"_c{i}", docs.schema[n].dataType) for i, n in enumerate(names)], T.StructField("_cell", T.IntegerType()), T.StructField("_turn", T.LongType()), T.StructField("_from", T.LongType())])
    known = docs.sparkSession.sparkContext.broadcast((before, sizes))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, sizes = known.value
        p, at, to = TaskContext.get().partitionId(), 0, None
        rng = np.random.default_rng([seed, p, 1])
        for batch in batches:
            if to is None:
                if p >= len(before) - 1:
                    raise RuntimeError("the input changed between two readings")
                to = rng.permutation(np.repeat(np.arange(len(sizes), dtype=np.int32), matrix_row(seed, before, sizes, p)))
            n = batch.num_rows
            if at + n > len(to):
                raise RuntimeError("the input changed between two readings")
            turn = rng.integers(-(2**63), 2**63 - 1, n, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to[at : at + n]), pa.array(turn), pa.array(before[p] + np.arange(at, at + n))], fields.names)
            at += n
        if to is not None and at != len(to):
            raise RuntimeError("the input changed between two readings")

    dealt = docs.select(*[F.col(f"`{n}`").alias(f"_c{i}") for i, n in enumerate(names)]).mapInArrow(deal, fields)
    starts = sizes.reshape(shards, each).cumsum(1) - sizes.reshape(shards, each)
    start = F.element_at(F.array(*[F.lit(int(x)) for x in starts.ravel()]), F.col("_cell") + 1) if len(sizes) <= 4096 else None
    place = F.row_number().over(Window.partitionBy("_cell").orderBy("_turn", "_from")).cast("long") - 1
    if start is None:
        small = docs.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(starts.ravel())], "_cell int, _start long")
        dealt, start = dealt.join(small, "_cell"), F.col("_start")
    out = dealt.withColumn("slot", start.cast("long") + place)
    return out.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)], F.floor(F.col("_cell") / each).cast("int").alias("shard"), "slot")
