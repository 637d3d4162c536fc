"""Hard-negative mining by a full sort of each anchor's integer scores.

Anchors meet all rows in blocks: a block of anchors of bounded size is sent to every task, and a task scores it against its own rows.
The scores of an anchor are sorted, highest first, ties by the smaller id. The first pass reads each anchor's first rows of its own label,
its positives. The second sorts the scores again; a binary search finds the upper limit of each positive among the entries of other
labels, from which the first ``k`` above the lower limit are read. Tasks keep no more than ``k`` entries for an anchor and positive, so
what is exchanged are candidates alone, ranked by a window. No row is dropped, and no task sees more than a block of rows at once.

Components are integers, floor(scale * x), kept between -2**62 and 2**62. Scores are exact: in doubles or in longs where no sum can leave
them, in Python's integers otherwise; a score beyond a long counts as the nearest long.

Edge cases: rows with a null label, a null vector or a null or non-finite component take no part; vectors of another length than the
anchor's have no score; rows of the anchor's own id are not among its others, all other rows that repeat an id are rows of their own, also
as anchors; a null id is smaller than all others and its row an anchor only if ``anchors`` says so; an anchor without a positive, or a positive without a
negative between its limits, has no row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import known_id, scratch_dir, shown_id, tidy, written

#: Bytes of the vectors of a block of anchors, and the rows of it at most; rows that are sorted at once, and scores at once.
BLOCK_BYTES, BLOCK_ANCHORS = 16_000_000, 16_384
ROWS, SCORES = 8192, 1 << 20
LONG = 2**63 - 1


def _whole(scale: int):
    """(id, anchor, label, vector): vectors of integers as doubles; rows that take no part go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(3)
            at, flat = given.offsets.to_numpy(), given.values.fill_null(np.nan).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.clip(np.floor(flat * scale), -(2.0**62), 2.0**62) + 0.0
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            keep = np.flatnonzero((bad[at[1:]] == bad[at[:-1]]) & given.is_valid().to_numpy(zero_copy_only=False) & batch.column(2).is_valid().to_numpy(zero_copy_only=False))
            vectors = [whole[at[i] : at[i + 1]].tobytes() for i in keep.tolist()]
            left = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*left.columns[:3], pa.array(vectors, pa.binary())], ["id", "anchor", "label", "vector"])

    return run


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products of integers that are held as doubles, as longs: (anchors, rows)."""
    most = rows.shape[1] * float(np.abs(rows).max(initial=0)) * float(np.abs(anchors).max(initial=0))
    if most < 2.0**53:
        return (anchors @ rows.T).astype(np.int64)
    if most < 2.0**62:
        return anchors.astype(np.int64) @ rows.astype(np.int64).T
    exact = np.array([[int(x) for x in v] for v in anchors], object) @ np.array([[int(x) for x in v] for v in rows], object).T
    return np.clip(exact, -LONG - 1, LONG).astype(np.int64)


def sorted_scores(ids: np.ndarray, score: np.ndarray) -> np.ndarray:
    """For each anchor the order of all rows: by score, highest first (~x falls as x grows and never overflows), then by id."""
    return np.lexsort((np.broadcast_to(ids, score.shape), ~score))


def first_k(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` entries of each slot, in order."""
    order = np.lexsort((ids, ~score, slot))
    slot = slot[order]
    start = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else slot
    return order[np.arange(len(slot)) - np.repeat(start, np.diff(np.append(start, len(slot)))) < k]


def lower_limit(score: np.ndarray, low: int) -> np.ndarray:
    """The smallest n with low * score <= 100 * n, for 0 <= low <= 100, in exact integers."""
    return np.array([-((-low * x) // 100) for x in score.tolist()], np.int64)


class Block:
    """Anchors by length of vector: places among the block's anchors, ids, labels, vectors."""

    def __init__(self, anchors: list[tuple[int, str, bytes]]):
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in {len(v) for _, _, v in anchors}:
            own = [i for i, a in enumerate(anchors) if len(a[2]) == size]
            v = np.frombuffer(b"".join(anchors[i][2] for i in own), np.float64).reshape(len(own), -1)
            self.of[size] = np.array(own), np.array([anchors[i][0] for i in own], np.int64), np.array([anchors[i][1] for i in own], object), v


def _scored(batches: Iterator[pa.RecordBatch], block: Block):
    """(places of anchors, whether labels agree, ids, scores, order) for parts of the block and of the task's rows, without rows of the anchor's id (score order is theirs)."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            yield from _met(held, block)
            held, n = [], 0
    if n:
        yield from _met(held, block)


def _met(held: list[pa.RecordBatch], block: Block):
    table = pa.Table.from_batches(held)
    raw, labels, ids = table["vector"].to_pylist(), np.array(table["label"].to_pylist(), object), table["id"].to_numpy()
    sizes = np.array([len(x) for x in raw], np.int64)
    for size in np.unique(sizes).tolist():
        if size not in block.of:
            continue
        rows = np.flatnonzero(sizes == size)
        v = np.frombuffer(b"".join(raw[i] for i in rows.tolist()), np.float64).reshape(len(rows), -1)
        place, own, kind, vectors = block.of[size]
        for lo in range(0, len(place), step := max(1, SCORES // len(rows))):
            part = slice(lo, lo + step)
            score = products(v, vectors[part])
            order = sorted_scores(ids[rows], score)
            yield place[part], own[part], kind[part], labels[rows], ids[rows], score, order


def _kept(found: list[tuple[np.ndarray, ...]], k: int) -> list[tuple[np.ndarray, ...]]:
    """Entries (slot, score, id) of all parts so far, cut down to the first ``k`` of each slot."""
    slot, score, ids = (np.concatenate(x) for x in zip(*found, strict=True))
    at = first_k(slot, score, ids, k)
    return [(slot[at], score[at], ids[at])]


def _out(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    for slot, score, ids in found:
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(score, pa.int64()), pa.array(ids, pa.int64())], ["slot", "score", "id"])


def _positives(shared, k: int):
    """slot: the anchor's place in its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        for place, own, kind, labels, ids, score, order in _scored(batches, shared.value):
            for i, at in enumerate(order):
                at = at[(labels[at] == kind[i]) & (ids[at] != own[i])][:k]
                found.append((np.full(len(at), place[i]), score[i, at], ids[at]))
            found = _kept(found, k)
        yield from _out(found)

    return run


def _negatives(shared, k: int, low: int):
    """slot: the anchor's place times the number of positives, and the positive's rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, limits, width = shared.value
        found: list[tuple[np.ndarray, ...]] = []
        for place, own, kind, labels, ids, score, order in _scored(batches, block):
            for i, at in enumerate(order):
                upper = limits.get(int(place[i]))
                if upper is None:
                    continue
                at = at[(labels[at] != kind[i]) & (ids[at] != own[i])]
                falling = ~score[i, at]
                begin = np.searchsorted(falling, ~upper, "left")
                end = np.minimum(begin + k, np.searchsorted(falling, ~lower_limit(upper, low), "right"))
                for rank, (b, e) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
                    if b < e:
                        found.append((np.full(e - b, int(place[i]) * width + rank), score[i, at[b:e]], ids[at[b:e]]))
            found = _kept(found, k) if found else found
        yield from _out(found)

    return run


def _ranked(candidates: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each slot over all tasks, with their rank from 1."""
    rank = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "id"))
    return candidates.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(
    table: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = 5, k: int = 5, low: int = 80, scale: int = 256, block: int = BLOCK_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which ``anchors`` holds. For each of an anchor's first ``positives`` other rows of its label: the first ``k`` rows
    of other labels whose score is the positive's at most and ``low`` hundredths of it at least. A pass over all rows is made twice for each
    ``block`` of anchors (fewer where vectors are long), so the work is rows times anchors, in any number of tasks.
    """
    if not 0 <= low <= 100:
        raise ValueError("low is a share in hundredths")
    spark = table.sparkSession
    given = table.select(known_id(id_col).alias("id"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = written(given.mapInArrow(tidy(_whole(scale)), "id long, anchor boolean, label string, vector binary"))
    chosen = written(rows.where("anchor").withColumn("tag", F.monotonically_increasing_id()))
    n, longest = chosen.agg(F.count("*"), F.max(F.octet_length("vector"))).first()
    folder = f"{scratch_dir(spark)}/ledgerine-{uuid.uuid4().hex}"
    blocks = -(-n // max(1, min(block, BLOCK_BYTES // max(8, longest or 8))))
    for b in range(blocks):
        here = [(r["id"], r["label"], bytes(r["vector"])) for r in chosen.where(F.pmod(F.xxhash64("tag"), F.lit(blocks)) == b).orderBy("tag").select("id", "label", "vector").collect()]
        parts = Block(here)
        shared = spark.sparkContext.broadcast(parts)
        first = _ranked(rows.select("id", "label", "vector").mapInArrow(tidy(_positives(shared, positives)), "slot long, score long, id long"), positives)
        first = sorted(first.select("slot", "rank", "score", "id").collect())
        shared.destroy()
        limits: dict[int, list[int]] = {}
        for r in first:
            limits.setdefault(r["slot"], []).append(r["score"])
        shared = spark.sparkContext.broadcast((parts, {i: np.array(x, np.int64) for i, x in limits.items()}, positives))
        found = _ranked(rows.select("id", "label", "vector").mapInArrow(tidy(_negatives(shared, k, low)), "slot long, score long, id long"), k)
        pairs = [(r["slot"] * positives + r["rank"] - 1, here[r["slot"]][0], r["id"], r["score"]) for r in first]
        pairs = F.broadcast(spark.createDataFrame(pairs, "slot long, anchor_id long, positive_id long, positive_score long"))  # as many as a block of anchors has positives
        found.withColumnsRenamed({"score": "negative_score", "id": "negative_id"}).join(pairs, "slot").drop("slot").write.mode("append").parquet(folder)
        shared.destroy()
    if not blocks:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = spark.read.schema("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long").parquet(folder)
    return out.select(shown_id(F.col("anchor_id")).alias("anchor_id"), shown_id(F.col("positive_id")).alias("positive_id"), "rank", shown_id(F.col("negative_id")).alias("negative_id"), "positive_score", "negative_score")
