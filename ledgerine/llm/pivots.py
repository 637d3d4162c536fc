"""Embedding near-dedup by a pivot-permutation index.

Every vector is described by its nearest pivots in order of nearness. Two vectors share a pivot if it is among the ``nearest`` of both, at
places ``slack`` apart at most. The inverted lists hold, for each label and each ``shared`` pivots among a vector's ``nearest`` ones, the vectors that
have them all, with their order; a pair is retrieved exactly if at least ``shared`` pivots are shared, and one that meets in several lists
counts in one: that of its first shared pivots.

Retrieval takes two passes. The first carries, instead of vectors, the permutation and a sketch of a few bytes: the angles to the
first ``SKETCH`` pivots. Two angles to one point differ by no more than the angle between the vectors, so a pair whose sketches
differ by more cannot link; this loses nothing. Entries of lists that keep a partner go on to the second pass, which verifies by
cosine in double precision. Lists of any length are cut into blocks that meet pair by pair; links are counted inside a task and only
a link to the smallest member of each tree is emitted. Equal vectors are one member with a multiplicity.

Pivots: as many as the root of the number of vectors, from 128 to 4096, so that lists stay short as the table grows. They are
spread by farthest-first choice over a sample (those of smallest hash) of four times as many and 2048 at least, of 64 MB at most; all
vectors are indexed. Each of the ``LENGTHS`` most frequent lengths of vectors has its share of the sample and pivots of its own; vectors of
other lengths go to one list for each label, in which all that have one length meet. Recall against brute force is measured in the tests.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label, link with
nothing; others are scaled by a power of two, so that no norm over- or underflows; vectors of different lengths never link; null
ids stand for one smallest id; rows that repeat an id are each returned; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clusters import bounds, by_cell, in_cells
from .common import Forest, components, join_counted, known_id, paired_blocks, shown_id, stars, tidy, written


#: Pivots whose angles make up the sketch, and the steps of an angle from 0 to pi.
SKETCH, STEPS = 32, 255
SAMPLE_BYTES = 64_000_000
#: Lengths of vectors that have pivots.
LENGTHS = 16


def pivot_count(vectors: int) -> int:
    return min(4096, max(128, math.isqrt(vectors)))


def usable(x: np.ndarray) -> np.ndarray | None:
    """The vector with its largest component between 1/2 and 1, or None if it may not link."""
    most = np.abs(x).max(initial=0.0)  # nan where a component is
    return np.ldexp(x, -np.frexp(most)[1]) + 0.0 if 0 < most < np.inf else None


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors, digests = [], []
        given = batch.column(2)
        offsets, present, flat = given.offsets.to_numpy(), given.is_valid().to_numpy(zero_copy_only=False), given.values.fill_null(np.nan).to_numpy(zero_copy_only=False)
        for i, label in enumerate(batch.column(1).to_pylist()):
            v = usable(flat[offsets[i] : offsets[i + 1]]) if label is not None and present[i] else None
            raw = None if v is None else v.tobytes()
            vectors.append(raw)
            digests.append(None if raw is None else hashlib.blake2b(raw, digest_size=16, key=hashlib.blake2b(label.encode()).digest()).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.binary()), pa.array(digests, pa.binary())], ["id", "label", "vector", "digest"])


def spread(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Farthest-first choice by angle."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen, near = [0], unit @ unit[0]
    while len(chosen) < min(pivots, len(unit)):
        i = int(near.argmin())
        if near[i] > 1 - 1e-12:
            break
        chosen.append(i)
        near = np.maximum(near, unit @ unit[i])
    return unit[chosen]


def _permute(pivots: dict[int, np.ndarray], nearest: int, shared: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0).to_pylist()
            perms, sketches, lists = [b""] * len(raw), [b""] * len(raw), [[] for _ in raw]
            for size in {len(x) for x in raw}:
                own = [i for i, x in enumerate(raw) if len(x) == size]
                v = np.frombuffer(b"".join(raw[i] for i in own), np.float64).reshape(len(own), -1)
                v = v / np.linalg.norm(v, axis=1, keepdims=True)
                p = pivots.get(size // 8)
                if p is None:  # a length that the sample does not hold: one list
                    p = np.zeros((1, size // 8))
                near = v @ p.T
                order = np.argsort(-near, axis=1, kind="stable")[:, :nearest]
                angles = (np.arccos(np.clip(near[:, :SKETCH], -1, 1)) * (STEPS / np.pi)).astype(np.uint8)
                few = np.sort(order, axis=1)
                k = min(shared, few.shape[1])
                code = np.stack([sum(few[:, c].astype(np.int64) << (16 * i) for i, c in enumerate(cs)) for cs in combinations(range(few.shape[1]), k)], axis=1)
                for row, i in enumerate(own):
                    perms[i], sketches[i], lists[i] = order[row].astype(np.int16).tobytes(), angles[row].tobytes(), code[row]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(perms, pa.binary()), pa.array(sketches, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], [*batch.schema.names, "perm", "sketch", "lists"])

    return run


def band(places: int, slack: int) -> np.ndarray:
    """Whether two places of an order are near enough for a pivot to be shared."""
    at = np.arange(places)
    return np.abs(at[:, None] - at[None, :]) <= slack


def canonical(perms: np.ndarray, key: int, k: int, slack: int) -> np.ndarray:
    """Pairs (i, j) of one list for which it is the list of their first k shared pivots: these are shared, and no other shared one comes before the last."""
    own = [key >> (16 * i) & 0xFFFF for i in range(k)]
    near = band(perms.shape[1], slack).astype(np.float32)

    def shares(pivots: np.ndarray) -> np.ndarray:
        """How many of the pivots each pair shares."""
        at = (perms[:, None, :] == pivots[None, :, None]).astype(np.float32)  # row, pivot, place
        return at.reshape(len(perms), -1) @ (at @ near).reshape(len(perms), -1).T

    early = np.array([x for x in np.unique(perms[perms < own[-1]]) if x not in own], perms.dtype)
    out = shares(np.array(own, perms.dtype)) == k
    return out & (shares(early) == 0) if len(early) else out


def first_shared(x: np.ndarray, y: np.ndarray, code: np.ndarray, k: int, slack: int) -> np.ndarray:
    """The same for pairs of rows of permutations and the code of each pair's list."""
    own = np.stack([code >> (16 * i) & 0xFFFF for i in range(k)], axis=1)
    shared = ((x[:, :, None] == y[:, None, :]) & band(x.shape[1], slack)).any(2)
    mine = (x[:, :, None] == own[:, None, :]).any(2)
    return ((shared & mine).sum(1) == k) & ~(shared & (x < own[:, -1:]) & ~mine).any(1)


def _prune(gap: int, shared: int, slack: int):
    """The entries of lists that keep a partner: sketches differ by ``gap`` steps at most everywhere, and the list is the pair's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_cell(batches):
            start, code, side, whole = bounds(table), table["code"].to_numpy(), table["side"].to_numpy(), table["whole"].to_numpy(zero_copy_only=False)
            end = np.repeat(start[1:], np.diff(start))
            of_size, raw, perm = pc.binary_length(table["perm"]).to_numpy(), table["sketch"].to_pylist(), table["perm"].to_pylist()
            keep = np.zeros(len(code), bool)
            for size in np.unique(of_size).tolist():  # vectors of one length have permutations of one length
                rows = np.flatnonzero(of_size == size)
                last, own = np.searchsorted(rows, end[rows]), code[rows]
                sketch = np.frombuffer(b"".join(raw[i] for i in rows.tolist()), np.uint8).reshape(len(rows), -1).astype(np.int16)
                perms = np.frombuffer(b"".join(perm[i] for i in rows.tolist()), np.int16).reshape(len(rows), -1)
                i, step = np.arange(len(rows)), 0
                while len(i):
                    step += 1
                    i = i[i + step < last[i]]
                    near = i[whole[rows[i]] | (side[rows[i]] != side[rows[np.minimum(i + step, len(rows) - 1)]])]
                    for lo in range(0, sketch.shape[1], 8):  # most pairs differ in the first angles
                        near = near[(np.abs(sketch[near, lo : lo + 8] - sketch[near + step, lo : lo + 8]) <= gap).all(1)]
                    near = near[first_shared(perms[near], perms[near + step], own[near], min(shared, perms.shape[1]), slack)]
                    keep[rows[near]] = keep[rows[near + step]] = True
            at = np.flatnonzero(keep)
            names = table["digest"].take(pa.array(at)).combine_chunks()
            yield pa.RecordBatch.from_arrays([names.cast(pa.binary()), pa.array(code[at])], ["digest", "code"])

    return run


def _verify(least: float, shared: int, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_cell(batches):
            start, names, m = bounds(table), table["digest"].to_pylist(), table["m"].to_numpy()
            raw, perm, code, side, whole = table["vector"].to_pylist(), table["perm"].to_pylist(), table["code"].to_numpy(), table["side"].to_numpy(), table["whole"].to_numpy(zero_copy_only=False)
            out: list[list] = [[], [], []]
            for lo, hi in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                v = np.frombuffer(b"".join(raw[lo:hi]), np.float64).reshape(hi - lo, -1)
                norm = np.linalg.norm(v, axis=1)
                near = (v @ v.T) / np.outer(norm, norm) >= least
                near[np.arange(hi - lo), np.arange(hi - lo)] = False
                if not whole[lo]:
                    near &= side[lo:hi, None] != side[None, lo:hi]
                if not near.any():
                    continue
                perms = np.frombuffer(b"".join(perm[lo:hi]), np.int16).reshape(hi - lo, -1)
                near &= canonical(perms, int(code[lo]), min(shared, perms.shape[1]), slack)
                count = near @ m[lo:hi]
                i, j = np.nonzero(np.triu(near))
                forest = Forest(hi - lo)
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    forest.union(x, y)
                for x, y in stars(forest, names[lo:hi]):
                    for to, value in zip(out, (x, y, 0), strict=True):
                        to.append(value)
                for x in np.flatnonzero(count).tolist():
                    for to, value in zip(out, (names[lo + x], None, int(count[x])), strict=True):
                        to.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.binary(), pa.binary(), pa.int64()), strict=True)], ["a", "b", "links"])

    return run


#: What a list belongs to: label (96 bits of it) and length of the vectors.
OF = ["label_id", "label_tag", "size"]


def listed(spots: DataFrame, block: int, *columns: str) -> DataFrame:
    """Entries (``OF``, code, digest and ``columns``) of lists that hold two or more, in cells."""
    spots = written(spots)
    lengths = written(spots.groupBy(*OF, "code").agg(F.count("*").alias("c")).where("c > 1"))
    met = join_counted(spots, lengths, [*OF, "code"], "c", spots.count()).withColumn("list", F.struct(*OF, "code"))
    cells = paired_blocks(met, "list", F.col("c"), F.col("digest"), block).withColumn("whole", F.expr("cell.low = cell.high"))
    return in_cells(cells.select("cell", "side", "whole", "digest", "code", *columns))


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, pivots: int | None = None, nearest: int = 6, shared: int = 2, slack: int = 3, block: int = 256) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of ``table``."""
    given = table.select(known_id(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = written(given.mapInArrow(tidy(_clean), "id long, label string, vector binary, digest binary"))
    of = [F.xxhash64("label").alias("label_id"), F.hash("label").alias("label_tag"), F.octet_length("vector").alias("size")]
    kinds = rows.where("digest is not null").select("id", "digest", "vector", *of)
    kinds = written(kinds.groupBy("digest", *OF).agg(F.first("vector").alias("vector"), F.count("*").alias("m"), F.min("id").alias("id")))
    wanted = pivots or pivot_count(kinds.count())
    lengths = [r["size"] for r in kinds.groupBy("size").count().orderBy(F.desc("count"), "size").limit(LENGTHS).collect()]
    sample = max(1, min(max(2048, 4 * wanted), SAMPLE_BYTES // max([*lengths, 8])) // max(1, len(lengths)))
    by_size: dict[int, list] = {}
    rank = F.row_number().over(Window.partitionBy("size").orderBy(F.xxhash64("vector"), "vector"))
    for r in kinds.where(F.col("size").isin(lengths)).select("vector", rank.alias("n")).where(F.col("n") <= sample).collect():
        by_size.setdefault(len(r["vector"]) // 8, []).append(np.frombuffer(bytes(r["vector"]), np.float64))
    points = {n: spread(np.stack(x), wanted) for n, x in by_size.items()}
    index = kinds.select("vector", "digest", *OF, "m").mapInArrow(tidy(_permute(points, nearest, shared)), "vector binary, digest binary, label_id long, label_tag int, size int, m long, perm binary, sketch binary, lists array<long>")
    index = written(index)
    spots = listed(index.select(*OF, "digest", "perm", "sketch", F.explode("lists").alias("code")), block, "perm", "sketch")
    gap = math.ceil(math.acos(least) * STEPS / math.pi + 1e-6)
    spots = written(spots.mapInArrow(tidy(_prune(gap, shared, slack)), "digest binary, code long").distinct())
    cells = listed(spots.join(index.select("digest", *OF, "vector", "perm", "m"), "digest"), block, "vector", "perm", "m")
    found = written(cells.mapInArrow(tidy(_verify(least, shared, slack)), "a binary, b binary, links long"))
    counts = found.where("b is null").groupBy(F.col("a").alias("digest")).agg(F.sum("links").alias("links"))
    linked = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "digest")
    named = kinds.select("digest", "id", "m").join(linked, "digest", "left").join(counts, "digest", "left")
    named = written(named.withColumn("root", F.coalesce("root", "digest")))
    lowest = written(named.groupBy("root").agg(F.min("id").alias("component")))  # written, so that a join on a hot root can be broadcast or split
    named = written(named.join(lowest, "root").select("digest", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"), "component"))
    out = rows.select("id", "digest").join(named, "digest", "left").withColumn("component", F.coalesce("component", "id"))
    return out.select(shown_id(F.col("id")).alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), shown_id(F.col("component")).alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
