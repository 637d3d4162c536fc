"""MinHash near-dedup with b-bit signatures: bands give candidates, bit counts screen them, full shingle sets confirm them.

1. Texts that have equal shingle sets become one class. A class has 128 minima: bands of them (as many rows a band as keep the chance
   to miss a pair at the threshold below one in a million) and their lowest 4 bits, packed.
2. Classes that share a band meet. The similarity that the packed bits show, corrected for chance collisions, screens pairs five
   deviations below the threshold; a spanning forest of what remains gives coarse groups, which hold every pair that can be a link.
3. In each coarse group full sets are compared exactly, leaving out pairs that are connected already. Sets are fetched by the text of
   one row of each class and go by the class's digest.

Lists and groups of any length meet as ``clusters`` says, so none is capped or bound to one task, and no member is sent to all blocks
of a group that its tree already covers.

Edge cases: a null text or one without words has no shingles, stands alone and is linked with nothing; fewer words than a shingle
are one shingle; a null id is one document, smaller than all others; rows that repeat an id are each returned; very long texts are
worked off in runs, and few of them share a block; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clusters import bounds, by_cell, connect, links_batch, parts_of
from .common import Forest, if_small, join_counted, known_id, mixed, shown_id, stars, tidy, written

MINIMA, BITS = 128, 4
A = mixed(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
B = mixed(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
ONES = np.uint64(0x1111111111111111)
#: Keys of one number, about 40 bytes each in memory, that may be broadcast; more are exchanged.
SMALL_NUMBERS = 1_500_000
#: Shingles of one block of sets, about.
HELD = 2_000_000


def band_rows(share: float, miss: float = 1e-6) -> int:
    """The longest band that misses a pair of this similarity with at most this chance."""
    return max([r for r in range(1, 17) if (1 - share**r) ** (MINIMA // r) <= miss], default=1)


def shingles(data: bytes, k: int) -> np.ndarray:
    """Distinct 64-bit hashes of the word k-grams, sorted."""
    from xxhash import xxh3_64_intdigest

    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < k:
        h = np.concatenate([h, np.full(k - len(words), len(words), np.uint64)])
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[i : i + n]
    return np.unique(mixed(out))


def minima(s: np.ndarray) -> np.ndarray:
    low = np.full(MINIMA, 2**64 - 1, np.uint64)
    for lo in range(0, len(s), 2048):
        np.minimum(low, (s[lo : lo + 2048, None] * A + B).min(0), out=low)
    return low


def packed(low: np.ndarray) -> bytes:
    """The lowest bits of mixed minima, 16 of them a word."""
    nibbles = (mixed(low) & np.uint64(2**BITS - 1)).reshape(-1, 16)
    return (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64).tobytes()


def similarity(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated by counting the bits where packed signatures differ, corrected for minima that agree in four bits by chance."""
    d = x ^ y
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    same = 1 - np.bitwise_count(d & ONES).sum(-1, dtype=np.int64) / MINIMA
    chance = 2.0**-BITS
    return (same - chance) / (1 - chance)


def _sign(k: int, rows: int):
    bands = MINIMA // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = mixed(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            n, digests, signs, keys = [], [], [], []
            for data in batch.column(2):
                s = shingles(data.as_buffer().to_pybytes() if data.is_valid else b"", k)
                n.append(len(s))
                if len(s):
                    low = minima(s)
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    signs.append(packed(low))
                    keys.append(mixed((low[: bands * rows].reshape(bands, rows) * weights).sum(1, dtype=np.uint64) + mixed(np.arange(bands))).view(np.int64))
                else:
                    for to in (digests, signs, keys):
                        to.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc", "row", "n", "digest", "sign", "bands"])

    return run


def near_pairs(table: pa.Table, least: float) -> Iterator[tuple[np.ndarray, int]]:
    """(i, step): rows i and i + step of a cell, to be compared there, whose signatures show the ``least`` similarity."""
    start = bounds(table)
    end = np.repeat(start[1:], np.diff(start))
    signs = np.frombuffer(b"".join(table["sign"].to_pylist()), np.uint64).reshape(len(end), -1)
    side, whole = table["side"].to_numpy(), table["whole"].to_numpy(zero_copy_only=False)
    i, step = np.arange(len(end)), 0
    while len(i):
        step += 1
        i = i[i + step < end[i]]
        met = i[whole[i] | (side[i] != side[np.minimum(i + step, len(end) - 1)])]
        yield met[similarity(signs[met], signs[met + step]) >= least], step


def _screen(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_cell(batches):
            names, forest = table["digest"].to_pylist(), Forest(table.num_rows)
            for column in (names, table["tree"].to_pylist()):  # one class in several cells is one node, and so are classes of one tree
                first = {}
                for i, x in enumerate(column):
                    if x is not None:
                        forest.union(first.setdefault(x, i), i)
            for found, step in near_pairs(table, least):
                for x in found.tolist():
                    forest.union(x, x + step)
            yield links_batch(stars(forest, names))

    return run


def _sift(least: float):
    """Classes that may have a link to another tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_cell(batches):
            tree = table["tree"].combine_chunks().dictionary_encode().indices.to_numpy()
            keep = np.zeros(len(tree), bool)
            for found, step in near_pairs(table, least):
                found = found[tree[found] != tree[found + step]]
                keep[found] = keep[found + step] = True
            yield pa.RecordBatch.from_arrays([table["digest"].filter(pa.array(keep)).combine_chunks().cast(pa.binary())], ["digest"])

    return run


def _sets(k: int):
    """Shingle sets of texts. Rows that agree in id and text are taken once a task, so a hot one is combined before it is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            out, held = [], 0
            for doc, row, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if row is None or (key := doc.to_bytes(8, "little", signed=True) + row) in seen:
                    continue
                seen.add(key)
                s = shingles(data.as_buffer().to_pybytes(), k).tobytes()
                out.append((hashlib.blake2b(s, digest_size=16).digest(), s))
                held += len(s)
                if held > 16_000_000:
                    yield _set(out)
                    out, held = [], 0
            yield _set(out)

    return run


def _set(out: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in range(2)], ["digest", "shingles"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_cell(batches):
            start, names, held, trees = bounds(table), table["digest"].to_pylist(), table["shingles"], table["tree"].to_pylist()
            side, whole, out = table["side"].to_numpy(), table["whole"].to_numpy(zero_copy_only=False), []
            for lo, hi in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
                if hi - lo > 1:
                    sets = [np.frombuffer(held[i].as_buffer(), np.uint64) for i in range(lo, hi)]
                    out += stars(confirmed(sets, side[lo:hi], bool(whole[lo]), percent, trees[lo:hi]), names[lo:hi])
            yield links_batch(out)

    return run


def confirmed(sets: list[np.ndarray], side: np.ndarray, whole: bool, percent: int, trees: list | None = None) -> Forest:
    """Trees of the links among sets (between the two sides unless ``whole``) with 100 * intersection >= percent * union, beside the given trees."""
    m, forest, first = len(sets), Forest(len(sets)), {}
    for i, x in enumerate(trees or ()):
        if x is not None:
            forest.union(first.setdefault(x, i), i)
    size = np.array([len(x) for x in sets], np.int64)
    flat, ends = np.concatenate(sets), np.cumsum(size)
    for i in range(m - 1):
        j = np.arange(i + 1, m)
        root = forest.find(i)
        open_ = np.array([forest.find(x) != root for x in j.tolist()]) & (np.minimum(size[i], size[j]) * 100 >= percent * np.maximum(size[i], size[j]))
        if not whole:
            open_ &= side[j] != side[i]
        j = j[open_]
        if not len(j):
            continue
        if len(j) * 4 >= m - i:
            a = ends[i]
            part = flat[a:]
            at = np.minimum(np.searchsorted(sets[i], part), len(sets[i]) - 1)
            hit = np.concatenate([[0], np.cumsum(sets[i][at] == part)])
            both = hit[ends[j] - a] - hit[ends[j] - size[j] - a]
        else:
            both = np.array([np.count_nonzero(sets[i][np.minimum(np.searchsorted(sets[i], sets[x]), size[i] - 1)] == sets[x]) for x in j.tolist()])
        for x in j[100 * both >= percent * (size[i] + size[j] - both)].tolist():
            forest.union(i, x)
    return forest


def row_key(id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart: the document and a 128-bit hash of its text."""
    return [known_id(id_col).alias("doc"), F.unhex(F.md5(F.encode(F.col(text_col), "UTF-8"))).alias("row")]


def grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(doc, row, n, digest) of each row, and (digest, component, first) of classes that hold several rows or are linked: the smallest id and the smallest (doc, row) of their group."""
    share = percent / 100
    least = share - 5 * math.sqrt(share * (1 - share) / MINIMA + 2.0**-BITS / MINIMA)
    given = docs.select(*row_key(id_col, text_col), F.encode(F.col(text_col), "UTF-8").alias("text"))
    rows = written(given.mapInArrow(tidy(_sign(shingle, band_rows(share))), "doc long, row binary, n long, digest binary, sign binary, bands array<long>"))
    classes = rows.where("n > 0").groupBy("digest").agg(F.min(F.struct("doc", "row")).alias("at"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sign").alias("sign"), F.first("bands").alias("bands"))
    classes = written(classes)
    signs = classes.select("digest", "sign")

    spots = classes.select("digest", F.explode("bands").alias("list"))
    shared = written(spots.groupBy("list").agg(F.count("*").alias("c")).where("c > 1").withColumn("parts", parts_of(F.col("c") / block)))
    spots = written(join_counted(spots, shared, ["list"], "c", classes.count() * (MINIMA // band_rows(share))).select("list", "c", "parts", "digest"))
    coarse = written(connect(spots, signs, _screen(least)).select(F.col("node").alias("digest"), F.col("root").alias("list")))

    coarse = written(classes.select("digest", "at", "n").join(if_small(coarse), "digest"))
    sizes = coarse.groupBy("list").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    sizes = written(sizes.select("list", "c", parts_of(F.greatest(F.col("c") / block, F.least(F.col("c").cast("double"), F.col("n") / HELD))).alias("parts")))
    spots = written(coarse.join(sizes, "list").select("list", "c", "parts", "digest"))
    numbers = coarse.select(F.xxhash64("at.doc", "at.row").alias("k"))
    wanted = coarse.count()
    sets = given.join(F.broadcast(numbers) if wanted <= SMALL_NUMBERS else numbers, F.xxhash64("doc", "row") == F.col("k"), "left_semi")
    sets = written(sets.mapInArrow(tidy(_sets(shingle)), "digest binary, shingles binary"))
    if sets.count() > wanted:  # one row in several tasks, or other rows whose keys collide
        sets = written(sets.dropDuplicates(["digest"]))
    linked = connect(spots, sets, _confirm(percent), signs, _sift(least)).withColumnRenamed("node", "digest")

    named = classes.select("digest", "at", "copies").join(linked, "digest", "left").where("copies > 1 or root is not null")
    named = written(named.withColumn("root", F.coalesce("root", "digest")))
    lowest = written(named.groupBy("root").agg(F.min("at").alias("first")))  # written, so that a join on a hot root can be broadcast or split
    return rows.select("doc", "row", "n", "digest"), written(named.select("digest", "root").join(lowest, "root").select("digest", F.col("first.doc").alias("component"), "first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 85, block: int = 128) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), kept (the row has that id): a row for each row of ``docs``."""
    rows, found = grouped(docs, id_col, text_col, shingle, percent, block)
    out = rows.join(found, "digest", "left").withColumn("component", F.coalesce("component", "doc"))
    return out.select(shown_id(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), shown_id(F.col("component")).alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, block: int = 128) -> DataFrame:
    """``docs`` with one row of each group: that of smallest id, of several such the one of smallest hash of the text; of equal ids and texts one row.

    Rows without shingles are in no group and all stay.
    """
    rows, found = grouped(docs, id_col, text_col, shingle, percent, block)
    own = rows.join(found, "digest").withColumn("stays", (F.col("doc") == F.col("first.doc")) & (F.col("row") == F.col("first.row")))
    own = written(own.groupBy("doc", "row", "stays").agg(F.count("*").alias("m")).where("not stays or m > 1").select(F.col("doc").alias("_doc"), F.col("row").alias("_row"), F.when(F.col("stays"), True).alias("_again")))
    names = docs.columns
    inner = [f"_c{i}" for i in range(len(names))]
    doc, row = row_key(id_col, text_col)
    keyed = docs.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, inner, strict=True)], doc.alias("_doc"), row.alias("_row"))
    out = keyed.join(if_small(own), ["_doc", "_row"], "left_anti").select(*inner)
    again = own.where("_again").select("_doc", "_row")
    if not again.isEmpty():
        same = keyed.join(if_small(again), ["_doc", "_row"]).groupBy("_doc", "_row")
        out = out.unionByName(same.agg(F.min_by(F.struct(*inner), F.xxhash64(*inner)).alias("_one")).select("_one.*"))
    return out.toDF(*names)
