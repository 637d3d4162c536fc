"""Periodic run detection over words by power-of-two naming (Karp, Miller, Rosenberg).

A run is a stretch of consecutive words with smallest period q, of at least ``max(least, 2 * q)`` words, that no neighbouring word extends
with that period. Of every run the words after its first q repeat what stands before them, and collapsing drops them.

1. Names. Level k names the stretches of 2**k words of a document: a stretch is the pair of the names of its halves, and pairs are numbered
   by sorting. Only stretches whose halves both occur twice are sorted, as others equal nothing; levels end where all stretches differ.
2. Candidates. For each period q the places 0, q, 2q, ... of a document are compared with those q words later. A run's words equal those q
   later over q places at least, so one of them lies on this grid: n / q pairs for a period, n log n for a document.
3. Extension. How far the words at both places agree, to the right and to the left, is read off the names from the highest level
   down. Together this is the maximal stretch of period q. Of equal stretches the smallest period is theirs.

Names are equal exactly if the words are, so nothing is hashed and nothing needs to be confirmed. Documents of a batch are worked on
together; a document is never cut, so one of very many words takes 4 bytes a word and level (as many levels as its longest repeat has
binary digits), and pairs are made ``PAIRS`` at a time.

Edge cases: a null text stays null and has no words; an empty or blank text has none and collapses to the empty text; other texts come
back with single spaces between words; rows that repeat an id are rows of their own; an empty table gives an empty result; other
columns are carried through, result names replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_texts, tidy

#: Bytes of text that are worked on together, but for longer texts, and pairs of places that are compared at once.
SLICE, PAIRS = 2_000_000, 1 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and where each text's begin."""
    parts = pc.ascii_split_whitespace(column.cast(pa.string()).fill_null(""))
    flat = parts.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty part
    before = np.concatenate([[0], np.cumsum(full)])
    at = parts.offsets.to_numpy()
    return flat.filter(pa.array(full)), before[at - at[0]]


def levels_of(ids: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Names of all stretches of 1, 2, 4, ... words; a stretch that equals no other of its document, or would leave it, has a negative name of its own."""
    n, out, size = len(ids), [ids.astype(np.int32)], 1
    live, alone = np.ones(n, bool), -1 - np.arange(n, dtype=np.int32)
    while 2 * size <= n:
        start = np.flatnonzero(live[: n - 2 * size + 1] & live[size : n - size + 1] & (doc[: n - 2 * size + 1] == doc[2 * size - 1 :]))
        names = out[-1]
        most = int(names.max()) + 1
        key = names[start].astype(np.int64) * most + names[start + size]
        if size == 1:  # from here on names belong to a document
            key += doc[start].astype(np.int64) * (most * most)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        number = np.cumsum(new) - 1
        several = np.bincount(number, minlength=1)[number] > 1
        if not several.any():
            break
        start, number = start[order][several], number[several]
        level = alone.copy()
        level[start] = number
        live = np.zeros(n, bool)
        live[start] = True
        out.append(level)
        size *= 2
    return out


def agreement(levels: list[np.ndarray], at: np.ndarray, q: np.ndarray, bound: np.ndarray, left: bool) -> np.ndarray:
    """For how many words from ``at`` on (or before it) the words ``q`` places later are the same, within the document that ``bound`` ends."""
    x = at.copy()
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        if left:
            rows = np.flatnonzero(x - size >= bound)
            here = x[rows] - size
        else:
            rows = np.flatnonzero(x + q + size <= bound)
            here = x[rows]
        equal = levels[k][here] == levels[k][here + q[rows]]
        x[rows[equal]] += -size if left else size
    return np.abs(x - at)


def runs_of(ids: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(document, start, end, period) of all runs, by document, start and period; starts and ends are places in ``ids``."""
    count = np.diff(offsets)
    doc = np.repeat(np.arange(len(count), dtype=np.int64), count)
    levels = levels_of(ids, doc) if len(ids) else []
    half = np.where(count >= least, count // 2, 0)
    of = np.repeat(np.arange(len(count)), half)  # a row for each document and period
    period = np.arange(len(of)) - np.repeat(np.cumsum(half) - half, half) + 1
    pairs = (count[of] - 1) // period
    upto = np.cumsum(pairs)
    found: list[np.ndarray] = []
    lo = 0
    while lo < len(of):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
        n = pairs[lo:hi]
        q = np.repeat(period[lo:hi], n)
        at = (np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)) * q + np.repeat(offsets[of[lo:hi]], n)
        equal = np.flatnonzero(ids[at] == ids[at + q])
        at, q = at[equal], q[equal]
        d = doc[at]
        end = at + agreement(levels, at, q, offsets[d + 1], False)
        begin = at - agreement(levels, at, q, offsets[d], True)
        fits = (end - begin >= q) & (end - begin + q >= least)
        begin, end, q = begin[fits], (end + q)[fits], q[fits]
        new = np.concatenate([[True], (begin[1:] != begin[:-1]) | (end[1:] != end[:-1]) | (q[1:] != q[:-1])])[: len(q)]  # places of one run are neighbours
        found.append(np.stack([begin[new], end[new], q[new]]))
        lo = hi
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    start, end, q = np.concatenate(found, axis=1)
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    first = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])[: len(start)]
    start, end, q = start[first], end[first], q[first]
    order = np.lexsort((q, start))
    return doc[start[order]], start[order], end[order], q[order]


def _collapse(names: list[str], least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for first, last, _, _ in flat_texts(texts, SLICE):
                column = texts.slice(first, last - first)
                words, offsets = split_words(column)
                doc, start, end, q = runs_of(words.dictionary_encode().indices.to_numpy(zero_copy_only=False), offsets, least)
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, start + q, 1)
                np.add.at(gone, end, -1)
                kept = np.cumsum(gone)[:-1] == 0
                before = np.concatenate([[0], np.cumsum(kept)])[offsets]
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), words.filter(pa.array(kept))), " ")
                text = pc.if_else(column.is_valid(), text, pa.scalar(None, pa.string()))
                spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - offsets[doc], end - start, q)], ["start", "length", "period"])
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(last - first + 1)).astype(np.int32)), spans)
                own = batch.slice(first, last - first).columns[:-1]
                yield pa.RecordBatch.from_arrays([*own, text, pa.array(np.diff(offsets), pa.int64()), spans], names)

    return run


def collapse_runs(docs: DataFrame, text_col: str = "text", least: int = 12) -> DataFrame:
    """The columns of ``docs`` with the text collapsed, ``n_words`` (before) and ``runs`` (start, length, period in words, by start and period).

    One pass without an exchange: a document's runs depend on it alone.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    names = [n for n in docs.columns if n not in (text_col, "n_words", "runs")]
    inner = [f"_c{i}" for i in range(len(names))]
    given = docs.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, inner, strict=True)], F.col(f"`{text_col}`").cast("string").alias("text"))
    fields = ", ".join([*(f"{c} {docs.schema[n].dataType.simpleString()}" for n, c in zip(names, inner, strict=True)), f"text string, n_words long, runs {RUNS}"])
    out = given.mapInArrow(tidy(_collapse([*inner, "text", "n_words", "runs"], least)), fields)
    return out.select(*[F.col("text").alias(n) if n == text_col else F.col(inner[names.index(n)]).alias(n) for n in docs.columns if n not in ("n_words", "runs")], "n_words", "runs")
