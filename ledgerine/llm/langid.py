"""Language ID by prediction by partial matching: per-language variable-order byte context trees under frozen statistics.

Each language has the counts of every byte after every context of up to ``order`` bytes (PPM, escape method C, with exclusion): a
byte that a context has seen has its count over the context's total and number of different bytes; any other has the escape, that number
over the same sum, times its probability in the next shorter context, in which bytes seen by the longer one do not count. Below the
empty context all bytes not seen there are equal. The contexts of all languages form one tree; for each node the code length of each
byte in each language is worked out once. A text's code length is the sum over its bytes, so it is exact, does not depend on
the batch, and takes one table look-up a byte.

Training reads at most ``sample_rows`` labelled rows a language (about; chosen by the hash of the id), which bounds the model of a
language at any input size by the different strings of ``order`` + 1 bytes in so many texts, however long: they go through the driver, those of ``TOGETHER`` languages at a time. Every language is learned. Languages are dealt to models of about ``MODEL_BYTES`` and ``TOGETHER``
languages at most; with more than one model a task holds one at a time, so memory does not grow with the number of languages, but
time and the disk for the models do. Bytes that no sampled text holds share one symbol.

Edge cases: a text that is null or has no letter is ``und`` with score 0; a null language is never learned; with nothing to learn
from, all texts are ``und``; a language with empty texts only has nothing to learn; ids may be null or repeat (in the sample a
null id is drawn by its text); extra columns are carried through where they do not clash; a table without rows gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat_texts, small_batches, tidy, written

SLICE = 500_000
#: Languages of one model at most, and bytes of its costs (a language that needs more has a model of its own).
TOGETHER = 16
MODEL_BYTES = 48_000_000
#: Contexts whose probabilities are worked out at once.
NODES = 2048


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


class Model:
    """``symbol``: byte to symbol. ``row``: the last ``order`` - 1 symbols (as a number) to a row of ``node``, which has the tree node for each symbol before them. ``cost``: (node, symbol, language) bits.

    Only contexts that a sampled text holds have rows of their own, so each byte can have its own symbol.
    """

    def __init__(self, languages: list[str], symbol: np.ndarray, row: np.ndarray, node: np.ndarray, cost: np.ndarray, order: int):
        self.languages, self.symbol, self.row, self.node, self.cost, self.order = languages, symbol, row, node, cost, order

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, languages) code lengths. Each text starts after ``order`` line ends."""
        n, size = len(data), self.cost.shape[1]
        if not n:
            return np.zeros((len(offsets) - 1, len(self.languages)))
        s = self.symbol[data].astype(np.int32)
        start, lengths = np.zeros(n, np.int32), np.diff(offsets)
        full = offsets[:-1][lengths > 0]
        since = np.arange(n, dtype=np.int32) - np.repeat(full.astype(np.int32), lengths[lengths > 0])
        edge = np.int32(self.symbol[10])
        context = start
        for back in range(self.order, 0, -1):
            shifted = np.empty(n, np.int32)
            shifted[back:] = s[: n - back]
            shifted[: min(back, n)] = edge
            shifted = np.where(since < back, edge, shifted)
            if back == self.order:
                first = shifted
            else:
                context = context * np.int32(size) + shifted
        node = self.node[self.row[context], first]
        each = self.cost.reshape(-1, len(self.languages))[node.astype(np.int64) * size + s]
        out = np.zeros((len(lengths), len(self.languages)))
        out[lengths > 0] = np.add.reduceat(each, full, axis=0, dtype=np.float64)
        return out


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Of each byte the number of it and the ``order`` bytes before it; a text starts after line ends."""
    out = np.zeros(len(data), np.uint32)
    lengths = np.diff(offsets)
    since = np.arange(len(data)) - np.repeat(offsets[:-1], lengths)
    for back in range(order, -1, -1):
        shifted = np.full(len(data), 10, np.uint32)
        shifted[back:] = data[: len(data) - back]
        out = out << np.uint32(8) | np.where(since < back, np.uint32(10), shifted)
    return out


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, dict[int, int]] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in sorted(set(langs.tolist())):
                own = batch.column(1).filter(pa.array(langs == lang))
                to = total.setdefault(lang, {})
                for _, _, data, offsets in flat_texts(own, SLICE):
                    if len(data):
                        keys, n = np.unique(grams(data, offsets, order), return_counts=True)
                        for k, c in zip(keys.tolist(), n.tolist(), strict=True):
                            to[k] = to.get(k, 0) + c
        for lang, found in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], ["lang", "gram", "n"])

    return run


class Models:
    """Models of all languages, each sent to the executors by itself. ``languages`` are in the order of the models."""

    def __init__(self, languages: list[str], parts: list[Broadcast]):
        self.languages, self.parts = languages, parts

    def each(self) -> Iterator[Model]:
        for part in self.parts:
            yield part.value
            if len(self.parts) > 1:
                self._let_go(part)

    def let_go(self) -> None:
        """At the end of a task: its worker may wait idle while other stages run, and the next task reads the models again."""
        for part in self.parts:
            self._let_go(part)

    @staticmethod
    def _let_go(part: Broadcast) -> None:
        if getattr(part, "_path", None):
            part.__dict__.pop("_value", None)  # read again from the worker's local file


def fit(docs: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 600, order: int = 3) -> Models | None:
    """Learns every language of rows of ``where``; None if there are none. The driver gets n-gram counts of the bounded sample only, of ``TOGETHER`` languages at a time."""
    if order != 3:
        raise ValueError("counts are kept in 32 bits: order must be 3")
    spark = docs.sparkSession
    small_batches(spark)
    given = docs.where(where & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("id"))
    share = [(r["lang"], min(1.0, sample_rows / r["n"])) for r in given.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()]
    if not share:
        return None
    spot = F.pmod(F.xxhash64(F.coalesce("id", "text"), F.lit(7)), F.lit(1_000_000)) / 1_000_000.0
    chosen = given.join(F.broadcast(spark.createDataFrame(share, "lang string, part double")), "lang").where(spot < F.col("part"))
    counts = chosen.select("lang", "text").mapInArrow(tidy(_count(order)), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    languages = sorted(lang for lang, _ in share)
    if len(languages) > TOGETHER:
        counts = written(counts.repartitionByRange("lang").sortWithinPartitions("lang"))
    names, parts = [], []
    for i in range(0, len(languages), TOGETHER):
        some = languages[i : i + TOGETHER]
        found = (counts.where(F.col("lang").isin(some)) if len(languages) > TOGETHER else counts).toPandas()
        for group in grouped(found, order):
            names += group
            parts.append(spark.sparkContext.broadcast(build(found[found["lang"].isin(group)], group, order)))
    return Models(names, parts) if parts else None


def grouped(counts: pd.DataFrame, order: int = 3) -> list[list[str]]:
    """The languages of ``counts``, in order, in groups whose costs take about ``MODEL_BYTES`` at most."""
    out, nodes, symbols = [], 0, set()
    for lang, gram in counts.groupby("lang", sort=True)["gram"]:
        own = sum(len(np.unique((gram.to_numpy() >> 8) & ((1 << 8 * k) - 1))) for k in range(order + 1))
        used = set(np.unique(gram.to_numpy() & 255).tolist())
        if not out or (nodes + own) * (len(symbols | used) + 1) * (len(out[-1]) + 1) * 4 > MODEL_BYTES:
            out.append([])
            nodes, symbols = 0, set()
        out[-1].append(lang)
        nodes, symbols = nodes + own, symbols | used
    return out


def build(counts: pd.DataFrame, languages: list[str], order: int = 3) -> Model:
    gram, n = counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
    lang = np.searchsorted(np.array(languages, dtype=object), counts["lang"].to_numpy(dtype=object))
    kept = np.union1d(gram & 255, [10])  # line ends stand before each text
    size = len(kept) + 1
    symbol = np.full(256, size - 1, np.int16)
    symbol[kept] = np.arange(size - 1)
    shared = 256 - len(kept)
    parts = [symbol[(gram >> (8 * back)) & 255].astype(np.int64) for back in range(order, -1, -1)]
    L = len(languages)
    held = lower = longest = None  # of the order before: counts, probabilities behind an escape, contexts
    node_of = np.zeros(1, np.int64)  # contexts of the order so far, to nodes
    costs: list[np.ndarray] = []
    for k in range(order + 1):
        context = np.zeros(len(gram), np.int64)
        for p in parts[order - k : order]:
            context = context * size + p
        found, row = np.unique(context, return_inverse=True)
        by_row = np.argsort(row, kind="stable")
        ends = np.searchsorted(row[by_row], np.arange(len(found) + 1))
        first = sum(len(x) for x in costs)
        tables, escaped = [], []
        for lo in range(0, len(found), NODES):
            hi = min(lo + NODES, len(found))
            own = by_row[ends[lo] : ends[hi]]
            table = np.zeros((hi - lo, size, L))
            np.add.at(table, (row[own] - lo, parts[order][own], lang[own]), n[own])
            if k:
                at = np.searchsorted(longest, found[lo:hi] % size ** (k - 1))
                above, below = held[at], lower[at]
            else:
                alike = np.ones((1, size, 1))
                alike[:, -1] = shared
                above, below = np.zeros_like(table), alike / np.maximum(256 - (table > 0).sum(1, keepdims=True), 1)
            known, behind = escapes(table, above, below)
            with np.errstate(divide="ignore"):  # a symbol that no byte has
                costs.append(-np.log2(known).astype(np.float32))
            if k < order:
                tables.append(table)
                escaped.append(behind)
        if k < order:
            held, lower, longest = np.concatenate(tables), np.concatenate(escaped), found
        if k == order:
            suffix = found % size ** (k - 1)
            own_rows = np.unique(suffix)
            # A context whose suffix is not seen stands at the suffix's node, one of the shared rows.
            shorter, row_of = np.unique(node_of, return_inverse=True)
            row_of[own_rows] = len(shorter) + np.arange(len(own_rows))
            node = np.repeat(np.concatenate([shorter, node_of[own_rows]])[:, None], size, axis=1)
            node[row_of[suffix], found // size ** (k - 1)] = first + np.arange(len(found))
        elif k:
            longer = np.tile(node_of, size)  # a context not seen stands at the node of its longest seen suffix
            longer[found] = first + np.arange(len(found))
            node_of = longer
    cost = np.concatenate(costs)
    cost[:, -1, :] += np.float32(np.log2(max(1, shared)))
    return Model(languages, symbol, row_of.astype(np.int32), node.astype(np.int32), cost, order)


def escapes(table: np.ndarray, above: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities (node, symbol, language) in contexts with counts ``table``, and those behind an escape from them.

    ``above``: counts in the contexts one byte shorter, which have seen all that the longer ones have; ``below``: probabilities behind an escape
    from those. Behind an escape only symbols count that the longer context has not seen. A context that a language never meets escapes for sure.
    """
    seen = table > 0
    total, distinct = table.sum(1, keepdims=True), seen.sum(1, keepdims=True)
    rest = np.where(seen, 0, above)
    total_rest, distinct_rest = rest.sum(1, keepdims=True), (rest > 0).sum(1, keepdims=True)
    behind = np.where(above > 0, above / np.maximum(total_rest + distinct_rest, 1), np.where(total_rest > 0, distinct_rest / np.maximum(total_rest + distinct_rest, 1), 1) * below)
    return np.where(seen, table / np.maximum(total + distinct, 1), np.where(total > 0, distinct / np.maximum(total + distinct, 1), 1) * behind), behind


def _bits(model: Model, column: pa.Array) -> np.ndarray:
    """(texts, languages) code lengths of a column of texts."""
    out = [np.zeros((0, len(model.languages)))]
    for _, _, data, offsets in flat_texts(column, SLICE):
        out.append(_long(model, data) if len(data) > 4 * SLICE else model.bits(data, offsets))
    return np.concatenate(out)


def _predict(models: Models | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            if models is None:
                bits = np.zeros((len(texts), 1))
            else:
                bits = np.concatenate([_bits(m, texts) for m in models.each()], axis=1)
            least = bits.min(1, keepdims=True)
            share = 1 / np.exp2(np.clip(least - bits, -1000, 0)).sum(1)
            best = bits.argmin(1)
            out_lang, out_score, out_bits = [], [], []
            for i in range(len(texts)):
                text = texts[i].as_py() if models is not None else None
                ok = text is not None and has_letter(text)
                out_lang.append(models.languages[best[i]] if ok else "und")
                out_score.append(float(share[i]) if ok else 0.0)
                out_bits.append(float(least[i, 0]) if ok else None)
            own = pa.array(out_lang, pa.string()), pa.array(out_score, pa.float64()), pa.array(out_bits, pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *own], [*batch.schema.names[1:], "lang_pred", "score", "bits"])

    return run


def _long(model: Model, data: np.ndarray) -> np.ndarray:
    """A text beyond the slice: cut, each part scored behind the bytes before it, so the sum is that of the whole."""
    out = np.zeros((1, len(model.languages)))
    for lo in range(0, len(data), SLICE):
        back = min(lo, model.order)
        part = data[lo - back : lo + SLICE]
        out += model.bits(part, np.array([0, len(part)]))
        if back:
            lead = part[:back]
            out -= model.bits(lead, np.array([0, len(lead)]))
    return out


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text[:64]) or any(map(str.isalpha, text))


def predict(docs: DataFrame, model: Models | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``score`` (share of the likelihood that the best language holds), ``bits``. Map-only; the models are sent to the executors."""
    small_batches(docs.sparkSession)
    names = [n for n in docs.columns if n not in ("lang_pred", "score", "bits")]
    given = docs.select(F.col(text_col).alias("_text"), *[F.col(f"`{n}`").alias(f"_c{i}") for i, n in enumerate(names)])
    fields = ", ".join([*(f"_c{i} {docs.schema[n].dataType.simpleString()}" for i, n in enumerate(names)), "lang_pred string, score double, bits double"])

    def run(batches):
        try:
            yield from _predict(model)(batches)
        finally:
            if model is not None:
                model.let_go()

    out = given.mapInArrow(tidy(run), fields)
    return out.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)], "lang_pred", "score", "bits")
