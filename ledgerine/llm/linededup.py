"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position.

A line's key is the line stripped of white space at both ends with A-Z lower-cased. Keys of at least ``least_chars`` code points
that at least ``least_docs`` documents hold lose all their lines, save those in the largest doc_id that holds the key.

Edge cases: a null or empty text is one empty line; a null doc_id is one document, smaller than all others; rows that repeat a
doc_id are one document for the counts, and each of them is returned; an empty table gives an empty result; other columns are
carried through untouched, and inner columns are prefixed so that none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_counted, known_id, texts_of, tidy, written

STRIPPED = "\x20\x09\x0a\x0b\x0c\x0d"
LOWER = {c: c + 32 for c in range(65, 91)}


def line_key(line: str, least_chars: int) -> bytes | None:
    """16 bytes for a line that is long enough to count."""
    if len(line) < least_chars or len(key := line.strip(STRIPPED)) < least_chars:
        return None
    return hashlib.blake2b(key.translate(LOWER).encode("utf-8", "surrogatepass") if not key.isascii() else key.lower().encode(), digest_size=16).digest()


def _keys(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys = [], []
            for i, text in enumerate(texts_of(batch.column(2))):
                found = {line_key(x, least_chars) for x in text.split("\n")}
                found.discard(None)
                at += [i] * len(found)
                keys += found
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(keys, pa.binary())], ["_doc", "_row", "_key"])

    return run


def _rebuild(least_chars: int, text_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lines, dropped = [], [], []
            for text, drop in zip(batch.column(text_at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if not drop:
                    kept.append(text)
                    lines.append((text or "").count("\n") + 1)
                    dropped.append(0)
                    continue
                drop, parts = set(drop), (text or "").split("\n")
                left = [x for x in parts if line_key(x, least_chars) not in drop]
                kept.append("\n".join(left))
                lines.append(len(parts))
                dropped.append(len(parts) - len(left))
            own = batch.columns[: batch.num_columns - 1]
            own[text_at] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays([*own, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names)

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """All columns of ``docs`` with the lines dropped from the text, and ``n_lines`` (before) and ``n_dropped``.

    Lines are hashed once and written: 32 bytes per distinct long line of a row. The count is combined before it is sent. Keys that
    hold a large share of all lines are broadcast, others joined by exchange. Decisions go back to rows by (document, hash of the
    text), so rows that share an id, as null ids do, are not gathered; rows that agree in both have equal decisions line by line.
    """
    row = F.xxhash64(F.col(text_col)).alias("_row")
    keys = docs.select(known_id(id_col).alias("_doc"), row, F.col(text_col).alias("_text")).where(F.length("_text") >= least_chars)
    keys = written(keys.mapInArrow(tidy(_keys(least_chars)), "_doc long, _row long, _key binary"))
    # Equal ids may repeat, so documents are counted as (key, doc) pairs first; both steps combine on the map side.
    counted = keys.groupBy("_key", "_doc").agg(F.count("*").alias("_rows"))
    counted = counted.groupBy("_key").agg(F.count("*").alias("_n"), F.max("_doc").alias("_last"), F.sum("_rows").alias("_rows"))
    often = written(counted.where(F.col("_n") >= least_docs).select("_key", "_last", "_rows"))
    drops = join_counted(keys, often, ["_key"], "_rows", keys.count()).where(F.col("_doc") != F.col("_last"))
    drops = drops.groupBy("_doc", "_row").agg(F.collect_set("_key").alias("_drop"))
    names = docs.columns
    marked = docs.select(*[F.col(f"`{n}`").alias(f"_c{i}") for i, n in enumerate(names)], known_id(id_col).alias("_doc"), row)
    marked = marked.join(drops, ["_doc", "_row"], "left").drop("_doc", "_row")
    schema = T.StructType([*[T.StructField(f"_c{i}", docs.schema[i].dataType) for i in range(len(names))], T.StructField("_n_lines", T.LongType()), T.StructField("_n_dropped", T.LongType())])
    out = marked.mapInArrow(tidy(_rebuild(least_chars, names.index(text_col), schema.names)), schema)
    own = [n for n in names if n not in ("n_lines", "n_dropped")]
    return out.select(*[F.col(f"_c{names.index(n)}").alias(n) for n in own], F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"))
