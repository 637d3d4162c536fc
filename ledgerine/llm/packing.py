"""Packing by power-of-two decomposition: each document is cut into pieces of binary length, one piece a sequence.

A document of n tokens becomes floor(n / most) pieces of ``most`` tokens and one piece for each set bit of the rest, longest
first. A piece is a whole sequence: no sequence crosses documents and none needs padding. Sequences of equal length form a
bucket; ``sequence_id`` is (bucket, input partition, number there), so it needs no exchange and ordering by it lays the
buckets out one after another.

Edge cases: a null or empty text has only the end token; extra columns are ignored; rows that repeat an id are separate
documents; a null id stays null; an empty table gives an empty result. ``most`` must be a power of two.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts_of, tidy

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, bucket int"
#: Bits of a sequence id: bucket, partition, number within bucket and partition.
PARTITION_BITS, NUMBER_BITS = 22, 36


def word_ranks(path: str) -> tuple[dict[bytes, int], np.ndarray]:
    """The vocabulary as ranks for words that end in byte 255, which UTF-8 never has, and the token id of each rank.

    First the last byte joins its end mark, then pairs join in the order of the merges. Every token can be reached by the merges
    from its own bytes, so joining by the rank of what results equals joining by the rank of the pair (tests hold the two
    against each other).
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    mark = model["end_of_word_suffix"]

    def raw(token: str) -> bytes:
        return bytes(byte_of[c] for c in token.removesuffix(mark)) + b"\xff" * token.endswith(mark)

    ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 255]): 256 + b for b in range(256)}
    for x in model["merges"]:
        left, right = x if isinstance(x, list) else x.split(" ")
        ranks.setdefault(raw(left) + raw(right), len(ranks))
    ids = np.zeros(len(ranks), "<u4")
    for token, i in model["vocab"].items():
        if not (token.startswith("<|") and token.endswith("|>")):
            ids[ranks[raw(token)]] = i
    return ranks, ids


class ChunkIds(dict):
    """Little-endian 32-bit ids of text between ASCII white space, each encoded once.

    The tokenizer drops white space and never merges across it, so the ids of a text are those of its chunks in order. Nor does
    it merge letters with punctuation behind them. Words of Latin-1 letters are encoded by rank, all else by the tokenizer as it
    stands. The newest ``most`` entries and the generation before them are kept, so frequent chunks stay and memory is bounded.
    """

    def __init__(self, path: str, most: int = 150_000):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most, self.old, self.tails = Tokenizer.from_file(path), most, {}, {}
        ranks, ids = word_ranks(path)
        self.by_rank = [x.tobytes() for x in ids]
        self.piece = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def encoded(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        return b"".join([self.by_rank[x] for x in self.piece(word.lower().encode() + b"\xff")])

    def tail(self, tail: str) -> bytes:
        if (out := self.tails.get(tail)) is None:
            out = self.encoded(tail)
            if len(self.tails) < 4096:
                self.tails[tail] = out
        return out

    def __missing__(self, chunk: str) -> bytes:
        if (out := self.old.pop(chunk, None)) is None:
            body = chunk.rstrip(PUNCTUATION)
            if body.isalpha() and (body.isascii() or max(body) <= "ÿ"):
                out = self.word(body) if len(body) == len(chunk) else self.word(body) + self.tail(chunk[len(body) :])
            else:
                out = self.encoded(chunk)
        if len(chunk) <= 40:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[chunk] = out
        return out

    def forget(self) -> None:
        """Gives the memory back; workers outlive tasks and go on with other stages."""
        self.clear()
        self.old, self.tails = {}, {}
        pa.default_memory_pool().release_unused()

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, split_ascii(text)))


#: Marks that the tokenizer keeps apart from the letters before them. An apostrophe is not one: it can begin a suffix.
PUNCTUATION = ".,!?;:|)]"


@functools.cache
def chunk_ids(path: str) -> ChunkIds:
    """The tokenizer of a Python worker, kept from task to task; the chunks are not."""
    return ChunkIds(path)


def split_ascii(text: str) -> list[str]:
    # str.split() also cuts at other white space, which the tokenizer drops as well; \x1c-\x1f and \x85 differ between the two.
    return text.split() if not any(c in text for c in "\x1c\x1d\x1e\x1f\x85") else text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")


def binary_pieces(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    out = [(s, most) for s in range(0, n - n % most, most)]
    at, bit = n - n % most, most >> 1
    while bit:
        if n & bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


def _pack(tokenizer: str, end_id: int, most: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, end, part = chunk_ids(tokenizer), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        numbers = [0] * 40
        for batch in batches:
            rows: list[list] = [[] for _ in range(9 if keep_ids else 8)]
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                ids = chunks.ids(text) + end
                n = len(ids) // 4
                for start, length in binary_pieces(n, most):
                    bucket = length.bit_length() - 1
                    piece = ids[4 * start : 4 * (start + length)]
                    sequence = ((bucket << PARTITION_BITS | part) << NUMBER_BITS) | numbers[bucket]
                    numbers[bucket] += 1
                    for to, x in zip(rows, (doc, start, length, zlib.crc32(piece), n, sequence, 0, bucket), strict=False):
                        to.append(x)
                    if keep_ids:
                        rows[8].append(np.frombuffer(piece, "<u4").astype(np.int32))
                        held += len(piece)
                if held > 16_000_000:
                    yield _batch(rows)
                    rows, held = [[] for _ in rows], 0
            yield _batch(rows)
        chunks.forget()

    return run


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.list_(pa.int32())]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=False)], names[: len(rows)])


def pack_binary(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, most: int = 4096, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (always 0), bucket (log2 of the length), and the token ``ids`` on request. Map-only: nothing is exchanged."""
    if most < 1 or most & (most - 1):
        raise ValueError("most must be a power of two")
    small_batches(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(tidy(_pack(tokenizer, end_id, most, keep_ids)), SCHEMA + (", ids array<int>" if keep_ids else ""))


def equal_length_batches(pieces: DataFrame, tokens: int) -> DataFrame:
    """Adds ``batch_id``: sequences of one bucket and input partition, ``tokens`` tokens a batch (the last may be short)."""
    number = F.col("sequence_id").bitwiseAND((1 << NUMBER_BITS) - 1)
    each = F.greatest(F.lit(1), F.floor(F.lit(tokens) / F.col("length"))).cast("long")
    return pieces.withColumn("batch_id", F.col("sequence_id") - F.pmod(number, each))
