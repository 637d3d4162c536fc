"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice; decoding is lossless.

A text's lattice falls apart where no piece can cross: before a space mark that follows something else, and around characters that no
longer piece holds. Each part is filtered forward once (sum over all segmentations up to each place) and kept; sampling runs backward
for all parts of a batch at once, one edge a step, from the last place to the first; the few longest are walked to their ends one by one.
Random numbers are a hash of the row key, the
part's number and the step: the same key and text give the same pieces in any batch, task or order, to the last bit, for parts filtered
one by one and in blocks go through the same sums in the same order.

A BPE model has ranks, not probabilities; a piece of rank r has weight (r + 1) ^ -power (the law of Zipf), which needs no training.
Characters without a piece are coded as UTF-8 byte pieces. So is the space mark itself where it stands in a text, which tells it from
a space and keeps decoding exact.

Edge cases: a null or empty text has no pieces and decodes to the empty text; a null key is a key; rows that repeat a key and a text
get the same pieces; a text of any length is taken whole, in memory of some hundred bytes a character; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLD, known_id, mixed, mixed_int, texts_of, tidy

MARK = "▁"
#: Stands for the mark where a text itself has it; no text holds a lone surrogate.
LITERAL = "\udc00"


def raw_pieces(model) -> list[bytes]:
    """The bytes that each piece stands for; control pieces stand for none."""
    size = model.get_piece_size()
    return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else model.id_to_piece(i).replace(MARK, " ").encode() for i in range(size)]


def spelled(raw: list[bytes], ids: np.ndarray) -> str:
    out = b"".join(map(raw.__getitem__, ids.tolist()))
    return (out[1:] if out[:1] == b" " else out).decode()


class Lattices:
    """The vocabulary, and the places and edges of the parts seen so far. ``bound`` of a place's last edge is 1."""

    def __init__(self, path: str, power: float, most_edges: int = 4_000_000, few: int = 4):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.most_edges, self.few = most_edges, few
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.pieces = {model.id_to_piece(i): (i, x, math.exp(x)) for r, i in enumerate(ranked) for x in [-power * math.log(r + 1.0)]}  # number, log-weight, weight
        self.longest = max(map(len, self.pieces))
        self.spread = power * math.log(max(2, len(self.pieces)))  # of the logarithms of weights
        if self.spread * self.longest > 600:
            raise ValueError("weights lie too far apart")
        h = np.array([self._hash(np.array([[ord(c) for c in p]], np.uint64))[0] for p in self.pieces], np.uint64)
        order = np.argsort(h)
        self.hashes = h[order]
        self.slots, left = [], np.arange(len(h))
        for shift in (46, 20, 33, 8):  # of pieces that share a slot one stays; the others go to the next table
            slot, table = self._slot(self.hashes[left], shift), np.full(2**18, -1, np.int32)
            table[slot] = left
            self.slots.append((shift, table))
            left = left[table[slot] != left]
            if not len(left):
                break
        else:
            raise ValueError("pieces share all slots")
        self.hash_ids = np.append(np.array([x[0] for x in self.pieces.values()], np.int32)[order], np.int32(0))
        self.hash_weights = np.append(np.array([x[2] for x in self.pieces.values()])[order], 0.0)  # the last is for no piece
        self.raw = raw_pieces(model)
        inside = {c for p in self.pieces if len(p) > 1 for c in p}
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece crosses a space")
        alone = LITERAL + "".join(c for c in "\n\t\r" if c not in inside)
        after = {b for p in self.pieces for a, b in zip(p, p[1:], strict=False) if a not in ".,!?;:" + MARK}
        stop = "".join(c for c in ".,!?;:" if c not in after)  # no piece has one behind another kind of character
        body = f"[^{MARK}{alone}{stop}]+"
        self.parts = re.compile(f"[{alone}]|{MARK}*[{stop}]*{body}|{MARK}*[{stop}]+|{MARK}+" if stop else f"[{alone}]|{MARK}*{body}|{MARK}+")
        self.clear()

    def clear(self) -> None:
        self.ends: dict[str, int] = {}
        self.bound, self.back, self.piece, self.first, self.places = array("d"), array("i"), array("i"), array("i"), 0

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), np.uint64)
        for i in range(codes.shape[1]):
            h = (h ^ codes[:, i]) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
        return h

    @staticmethod
    def _slot(h: np.ndarray, shift: int) -> np.ndarray:
        return (h >> np.uint64(shift)).astype(np.int64) & 0x3FFFF

    def _found(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash, -1 without."""
        shift, table = self.slots[0]
        out = table[self._slot(h, shift)]
        left = np.flatnonzero(self.hashes[out] != h)
        left = left[out[left] >= 0]  # a piece lies in a later table only where another has its slot here
        out[self.hashes[out] != h] = -1
        for shift, table in self.slots[1:]:
            at = table[self._slot(h[left], shift)]
            hit = self.hashes[at] == h[left]
            out[left[hit]] = at[hit]
            left = left[~hit & (at >= 0)]
        return out

    def add_many(self, parts: list[str]) -> None:
        """All parts of one length at once; long ones and those with characters outside the vocabulary one by one."""
        by_size: dict[int, list[str]] = {}
        for part in parts:
            if part not in self.ends:
                self.ends[part] = -2
                by_size.setdefault(len(part), []).append(part)
        for n, own in by_size.items():
            step = len(own) if n == 1 else max(1, 500_000 // (n * n))
            for lo in range(0, len(own), step):
                some = own[lo : lo + step]
                if n > 24 or len(some) < 8 or n * self.spread > 400:
                    for part in some:
                        self.add(part)
                else:
                    self._add_block(some, n)

    def _add_block(self, parts: list[str], n: int) -> None:
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).T.astype(np.uint64, order="C")
        at = np.full((n * (n + 1) // 2, len(parts)), -1, np.int32)  # piece from start to end, in row end * (end - 1) / 2 + start
        for start in range(n):
            h = np.zeros(len(parts), np.uint64)
            for end in range(start + 1, min(n, start + self.longest) + 1):
                h = (h ^ codes[end - 1]) * np.uint64(0x9FB21C651E98DF25)
                h ^= h >> np.uint64(29)
                at[end * (end - 1) // 2 + start] = self._found(h)
        whole = (at[[end * (end + 1) // 2 - 1 for end in range(1, n + 1)]] >= 0).all(0)
        for i in np.flatnonzero(~whole).tolist():
            self.add(parts[i])
        keep = np.flatnonzero(whole)
        if not len(keep):
            return
        at = at[:, keep]
        up, total = self.hash_weights[at], [np.ones(len(keep))]
        for end in range(1, n + 1):
            here, sum_ = up[end * (end - 1) // 2 : end * (end + 1) // 2], np.zeros(len(keep))
            for start in range(end):
                here[start] *= total[start]
                sum_ += here[start]
                here[start] = sum_
            here /= sum_
            total.append(sum_)
        at, up = np.ascontiguousarray(at.T), np.ascontiguousarray(up.T)  # a part's edges by end, then start
        used = at >= 0
        own = self.places + np.arange(len(keep) * n, dtype=np.int32).reshape(len(keep), n)  # place of each end
        back = np.concatenate([np.full((len(keep), 1), -1, np.int32), own[:, :-1]], axis=1)[:, [start for end in range(1, n + 1) for start in range(end)]]
        number = np.add.reduceat(used, [end * (end - 1) // 2 for end in range(1, n + 1)], axis=1, dtype=np.int64).ravel()
        self.first.frombytes((len(self.bound) + np.cumsum(number) - number).astype(np.int32).tobytes())
        self.bound.frombytes(up[used].tobytes())
        self.back.frombytes(back[used].astype(np.int32).tobytes())
        self.piece.frombytes(self.hash_ids[at[used]].tobytes())
        self.places += len(keep) * n
        self.ends.update(zip([parts[i] for i in keep.tolist()], own[:, -1].tolist(), strict=True))

    def add(self, part: str) -> int:
        """The place at the end of a part."""
        n, get, longest = len(part), self.pieces.get, self.longest
        place, total = [-2] * (n + 1), [0.0] * (n + 1)
        place[0], total[0] = -1, 1.0
        for end in range(1, n + 1):
            options, up = [], 0.0
            for start in range(end - longest if end > longest else 0, end):
                if place[start] != -2 and (p := get(part[start:end])) is not None:
                    up += total[start] * p[2]
                    options.append((place[start], p[0], up))
            if options:
                place[end], total[end] = self._place(options, up), up
            elif place[end - 1] != -2 and part[end - 1] not in self.pieces:
                at = place[end - 1]
                for b in (MARK if part[end - 1] == LITERAL else part[end - 1]).encode():
                    at = self._place([(at, self.byte_ids[b], 1.0)], 1.0)
                place[end], total[end] = at, total[end - 1]
            if 0 < total[end] < 2.0**-600:  # a power of two, which changes no share
                for i in range(max(0, end - longest), end + 1):
                    total[i] *= 2.0**600
        self.ends[part] = place[n]
        return place[n]

    def _place(self, options: list, total: float) -> int:
        self.first.append(len(self.bound))
        for back, piece, up in options:
            self.bound.append(up / total)
            self.back.append(back)
            self.piece.append(piece)
        self.places += 1
        return self.places - 1

    def tables(self):
        """Views that must be gone before the next part is added."""
        return np.frombuffer(self.bound), np.frombuffer(self.back, np.int32), np.frombuffer(self.piece, np.int32), np.frombuffer(self.first, np.int32)

    def split(self, text: str) -> list[str]:
        return self.parts.findall(MARK + text.replace(MARK, LITERAL).replace(" ", MARK))

    @staticmethod
    def _drawn(seed: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Numbers in [0, 1) by the seeds of parts and the steps."""
        return (mixed(seed + (step + np.uint64(1)) * GOLD) >> np.uint64(11)).astype(np.float64) * 2.0**-53

    def _walk(self, place: int, seed: np.uint64, step: int, bound: np.ndarray, back: np.ndarray, piece: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Pieces of one part from a place back to its start, by the same numbers as all parts at once: 4 bytes a piece."""
        out, block = array("i"), 4096
        while place >= 0:
            for u in self._drawn(np.full(block, seed), np.arange(step, step + block, dtype=np.uint64)).tolist():
                edge = first[place]
                while bound[edge] <= u:
                    edge += 1
                out.append(piece[edge])
                place = back[edge]
                if place < 0:
                    break
            step += block
        return np.frombuffer(out, np.int32)

    def sample(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """Piece ids of each text."""
        if len(self.bound) > self.most_edges:
            self.clear()
        split = [self.split(text) if text else [] for text in texts]
        parts = [p for own in split for p in own]
        if not parts:
            return [np.zeros(0, np.int32) for _ in texts]
        count = np.fromiter(map(len, split), np.int64, len(split))
        owner = np.repeat(np.arange(len(texts)), count)
        number = (np.arange(len(parts)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
        at = np.fromiter(map(self.ends.get, parts, repeat(-3)), np.int64, len(parts))
        new = np.flatnonzero(at == -3).tolist()
        self.add_many([parts[i] for i in new])
        at[new] = [self.ends[parts[i]] for i in new]
        bound, back, piece, first = self.tables()
        seed = mixed(keys.astype(np.int64).view(np.uint64)[owner] + mixed(number) * GOLD)
        live, steps = np.arange(len(at)), []
        size = np.zeros(len(at), np.int64)
        while len(live) > self.few:
            u = self._drawn(seed[live], np.array([len(steps)], np.uint64))
            edge = first[at[live]]
            late = np.flatnonzero(bound[edge] <= u)
            while len(late):  # an edge further for those whose number lies beyond; the last edge's bound is beyond all
                edge[late] += 1
                late = late[bound[edge[late]] <= u[late]]
            steps.append((live, piece[edge]))
            size[live] += 1
            at[live] = back[edge]
            live = live[at[live] >= 0]
        tails = [(i, self._walk(int(at[i]), seed[i], len(steps), bound, back, piece, first)) for i in live.tolist()]
        for i, tail in tails:
            size[i] += len(tail)
        last = np.cumsum(size)
        out = np.zeros(int(last[-1]), np.int32)
        for step, (which, ids) in enumerate(steps):
            out[last[which] - 1 - step] = ids
        for i, tail in tails:
            end = int(last[i]) - len(steps)
            out[end - len(tail) : end] = tail[::-1]
        del bound, back, piece, first
        cut = np.concatenate([[0], np.cumsum(np.bincount(owner, size, len(texts)).astype(np.int64))])
        return [out[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        return spelled(self.raw, ids)


@functools.cache
def lattices(path: str, power: float) -> Lattices:
    """One table for each Python worker, kept from task to task."""
    return Lattices(path, power)


@functools.cache
def spellings(path: str) -> list[bytes]:
    """All that decoding needs; it runs in workers of its own, beside those that encode."""
    from sentencepiece import SentencePieceProcessor

    return raw_pieces(SentencePieceProcessor(model_file=path))


#: Bytes of text, or of ids, of one run.
RUN = 1_500_000


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) of runs of whole rows."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + RUN, "right")))
        yield first, last
        first = last


def _encode(path: str, power: float, seed: int):
    salt = mixed_int(seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattices(path, power)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = (mixed(batch.column(0).to_numpy().view(np.uint64)) ^ np.uint64(salt)).view(np.int64)
            for lo, hi in _runs(sizes):
                ids = own.sample(texts_of(batch.column(1).slice(lo, hi - lo)), keys[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = spellings(path)
        for batch in batches:
            sizes = 4 * pc.fill_null(pc.list_value_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in _runs(sizes):
                part = batch.slice(lo, hi - lo)
                texts = [spelled(raw, x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return run


def encode_sampled(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", power: float = 1.0, seed: int = 8) -> DataFrame:
    """doc_id and the sampled piece ``ids`` of the text. Map-only."""
    given = docs.select(known_id(id_col).alias("key"), F.col(text_col).alias("text"))
    out = given.mapInArrow(tidy(_encode(model, power, seed)), "key long, ids array<int>")
    return out.select(F.when(F.col("key") != -(2**63), F.col("key")).alias("doc_id"), "ids")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids and the ``text`` they spell."""
    return encoded.select("doc_id", "ids").mapInArrow(tidy(_decode(model)), "doc_id long, ids array<int>, text string")
