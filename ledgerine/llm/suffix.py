"""Suffix dedup: windows dealt out by a minimal string, then ordered by most-significant-digit passes to their full depth.

A radix sort of all suffixes moves a row for each byte of text. Here the first pass, which deals suffixes to tasks, is not by
their first bytes but by a string inside them, so that a run of neighbouring suffixes is one row; the passes after it take the digits
in order. Equal groups after the last pass are exactly the repeated windows.

1. Minimal string. A window's key is the 48-byte string of smallest hash inside it (leftmost on ties) and where it stands. Equal windows
   have equal keys, and neighbouring windows share one, so a run of them (a block) is a single row of about one per 64 bytes of
   text. Neighbouring blocks of the same bytes, as a text of one period has them, are one row with the number of times. Only strings that
   occur twice go on.
2. Content: a keyed digest of the block's bytes. Blocks that occur twice are settled, all their windows repeat.
3. Digits, for blocks whose string occurs with other contents: one block of each kind shows its bytes. While more than ``most`` kinds share
   a string, they are dealt out anew by more bytes around it: windows in whose front half the string lies share more bytes behind it, the others
   more bytes before it, so a block goes two ways, and at the ninth step at the latest all 200 bytes of a window are its key.
   Up to ``most`` kinds are one task's: their windows are refined by eight bytes a pass until ``window`` bytes are read, and a group that
   holds one window leaves after each pass. Both compare bytes, so where the border lies changes nothing but the tasks.

All bytes that a repeated window covers are removed, the first copy too. Matches never cross documents; windows are judged on
the input. Strings and contents that hold a large share of all blocks are broadcast, so no task gathers the copies of a hot passage.

Edge cases: a null text is the empty text; texts below ``window`` bytes stay as they are; texts of any length are cut into overlapping
runs; rows that repeat an id and a text are copies of each other and lose everything; null ids are ids; an empty table gives an
empty result; other columns are carried through, and result names replace columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_texts, join_counted, known_id, mixed, tidy, written

GRAM = 48
SLICE = 1_000_000
#: Kinds of one string that a task orders together; of more, the rest is dealt out by further bytes first.
MOST = 5000
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
STEPS = [0x5851F42D4C957F2D]
while len(STEPS) < 31:
    STEPS.append(STEPS[-1] * STEPS[-1] % 2**64)
STEPS = [np.uint64(x) for x in STEPS]


def hashes(data: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Of each length the hash of the bytes from each position on, by doubling: log2(length) passes over the data."""
    part, size, level, n = BYTES[data], 1, 0, len(data)
    done: dict[int, tuple[np.ndarray | None, int]] = dict.fromkeys(lengths, (None, 0))
    while size <= max(lengths):
        for length in lengths:
            if length & size:
                own, a = done[length]
                m = max(0, n - a - size + 1)
                done[length] = (part[:m] if own is None else own[:m] * STEPS[level] + part[a : a + m], a + size)
        m = max(0, len(part) - size)
        part = part[:m] * STEPS[level] + part[size : size + m]
        size, level = size * 2, level + 1
    return {length: mixed(done[length][0]) for length in lengths}


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    size, low = 1, v
    while size * 2 <= width:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    m = len(v) - width + 1
    return np.minimum(low[:m], low[width - size : width - size + m])


def same_behind(data: np.ndarray, first: np.ndarray, shift: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ``length`` bytes from each place on are those ``shift`` places later."""
    out = np.zeros(len(first), bool)
    for n in np.unique(shift).tolist():
        own = np.flatnonzero(shift == n)
        other = np.concatenate([[0], np.cumsum(data[:-n] != data[n:], dtype=np.int32)])
        out[own] = other[first[own] + length[own]] == other[first[own]]
    return out


def blocks_of(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(text, first window start within it, string's place behind that, windows, times, string hash, content digest) of each block."""
    if len(data) < window:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    h = hashes(data, (GRAM,))[GRAM]
    packed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    at = (sliding_min(packed, window - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    start = np.flatnonzero(np.arange(window, len(at) + window) <= offsets[text + 1])
    if not len(start):
        return blocks_of(data[:0], offsets[:1], window)
    at, text = at[start], text[start]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    first, n = start[new], np.diff(np.append(new, len(start)))
    where, string, text = at[new] - first, h[at[new]], text[new]
    again = np.flatnonzero((string[1:] == string[:-1]) & (where[1:] == where[:-1]) & (n[1:] == n[:-1]) & (text[1:] == text[:-1]))
    again = again[same_behind(data, first[again], n[again], n[again] - 1 + window)]
    heads = np.ones(len(first), bool)
    heads[again + 1] = False
    heads = np.flatnonzero(heads)
    times = np.diff(np.append(heads, len(first)))
    first, where, n = first[heads], where[heads], n[heads]
    raw, content = memoryview(data.tobytes()), []
    for a, w, m in zip(first.tolist(), where.tolist(), n.tolist(), strict=True):
        content.append(hashlib.blake2b(raw[a : a + m - 1 + window], digest_size=8, salt=bytes((w, m))).digest())
    content = np.frombuffer(b"".join(content), np.int64)
    return text[heads], first - offsets[text[heads]], where, n, times, string[heads].view(np.int64), content


def _runs(column: pa.Array, window: int):
    """(rows, their shift, bytes, offsets): whole texts, and very long ones in runs that overlap by a window less one byte."""
    for first, last, data, offsets in flat_texts(column, SLICE):
        if len(data) <= 4 * SLICE:
            yield np.arange(first, last), np.zeros(last - first, np.int64), data, offsets
        else:
            for lo in range(0, len(data), SLICE):
                part = data[lo : lo + SLICE + window - 1]
                if len(part) >= window:
                    yield np.array([first]), np.array([lo]), part, np.array([0, len(part)])


def _blocks(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for rows, shift, data, offsets in _runs(batch.column(2), window):
                text, first, where, n, times, string, content = blocks_of(data, offsets, window)
                row = rows[text] if len(text) else text
                place = tag[row].astype(np.int64) << 47 | (first + (shift[text] if len(text) else 0)) << 16 | where << 8 | n
                yield pa.RecordBatch.from_arrays([pa.array(string), pa.array(content), pa.array(key[row]), pa.array(place), pa.array(times.astype(np.int32))], ["string", "content", "key", "place", "times"])

    return run


def _shown(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            texts, held = batch.column(2), 0
            for i, wanted in enumerate(batch.column(3).to_pylist()):
                data = memoryview(texts[i].as_buffer())
                for x in wanted:
                    first, n = x["place"] >> 16 & 0x7FFFFFFF, x["place"] & 255
                    body = data[first : first + n - 1 + window].tobytes()
                    for to, v in zip(out, (x["string"], x["n"], x["kinds"], batch.column(0)[i].as_py(), x["place"], body), strict=True):
                        to.append(v)
                    held += len(body)
                if held > 8_000_000:
                    yield _show(out)
                    out, held = [[] for _ in range(6)], 0
            yield _show(out)

    return run


def _show(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["string", "n", "kinds", "key", "place", "body"])


def windows_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(bytes, row, offset to the string, place in the bytes, window start) of all windows of the shown blocks, in runs."""
    bodies = batch.column(batch.schema.get_field_index("body"))
    place = batch.column(batch.schema.get_field_index("place")).to_numpy()
    for first, last, data, offsets in flat_texts(bodies, bodies.nbytes + 1):
        n = place[first:last] & 255
        row = np.repeat(np.arange(last - first), n)
        j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = place[first:last][row]
        yield data, row + first, (at >> 8 & 255) - j, offsets[:-1][row] + j, (at >> 16 & 0x7FFFFFFF) + j


def radix_repeats(data: np.ndarray, group: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The windows (places ``at``) whose bytes occur again in their group: passes over digits of eight bytes, most significant first."""
    words = np.zeros(max(0, len(data) - 7), np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | data[k : k + len(words)]
    left = np.argsort(group, kind="stable")
    group = group[left]
    for digit in [None, *range(0, window - 8, 8), window - 8]:
        key = np.zeros(len(left), np.uint64) if digit is None else words[at[left] + digit]
        split = (key[1:] != key[:-1]) & (group[1:] == group[:-1])
        if digit is not None and not split.any():
            continue
        number = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]])) if len(left) else group
        mixed_up = np.zeros(len(left) and number[-1] + 1, bool)
        mixed_up[number[1:][split]] = True
        rows = np.flatnonzero(mixed_up[number])  # of groups that hold several digits
        order = rows[np.lexsort((key[rows], number[rows]))]
        key[rows], left[rows] = key[order], left[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (number[1:] != number[:-1])])[: len(left)]
        group = np.cumsum(new) - 1
        several = np.bincount(group, minlength=1)[group] > 1
        left, group = left[several], group[several]
        if not len(left):
            break
    return np.sort(left)


def _spans(key: np.ndarray, place: np.ndarray, row: np.ndarray, start: np.ndarray, window: int) -> pa.RecordBatch:
    """Maximal runs of window starts (sorted by row, start) as spans."""
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])) if len(row) else np.zeros(0, np.int64)
    last = np.append(new[1:] - 1, len(row) - 1) if len(row) else new
    span = start[new] << 32 | (start[last] + window)
    return pa.RecordBatch.from_arrays([pa.array(key[row[new]]), pa.array((place[row[new]] >> 47).astype(np.int32)), pa.array(span)], ["key", "tag", "span"])


#: Rows whose windows are compared at once, unless one string has more: a window takes some hundred bytes, and a row has many.
AT_ONCE = 2048


def _settle(window: int):
    """Input sorted by string; every string's kinds come to one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in (batch.slice(lo, AT_ONCE) for batch in batches for lo in range(0, batch.num_rows, AT_ONCE)):
            table = pa.Table.from_batches([batch])
            left = table if left is None else pa.concat_tables([left, table])
            string = left["string"].to_numpy()
            end = int(np.searchsorted(string, string[-1])) if len(string) else 0
            if end and left.num_rows > 1024:
                yield from done(left.slice(0, end))
                left = left.slice(end)
        if left is not None and left.num_rows:
            yield from done(left)

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        batch = table.combine_chunks().to_batches()[0]
        string, key, place, count, low, high = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("string", "key", "place", "n", "low", "high"))
        number = np.cumsum(np.concatenate([[0], string[1:] != string[:-1]]))
        for data, row, off, at, start in windows_of(batch):
            here = np.flatnonzero((off >= low[row]) & (off <= high[row]))
            row, off, at, start = row[here], off[here], at[here], start[here]
            found = radix_repeats(data, number[row] * 256 + off, at, window)
            found = found[count[row[found]] == 1]
            yield _spans(key, place, row[found], start[found], window)

    return run


def _deal(window: int):
    """Each kind by halves of the places at which its string may stand in a window, keyed by the bytes that all windows of a half share."""
    names = ["string", "n", "key", "place", "body", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, lows, highs = [], [], [], []
            own = [batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("place", "body", "low", "high")]
            for i, (place, body, low, high) in enumerate(zip(*own, strict=True)):
                at, n = place >> 8 & 255, place & 255
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    if a <= at and at - n + 1 <= b:
                        key = hashlib.blake2b(body[at - a : at - b + window], digest_size=8, salt=bytes((a, b))).digest()
                        for to, x in zip((rows, keys, lows, highs), (i, int.from_bytes(key, "little", signed=True), a, b), strict=True):
                            to.append(x)
            n, key, place, body = (batch.column(batch.schema.get_field_index(x)).take(pa.array(rows, pa.int64())) for x in ("n", "key", "place", "body"))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), n, key, place, body, pa.array(lows, pa.int32()), pa.array(highs, pa.int32())], names)

    return run


def _cut(names: list[str], text_at: int, as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(text_at), batch.column(batch.num_columns - 1)
            sizes, removed, runs, digests, kept = [], [], [], [], []
            for i in range(batch.num_rows):
                own = texts[i].as_buffer()
                data = b"" if own is None else own.to_pybytes()
                ranges = merged(spans[i].as_py())
                parts = [data[a:b] for a, b in zip([0, *(e for _, e in ranges)], [*(s for s, _ in ranges), len(data)], strict=True)]
                left = b"".join(parts)
                sizes.append(len(data))
                removed.append(len(data) - len(left))
                runs.append(len(ranges))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append("".join(x.decode(errors="ignore") for x in parts) if as_text else left)
            own = [c for i, c in enumerate(batch.columns[:-1]) if i != text_at]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)), pa.array(digests, pa.string()), pa.array(kept, pa.string() if as_text else pa.binary())], names)

    return run


def merged(spans: list[int] | None) -> list[tuple[int, int]]:
    """Maximal ranges that the spans (start << 32 | end) cover; ranges that touch are one."""
    out: list[tuple[int, int]] = []
    for x in sorted(spans or ()):
        start, end = x >> 32, x & 0xFFFFFFFF
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def repeated_spans(keyed: DataFrame, window: int, most: int = MOST) -> DataFrame:
    """(key, tag, spans) for (key, tag, text): the bytes that repeated windows cover."""
    if not GRAM < window <= GRAM + 254:
        raise ValueError(f"window must lie between {GRAM + 1} and {GRAM + 254}")
    blocks = written(keyed.mapInArrow(tidy(_blocks(window)), "string long, content long, key long, place long, times int"))
    again = written(blocks.groupBy("string").agg(F.count("*").alias("c"), F.sum("times").alias("n")).where("n > 1").drop("n"))
    rows = written(join_counted(blocks, again, ["string"], "c", blocks.count()).drop("c"))
    kinds = rows.groupBy("string", "content").agg(F.sum("times").alias("n"), F.count("*").alias("copies"), F.min("key").alias("key"), F.min_by("place", "key").alias("place"))
    several = kinds.groupBy("string").agg(F.count("*").alias("kinds")).where("kinds > 1")
    kinds = written(kinds.join(several, "string", "left").where("n > 1 or kinds > 1"))
    first, n = F.col("place").bitwiseAND(0x7FFFFFFF0000), F.col("place").bitwiseAND(255)
    tag = F.shiftright("place", 47).cast("int").alias("tag")
    settled = join_counted(rows, kinds.where("n > 1").select("string", "content", "copies"), ["string", "content"], "copies", rows.count())
    settled = settled.select("key", tag, (F.shiftleft(first, 16) + F.shiftright(first, 16) + n * F.col("times") + (window - 1)).alias("span"))
    wanted = kinds.where("kinds > 1").select("key", tag, F.struct("string", "place", "n", "kinds").alias("x")).groupBy("key", "tag").agg(F.collect_list("x").alias("wanted"))
    shown = keyed.join(wanted, ["key", "tag"]).select("key", "tag", "text", "wanted")
    shown = written(shown.mapInArrow(tidy(_shown(window)), "string long, n long, kinds long, key long, place long, body binary"))
    left = shown.withColumns({"low": F.lit(0), "high": F.lit(window - GRAM)})
    spans = settled
    while True:
        few = left.where((F.col("kinds") <= most) & (F.col("low") < F.col("high"))).repartition("string").sortWithinPartitions("string")
        spans = spans.unionByName(few.mapInArrow(tidy(_settle(window)), "key long, tag int, span long"))
        many = left.where((F.col("kinds") > most) & (F.col("low") < F.col("high")))
        if many.isEmpty():
            break
        dealt = written(many.mapInArrow(tidy(_deal(window)), "string long, n long, key long, place long, body binary, low int, high int"))
        counts = written(dealt.groupBy("string").agg(F.count("*").alias("kinds")).where("kinds > 1"))
        left = written(join_counted(dealt, counts, ["string"], "kinds", dealt.count()))
        whole = left.where("low = high").withColumns({"behind": F.shiftright("place", 8).bitwiseAND(255).cast("int") - F.col("low")})
        whole = whole.withColumn("bytes", F.col("body").substr(F.col("behind") + 1, F.lit(window)))
        twice = whole.groupBy("bytes").agg(F.count("*").alias("c")).where("c > 1")
        start = F.shiftright(first, 16) + F.col("behind")
        same = join_counted(whole.where("n = 1"), written(twice), ["bytes"], "c", left.count())
        spans = spans.unionByName(same.select("key", tag, (F.shiftleft(start, 32) + start + window).alias("span")))
    return spans.groupBy("key", "tag").agg(F.collect_set("span").alias("spans"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, as_text: bool = False, most: int = MOST) -> DataFrame:
    """The columns of ``docs`` but the text, and n_bytes, n_removed, n_spans, kept_sha256, kept: binary, as a cut may split a character, or ``as_text`` without split characters."""
    names = [n for n in docs.columns if n not in (text_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")]
    text = F.encode(F.col(text_col), "UTF-8")
    key, tag = F.xxhash64(known_id(id_col), F.col(text_col)).alias("key"), F.pmod(F.hash(F.col(text_col), known_id(id_col)), F.lit(65536)).alias("tag")
    keyed = docs.select(key, tag, text.alias("text")).where(F.octet_length("text") >= window)
    spans = repeated_spans(keyed, window, most)
    full = docs.select(key, tag, *[F.col(f"`{n}`").alias(f"_c{i}") for i, n in enumerate(names)], text.alias("text"))
    full = full.join(spans, ["key", "tag"], "left").drop("key", "tag")
    out = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    fields = ", ".join([*(f"_c{i} {docs.schema[n].dataType.simpleString()}" for i, n in enumerate(names)), "n_bytes long, n_removed long, n_spans long, kept_sha256 string", "kept string" if as_text else "kept binary"])
    cut = full.mapInArrow(tidy(_cut([*(f"_c{i}" for i in range(len(names))), *out], len(names), as_text)), fields)
    return cut.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)], *out)
