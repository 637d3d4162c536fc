"""Media columns: AVI motion-JPEG. RIFF indexes are parsed, intra frames decoded, shots found by adaptive histogram differences.

Three column operators, each map-only and one document at a time in memory:

* ``to_avi``: bytes to an AVI whose frames are baseline JPEGs of flat 8x8 blocks, one block a byte. Only the block means are
  coded and their quantiser is 8, so every sample comes back exactly. The Huffman code gives a difference of s bits a word of
  9 - s bits: each block takes ten bits, and whole frames are coded and decoded as arrays.
* ``decode_avi``: any baseline (Huffman, sequential, 8-bit) motion-JPEG AVI to frames. Frames of the layout above are decoded as
  arrays, others coefficient by coefficient with the inverse cosine transform.
* ``clips``: timed rows, one for each shot.

Edge cases: a null or empty text is one frame of bytes 255; an unreadable AVI gives no clips and a reason in ``error``; ids may be
null or repeat; an empty table gives an empty result; very long texts are worked off in runs of frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

SIDE = 24
UNIT = SIDE * SIDE
FPS = 25

# Fixed values of the JPEG standard: the zigzag order of an 8x8 block.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


@cache
def frame_head() -> bytes:
    """Everything before the coded blocks; equal for all frames."""
    quant = _segment(0xDB, b"\0" + bytes([8] * 64))
    frame = _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE * 8, SIDE * 8, 1, 1, 0x11, 0))
    # One code of each length 1 .. 9, for 8 bits down to none; its words never are all ones.
    dc = _segment(0xC4, bytes([0x00, *[1] * 9, *[0] * 7, *range(8, -1, -1)]))
    ac = _segment(0xC4, bytes([0x10, 1, *[0] * 15, 0]))
    scan = _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    return b"\xff\xd8" + quant + frame + dc + ac + scan


@cache
def words() -> tuple[np.ndarray, np.ndarray]:
    """Ten-bit word of each difference -255 .. 255 (at +255), and the difference of each word."""
    code, back, nxt = np.zeros(511, np.uint16), np.zeros(1024, np.int16), {}
    first = 0
    for length, s in zip(range(1, 10), range(8, -1, -1), strict=True):
        nxt[s] = (first, length)
        first = (first + 1) << 1
    for d in range(-255, 256):
        s = abs(d).bit_length()
        value, _ = nxt[s]
        extra = d if d >= 0 else d + (1 << s) - 1
        code[d + 255] = ((value << s) | extra) << 1  # and the one-bit end of block, 0
        back[code[d + 255]] = d
    return code, back


def scans(frames: np.ndarray) -> list[bytes]:
    """Coded blocks of frames (n, UNIT) of uint8."""
    level = frames.astype(np.int16) - 128
    diff = np.diff(level, axis=1, prepend=np.int16(0))
    w = words()[0][diff + 255].astype(np.uint64).reshape(len(frames), -1, 4)
    packed = w[..., 0] << np.uint64(30) | w[..., 1] << np.uint64(20) | w[..., 2] << np.uint64(10) | w[..., 3]
    raw = packed.astype(">u8").view(np.uint8).reshape(len(frames), -1, 8)[..., 3:].reshape(len(frames), -1)
    return [x.tobytes().replace(b"\xff", b"\xff\0") for x in raw]


def unscans(coded: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(x.replace(b"\xff\0", b"\xff") for x in coded), np.uint8).reshape(len(coded), -1, 5)
    wide = np.zeros((*raw.shape[:2], 8), np.uint8)
    wide[..., 3:] = raw
    packed = wide.view(">u8")[..., 0].astype(np.uint64)
    w = np.stack([(packed >> np.uint64(k)) & np.uint64(1023) for k in (30, 20, 10, 0)], axis=-1).reshape(len(coded), -1)
    return (np.cumsum(words()[1][w], axis=1, dtype=np.int32) + 128).astype(np.uint8)


def payload_of(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def encode_avi(payload: bytes) -> bytes:
    """An AVI 1.0 file with an ``idx1`` index, one JPEG a frame."""
    frames = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    head, tail = frame_head(), b"\xff\xd9"
    parts, index, at = [], [], 4
    for lo in range(0, len(frames), 2048):
        for scan in scans(frames[lo : lo + 2048]):
            size = len(head) + len(scan) + 2
            parts += [b"00dc", struct.pack("<I", size), head, scan, tail, b"\0" * (size & 1)]
            index.append(struct.pack("<4sIII", b"00dc", 16, at, size))
            at += 8 + size + (size & 1)
    side = SIDE * 8
    main = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, len(frames), 0, 1, 0, side, side, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), 0, 0xFFFFFFFF, 0, 0, 0, side, side)
    shape = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 24, b"MJPG", side * side * 3, 0, 0, 0, 0)
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    headers = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", shape)))
    body = headers + chunk(b"LIST", b"movi" + b"".join(parts)) + chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"AVI " + body


class BadMedia(ValueError):
    pass


def chunks_of(data: bytes, lo: int, hi: int) -> Iterator[tuple[bytes, int, int]]:
    while lo + 8 <= hi:
        name, size = data[lo : lo + 4], struct.unpack_from("<I", data, lo + 4)[0]
        yield name, lo + 8, min(hi, lo + 8 + size)
        lo += 8 + size + (size & 1)


def parse_avi(data: bytes) -> tuple[float, list[bytes]]:
    """Seconds a frame, and the JPEGs of the first video stream in the order of the index (of the movi list where none is)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise BadMedia("no AVI")
    each, index, movi = 1 / FPS, None, None
    for name, lo, hi in chunks_of(data, 12, len(data)):
        if name == b"LIST" and data[lo : lo + 4] == b"hdrl":
            for inner, a, _ in chunks_of(data, lo + 4, hi):
                if inner == b"avih":
                    each = struct.unpack_from("<I", data, a)[0] / 1e6
        elif name == b"LIST" and data[lo : lo + 4] == b"movi":
            movi = (lo, hi)
        elif name == b"idx1":
            index = [struct.unpack_from("<4sIII", data, x) for x in range(lo, hi - 15, 16)]
    if movi is None:
        raise BadMedia("no movi list")
    if index is not None:
        spots = [x for x in index if x[0][2:] in (b"dc", b"db")]
        base = movi[0] if not spots or spots[0][2] < movi[0] else 0
        found = [data[base + at + 8 : base + at + 8 + size] for _, _, at, size in spots]
    else:
        found = [data[a:b] for name, a, b in chunks_of(data, movi[0] + 4, movi[1]) if name[2:] in (b"dc", b"db")]
    return each, found


def decode_jpeg(data: bytes) -> np.ndarray:
    """(height, width, components) of uint8 of any baseline JPEG; components are not converted."""
    at, quant, huff, shape, restart = 2, {}, {}, None, 0
    if data[:2] != b"\xff\xd8":
        raise BadMedia("no JPEG")
    while True:
        if at + 4 > len(data) or data[at] != 255:
            raise BadMedia("broken JPEG")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide, to = body[k] >> 4, body[k] & 15
                quant[to] = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1).astype(np.float64)
                k += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts, table, code, p = body[k + 1 : k + 17], {}, 0, k + 17
                for length, n in enumerate(counts, 1):
                    for _ in range(n):
                        table[length, code] = body[p]
                        code, p = code + 1, p + 1
                    code <<= 1
                huff[body[k]] = table
                k = p
        elif marker in (0xC0, 0xC1):
            _, height, width, n = struct.unpack_from(">BHHB", body)
            shape = (height, width, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)])
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif 0xC2 <= marker <= 0xCF:
            raise BadMedia("not a baseline JPEG")
        elif marker == 0xDA:
            break
    if shape is None:
        raise BadMedia("no frame header")
    tables = {body[1 + 2 * i]: (huff[body[2 + 2 * i] >> 4], huff[16 | body[2 + 2 * i] & 15]) for i in range(body[0])}
    end = data.rfind(b"\xff\xd9")
    return _blocks(data[at : end if end >= at else len(data)], shape, quant, tables, restart)


def _blocks(scan: bytes, shape: tuple, quant: dict, tables: dict, restart: int) -> np.ndarray:
    height, width, parts = shape
    across, down = max(p[1] for p in parts), max(p[2] for p in parts)
    cols, rows = -(-width // (8 * across)), -(-height // (8 * down))
    planes = [np.zeros((rows * v * 8, cols * h * 8)) for _, h, v, _ in parts]
    turn = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])
    pieces, k = [], 0
    while (n := scan.find(b"\xff", k)) >= 0 and n + 1 < len(scan):
        if 0xD0 <= scan[n + 1] <= 0xD7:
            pieces.append(scan[:n])
            scan, k = scan[n + 2 :], 0
        else:
            k = n + 2
    pieces.append(scan)
    bits, spot, last = "", 0, [0] * len(parts)

    def number(table: dict) -> int:
        nonlocal spot
        code = 0
        for length in range(1, 17):
            if spot >= len(bits):
                raise BadMedia("scan too short")
            code, spot = code << 1 | (bits[spot] == "1"), spot + 1
            if (length, code) in table:
                return table[length, code]
        raise BadMedia("unknown code")

    def extra(s: int) -> int:
        nonlocal spot
        if not s:
            return 0
        x, spot = int(bits[spot : spot + s], 2), spot + s
        return x if x >> (s - 1) else x - (1 << s) + 1

    for unit in range(rows * cols):
        if unit == 0 or restart and unit % restart == 0:
            if not pieces:
                raise BadMedia("scan too short")
            piece = pieces.pop(0).replace(b"\xff\0", b"\xff")
            bits, spot, last = bin(int.from_bytes(b"\1" + piece))[3:], 0, [0] * len(parts)
        for i, (name, h, v, q) in enumerate(parts):
            dc, ac = tables[name]
            for y in range(v):
                for x in range(h):
                    block = np.zeros(64)
                    last[i] += extra(number(dc))
                    block[0], k = last[i], 1
                    while k < 64:
                        rs = number(ac)
                        if not rs & 15:
                            if rs != 0xF0:
                                break
                            k += 16
                            continue
                        k += rs >> 4
                        if k > 63:
                            raise BadMedia("too many coefficients")
                        block[k], k = extra(rs & 15), k + 1
                    flat = np.zeros(64)
                    flat[ZIGZAG] = block * quant[q]
                    r, c = (unit // cols * v + y) * 8, (unit % cols * h + x) * 8
                    planes[i][r : r + 8, c : c + 8] = turn @ flat.reshape(8, 8) @ turn.T + 128
    full = [np.repeat(np.repeat(p, down // v, 0), across // h, 1)[:height, :width] for p, (_, h, v, _) in zip(planes, parts, strict=True)]
    return np.clip(np.rint(np.stack(full, axis=-1)), 0, 255).astype(np.uint8)


def samples_of(jpegs: list[bytes]) -> np.ndarray:
    """Block means of the first component, a row a frame (frames must agree in size)."""
    head = frame_head()
    if all(x.startswith(head) for x in jpegs):
        return unscans([x[len(head) : -2] for x in jpegs])
    out = []
    for x in jpegs:
        plane = decode_jpeg(x)[..., 0]
        h, w = (plane.shape[0] // 8 or 1) * 8, (plane.shape[1] // 8 or 1) * 8
        plane = np.pad(plane, ((0, max(0, h - plane.shape[0])), (0, max(0, w - plane.shape[1]))), "edge")[:h, :w]
        out.append(np.rint(plane.reshape(h // 8, 8, w // 8, 8).mean((1, 3))).astype(np.uint8).ravel())
    if len({len(x) for x in out}) > 1:
        raise BadMedia("frames of different sizes")
    return np.stack(out) if out else np.zeros((0, UNIT), np.uint8)


def cuts(frames: np.ndarray, window: int = 12, factor: float = 3.0, floor: float = 0.15) -> list[int]:
    """First frames of shots after the first: where the distance of 16-bin histograms to the frame before exceeds
    ``floor`` and the mean plus ``factor`` deviations of the ``window`` distances before it."""
    n = len(frames)
    if n < 2:
        return []
    hist = np.zeros((n, 16), np.int64)
    for lo in range(0, n, 4096):
        part = frames[lo : lo + 4096]
        np.add.at(hist, (np.repeat(np.arange(lo, lo + len(part)), part.shape[1]), (part >> 4).ravel()), 1) if part.shape[1] < 64 else hist.__setitem__(slice(lo, lo + len(part)), np.stack([np.count_nonzero((part >> 4) == b, axis=1) for b in range(16)], axis=1))
    d = np.abs(np.diff(hist, axis=0)).sum(1) / (2 * frames.shape[1])
    s1, s2 = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    i = np.arange(len(d))
    lo = np.maximum(0, i - window)
    m = np.maximum(1, i - lo)
    mean = (s1[i] - s1[lo]) / m
    dev = np.sqrt(np.maximum(0, (s2[i] - s2[lo]) / m - mean**2))
    return (np.flatnonzero((d > floor) & (d > mean + factor * dev)) + 1).tolist()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, media, held = [], [], [], 0
        for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = data or b""
            ids.append(doc)
            sizes.append(len(data))
            media.append(encode_avi(payload_of(data)))
            held += len(media[-1])
            if held > 16_000_000:
                yield _media(ids, sizes, media)
                ids, sizes, media, held = [], [], [], 0
        yield _media(ids, sizes, media)


def _media(ids: list, sizes: list, media: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def to_avi(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (unpadded) and the ``media`` column."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("data"))
    return given.mapInArrow(tidy(_encode), "doc_id long, n_bytes long, media binary")


CLIPS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, seconds double, shots array<struct<shot int, start_frame long, end_frame long, start_s double, end_s double, mean double>>, error string"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames", "seconds", "shots", "error"]
    shot = pa.struct([("shot", pa.int32()), ("start_frame", pa.int64()), ("end_frame", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("mean", pa.float64())])
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.list_(shot), pa.string()]
    for batch in batches:
        rows = []
        for doc, n, media in zip(*(batch.column(i) for i in range(3)), strict=True):
            media = media.as_py() or b""
            row = [doc.as_py(), n.as_py(), None, None, None, len(media), hashlib.sha256(media).hexdigest(), 0, 0.0, [], None]
            try:
                each, jpegs = parse_avi(media)
                frames = samples_of(jpegs)
                payload = frames.tobytes()
                bounds = [0, *cuts(frames), len(frames)] if len(frames) else [0]
                shots = [{"shot": i, "start_frame": a, "end_frame": b, "start_s": a * each, "end_s": b * each, "mean": float(frames[a:b].mean())} for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
                row[2:5] = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])
                row[7:10] = len(frames), len(frames) * each, shots
            except (BadMedia, struct.error, KeyError, IndexError) as e:
                row[10] = f"{type(e).__name__}: {e}"
            rows.append(row)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names)


def decode_avi(media: DataFrame) -> DataFrame:
    """A row per medium: what was read back, its digests, and its shots."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidy(_decode), CLIPS)


def clips(decoded: DataFrame) -> DataFrame:
    """A timed row for each shot."""
    return decoded.select("doc_id", F.explode("shots").alias("s")).select("doc_id", "s.*")
