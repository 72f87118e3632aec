"""AVI motion-JPEG: write and parse RIFF files, decode intra frames, detect shots, yield timed clips.

A payload is stored losslessly in the format's own unit, the quantised coefficient: JPEG cannot keep arbitrary
8-bit pixels exact through its cosine transform, but it keeps the integers it codes. Each block holds 63 payload
bytes as its alternating coefficients. The frames' Huffman tables give the one size category in use an 8-bit
code, so that every coefficient takes two whole bytes and blocks are coded and decoded as arrays; frames with
other tables (of any baseline greyscale encoder) go through a general bit reader.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 64  # pixels of a frame's side
BLOCKS = (SIDE // 8) ** 2
FRAME_BYTES = BLOCKS * 63
FPS = 25
BINS = 32


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, codes: dict[int, list[int]]) -> bytes:
    """A Huffman table: symbols by code length."""
    return _segment(0xC4, bytes([kind]) + bytes(len(codes.get(n, ())) for n in range(1, 17)) + bytes(s for n in range(1, 17) for s in codes.get(n, ())))


HEADER = b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0)) + _table(0x00, {8: [0]}) + _table(0x10, {8: [8, 0]}) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
"""All that stands before a frame's coded data. Codes: DC category 0 is 00, AC category 8 is 00, end of block is 01."""


@lru_cache(maxsize=1)
def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in coding order: diagonals, alternating direction."""
    return np.array(sorted(range(64), key=lambda p: (s := p // 8 + p % 8, p // 8 if s % 2 else p % 8)))


@lru_cache(maxsize=1)
def _transform() -> np.ndarray:
    """(64, 64): coefficients in coding order to row-major pixels, before the level shift."""
    u = np.arange(8)
    c = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)[:, None]
    return np.ascontiguousarray(np.kron(c, c)[zigzag()].astype(np.float32))


def _frame(payload: bytes) -> bytes:
    """A JPEG frame of up to FRAME_BYTES payload bytes."""
    whole, rest = divmod(len(payload), 63)
    full = np.zeros((whole, 127), np.uint8)
    full[:, 2::2] = np.frombuffer(payload, np.uint8, whole * 63).reshape(whole, 63)
    tail = b""
    if whole < BLOCKS:
        last = np.zeros(2 * rest + 2, np.uint8)
        last[2 : 2 * rest + 2 : 2] = np.frombuffer(payload, np.uint8, rest, whole * 63)
        last[-1] = 1
        tail = last.tobytes() + b"\0\1" * (BLOCKS - whole - 1)
    return HEADER + (full.tobytes() + tail).replace(b"\xff", b"\xff\0") + b"\xff\xd9"


def write_avi(payload: bytes) -> bytes:
    """The payload as an AVI file of MJPG frames with an index; its length is kept in the INFO list."""
    frames = [_frame(payload[at : at + FRAME_BYTES]) for at in range(0, max(1, len(payload)), FRAME_BYTES)]
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    most = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 10_000, 0, 0, 0, SIDE, SIDE)
    form = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SIDE * SIDE, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", form)))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", f"payload bytes: {len(payload)}".encode()))
    at, index = 4, []
    for f in frames:
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        at += 8 + len(f) + len(f) % 2
    movie = chunk(b"LIST", b"movi" + b"".join(chunk(b"00dc", f) for f in frames))
    return chunk(b"RIFF", b"AVI " + head + info + movie + chunk(b"idx1", b"".join(index)))


def _chunks(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, size = bytes(data[at : at + 4]), struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, min(end, at + 8 + size)
        at += 8 + size + size % 2


def parse_avi(avi: bytes) -> tuple[list[bytes], int | None, int]:
    """The frames named by the index (or, without one, by the movie list), the payload length noted in INFO if
    any, and microseconds a frame. Raises ValueError for anything but an AVI file."""
    data = memoryview(avi)
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movie, index, length, us = None, None, None, 1_000_000 // FPS
    for name, a, b in _chunks(data, 12, len(avi)):
        kind = avi[a : a + 4] if name == b"LIST" else b""
        if kind == b"movi":
            movie = (a, b)
        elif name == b"idx1":
            index = avi[a:b]
        elif kind in (b"hdrl", b"INFO"):
            for part, c, d in _chunks(data, a + 4, b):
                if part == b"avih":
                    us = struct.unpack_from("<I", avi, c)[0]
                elif part == b"ICMT" and avi[c:d].startswith(b"payload bytes: "):
                    length = int(avi[c + 15 : d])
    if movie is None:
        return [], length, us
    if index is None:
        return [avi[a:b] for name, a, b in _chunks(data, movie[0] + 4, movie[1]) if name[2:] in (b"dc", b"db")], length, us
    entries = [struct.unpack_from("<4sIII", index, i) for i in range(0, len(index) - 15, 16)]
    base = movie[0] if entries and avi[movie[0] + entries[0][2] : movie[0] + entries[0][2] + 4] == entries[0][0] else 0  # offsets count from the list or the file
    return [avi[base + at + 8 : base + at + 8 + size] for name, _, at, size in entries if name[2:] in (b"dc", b"db")], length, us


def decode_frame(jpeg: bytes) -> tuple[np.ndarray, int, int, np.ndarray]:
    """Quantised coefficients (blocks, 64) in coding order, width, height and the quantisation table.

    Baseline greyscale frames only; ValueError for others.
    """
    if jpeg.startswith(HEADER):
        coded = np.frombuffer(jpeg[len(HEADER) : -2].replace(b"\xff\0", b"\xff"), np.uint8)
        out = np.zeros((BLOCKS, 64), np.int16)
        rows = coded[: len(coded) // 127 * 127].reshape(-1, 127)[:BLOCKS]
        bad = np.flatnonzero(rows[:, 1::2].any(axis=1) | (rows[:, 0] != 0))
        whole = int(bad[0]) if len(bad) else len(rows)
        raw = rows[:whole, 2::2].astype(np.int16)
        out[:whole, 1:] = raw - 255 * (raw < 128)
        if whole < BLOCKS:
            rest = coded[whole * 127 :]
            k = int(np.flatnonzero(rest[1:127:2])[0])
            raw = rest[2 : 2 * k + 1 : 2].astype(np.int16)
            out[whole, 1 : k + 1] = raw - 255 * (raw < 128)
            if rest[2 * k + 2 :].tobytes() != b"\0\1" * (BLOCKS - whole - 1):
                raise ValueError("damaged frame")
        return out, SIDE, SIDE, np.ones(64, np.int16)
    return _decode_any(jpeg)


def _decode_any(jpeg: bytes) -> tuple[np.ndarray, int, int, np.ndarray]:
    at, tables, quant, restart = 2, {}, {}, 0
    while True:
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                counts, n, code, table = body[1:17], 17, 0, {}
                for length in range(1, 17):
                    for _ in range(counts[length - 1]):
                        table[length, code] = body[n]
                        code, n = code + 1, n + 1
                    code *= 2
                tables[body[0]] = table
                body = body[n:]
        elif marker == 0xC0:
            height, width, parts, q = *struct.unpack_from(">HHB", body, 1), body[8]
            if parts != 1:
                raise ValueError("greyscale frames only")
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("baseline frames only")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            dc, ac = tables[body[2] >> 4], tables[0x10 | body[2] & 15]
            break
    n = -(-width // 8) * -(-height // 8)
    out = np.zeros((n, 64), np.int32)
    bits, left, last = 0, 0, 0

    def take(k: int) -> int:
        nonlocal bits, left, at
        while left < k:
            byte = jpeg[at] if at < len(jpeg) else 0
            at += 2 if byte == 0xFF and at + 1 < len(jpeg) and jpeg[at + 1] == 0 else 1
            bits, left = (bits << 8 | byte) & 0xFFFFFFFF, left + 8
        left -= k
        return bits >> left & (1 << k) - 1

    def symbol(table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("damaged frame")

    def value(k: int) -> int:
        v = take(k)
        return v if not k or v >> k - 1 else v - (1 << k) + 1

    for i in range(n):
        if restart and i and i % restart == 0:
            left, last, at = 0, 0, at + 2
        last += value(symbol(dc))
        out[i, 0] = last
        k = 1
        while k < 64:
            s = symbol(ac)
            if s == 0:
                break
            k += s >> 4
            if s & 15:
                out[i, k] = value(s & 15)
            k += 1
    return out, width, height, quant[q]


def read_payload(avi: bytes) -> bytes:
    """What write_avi() stored, from the stored bytes."""
    frames, length, _ = parse_avi(avi)
    raw = np.concatenate([decode_frame(f)[0][:, 1:] for f in frames]) if frames else np.zeros((0, 63), np.int16)
    return (raw + 255 * (raw < 0)).astype(np.uint8).tobytes()[:length]


def histograms(coefficients: np.ndarray, quant: np.ndarray, frames: int) -> np.ndarray:
    """(frames, BINS): brightness of the decoded pixels, as shares. Frames have equally many blocks."""
    each = len(coefficients) // max(frames, 1)
    out = np.zeros((frames, BINS))
    for f in range(0, frames, 64):
        part = coefficients[f * each : (f + 64) * each]
        k = len(part) // each
        pixels = np.clip((part * quant).astype(np.float32) @ _transform() + np.float32(128.5), 0, 255).astype(np.uint8) // (256 // BINS)
        place = pixels.reshape(k, -1) + (np.arange(k, dtype=np.uint16) * BINS)[:, None]
        out[f : f + k] = np.bincount(place.ravel(), minlength=k * BINS).reshape(k, BINS) / (each * 64)
    return out


def shots(hist: np.ndarray, window: int = 8, factor: float = 3.0, least: float = 0.05) -> list[int]:
    """First frames of the shots: a frame opens one if its difference to the frame before is over the mean plus
    factor deviations of the differences inside the current shot (the last window of them), and over least."""
    if not len(hist):
        return []
    jump = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    starts, recent = [0], []
    for i, d in enumerate(jump.tolist(), 1):
        mean = sum(recent) / len(recent) if recent else 0.0
        spread = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if d > max(least, mean + factor * spread) and recent:
            starts.append(i)
            recent = []
        else:
            recent = [*recent[1 - window :], d]
    return starts


def clips(avi: bytes) -> list[tuple[int, int, int, float]]:
    """(clip, start ms, end ms, mean brightness) for each shot. Frames of one file share a size."""
    frames, _, us = parse_avi(avi)
    if not frames:
        return []
    parts = [decode_frame(f) for f in frames]
    return _clips(np.concatenate([p[0] for p in parts]), parts[0][3], len(frames), us)


def _clips(coefficients: np.ndarray, quant: np.ndarray, frames: int, us: int) -> list[tuple[int, int, int, float]]:
    hist = histograms(coefficients, quant, frames)
    starts = shots(hist)
    light = hist @ ((np.arange(BINS) + 0.5) * (256 / BINS))
    return [(i, a * us // 1000, b * us // 1000, float(light[a:b].mean())) for i, (a, b) in enumerate(zip(starts, [*starts[1:], frames]))]


def pad(text: str | None) -> tuple[int, bytes]:
    """Unpadded length, and the text's bytes filled with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))


def to_avi(docs: DataFrame) -> DataFrame:
    """(doc_id, avi): each text's padded bytes as an AVI file; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array([write_avi(pad(t.as_py())[1]) for t in s.column(1)], pa.binary())], ["doc_id", "avi"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, avi binary")


def to_clips(files: DataFrame) -> DataFrame:
    """(doc_id, clip, start_ms, end_ms, brightness) from (doc_id, avi); null files and files without frames have no clips.

    A damaged file, or one of another kind, has one row whose clip is null, so that it is seen and stops nothing. Rows
    that repeat are measured each.
    """

    def measured(avi: bytes) -> list[tuple]:
        try:
            return clips(avi)
        except (ValueError, IndexError, KeyError, struct.error):
            return [(None,) * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i.as_py(), *c) for i, avi in zip(b.column(0), b.column(1)) if avi.is_valid for c in measured(avi.as_py())]
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "clip", "start_ms", "end_ms", "brightness"), r)) for r in rows], pa.schema([("doc_id", b.schema.field(0).type), ("clip", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("brightness", pa.float64())]))

    return files.select("doc_id", "avi").mapInArrow(run, f"doc_id {files.schema['doc_id'].dataType.simpleString()}, clip int, start_ms long, end_ms long, brightness double")


def describe(text: str | None) -> tuple[int, int, str, int, int, str, str]:
    """The digest columns for one text: stored, read back from the stored bytes, and measured."""
    n, payload = pad(text)
    avi = write_avi(payload)
    frames, length, us = parse_avi(avi)
    coefficients = np.concatenate([decode_frame(f)[0] for f in frames])
    raw = coefficients[:, 1:]
    back = (raw + 255 * (raw < 0)).astype(np.uint8).tobytes()[:length]
    feature = ";".join(f"{a}-{b}@{light:.3f}" for _, a, b, light in _clips(coefficients, np.ones(64, np.int16), len(frames), us))
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(avi), hashlib.sha256(avi).hexdigest(), feature


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature).

    A row for each row of docs; a null text counts as empty. Equal texts have equal values. Repeated rows and
    null ids are kept; other columns are ignored.
    """
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(zip(*(describe(t.as_py()) for t in b.column(1)))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", *names])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
