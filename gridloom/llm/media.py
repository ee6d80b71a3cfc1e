"""Media columns: motion JPEG in AVI, with shots from adaptive histogram differences.

A payload is stored as grey frames of 16 x 12 samples. Each sample is the DC term of one flat 8 x 8 block of a baseline
JPEG (quantiser 8, so the term is the sample less 128): a frame decodes to 128 x 96 pixels in any JPEG reader and
loses nothing. Frames lie in the ``movi`` list of a RIFF AVI file with an ``idx1`` index.

Reading walks the RIFF chunks, takes the frames from the index (from the list where there is none) and decodes all
frames of one geometry together, one symbol of every frame a step. Shots are detected on the DC plane: a cut is a
frame whose histogram moves more than the local mean by three deviations and by a fifth of the samples at least.

Defined cases: null text is the empty text, whose payload is 192 spaces; equal texts give equal bytes; an empty table
gives an empty result; columns other than id and text are ignored. A file is limited to 4 GB, as RIFF is; frames with
restart intervals or progressive coding raise ``ValueError`` (``media_clips`` reports it in the row).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts

FRAME_BYTES, COLUMNS, LINES, FPS = 192, 16, 12, 25
#: Frames that are coded or decoded together.
LANES = 4096
BINS, REACH, DEVIATIONS, LEAST_MOVE = 16, 8, 3.0, 0.2

#: JPEG's zigzag order by rule: along anti-diagonals, in turns up and down.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i % 8 if (i // 8 + i % 8) % 2 == 0 else i // 8))))

#: The frames' own Huffman tables: how many codes of each length, and the symbols by length.
DC_COUNTS, DC_SYMBOLS = (0, 0, 6, 2, 1, *[0] * 11), (3, 4, 5, 6, 7, 2, 1, 0, 8)
AC_COUNTS, AC_SYMBOLS = (1, *[0] * 15), (0,)


def _run_sizes(*first: int) -> tuple[int, ...]:
    """All symbols of AC terms: those of the short codes, then the others in ascending order."""
    every = {0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))}
    return (*first, *sorted(every - {*first}))


#: The tables that JPEG lists as typical, for luminance and colour. Motion-JPEG frames may leave them out.
TYPICAL_TABLES = {
    0x00: ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))),
    0x01: ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), tuple(range(12))),
    0x10: (
        (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125),
        _run_sizes(
            0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14, 0x32, 0x81, 0x91, 0xA1, 0x08, 0x23, 0x42,
            0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72, 0x82,
        ),
    ),
    0x11: (
        (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119),
        _run_sizes(
            0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13, 0x22, 0x32, 0x81, 0x08, 0x14, 0x42, 0x91, 0xA1, 0xB1,
            0xC1, 0x09, 0x23, 0x33, 0x52, 0xF0, 0x15, 0x62, 0x72, 0xD1, 0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1,
        ),
    ),
}


def _codes(counts: tuple[int, ...], symbols: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """Canonical (code, length, symbol)."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, length, symbols[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(maxsize=16)
def _lookup(counts: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """For each 16-bit window: symbol * 32 + code length (0 where no code fits)."""
    out = np.zeros(1 << 16, np.int32)
    for code, length, symbol in _codes(counts, symbols):
        out[code << (16 - length) : (code + 1) << (16 - length)] = symbol * 32 + length
    return out


def _marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


@lru_cache(maxsize=1)
def _frame_head() -> bytes:
    return (
        b"\xff\xd8"
        + _marker(0xDB, b"\0" + bytes([8] + [16] * 63))
        + _marker(0xC0, struct.pack(">BHHBBBB", 8, LINES * 8, COLUMNS * 8, 1, 1, 0x11, 0))
        + _marker(0xC4, b"\x00" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS))
        + _marker(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS))
        + _marker(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


@lru_cache(maxsize=1)
def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference + 255: the bits of its code, magnitude and end-of-block, and how many they are."""
    by_symbol = {s: (c, n) for c, n, s in _codes(DC_COUNTS, DC_SYMBOLS)}
    bits, sizes = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, length = by_symbol[size]
        bits[d + 255] = ((code << size) | (d if d >= 0 else d + (1 << size) - 1)) << 1
        sizes[d + 255] = length + size + 1
    return bits, sizes


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """One JPEG for each row of 192 samples (uint8)."""
    out: list[bytes] = []
    for at in range(0, len(samples), LANES):
        out += _encode_lanes(samples[at : at + LANES])
    return out


def _encode_lanes(samples: np.ndarray) -> list[bytes]:
    n, width = len(samples), (FRAME_BYTES * 14 + 7) // 8 + 3
    level = samples.astype(np.int16) - 128
    step = np.diff(level, axis=1, prepend=np.int16(0)) + 255
    bits, sizes = _difference_codes()
    size, value = sizes[step], bits[step]
    ends = np.cumsum(size, axis=1)
    offset = ends - size
    value <<= 24 - (offset & 7) - size
    place = ((offset >> 3) + (np.arange(n) * width)[:, None]).ravel()
    value = value.ravel()
    stored = np.bincount(place, value >> 16, n * width)
    stored += np.bincount(place + 1, (value >> 8) & 255, n * width)
    stored += np.bincount(place + 2, value & 255, n * width)
    stored = stored.astype(np.uint8).reshape(n, width)
    total = ends[:, -1]
    rest = np.flatnonzero(total & 7)
    stored[rest, total[rest] >> 3] |= ((1 << (8 - (total[rest] & 7))) - 1).astype(np.uint8)
    used = np.arange(width)[None, :] < ((total + 7) >> 3)[:, None]
    flat = stored[used]
    copies = 1 + (flat == 255)
    spread = np.zeros(copies.sum(), np.uint8)
    spread[np.cumsum(copies) - copies] = flat
    stuffed = (used.sum(axis=1) + ((stored == 255) & used).sum(axis=1)).tolist()
    head, data, out, at = _frame_head(), spread.tobytes(), [], 0
    for length in stuffed:
        out.append(head + data[at : at + length] + b"\xff\xd9")
        at += length
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int = COLUMNS * 8, height: int = LINES * 8, fps: int = FPS) -> bytes:
    """A RIFF AVI file with one motion-JPEG stream and an index."""
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        movi.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movi[-1])
    return _chunk(b"RIFF", b"AVI " + header + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, min(at + 8 + size, end)
        at += 8 + size + (size & 1)


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """The frames of the video stream in the order of the index, and the milliseconds that each is shown."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, ms = None, None, 1000.0 / FPS
    for name, start, end in _chunks(data, 12, len(data)):
        kind = data[start : start + 4]
        if name == b"LIST" and kind == b"hdrl":
            for inner, s, _ in _chunks(data, start + 4, end):
                if inner == b"avih":
                    ms = struct.unpack_from("<I", data, s)[0] / 1000
        elif name == b"LIST" and kind == b"movi":
            movi = (start, end)
        elif name == b"idx1":
            index = (start, end)
    if movi is None:
        raise ValueError("the AVI file has no movi list")
    frames = []
    if index:
        table = np.frombuffer(data, "<u4", (index[1] - index[0]) // 16 * 4, index[0]).reshape(-1, 4)
        video = table[(table[:, 0] >> 16) == struct.unpack("<H", b"dc")[0]]
        base = movi[0]
        video = video[video[:, 0] == video[0, 0]] if len(video) else video  # the first stream of pictures
        if len(video) and data[base + int(video[0, 2]) : base + int(video[0, 2]) + 4] != video[0, :1].tobytes():
            base = 0  # offsets from the start of the file are allowed too
        for at, size in video[:, 2:].tolist():
            frames.append(data[base + at + 8 : base + at + 8 + size])
    else:
        found = [(name, s, e) for name, s, e in _chunks(data, movi[0] + 4, movi[1]) if name[2:] == b"dc"]
        frames = [data[s:e] for name, s, e in found if name == found[0][0]]
    return frames, ms


@dataclass(frozen=True)
class Head:
    """What a frame's markers say: geometry, the block plan of one MCU, tables, and where the scan starts."""

    size: int
    width: int
    height: int
    plan: tuple[tuple[int, int, int, int], ...]  # component, DC table, AC table, quantiser
    units: int
    dc: tuple
    ac: tuple
    quant: tuple


def _parse_head(data: bytes) -> Head:
    at, quant, tables, parts, width, height = 2, {}, dict(TYPICAL_TABLES), {}, 0, 0
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("a JPEG marker is missing")
        kind, length = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + length], at + 2 + length
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = tuple(np.frombuffer(body, ">u2" if wide else "u1", 64, 1).tolist())
                body = body[65 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                counts = tuple(body[1:17])
                tables[body[0]] = (counts, tuple(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif kind in (0xC0, 0xC1):
            height, width = struct.unpack_from(">HH", body, 1)
            parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])}
        elif kind == 0xDA:
            break
        elif kind == 0xDD and any(body) or 0xC2 <= kind <= 0xCF:
            raise ValueError("only baseline frames without restart intervals are read")
    scan = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
    across, down = max(p[0] for p in parts.values()), max(p[1] for p in parts.values())
    if len(scan) == 1:
        across = down = 1
    plan = []
    for i, (part, table) in enumerate(scan):
        h, v, q = parts[part]
        plan += [(i, table >> 4, table & 15, q)] * (h * v if len(scan) > 1 else 1)
    units = -(-width // (8 * across)) * -(-height // (8 * down))
    dc, ac = ({k & 15: v for k, v in tables.items() if k >> 4 == c} for c in (0, 1))
    return Head(at, width, height, tuple(plan), units, tuple(sorted(dc.items())), tuple(sorted(ac.items())), tuple(sorted(quant.items())))


_HEADS: dict[bytes, Head] = {}


def _head(frame: bytes) -> Head:
    for known, head in _HEADS.items():
        if frame.startswith(known):
            return head
    head = _parse_head(frame)
    if len(_HEADS) < 64:
        _HEADS[frame[: head.size]] = head
    return head


def decode_frames(frames: list[bytes], keep_ac: bool = False) -> list[np.ndarray]:
    """Quantised terms of each frame: (blocks,) DC terms, or (blocks, 64) in zigzag order with ``keep_ac``."""
    groups: dict[Head, list[int]] = {}
    for i, f in enumerate(frames):
        groups.setdefault(_head(f), []).append(i)
    out: list[np.ndarray] = [None] * len(frames)  # type: ignore[list-item]
    for head, members in groups.items():
        for at in range(0, len(members), LANES):
            some = members[at : at + LANES]
            for i, terms in zip(some, _decode_lanes(head, [frames[i] for i in some], keep_ac), strict=True):
                out[i] = terms
    return out


def _decode_lanes(head: Head, frames: list[bytes], keep_ac: bool) -> np.ndarray:
    ends = [f.rfind(b"\xff\xd9") for f in frames]
    raw = [f[head.size : e if e > 0 else len(f)] for f, e in zip(frames, ends, strict=True)]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw) + b"\0" * 8, np.uint8)
    keep = np.ones(len(data), bool)
    keep[1:] = ~((data[1:] == 0) & (data[:-1] == 255))
    keep[-8:] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    start = kept[np.concatenate(([0], np.cumsum(sizes)[:-1]))] * 8
    data = data[keep].astype(np.int64)
    words = np.zeros(len(data), np.int64)
    words[:-3] = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    limit = len(words) - 1
    dc, ac = ({k: _lookup(*v) for k, v in t} for t in (head.dc, head.ac))
    n, place = len(frames), start.copy()
    terms = np.zeros((n, head.units * len(head.plan), 64) if keep_ac else (n, head.units * len(head.plan)), np.int32)
    predicted = np.zeros((max(p[0] for p in head.plan) + 1, n), np.int64)

    def take(at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and code length at the bit positions."""
        found = table[((words[np.minimum(at >> 3, limit)] << (at & 7)) >> 16) & 0xFFFF]
        return found >> 5, found & 31

    def magnitude(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        value = ((words[np.minimum(at >> 3, limit)] << (at & 7)) & 0xFFFFFFFF) >> (32 - size)
        return np.where(value < (1 << size) >> 1, value - (1 << size) + 1, value)

    block = 0
    for _ in range(head.units):
        for part, dc_id, ac_id, _q in head.plan:
            size, used = take(place, dc[dc_id])
            if not used.all():
                raise ValueError("a frame's scan is damaged")
            place += used
            predicted[part] += magnitude(place, size)
            place += size
            if keep_ac:
                terms[:, block, 0] = predicted[part]
            else:
                terms[:, block] = predicted[part]
            live, k = None, np.ones(n, np.int64)
            while True:
                at = place if live is None else place[live]
                symbol, used = take(at, ac[ac_id])
                if not used.all():
                    raise ValueError("a frame's scan is damaged")
                size = symbol & 15
                if live is None and not symbol.any():
                    place += used
                    break
                value = magnitude(at + used, size)
                who = np.arange(n) if live is None else live
                k[who] += symbol >> 4
                if keep_ac and (put := np.flatnonzero(size)).size:
                    terms[who[put], block, np.minimum(k[who[put]], 63)] = value[put]
                place[who] = at + used + size
                k[who] += 1
                live = who[(symbol != 0) & (k[who] < 64)]
                if not live.size:
                    break
            block += 1
    return terms


def pixels(frame: bytes) -> np.ndarray:
    """Grey pixels of a one-component frame, by dequantising and the inverse transform."""
    head = _head(frame)
    terms = decode_frames([frame], keep_ac=True)[0] * np.array(dict(head.quant)[head.plan[0][3]])
    square = np.zeros_like(terms, dtype=np.float64)
    square[:, ZIGZAG] = terms
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)
    blocks = np.einsum("nuv,ux,vy->nxy", square.reshape(-1, 8, 8), basis, basis)
    across = -(-head.width // 8)
    image = blocks.reshape(-1, across, 8, 8).swapaxes(1, 2).reshape(-1, across * 8)
    return np.clip(np.rint(image + 128), 0, 255).astype(np.uint8)[: head.height, : head.width]


def dc_planes(frames: list[bytes]) -> np.ndarray:
    """Samples (frames, blocks) of frames of one geometry: the mean brightness of each block (of the first component)."""
    if not frames:
        return np.zeros((0, FRAME_BYTES), np.uint8)
    head = _head(frames[0])
    if any(_head(f).plan != head.plan or _head(f).units != head.units for f in frames):
        raise ValueError("the frames differ in size")
    bright = np.tile([part == 0 for part, *_ in head.plan], head.units)
    terms = np.stack([t[bright] for t in decode_frames(frames)])
    steps = np.array([dict(_head(f).quant)[head.plan[0][3]][0] for f in frames])  # frames may differ in quality
    return np.clip(np.rint(terms * (steps[:, None] / 8)) + 128, 0, 255).astype(np.uint8)


def shots(planes: np.ndarray) -> list[tuple[int, int, float]]:
    """Shots as (first frame, frame after the last, how much of the histogram moved at its start)."""
    n = len(planes)
    if n == 0:
        return []
    samples = planes.shape[1]
    place = (planes.astype(np.int64) * BINS >> 8) + (np.arange(n) * BINS)[:, None]
    bars = np.bincount(place.ravel(), minlength=n * BINS).reshape(n, BINS)
    moved = np.abs(np.diff(bars, axis=0)).sum(axis=1) // 2
    m = len(moved)
    low, high = np.maximum(np.arange(m) - REACH, 0), np.minimum(np.arange(m) + REACH + 1, m)
    total, square = (np.concatenate(([0], np.cumsum(v))) for v in (moved, moved * moved))
    count = np.maximum(high - low - 1, 1)
    mean = (total[high] - total[low] - moved) / count
    spread = np.sqrt(np.maximum((square[high] - square[low] - moved * moved) / count - mean * mean, 0))
    cuts = np.flatnonzero((moved > mean + DEVIATIONS * spread) & (moved >= LEAST_MOVE * samples)) + 1
    edges = [0, *cuts.tolist(), n]
    return [(a, b, 0.0 if a == 0 else float(moved[a - 1]) / samples) for a, b in zip(edges, edges[1:], strict=False)]


def payload_of(text: str) -> tuple[bytes, int]:
    """UTF-8 bytes, filled with spaces to a positive multiple of 192, and their number before that."""
    raw = text.encode()
    return raw + b" " * (-len(raw) % FRAME_BYTES or (FRAME_BYTES if not raw else 0)), len(raw)


def store(text: str) -> bytes:
    """The text's AVI file."""
    payload, _ = payload_of(text)
    return write_avi(encode_frames(np.frombuffer(payload, np.uint8).reshape(-1, FRAME_BYTES)))


#: The type of a file's timed clips, for Spark and Arrow.
CLIPS = "array<struct<first_frame:long,end_frame:long,start_ms:double,end_ms:double,moved:double>>"
_CLIPS = pa.list_(pa.struct([("first_frame", pa.int64()), ("end_frame", pa.int64()), ("start_ms", pa.float64()), ("end_ms", pa.float64()), ("moved", pa.float64())]))


def _timed(found: list[tuple[int, int, float]], ms: float) -> list[dict]:
    """Shots with their times, for frames of ``ms`` milliseconds."""
    return [{"first_frame": a, "end_frame": b, "start_ms": a * ms, "end_ms": b * ms, "moved": m} for a, b, m in found]


def _fields(id_type: str, id_col: str) -> str:
    return (
        f"`{id_col}` {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        f"media_sha256 string, feature string, clips {CLIPS}"
    )


def media_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store every text as an AVI file, read the file back and find its shots; no shuffle.

    Returns sizes and digests of payload and file, the shots as ``clips`` and their digest ``feature`` (the first
    frame of each shot). ``keep_media`` adds the file itself.
    """
    schema = _fields(dict(df.dtypes)[id_col], id_col) + ", media binary" * keep_media
    names = [p.strip().split(" ")[0].strip("`") for p in schema.split(", ")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [payload_of(t) for t in texts(batch.column(1))]
        counts = [len(p) // FRAME_BYTES for p, _ in rows]
        coded = encode_frames(np.frombuffer(b"".join(p for p, _ in rows), np.uint8).reshape(-1, FRAME_BYTES))
        files, at = [], 0
        for n in counts:
            files.append(write_avi(coded[at : at + n]))
            at += n
        del coded
        read = [read_avi(f) for f in files]
        planes = dc_planes([f for frames, _ in read for f in frames])
        out: dict[str, list] = {k: [] for k in names[1:]}
        at = 0
        for (_, size), n, file, (_, ms) in zip(rows, counts, files, read, strict=True):
            own = planes[at : at + n]
            at += n
            payload = own.tobytes()
            found = shots(own)
            values = (
                size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(),
                f"{n}:" + ",".join(str(a) for a, _, _ in found),
                _timed(found, ms),
            )
            for k, v in zip(out, (*values, file) if keep_media else values, strict=True):
                out[k].append(v)
        kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "clips": _CLIPS, "media": pa.binary()}
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, kinds.get(k, pa.string())) for k, v in out.items())], names)

    return map_batches(df.select(id_col, text_col), run, schema)


def media_clips(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``id_col, n_frames, clips, error`` of every row whose ``media_col`` holds the bytes of an AVI file.

    A null file has no frames; one that cannot be read has none either, and ``error`` says why.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, clips, errors = [], [], []
        for data in batch.column(1).to_pylist():
            found, n, error = [], 0, None
            try:
                frames, ms = read_avi(data) if data is not None else ([], 0.0)
                found, n = _timed(shots(dc_planes(frames)), ms), len(frames)
            except (ValueError, KeyError, IndexError, struct.error) as e:
                error = f"{type(e).__name__}: {e}"
            counts.append(n)
            clips.append(found)
            errors.append(error)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(clips, _CLIPS), pa.array(errors, pa.string())], [id_col, "n_frames", "clips", "error"])

    return map_batches(df.select(id_col, media_col), run, f"`{id_col}` {dict(df.dtypes)[id_col]}, n_frames long, clips {CLIPS}, error string")


def clip_rows(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One timed row for each shot of ``media_documents`` or ``media_clips``."""
    return media.select(id_col, F.posexplode("clips").alias("clip", "c")).select(id_col, "clip", "c.*")
