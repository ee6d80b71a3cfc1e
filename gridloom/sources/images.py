"""Image files as bytes: PNG and baseline TIFF, written and read without an imaging library; files of a table."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..errors import UnknownMethodError

#: Samples of a pixel by PNG's colour type.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def png(image: np.ndarray) -> bytes:
    """A PNG file of H x W grey, or H x W x 3 or 4 colour bytes."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    h, w = image.shape[:2]
    kind = {1: 0, 3: 2, 4: 6}[1 if image.ndim == 2 else image.shape[2]]
    rows = b"".join(b"\0" + line.tobytes() for line in image)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """The samples of a PNG file of eight bits a sample (palettes become colours): H x W, or H x W x samples."""
    at, body, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
    if head is None or head[2] != 8 or head[6]:
        raise UnknownMethodError("only PNG files of eight bits without interlacing are read")
    w, h, _, colour, *_ = head
    n = _SAMPLES[colour]
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * n)
    out, above = np.zeros((h, w * n), np.uint8), np.zeros(w * n, np.uint8)
    for k in range(h):
        out[k] = above = _unfiltered(int(lines[k, 0]), lines[k, 1:], above, n)
    image = out.reshape(h, w, n)
    if colour == 3:
        return palette[image[..., 0]]
    return image[..., 0] if n == 1 else image


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    """A line before PNG's filter ``kind``, from the line above; ``n`` samples a pixel."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, n), axis=0, dtype=np.uint8).ravel()
    if kind == 2:
        return line + above
    raw, up, out = line.tolist(), above.tolist(), []
    for i, v in enumerate(raw):
        a, b, c = (out[i - n], up[i], up[i - n]) if i >= n else (0, up[i], 0)
        if kind == 3:
            guess = (a + b) // 2
        else:  # the neighbour nearest to a + b - c
            guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
        out.append((v + guess) & 255)
    return np.array(out, np.uint8)


def tiff(image: np.ndarray) -> bytes:
    """A TIFF file of H x W grey or H x W x samples bytes, in one strip without compression."""
    h, w = image.shape[:2]
    n = 1 if image.ndim == 2 else image.shape[2]
    body = np.ascontiguousarray(image, np.uint8).tobytes()
    first = 8 + len(body) + len(body) % 2
    depths = first + 2 + 10 * 12 + 4  # where the bits of each sample stand, if they are more than two
    short = lambda tag, *v: struct.pack("<HHI4s", tag, 3, len(v), struct.pack(f"<{len(v)}H", *v).ljust(4, b"\0"))
    whole = lambda tag, v: struct.pack("<HHII", tag, 4, 1, v)
    bits = short(258, *[8] * n) if n <= 2 else struct.pack("<HHII", 258, 3, n, depths)
    entries = [whole(256, w), whole(257, h), bits, short(259, 1), short(262, 2 if n >= 3 else 1), whole(273, 8), short(277, n), whole(278, h), whole(279, len(body)), short(284, 1)]
    return b"II*\0" + struct.pack("<I", first) + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(entries)) + b"".join(entries) + b"\0" * 4 + struct.pack(f"<{n}H", *[8] * n)


def read_tiff(data: bytes) -> np.ndarray:
    """The samples of the first image of a TIFF file of eight bits a sample in strips without compression."""
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(f"{order}I", data, 4)[0]
    fields: dict[int, tuple] = {}
    for k in range(struct.unpack_from(f"{order}H", data, at)[0]):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
        if kind in (3, 4):
            letter, size = ("H", 2) if kind == 3 else ("I", 4)
            place = at + 10 + 12 * k
            if size * count > 4:
                place = struct.unpack_from(f"{order}I", data, place)[0]
            fields[tag] = struct.unpack_from(f"{order}{count}{letter}", data, place)
    if set(fields.get(258, (1,))) != {8} or fields.get(259, (1,)) != (1,) or 273 not in fields:
        raise UnknownMethodError("only TIFF files of eight bits in strips without compression are read")
    body = b"".join(data[a : a + n] for a, n in zip(fields[273], fields[279], strict=True))
    n = fields.get(277, (1,))[0]
    shape = (fields[257][0], fields[256][0])
    return np.frombuffer(body, np.uint8).reshape(*shape, n) if n > 1 else np.frombuffer(body, np.uint8).reshape(shape)


def decode(data: bytes) -> np.ndarray:
    """An image by the first bytes of its file."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return read_png(data)
    if data[:4] in (b"II*\0", b"MM\0*"):
        return read_tiff(data)
    raise UnknownMethodError("neither a PNG nor a TIFF file; give a decoder of your own")


def contents(files: DataFrame) -> DataFrame:
    """``path, content`` of a table of paths that all workers reach, read in the workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                with open(path, "rb") as f:
                    yield pd.DataFrame({"path": [path], "content": [f.read()]})

    return files.select("path").mapInPandas(run, "path string, content binary")
