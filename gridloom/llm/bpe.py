"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut where a pre-token must end whatever follows, so every call of the library sees a bounded text.
A run that allows no such cut (white space, or one class of character without end) is taken piece by piece.

Defined cases: null text is encoded as the empty text (no ids); repeated rows give repeated results; an empty table
gives an empty result; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_batches, texts

#: Texts up to this many characters go to the library whole; longer ones are cut into parts of about this size.
WHOLE_CHARS = 8192

#: A letter or digit and then a space or line end: no pre-token spans that place, and none looks back over it.
_CUT = regex.compile(r"(?<=[\p{L}\p{N}])(?=[ \n])")


@lru_cache(maxsize=4)
def encoding(rank_path: str, pattern: str):
    """The library's encoding for a rank file (one per process)."""
    import tiktoken

    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def pieces_of(pattern: str):
    """The pre-token pattern, with white space as Unicode defines it (the library's reading of ``\\s``)."""
    return regex.compile(pattern)


def parts(text: str, size: int = WHOLE_CHARS) -> list[str]:
    """``text`` cut at safe places into parts of at least ``size`` characters (all but the last)."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size and (m := _CUT.search(text, start + size)):
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


def encode(text: str, rank_path: str, pattern: str) -> np.ndarray:
    """Token ids of a whole text as little-endian unsigned 32-bit integers."""
    enc = encoding(rank_path, pattern)
    out = []
    for part in parts(text):
        if len(part) <= 2 * WHOLE_CHARS:
            out.append(np.asarray(enc.encode_ordinary(part), "<u4"))
        else:
            for piece in pieces_of(pattern).findall(part):
                out.append(np.asarray(enc.encode_single_piece(piece) if hasattr(enc, "encode_single_piece") else enc._encode_single_piece(piece), "<u4"))
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, "<u4")


def decode(ids: np.ndarray, rank_path: str, pattern: str) -> bytes:
    """The raw bytes that the ids stand for; they need not be whole characters."""
    return encoding(rank_path, pattern).decode_bytes(ids.tolist())


def encode_documents(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids`` (binary, 4 bytes a token) for every row; no shuffle."""
    id_type = dict(df.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [encode(t, rank_path, pattern).tobytes() for t in texts(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], [id_col, "ids"])

    return map_batches(df.select(id_col, text_col), run, f"`{id_col}` {id_type}, ids binary")


def round_trip(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode every text, decode the ids again and return counts and digests of both.

    ``keep_ids`` adds the ids themselves. The digests are taken where the ids are, so ids need not leave the worker.
    """
    id_type = dict(df.dtypes)[id_col]
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, ids_sha, text_sha, raw = [], [], [], []
        for t in texts(batch.column(1)):
            ids = encode(t, rank_path, pattern)
            stored = ids.tobytes()
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(stored).hexdigest())
            text_sha.append(hashlib.sha256(decode(ids, rank_path, pattern)).hexdigest())
            if keep_ids:
                raw.append(stored)
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
        return pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * keep_ids, names)

    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return map_batches(df.select(id_col, text_col), run, schema)
