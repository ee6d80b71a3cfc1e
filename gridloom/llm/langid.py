"""Language identification by hierarchical discrimination.

A linear support vector machine for each language family (one against the rest) picks the family of a text; one
machine for each pair of languages of that family (one against one) then picks the language by votes, ties by the sum
of margins. Features are byte n-grams (1 to 3) of the whole lower-cased text, hashed, as square roots of their shares.

The models are fitted on a bounded, hash-ordered sample of labelled rows (``MAX_ROWS`` in all, at most
``ROWS_PER_LANGUAGE`` a language, and ``LEAST_ROWS`` of each language in any case); every language that has a labelled row
is learned and every row of the input is predicted. Labels are never inputs of a prediction.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text where no labelled
row exists; equal votes and margins give the first language by name; one learned language is predicted for all others; repeated rows give repeated results; an empty table gives
an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, texts

#: Size of the hashed feature space and bounds of the training sample: rows a language at most, rows in all, and rows a
#: language at least where there are so many languages that these are more.
DIMENSIONS, ROWS_PER_LANGUAGE, MAX_ROWS, LEAST_ROWS = 4096, 300, 4000, 10
#: Characters of a long text that are lower-cased, and bytes that are counted, at a time.
PIECE = 1 << 18

#: Families of ISO 639-1 codes (fixed values); a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa si ur",
    "semitic": "am ar he mt",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTER = regex.compile(r"\p{L}")


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


def _letters() -> np.ndarray:
    """Byte map: letters stay, every other ASCII byte becomes a space."""
    out = np.arange(256, dtype=np.uint8)
    out[:128] = [b if chr(b).isalpha() else 32 for b in range(128)]
    return out


_CLEAN = _letters()


def _count(out: np.ndarray, parts: list[bytes], rows: list[int]) -> None:
    """Add the n-grams that begin in ``parts`` (in all but their last two bytes) to the counts of their rows."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    data = _CLEAN[np.frombuffer(b"".join(parts), np.uint8)].astype(np.uint32)
    part = np.repeat(np.arange(len(parts), dtype=np.int64), sizes)
    one, two, three = data[:-2], data[1:-1], data[2:]
    inside = (part[:-2] == part[2:]) & ~((one == 32) & (two == 32))
    grams = (one, one | (two << 8) | (1 << 24), one | (two << 8) | (three << 16) | (2 << 24))
    where = part[:-2][inside] * DIMENSIONS
    shift = np.uint32(32 - int(DIMENSIONS).bit_length() + 1)
    for gram in grams:
        mixed = gram[inside].astype(np.uint32) * np.uint32(2654435761)
        mixed ^= mixed >> np.uint32(15)
        found = np.bincount(where + ((mixed * np.uint32(2246822519)) >> shift), minlength=len(parts) * DIMENSIONS)
        out[rows] += found.reshape(len(parts), DIMENSIONS)


def features(rows: list[str]) -> np.ndarray:
    """One unit vector for each text (zero for a text without n-grams). Long texts are counted piece by piece."""
    out = np.zeros((len(rows), DIMENSIONS), np.float32)
    parts, of, held = [], [], 0
    for i, text in enumerate(rows):
        tail = b" "
        for at in range(0, max(1, len(text)), PIECE):
            own = tail + text[at : at + PIECE].lower().encode()
            tail = own[-2:]
            if at + PIECE >= len(text):
                own += b" "
            if held + len(own) > 4 * PIECE or of and of[-1] == i:  # a row stands once in a round
                _count(out, parts, of) if parts else None
                parts, of, held = [], [], 0
            parts.append(own)
            of.append(i)
            held += len(own)
    if parts:
        _count(out, parts, of)
    out = np.sqrt(out)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 60) -> np.ndarray:
    """Weights (bias last) of an L2-regularised squared-hinge machine, by dual coordinate descent in a fixed order."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    share = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum()))
    slack = 1 / (2 * cost * share)
    diagonal = (x * x).sum(axis=1) + slack
    w, dual = np.zeros(x.shape[1], np.float32), np.zeros(len(x))
    order = np.random.default_rng(7).permutation(len(x))
    for _ in range(rounds):
        moved = 0.0
        for i in order:
            step = max(0.0, dual[i] - (y[i] * float(x[i] @ w) - 1 + slack[i] * dual[i]) / diagonal[i]) - dual[i]
            if step:
                dual[i] += step
                w += np.float32(step * y[i]) * x[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


@dataclass(frozen=True)
class Model:
    """Languages, their families, and the machines as rows of two weight tables."""

    languages: tuple[str, ...]
    families: tuple[str, ...]
    family_weights: np.ndarray
    pairs: tuple[tuple[int, int], ...]
    pair_weights: np.ndarray

    def predict(self, rows: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) of each text."""
        spoken = np.fromiter((bool(_LETTER.search(t)) for t in rows), bool, len(rows))
        names, scores = ["und"] * len(rows), np.zeros(len(rows))
        if not self.languages or not spoken.any():
            return names, scores
        x = features(rows)
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        of_family = np.array([self.families.index(family(v)) for v in self.languages])
        margins = x @ self.family_weights.T
        chosen = margins.argmax(axis=1)
        duels = x @ self.pair_weights.T if self.pairs else np.zeros((len(rows), 0))
        votes, sums = np.zeros((len(rows), len(self.languages))), np.zeros((len(rows), len(self.languages)))
        worst = np.full((len(rows), len(self.languages)), np.inf)
        for (a, b), m in zip(self.pairs, duels.T, strict=True):
            for lang, own in ((a, m), (b, -m)):
                votes[:, lang] += own > 0
                sums[:, lang] += own
                worst[:, lang] = np.minimum(worst[:, lang], own)
        outside = of_family[None, :] != chosen[:, None]
        rank = np.where(outside, -np.inf, votes + 0.5 * np.tanh(sums))
        best = rank.argmax(axis=1)
        every = np.arange(len(rows))
        sure = _share(margins[every, chosen] if len(self.families) > 1 else np.full(len(rows), np.inf)) * _share(worst[every, best])
        for i in np.flatnonzero(spoken):
            names[i], scores[i] = self.languages[best[i]], sure[i]
        return names, scores


def _share(margin: np.ndarray) -> np.ndarray:
    """A margin as a number from 0 to 1; 0.5 on the plane, 0.95 a unit away."""
    return 1 / (1 + np.exp(-np.clip(3 * margin, -50, 50)))


def train(langs: list[str], x: np.ndarray) -> Model:
    """Fit all machines on the feature rows ``x``."""
    names = tuple(sorted(set(langs)))
    code = np.array([names.index(v) for v in langs], dtype=np.int64)
    families = tuple(sorted({family(v) for v in names}))
    of_family = np.array([families.index(family(v)) for v in names], dtype=np.int64)
    width = DIMENSIONS + 1
    if len(families) > 1:
        top = np.stack([svm(x, np.where(of_family[code] == f, 1.0, -1.0)) for f in range(len(families))])
    else:
        top = np.zeros((len(families), width), np.float32)
    pairs = tuple((a, b) for a in range(len(names)) for b in range(a + 1, len(names)) if of_family[a] == of_family[b])
    duels = [svm(x[own], np.where(code[own] == a, 1.0, -1.0)) for a, b in pairs for own in [np.flatnonzero((code == a) | (code == b))]]
    return Model(names, families, top, pairs, np.stack(duels) if duels else np.zeros((0, width), np.float32))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the rows of ``labelled`` that have a language; the sample is bounded whatever their number."""
    labelled = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return Model((), (), np.zeros((0, DIMENSIONS + 1), np.float32), (), np.zeros((0, DIMENSIONS + 1), np.float32))
    most = max(LEAST_ROWS, min(ROWS_PER_LANGUAGE, MAX_ROWS // len(counts)))
    # An id's hash decides; of each language about twice the rows that are wanted pass, and the first of them stay.
    hashed = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    bound = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, int(min(1.0, (2 * most + 50) / n) * (1 << 30)))])
    some = labelled.where(hashed < bound[F.col("lang")]).withColumn("h", hashed)
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", "text"))).where(F.col("k") <= most)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = features(texts(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in rows], pa.binary())], ["id", "lang", "x"])

    id_type = dict(some.dtypes)["id"]
    sample = map_batches(some.select("id", "text", "lang"), run, f"id {id_type}, lang string, x binary").toArrow().to_pylist()
    sample.sort(key=lambda r: (r["lang"], str(r["id"]), r["x"]))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in sample])
    spoken = np.flatnonzero(np.abs(x).sum(axis=1) > 0)
    return train([sample[i]["lang"] for i in spoken], x[spoken])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, lang_pred, score`` for every row; no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS numbers for each language and each pair of one family
    id_type = dict(df.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = shared.value.predict(texts(batch.column(2)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [id_col, "held_out", "lang_pred", "score"])

    return map_batches(df.select(id_col, held_out(id_col).alias("held_out"), text_col), run, f"`{id_col}` {id_type}, held_out boolean, lang_pred string, score double")


def keep_identified(df: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns unchanged, whose language is identified with a score of ``least`` or more."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.schema.names.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = shared.value.predict(texts(batch.column(at)))
        return batch.filter(pa.array((np.array(names) != "und") & (scores >= least)))

    return map_batches(df, run, df.schema)
