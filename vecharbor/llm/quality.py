"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are the three-character shapes it is made of (lower case, upper case, digit,
space, line end, kinds of punctuation, beyond ASCII) and how its words repeat. Square roots of
term rates, weighted by inverse document frequency, are projected on the leading singular
vectors of a bounded sample of labelled documents. The sample's unit vectors and labels are
broadcast (``MAX_TRAIN`` rows of ``RANK`` numbers at most); every document's cosines with all
of them are one exact matrix product a block; the labels of the ``NEIGHBOURS`` nearest vote,
each with its cosine as weight.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, crc_remainder, keep_rows, labelled_texts, map_texts

#: The bound of the labelled sample (rows), taken by hash of doc_id.
MAX_TRAIN = 4000
RANK = 32
NEIGHBOURS = 15
THRESHOLD = 0.7
#: Decimal places of a cosine.
PLACES = 5
#: Documents whose cosines are computed at once.
BLOCK = 256

_SHAPES = 13


def _shape_table() -> np.ndarray:
    kinds = {"\n\r": 4, " \t\v\f": 3, ".,": 5, ";:": 6, "!?": 7, "#$%&*@^~": 8, "|": 9, "()[]{}<>": 10, "'\"-/\\_=+`": 11}
    table = np.full(256, 12, np.int16)
    table[128:] = 0
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    for chars, kind in kinds.items():
        for c in chars:
            table[ord(c)] = kind
    return table


_TABLE = _shape_table()
#: Shapes, then: adjacent equal words, words seen before, words before first repeats.
TERMS = _SHAPES**3 + 3


def terms(text: bytes) -> np.ndarray:
    """Rate of each term in one text; all zero for an empty text."""
    out = np.zeros(TERMS, np.float32)
    kind = _TABLE[np.frombuffer(text, np.uint8)]
    if len(kind) > 2:
        code = (kind[:-2] * _SHAPES + kind[1:-1]) * _SHAPES + kind[2:]
        out[: _SHAPES**3] = np.bincount(code, minlength=_SHAPES**3) / len(code)
    words = text.split()
    if words:
        n = len(words)
        fresh = len(set(words)) / n
        out[-3:] = sum(map(eq, words, words[1:])) / n, 1 - fresh, fresh
    return np.sqrt(out)


@dataclass
class Model:
    columns: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, rows: np.ndarray) -> np.ndarray:
        out = rows[:, self.columns] @ self.project
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Share of label 1 among the weighted votes; the sample's share where no vote counts."""
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(texts), BLOCK):
            rows = np.array([terms(t) for t in texts[at : at + BLOCK]])
            cosine = np.round(self.latent(rows) @ self.vectors.T, PLACES)
            last = np.partition(cosine, -k, axis=1)[:, -k][:, None]
            above, level = cosine > last, cosine == last
            # Those level with the last neighbour share the places that are left.
            left = (k - above.sum(axis=1)) / level.sum(axis=1)
            weight = np.maximum(cosine, 0) * (above + level * left[:, None])
            total = weight.sum(axis=1)
            voted = weight @ self.labels
            out[at : at + len(rows)] = np.where(total > 0, voted / np.where(total > 0, total, 1), self.prior)
        return np.clip(out, 0, 1)


def labelled(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, most: int) -> DataFrame:
    """(text, label) of at most ``most`` labelled rows outside the held-out fold, by hash of doc_id.

    Rows without a label or doc_id do not count; where labels of a doc_id differ, the mean
    decides; a doc_id with several texts gives each of them as far as the bound has room, one
    text of every doc_id first.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_remainder("doc_id", mod) != held))
        .groupBy("doc_id")
        .agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    )
    return labelled_texts(docs, known, ("true", most))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 4, held: int = 2, most: int = MAX_TRAIN, unknown: float = 1.0) -> Model:
    """Fit on a bounded labelled sample; terms are counted on executors, only their vectors come back.

    Without any labelled row every score is ``unknown``.
    """

    def make():
        def kernel(batch: pa.RecordBatch) -> dict:
            rows = [terms(t) for t in as_bytes(batch.column("text"))]
            at = [np.flatnonzero(r) for r in rows]
            return {"label": batch.column("label"), "at": [a.tolist() for a in at], "rate": [r[a].tolist() for r, a in zip(rows, at, strict=True)]}

        return kernel

    got = map_texts(labelled(docs, labels, label, mod, held, most), make, "label int, at array<int>, rate array<float>").collect()
    got.sort(key=lambda r: (r.label, r["at"], r.rate))
    if not got:
        return Model(np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0), unknown)
    rows = np.zeros((len(got), TERMS), np.float32)
    for i, r in enumerate(got):
        rows[i, r["at"]] = r.rate
    y = np.array([r.label for r in got], float)
    seen = (rows > 0).sum(axis=0)
    columns = np.flatnonzero(seen >= min(3, len(got)))
    weight = np.log((1 + len(got)) / (1 + seen[columns])) + 1
    m = rows[:, columns].astype(float) * weight
    _, v = np.linalg.eigh(m.T @ m)
    project = (weight[:, None] * v[:, ::-1][:, :RANK]).astype(np.float32)
    model = Model(columns, project, np.zeros((0, 0), np.float32), y, float(y.mean()))
    model.vectors = model.latent(rows)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row; null and empty texts get the sample's share of label 1.

    Equal texts score alike, repeated rows give repeated rows (also without a doc_id), an empty
    table none. Texts are read whole; columns other than doc_id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def kernel(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column("doc_id"), "score": own.scores(as_bytes(batch.column("text")))}

        return kernel

    return map_texts(docs.select("doc_id", "text"), make, "doc_id bigint, score double")


def good_rows(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows whose score reaches the threshold, with all their columns, whatever these are called.

    Rows are judged as ``scored`` judges them: null and empty texts by the sample's share of label
    1, repeated rows each; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        return lambda batch: (own.scores(as_bytes(batch.column("text"))) >= threshold).tolist()

    return keep_rows(docs, make)
