"""Quality classifier: hashed word n-gram logistic regression.

A text's features are its words and word pairs, and the words and pairs of its
shapes (letters as x or X, digits as 9, repeats of the last word as =), each
hashed to a weight. Fitting follows the regularised leader one text at a time;
a score is one sparse dot product.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DIMENSIONS = 1 << 18
#: Labelled texts a model is fitted on, on average: a bounded sample, drawn by the text's hash.
TRAIN_ROWS = 6_000
PASSES = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
#: Weight of each family of features: words, word pairs, shapes, shape pairs.
SCALES = (2.0, 2.0, 6.0, 6.0)
PAIR = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text whose features are formed at a time; pairs and repeats go on across parts.
CHUNK = 1 << 20

_SHAPE = bytes(
    ord("x") if 97 <= i <= 122 or i >= 128 else ord("X") if 65 <= i <= 90 else ord("9") if 48 <= i <= 57 else i for i in range(256)
)
_RUNS = re.compile(rb"x+|X+|9+")


def _hashes(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    hashed = xxhash.xxh64_intdigest
    for w in set(words):
        seen[w] = hashed(w)
    return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def _families(text: bytes, last: tuple | None) -> tuple[list[np.ndarray], tuple | None]:
    """Indices by family of a part of a text, and its last word and shape, with which the next part goes on."""
    words = text.split()
    if not words:
        return [np.zeros(0, np.int64)] * 4, last
    own = _hashes([w.lower() for w in words])
    shapes = _RUNS.sub(lambda m: m.group()[:1], text.translate(_SHAPE)).split()
    shape = _hashes(shapes)
    before = np.append(np.array(last[:1], np.uint64) if last else ~own[:1], own[:-1])
    shape = np.where(own == before, np.uint64(0x3D3D3D3D), shape)
    found = []
    for i, x in enumerate((own, shape)):
        salt, run = np.uint64(0x51ED27 * (2 * i + 1)), np.append(np.array(last[i : i + 1], np.uint64), x) if last else x
        found += [(x ^ salt) * PAIR, ((run[:-1] * PAIR + run[1:]) ^ (salt << np.uint64(8))) * PAIR]
    return [(x >> np.uint64(46)).astype(np.int64) for x in found], (own[-1], shape[-1])


def features(text: bytes | None) -> list[tuple[np.ndarray, float]]:
    """(indices with repeats, value of each) by family; values of a family sum to its scale. Covers the whole text."""
    text = text or b""
    parts, start, last = [], 0, None
    while start < len(text):
        end = start + CHUNK
        if end < len(text):  # a part ends at white space
            space = re.compile(rb"\s").search(text, end)
            end = space.start() if space else len(text)
        found, last = _families(text[start:end], last)
        parts.append(found)
        start = end
    found = []
    for scale, family in zip(SCALES, zip(*parts)):
        index = np.concatenate(family)
        if len(index):
            found.append((index, scale / len(index)))
    return found


class Model:
    """Weights of a logistic regression; the last one is the bias."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def score(self, text: bytes | None) -> float:
        z = float(self.weights[-1]) + sum(v * float(self.weights[i].sum(dtype=np.float64)) for i, v in features(text))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def fit(texts: list[bytes], labels: list[int], passes: int = PASSES) -> Model:
    """Follow-the-regularised-leader with per-weight rates, over the texts in the given order."""
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    made = []
    for text in texts:
        index, value = [np.array([DIMENSIONS])], [np.ones(1)]
        for i, v in features(text):
            at, count = np.unique(i, return_counts=True)
            index.append(at)
            value.append(count * v)
        merged, at = np.unique(np.concatenate(index), return_inverse=True)
        made.append((merged.astype(np.int32), np.bincount(at, np.concatenate(value)).astype(np.float32)))

    def weights(zi, ni):
        return np.where(np.abs(zi) <= L1, 0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(passes):
        for (index, value), y in zip(made, labels):
            zi, ni = z[index], n[index]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -30, 30)))
            g = (p - y) * value
            z[index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[index] = ni + g * g
    return Model(weights(z, n).astype(np.float32))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = TRAIN_ROWS
) -> Model | None:
    """Model of ``label_col`` (0 or 1) from labelled texts; None if there are none.

    The sample is bounded by ``max_rows`` on average, drawn by the id's hash, so
    the ids that meet the documents are few enough to broadcast; whole texts are
    used. Rows whose label, id or text is null teach nothing.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col), F.col(label_col).cast("int").alias("y"))
    total = known.count()
    rate = int(min(1.0, max_rows / max(total, 1)) * 1_000_000)
    drawn = known.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("quality")), F.lit(1_000_000)) < rate)
    texts = docs.select(id_col, F.col(text_col).cast("string").cast("binary").alias("text")).filter("text is not null")
    sample = texts.join(F.broadcast(drawn), id_col).select("text", "y")

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(at=[xxhash.xxh64_intdigest(t) for t in pdf["text"]]).sort_values(["at", "y"])
        model = fit([bytes(t) for t in pdf["text"]], pdf["y"].tolist())
        at = np.flatnonzero(model.weights).astype(np.int32)
        return pd.DataFrame({"at": [at.tobytes()], "w": [model.weights[at].tobytes()]})

    found = sample.groupBy().applyInPandas(fitted, "at binary, w binary").collect()
    if not found:
        return None
    weights = np.zeros(DIMENSIONS + 1, np.float32)
    weights[np.frombuffer(found[0]["at"], np.int32)] = np.frombuffer(found[0]["w"], np.float32)
    return Model(weights)


def score(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score double`` in 0 to 1 and ``predicted int`` (1 if the score reaches the threshold).

    A null text scores like an empty one; without a model every score is 0.5.
    Repeated rows score alike; an empty table gives an empty result. Input
    columns named like an output are replaced by it.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for batch in batches:
            model = shared.value
            found = [model.score(t.as_py()) if model else 0.5 for t in batch.column(at).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.float64()), pa.array([int(x >= threshold) for x in found], pa.int32())],
                names=[*batch.schema.names, "score", "predicted"],
            )

    return docs.mapInArrow(scored, StructType([*docs.schema.fields, *StructType.fromDDL("score double, predicted int").fields]))
