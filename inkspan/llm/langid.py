"""Language identification by character language models.

Each language has an interpolated Kneser-Ney model over characters. The models
of all languages share sorted hash arrays: one entry of an order holds that
n-gram's probability in every language. A text goes to the language of the
lowest cross-entropy per character, and is rejected where that entropy exceeds
what the language's own held-back texts show.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ORDER = 4
#: Characters of distinct training texts a language has on average at most, besides its first text. A bounded sample.
TRAIN_CHARS = 3_000_000
#: A text counts for this many characters at most where the score is formed.
SCORE_CHARS = 64
#: Of held-back training texts, this share is accepted; the limit is then widened by the factor.
ACCEPTED, WIDER = 0.999, 1.5
UNKNOWN = "und"
SPACE, BLOCK = 32, 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> lower-cased letter in 16 bits, or space. Letters beyond 16 bits share one symbol."""
    table = np.full(0x110000, SPACE, np.uint16)
    for i in range(0x110000):
        if not 0xD800 <= i < 0xE000 and (c := chr(i)).isalpha():
            low = ord(c.lower()[0])
            table[i] = low if low < 0xFFFF else 0xFFFF
    return table


def symbols(text: str | None) -> np.ndarray:
    """Letters of a text, each run of other characters as one space, a space at either end; empty if there is no letter."""
    codes = _letters()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    kept = codes != SPACE
    if not kept.any():
        return np.zeros(0, np.uint16)
    codes = np.concatenate(([SPACE], codes, [SPACE])).astype(np.uint16)
    kept = np.concatenate(([False], codes[1:] != SPACE))
    kept[0] = True
    kept[1:] |= codes[:-1] != SPACE
    return codes[kept]


def grams(codes: np.ndarray) -> np.ndarray:
    """Each symbol after the first with its ORDER - 1 predecessors, 16 bits each; the start is padded with spaces."""
    padded = np.concatenate((np.full(ORDER - 2, SPACE, np.uint16), codes)).astype(np.uint64)
    n = len(padded) - ORDER + 1
    found = np.zeros(max(n, 0), np.uint64)
    for i in range(ORDER):
        found = (found << np.uint64(16)) | padded[i : i + n]
    return found


class Table:
    """Sorted hash array with a directory over the hashes' top bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashed = keys * MIX
        order = np.argsort(hashed)
        self.hashes, self.values = np.append(hashed[order], np.uint64(2**64 - 1)), np.vstack((values[order], np.zeros((1, values.shape[1]), values.dtype)))
        bits = max(1, int(len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.hashes[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each key, and whether it is there."""
        hashed = keys * MIX
        at = self.starts[hashed >> self.shift]
        behind = np.flatnonzero(self.hashes[at] < hashed)
        while len(behind):
            at[behind] += 1
            behind = behind[self.hashes[at[behind]] < hashed[behind]]
        return at, (self.hashes[at] == hashed) & (at < len(self.hashes) - 1)


class Models:
    """Joint Kneser-Ney tables of all languages, built from counts of ORDER-grams."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.limits = {x: np.inf for x in self.langs}
        levels = {x: self._levels(*counts[x]) for x in self.langs}
        self.probs: dict[int, Table] = {}
        self.backoffs: dict[int, Table] = {}
        lower = np.full((1, len(self.langs)), 1 / 65536)
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([levels[x][n][0] for x in self.langs]))
            heads = np.unique(keys >> np.uint64(16))
            own, weight = np.zeros((len(keys), len(self.langs))), np.ones((len(heads), len(self.langs)))
            for i, x in enumerate(self.langs):
                found, count = levels[x][n]
                ones, twos = (count == 1).sum(), (count == 2).sum()
                cut = ones / (ones + 2 * twos) if ones and twos else 0.5
                context, at = np.unique(found >> np.uint64(16), return_inverse=True)
                total, kinds = np.bincount(at, count), np.bincount(at)
                own[np.searchsorted(keys, found), i] = (count - cut) / total[at]
                weight[np.searchsorted(heads, context), i] = cut * kinds / total
            if n > 1:
                suffix = keys & np.uint64((1 << 16 * (n - 1)) - 1)
                at, _ = self.probs[n - 1].find(suffix)
                lower = np.exp(self.probs[n - 1].values[at])
            p = own + weight[np.searchsorted(heads, keys >> np.uint64(16))] * lower
            self.probs[n] = Table(keys, np.log(p).astype(np.float32))
            self.backoffs[n] = Table(heads, np.log(weight).astype(np.float32))

    @staticmethod
    def _levels(keys: np.ndarray, counts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Counts of the highest order, and continuation counts of the lower ones."""
        found = {ORDER: (keys, counts.astype(np.float64))}
        for n in range(ORDER - 1, 0, -1):
            keys, counts = np.unique(keys & np.uint64((1 << 16 * n) - 1), return_counts=True)
            found[n] = (keys, counts.astype(np.float64))
        return found

    def _log_probs(self, keys: np.ndarray, n: int) -> np.ndarray:
        at, there = self.probs[n].find(keys)
        found = self.probs[n].values[at]
        missing = np.flatnonzero(~there)
        if len(missing):
            at, there = self.backoffs[n].find(keys[missing] >> np.uint64(16))
            found[missing] = np.where(there[:, None], self.backoffs[n].values[at], np.float32(0))
            if n > 1:
                found[missing] += self._log_probs(keys[missing] & np.uint64((1 << 16 * (n - 1)) - 1), n - 1)
            else:
                found[missing] -= np.float32(np.log(65536))
        return found

    def entropies(self, text: str | None) -> tuple[np.ndarray | None, int]:
        """Cross-entropy per character (nats) of the whole text in each language, and its characters; None if it has no letter."""
        codes = symbols(text)
        if not len(codes):
            return None, 0
        keys = grams(codes)
        total = np.zeros(len(self.langs))
        for at in range(0, len(keys), BLOCK):
            total -= self._log_probs(keys[at : at + BLOCK], ORDER).sum(0, dtype=np.float64)
        return total / len(keys), len(keys)

    def predict(self, text: str | None) -> tuple[str, float, float | None, bool]:
        """``(language, score, entropy, accepted)``."""
        entropy, n = self.entropies(text)
        if entropy is None:
            return UNKNOWN, 0.0, None, False
        best = int(np.argmin(entropy))
        score = 1 / np.exp((entropy[best] - entropy) * min(n, SCORE_CHARS)).sum()
        lang = self.langs[best]
        return lang, float(score), float(entropy[best]), bool(entropy[best] <= self.limits[lang])


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """ORDER-gram counts of one language's sample, as bytes."""
    found, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    waiting, size = [], 0
    for text in [*pdf["text"], None]:
        if text is not None:
            waiting.append(grams(symbols(text)))
            size += len(waiting[-1])
        if waiting and (text is None or size > BLOCK):
            keys, counts = np.unique(np.concatenate(waiting), return_counts=True)
            merged, at = np.unique(np.concatenate((found, keys)), return_inverse=True)
            sums = np.bincount(at, np.concatenate((sums, counts)), len(merged)).astype(np.int64)
            found, waiting, size = merged, [], 0
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "grams": [found.tobytes()], "counts": [sums.tobytes()]})


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", max_chars: int = TRAIN_CHARS) -> Models | None:
    """Models from rows with a language; null languages and texts without a letter teach nothing.

    The sample is bounded: a language's distinct texts are drawn whole, by their
    hash, at the rate that gives ``max_chars`` on average, however many copies
    they have. Its text of the lowest hash is always drawn and never held back,
    so every language has a model; the sample is over ``max_chars`` by that text
    at most on average. Of the others every tenth is held back to set the
    language's rejection limit; without one nothing is rejected. None if there
    is no usable row.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter(r"lang is not null and text rlike '\\p{L}'").withColumn("hash", F.xxhash64("text", F.lit("langid")))
    rows = rows.withColumn("draw", F.pmod("hash", F.lit(1_000_000)))
    texts = rows.groupBy("lang", "hash", "draw").agg(F.first(F.length("text")).alias("chars"))
    sizes = texts.groupBy("lang").agg(F.sum("chars"), F.min(F.struct("draw", "hash"))["hash"]).collect()
    if not sizes:
        return None
    rate, lowest = F.lit(0), F.lit(None)
    for lang, n, least in sizes:
        rate = F.when(F.col("lang") == lang, int(min(1.0, max_chars / n) * 1_000_000)).otherwise(rate)
        lowest = F.when(F.col("lang") == lang, least).otherwise(lowest)
    drawn = rows.withColumn("first", F.col("hash") == lowest).filter((F.col("draw") < rate) | F.col("first")).select("lang", "text", "first").distinct()
    held = (F.pmod(F.xxhash64("text", F.lit("held")), F.lit(10)) == 0) & ~F.col("first")
    counts = drawn.filter(~held).groupBy("lang").applyInPandas(_count, "lang string, grams binary, counts binary").collect()
    fitted = {r["lang"]: (np.frombuffer(r["grams"], np.uint64), np.frombuffer(r["counts"], np.int64)) for r in counts}
    models = Models(fitted)
    scored = predict(drawn.filter(held), models, "text").groupBy("lang_pred")
    for lang, limit in scored.agg(F.percentile_approx("entropy", ACCEPTED, 10_000)).collect():
        if limit is not None:
            models.limits[lang] = limit * WIDER
    return models


def predict(docs: DataFrame, models: Models | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred string``, ``score double``, ``entropy double`` and ``accepted boolean``.

    A null text, or one without a letter, is ``und`` with score 0, not accepted;
    without models every text is. Repeated rows are scored alike; an empty table
    gives an empty result. Input columns named like an output are replaced by it.
    """
    outputs = ["lang_pred", "score", "entropy", "accepted"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in outputs])
    shared = docs.sparkSession.sparkContext.broadcast(models)
    at = docs.columns.index(text_col)
    kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]

    def scored(batches):
        for batch in batches:
            models = shared.value
            found = [models.predict(t.as_py()) if models else (UNKNOWN, 0.0, None, False) for t in batch.column(at)]
            columns = list(zip(*found)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=[*batch.schema.names, *outputs])

    added = StructType.fromDDL("lang_pred string, score double, entropy double, accepted boolean")
    return docs.mapInArrow(scored, StructType([*docs.schema.fields, *added.fields]))
