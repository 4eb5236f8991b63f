"""Importance resampling towards a target distribution.

Hashed n-gram counts of the corpus and of the target give every bucket a gain,
an array of fixed size by which documents are weighted. Documents are then
drawn without replacement by weight plus Gumbel noise. The last drawn key is
found exactly by a distributed radix selection over the digits of the composite
key (score, id), and only drawn rows are sorted by range and ranked.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.llm.scratch import materialise

#: Words are runs of digits, letters and everything beyond ASCII, in UTF-8 the bytes from 0x80 on: A-Z become a-z, all else a space.
WORD_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()
#: Bytes of a text that are cut into words at a time.
BLOCK = 1 << 20
#: Bits of a key looked at in one round of the selection; a round sends 2^DIGIT counts to the driver at most.
DIGIT = 14
SIGN = 1 << 63


def feature_hashes(text: bytes | None) -> Iterator[tuple[int, np.ndarray]]:
    """(words, CRC-32 of the runs of one and two words) of each block of a text. Runs across blocks are included."""
    low = (text or b"").translate(WORD_BYTES)
    start, before = 0, None
    while start < len(low):
        end = low.find(b" ", start + BLOCK)
        end = end if end >= 0 else len(low)
        words = low[start:end].split()
        start = end
        if not words:
            continue
        single = [zlib.crc32(w) for w in words]
        heads = single[:-1] if before is None else [before, *single[:-1]]
        tails = words[1:] if before is None else words
        double = [zlib.crc32(b" " + w, head) for head, w in zip(heads, tails)]
        before = single[-1]
        yield len(words), np.array(single + double, np.int64)


def bucket_counts(texts: DataFrame, text_col: str, buckets: int) -> np.ndarray:
    """Features of all rows by bucket. Each task counts its own rows; one row per bucket reaches the driver."""

    def counted(batches):
        found = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, hashes in feature_hashes(text.as_py()):
                    found += np.bincount(hashes % buckets, minlength=buckets) if len(hashes) * 8 > buckets else 0
                    if len(hashes) * 8 <= buckets:
                        np.add.at(found, hashes % buckets, 1)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], names=["bucket", "n"])

    parts = texts.select(F.col(text_col).cast("string").cast("binary")).mapInArrow(counted, "bucket int, n long")
    counts = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share in the target over that in the source."""
    spread, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    ratio = lambda s, t: (float(t + 1) * float(all_source + spread)) / (float(s + 1) * float(all_target + spread))
    return np.array([math.floor(1000 * math.log(ratio(int(s), int(t)))) for s, t in zip(source, target)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """``id_col``, ``n_words``, ``n_features`` and ``weight`` (floored mean of gains, 0 without a feature) of every row."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gains), len(gains)

    def weighed(batches):
        for batch in batches:
            gains, rows = shared.value, []
            for text in batch.column(1):
                words = features = total = 0
                for n, hashes in feature_hashes(text.as_py()):
                    words, features, total = words + n, features + len(hashes), total + int(gains[hashes % buckets].sum())
                rows.append((words, features, total // features if features else 0))
            found = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[:, i]) for i in range(3)]], names=["id", "n_words", "n_features", "weight"])

    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return ids.mapInArrow(weighed, "id long, n_words long, n_features long, weight long")


def upto_kth(df: DataFrame, keys: list[str], k: int) -> Column:
    """Condition that holds for the ``k`` rows of ``df`` that come first by the long columns ``keys``.

    Rows that share the k-th row's whole key all fulfil it. One key after the
    other is narrowed down to its value in the k-th row, ``DIGIT`` bits a round:
    a round counts the rows by digit, so what the driver sees is bounded.
    """
    if k <= 0:
        return F.lit(False)
    left, fixed, parts = k, F.lit(True), []
    for key in keys:
        value = F.col(key)
        ends = df.filter(fixed).agg(F.min(key), F.max(key)).first()
        if ends[0] is None:
            return F.lit(True)
        low, high = ends[0] + SIGN, ends[1] + SIGN
        bits = (low ^ high).bit_length()
        low = low >> bits << bits
        while bits:
            shift = max(0, bits - DIGIT)
            within = value.between(low - SIGN, low + (1 << bits) - 1 - SIGN)
            digit = F.shiftrightunsigned(value.bitwiseXOR(F.lit(-SIGN)), shift).bitwiseAND(F.lit((1 << (bits - shift)) - 1))
            counts = sorted(df.filter(fixed & within).groupBy(digit.alias("digit")).count().collect())
            for place, (at, n) in enumerate(counts):
                if left <= n or place == len(counts) - 1:
                    break
                left -= n
            low, bits = low + (at << shift), shift
            if left >= n:  # every row of the digit is taken, so its last value bounds the key
                return reduce(lambda a, b: a | b, parts, F.lit(False)) | (fixed & (value <= low + (1 << bits) - 1 - SIGN))
        parts.append(fixed & (value < low - SIGN))
        fixed = fixed & (value == low - SIGN)
    return reduce(lambda a, b: a | b, parts) | fixed


def rank_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with ``rank long`` (1, 2, 3, ... by ``keys``): sorted by range, and each range numbered after those before it.

    One row count per range passes through the driver.
    """
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = materialise(ordered.withColumn("place_", F.monotonically_increasing_id()), "ranked")
    part, within = F.shiftright("place_", 33), F.col("place_").bitwiseAND(F.lit((1 << 33) - 1))
    before, offsets = 0, []
    for row in sorted(ordered.groupBy(part.alias("part_")).count().collect()):
        offsets.append((row[0], before))
        before += row[1]
    found = df.sparkSession.createDataFrame(offsets, "part_ long, before_ long")
    ranked = ordered.withColumn("part_", part).join(F.broadcast(found), "part_")
    return ranked.withColumn("rank", F.col("before_") + within + 1).drop("part_", "before_", "place_")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """``id_col``, ``n_features``, ``n_words``, ``weight``, ``score`` and ``rank``, all long, of every row of ``docs``.

    Features are all runs of one and two words, repeats counted; words are runs
    of digits, letters and whatever lies beyond ASCII, A-Z lower-cased. The
    ``rank`` is 1, 2, 3, ... for the drawn documents and null for the others:
    ``percent`` per cent, rounded down, of the documents with ``min_words`` or
    more are drawn, by highest score.

    Ties go to the smaller id, and a null id, whose noise is that of an empty
    one, comes last; rows that repeat an id and a score are ranked one after
    the other. A null text counts as empty: no features, weight 0. Texts of any
    length are cut into words by blocks. An empty table gives an empty result,
    an empty target gives every bucket its smoothed share. Other columns of
    ``docs`` are not read. Counts cover all rows of both tables.

    The scored rows are written to the shared folder, so the selection's rounds
    and the result agree and none is computed again from the texts; that table
    and the one of drawn rows stay, as the result reads them. Broadcast are one
    gain per bucket and one row count per range.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((noise + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weigh(docs, gains, id_col, text_col).withColumn("score", F.col("weight") + gumbel)
    scored = scored.withColumns(
        {
            "by_score": F.bitwise_not("score"),
            "by_null": F.col("id").isNull().cast("long"),
            "by_id": F.coalesce("id", F.lit(0)).cast("long"),
            "by_row": F.monotonically_increasing_id(),
        }
    )
    scored = materialise(scored, "scored")
    keys = ["by_score", "by_null", "by_id", "by_row"]
    enough = F.col("n_words") >= min_words
    taken = enough & upto_kth(scored.filter(enough), keys, scored.filter(enough).count() * percent // 100)
    result = [F.col("id").alias(id_col), "n_features", "n_words", "weight", "score", "rank"]
    drawn = rank_rows(scored.filter(taken), keys)
    return drawn.select(*result).unionByName(scored.filter(~taken).withColumn("rank", F.lit(None).cast("long")).select(*result))
