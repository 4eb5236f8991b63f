"""Benchmark decontamination by item-sized windows.

A window of a document has as many words as a benchmark item. Postings of the
items' shingles tell which windows hold enough of an item's shingles for the
threshold; others cannot reach it and are passed over before fingerprints are
formed. SimHashes of the windows that are left are held against the item's by
blocks, one of which agrees up to a small ball wherever the whole distance is
within the radius, and candidates are verified by the exact weighted similarity
of the shingle multisets. An item that repeats a shingle weighs it several times
in its fingerprint, so its distances have no such bound: its windows go straight
to the exact similarity.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.simhash import BITS, segments, shingle_bounds

SHINGLE, THRESHOLD = 5, 0.8
#: At similarity 0.8 about 10 of 64 bits differ, with a deviation under 3; the radius is five deviations wider.
RADIUS, BLOCKS = 24, 8
#: Bytes of item text indexed at a time; a larger benchmark is searched for in several passes over the documents.
INDEX_BYTES = 8 << 20
#: Windows fingerprinted at a time.
CHUNK = 1 << 14


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words, split at white space."""
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def hashes_of(words: list[bytes], size: int) -> np.ndarray:
    """Hash of each shingle of ``size`` words; fewer words are one shingle, none are none."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, starts, ends = shingle_bounds(words, size)
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[s:e]) for s, e in zip(starts, ends)]), ">u8").astype(np.uint64)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two shingle multisets."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    common = sum((x & y).values())
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 0.0


class Item:
    """A benchmark item: its shingles, and its fingerprint unless a shingle repeats."""

    __slots__ = ("name", "words", "hashes", "print")

    def __init__(self, name: int, words: int, hashes: np.ndarray):
        self.name, self.words, self.hashes = name, words, hashes
        repeats = len(np.unique(hashes)) < len(hashes)
        self.print = None if repeats else _packed(2 * _bits(hashes).sum(0, dtype=np.int64)[None, :] > len(hashes))[0]


class Index:
    """Items with the postings of their shingles, as sorted arrays: some 30 bytes for each word of the items."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, threshold: float, radius: int, blocks: int):
        self.threshold, self.radius, self.blocks = threshold, radius, segments(radius, blocks)
        self.items: dict[int, list[Item]] = {}
        for name, text in items:
            words = words_of(text)
            if words:
                self.items.setdefault(min(shingle, len(words)), []).append(Item(name, len(words), hashes_of(words, shingle)))
        self.postings = {}
        for gram, own in self.items.items():
            hashes = [np.unique(i.hashes) for i in own]
            owner = np.repeat(np.arange(len(own), dtype=np.int32), [len(h) for h in hashes])
            hashes = np.concatenate(hashes)
            order = np.argsort(hashes, kind="stable")
            known, starts = np.unique(hashes[order], return_index=True)
            self.postings[gram] = known, np.append(starts, len(order)), owner[order]

    def matches(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """``(item, first word, words, similarity)``: the best window of each item at or over the threshold."""
        words, found = words_of(text), []
        for gram, own in self.items.items():
            hashes = hashes_of(words, gram)
            if not len(hashes):
                continue
            known, starts, owners = self.postings[gram]
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = np.flatnonzero(known[at] == hashes)
            if not len(hit):
                continue
            lengths = starts[at[hit] + 1] - starts[at[hit]]
            ends = np.cumsum(lengths)
            holder = owners[np.arange(ends[-1]) + np.repeat(starts[at[hit]] - ends + lengths, lengths)]
            places = np.repeat(hit, lengths)
            order = np.argsort(holder, kind="stable")
            names, firsts = np.unique(holder[order], return_index=True)
            for i, held in zip(names.tolist(), np.split(places[order], firsts[1:])):
                best = self._best(own[i], hashes, held)
                if best:
                    found.append((own[i].name, best[1], min(own[i].words, len(words)), -best[0]))
        return self._once(found)

    @staticmethod
    def _once(found: list) -> list:
        best = {}
        for item, start, size, score in found:
            if item not in best or (-score, start) < (-best[item][3], best[item][1]):
                best[item] = (item, start, size, score)
        return sorted(best.values())

    def _best(self, item: Item, hashes: np.ndarray, held: np.ndarray) -> tuple[float, int] | None:
        """(-similarity, start) of the best window of one item, given the places of its shingles in the text."""
        span = min(len(item.hashes), len(hashes))
        due = self.threshold / (1 + self.threshold) * (span + len(item.hashes)) - 1e-6  # shingles in common at the threshold
        if len(held) < due:
            return None
        last, best = len(hashes) - span, None
        cover = np.zeros(last + 2, np.int64)
        np.add.at(cover, np.clip(held - span + 1, 0, last), 1)
        np.add.at(cover, np.minimum(held, last) + 1, -1)
        starts = np.flatnonzero(np.cumsum(cover)[: last + 1] >= due)
        for lo in range(0, len(starts), CHUNK):
            some = starts[lo : lo + CHUNK]
            for run in np.split(some, np.flatnonzero(np.diff(some) > span) + 1):
                for start in self._candidates(item, hashes, run, span):
                    score = similarity(hashes[start : start + span], item.hashes)
                    if score >= self.threshold and (best is None or (-score, start) < best):
                        best = (-score, start)
        return best

    def _candidates(self, item: Item, hashes: np.ndarray, run: np.ndarray, span: int) -> list[int]:
        """Windows whose fingerprints are within the radius: some block's ball holds them, then the whole distance does."""
        if item.print is None or not len(run):
            return run.tolist()
        base, end = int(run[0]), int(run[-1]) + span
        sums = np.zeros((end - base + 1, BITS), np.int32)
        np.cumsum(_bits(hashes[base:end]), axis=0, dtype=np.int32, out=sums[1:])
        differing = _packed(2 * (sums[run - base + span] - sums[run - base]) > span) ^ item.print
        near = np.zeros(len(run), bool)
        for shift, width, ball in self.blocks:
            near |= np.bitwise_count((differing >> np.uint64(shift)) & np.uint64((1 << width) - 1)) <= ball
        return run[near & (np.bitwise_count(differing) <= self.radius)].tolist()


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, shingle: int, threshold: float, radius: int) -> Iterator[Index]:
    """Indexes over the benchmark, each over at most ``INDEX_BYTES`` of text (or one longer item)."""
    items, size = [], 0
    rows = benchmark.filter(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("long"), F.col(text_col).cast("string"))
    for item, text in rows.toLocalIterator():
        if items and size + len(text) > INDEX_BYTES:
            yield Index(items, shingle, threshold, radius, BLOCKS)
            items, size = [], 0
        items.append((item, text))
        size += len(text)
    if items:
        yield Index(items, shingle, threshold, radius, BLOCKS)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    radius: int = RADIUS,
) -> DataFrame:
    """Rows ``(id_col, item_id long, start_word long, n_words long, similarity double)``.

    One row for each document and item whose best item-sized window reaches the
    threshold; of equal windows the first. A document shorter than the item is
    one window. Items under ``shingle`` words are one shingle. Null or wordless
    texts and null items match nothing; rows that repeat a document repeat its
    rows; items with equal texts each match. Empty tables give an empty result.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = rows.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, item_id long, start_word long, n_words long, similarity double"
    names = [id_col, "item_id", "start_word", "n_words", "similarity"]
    found = None
    for index in _indexes(benchmark, item_col, item_text_col, shingle, threshold, radius):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def matched(batches, shared=shared):
            for batch in batches:
                out = [(i, *m) for i, text in zip(batch.column(0).to_pylist(), batch.column(1)) for m in shared.value.matches(text.as_py())]
                columns = list(zip(*out)) if out else [[]] * 5
                kinds = [batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        part = rows.mapInArrow(matched, schema)
        found = part if found is None else found.unionAll(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, unchanged and unshuffled."""
    at = docs.columns.index(text_col)
    for index in _indexes(benchmark, item_col, item_text_col, SHINGLE, THRESHOLD, RADIUS):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches, shared=shared):
            for batch in batches:
                yield batch.filter(pa.array([not shared.value.matches(t.as_py()) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
