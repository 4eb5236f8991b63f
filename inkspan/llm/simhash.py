"""SimHash near-duplicate classes by multi-index hashing.

A fingerprint is split into segments. Two fingerprints within the radius agree
in some segment up to a small number of bits, so enumerating that small Hamming
ball around each segment value and looking the values up in a table of all
fingerprints finds every pair; full distances are then verified. A segment value
that many fingerprints share is looked up together with blocks of the other bits.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.components import connected_components, unbroadcast
from inkspan.llm.scratch import Tables, discard

BITS = 64
#: Shingles whose bits are unpacked at a time; bounds memory for very long texts.
CHUNK = 1 << 16
#: A segment value with more fingerprints than the i-th of these is looked up with i + 1 further blocks. Sets the cost, never the result.
HEAT = (1 << 6, 1 << 12, 1 << 16)


def shingle_bounds(words: list[bytes], size: int) -> tuple[bytes, list[int], list[int]]:
    """The space-joined words, with start and end offset of each shingle in them."""
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) < size:
        return joined, starts[:1].tolist(), ends[-1:].tolist()
    return joined, starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()


def fingerprint(text: bytes, size: int) -> int:
    """Unsigned SimHash of a text's word shingles: a bit is set if over half the shingle hashes set it."""
    words = text.lower().split()  # on bytes: A-Z, and space with \t\n\v\f\r
    if not words:
        return 0
    joined, starts, ends = shingle_bounds(words, size)
    digest, counts = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = b"".join([digest(joined[s:e], 42) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """Rows ``(id_col long, fingerprint long)``, one per input row; null text counts as empty.

    The fingerprint's 64 bits are held in a signed long. Other columns are not read.
    """

    def hashed(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            bits = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=[id_col, "fingerprint"])

    columns = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return columns.mapInArrow(hashed, f"`{id_col}` long, fingerprint long")


def segments(radius: int, count: int) -> list[tuple[int, int, int]]:
    """``(shift, width, ball radius)`` of each segment.

    With s = radius // count and a = radius - s * count, a pair within the radius
    is within s in one of the first a + 1 segments or within s - 1 in another one;
    a segment whose ball would be empty is left out.
    """
    small, extra = divmod(radius, count)
    cuts = [BITS * i // count for i in range(count + 1)]
    balls = [small if i <= extra else small - 1 for i in range(count)]
    return [(lo, hi - lo, ball) for lo, hi, ball in zip(cuts, cuts[1:], balls) if ball >= 0]


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << bit for bit in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]


def _segment(column, shift: int, width: int):
    return F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << width) - 1))


def _probes(number: int, shift: int, width: int, ball: int):
    """Array of (segment, value) to look up: the Hamming ball around a segment's value."""
    flips = F.array(*[F.lit(x).cast("long") for x in _ball(width, ball)])
    own = _segment(F.col("f"), shift, width)
    return F.transform(flips, lambda flip: F.struct(F.lit(number).alias("segment"), own.bitwiseXOR(flip).alias("at")))


def midpoint_links(classes: DataFrame, key: str, value: str = "fingerprint") -> DataFrame:
    """Links ``(a, b)`` that connect every two keys whose fingerprints differ in at most two bits.

    Such fingerprints share a point at most one bit from either, so each key
    names its fingerprint and the 64 points around it, and links to the least
    key that names the same point: rows grow with the keys, not with their
    pairs, and a point has 65 keys at most.
    """
    rows = classes.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
    flips = F.array(*[F.lit(_signed(x)).cast("long") for x in _ball(BITS, 1)])
    points = rows.select(F.col(key).alias("a"), F.col(value).alias("f"), F.explode(flips).alias("flip"))
    points = points.select("a", F.col("f").bitwiseXOR(F.col("flip")).alias("point"))
    named = points.groupBy("point").agg(F.min("a").alias("b"), F.max("a").alias("most"))
    shared = named.filter("b <> most").select("point", "b")
    return points.join(unbroadcast(shared), "point").filter("a <> b").select("a", "b").distinct()


def _signed(x: int) -> int:
    return x - (x >> (BITS - 1) << BITS)


def block_masks(shift: int, width: int, radius: int, agreeing: int) -> list[int]:
    """Masks over the bits outside a segment such that two values within the radius agree under one of them, at least.

    The bits are cut into ``radius + agreeing`` blocks, of which ``agreeing`` must
    be free of differences; each mask covers that many blocks.
    """
    outside = [b for b in range(BITS) if not shift <= b < shift + width]
    count = radius + agreeing
    blocks = [sum(1 << b for b in outside[len(outside) * i // count : len(outside) * (i + 1) // count]) for i in range(count)]
    return [sum(chosen) for chosen in combinations(blocks, agreeing)]


def _heat(table: DataFrame) -> DataFrame:
    """Rows ``(segment, at, depth, main)`` of the segment values over the first of ``HEAT``; main is the value's largest group."""
    groups = table.groupBy("segment", "at", "g").agg(F.count("*").alias("n"))
    values = groups.groupBy("segment", "at").agg(F.sum("n").alias("n"), F.max_by("g", F.struct("n", "g")).alias("main"))
    depth = sum((F.col("n") > bound).cast("int") for bound in HEAT)
    return values.filter(F.col("n") > HEAT[0]).select("segment", "at", depth.alias("depth"), "main")


def hamming_links(
    classes: DataFrame,
    key: str,
    value: str = "fingerprint",
    radius: int = 4,
    count: int = 3,
    group: str | None = None,
    tables: Tables | None = None,
) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of keys whose fingerprints differ in at most ``radius`` bits.

    ``classes`` has one row per distinct key. Each pair comes out once. Null keys
    or fingerprints have no links. With ``group``, a column that tells what is
    connected already, the pairs are distinct pairs of different groups instead.

    A segment value that n fingerprints share would cost n * n comparisons. Over
    ``HEAT`` it is therefore looked up under every choice of one to three blocks
    of the other bits, all of which a pair within the radius must have alike in
    some choice; and its largest group is not compared with itself. The heat of
    values is written through ``tables``, for the caller to clear after reading.
    """
    parts = segments(radius, count)
    tables = tables or Tables(classes.sparkSession)
    rows = classes.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
    rows = rows.select(F.col(key).alias("k"), F.col(value).alias("f"), F.col(group or key).alias("g"))
    table = rows.select("k", "f", "g", F.posexplode(F.array(*[_segment(F.col("f"), s, w) for s, w, _ in parts])).alias("segment", "at"))
    probed = rows.select("k", "f", "g", F.inline(F.flatten(F.array(*[_probes(i, *part) for i, part in enumerate(parts)]))))
    heat = tables.write(_heat(table), "heat")
    # Masks by segment and depth; without heat one empty mask, under which all agree.
    masks = F.array(*[F.array(*[F.array(*[F.lit(_signed(m)).cast("long") for m in block_masks(s, w, radius, d)]) for d in range(len(HEAT) + 1)]) for s, w, _ in parts])
    chosen = F.get(F.get(masks, F.col("segment")), F.coalesce("depth", F.lit(0)))
    own = F.coalesce(F.col("g") == F.col("main"), F.lit(False))
    sides = F.when(F.col("main").isNull() | own, F.array(F.lit(False))).otherwise(F.array(F.lit(True), F.lit(False)))

    def keyed(side: DataFrame, main) -> DataFrame:
        looked = side.join(heat, ["segment", "at"], "left").select("k", "f", "g", "segment", "at", "depth", main)
        return looked.select("*", F.explode(chosen).alias("mask")).withColumn("part", F.col("f").bitwiseAND(F.col("mask")))

    a, b = keyed(probed, F.explode(sides).alias("main")).alias("a"), keyed(table, own.alias("main")).alias("b")
    differing = F.col("a.f").bitwiseXOR(F.col("b.f"))
    first = F.lit(None).cast("int")
    for i, (s, w, r) in reversed(list(enumerate(parts))):
        first = F.when(F.bit_count(_segment(differing, s, w)) <= r, i).otherwise(first)
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("segment", "at", "mask", "part", "main")]
    apart = (F.col("a.k") < F.col("b.k")) & (F.col("a.g") != F.col("b.g"))
    joined = a.join(unbroadcast(b), reduce(and_, same) & apart & (F.bit_count(differing) <= radius) & (first == F.col("a.segment")))
    ends = (F.least("a.g", "b.g"), F.greatest("a.g", "b.g")) if group else (F.col("a.k"), F.col("b.k"))
    return joined.select(ends[0].alias("a"), ends[1].alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, segment_count: int = 3
) -> DataFrame:
    """Near-duplicate classes: ``(id_col, fingerprint long, component_id long)``, one row per document.

    Documents link when their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest id reachable by links, itself included.
    Equal fingerprints are one class before any search, so a group of copies
    costs one row in it. Classes at most two bits apart are connected first by
    the points they share, so a large group of near copies is mostly one
    component before the multi-index search, which then emits links between
    different components only. Null and wordless texts have fingerprint zero and link
    like any other. Rows without an id are kept, with the component that their
    fingerprint has, or null if no row of it has an id. Repeated ids count once
    per row. An empty table gives an empty result; other columns are not read.
    The result reads three tables in the shared folder; all others are deleted.
    """
    read, passing = Tables(docs.sparkSession), Tables(docs.sparkSession)
    prints = read.write(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = passing.write(prints.groupBy("fingerprint").agg(F.min(id_col).alias("rep")), "classes")
    if radius >= 2:
        near = connected_components(midpoint_links(classes, "rep"), "a", "b")
        joined = classes.join(unbroadcast(near), F.col("rep") == F.col("node"), "left")
    else:
        joined, near = classes.withColumn("component", F.col("rep")), None
    classes = read.write(joined.select("fingerprint", "rep", F.coalesce("component", "rep").alias("near")), "classes")
    if near is not None:
        discard(near)
    links = hamming_links(classes, "rep", radius=radius, count=segment_count, group="near", tables=passing)
    labels = connected_components(links, "a", "b")
    passing.clear()
    named = classes.join(unbroadcast(labels), F.col("near") == F.col("node"), "left").select("fingerprint", F.coalesce("component", "near").alias("component_id"))
    return prints.join(unbroadcast(named), "fingerprint").select(id_col, "fingerprint", "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its near-duplicate class, with the columns of ``docs``.

    Ids should be unique; rows that share one stay or go together. Rows without an id stay.
    """
    found = near_duplicates(docs, id_col, text_col, **parameters)
    gone = found.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
