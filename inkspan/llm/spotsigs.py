"""Document fingerprints from spot signatures.

A signature is a common word (the anchor) with the chain of content words that
follows it; common words inside the chain are passed over. A text's fingerprint
is the set of its signatures, so it follows the prose and not menus or lists
that have no common words. Sets are partitioned by their length: two sets can
only be alike to a degree that the ratio of their lengths allows, so pairs from
length classes too far apart are decided without looking at the members.

Everything here is DataFrame functions; no Python runs on the rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The commonest function words of English, German, French and Spanish.
COMMON_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "be", "by", "as", "this", "are", "at", "from",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "auf", "des", "für", "ist", "nicht", "dem", "im", "ein", "eine", "als", "auch",
    "de", "la", "le", "et", "les", "en", "un", "du", "une", "que", "pour", "est", "qui", "par", "dans", "sur", "au", "pas", "avec", "ne",
    "el", "y", "los", "se", "del", "las", "por", "no", "con", "su", "una", "es", "para", "al", "lo", "como", "más", "pero", "sus", "o",
)
#: Words are runs of letters, marks and digits.
WORD = r"[\p{L}\p{M}\p{N}]+"
#: Hex digits of a signature.
DIGITS = 8
#: Blocks of neighbouring ids for each shuffle partition.
BLOCKS = 8


def signature_set(words: str, places: str, chain: int) -> Column:
    """Sorted distinct signatures of the column ``words``, whose content words stand at ``places``."""
    said = lambda j: F.get(words, j)
    digest = lambda *parts: F.substring(F.md5(F.concat_ws(" ", *parts)), 1, DIGITS)
    gaps = F.transform(
        places, lambda i, p: F.struct(F.when(p > 0, F.get(places, p - 1) + 1).otherwise(F.lit(0)).alias("start"), i.alias("end"), p.alias("p"))
    )
    follow = lambda g: F.transform(F.slice(places, g["p"] + 1, chain), said)
    of_gap = lambda g: F.transform(F.slice(words, g["start"] + 1, g["end"] - g["start"]), lambda a: digest(a, follow(g)))
    anchored = F.flatten(F.transform(F.filter(gaps, lambda g: g["end"] > g["start"]), of_gap))
    every = F.transform(words, lambda w, i: digest(F.slice(words, i + 1, chain + 1)))
    last = F.element_at(places, -1)
    has_anchor = (F.size(places) > 0) & (last >= F.size(places))
    return F.sort_array(F.array_distinct(F.when(has_anchor, anchored).otherwise(every)))


def with_signatures(df: DataFrame, text_col: str, out: str, anchors=COMMON_WORDS, chain: int = 2) -> DataFrame:
    """``df`` with ``out array<string>``, the signature set of ``text_col``.

    A chain at the end of a text may be shorter. A text in which no anchor
    stands before a content word takes the chain that starts at each of its
    words instead, so only a text without words has an empty set.
    """
    words, places = f"{out}_words", f"{out}_places"
    df = df.withColumn(words, F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(WORD), F.lit(0)))
    content = F.filter(F.transform(words, lambda w, i: F.when(~w.isin(*anchors), i)), lambda i: i.isNotNull())
    return df.withColumn(places, content).withColumn(out, signature_set(words, places, chain)).drop(words, places)


def fingerprint(signatures: Column | str) -> Column:
    """A signature set as one string, ``DIGITS`` hex digits a signature in rising order."""
    return F.array_join(signatures, "")


def length_class(size: Column, threshold: float) -> Column:
    """Number of the length partition; sets of Jaccard ``threshold`` or more are at most one apart. Empty sets are in class -1."""
    return F.when(size == 0, -1).otherwise(F.floor(F.log(size.cast("double")) / F.lit(-math.log(threshold)))).cast("int")


def jaccard(left: Column | str, right: Column | str, threshold: float = 0.0) -> Column:
    """Jaccard similarity of two sorted signature sets; 0 where it is under ``threshold``.

    The bounds come first: the ratio of the sets' lengths, and whether their
    ranges meet at all. Only pairs within both are intersected. Two empty sets
    are alike (1), an empty and another one are not (0).
    """
    a, b = (F.col(c) if isinstance(c, str) else c for c in (left, right))
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    apart = (F.element_at(a, -1) < F.get(b, 0)) | (F.element_at(b, -1) < F.get(a, 0))
    exact = shared / (small + large - shared)
    return (
        F.when(large == 0, 1.0)
        .when((small == 0) | (small < large * F.lit(threshold)), 0.0)
        .when(apart, 0.0)
        .when(exact < threshold, 0.0)
        .otherwise(exact)
    )


def with_next(docs: DataFrame, id_col: str, parts: int) -> DataFrame:
    """``docs`` (id, ``text``) dealt by ``block`` for looking at the next document by descending id; ``late`` marks copies.

    Evenly spread values split the ids into blocks that one window task each can
    order. The document that opens a block is also sent to the block before,
    behind its rows, and the very first one to the last block. The number of
    partitions is fixed, as reading signatures costs much for few bytes.
    """
    key, blocks = F.col(id_col), BLOCKS * parts
    literal = lambda values, kind=np.int64: F.lit(np.array(values, kind))  # one literal, however long
    spread = F.percentile_approx(key, literal([k / blocks for k in range(1, blocks)], np.float64), F.lit(20 * blocks))
    splits = sorted(set(docs.agg(spread).first()[0] or []), reverse=True)
    if splits:  # how many splits are not below the id, counted by strides first
        step = max(1, math.isqrt(len(splits)))
        coarse = F.size(F.filter(literal(splits[step - 1 :: step]), lambda s: s >= key))
        fine = F.size(F.filter(F.slice(literal(splits), coarse * step + 1, step), lambda s: s >= key))
        block = F.when(key.isNull(), len(splits)).otherwise(coarse * step + fine)
    else:
        block = F.lit(0)
    opening = sorted((r["block"], r["first"]) for r in docs.groupBy(block.alias("block")).agg(F.max(key).alias("first")).collect())
    first, no_id, before = ([0] * (len(splits) + 1) for _ in range(3))
    for (b, value), (previous, _) in zip(opening, opening[-1:] + opening[:-1]):
        first[b], no_id[b], before[b] = value or 0, int(value is None), previous
    at = lambda values: F.get(literal(values), F.col("block_"))
    opens = F.when(at(no_id) == 1, key.isNull()).otherwise(key == at(first))
    place = lambda b, late: F.struct(b.cast("int").alias("block"), F.lit(late).alias("late"))
    sent = F.array(place(F.col("block_"), 0), F.when(opens, place(at(before), 1)))
    dealt = docs.withColumn("block_", block).select(id_col, "text", F.explode(F.array_compact(sent)).alias("to"))
    return dealt.select(id_col, "text", "to.block", "to.late").repartition(parts, "block")


def compare_neighbours(
    docs: DataFrame, threshold: float = 0.0, share: int = 3, anchors=COMMON_WORDS, chain: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``id_col``, ``n_chars long``, ``text``, ``next_id``, ``edited``, the signature sets ``signatures``,
    ``edited_signatures`` and ``next_signatures``, and the likenesses ``near_edited`` and ``near_next`` (double, 0 to 1).

    The next document is the one with the next smaller id; after the last comes
    the first, and a single document follows itself. A null id comes last, rows
    that repeat an id follow one another by their texts' hash and share a block.
    The edited text has its last ``n_chars // share`` code points replaced by as
    many (or all) of the next document's first. A null text counts as empty; a
    text without words has an empty set, and two empty sets are alike. Likeness
    is the Jaccard similarity of the sets, 0 where it is under ``threshold``.
    An empty table gives an empty result. Other columns of ``docs`` are not read.

    The texts are shuffled once. Only the blocks' bounds and first ids, ``BLOCKS``
    for each shuffle partition, pass through the driver.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_signatures(with_next(texts, id_col, parts), "text", "signatures", anchors, chain)
    order = W.partitionBy("block").orderBy("late", F.col(id_col).desc_nulls_last(), F.xxhash64("text"))
    found = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", "signatures")} | {"next_id": F.lead(id_col).over(order)})
    n, cut = F.length("text"), F.floor(F.length("text") / share).cast("int")
    found = found.filter("late = 0").withColumns(
        {"n_chars": n.cast("long"), "edited": F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))}
    )
    found = with_signatures(found, "edited", "edited_signatures", anchors, chain)
    return found.select(
        id_col, "n_chars", "text", "next_id", "edited", "signatures", "edited_signatures", "next_signatures",
        jaccard("signatures", "edited_signatures", threshold).alias("near_edited"),
        jaccard("signatures", "next_signatures", threshold).alias("near_next"),
    )


def classes(docs: DataFrame, anchors=COMMON_WORDS, chain: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``class_id`` of every document, and ``signatures``: documents of equal sets share the smallest id of them.

    A null id counts after all others; a class of null ids alone has none. The
    class is found by aggregation within each task first, so a group of copies
    of any size is a row per task.
    """
    made = with_signatures(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")), "text", "signatures", anchors, chain)
    made = made.select(id_col, "signatures", F.sha2(fingerprint("signatures"), 256).alias("digest"))
    named = made.groupBy("digest").agg(F.min(id_col).alias("class_id"))
    return made.join(named, "digest").select(id_col, "class_id", "signatures")


def near_pairs(sets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(left_id, right_id, near)`` of all pairs of classes whose sets have a Jaccard similarity of ``threshold`` or more, left below right.

    ``sets`` has ``class_id`` and ``signatures``, as ``classes`` gives them; each
    class takes part once, and classes without an id or with an empty set in no
    pair. Sets are partitioned by length: one meets the sets of its own length
    class and of the next smaller one, no others. In a partition two sets meet
    if they share one of the first signatures, rarest first, that a pair of that
    similarity must share; lengths and places bound the rest, and what is left is
    intersected. No candidate is capped.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    one = sets.filter("class_id is not null").groupBy("class_id").agg(F.first("signatures").alias("signatures"))
    postings = one.select("class_id", F.explode("signatures").alias("signature"))
    counts = postings.groupBy("signature").agg(F.count("*").alias("n"))
    ordered = postings.join(counts, "signature").groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("n", "signature"))).alias("found"))
    size = F.size("found")
    first = size - F.ceil(size * F.lit(threshold) - F.lit(1e-9)) + 1
    heads = ordered.select("class_id", size.alias("size"), length_class(size, min(threshold, 0.999) * (1 - 1e-9)).alias("part"), F.posexplode(F.slice("found", F.lit(1), first.cast("int"))).alias("place", "head"))
    heads = heads.select("class_id", "size", "part", "place", F.col("head.signature").alias("signature"))
    index = heads.toDF("left_id", "left_size", "part", "left_place", "signature")
    probes = heads.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") - 1))).toDF("right_id", "right_size", "part", "right_place", "signature")
    smaller = F.struct("left_size", "left_id") < F.struct("right_size", "right_id")
    least = F.ceil((F.col("left_size") + F.col("right_size")) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))
    rest = F.least(F.col("left_size") - F.col("left_place"), F.col("right_size") - F.col("right_place"))
    bounded = smaller & (F.col("left_size") >= F.col("right_size") * F.lit(threshold) - F.lit(1e-9))
    met = index.join(probes, ["part", "signature"]).filter(bounded).groupBy("left_id", "right_id").agg(
        F.min(F.struct("left_place", "right_place", rest.alias("rest"))).alias("at"), F.first(least).alias("least")
    )
    met = met.filter(F.col("at.rest") >= F.col("least")).select("left_id", "right_id")
    side = lambda name: one.select(F.col("class_id").alias(f"{name}_id"), F.col("signatures").alias(name))
    found = met.join(side("left"), "left_id").join(side("right"), "right_id").withColumn("near", jaccard("left", "right", threshold)).filter("near > 0")
    return found.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "near")
