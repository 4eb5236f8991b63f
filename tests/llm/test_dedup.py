import hashlib
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkspan.llm.components import connected_components
from inkspan.llm.exact_dedup import deduplicate, mark_duplicates
from inkspan.llm.scratch import materialise
from inkspan.llm.simhash import block_masks, fingerprint, hamming_links, keep_representatives, midpoint_links, near_duplicates, segments

SPACE = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    return groups


def test_exact_matches_brute_force(spark):
    rows = [(1, "a  b"), (2, "a\tb"), (3, None), (4, ""), (5, " "), (6, "x" * 200_000), (7, "x" * 200_000), (8, "a b"), (9, "a\u00a0b"), (10, "é\r\n z"), (11, "é z")]
    rows += [(100 + i, "hot copy") for i in range(300)] + [(1000 + i, f"prefix that many share {i % 7}") for i in range(50)]
    random.Random(1).shuffle(rows)
    found = {r.doc_id: r for r in mark_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    groups = brute_exact(rows)
    assert len(found) == len(rows)
    for text, ids in groups.items():
        for i in ids:
            r = found[i]
            assert (r.keep_id, r.group_size, r.kept) == (min(ids), len(ids), i == min(ids))
            assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_exact_ties_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")]
    found = mark_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sum(r.kept for r in found) == 2 and len(found) == 5
    assert {(r.keep_id, r.group_size) for r in found} == {(1, 3), (None, 2)}


def test_exact_hot_group_with_ties(spark):
    rows = [(5, "hot")] * 200 + [(None, "hot")] * 5 + [(i, f"t{i}") for i in range(20)]
    found = mark_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    hot = [r for r in found if r.group_size == 205]
    assert len(hot) == 205 and sum(r.kept for r in hot) == 1 and {r.keep_id for r in hot} == {5}


def test_exact_empty_table_and_clashing_names(spark):
    assert mark_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = spark.createDataFrame([(1, "a", "k", 3, "n", True)], "doc_id long, text string, keep_id string, run int, norm string, Kept boolean")
    (r,) = mark_duplicates(rows).collect()
    assert (r.keep_id, r.run, r.norm, r.kept) == (1, 3, "n", True)
    assert deduplicate(rows).columns == rows.columns


def plain_fingerprint(text, size):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \n", "One", "A b c", "A b c D", "É à É à É à É à", "one two three four five six " * 40, "a\u00a0b c\x1cd e f"])
def test_fingerprint_matches_plain_version(text):
    assert fingerprint(text.encode(), 4) == plain_fingerprint(text, 4)


def test_fingerprint_of_a_very_long_text():
    rng = random.Random(3)
    text = " ".join(str(rng.randint(0, 50)) for _ in range(150_000))
    assert fingerprint(text.encode(), 4) == plain_fingerprint(text, 4)


def test_segments_cover_every_pair_within_the_radius():
    rng = random.Random(5)
    for radius, count in ((4, 3), (4, 4), (4, 2), (3, 4), (24, 8)):
        parts = segments(radius, count)
        for _ in range(3000):
            x = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(bin(x >> s & (1 << w) - 1).count("1") <= ball for s, w, ball in parts)


def test_links_are_all_pairs_within_the_radius(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64) * np.uint64(2)
    prints = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(6):
            prints.add(b ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(1, 7), replace=False)))
    prints = sorted(prints)
    rows = [(i, int(np.uint64(p).astype(np.int64))) for i, p in enumerate(prints)]
    found = {(r.a, r.b) for r in hamming_links(spark.createDataFrame(rows, "rep long, fingerprint long"), "rep").collect()}
    assert found == {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if bin(prints[i] ^ prints[j]).count("1") <= 4}


@pytest.mark.parametrize("depth", [0, 1, 2, 3])
def test_masks_cover_every_pair_within_the_radius(depth):
    rng = random.Random(depth)
    for shift, width, _ in segments(4, 3):
        masks = block_masks(shift, width, 4, depth)
        inside = (1 << width) - 1 << shift
        assert not any(m & inside for m in masks)
        for _ in range(2000):
            x = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(x & m == 0 for m in masks)


@pytest.mark.parametrize("heat", [(0, 2, 4), (0, 1 << 40, 1 << 40), (2, 6, 40)])
def test_links_through_hot_segment_values(spark, monkeypatch, heat):
    """However hot the values count as, the links are those of brute force, with and without groups."""
    monkeypatch.setattr("inkspan.llm.simhash.HEAT", heat)
    rng = np.random.default_rng(7)
    prints = set()
    for b in rng.integers(0, 1 << 42, 25, dtype=np.uint64).tolist():  # one value in the last segment
        prints |= {b ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(7)}
    prints = sorted(prints)
    pairs = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if bin(prints[i] ^ prints[j]).count("1") <= 4}
    rows = spark.createDataFrame([(i, int(np.uint64(p).astype(np.int64)), i % 3) for i, p in enumerate(prints)], "rep long, fingerprint long, near long")
    assert {(r.a, r.b) for r in hamming_links(rows, "rep").collect()} == pairs
    assert {(r.a, r.b) for r in hamming_links(rows, "rep", group="near").collect()} == {tuple(sorted((i % 3, j % 3))) for i, j in pairs if i % 3 != j % 3}


def test_a_hot_segment_value_is_not_compared_with_itself(spark):
    """60,000 fingerprints with one value in a segment: far less time than their 1.8 billion pairs would take, and no link is lost."""
    rng = np.random.default_rng(1)
    prints = np.unique(rng.integers(0, 1 << 42, 60_000, dtype=np.int64))
    near = prints[:50] ^ 0b1111
    frame = spark.createDataFrame([(i, int(p)) for i, p in enumerate([*prints, *np.setdiff1d(near, prints)])], "rep long, fingerprint long").repartition(8).cache()
    frame.count()
    start = time.monotonic()
    found = hamming_links(frame, "rep").count()
    assert found >= 50 and time.monotonic() - start < 60


def test_midpoints_connect_all_pairs_within_two_bits(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    prints = {int(b) for b in base} | {0, 2**64 - 1, 2**63, 1, 3}
    for b in base.tolist():
        for _ in range(8):
            prints.add(b ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(1, 5), replace=False)))
    prints = sorted(prints)
    near = {i: i for i in range(len(prints))}
    pairs = [(i, j) for i in near for j in near if i < j and bin(prints[i] ^ prints[j]).count("1") <= 2]
    for _ in prints:
        for i, j in pairs:
            near[i] = near[j] = min(near[i], near[j])
    rows = spark.createDataFrame([(i, int(np.uint64(p).astype(np.int64))) for i, p in enumerate(prints)], "rep long, fingerprint long")
    found = {r.node: r.component for r in connected_components(midpoint_links(rows, "rep"), "a", "b").collect()}
    assert found == {i: c for i, c in near.items() if any(i in p for p in pairs)}
    grouped = rows.withColumn("near", F.create_map(*[F.lit(x) for kv in near.items() for x in kv])[F.col("rep")].cast("long"))
    links = {(r.a, r.b) for r in hamming_links(grouped, "rep", group="near").collect()}
    wanted = {tuple(sorted((near[i], near[j]))) for i in near for j in near if i < j and bin(prints[i] ^ prints[j]).count("1") <= 4 and near[i] != near[j]}
    assert links == wanted


def test_pairs_are_not_formed_by_a_broadcast(spark):
    """Spark takes these small files for their exploded rows, so without a hint it broadcasts them."""
    rows = materialise(spark.range(500).select(F.col("id").alias("rep"), F.xxhash64("id").alias("fingerprint")), "rows")
    texts = spark.range(500).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    for found in (midpoint_links(rows, "rep"), hamming_links(rows, "rep"), near_duplicates(texts)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"BroadcastHashJoin.* Inner", plan), plan


def test_components_match_union_find(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)]
    links += [(5, 5), (None, 3), (3, 2), (2, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert found == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_near_duplicates_edge_cases(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(9, text), (4, text.upper()), (7, None), (3, " "), (None, text), (8, "other words entirely here now")]
    found = near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    by_id = {r.doc_id: r.component_id for r in found if r.doc_id}
    assert by_id == {9: 4, 4: 4, 7: 3, 3: 3, 8: 8} and len(found) == 6
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    kept = keep_representatives(spark.createDataFrame(rows, DOCS).withColumn("component_id", F.lit("mine")))
    assert {r.doc_id for r in kept.collect()} == {4, 3, None, 8} and kept.columns == ["doc_id", "text", "component_id"]


def test_near_duplicates_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, plain_fingerprint(r.text, 4)) for r in docs.collect()]
    component = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, p in rows:
            low = min(component[j] for j, q in rows if bin(p ^ q).count("1") <= 4)
            if low < component[i]:
                component[i], changed = low, True
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == component
