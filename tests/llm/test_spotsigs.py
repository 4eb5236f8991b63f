import hashlib
import itertools
import random

import pytest
import regex

from inkspan.llm import spotsigs
from inkspan.llm.queries import op12_fingerprints
from inkspan.llm.spotsigs import compare_neighbours, fingerprint, jaccard, length_class

DOCS = "doc_id long, text string"


def brute_signatures(text, anchors=spotsigs.COMMON_WORDS, chain=2):
    words = regex.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").lower())
    signs = lambda parts: hashlib.md5(" ".join(parts).encode()).hexdigest()[:8]
    found = set()
    for i, word in enumerate(words):
        if word in anchors:
            after = list(itertools.islice((words[j] for j in range(i + 1, len(words)) if words[j] not in anchors), chain))
            if after:
                found.add(signs([word, *after]))
    return found or {signs(words[i : i + chain + 1]) for i in range(len(words))}


def likeness(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def brute(rows):
    """doc_id -> expected row; ids must differ."""
    ordered = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        text, after = text or "", after or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = map(brute_signatures, (text, edited, after))
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(sorted(a)), "".join(sorted(b)), likeness(a, b), likeness(a, c))
    return out


def rows_of(docs):
    found = compare_neighbours(docs).withColumns({"f": fingerprint("signatures"), "g": fingerprint("edited_signatures")}).collect()
    return {r.doc_id: (r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest(), r.f, r.g, r.near_edited, r.near_next) for r in found}, len(found)


def sample(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "is", "der", "la", "Über", "naïve", "cat", "dog", "sun", "漢字", "x1", "é", "\U0001f600", "..."]
    return [(rng.randint(-(2**62), 2**62), " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 30, 90])))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_rows_equal_brute_force(spark, seed):
    rows = sample(seed, 150) + [(0, None), (1, ""), (2, "the"), (3, "the of"), (4, "word " * 30_000), (5, "of a"), (6, "?!" * 500), (7, "The sun is a dog the sun")]
    found, n = rows_of(spark.createDataFrame(rows, DOCS).repartition(5))
    assert n == len(rows) and found == brute(rows)


def test_small_tables(spark):
    assert compare_neighbours(spark.createDataFrame([], DOCS)).collect() == []
    (one,) = compare_neighbours(spark.createDataFrame([(4, "the cat saw a dog")], DOCS)).collect()
    assert one.next_id == 4 and one.near_next == 1.0 and one.edited == "the cat saw " + "the c"
    two, _ = rows_of(spark.createDataFrame([(4, "the cat saw a dog"), (9, "")], DOCS))
    assert two == brute([(4, "the cat saw a dog"), (9, "")])


def test_null_and_repeated_ids_and_clashing_names(spark):
    rows = [(None, "the cat sat", 1), (5, "of a house", 2), (5, "of a house", 3), (5, "the tree", None), (None, None, 4), (1, "la casa", 5)]
    found = compare_neighbours(spark.createDataFrame(rows, DOCS + ", block_ int")).collect()
    assert len(found) == len(rows)
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in rows)
    assert [r.next_id for r in found if r.doc_id == 1] == [None]  # null ids come last
    assert sorted(str(r.next_id) for r in found) == sorted(str(r[0]) for r in rows)  # every row follows one
    nulls = compare_neighbours(spark.createDataFrame([(None, "the a b"), (None, "the c d")], DOCS)).collect()
    assert {r.near_next for r in nulls} == {0.0} and len(nulls) == 2


def test_equal_texts_share_a_fingerprint_and_edits_stay_near(spark):
    found = op12_fingerprints(spark, "/root/testdata/sf0.001").collect()
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    by_text = {}
    for r in found:
        assert by_text.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    long = [r for r in found if r.n_chars > 600]
    assert sum(r.near_edited for r in long) / len(long) > 0.4
    assert sum(r.near_next for r in long) / len(long) < 0.1


def test_pruned_jaccard_and_length_classes(spark):
    rng = random.Random(2)
    pairs = [(sorted(rng.sample([f"{i:03d}" for i in range(40)], rng.randint(0, 12))), sorted(rng.sample([f"{i:03d}" for i in range(40)], rng.randint(0, 12)))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    from pyspark.sql import functions as F

    for threshold in (0.0, 0.2, 0.8):
        shown = df.select("a", "b", jaccard("a", "b", threshold).alias("j"), length_class(F.size("a"), 0.8).alias("p"), length_class(F.size("b"), 0.8).alias("q"))
        for r in shown.collect():
            full = likeness(set(r.a), set(r.b))
            assert r.j == (full if full >= threshold else 0.0)
            if full >= 0.8:
                assert abs(r.p - r.q) <= 1


@pytest.mark.parametrize("threshold", [0.3, 0.8, 1.0])
def test_near_pairs_equal_brute_force(spark, threshold):
    rng = random.Random(int(threshold * 10))
    rows = []
    for i in range(40):
        words = [rng.choice(["the", "of", "a", "cat", "dog", "sun", "sea", f"w{rng.randint(0, 60)}"]) for _ in range(rng.choice([3, 20, 21, 40, 90]))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(rng.choice([0, 1, 3])):  # near and exact copies
            copy = words[:]
            for _ in range(rng.choice([0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = f"n{rng.randint(0, 99)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, ""), (901, None), (902, "?"), (None, "the cat of a dog"), (903, rows[0][1]), (903, rows[0][1])]
    made = spotsigs.classes(spark.createDataFrame(rows, DOCS).repartition(4))
    member = {}
    for i, text in rows:
        if i is not None:
            member[frozenset(brute_signatures(text))] = min(i, member.get(frozenset(brute_signatures(text)), i))
    found = made.collect()
    assert len(found) == len(rows)
    text = dict(rows)
    assert all(r.class_id == member.get(frozenset(brute_signatures(text[r.doc_id]))) for r in found)
    wanted = {(min(a, b), max(a, b)): likeness(x, y) for (x, a), (y, b) in itertools.combinations(member.items(), 2) if x and y and likeness(x, y) >= threshold - 1e-12}
    pairs = spotsigs.near_pairs(made, threshold).collect()
    assert {(r.left_id, r.right_id): r.near for r in pairs} == wanted and len(pairs) == len(wanted)
    assert threshold == 1.0 or len(wanted) > 5


def test_near_pairs_of_nothing(spark):
    assert spotsigs.near_pairs(spotsigs.classes(spark.createDataFrame([], DOCS))).collect() == []
    with pytest.raises(ValueError):
        spotsigs.near_pairs(spotsigs.classes(spark.createDataFrame([], DOCS)), 0)
