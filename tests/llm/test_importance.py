import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkspan.llm import importance
from inkspan.llm.importance import feature_hashes, rank_rows, resample, upto_kth

DOCS = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, target, percent=25, min_words=20, buckets=10_000, seed=7):
    """(id, n_features, weight, score, rank) of every row, in no order."""
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    runs = lambda w: [*w, *(" ".join(p) for p in zip(w, w[1:]))]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    source, aim = Counter(), Counter()
    for _, text in docs:
        source.update(map(bucket, runs(split(text))))
    for (text,) in target:
        aim.update(map(bucket, runs(split(text))))
    s_all, t_all = sum(source.values()), sum(aim.values())
    rows = []
    for i, text in docs:
        words = split(text)
        at = [bucket(f) for f in runs(words)]
        gain = [math.floor(1000 * math.log((aim[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets)))) for b in at]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(at), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = Counter()
    for r in able[: len(able) * percent // 100]:
        drawn[r] += 1
    out, rank = [], 0
    for r in able:
        rank += 1
        out.append((*r[:4], rank if rank <= len(able) * percent // 100 else None))
    return out + [(*r[:4], None) for r in rows if r[4] < min_words]


def rows_of(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_rows_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["The", "Σtadt", "é", "a1", "x", "dog", "ÄB", "sun--moon", "\x7f", "\x00"]
    docs = [(rng.randint(-(2**62), 2**62), " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 19, 20, 21, 60])))) for _ in range(300)]
    docs += [(1, None), (2, ""), (3, "word " * 300_000), (4, "x" * 3_000_000 + " a b")]
    target = [("the dog",), (None,), ("",), ("Σtadt é sun",)]
    found = resample(spark.createDataFrame(docs, DOCS).repartition(6), spark.createDataFrame(target, "text string"))
    assert rows_of(found) == sorted(brute(docs, target), key=str)


def test_ties_repeated_rows_and_nulls(spark):
    text = "one two three " * 10
    docs = [(7, text)] * 40 + [(None, text)] * 5 + [(8, text), (9, "few words"), (6, text)]
    found = rows_of(resample(spark.createDataFrame(docs, DOCS), spark.createDataFrame([("one",)], "text string")))
    assert found == sorted(brute(docs, [("one",)]), key=str)
    assert sorted(r[4] for r in found if r[4]) == list(range(1, len(docs[:-2]) * 25 // 100 + 1))


def test_empty_tables_and_extra_columns(spark):
    none, target = spark.createDataFrame([], DOCS), spark.createDataFrame([], "text string")
    assert resample(none, target).collect() == []
    docs = [(i, "w%d " % i * 20) for i in range(20)]
    clash = spark.createDataFrame(docs, DOCS).withColumns({"rank": F.lit(3), "score": F.lit("x"), "by_id": F.lit(1)})
    found = resample(clash, target)
    assert found.columns == ["doc_id", "n_features", "n_words", "weight", "score", "rank"]
    assert rows_of(found) == sorted(brute(docs, []), key=str)


def test_blocks_keep_runs_across_them(monkeypatch):
    text = ("Aa bB, éé 12 " * 40).encode()
    whole = sorted(h for _, hs in feature_hashes(text) for h in hs.tolist())
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(importance, "BLOCK", size)
        assert sorted(h for _, hs in feature_hashes(text) for h in hs.tolist()) == whole


@pytest.mark.parametrize("seed", range(4))
def test_radix_selection_finds_the_kth_key(spark, seed):
    rng = random.Random(seed)
    spread = [3, 100, 2**40, 2**63 - 1][seed]
    rows = [(rng.randint(-spread, spread), rng.choice([0, -(2**63), 2**63 - 1, 5]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "a long, b long, c long").cache()
    for k in (0, 1, 2, 77, 199, 200):
        assert sorted(tuple(r) for r in df.filter(upto_kth(df, ["a", "b", "c"], k)).collect()) == sorted(rows)[:k]
    ranked = rank_rows(df, ["a", "b", "c"]).collect()
    assert [tuple(r)[:3] for r in sorted(ranked, key=lambda r: r["rank"])] == sorted(rows)
    assert sorted(r["rank"] for r in ranked) == list(range(1, 201))
