"""The stateful stream of the error log against the batch fold, with late, repeated and expired events."""

import random
from datetime import datetime, timedelta

from inkspan.functions import geometry
from inkspan.functions.rules import repairs
from inkspan.operators import errors as batch
from inkspan.sources import versions
from inkspan.streaming import state
from pyspark.sql import functions as F

EVENTS = "id string, event_id long, ts timestamp, stage string, error_msg string, is_retry boolean"
T0 = datetime(2024, 1, 1)


def replay(spark, folder, files, keep_ms=10**15, delay="1000 days", per_batch=1):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/events")
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_batch).parquet(f"{folder}/events")
    state.into_store(state.error_records(events, keep_ms, delay), f"{folder}/store", f"{folder}/checkpoint").awaitTermination()
    return versions.read(spark, f"{folder}/store")


def test_any_order_ends_in_the_batch_fold(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("abcd"), i, T0 + timedelta(minutes=rng.randint(0, 50)), rng.choice(["x", "y"]), f"m{i}", rng.random() < 0.4) for i in range(60)]
    rng.shuffle(rows)
    changes = replay(spark, str(tmp_path), [rows[:20], rows[20:40] + rows[5:9], rows[40:] + rows[:3]])
    wanted = {tuple(r) for r in batch.fold_errors(spark.createDataFrame(rows, EVENTS)).collect()}
    assert {tuple(r) for r in state.newest(changes).collect()} == wanted
    assert changes.filter("expired").isEmpty() and changes.agg(F.max("seen")).first()[0] == max(sum(r[0] == k for r in rows) for k in "abcd")
    # a second run finds nothing new and writes nothing
    before = versions.history(spark, f"{tmp_path}/store").count()
    again = replay(spark, str(tmp_path), [])
    assert versions.history(spark, f"{tmp_path}/store").count() == before and again.count() == changes.count()


def test_records_expire_after_the_watermark(spark, tmp_path):
    hour = lambda h: T0 + timedelta(hours=h)
    files = [[("old", 1, hour(0), "s", "m", False)], [("new", 2, hour(100), "s", "m", False)], [("new", 3, hour(101), "s", "m", True)]]
    changes = replay(spark, str(tmp_path), files, keep_ms=3_600_000, delay="1 hour")
    rows = [(r.id, r.seen, r.expired) for r in changes.collect()]
    assert ("old", 1, True) in rows and ("new", 2, False) in rows
    assert {r.id for r in state.newest(changes).collect()} == {"old", "new"}


def test_fold_does_not_depend_on_order():
    rows = [(1, 10, "a", "m1", False), (2, 10, "b", "m2", False), (3, 5, "c", "m3", True), (4, 7, "d", "m4", True)]
    for seed in range(10):
        random.Random(seed).shuffle(rows)
        made = state.fold(None, rows[:2])
        assert state.fold(made, rows[2:]) == {"stage": "b", "error_msg": "m2", "timestamp": 10, "newest": 2, "retry_count": 2, "last_retry": 7, "seen": 4}


def test_font_sizes_equal_the_plain_search(spark):
    rng = random.Random(9)
    texts = ["", None, "\r\n", "x" * 3000, "汉字" * 40, "a\U00020000b" * 30] + ["".join(rng.choice("ab \t\n汉é\r.") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for width, height in ((200.0, 60.0), (50.0, 10.0), (1000.0, 500.0)):
        found = {r.i: r.s for r in rows.select("i", geometry.font_size(F.col("t"), width, height).alias("s")).collect()}
        assert found == {i: repairs.fit_font(t or "", width, height) for i, t in enumerate(texts)}


def test_placeholders_come_back_once_and_in_order():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.choice(["the", "a", "of", "x", "naïve", "漢", "1", ".", ","]) + rng.choice(["", str(rng.randint(0, 99))]) for _ in range(rng.randint(0, 30))]
        parts, keys = [], []
        for w in words:
            parts += [w, rng.choice([" ", " ", "\n", ""])]
            if rng.random() < 0.4:
                keys.append(f"<<<LATEX_CMD_{len(keys)}>>>")
                parts += [keys[-1], rng.choice([" ", ""])]
        whole = "".join(parts)
        lost = [k for k in keys if rng.random() < 0.5]
        text = whole
        for k in lost:
            text = text.replace(k, "")
        found, done = repairs.recover_in_order(text, whole, sorted(keys))
        assert found == whole and sorted(k for k, _ in done) == sorted(lost)


def test_placeholders_keep_their_order_in_changed_words():
    rng = random.Random(5)
    for _ in range(100):
        keys = [f"<<<LATEX_CMD_{i}>>>" for i in range(rng.randint(1, 6))]
        whole = " ".join(x for i, k in enumerate(keys) for x in (f"word{i}", k))
        text = " ".join(x for i, k in enumerate(keys) for x in (f"wort{i}", k) if x not in keys or rng.random() < 0.5)
        found, _ = repairs.recover_in_order(text, whole, keys)
        import re

        assert re.findall("<<<[^>]*>>>", found) == keys
    assert repairs.recover_in_order("a", "b", ["<<<K_1>>>"]) == ("a <<<K_1>>>", [("<<<K_1>>>", "append")])
    assert repairs.recover_in_order("", "<<<K_1>>> b", ["<<<K_1>>>"])[1] == [("<<<K_1>>>", "start")]


def test_font_sizes_at_the_bounds_that_need_no_fold(spark):
    """Texts that fill their lines exactly or lack one character of it, with wide characters and newlines, equal the plain search."""
    texts = [c * n + end for c in ("x", "\u6c49", " ", "x\n", "x\u6c49") for n in (0, 1, 2, 9, 10, 11, 66, 67, 133, 134, 400) for end in ("", "\n", "\u6c49")]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for width, height in ((200.0, 60.0), (6.0, 60.0), (3.0, 20.0)):
        found = {r.i: r.s for r in rows.select("i", geometry.font_size(F.col("t"), width, height).alias("s")).collect()}
        assert found == {i: repairs.fit_font(t, width, height) for i, t in enumerate(texts)}
