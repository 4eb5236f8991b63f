"""Archives, stores with bad records, and writes that count once."""

import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from inkspan.sources import archives, stores, versions

FILES = "path string, content binary"


@pytest.mark.parametrize("kind", ["zip", "tar.gz"])
def test_archives_come_back_whole(spark, tmp_path, kind):
    rows = [(f"d/{i}.tex", bytes([i % 256]) * (i * 37)) for i in range(60)] + [("empty", b""), ("none", None), ("é/漢字.tex", b"x")]
    archives.write(spark.createDataFrame(rows, FILES).repartition(4), str(tmp_path / "a"), kind)
    found = archives.read(spark, str(tmp_path / "a")).collect()
    assert {(r.path, bytes(r.content)) for r in found} == {(p, c or b"") for p, c in rows} and len(found) == len(rows)
    assert all(r.error is None for r in found) and not [p for p in (tmp_path / "a").iterdir() if p.name.startswith("_")]
    archives.write(spark.createDataFrame([("n", b"new")], FILES), str(tmp_path / "a"), kind, overwrite=True)
    assert [(r.path, bytes(r.content)) for r in archives.read(spark, str(tmp_path / "a")).collect()] == [("n", b"new")]


def test_broken_archives_and_entries_are_error_rows(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "ok.bin", "w") as z:
        z.writestr("x.tex", "one" * 100)
        z.writestr("../evil", "no")
    whole = io.BytesIO()
    with tarfile.open(fileobj=whole, mode="w:gz") as t:
        for name in ("a", "b"):
            info = tarfile.TarInfo(name)
            info.size = 100_000
            t.addfile(info, io.BytesIO(__import__("random").Random(name).randbytes(100_000)))
    (tmp_path / "half.tgz").write_bytes(whole.getvalue()[:150_000])
    (tmp_path / "junk.zip").write_bytes(b"PK\x03\x04 and no more")
    body = (tmp_path / "ok.bin").read_bytes()
    (tmp_path / "crc.zip").write_bytes(body.replace(b"one" * 100, b"two" * 100, 1))
    (tmp_path / "plain.txt").write_text("no archive")
    (tmp_path / "_hidden.zip").write_bytes(body)
    found = archives.read(spark, str(tmp_path)).collect()
    by = {}
    for r in found:
        by.setdefault(r.archive.rsplit("/", 1)[1], []).append((r.path, r.error is not None))
    assert by["ok.bin"] == [("x.tex", False)]
    assert by["half.tgz"] == [("a", False), (None, True)]
    assert by["junk.zip"] == [(None, True)] and ("x.tex", True) in by["crc.zip"]
    assert set(by) == {"ok.bin", "half.tgz", "junk.zip", "crc.zip"}


def test_one_task_per_large_archive(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.zip").write_bytes(b"PK\x03\x04" + b"x" * 1000)
    spark.dataSource.register(archives.ArchiveSource)
    one = spark.read.format("archives").option("taskBytes", 1000).load(str(tmp_path))
    assert one.rdd.getNumPartitions() == 5 and archives.read(spark, str(tmp_path)).rdd.getNumPartitions() == 1


def test_a_failed_write_of_archives_leaves_nothing(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").cast("string").alias("path"), F.when(F.col("id") == 33, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.lit(b"x")).alias("content"))
    with pytest.raises(Exception, match="lost"):
        archives.write(rows.repartition(4), str(tmp_path / "a"))
    assert not (tmp_path / "a").exists() or not list((tmp_path / "a").iterdir())


def test_bad_json_records(spark, tmp_path):
    good = '{"id":"a","stage":"s","timestamp":"2024-01-02T00:00:00Z","extra":[1]}'
    lines = [good, good.replace("02", "01").replace('"s"', '"old"'), '{"id":"b"}', "", "  ", '{"id":', "[1, 2", '{"id":"c","retry_count":"many"}', '{"id":"d","reported":3}', "null word"]
    (tmp_path / "log").write_text("\n".join(lines))
    rows, bad = stores.error_log(spark, str(tmp_path / "log"))
    assert {(r.id, r.stage, r.retry_count) for r in rows.collect()} == {("a", "s", 0), ("b", "", 0)}
    assert sorted(r.raw for r in bad.collect()) == sorted(lines[5:])
    assert all(r.error for r in bad.collect())
    (tmp_path / "empty").write_text("")
    rows, bad = stores.error_log(spark, str(tmp_path / "empty"))
    assert rows.collect() == bad.collect() == []


def test_bad_papers_and_listings(spark, tmp_path):
    for name, body in (("a", '{\n "arxiv_id": "2301.00001"\n}'), ("b", "{oops"), ("c", '{"arxiv_id": 7, "has_latex_source": "x"}')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata.json").write_text(body)
    rows, bad = stores.registry(spark, str(tmp_path))
    assert [r.arxiv_id for r in rows.collect()] == ["2301.00001"] and bad.count() == 2
    held = spark.createDataFrame([('[{"name":"x","size":3},{"name":"y","size":"big"}]',), ("nope",), (None,)], "j string")
    rows, bad = stores.listing(held, "j")
    assert [(r.name, r.size) for r in rows.collect()] == [("x", 3)] and sorted(r.raw for r in bad.collect()) == ["nope", '{"name":"y","size":"big"}']


def test_bad_feed_entries(spark, tmp_path):
    entry = "<entry><id>http://arxiv.org/abs/2301.0000{}v2</id><title>T\n {}</title><summary>s</summary></entry>"
    broken = "<entry><id>http://arxiv.org/abs/2301.00009v1</id><title>open"
    (tmp_path / "f.xml").write_text("<feed><title>q</title>" + entry.format(1, "a") + broken + entry.format(2, "b") + "<entry><id>none</id></entry></feed>")
    rows, bad = stores.atom_feed(spark, str(tmp_path / "f.xml"))
    assert sorted(tuple(r) for r in rows.collect()) == [("2301.00001", "T a", "s"), ("2301.00002", "T b", "s")]
    assert sorted(tuple(r) for r in bad.collect()) == [("<entry><id>http://arxiv.org/abs/2301.00009v1</id><title>open", "no xml record of the store's schema"), ("<entry><id>none</id></entry>", "no identifier")]


def test_versions_count_once_and_survive_a_failed_task(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(ValueError):
        versions.read(spark, path)
    ids = lambda version=None: sorted(r.id for r in versions.read(spark, path, version).collect())
    assert versions.commit(spark.range(3), path, "a") == 1
    assert versions.commit(spark.range(10, 12), path, "b") == 2 == versions.commit(spark.range(10, 12), path, "b")
    assert ids() == [0, 1, 2, 10, 11]
    failing = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("id"))
    for append in (True, False):
        with pytest.raises(Exception, match="lost"):
            versions.commit(failing, path, "c", append)
        assert ids() == [0, 1, 2, 10, 11]
    assert versions.commit(spark.range(5, 6), path, "c", append=False) == 3 and ids() == [5] and ids(2) == [0, 1, 2, 10, 11]
    assert [r.batch for r in versions.history(spark, path).orderBy("version").collect()] == ["a", "b", "c"]
    rows = versions.read(spark, path)  # a store may be written from itself
    assert versions.commit(rows, path, "d") == 4 and ids() == [5, 5]


def test_stores_of_either_layout(spark, tmp_path):
    import json

    from inkspan.sources import readers, writers

    rows = [(f"h{i}", "o", f"t{i}") for i in range(50)]
    writers.cache(spark.createDataFrame(rows, "hash string, original string, translation string").coalesce(1), str(tmp_path / "lines"))
    assert readers.translation_cache(spark, str(tmp_path / "lines")).count() == 50
    document = {"version": "1.0", "entries": [{"hash": h, "original": o, "translation": t} for h, o, t in rows]}
    for name, indent in (("pretty", 2), ("compact", None)):
        (tmp_path / name).write_text("\n" + json.dumps(document, indent=indent))
        assert readers.translation_cache(spark, str(tmp_path / name)).count() == 50
    log = [{"id": str(i), "timestamp": "2024-01-01T00:00:00Z"} for i in range(20)]
    for name, body in (("array", json.dumps(log)), ("pretty_array", json.dumps(log, indent=1)), ("log_lines", "\n".join(map(json.dumps, log)))):
        (tmp_path / name).write_text(body)
        assert readers.error_log(spark, str(tmp_path / name)).count() == 20
    (tmp_path / "nothing").write_text("")
    assert readers.error_log(spark, str(tmp_path / "nothing")).count() == 0
