import io
import json
import tarfile
import zipfile

from pyspark.sql import functions as F

from inkspan.sources import readers, writers


def test_registry_round_trip_skips_malformed(spark, tmp_path):
    for name, body in (("a", {"arxiv_id": "2301.00001", "status": "complete", "translated_at": "2024-01-01T00:00:00Z"}), ("b", {"arxiv_id": "x"})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata.json").write_text(json.dumps(body, indent=1))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "metadata.json").write_text("{oops")
    rows = {r.arxiv_id: r for r in readers.registry(spark, str(tmp_path)).collect()}
    assert set(rows) == {"2301.00001", "x"}
    assert rows["x"].title == "" and rows["x"].has_latex_source is False and rows["x"].translated_at is None


def test_error_log_keeps_newest(spark, tmp_path):
    path = tmp_path / "errors.json"
    path.write_text(json.dumps([{"id": "a", "timestamp": "2024-01-01T00:00:00Z", "stage": "x"}, {"id": "a", "timestamp": "2024-01-02T00:00:00Z", "stage": "y"}]))
    (row,) = readers.error_log(spark, str(path)).collect()
    assert (row.stage, row.retry_count, row.reported) == ("y", 0, False)


def test_cache_round_trip(spark, tmp_path):
    entries = spark.createDataFrame([("h1", "a", "A"), ("h2", "b", "")], "hash string, original string, translation string")
    writers.cache(entries, str(tmp_path / "cache"))
    assert {(r.hash, r.translation) for r in readers.translation_cache(spark, str(tmp_path / "cache")).collect()} == {("h1", "A"), ("h2", "")}


def test_id_list(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("# head\n 2301.00001 \n\n2301.00002\n")
    assert sorted(r.id for r in readers.id_list(spark, str(tmp_path / "ids.txt")).collect()) == ["2301.00001", "2301.00002"]
    writers.id_list(spark.createDataFrame([("a",)], "id string"), str(tmp_path / "out"))
    writers.id_list(spark.createDataFrame([("b",)], "id string"), str(tmp_path / "out"), append=True)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_feed_and_harvest(spark, tmp_path):
    feed = "<feed><title>q</title><entry><id>http://arxiv.org/abs/2301.00001v2</id><title>A\n  b</title><summary> s  t </summary></entry><entry><id>none</id><title>x</title></entry></feed>"
    (tmp_path / "feed.xml").write_text(feed)
    (row,) = readers.atom_feed(spark, str(tmp_path / "feed.xml")).collect()
    assert tuple(row) == ("2301.00001", "A b", "s t")
    writers.harvest(readers.atom_feed(spark, str(tmp_path / "feed.xml")), str(tmp_path / "h"))
    assert readers.harvest(spark, str(tmp_path / "h/entries")).count() == 1
    text = "<feed><title>q</title><entry><title> Real\n title</title><summary>S</summary><author><name>A</name></author><author><name>B</name></author></entry></feed>"
    (meta,) = readers.feed_metadata(spark.createDataFrame([(text,)], "x string"), "x").collect()
    assert (meta.title, meta.abstract, meta.authors) == ("Real title", "S", "A, B")


def test_repository_listing(spark):
    body = json.dumps([{"name": "2301.00001_cs_cn.pdf", "type": "file"}, {"name": "d", "type": "dir"}])
    rows = readers.repository_listing(spark.createDataFrame([(body,)], "j string"), "j").collect()
    assert [(r.name, r.type, r.download_url) for r in rows] == [("2301.00001_cs_cn.pdf", "file", ""), ("d", "dir", "")]


def test_archives_drop_unsafe_entries(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.bin", "w") as z:
        z.writestr("x/main.tex", "one")
        z.writestr("../evil.tex", "no")
    with tarfile.open(tmp_path / "b.bin", "w:gz") as t:
        data = b"two"
        info = tarfile.TarInfo("y.tex")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    (tmp_path / "c.bin").write_bytes(b"plain")
    rows = readers.archives(spark, str(tmp_path)).collect()
    assert sorted((r.path, bytes(r.content)) for r in rows) == [("x/main.tex", b"one"), ("y.tex", b"two")]


def test_tex_files_and_encodings(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.TEX").write_bytes("汉字 text".encode("gbk"))
    (tmp_path / "d" / "b.tex").write_bytes(b"\xef\xbb\xbfplain")
    (tmp_path / "c.txt").write_text("no")
    rows = {r.path.rsplit("/", 1)[1]: (r.encoding, r.text) for r in readers.documents(readers.tex_files(spark, str(tmp_path))).collect()}
    assert rows == {"a.TEX": ("GBK", "汉字 text"), "b.tex": ("UTF-8-BOM", "plain")}
    encoded = writers.encoded(spark.createDataFrame([("é",)], "t string"), "t", "UTF-16LE").select(F.hex("content")).first()[0]
    assert encoded == "E900"


def test_registry_writer(spark, tmp_path):
    writers.registry(spark.createDataFrame([("cs/0112017", "t")], "arxiv_id string, title string"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().arxiv_id == "cs/0112017"
