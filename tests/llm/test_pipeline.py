import ast
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from inkspan.llm import queries
from inkspan.llm.decontaminate import find_contamination
from inkspan.llm.queries import language_models
from tests.llm.test_dedup import brute_exact
from tests.llm.test_similar import brute_components

ROOT = Path(__file__).parents[2]


def test_stages_take_effect_on_their_own_input(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        seen[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = seen[name][1]
        if name != "packing":
            assert docs.columns == columns
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}

    before, after = seen["language_id"]
    models = language_models(before)
    assert ids(after) == {r.doc_id for r in before.collect() if models.predict(r.text)[3]}
    before, after = seen["exact_dedup"]
    assert ids(after) == {min(g) for g in brute_exact([(r.doc_id, r.text) for r in before.collect()]).values()}
    before, after = seen["near_dedup"]
    components = brute_components([(r.doc_id, r.text) for r in before.collect()])  # five words, similarity 0.8
    assert ids(after) == set(components.values()) and len(ids(after)) < len(ids(before))
    before, after = seen["decontamination"]
    found = find_contamination(before, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert ids(after) == ids(before) - {r.doc_id for r in found.collect()}
    before, after = seen["packing"]
    assert ids(after) == ids(before)


def test_run_is_the_stages_in_order(spark):
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_every_operator_has_a_query():
    assert {int(k[2:].split("_")[0]) for k in queries.QUERIES} == set(range(1, 14))


def test_nothing_else_imports_the_subpackage():
    for path in [*ROOT.glob("inkspan/**/*.py"), ROOT / "bench.py"]:
        if path.exists() and "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(n.startswith("inkspan.llm") for n in names), path


def test_stages_on_hostile_rows(spark):
    """Nulls, empty and long texts, repeated rows and an extra column: each stage keeps the columns and does not fail."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    base = docs.columns
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (900001, "", "en", "s", 0), (900002, None, "en", "s", 0), (900003, "word " * 50_000, "en", "s", 1), (900003, "word " * 50_000, "en", "s", 1), (900004, "7 % 7", None, None, None)],
        docs.select("doc_id", "text", "lang", "source", "n_chars").schema,
    )
    mixed = docs.unionByName(odd.select(*base)).withColumn("score", F.lit("mine")).withColumn("component", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        rows = mixed if name != "packing" else mixed.limit(40)
        found = stage(spark, rows, sf)
        if name != "packing":
            assert found.columns == mixed.columns
        assert found.count() > 0, name
        assert stage(spark, mixed.limit(0), sf).count() == 0, name


def test_language_id_without_a_language_is_an_error(spark):
    rows = spark.createDataFrame([(1, "some text", None, "s", 9), (2, "more", None, "s", 4)], "doc_id long, text string, lang string, source string, n_chars long")
    with pytest.raises(ValueError, match="language"):
        corpus_pipeline.language_id(spark, rows, "")


def test_near_dedup_keeps_rows_without_words_or_ids(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (5, " "), (6, "x"), (6, "x")]
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert sorted(kept, key=lambda i: (i is not None, i)) == [None, 1, 3, 4, 5, 6, 6]
