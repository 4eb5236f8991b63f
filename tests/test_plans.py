"""Physical plans: no products, no Python where columns do, no shuffle where a row is enough, pruned scans."""

import pytest

from inkspan.plans import catalog

SF = "/root/testdata/sf0.001"
ROW_WISE = [
    "document_predicates", "text_functions", "url_functions", "block_predicates", "block_types", "text_widths", "layout_functions", "date_functions", "content_identity", "line_range", "line_search",
    "log_classes",
]


def plan(spark, name):
    return catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in catalog.queries()])
def test_no_products_and_python_only_in_rules(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    if catalog.query_module(name) not in ("rules", "repairs") and name not in ("batch_packing", "batch_partition", "structure_spans"):
        assert "ArrowEvalPython" not in text and "MapInArrow" not in text


@pytest.mark.parametrize("name", ROW_WISE)
def test_row_wise_queries_shuffle_no_more_than_their_view(spark, name):
    text = plan(spark, name)
    assert text.count("Exchange") <= (1 if "string_agg" in text or "collect_list" in text else 0)


def test_profile_and_its_view_shuffle_nothing(spark):
    assert "Exchange" not in plan(spark, "document_structure_profile")


def test_scans_are_pruned(spark):
    assert "ReadSchema: struct<doc_id:bigint>" in plan(spark, "preferred_main_file")
    assert "n_chars" not in plan(spark, "text_functions") and "source:" not in plan(spark, "cache_lookup")
