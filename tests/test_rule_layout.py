from inkspan.plans import catalog
from inkspan.plans.views import Tables

SF = "/root/testdata/sf0.001"


def test_every_page_has_its_elements(spark):
    blocks = {(r.doc_id, r.page, r.pos) for r in Tables(spark, SF).blocks.select("doc_id", "page", "pos").collect()}
    found = [(r.doc_id, r.page, r.element) for r in catalog.queries()["rule_layout_pages"](spark, SF).collect()]
    assert set(found) == blocks and len(found) == len(blocks) and max(page for _, page, _ in found) > 1
