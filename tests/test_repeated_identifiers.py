"""Tables as large ones have them: identifiers that papers share (five digits are not enough from 100,000 documents on), ids with retries only."""

import collections
import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from inkspan.plans import catalog

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Documents in falling order, in which ten papers each share one identifier with one to three others."""
    at = tmp_path_factory.mktemp("shared")
    ids = sorted([*range(10_000, 10_010), *range(100_000, 100_100), *range(2_305, 2_330)], reverse=True)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": [f"text {d % 90}" for d in ids]}), f"{at}/documents.parquet")
    events = [(n, START + datetime.timedelta(minutes=n), user, "error") for n, user in ((5, 1), (10, 1), (11, 2), (15, 2), (21, 3), (22, 3))]
    columns = dict(zip(("event_id", "ts", "user_id", "event_type"), map(list, zip(*events))))
    pq.write_table(pa.table(columns | {"ts": pa.array(columns["ts"], pa.timestamp("us"))}), f"{at}/events.parquet")
    return str(at)


def rows(found):
    columns = sorted(found.columns)
    return columns, collections.Counter(tuple(r[c] for c in columns) for r in found.collect())


def expected(folder, name):
    connection = duckdb.connect()
    for t in ("documents", "events"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    result = connection.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), collections.Counter(tuple(r[i] for i in at) for r in result.fetchall())


def test_report_row_of_an_id_with_retries_only(spark, folder):
    assert rows(catalog.queries()["error_report_rows"](spark, folder)) == expected(folder, "error_report_rows")


def test_text_report_of_an_id_with_retries_only(spark, folder):
    assert rows(catalog.queries()["error_text_report"](spark, folder)) == expected(folder, "error_text_report")


def test_harvest_keeps_the_first_of_papers_with_one_identifier(spark, folder):
    first = {}
    for d in sorted(pq.read_table(f"{folder}/documents.parquet")["doc_id"].to_pylist()):
        first.setdefault(f"{2301 + d % 12}.{str(d).rjust(5, '0')[:5]}", f"paper {d}")
    found = catalog.queries()["harvest_store"](spark, folder).collect()
    assert len(found) == len(first) and {r["arxiv_id"]: r["title"] for r in found} == first


def test_a_paper_is_pending_though_another_with_its_identifier_is_done(spark, folder):
    assert rows(catalog.queries()["pending_papers"](spark, folder)) == expected(folder, "pending_papers")


def test_every_paper_with_the_identifier_is_found(spark, folder):
    assert rows(catalog.queries()["registry_existing"](spark, folder)) == expected(folder, "registry_existing")


def test_delete_leaves_other_papers_with_the_identifier(spark, folder):
    assert rows(catalog.queries()["registry_status_and_delete"](spark, folder)) == expected(folder, "registry_status_and_delete")


def test_upsert_keeps_papers_with_one_identifier_apart(spark, folder):
    assert rows(catalog.queries()["registry_upsert"](spark, folder)) == expected(folder, "registry_upsert")
