"""Every query that has SQL, against DuckDB on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from strandsift import queries as search
from strandsift.queries import _needles
from tests.models import edit_distance_ends

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(value):
    return None if value is None or value != value else value.item() if hasattr(value, "item") else value


@pytest.mark.parametrize("name", sorted(search.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{table}'")
    expected = con.sql(search.oracle_sql()[name])
    columns = expected.columns
    found = search.queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in found.collect())
    assert got == Counter(expected.fetchall())


def test_approximate_contamination(spark):
    found = {tuple(r) for r in search.contamination_approximate(spark, SF).select("doc_id", "needle_id", "end_pos", "distance").collect()}
    assert {(d, n) for d, n, _, _ in found} >= {(r.doc_id, r.needle_id) for r in search.contamination(spark, SF).collect()}
    needles = {r.needle_id: r.needle for r in _needles(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for doc, needle in sorted({x[:2] for x in found})[:3]:
        expected = {(doc, needle, e, d) for e, d in edit_distance_ends(texts[doc], needles[needle], 8)}
        assert {x for x in found if x[:2] == (doc, needle)} == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(search.queries()) <= set(entry.queries())
