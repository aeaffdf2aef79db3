"""Operators that SQL can express, on the odd table and on given documents; all on an empty one."""

import duckdb
import pytest

import corpus_pipeline

from tensorloom.llm import quality
from tensorloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", [n for n in ORACLES if n != "op13_conversations"])
def test_odd_rows(spark, folder, duck, name):
    got, want = QUERIES[name](spark, folder).toArrow(), duck.sql(ORACLES[name]).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    key = lambda t: sorted(repr(tuple(r[c] for c in columns)) for r in t.to_pylist())
    assert key(got) == key(want)


@pytest.mark.parametrize("name", [n for n in ORACLES if n != "op13_conversations"])
def test_given_documents(spark, name):
    sf = "/root/testdata/sf0.001"
    got = QUERIES[name](spark, sf).toArrow()
    want = duckdb.sql(ORACLES[name].replace("FROM documents", f"FROM '{sf}/documents.parquet'")).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    key = lambda t: sorted(repr(sorted(r.items())) for r in t.to_pylist())
    assert key(got) == key(want)


def test_more_words_than_positions_fit(spark, folder, duck, monkeypatch):
    monkeypatch.setattr(quality, "PACKED", 64)
    test_odd_rows(spark, folder, duck, "op3_quality")


@pytest.mark.parametrize("name", [*[n for n in QUERIES if n != "op13_conversations"], "pipeline"])  # that one reads another table
def test_empty_table(spark, empty, name):
    query = corpus_pipeline.run if name == "pipeline" else QUERIES[name]
    assert query(spark, empty).count() == 0
