"""Registered queries against their SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from sylva.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
SOME = ["agg_sum_float", "agg_sum_text", "agg_inner_context", "agg_filtered_context", "agg_two_contexts", "path_parent", "pred_chain", "pred_position_then_attr", "path_relative", "sort_two_elements", "sort_typed_key", "tail_n", "head_whole_document", "delete_subtree", "flatten_recursive", "cat_union", "xml_roundtrip", "shred_udtf", "agg_based_int", "path_file", "sort_first_path_wins", "sort_whole_document", "head_path_by_path", "delete_values", "flatten_values", "store_roundtrip", "read_files", "agg_report_tags", "shred_lenient", "html_pages_stat"]


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, DATA)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda r: tuple((x is None, str(x)) for x in r)
    rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=key)
    assert rows == sorted(want.select(*columns).fetchall(), key=key)
