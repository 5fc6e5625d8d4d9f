"""Queries against their SQL at the smallest scale, as the driver does."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SOME = ["components_with_ranks", "csr_forward_offsets", "bfs_order", "scc_components_copart", "topological_order_copart", "wave_offsets", "snapshot_bytes_hex", "work_profile", "renamed_graph"]


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.sql(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, sf_dir).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[columns].astype(object).values.tolist()))
    assert rows(got) == rows(want)


def test_names_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
