"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ("content_digest", "symbol_diff", "change_status", "module_index", "import_resolution", "c_family_resolution", "innermost_interval",
          "sibling_lookup", "graph_edge_diff", "impact_rings", "reaches_merge", "concerns", "intent_verdict", "layout_coords", "parse_status", "stored_concerns")


def _shown(value):
    if pd.isna(value):
        return "NULL"
    if isinstance(value, float):
        return str(int(value)) if value == int(value) else f"{value:.6f}"
    return str(value)


def _rows(frame):
    return sorted(tuple(_shown(value) for value in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, name):
    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        connection.execute(f"create view {file.removesuffix('.parquet')} as select * from '{FOLDER}/{file}'")
    got = entry_points.queries()[name](spark, FOLDER).toPandas()
    want = connection.execute(entry_points.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_entry_runs(spark):
    assert entry_points.entry(spark).count() > 0


def test_listed_names_are_not_broadcast(spark, tmp_path):
    """Ten names a part are far more than the column of keys that their size is guessed from."""
    rows = [(i, i % 50 + 1) for i in range(200)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    found = entry_points.queries()["symbol_fingerprints"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [" in line and "p_partkey" in line]
    assert joins and not any("Broadcast" in line for line in joins), plan
