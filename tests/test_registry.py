"""The contract file, and a few queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.FLAGSHIP in entry.queries()


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "tier" in df.columns


@pytest.mark.parametrize("name", [
    "bar_expert_tiers", "chord_clusters", "match_notes", "harmony_changes", "note_features",
    "group_folds", "cluster_bootstrap", "edge_outside_notes", "phrase_arcs", "injected_mistakes",
])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == check.rows_of(
        cols, cur.fetchall())
