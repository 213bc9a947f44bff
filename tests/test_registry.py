"""Registered queries: all run, and those with SQL agree with DuckDB, on the smallest tables."""

import duckdb
import pytest

from lithic.plans import registry

SLOW = {"match_all_stages", "predict_full"}  # without SQL


def test_each_oracle_has_its_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - SLOW))
def test_query(spark, sf_dir, name):
    frame = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = [tuple(r) for r in frame.select(*columns).collect()]
    if name in registry.ORACLE:
        db = duckdb.connect()
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
            db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        expected = db.execute(f"select {', '.join(columns)} from ({registry.ORACLE[name]})").fetchall()
        close = lambda rows: sorted((tuple(round(x, 3) + 0.0 if isinstance(x, float) else x for x in r) for r in rows), key=repr)
        assert close(got) == close(expected)


@pytest.mark.parametrize("name", ["compare_deviation", "prediction_z", "extra_left"])
def test_sides_are_aggregated_once_and_without_broadcasts(spark, sf_dir, monkeypatch, name):
    plans = []

    def cut(frame):
        plans.append(frame._jdf.queryExecution().sparkPlan().toString())
        return kept(frame)

    kept = registry.cut
    monkeypatch.setattr(registry, "cut", cut)
    plans.append(registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString())
    assert sum("lineitem" in p for p in plans) == 2 and not any("BroadcastHashJoin" in p for p in plans if "lineitem" in p)
