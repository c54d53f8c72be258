"""Every query against its SQL in DuckDB, on whole tables."""

import duckdb
import pytest

import __spark_entry__
from verseloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if frame[c].dtype.kind in "fiu" or str(frame[c].dtype) in ("Int64", "Float64"):
            frame[c] = frame[c].astype(float)
    return sorted(map(repr, frame.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), duck.execute(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.copy()) == rows(want.copy())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_without_sql_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def same_on(spark, tmp_path, name, orders):
    """Whether a query gives its SQL's rows on these orders (o_orderkey, o_custkey, o_totalprice, o_orderpriority)."""
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got, want = plans.QUERIES[name](spark, str(tmp_path)).toPandas(), c.execute(plans.SQL[name]).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["candidate_matrix", "best_candidate"])
def test_equal_scores_tie_as_in_sql(spark, tmp_path, name):
    """Pairs whose scores are equal in the SQL's decimals; 0.8 as a binary fraction told them apart."""
    pairs = {45042: ((473343, "2-HIGH"), (495480, "1-URGENT")), 38753: ((312810, "4-NOT SPECIFIED"), (418734, "2-HIGH")), 106509: ((1165451, "5-LOW"), (1146371, "5-LOW"))}
    same_on(spark, tmp_path, name, [(key, video, 1.0, strategy) for video, pair in pairs.items() for key, strategy in pair])


def test_halves_round_to_even_as_in_sql(spark, tmp_path):
    """Prices whose sevenfold ends in a half, where rounding up shows in the text."""
    prices = (27055.5, 29381.5, 69551.5, 0.5, 1.5, 1001.93)
    same_on(spark, tmp_path, "display_formats", [(k, k, p, "x") for k, p in enumerate(prices)])
