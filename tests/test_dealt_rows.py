"""Queries whose floors and ranks hang on a mean's last digit equal their SQL, whatever the files' order of rows."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from seriata.plans.queries import ORACLES, QUERIES


def means_that_turn(n):
    """Lists of prices whose mean is whole in one order of adding and not in the other."""
    rng, out = random.Random(4), []
    while len(out) < n:
        cents = [rng.randrange(100_000, 50_000_000) for _ in range(9)]
        cents.append(-sum(cents) % 1000 + 1_000_000)
        prices = [c / 100 for c in cents]
        if sum_of(prices) // 10 != sum_of(prices[::-1]) // 10:
            out.append(prices)
    return out


def sum_of(values):
    total = 0.0
    for v in values:  # sum() compensates
        total += v
    return total


def stored(spark, tmp_path, name, rows, schema, key):
    """The rows in the order of the key for SQL, backwards in one file and dealt over five for Spark."""
    df = spark.createDataFrame(rows, schema)
    con = duckdb.connect()
    con.sql("set threads = 1")
    df.orderBy(key).coalesce(1).write.parquet(str(tmp_path / "sql" / name))
    con.sql(f"create view {name} as select * from read_parquet('{tmp_path}/sql/{name}/*.parquet')")
    df.orderBy(F.desc(key)).coalesce(1).write.parquet(str(tmp_path / "back" / f"{name}.parquet"))
    df.repartition(5, F.col(key) % 7).write.parquet(str(tmp_path / "dealt" / f"{name}.parquet"))
    return con, [str(tmp_path / "back"), str(tmp_path / "dealt")]


def equal(spark, con, folders, name):
    for folder in folders:
        df = QUERIES[name](spark, folder)
        listed = ", ".join(df.columns)
        got, want = sorted(map(tuple, df.collect()), key=str), sorted(con.sql(f"select {listed} from ({ORACLES[name]})").fetchall(), key=str)
        assert len(got) == len(want)
        for a, b in zip(got, want):
            assert list(a) == [pytest.approx(v, abs=2e-5) if isinstance(v, float) else v for v in b]


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    prices = [(c, p) for c, many in enumerate(means_that_turn(30)) for p in many]
    rows = [(i, c, p, "1-URGENT" if i % 2 else "2-HIGH") for i, (c, p) in enumerate(prices)]
    return stored(spark, tmp_path_factory.mktemp("orders"), "orders", rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string", "o_orderkey")


def test_cluster_means_of_dealt_orders(spark, orders):
    equal(spark, *orders, "cluster_means")


def test_signed_rank_of_dealt_orders(spark, orders):
    equal(spark, *orders, "signed_rank")


def test_difficulty_associations_of_dealt_events_at_the_edges_of_cells(spark, tmp_path):
    """Every sixth event is in the last half second of six hours, which the SQL counts to the next."""
    rng, start = random.Random(1), dt.datetime(2024, 1, 1)
    times = sorted(6 * 3600 * rng.randrange(1, 20) - rng.choice((0.2, 0.5, 0.7, 1.5)) if i % 6 == 0 else rng.uniform(0, 20 * 6 * 3600) for i in range(1500))
    rows = [(i, start + dt.timedelta(seconds=t), rng.randrange(40), rng.choice(("click", "view")), rng.randrange(20_000) / 100) for i, t in enumerate(times)]
    con, folders = stored(spark, tmp_path, "events", rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double", "event_id")
    equal(spark, con, folders, "difficulty_associations")
