"""Every registered query with SQL equals DuckDB on the smallest tables; pipelines and plugins."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from seriata.operators import diagnose, downstream
from seriata.plans import inputs, pipelines, registry
from seriata.plans.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{DIR}/{name}')")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = table(df.select(*cols).collect())
    listed = ", ".join(f'"{c}"' for c in cols)
    want = table(duck.sql(f"select {listed} from ({ORACLES[name]})").fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == pytest.approx(y, rel=1e-9, abs=2e-4) if isinstance(y, float) else x == y, (a, b)


def table(rows):
    """Rows in an order that the last digit of a rounded number cannot change."""
    clean = [tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v if v is None else str(v) for v in r) for r in rows]
    return sorted(clean, key=lambda r: [str(v) for v in r if v is not None and not isinstance(v, float)] + [f"{v:.2f}" if isinstance(v, float) else "none" for v in r])


@needs_data
@pytest.mark.parametrize("name", ["arm_selection"])
def test_other_queries_return_rows(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_plugins(spark):
    assert registry.available("loss") == ["fredf", "fredf_sqrth"] and registry.kind_of("revin") == "transform"
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0)], "k string, pos long, value double")
    assert registry.wrap(df, "none") is df
    assert {round(r.normalised, 3) for r in registry.wrap(df, "revin", key=["k"]).collect()} == {-1.0, 1.0}
    with pytest.raises(TypeError):
        registry.wrap(df, "revin", key=["k"], period_len=24)
    with pytest.raises(KeyError):
        registry.kind_of("absent")


def test_certification_counts(spark):
    seq = spark.createDataFrame([("index_order", 5.0, 0.5), ("index_order", 1.0, 0.1), ("full_permutation", 0.0, 0.0), ("full_permutation", None, None)], "variant string, z double, r double")
    row = pipelines.certification(seq, (0.05,)).first()
    assert (row.n_clean, row.n_corrupted, row.clean_certified_pct, row.corrupted_certified_pct) == (2, 2, 50.0, 0.0)
    assert pipelines.margin(seq).where("variant = 'index_order'").first().median_z == 3.0


def test_draws_and_clusters(spark):
    draws = spark.createDataFrame([(f"b{b}", d, c, 0.01 * b + (0.001 * d if c == "defect" else 0.0)) for b in range(6) for d in range(3) for c in ("defect", "control")], "block string, draw int, condition string, rho double")
    row = pipelines.draws_summary(pipelines.equivalence_draws(draws, "block", 0.05)).first()
    assert row.certify_fraction == 1.0 and row.p_of_means < 0.05
    cells = spark.createDataFrame([(f"d{i % 4}", float(i), 2.0) for i in range(40)], "dataset string, a double, b double")
    got = {r.statistic: r for r in pipelines.cluster_summary(cells, ["dataset"], ("a", "b"), 20).collect()}
    assert got["b"].ci_lo == got["b"].ci_hi == 2.0 and got["a"].n_clusters == 4


def test_audit_rules_and_runs(spark):
    cells = spark.createDataFrame([("c", 4000, 96, 720)], "cell string, n long, seq_len int, pred_len int")
    got = {r.purge_mode: r.boundary_ok for r in pipelines.purge_audit(cells).collect()}
    assert got == {"labels": 1, "disjoint": 1, "legacy": 0}
    runs = spark.createDataFrame([("x", "det", 2.0, 1.0, 3), ("x", "shuf", 2.1, 1.0, 3), ("y", "det", 1.0, 1.0, 3)], "k string, val_order string, mse double, val_mse double, best_epoch int")
    row = pipelines.rng_tax(runs, ["k"]).collect()
    assert len(row) == 1 and row[0].abs_rel_diff_pct == pytest.approx(5.0) and row[0].same_best_epoch == 1


def test_numbers_and_tables(spark):
    runs = spark.createDataFrame([("D", "a", 0.5, 3600.0, 4), ("E", "b", 0.7, 7200.0, 6)], "dataset string, backbone string, mse double, train_seconds double, epochs_run int").selectExpr("*", "'none' as plugin", "'det' as val_order", "96 as pred_len", "1 as seed", "10 as n_val_windows", "20 as n_test_windows", "false as truncated")
    numbers = {r.name: r.value for r in pipelines.run_numbers(runs).collect()}
    assert numbers["runs"] == 2 and numbers["hours"] == 3 and numbers["epochs"] == 10 and numbers["runs_dataset_D"] == 1 and numbers["hours_val_order_det"] == 3
    assert {r.backbone: r.runs for r in pipelines.grid_table(runs).collect()} == {"a": 1, "b": 1, "all": 2}
    assert runs.agg(pipelines.rate_of(F.col("mse") > 0.6).alias("x")).first().x == 50.0


def test_tail_draws_are_split_and_summed(spark, monkeypatch):
    rows = [(k, i, float((i * i * 7919) % 101)) for k in ("a", "b") for i in range(40)] + [("flat", i, 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, pos long, value double")
    got = diagnose.tail_calibration(df, ["k"], 20_500, (0.05, 0.01), seed=3, part=4_000).collect()
    assert sorted((r.k, r.alpha) for r in got) == [("a", 0.01), ("a", 0.05), ("b", 0.01), ("b", 0.05)]
    assert all(r.n_perm == 20_500 and r.n == 40 and r.fpr_empirical == r.n_reject / 20_500 and 0.5 < r.ratio_to_nominal < 2 for r in got)
    assert diagnose.tail_calibration(df, ["k"], 20_500, (0.05,), seed=3, part=4_000).agg(F.sum("n_reject")).first()[0] == sum(r.n_reject for r in got if r.alpha == 0.05)
    assert next(iter(diagnose.tail_calibration(df.where("k = 'a'"), ["k"], 7, (0.5,), part=4).collect())).n_perm == 7
    asked = []
    monkeypatch.setattr(diagnose, "tail_calibration", lambda df, key, draws, **more: asked.append(draws))
    monkeypatch.setattr(inputs, "arms", lambda spark, sf_dir: None)
    QUERIES["aot_tail"](spark, DIR)
    assert asked == [1_000_000]


def test_difficulty_regression_boosts_200_rounds(spark, monkeypatch):
    asked = []

    class Fitted(Exception):
        pass

    def fit(seed, iterations):
        asked.append(iterations)
        raise Fitted

    monkeypatch.setattr(downstream, "regressor", fit)
    with pytest.raises(Fitted):
        QUERIES["difficulty_regression"](spark, DIR)
    assert asked == [200]
