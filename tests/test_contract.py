"""Provenance contract: digests, validation, the fault matrix, joins, sources and streaming."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriata import schema as S
from seriata.operators import contract, downstream, joins, reports
from seriata.sources import files
from seriata.streaming import recorder

NAMES = ("val_index_order", "val_loader_order", "val_perm")


@pytest.fixture(scope="module")
def cell(spark):
    values = files.fixture_cell(spark).cache()
    index = values.where("product = 'val_index_order'")
    side = contract.build_sidecars(index, files.fixture_identity(spark), S.ORDER_INDEX, commit="c").cache()
    return index, side, values


def violation(values, sidecars, **kw):
    return contract.validate(values, sidecars, **kw).first()


def test_digest_framing_equals_hashlib(spark, cell):
    index, side, _ = cell
    ids = [r.sample_id for r in index.orderBy("pos").collect()]
    h = hashlib.sha256(S.ID_DIGEST_DOMAIN.encode() + f"count={len(ids)}\n".encode())
    for s in ids:
        h.update(f"{len(s.encode())}:".encode() + s.encode() + b"\n")
    row = side.first()
    assert row.ordered_sample_id_digest == "sha256:" + h.hexdigest()
    assert ids[3] == "window_origin/v1|ETTh1|val|L96|H336|w3"
    v = np.array([r.value for r in index.orderBy("pos").collect()])
    assert row.value_digest == contract.value_digest_of(v)


def test_value_digest_rules():
    a = np.array([0.0, 1.5, np.nan])
    assert contract.value_digest_of(a) == contract.value_digest_of(a.astype(">f8")) == contract.value_digest_of(np.array([-0.0, 1.5, np.nan]))
    assert contract.value_digest_of(np.array([1, 2])) == contract.value_digest_of(np.array([1, 2], np.int32)) != contract.value_digest_of(np.array([1.0, 2.0]))
    with pytest.raises(TypeError):
        contract.value_digest_of(np.array(["a"]))


def test_intact_product_passes(cell):
    index, side, _ = cell
    row = violation(index, side)
    assert row.violation is None and not row.legacy and not row.incomplete
    contract.enforce(contract.validate(index, side))


def test_fault_matrix(spark):
    from seriata.plans.coverage import contract_coverage

    rows = {r.fault: r for r in contract_coverage(spark).collect()}
    assert len(rows) == 25
    assert sum(r.detected for r in rows.values()) == 20
    want = {"single_element_edited": "DigestMismatch", "array_truncated_by_one_sample": "IdentityMismatch", "val_product_consumed_as_test": "IdentityMismatch", "loader_order_relabelled_as_index_order": "IdentityMismatch", "legacy_sidecar_without_schema_version": "SchemaVersion", "required_field_removed_from_sidecar": "MissingField", "order_semantics_outside_the_enumeration": "OrderSemantics", "sidecar_file_deleted": "MissingField", "duplicate_sample_ids_in_one_product": "IdentityMismatch"}
    for k, v in want.items():
        assert rows[k].exception == v, rows[k]


def test_legacy_reads(spark, cell):
    index, side, _ = cell
    old = side.withColumn("schema_version", F.lit(None).cast("string")).withColumn("order", F.lit("index")).withColumn("n_windows", F.lit(64).cast("bigint"))
    assert violation(index, old).error == "SchemaVersion"
    assert violation(index, old, legacy_ok=True).violation is None
    assert violation(index, old.withColumn("order", F.lit("loader")), legacy_ok=True).error == "OrderSemantics"
    assert violation(index, old.withColumn("n_windows", F.lit(63).cast("bigint")), legacy_ok=True).error == "IdentityMismatch"


def test_expectations(cell):
    index, side, _ = cell
    assert violation(index, side, expect={"dataset": "ETTh1", "seed": 2021, "plugin": None}).violation is None
    assert violation(index, side, expect={"pred_len": 96}).violation == "pred_len"


def test_sibling_ids_and_backfill(spark, cell):
    _, side, values = cell
    loader = values.where("product = 'val_loader_order'")
    sc = contract.build_sidecars(loader, files.fixture_identity(spark, products=["val_loader_order"]), S.ORDER_LOADER)
    sib = sc.withColumn("sample_id_spec", F.expr("named_struct('kind', 'sibling_array', 'start', cast(null as bigint), 'name', 'val_perm', 'window_origins', cast(null as array<bigint>), 'sample_ids', cast(null as array<string>))"))
    ids = {r.pos: r.sample_id for r in contract.resolve_sample_ids(sib, values).collect()}
    assert ids == {r.pos: r.sample_id for r in loader.collect()}
    assert violation(loader, sib, siblings=values, require_order="loader").violation is None
    legacy = spark.createDataFrame([("cell", "val_index_order", None, "index", 64), ("cell", "val_loader_order", None, "loader", 64), ("cell", "val_perm", None, "odd", 64), ("other", "val_index_order", None, "index", 3)], "cell_id string, product string, schema_version string, order string, n_windows long")
    plan = {(r.cell_id, r["product"]): r.status for r in contract.backfill_plan(legacy, values).collect()}
    assert plan == {("cell", "val_index_order"): "ok", ("cell", "val_loader_order"): "ok", ("cell", "val_perm"): "error", ("other", "val_index_order"): "error"}


def test_backfilled_sidecars_validate(spark, cell):
    _, _, values = cell
    names = ["val_index_order", "val_loader_order"]
    legacy = spark.createDataFrame([("cell", "val_index_order", "index"), ("cell", "val_loader_order", "loader")], "cell_id string, product string, order string")
    legacy = legacy.select("*", F.lit(None).cast("string").alias("schema_version"), F.lit(64).cast("bigint").alias("n_windows"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("string").alias("val_order"))
    made = contract.backfill(legacy, values, files.fixture_identity(spark, products=names)).cache()
    assert {r["product"]: r.sample_id_spec.kind for r in made.collect()} == {"val_index_order": "identity_range", "val_loader_order": "sibling_array"}
    for name, order_ in zip(names, ("index", "loader")):
        own = made.where(F.col("product") == name)
        assert violation(values.where(F.col("product") == name), own, siblings=values, require_order=order_).violation is None
    assert contract.loader_consistency(values).first().worst <= 0
    broken = values.withColumn("value", F.when((F.col("product") == "val_loader_order") & (F.col("pos") == 3), 99.0).otherwise(F.col("value")))
    assert contract.loader_consistency(broken).first().worst > 0
    assert made.first().backfilled and made.first().producer_commit == "unknown"


def test_join_by_sample_id(spark):
    mk = lambda a, b: spark.createDataFrame([(f"w{i}", i, float(i)) for i in range(a, b)], "sample_id string, pos long, value double")
    out = joins.join_by_sample_id({"a": mk(0, 10), "b": mk(3, 13).orderBy(F.rand(1))})
    assert out.count() == 7 and out.where("a != b").count() == 0
    with pytest.raises(contract.IdentityMismatch):
        joins.join_by_sample_id({"a": mk(0, 3), "b": mk(5, 8)})
    with pytest.raises(contract.IdentityMismatch):
        joins.join_by_sample_id({"a": mk(0, 3).union(mk(0, 1)), "b": mk(0, 3)})
    with pytest.raises(contract.MissingField):
        joins.join_by_sample_id({"a": mk(0, 3).drop("sample_id")})
    with pytest.raises(contract.MissingField):
        joins.join_by_sample_id({})


def test_positional_guard(spark, cell):
    _, side, _ = cell
    joins.assert_positional_join(side)
    joins.assert_positional_join(side.unionByName(side))
    with pytest.raises(contract.IdentityMismatch):
        joins.assert_positional_join(side.unionByName(side.withColumn("ordered_sample_id_digest", F.lit("x"))))
    with pytest.raises(contract.IdentityMismatch):
        joins.assert_positional_join(side.unionByName(side.withColumn("pred_len", F.lit(96))))
    with pytest.raises(contract.SchemaVersion):
        joins.assert_positional_join(side.unionByName(side.withColumn("schema_version", F.lit(None).cast("string"))))
    row = joins.positional_join_check(side.unionByName(side.withColumn("n_samples", F.lit(60).cast("bigint")).withColumn("ordered_sample_id_digest", F.lit("x"))), (), 60).first()
    assert row.truncated and row.violation is None


def test_series_round_trip(spark, cell, tmp_path):
    index, side, values = cell
    root = str(tmp_path / "bank")
    files.write_series(index, side, root)
    got = files.load_series(spark, root, "cell", "val_index_order", expect_n=64).orderBy("pos").collect()
    assert [r.value for r in got] == [r.value for r in index.orderBy("pos").collect()]
    with pytest.raises(contract.IdentityMismatch):
        files.load_series(spark, root, "cell", "val_index_order", expect_n=63)
    with pytest.raises(contract.MissingField):
        files.load_series(spark, root, "cell", "absent")


def test_small_sources(spark, tmp_path):
    (tmp_path / "cells").mkdir()
    for i in (2, 1):
        files.write_json(str(tmp_path / "cells" / f"{i}.json"), {"dataset": "D", "backbone": "B", "pred_len": 96, "cell_id": f"c{i}", "mse": 0.5, "truncated": False})
    runs = files.read_runs(spark, str(tmp_path / "cells"))
    assert [r.cell_id for r in runs.collect()] == ["c1", "c2"] and runs.first().block_id == "D_h96_B"
    data = tmp_path / "data"
    data.mkdir()
    (data / "a.csv").write_bytes(b"x,y\n1,2\n")
    manifest = spark.createDataFrame([("a.csv", hashlib.sha256(b"x,y\n1,2\n").hexdigest()), ("b.csv", "0")], "name string, sha256 string")
    assert {r.name: r.ok for r in files.manifest_check(spark, str(data), manifest).collect()} == {"a.csv": True, "b.csv": False}
    assert files.read_csv(spark, str(data / "a.csv")).first().y == 2
    (tmp_path / "npy").mkdir()
    np.save(tmp_path / "npy" / "val.npy", np.array([3.0, 1.0]))
    assert [(r["product"], r.pos, r.value) for r in files.read_npy(spark, str(tmp_path / "npy")).collect()] == [("val", 0, 3.0), ("val", 1, 1.0)]
    (tmp_path / "g.yaml").write_text("datasets: [a, b]\n")
    assert files.read_grid(str(tmp_path / "g.yaml")) == {"datasets": ["a", "b"]}
    assert files.horizons([96, 192, 336, 720], "all") == [96, 192, 336, 720] and files.horizons([96, 192, 336, 720], ["first", "fourth", 5]) == [96, 720, 5]
    built = []
    for _ in range(2):
        files.feature_cache(spark, str(tmp_path / "cache"), {"dataset": "d", "pred_len": 96}, lambda: built.append(1) or spark.range(3)).count()
    assert built == [1]
    files.append_log(spark.range(2), str(tmp_path / "log"))
    files.append_log(spark.range(1), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 3
    side = tmp_path / "s" / "cell9"
    side.mkdir(parents=True)
    (side / "val_index_order.provenance.json").write_text(json.dumps({"split": "val", "n_samples": 4}))
    row = files.read_json_sidecars(spark, str(tmp_path / "s" / "*")).first()
    assert (row.cell_id, row["product"], row.n_samples, row.schema_version) == ("cell9", "val_index_order", 4, None)


def batches(spark, n=64, horizon=8, channels=3):
    rng = np.random.default_rng(0)
    perm = rng.permutation(n)
    rows = []
    for p, o in enumerate(perm):
        rows += [(p // 7, p % 7, int(o), s, c, float(rng.normal()), float(rng.normal())) for s in range(horizon) for c in range(channels)]
    return spark.createDataFrame(rows, "batch_id long, pos_in_batch int, window_origin long, step int, channel int, pred double, true double"), perm


def test_recorder_batch_and_stream_agree(spark, tmp_path):
    df, perm = batches(spark)
    errors = recorder.window_errors(df)
    loader = recorder.loader_order(errors).orderBy("pos").collect()
    assert [r.window_origin for r in loader] == list(perm)
    index = {r.pos: r.value for r in recorder.index_order(errors).collect()}
    assert index == {r.window_origin: r.value for r in loader}
    mse = recorder.totals(df).first().mse
    assert mse == pytest.approx(np.mean(list(index.values())), rel=1e-5)
    with pytest.raises(contract.IdentityMismatch):
        recorder.index_order(errors.unionByName(errors.limit(1)))
    src = str(tmp_path / "in")
    df.repartition(3).write.parquet(src)
    q = recorder.record(spark.readStream.schema(df.schema).parquet(src), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {r.window_origin: r.value for r in spark.read.parquet(str(tmp_path / "out")).groupBy("window_origin").agg(F.avg("value").alias("value")).collect()}
    assert got.keys() == index.keys()


def test_incremental_aot_equals_batch(spark, tmp_path):
    from seriata.operators import diagnose

    x = np.cumsum(np.random.default_rng(3).normal(size=50))
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "key string, seq long, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = recorder.incremental_aot(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("inc").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("inc").orderBy(F.desc("n")).first()
    want = diagnose.aot(df.withColumnRenamed("seq", "pos"), ["key"]).first()
    assert got.n == 50 and got.r == pytest.approx(want.r, rel=1e-9) and got.z == pytest.approx(want.z, rel=1e-9)


def test_event_time_streams(spark, tmp_path):
    rows = [(f"s{i % 40}", f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id string, t string, value double").withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = recorder.tumbling(stream(), "ts", "value", "1 day", "1 hour").writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(str(r.window.start.date()), r.n) for r in spark.table("days").collect()} == {(f"2024-01-0{d}", 20) for d in (1, 2, 3)}
    q = recorder.deduplicated(stream(), "ts", "10 days").writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 40


def test_written_cells_replace_only_themselves(spark, cell, tmp_path):
    index, side, _ = cell
    root = str(tmp_path / "bank")
    files.write_series(index, side, root)
    files.write_series(index.withColumn("cell_id", F.lit("b")), side.withColumn("cell_id", F.lit("b")), root)
    assert {r.cell_id for r in files.read_sidecars(spark, root).collect()} == {"cell", "b"}
    files.load_series(spark, root, "cell", "val_index_order")


def test_reports(spark):
    e = spark.createDataFrame([("a", i, v) for i, v in enumerate([5.0, 4.0, 4.5, 4.2, 4.1, 1.0])], "k string, epoch int, loss double")
    row = reports.early_stop(e, ["k"], "epoch", "loss", 3).first()
    assert (row.best_epoch, row.best_loss, row.epochs_run) == (1, 4.0, 5)
    assert reports.single(spark.createDataFrame([(1,), (1,)], "x int"), "x").first().x == 1
    with pytest.raises(Exception, match="not one value"):
        reports.single(spark.createDataFrame([(1,), (2,)], "x int"), "x").collect()
    assert [r.c for r in reports.custom_order(spark.createDataFrame([("b",), ("z",), ("a",)], "c string"), "c", ["a", "b"]).collect()] == ["a", "b", "z"]


def test_arm_selection_learns_only_the_right_join(spark):
    rng = np.random.default_rng(0)

    def make(n):
        x = rng.normal(size=n)
        f = spark.createDataFrame([(i, float(v), float(w)) for i, (v, w) in enumerate(zip(x, rng.normal(size=n)))], "pos long, x0 double, x1 double")
        a = spark.createDataFrame([(arm, i, 0.5 if (v > 0) == (arm == "a") else 1.5) for arm in "ab" for i, v in enumerate(x)], "arm string, pos long, value double")
        return f, a

    (fv, av), (ft, at) = make(600), make(300)
    from seriata.operators import order

    perms = order.full_permutation(av, ["arm"], 0)
    control = order.full_permutation(fv.withColumn("k", F.lit(0)), ["k"], 1).drop("k")
    got = {r.condition: r for r in downstream.arm_selection(fv, av, ft, at, ["x0", "x1"], perms, control).collect()}
    assert got["index"].oracle_match_acc > 0.95 and got["index"].realised_mse < 0.6
    assert got["control"].oracle_match_acc < 0.65 and got["index"].oracle_mse == pytest.approx(0.5)


def test_difficulty_regression(spark):
    rng = np.random.default_rng(0)
    f = np.abs(np.cumsum(rng.normal(size=600))) + 1
    y = f * np.exp(0.2 * rng.normal(size=600))
    df = spark.createDataFrame([("g", i, float(a), float(b)) for i, (a, b) in enumerate(zip(f, y))], "g string, pos long, f_std double, value double")
    from seriata.operators import order

    p, c = order.full_permutation(df, ["g"], 1), order.full_permutation(df, ["g"], 2)
    joined = downstream.three_conditions(df.drop("value"), df.select("g", "pos", "value"), p, c, ["g"])
    got = {r.condition: r for r in downstream.difficulty_regression(joined, df, ["f_std"], 4, 2, iterations=5).collect()}
    assert got["index"].spearman_test > 0.8 and abs(got["defect"].rho_f_std) < 0.15 and abs(got["control"].rho_f_std) < 0.15
    assert got["index"].holdout_eligible == 1 and got["index"].spearman_holdout is not None


def test_files_are_fetched_with_pinned_contents(tmp_path):
    source = tmp_path / "there" / "a.csv"
    source.parent.mkdir()
    source.write_bytes(b"x,y\n1,2\n" * 1000)
    sha = hashlib.sha256(source.read_bytes()).hexdigest()
    row = {"name": "a.csv", "url": source.as_uri(), "sha256": sha}
    here = str(tmp_path / "here")
    assert files.fetch([row], here) == ["a.csv"] and files.fetch([row], here) == []
    (tmp_path / "here" / "a.csv").write_bytes(b"spoilt")
    assert files.fetch([row], here) == ["a.csv"] and (tmp_path / "here" / "a.csv").read_bytes() == source.read_bytes()
    with pytest.raises(ValueError):
        files.fetch([row | {"name": "b.csv", "sha256": "0" * 64}], here)
    assert sorted(p.name for p in (tmp_path / "here").iterdir()) == ["a.csv"]


def test_a_missing_sibling_array_is_a_violation(spark, cell):
    _, _, values = cell
    loader = values.where("product = 'val_loader_order'")
    side = contract.build_sidecars(loader, files.fixture_identity(spark, products=["val_loader_order"]), S.ORDER_LOADER, commit="c")
    spec = F.expr("named_struct('kind', 'sibling_array', 'start', cast(null as bigint), 'name', 'val_perm', 'window_origins', cast(null as array<bigint>), 'sample_ids', cast(null as array<string>))")
    side = side.withColumn("sample_id_spec", spec)
    there = contract.validate(loader, side, siblings=values, require_order="loader").first()
    gone = contract.validate(loader, side, siblings=loader, require_order="loader").first()
    assert there.violation is None and (gone.violation, gone.error) == ("sample_id_spec", "MissingField")
    with pytest.raises(Exception, match="MissingField"):
        contract.resolve_sample_ids(side, loader).collect()


def test_channels_are_aligned_or_refused(spark):
    from seriata.operators import features

    df = spark.createDataFrame([(3, 1.0), (7, 2.0), (9, 5.0)], "channel int, value double")
    assert sorted(map(tuple, features.align_channels(df, [7, 3]).select("channel", "value").collect())) == [(0, 2.0), (1, 1.0)]
    with pytest.raises(Exception, match="no rows"):
        features.align_channels(df, [7, 4]).collect()
