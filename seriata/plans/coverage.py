"""The contract's fault matrix: 25 injected faults and whether the contract refuses them.

Faults of one product are rows of one validation plan, each as a cell of its own; faults of
joins run the guarded join. Five faults pass by design: nothing recorded contradicts them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriata import schema as S
from seriata.operators import contract, joins
from seriata.sources.files import fixture_cell, fixture_identity

# The names of the faults, here and below, are fixed values: reports of other tools are compared by them.
INDEX, LOADER = "val_index_order", "val_loader_order"
ACCEPTED = {
    "two_producers_share_one_wrong_loader_order": "both declare the same wrong order",
    "no_sidecar_but_consumer_passes_require_order_None": "the consumer opted out; a warning is due",
    "positional_join_truncated_to_n_min": "only the sample space is compared; a warning is due",
    "upstream_data_or_preprocessing_changed": "values and digests were made together from other data",
    "per_sample_value_computed_wrongly_but_consistently": "values and digests were made together by a wrong formula",
}


def _change(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def contract_coverage(spark: SparkSession) -> DataFrame:
    """fault, detected, exception, detected_by_field, note."""

    def fixed(df: DataFrame) -> DataFrame:
        """The fixture has 64 values a product; its plans are replaced by the rows."""
        return spark.createDataFrame(df.collect(), df.schema)

    bank = fixed(fixture_cell(spark))
    index, loader = (fixed(bank.where(F.col("product") == p)) for p in (INDEX, LOADER))
    side = fixed(contract.build_sidecars(index, fixture_identity(spark), S.ORDER_INDEX, commit="fixture"))
    loader_side = fixed(contract.build_sidecars(loader, fixture_identity(spark, products=[LOADER]), S.ORDER_LOADER, commit="fixture"))
    v, pos, n = F.col("value"), F.col("pos"), 64
    values = {
        "single_element_edited": _change(index, value=F.when(pos == 5, v + 1).otherwise(v)),
        "float_perturbation_1e-12": _change(index, value=F.when(pos == 5, v + 1e-12).otherwise(v)),
        "cyclic_rotation_of_the_whole_array": _change(index, pos=F.pmod(pos + 13, F.lit(n)).cast("bigint")),
        "random_permutation_of_the_array": loader,
        "array_truncated_by_one_sample": index.where(pos < n - 1),
        "stale_sidecar_array_rerun_in_place": _change(index, value=v * 1.5),
        "array_replaced_by_another_cell_same_length": fixture_cell(spark, seed=9).where(F.col("product") == INDEX),
        "upstream_data_or_preprocessing_changed": _change(index, value=v * 3),
        "per_sample_value_computed_wrongly_but_consistently": _change(index, value=v + 7),
    }
    spec = F.col("sample_id_spec")
    swapped = F.struct(spec["kind"].alias("kind"), spec["start"].alias("start"), spec["name"].alias("name"), F.reverse(spec["window_origins"]).alias("window_origins"), spec["sample_ids"].alias("sample_ids"))
    none = lambda t: F.lit(None).cast(t)
    sidecars = {
        "loader_order_relabelled_as_index_order": _change(loader_side, order_semantics=F.lit(S.ORDER_INDEX)),
        "sample_id_source_replaced_val_perm": _change(loader_side, sample_id_spec=swapped),
        "legacy_sidecar_without_schema_version": _change(side, schema_version=none("string")),
        "unknown_future_schema_version": _change(side, schema_version=F.lit("order-audit/provenance/9")),
        "required_field_removed_from_sidecar": _change(side, value_digest=none("string")),
        "order_semantics_outside_the_enumeration": _change(side, order_semantics=F.lit("sorted")),
        "sidecar_file_deleted": side.limit(0),
    }
    made = {name: fixed(contract.build_sidecars(values[name], fixture_identity(spark), S.ORDER_INDEX, commit="fixture")) for name in ("upstream_data_or_preprocessing_changed", "per_sample_value_computed_wrongly_but_consistently")}
    cells, sides = None, None
    for name in [*values, *sidecars]:
        own = values.get(name, loader if "loader" in name or "val_perm" in name else index)
        own = _change(own, cell_id=F.lit(name), product=F.lit(INDEX))
        sc = _change(made.get(name, sidecars.get(name, side)), cell_id=F.lit(name), product=F.lit(INDEX))
        cells = own if cells is None else cells.unionByName(own)
        sides = sc if sides is None else sides.unionByName(sc)
    cells, sides = fixed(cells), fixed(sides)
    # the swapped loader product is read as what it is; its order is no expectation here
    relaxed = F.col("cell_id") == "sample_id_source_replaced_val_perm"
    report = contract.validate(cells.where(~relaxed), sides.where(~relaxed)).unionByName(contract.validate(cells.where(relaxed), sides.where(relaxed), require_order="loader"))
    split = contract.validate(index, side, expect={"split": "test"}).withColumn("cell_id", F.lit("val_product_consumed_as_test"))
    opted = contract.validate(index, side.limit(0), require_order=None).withColumn("cell_id", F.lit("no_sidecar_but_consumer_passes_require_order_None"))
    read = report.unionByName(split).unionByName(opted).select(F.col("cell_id").alias("fault"), F.col("violation").isNotNull().cast("int").alias("detected"), F.col("error").alias("exception"), F.col("violation").alias("detected_by_field"))

    def other(column: str, horizon: int = 336, dataset: str = "ETTh1") -> DataFrame:
        return _change(index, sample_id=contract.sample_id(F.lit(dataset), F.lit("val"), F.lit(96), F.lit(horizon), pos))

    def duplicated() -> None:
        contract.build_sidecars(_change(index, sample_id=F.when(pos == 1, F.lit("twice")).when(pos == 2, F.lit("twice")).otherwise(F.col("sample_id"))), fixture_identity(spark), S.ORDER_INDEX).collect()

    cases: list[tuple[str, str, Callable[[], object]]] = [
        ("same_length_different_horizon_joined", "sample_id", lambda: joins.join_by_sample_id({"a": index, "b": other("b", horizon=192)})),
        ("same_length_different_dataset_joined", "sample_id", lambda: joins.join_by_sample_id({"a": index, "b": other("b", dataset="ETTh2")})),
        ("positional_join_across_different_sample_sets", "pred_len", lambda: joins.assert_positional_join(side.unionByName(_change(side, pred_len=F.lit(192))))),
        ("join_of_a_product_with_no_sample_ids", "sample_id", lambda: joins.join_by_sample_id({"a": index, "b": index.drop("sample_id")})),
        ("duplicate_sample_ids_in_one_product", "sample_id", duplicated),
        ("two_producers_share_one_wrong_loader_order", "", lambda: joins.assert_positional_join(loader_side.unionByName(loader_side))),
        ("positional_join_truncated_to_n_min", "", lambda: joins.assert_positional_join(side.unionByName(_change(side, n_samples=F.lit(60).cast("bigint"))), 60)),
    ]
    rows = []
    for fault, field, run in cases:
        try:
            run()
            rows.append((fault, 0, None, None))
        except Exception as e:
            known = next((k for k in contract.ERRORS if k == type(e).__name__ or k in str(e)), type(e).__name__)
            rows.append((fault, 1, known, field))
    joined = spark.createDataFrame(rows, "fault string, detected int, exception string, detected_by_field string")
    note = F.coalesce(*[F.when(F.col("fault") == k, F.lit(t)) for k, t in ACCEPTED.items()], F.lit(""))
    return read.unionByName(joined).withColumn("note", note)
