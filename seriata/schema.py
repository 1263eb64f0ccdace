"""Schemas and fixed values of the data model.

Order is data here: every per-sample value carries `pos` (its place in the vector as
recorded) and `window_origin` (the sample it belongs to). NULL means undefined inside the
engine; NaN is only accepted at the edges and turned into NULL.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the interchange format: sidecars and digests written by other tools agree only with exactly these.
SCHEMA_VERSION = "order-audit/provenance/2"
UNKNOWN = "unknown"
SCHEME_ORIGIN = "window_origin/v1"
SCHEME_DECLARED = "declared_position/v1"
ORDER_INDEX = "dataset_index"
ORDER_LOADER = "loader_emission"
ID_DIGEST_DOMAIN = "order-audit/ordered-sample-ids/v1\n"
VALUE_DIGEST_DOMAIN = "order-audit/value-digest/v1\n"
IDENTITY = ("dataset", "backbone", "plugin", "seq_len", "pred_len", "seed")
REQUIRED = ("schema_version", "split", "n_samples", "ordered_sample_id_digest", "value_digest", "order_semantics", "sample_id_scheme", *IDENTITY)
RECOMMENDED = ("producer_commit",)
ORDER_LABELS = {"index": ORDER_INDEX, "loader": ORDER_LOADER}

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def struct(fields: str, **nested: T.DataType) -> T.StructType:
    """Schema from "name type" pairs; needs no session, so workers can import this module."""
    out = T.StructType()
    for name, kind in (f.split() for f in fields.split(",")):
        out = out.add(name, nested[name] if kind == "nested" else _TYPES[kind])
    return out


RUNS = struct(
    "dataset string, backbone string, plugin string, pred_len int, seed int, val_order string, cell_id string, mse double, val_mse double, best_epoch int, epochs_run int, "
    "n_val_windows int, n_test_windows int, n_train_windows int, n_params int, loader_shuffled_val boolean, seq_len int, batch_size int, plugin_kind string, train_seconds double, "
    "device string, truncated boolean, timestamp string, winerr_dir string"
)

SAMPLE_VALUES = struct("cell_id string, product string, pos bigint, window_origin bigint, sample_id string, value double")

SIDECAR = struct(
    "cell_id string, product string, schema_version string, split string, n_samples bigint, ordered_sample_id_digest string, value_digest string, order_semantics string, sample_id_scheme string, "
    "sample_id_spec nested, dataset string, backbone string, plugin string, seq_len int, pred_len int, seed int, "
    "producer_commit string, order string, n_windows bigint, val_order string, note string, backfilled boolean, backfill_commit string, backfill_tool string",
    sample_id_spec=struct("kind string, start bigint, name string, window_origins nested, sample_ids nested", window_origins=T.ArrayType(T.LongType()), sample_ids=T.ArrayType(T.StringType())),
)

SERIES = struct("dataset string, split string, t bigint, channel int, value double")
