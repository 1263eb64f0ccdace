"""The provenance contract as DataFrame operators: ids, digests, validation, faults.

Values live in one long table SAMPLE_VALUES, sidecars in one table SIDECAR, both keyed by
(cell_id, product). Validation is a plan: a row per product with the first violated clause
in `violation` and its error class in `error`; enforce() fails the plan's action instead.
"""

from __future__ import annotations

import hashlib
import subprocess
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriata import schema as S
from seriata.functions.columns import token

Key = Sequence[str]
PRODUCT = ("cell_id", "product")


class ProvenanceError(RuntimeError):
    """Base of all rejections."""


class MissingField(ProvenanceError):
    """A field, sidecar or id is absent."""


class SchemaVersion(ProvenanceError):
    """The sidecar's schema or id scheme is not known here."""


class DigestMismatch(ProvenanceError):
    """The values are not those that the sidecar describes."""


class IdentityMismatch(ProvenanceError):
    """Another sample set, order or cell than expected."""


class OrderSemantics(ProvenanceError):
    """The declared order is outside the enumeration."""


class ProvenanceWarning(UserWarning):
    """An artefact without full contract was accepted."""


ERRORS = {e.__name__: e for e in (MissingField, SchemaVersion, DigestMismatch, IdentityMismatch, OrderSemantics)}


def sample_id(dataset: Column, split: Column, seq_len: Column, pred_len: Column, origin: Column, scheme: str = S.SCHEME_ORIGIN) -> Column:
    """C1."""
    if scheme not in (S.SCHEME_ORIGIN, S.SCHEME_DECLARED):
        raise SchemaVersion(f"unknown sample id scheme {scheme!r}")
    part = lambda p, c: F.concat(F.lit(p), token(c))
    return F.concat_ws("|", F.lit(scheme), token(dataset), token(split), part("L", seq_len), part("H", pred_len), part("w", origin))


def framed(ids: Column, count: Column) -> Column:
    """The digest's text: domain, count, and each id with its length in bytes."""
    body = F.array_join(F.transform(ids, lambda s: F.concat(F.octet_length(s).cast("string"), F.lit(":"), s, F.lit("\n"))), "")
    return F.concat(F.lit(S.ID_DIGEST_DOMAIN), F.lit("count="), count.cast("string"), F.lit("\n"), body)


def ordered_digest(df: DataFrame, key: Key, ident: str = "sample_id") -> DataFrame:
    """Key..., n, digest over the ids in pos order. A digest over an order needs its ids in one place: one product's ids at a time, no values."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", token(F.col(ident)).alias("s")))), lambda x: x["s"])
    g = df.groupBy(*key).agg(F.count("*").alias("n"), ids.alias("ids"))
    return g.select(*key, "n", F.concat(F.lit("sha256:"), F.sha2(framed(F.col("ids"), F.col("n")), 256)).alias("digest"))


def value_digest_of(x: np.ndarray) -> str:
    """C3 on an array: element type, shape and little-endian bytes, -0 as 0 and NaN in one form."""
    a = np.asarray(x)
    if a.dtype.kind == "f":
        a = a.astype("<f8") + 0.0
        a[np.isnan(a)] = np.nan
    elif a.dtype.kind in "iu":
        a = a.astype("<i8")
    elif a.dtype.kind == "b":
        a = a.astype(np.uint8)
    else:
        raise TypeError(f"no digest for element type {a.dtype!r}")
    head = f"{S.VALUE_DIGEST_DOMAIN}dtype={a.dtype.str}|shape={tuple(map(int, a.shape))}\n"
    return "sha256:" + hashlib.sha256(head.encode() + np.ascontiguousarray(a).tobytes()).hexdigest()


def value_digest(df: DataFrame, key: Key, value: str = "value") -> DataFrame:
    """Key..., n, digest of the values in pos order; the bytes of doubles need Arrow."""

    @F.pandas_udf("string")
    def of(rows: pd.Series) -> pd.Series:
        return rows.map(lambda v: value_digest_of(np.asarray(v)))  # Arrow gives one flat array each; a null double is NaN

    v = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v")))), lambda x: x["v"])
    return df.groupBy(*key).agg(F.count("*").alias("n"), v.alias("v")).select(*key, "n", of("v").alias("digest"))


def producer_commit(root: str = ".") -> str:
    """S16."""
    try:
        return subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=True).stdout.strip() or S.UNKNOWN
    except (OSError, subprocess.SubprocessError):
        return S.UNKNOWN


def build_sidecars(values: DataFrame, identity: DataFrame, order_semantics: str, scheme: str = S.SCHEME_ORIGIN, commit: str | None = None, extra: Mapping[str, object] | None = None) -> DataFrame:
    """C4: sidecars of the products in values (cell_id, product, pos, window_origin, sample_id, value); identity: (cell_id, product, split, dataset, ... seed). The plan fails on duplicate or missing ids; extras never replace contract fields."""
    if order_semantics not in (S.ORDER_INDEX, S.ORDER_LOADER):
        raise OrderSemantics(f"order must be {S.ORDER_INDEX} or {S.ORDER_LOADER}, got {order_semantics!r}")
    if scheme not in (S.SCHEME_ORIGIN, S.SCHEME_DECLARED):
        raise SchemaVersion(f"unknown sample id scheme {scheme!r}")
    key = list(PRODUCT)
    unique = values.groupBy(*key).agg(F.countDistinct("sample_id").alias("_u"), F.count("sample_id").alias("_c"), F.count("*").alias("_n"))
    ids = ordered_digest(values, key).select(*key, F.col("n").alias("n_samples"), F.col("digest").alias("ordered_sample_id_digest"))
    vals = value_digest(values, key).select(*key, F.col("digest").alias("value_digest"))
    origins = values.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "window_origin"))), lambda x: x["window_origin"]).alias("_o"))
    out = identity.join(ids, key).join(vals, key).join(unique, key).join(origins, key)
    checked = F.when((F.col("_u") == F.col("_n")) & (F.col("_c") == F.col("_n")), F.col("n_samples")).otherwise(F.raise_error(F.lit("IdentityMismatch: sample ids are not unique")).cast("bigint"))
    out = out.withColumn("n_samples", checked).withColumns({
        "schema_version": F.lit(S.SCHEMA_VERSION),
        "order_semantics": F.lit(order_semantics),
        "sample_id_scheme": F.lit(scheme),
        "producer_commit": F.lit(commit if commit is not None else producer_commit()),
        "sample_id_spec": F.struct(F.lit("inline").alias("kind"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("string").alias("name"), F.col("_o").alias("window_origins"), F.lit(None).cast("array<string>").alias("sample_ids")),
    }).drop("_u", "_c", "_n", "_o")
    for name, v in (extra or {}).items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(v))
    return out.select(*[(F.col(f.name) if f.name in out.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.SIDECAR])


def identity_complete(prefix: str = "") -> Column:
    """C6."""
    out = F.lit(True)
    for c in ("split", *S.IDENTITY):
        out = out & (token(F.col(prefix + c)) != S.UNKNOWN)
    return out


def is_legacy() -> Column:
    """A sidecar from before the contract."""
    return F.col("schema_version").isNull()


def resolve_sample_ids(sidecars: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """cell_id, product, pos, sample_id by what the sidecar's spec says: inline ids, inline origins, a range, another product's window order (the plan fails where that product has no values), or none (no rows)."""
    key = list(PRODUCT)
    sc = sidecars.select(*key, "dataset", "split", "seq_len", "pred_len", "n_samples", "sample_id_scheme", F.col("sample_id_spec").alias("spec"))
    made = F.concat_ws("|", F.col("sample_id_scheme"), token(F.col("dataset")), token(F.col("split")), F.concat(F.lit("L"), token(F.col("seq_len"))), F.concat(F.lit("H"), token(F.col("pred_len"))), F.concat(F.lit("w"), F.col("origin").cast("string")))
    listed = sc.where("spec.kind = 'inline' and spec.sample_ids is not null").select(*key, F.posexplode("spec.sample_ids").alias("pos", "sample_id"))
    inline = sc.where("spec.kind = 'inline' and spec.sample_ids is null and spec.window_origins is not null").select("*", F.posexplode("spec.window_origins").alias("pos", "origin")).select(*key, "pos", made.alias("sample_id"))
    ranged = sc.where("spec.kind = 'identity_range' and n_samples > 0").select("*", F.posexplode(F.sequence(F.coalesce("spec.start", F.lit(0)), F.coalesce("spec.start", F.lit(0)) + F.col("n_samples") - 1)).alias("pos", "origin")).select(*key, "pos", made.alias("sample_id"))
    out = listed.unionByName(inline).unionByName(ranged)
    if values is not None:
        other = values.select("cell_id", F.col("product").alias("_name"), F.col("pos").cast("int").alias("pos"), F.col("value").cast("bigint").alias("origin"))
        named = sc.where("spec.kind = 'sibling_array'").withColumn("_name", F.col("spec.name")).join(other, ["cell_id", "_name"], "left")
        pos = F.when(F.col("pos").isNotNull(), F.col("pos")).otherwise(F.raise_error(F.concat(F.lit("MissingField: "), "cell_id", F.lit("/"), "product", F.lit(" takes its ids from an array that is not there: "), "_name")).cast("int"))
        out = out.unionByName(named.select(*key, pos.alias("pos"), made.alias("sample_id")))
    return out.withColumn("pos", F.col("pos").cast("bigint"))


def missing_siblings(sidecars: DataFrame, values: DataFrame) -> DataFrame:
    """cell_id, product of sidecars that take their ids from another product of their cell that has no values."""
    there = values.select("cell_id", F.col("product").alias("_name")).distinct()
    return sidecars.where("sample_id_spec.kind = 'sibling_array'").withColumn("_name", F.col("sample_id_spec.name")).join(there, ["cell_id", "_name"], "left_anti").select(*PRODUCT)


def validate(values: DataFrame, sidecars: DataFrame, expect: Mapping[str, object] | None = None, siblings: DataFrame | None = None, wanted: DataFrame | None = None, require_order: str | None = "index", legacy_ok: bool = False) -> DataFrame:
    """cell_id, product, n, violation, error, legacy, incomplete; first failing clause in the contract's order.

    wanted: the (cell_id, product) that must exist; default all in values. siblings: values in
    which the products that sidecars name are looked up; default values. expect: values that
    fields must have. require_order None lets a product without sidecar pass."""
    key = list(PRODUCT)
    wanted = (values.select(*key).distinct() if wanted is None else wanted.select(*key)).distinct()
    own = value_digest(values, key).withColumnRenamed("digest", "_value_digest").withColumnRenamed("n", "n")
    siblings = values if siblings is None else siblings
    orphans = missing_siblings(sidecars, siblings).withColumn("_orphan", F.lit(1))
    ids = resolve_sample_ids(sidecars.join(orphans, key, "left_anti"), siblings)
    got = ordered_digest(ids, key).select(*key, F.col("n").alias("_n_ids"), F.col("digest").alias("_id_digest"))
    first_wrong = ids.join(sidecars.select(*key, "dataset", "split", "seq_len", "pred_len", "sample_id_scheme"), key)
    made = sample_id(F.col("dataset"), F.col("split"), F.col("seq_len"), F.col("pred_len"), F.col("pos"))
    first_wrong = first_wrong.groupBy(*key).agg(F.min(F.when(F.col("sample_id") != made, F.col("pos"))).alias("_first_wrong"))
    rows = wanted.join(own, key, "left").join(sidecars.withColumn("_side", F.lit(1)), key, "left").join(got, key, "left").join(first_wrong, key, "left").join(orphans, key, "left")
    c = F.col
    no_side, legacy = c("_side").isNull(), c("_side").isNotNull() & is_legacy()
    clauses: list[tuple[Column, str, str]] = [(c("n").isNull(), "values", "MissingField")]
    clauses.append((no_side & F.lit(require_order is not None), "sidecar", "MissingField"))
    if not legacy_ok:
        clauses.append((legacy, "schema_version", "SchemaVersion"))
    else:
        label = F.lit(require_order)
        clauses.append((legacy & label.isNotNull() & (token(c("order")) != label), "order", "OrderSemantics"))
        clauses.append((legacy & c("n_windows").isNotNull() & (c("n_windows") != c("n")), "n_windows", "IdentityMismatch"))
    new = c("_side").isNotNull() & ~is_legacy()
    clauses.append((new & (c("schema_version") != S.SCHEMA_VERSION), "schema_version", "SchemaVersion"))
    for f in S.REQUIRED[1:]:
        clauses.append((new & c(f).isNull(), f, "MissingField"))
    clauses += [
        (new & ~c("order_semantics").isin(S.ORDER_INDEX, S.ORDER_LOADER), "order_semantics", "OrderSemantics"),
        (new & ~c("sample_id_scheme").isin(S.SCHEME_ORIGIN, S.SCHEME_DECLARED), "sample_id_scheme", "SchemaVersion"),
        (new & (c("n_samples") != c("n")), "n_samples", "IdentityMismatch"),
        (new & (c("value_digest") != c("_value_digest")), "value_digest", "DigestMismatch"),
        (new & c("_orphan").isNotNull(), "sample_id_spec", "MissingField"),
        (new & c("_n_ids").isNotNull() & (c("_n_ids") != c("n")), "sample_ids", "IdentityMismatch"),
        (new & c("_id_digest").isNotNull() & (c("_id_digest") != c("ordered_sample_id_digest")), "ordered_sample_id_digest", "IdentityMismatch"),
        (new & (c("order_semantics") == S.ORDER_INDEX) & (c("sample_id_scheme") == S.SCHEME_ORIGIN) & c("_first_wrong").isNotNull(), "window_origin", "IdentityMismatch"),
    ]
    if require_order is not None:
        clauses.append((new & (c("order_semantics") != S.ORDER_LABELS[require_order]), "order_semantics", "IdentityMismatch"))
    for f, v in (expect or {}).items():
        if v is not None:
            clauses.append((new & (token(c(f)) != str(v)), f, "IdentityMismatch"))
    clauses.append((new & c("n_windows").isNotNull() & (c("n_windows") != c("n")), "n_windows", "IdentityMismatch"))
    first = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(what).alias("v"), F.lit(e).alias("e"))) for bad, what, e in clauses])
    return rows.select(*key, "n", first.alias("_f"), F.coalesce(legacy, F.lit(False)).alias("legacy"), (new & ~identity_complete()).alias("incomplete")).select(*key, "n", c("_f.v").alias("violation"), c("_f.e").alias("error"), "legacy", "incomplete")


def enforce(report: DataFrame) -> None:
    """Raise the first violation, if any."""
    row = report.where("violation is not null").orderBy(*PRODUCT).first()
    if row:
        raise ERRORS[row["error"]](f"{row['cell_id']}/{row['product']}: {row['violation']}")


def backfill_plan(sidecars: DataFrame, values: DataFrame) -> DataFrame:
    """C11: cell_id, product, status (ok, skipped, error), reason, n: which legacy sidecars can be given a contract. A loader product needs its cell's val_perm to be a bijection. Nothing is written."""
    from seriata.operators.order import bijection_violations

    key = list(PRODUCT)
    perms = values.where("product = 'val_perm'").select("cell_id", "pos", F.col("value").cast("bigint").alias("src_pos"))
    bad = bijection_violations(perms, ["cell_id"]).select("cell_id", F.lit(1).alias("_bad"))
    have = perms.select("cell_id").distinct().withColumn("_perm", F.lit(1))
    sizes = values.groupBy(*key).agg(F.count("*").alias("n"))
    rows = sidecars.select(*key, "schema_version", "order", "n_windows").join(sizes, key, "left").join(have, "cell_id", "left").join(bad, "cell_id", "left")
    loader = F.col("order") == "loader"
    reason = F.coalesce(
        F.when(F.col("schema_version").isNotNull(), "has a contract"),
        F.when(F.col("n").isNull(), "no values"),
        F.when(F.col("n_windows").isNotNull() & (F.col("n_windows") != F.col("n")), "length differs"),
        F.when(~F.coalesce(F.col("order").isin("index", "loader"), F.lit(False)), "unknown order"),
        F.when(loader & F.col("_perm").isNull(), "no permutation"),
        F.when(loader & F.col("_bad").isNotNull(), "permutation is no bijection"),
    )
    status = F.when(reason.isNull(), "ok").when(F.col("schema_version").isNotNull(), "skipped").otherwise("error")
    return rows.select(*key, status.alias("status"), reason.alias("reason"), "n")


def backfill(sidecars: DataFrame, values: DataFrame, identity: DataFrame, tool: str = "backfill", commit: str = S.UNKNOWN) -> DataFrame:
    """C11: the contract sidecars of all products that backfill_plan finds ok. Loader products take their windows from the cell's val_perm, index products from their positions; the producing commit of old values is unknown. Nothing is written; write the result to apply it."""
    key = list(PRODUCT)
    ok = backfill_plan(sidecars, values).where("status = 'ok'").select(*key).join(sidecars.select(*key, "order", "note", "val_order"), key)
    perm = values.where("product = 'val_perm'").select("cell_id", "pos", F.col("value").cast("bigint").alias("_origin"))
    rows = values.join(ok.select(*key, "order"), key).join(identity.select(*key, "dataset", "split", "seq_len", "pred_len"), key)
    rows = rows.join(perm, ["cell_id", "pos"], "left").withColumn("window_origin", F.when(F.col("order") == "loader", F.col("_origin")).otherwise(F.col("pos")))
    rows = rows.withColumn("sample_id", sample_id(F.col("dataset"), F.col("split"), F.col("seq_len"), F.col("pred_len"), F.col("window_origin")))
    cols = [f.name for f in S.SAMPLE_VALUES]
    out = None
    for label, semantics in S.ORDER_LABELS.items():
        part = rows.where(F.col("order") == label)
        mine = identity.join(ok.where(F.col("order") == label).select(*key), key)
        made = build_sidecars(part.select(*cols), mine, semantics, commit=S.UNKNOWN)
        none, kind = F.lit(None), F.lit("identity_range" if label == "index" else "sibling_array")
        spec = F.struct(kind.alias("kind"), F.lit(0 if label == "index" else None).cast("bigint").alias("start"), F.lit(None if label == "index" else "val_perm").cast("string").alias("name"), none.cast("array<bigint>").alias("window_origins"), none.cast("array<string>").alias("sample_ids"))
        made = made.withColumns({"sample_id_spec": spec, "order": F.lit(label), "n_windows": F.col("n_samples"), "backfilled": F.lit(True), "backfill_commit": F.lit(commit), "backfill_tool": F.lit(tool)})
        out = made if out is None else out.unionByName(made)
    return out


def loader_consistency(values: DataFrame) -> DataFrame:
    """cell_id, worst: by how much val_loader_order leaves the tolerance about val_index_order taken in val_perm's order; above 0 where the three disagree."""
    part = lambda name, c: values.where(F.col("product") == name).select("cell_id", "pos", F.col("value").alias(c))
    perm = part("val_perm", "_p").withColumn("_src", F.col("_p").cast("bigint"))
    index = part("val_index_order", "a").withColumnRenamed("pos", "_src")
    both = perm.join(index, ["cell_id", "_src"]).join(part("val_loader_order", "b"), ["cell_id", "pos"])
    return both.groupBy("cell_id").agg(F.max(F.abs(F.col("a") - F.col("b")) - (1e-8 + 1e-5 * F.abs("b"))).alias("worst"))


def latest(df: DataFrame, key: Key, order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
