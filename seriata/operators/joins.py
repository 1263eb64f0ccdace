"""Joins by sample id, guarded positional joins, the defect join, and grid and pending-work joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriata.functions.columns import token
from seriata.operators.contract import IdentityMismatch, MissingField, SchemaVersion

Key = Sequence[str]
SPACE = ("dataset", "split", "seq_len", "pred_len", "sample_id_scheme", "order_semantics")


def join_by_sample_id(products: Mapping[str, DataFrame], check: bool = True) -> DataFrame:
    """Products (sample_id, value, pos) by label -> sample_id, pos (of the first), a column per label: inner on the id.

    check counts rows, distinct and missing ids per product in one aggregation each, and
    refuses duplicates, missing ids and an empty result, as a silent misjoin would be worse
    than none."""
    if not products:
        raise MissingField("join_by_sample_id needs at least one product")
    for label, df in products.items():
        for c in ("sample_id", "value"):
            if c not in df.columns:
                raise MissingField(f"{label}: no {c}")
    sides = [df.select("sample_id", *(["pos"] if i == 0 and "pos" in df.columns else []), F.col("value").alias(label)) for i, (label, df) in enumerate(products.items())]
    out = reduce(lambda a, b: a.join(b, "sample_id"), sides)
    if check:
        for label, df in products.items():
            n, ids, missing = df.agg(F.count("*"), F.countDistinct("sample_id"), F.count(F.when(F.col("sample_id").isNull(), 1))).first()
            if missing:
                raise MissingField(f"{label}: {missing} values have no sample id")
            if n != ids:
                raise IdentityMismatch(f"{label}: duplicate sample ids")
        if not out.limit(1).count():
            raise IdentityMismatch(f"the sample ids of {list(products)} do not intersect")
    return out


def positional_join_check(sidecars: DataFrame, group: Key = (), n: int | None = None) -> DataFrame:
    """Group..., products, violation (NULL: allowed), truncated: whether products may be joined by position. One aggregation over the sidecars."""
    same = lambda c: F.count_distinct(token(F.col(c)))
    g = sidecars.groupBy(*group).agg(
        F.count("*").alias("products"),
        F.count(F.when(F.col("schema_version").isNull(), 1)).alias("_legacy"),
        *[same(c).alias(f"_{c}") for c in SPACE],
        F.count_distinct("ordered_sample_id_digest").alias("_digests"),
        F.count_distinct("n_samples").alias("_sizes"),
        F.min("n_samples").alias("_n"),
    )
    truncated = F.lit(False) if n is None else (F.col("_sizes") > 1) | (F.col("_n") != n)
    clause = F.coalesce(F.when(F.col("products") < 2, "").when(F.col("_legacy") > 0, "schema_version"), *[F.when(F.col(f"_{c}") > 1, c) for c in SPACE], F.when(~truncated & (F.col("_digests") > 1), "ordered_sample_id_digest"))
    return g.select(*group, "products", F.nullif(clause, F.lit("")).alias("violation"), (truncated & (F.col("products") >= 2)).alias("truncated"))


def assert_positional_join(sidecars: DataFrame, n: int | None = None) -> None:
    row = positional_join_check(sidecars, (), n).first()
    if row and row["violation"]:
        error = SchemaVersion if row["violation"] == "schema_version" else IdentityMismatch
        raise error(f"positional join refused: products differ in {row['violation']}")


def feature_join_check(features: DataFrame, sidecars: DataFrame, key: Key) -> DataFrame:
    """Features (key..., window_origin) against sidecars (key..., n_samples, ordered_sample_id_digest, ...): violation names the first clause that fails."""
    from seriata.operators.contract import ordered_digest, sample_id

    ids = features.withColumn("sample_id", sample_id(F.col("dataset"), F.col("split"), F.col("seq_len"), F.col("pred_len"), F.col("window_origin"))).withColumn("pos", F.col("window_origin"))
    own = ordered_digest(ids, key).withColumnRenamed("digest", "_d").withColumnRenamed("n", "_n")
    both = sidecars.join(own, list(key), "left")
    return both.withColumn("violation", F.when(F.col("_d").isNull(), "dataset, split or lengths").when(F.col("_n") != F.col("n_samples"), "n_samples").when(F.col("_d") != F.col("ordered_sample_id_digest"), "ordered_sample_id_digest")).drop("_d", "_n")


def stack_arms(arms: DataFrame, group: Key) -> DataFrame:
    """Rows of every arm up to the shortest arm's length; arms keep their long form."""
    sizes = arms.groupBy(*group, "arm").agg(F.count("*").alias("_n")).groupBy(*group).agg(F.min("_n").alias("_n_min"))
    return arms.join(sizes, list(group)).where(F.col("pos") < F.col("_n_min")).drop("_n_min")


def defect_join(features: DataFrame, values: DataFrame, perm: DataFrame, key: Key) -> DataFrame:
    """What a positional join against loader order pairs: row pos of the features meets the value of window src_pos."""
    moved = values.select(*key, F.col("pos").alias("src_pos"), "value").join(perm, [*key, "src_pos"]).select(*key, "pos", "value")
    return features.join(moved, [*key, "pos"])


def control_join(features: DataFrame, values: DataFrame, perm: DataFrame, key: Key) -> DataFrame:
    """The features are shuffled instead; the negative control."""
    cols = [c for c in features.columns if c not in (*key, "pos")]
    moved = features.withColumnRenamed("pos", "src_pos").join(perm, [*key, "src_pos"]).select(*key, "pos", *cols)
    return moved.join(values.select(*key, "pos", "value"), [*key, "pos"])


def paired_runs(runs: DataFrame, key: Key, on: str, left: object, right: object, value: str) -> DataFrame:
    """Key..., a, b, rel_diff_pct, abs_rel_diff_pct of runs that differ in `on` only."""
    a = runs.where(F.col(on) == left).select(*key, F.col(value).alias("a"))
    b = runs.where(F.col(on) == right).select(*key, F.col(value).alias("b"))
    rel = 100 * (F.col("b") - F.col("a")) / F.nullif(F.col("a"), F.lit(0.0))
    return a.join(b, list(key)).withColumn("rel_diff_pct", rel).withColumn("abs_rel_diff_pct", F.abs("rel_diff_pct"))


def nearest_pick(rows: DataFrame, size: str, quantiles: Sequence[float], *tie: str) -> DataFrame:
    """For each length quantile the row of nearest size, ties by `tie`. The quantiles are a literal list; rows are passed once."""
    q = rows.agg(F.percentile(size, [*map(float, quantiles)]).alias("q"))
    targets = q.select(F.posexplode("q").alias("k", "target"))
    best = rows.crossJoin(F.broadcast(targets)).groupBy("k", "target").agg(F.min_by(F.struct(*rows.columns), F.struct(F.abs(F.col(size) - F.col("target")), *tie)).alias("r"))
    return best.select("k", "target", "r.*")


def grid(spark: SparkSession, axes: Mapping[str, Sequence], ident: Sequence[str]) -> DataFrame:
    """All combinations of the axes in their given order, first of equal identities kept: ordinal, axes..., cell_id."""
    out = spark.range(1).select(F.lit(0).cast("bigint").alias("ordinal"))
    for name, values in axes.items():
        side = spark.createDataFrame([(i, v) for i, v in enumerate(values)], ["_i", name])
        out = out.crossJoin(F.broadcast(side)).withColumn("ordinal", F.col("ordinal") * max(1, len(values)) + F.col("_i")).drop("_i")
    out = out.withColumn("cell_id", F.concat_ws("_", *[F.col(c).cast("string") for c in ident]))
    first = F.row_number().over(Window.partitionBy("cell_id").orderBy("ordinal"))
    return out.withColumn("_r", first).where("_r = 1").drop("_r")


def pending(work: DataFrame, done: DataFrame, on: Key) -> DataFrame:
    """What has no result yet."""
    return work.join(done, list(on), "left_anti")


def reindex(wanted: DataFrame, df: DataFrame, on: Key) -> DataFrame:
    """J9."""
    return wanted.join(df, list(on), "left")


def asof_join(left: DataFrame, right: DataFrame, key: Key, at: str, value: str) -> DataFrame:
    """The last value of right at or before each left row, by one union and one window."""
    both = left.withColumn("_right", F.lit(None).cast(right.schema[value].dataType)).withColumn("_is", F.lit(1)).unionByName(right.select(*key, at, F.col(value).alias("_right")).withColumn("_is", F.lit(0)), allowMissingColumns=True)
    by = Window.partitionBy(*key).orderBy(at, "_is").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_right", ignorenulls=True).over(by)).where("_is = 1").drop("_is", "_right")


def exists(df: DataFrame, other: DataFrame, on: Key) -> DataFrame:
    """F8."""
    return df.join(other, list(on), "left_semi")


def allclose_violations(a: DataFrame, b: DataFrame, key: Key, value: str = "value", rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """key..., worst: how far the largest difference exceeds the tolerance; at most 0 where all are close."""
    both = a.select(*key, "pos", F.col(value).alias("a")).join(b.select(*key, "pos", F.col(value).alias("b")), [*key, "pos"])
    return both.groupBy(*key).agg(F.max(F.abs(F.col("a") - F.col("b")) - (atol + rtol * F.abs("b"))).alias("worst"))
