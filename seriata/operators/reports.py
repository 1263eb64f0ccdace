"""Report aggregates over run and result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Key = Sequence[str]


def summary(df: DataFrame, key: Key, value: str, quantiles: Sequence[float] = ()) -> DataFrame:
    """Count, mean, median, extremes, deviations and exact quantiles."""
    qs = [F.percentile(value, float(q)).alias(f"q{round(100 * q):02d}") for q in quantiles]
    return df.groupBy(*key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_samp(value).alias("sd"), F.stddev_pop(value).alias("sd_pop"), *qs)


def named(df: DataFrame, key: Key, **aggregates: Column) -> DataFrame:
    """A3."""
    return df.groupBy(*key).agg(*[c.alias(n) for n, c in aggregates.items()])


def pivot_mean(df: DataFrame, key: Key, condition: str, value: str, conditions: Sequence[str]) -> DataFrame:
    """A4, A5: a column per condition; the conditions are named, so no extra pass looks for them."""
    return df.groupBy(*key).pivot(condition, list(conditions)).agg(F.avg(value))


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """A7."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def rate(flag: Column) -> Column:
    """Percentage of rows where the flag holds."""
    return 100 * F.avg(F.coalesce(flag, F.lit(False)).cast("double"))


def kurtosis(value: str) -> Column:
    """3 for a normal distribution."""
    return F.kurtosis(value) + 3


def central_sums(df: DataFrame, key: Key, value: str) -> DataFrame:
    """N, s2, s4 about the mean, centred before the powers."""
    m = df.groupBy(*key).agg(F.avg(value).alias("_m"))
    c = F.col(value) - F.col("_m")
    return (df.join(m, list(key)) if key else df.crossJoin(F.broadcast(m))).groupBy(*key).agg(F.count(value).alias("n"), F.sum(c * c).alias("s2"), F.sum(c * c * c * c).alias("s4"))


def entropy_bits(df: DataFrame, key: Key, label: str) -> DataFrame:
    """A14."""
    c = df.groupBy(*key, label).agg(F.count("*").alias("c"))
    f = c.withColumn("f", F.col("c") / F.sum("c").over(Window.partitionBy(*(key or [F.lit(0)]))))
    return f.groupBy(*key).agg(F.sum(-F.col("f") * F.log2("f")).alias("entropy_bits"), F.max("f").alias("modal_share"))


def single(df: DataFrame, value: str) -> DataFrame:
    """The one value; the plan fails unless there is exactly one."""
    g = df.agg(F.min(value).alias("a"), F.max(value).alias("b"))
    return g.select(F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.raise_error(F.concat(F.lit("not one value: "), F.coalesce(F.col("a").cast("string"), F.lit("none"))))).alias(value))


def median_of_defined(value: str) -> Column:
    """The median of what is neither NULL nor NaN."""
    return F.median(F.when(~F.isnan(value), F.col(value)))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Bin (1..bins, 0 below and bins + 1 above), n."""
    return df.where(F.col(value).isNotNull()).groupBy(F.width_bucket(F.col(value), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def with_total(df: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    """Rows per key and one over all, named all."""
    g = df.rollup(key).agg(F.grouping(key).alias("_g"), *[c.alias(n) for n, c in aggregates.items()])
    return g.withColumn(key, F.when(F.col("_g") == 1, "all").otherwise(F.col(key))).drop("_g")


def multiset_equal(a: DataFrame, b: DataFrame) -> bool:
    """A22 for whole tables."""
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def distinct_sum(df: DataFrame, identity: Key, value: str) -> DataFrame:
    """The sum over one row per identity; where its rows differ, the greatest value counts."""
    return df.groupBy(*identity).agg(F.max(value).alias("_v")).agg(F.sum("_v").alias(value))


def custom_order(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Rows in a named order; unknown names last."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return df.orderBy(F.when(at > 0, at).otherwise(len(order) + 1), column)


def verify_numbers(computed: DataFrame, declared: DataFrame) -> DataFrame:
    """Q27: name, value (computed) against value (declared) and decimals: ok where integers are equal and others lie within max(1e-9, 0.51 10^-decimals, 1e-3 |v|); names on one side only are not ok."""
    both = computed.select("name", F.col("value").alias("computed")).join(declared.select("name", F.col("value").alias("declared"), "decimals"), "name", "full")
    tolerance = F.greatest(F.lit(1e-9), 0.51 * F.pow(F.lit(10.0), -F.col("decimals")), 1e-3 * F.abs("declared"))
    ok = F.when(F.col("decimals") == 0, F.round("computed") == F.col("declared")).otherwise(F.abs(F.col("computed") - F.col("declared")) <= tolerance)
    return both.withColumn("ok", F.coalesce(ok, F.lit(False)))


def scalars(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Q24: name, value: one row per named aggregate, all from one pass."""
    one = df.agg(*[c.cast("double").alias(n) for n, c in aggregates.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in aggregates])).alias("s")).select("s.name", "s.value")


def early_stop(epochs: DataFrame, key: Key, epoch: str, loss: str, patience: int, minimal: float = 1e-8) -> DataFrame:
    """ST7: key..., best_epoch, best_loss, epochs_run: an epoch improves if it beats the best before by more than `minimal`; training ends after `patience` epochs without."""
    by = Window.partitionBy(*key).orderBy(epoch)
    before = F.min(loss).over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = epochs.withColumn("_up", F.coalesce(F.col(loss) < before - minimal, F.lit(True)).cast("int"))
    rows = rows.withColumn("_last_up", F.max(F.when(F.col("_up") == 1, F.col(epoch))).over(by)).withColumn("_stale", F.col(epoch) - F.col("_last_up") >= patience)
    stop = F.min(F.when(F.col("_stale"), F.col(epoch))).over(Window.partitionBy(*key))
    kept = rows.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col(epoch) <= F.col("_stop")))
    return kept.groupBy(*key).agg(F.max_by(epoch, F.when(F.col("_up") == 1, F.col(epoch))).alias("best_epoch"), F.max_by(loss, F.when(F.col("_up") == 1, F.col(epoch))).alias("best_loss"), F.count("*").alias("epochs_run"))


def constants(spark, values: Mapping[str, float]) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in values.items()], "name string, value double")
