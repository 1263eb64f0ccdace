"""Per-window error recorder and incremental order diagnostics on Structured Streaming.

State is a few numbers a window or key, never predictions. Input batches carry
(batch_id, pos_in_batch, window_origin, step, channel, pred, true).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seriata.operators import order
from seriata.operators.contract import IdentityMismatch


def window_errors(batches: DataFrame) -> DataFrame:
    """ST1: batch_id, pos_in_batch, window_origin, value (mean squared error, in single precision then widened). The same for batch and stream."""
    d = F.pow(F.col("pred").cast("float") - F.col("true").cast("float"), F.lit(2.0))
    return batches.groupBy("batch_id", "pos_in_batch", "window_origin").agg(F.avg(d).alias("value"))


def totals(batches: DataFrame) -> DataFrame:
    """ST2, A23: squared error, count and their ratio, NULL without rows."""
    d = F.pow(F.col("pred") - F.col("true"), F.lit(2.0))
    return batches.agg(F.sum(d).alias("squared_error"), F.count(d).alias("n"), F.avg(d).alias("mse"))


def record(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that writes window errors of every micro-batch to Parquet; a replayed batch overwrites itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        window_errors(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def loader_order(errors: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """ST3, ST4: key..., pos (emission order), window_origin, value. A vector is numbered by ranges of its batches, so no task holds a whole one."""
    by = [*key, "_k"]
    return order.with_pos_spread(errors.withColumn("_k", F.lit(0)), by, "batch_id", "pos_in_batch").drop("_k", "batch_id", "pos_in_batch")


def index_order(errors: DataFrame) -> DataFrame:
    """ST5: pos = window_origin, value; refused unless every window came exactly once."""
    n, distinct, low, high = errors.agg(F.count("*"), F.countDistinct("window_origin"), F.min("window_origin"), F.max("window_origin")).first()
    if n and (n != distinct or low != 0 or high != n - 1):
        raise IdentityMismatch(f"{n} errors for {distinct} windows from {low} to {high}: not one each")
    return errors.select(F.col("window_origin").alias("pos"), "value")


def without_truncated(values: DataFrame, runs: DataFrame) -> DataFrame:
    """ST8: vectors of truncated runs are never written."""
    return values.join(runs.where("truncated").select("cell_id"), "cell_id", "left_anti")


def deduplicated(stream: DataFrame, event_time: str, delay: str, ident: str = "sample_id") -> DataFrame:
    """A sample seen again within the watermark is dropped. An addition, as is what follows."""
    return stream.withColumn("_t", F.col(event_time).cast("timestamp")).withWatermark("_t", delay).dropDuplicatesWithinWatermark([ident]).drop("_t")


def tumbling(stream: DataFrame, event_time: str, value: str, width: str, delay: str, *key: str) -> DataFrame:
    """Count, mean and deviation by event-time window."""
    t = F.col(event_time).cast("timestamp")
    return stream.withColumn("_t", t).withWatermark("_t", delay).groupBy(F.window("_t", width), *key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


STATE = "first double, last double, n bigint, s1 double, s2 double, s3 double, s4 double, lag double"
OUT = "key string, n bigint, r double, z double"


def _update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    first, last, n, s1, s2, s3, s4, lag = state.get if state.exists else (None, None, 0, 0.0, 0.0, 0.0, 0.0, 0.0)
    for frame in frames:
        for v in frame.sort_values("seq")["value"]:
            v = float(v)
            first = v if n == 0 else first
            lag += 0.0 if n == 0 else last * v
            n, s1, s2, s3, s4, last = n + 1, s1 + v, s2 + v * v, s3 + v**3, s4 + v**4, v
    state.update((first, last, n, s1, s2, s3, s4, lag))
    r = z = None
    if n >= 4:
        m = s1 / n
        c2 = s2 - n * m * m
        c4 = s4 - 4 * m * s3 + 6 * m * m * s2 - 3 * n * m**4
        if c2 > 1e-12 * max(s2, 1e-300):
            r = (lag + last * first - n * m * m) / c2
            var = ((c2 * c2 - c4) / (n - 1) + (c2 * c2 - 2 * c4) / ((n - 1) * (n - 2)) - c2 * c2 / (n - 1) ** 2) / (c2 * c2)
            z = (r + 1 / (n - 1)) / var**0.5 if var > 0 else None
    yield pd.DataFrame({"key": [key[0]], "n": [n], "r": [r], "z": [z]}).astype({"r": float, "z": float})


def incremental_aot(stream: DataFrame) -> DataFrame:
    """key, n, r, z after each micro-batch, from (key, seq, value); sums of powers are kept, so very large levels lose digits: centre values first."""
    return stream.groupBy("key").applyInPandasWithState(_update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
