"""Sliding-window covariates of a multichannel series.

Input: key..., channel, t (0, 1, 2 ... without gaps), value. Window t covers the look-back
[t, t + L); n = T - L - H + 1 windows exist per series. Features are computed per channel
and averaged over channels. A series too short for one window gives no rows, or an error
with strict.

The frames run over (key, channel). For a few very long series, `chunks` splits them into
overlapping pieces (a halo of L - 1 points), so no task holds a whole series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

Key = Sequence[str]
EPS = 1e-12
FEATURES = ("f_std", "f_range", "f_absdiff", "f_slope", "f_acf1", "f_drift", "f_spec_ent", "f_cross_corr", "f_last_dev", "f_kurtosis")
NATIVE = tuple(f for f in FEATURES if f not in ("f_spec_ent", "f_cross_corr"))


def chunked(df: DataFrame, seq_len: int, size: int) -> DataFrame:
    """Rows with chunk and own: a point also belongs, as halo, to the chunk before if a window there reaches it."""
    c = F.floor(F.col("t") / size).cast("bigint")
    back = F.when((F.col("t") % size < seq_len - 1) & (c > 0), F.array(c, c - 1)).otherwise(F.array(c))
    rows = df.withColumn("_c", c).withColumn("_chunk", F.explode(back))
    return rows.withColumn("_own", F.col("_c") == F.col("_chunk")).drop("_c")


def channel_features(series: DataFrame, key: Key, seq_len: int, pred_len: int, chunks: int | None = None) -> DataFrame:
    """key..., channel, window_origin and the eight single-channel features; one shuffle, JVM expressions only."""
    length = int(seq_len)
    rows = series
    split = []
    if chunks:
        rows, split = chunked(series, length, max(chunks, length)), ["_chunk"]
    ends = series.groupBy(*key, "channel").agg(F.max("t").alias("_t_max"))
    by = Window.partitionBy(*key, "channel", *split).orderBy("t")
    fr, f1 = by.rowsBetween(0, length - 1), by.rowsBetween(0, length - 2)
    half = length // 2
    # values are taken from the window's first one, which keeps sums of large levels exact enough
    v, t = F.col("value"), F.col("t").cast("double")
    nxt = F.lead("value").over(by)
    rows = rows.withColumn("_nxt", nxt)
    mean, sd, var = F.avg(v).over(fr), F.stddev_pop(v).over(fr), F.var_pop(v).over(fr)
    m = "_mean"
    rows = rows.withColumn(m, mean).withColumn("_sd", sd).withColumn("_var", var)
    rows = rows.withColumn("f_std", F.col("_sd")).withColumn("f_range", F.max(v).over(fr) - F.min(v).over(fr))
    rows = rows.withColumn("f_absdiff", F.avg(F.abs(F.col("_nxt") - v)).over(f1))
    rows = rows.withColumn("f_slope", F.covar_pop(v, t).over(fr) / (F.stddev_pop(t).over(fr) + EPS))
    cross = F.sum(v * F.col("_nxt")).over(f1) - F.col(m) * (F.sum(v).over(f1) + F.sum("_nxt").over(f1)) + (length - 1) * F.col(m) * F.col(m)
    rows = rows.withColumn("f_acf1", cross / (length * F.col("_var") + EPS))
    late, early = F.avg(v).over(by.rowsBetween(half, length - 1)), F.avg(v).over(by.rowsBetween(0, half - 1))
    rows = rows.withColumn("f_drift", F.abs(late - early) / (F.col("_sd") + EPS))
    rows = rows.withColumn("f_last_dev", F.abs(F.lead(v, length - 1).over(by) - F.col(m)) / (F.col("_sd") + EPS))
    rows = rows.withColumn("f_kurtosis", F.when(F.col("_var") > 0, F.kurtosis(v).over(fr) + 3).otherwise(0.0))
    if split:
        rows = rows.where("_own")
    whole = rows.join(ends, [*key, "channel"]).where(F.col("t") <= F.col("_t_max") - length - int(pred_len) + 1)
    return whole.select(*key, "channel", F.col("t").alias("window_origin"), *NATIVE)


def cross_correlation(series: DataFrame, key: Key, seq_len: int, pred_len: int, chunks: int | None = None) -> DataFrame:
    """key..., window_origin, f_cross_corr: mean over channel pairs of |correlation|; series with one channel have no rows here (0 by definition)."""
    a = series.select(*key, "t", F.col("channel").alias("a"), F.col("value").alias("x"))
    b = series.select(*key, "t", F.col("channel").alias("b"), F.col("value").alias("y"))
    pairs = a.join(b, [*key, "t"]).where("a < b")
    last = series.groupBy(*key, "channel").agg(F.max("t").alias("_e"))
    last = last.select(*key, F.col("channel").alias("a"), "_e").join(last.select(*key, F.col("channel").alias("b"), F.col("_e").alias("_e2")), list(key)).where("a < b").select(*key, "a", "b", F.least("_e", "_e2").alias("_e"))
    pairs, split = (chunked(pairs, int(seq_len), max(chunks, int(seq_len))), ["_chunk"]) if chunks else (pairs.withColumn("_own", F.lit(True)), [])
    fr = Window.partitionBy(*key, "a", "b", *split).orderBy("t").rowsBetween(0, int(seq_len) - 1)
    c = F.abs(F.covar_pop("x", "y").over(fr)) / (F.stddev_pop("x").over(fr) * F.stddev_pop("y").over(fr) + EPS)
    rows = pairs.withColumn("c", c).where("_own").join(last, [*key, "a", "b"]).where(F.col("t") <= F.col("_e") - int(seq_len) - int(pred_len) + 1)
    return rows.groupBy(*key, F.col("t").alias("window_origin")).agg(F.avg("c").alias("f_cross_corr"))


@F.pandas_udf(DoubleType())
def spectral_entropy(windows: pd.Series) -> pd.Series:
    """Normalised entropy of the power spectrum without its constant term; Spark has no FFT."""
    if not len(windows):
        return pd.Series([], dtype=float)
    x = np.stack(windows.to_numpy())
    power = np.abs(np.fft.rfft(x - x.mean(1, keepdims=True), axis=1))[:, 1:] ** 2
    p = power / (power.sum(1, keepdims=True) + EPS)
    return pd.Series(-(p * np.log(p + EPS)).sum(1) / np.log(max(p.shape[1], 2)))


def spectral(series: DataFrame, key: Key, seq_len: int, pred_len: int, chunks: int | None = None) -> DataFrame:
    """key..., window_origin, f_spec_ent of the channels' mean series."""
    mean = series.groupBy(*key, "t").agg(F.avg("value").alias("value"))
    last = mean.groupBy(*key).agg(F.max("t").alias("_e"))
    rows, split = (chunked(mean, int(seq_len), max(chunks, int(seq_len))), ["_chunk"]) if chunks else (mean.withColumn("_own", F.lit(True)), [])
    by = Window.partitionBy(*key, *split).orderBy("t")
    rows = rows.withColumn("w", F.collect_list("value").over(by.rowsBetween(0, int(seq_len) - 1))).where("_own").join(last, list(key))
    rows = rows.where(F.col("t") <= F.col("_e") - int(seq_len) - int(pred_len) + 1)
    return rows.select(*key, F.col("t").alias("window_origin"), spectral_entropy("w").alias("f_spec_ent"))


def window_features(series: DataFrame, key: Key, seq_len: int, pred_len: int, strict: bool = False, chunks: int | None = None) -> DataFrame:
    """key..., window_origin and all ten features."""
    if strict:
        short = series.groupBy(*key, "channel").agg(F.count("*").alias("n")).where(F.col("n") < seq_len + pred_len).limit(1).count()
        if short:
            raise ValueError(f"a series is too short for look-back {seq_len} and horizon {pred_len}")
    own = channel_features(series, key, seq_len, pred_len, chunks).groupBy(*key, "window_origin").agg(*[F.avg(f).alias(f) for f in NATIVE])
    at = [*key, "window_origin"]
    out = own.join(spectral(series, key, seq_len, pred_len, chunks), at).join(cross_correlation(series, key, seq_len, pred_len, chunks), at, "left")
    return out.withColumn("f_cross_corr", F.coalesce("f_cross_corr", F.lit(0.0))).select(*at, *FEATURES)


def feature_index(features: DataFrame, key: Key) -> DataFrame:
    """key..., n: the windows of each table."""
    return features.groupBy(*key).agg(F.count("*").alias("n"))


def forecaster_errors(series: DataFrame, key: Key, seq_len: int, pred_len: int, chunks: int | None = None) -> DataFrame:
    """key..., arm, pos, value: per-window squared error of four closed-form forecasters (last value, mean, exponentially weighted mean, first values of the window)."""
    length, horizon = int(seq_len), int(pred_len)
    rows, split = (chunked(series, length + horizon, max(chunks, length + horizon)), ["_chunk"]) if chunks else (series.withColumn("_own", F.lit(True)), [])
    by = Window.partitionBy(*key, *split).orderBy("t")
    rows = rows.withColumn("w", F.collect_list("value").over(by.rowsBetween(0, length + horizon - 1))).where(F.col("_own") & (F.size("w") == length + horizon))
    look, target = F.slice("w", 1, length), F.slice("w", length + 1, horizon)
    weights = [0.5 ** ((length - 1 - i) / (length / 2)) for i in range(length)]
    dot = F.aggregate(F.zip_with(look, F.array(*[F.lit(x) for x in weights]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    level = {"last": F.element_at(look, -1), "mean": F.aggregate(look, F.lit(0.0), lambda s, x: s + x) / length, "ewma": dot / sum(weights)}
    mse = lambda f: F.aggregate(target, F.lit(0.0), lambda s, x: s + (x - f) * (x - f)) / horizon
    season = F.aggregate(F.zip_with(target, F.slice("w", 1, horizon), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / horizon
    arms = F.array(*[F.struct(F.lit(k).alias("arm"), mse(v).alias("value")) for k, v in level.items()], F.struct(F.lit("seasonal").alias("arm"), season.alias("value")))
    return rows.select(*key, F.col("t").alias("pos"), F.explode(arms).alias("a")).select(*key, "a.arm", "pos", "a.value")


def revin(series: DataFrame, key: Key, value: str = "value", eps: float = 1e-5, affine: DataFrame | None = None, channel: str = "channel") -> DataFrame:
    """Value normalised within each key (a window and channel), with the mean and scale that undo it; affine (channel, weight, bias), a row per channel, is applied after."""
    w = Window.partitionBy(*key)
    rows = series.withColumn("mean", F.avg(value).over(w)).withColumn("scale", F.sqrt(F.var_pop(value).over(w) + eps))
    rows = rows.withColumn("normalised", (F.col(value) - F.col("mean")) / F.col("scale"))
    if affine is None:
        return rows
    return rows.join(affine.select(channel, "weight", "bias"), channel).withColumn("normalised", F.col("normalised") * F.col("weight") + F.col("bias"))


def revin_inverse(df: DataFrame, value: str = "normalised", eps: float = 1e-5) -> DataFrame:
    """value from the normalised one; where the rows hold weight and bias, those are undone first, a weight kept off zero by eps squared."""
    v = F.col(value)
    if {"weight", "bias"} <= set(df.columns):
        v = (v - F.col("bias")) / (F.col("weight") + eps * eps)
    return df.withColumn("value", v * F.col("scale") + F.col("mean"))


def align_channels(df: DataFrame, wanted: Sequence[int], channel: str = "channel") -> DataFrame:
    """U4: rows of the wanted channels, numbered in the wanted order; the plan fails where one has no rows."""
    names = df.sparkSession.createDataFrame([(int(c), i) for i, c in enumerate(wanted)], f"{channel} int, _at int")
    seen = df.select(F.col(channel).cast("int").alias(channel)).distinct()
    missing = names.join(seen, channel, "left_anti").agg(F.count("*").alias("_missing"))
    rows = df.join(F.broadcast(names), channel).crossJoin(F.broadcast(missing))  # a row per channel asked for, and one row
    at = F.when(F.col("_missing") == 0, F.col("_at")).otherwise(F.raise_error(F.lit("a channel has no rows")).cast("int"))
    return rows.withColumn(channel, at).drop("_at", "_missing")


def slice_length(seq_len: int) -> int:
    return max(4, min(24, seq_len // 3))


SPREAD_EPS = 1e-5
SPREAD_FLOOR = 0.1


def slice_statistics(windows: DataFrame, key: Key, seq_len: int, length: int | None = None) -> DataFrame:
    """Windows (key..., k from 0, value): key..., slice, mean, sd of whole slices aligned to the window's end; sd is a tenth of the window's at least."""
    p = length or slice_length(seq_len)
    pad = seq_len % p
    window_sd = F.sqrt(F.var_pop("value").over(Window.partitionBy(*key)) + SPREAD_EPS)
    rows = windows.withColumn("_sd", window_sd).where(F.col("k") >= pad).withColumn("slice", F.floor((F.col("k") - pad) / p).cast("int"))
    g = rows.groupBy(*key, "slice").agg(F.avg("value").alias("mean"), F.sqrt(F.var_pop("value") + SPREAD_EPS).alias("sd"), F.max("_sd").alias("_sd"))
    return g.withColumn("sd", F.greatest("sd", SPREAD_FLOOR * F.col("_sd"))).drop("_sd")


def slice_forecast(slices: DataFrame, key: Key) -> DataFrame:
    """Key..., mean, sd expected of the future: weights halve every half of the K slices; spreads are averaged as logarithms."""
    k = F.max("slice").over(Window.partitionBy(*key)) + 1
    w = F.pow(F.lit(0.5), (F.col("_k") - 1 - F.col("slice")) / (F.col("_k") / 2))
    rows = slices.withColumn("_k", k).withColumn("_w", w)
    mean = lambda c: F.sum(c * F.col("_w")) / F.sum("_w")
    return rows.groupBy(*key).agg(mean(F.col("mean")).alias("mean"), F.exp(F.greatest(F.lit(-8.0), F.least(F.lit(8.0), mean(F.ln("sd"))))).alias("sd"))


def slice_trend(slices: DataFrame, key: Key, ahead: int, penalty: float = 1.0) -> DataFrame:
    """key..., slice (the next `ahead` ones), mean: a penalised line through the slice means, kept within the observed span on either side of it. The negative control of slice_forecast."""
    g = slices.groupBy(*key).agg(F.avg("mean").alias("_y"), F.avg("slice").alias("_x"), (F.covar_pop("slice", "mean") * F.count("*")).alias("_sxy"), (F.var_pop("slice") * F.count("*")).alias("_sxx"), F.min("mean").alias("_lo"), F.max("mean").alias("_hi"), F.max("slice").alias("_last"))
    rows = g.withColumn("slice", F.explode(F.sequence(F.col("_last") + 1, F.col("_last") + ahead)))
    line = F.col("_y") + F.col("_sxy") / (F.col("_sxx") + penalty) * (F.col("slice") - F.col("_x"))
    span = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-6))
    return rows.select(*key, "slice", F.greatest(F.col("_lo") - span, F.least(F.col("_hi") + span, line)).alias("mean"))


def slice_normalise(windows: DataFrame, key: Key, seq_len: int, length: int | None = None) -> DataFrame:
    """Windows with normalised: each value by its slice; the remainder before the first whole slice goes by the first."""
    p = length or slice_length(seq_len)
    at = F.floor(F.greatest(F.col("k") - seq_len % p, F.lit(0)) / p).cast("int")
    stats = slice_statistics(windows, key, seq_len, p).withColumnRenamed("mean", "_m").withColumnRenamed("sd", "_s")
    return windows.withColumn("slice", at).join(stats, [*key, "slice"]).withColumn("normalised", (F.col("value") - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def slice_denormalise(forecast: DataFrame, expected: DataFrame, key: Key) -> DataFrame:
    """forecast (key..., step, normalised) with value, by the statistics expected of the future."""
    return forecast.join(expected, list(key)).withColumn("value", F.col("normalised") * F.col("sd") + F.col("mean")).drop("mean", "sd")


def lag_pairs(df: DataFrame, key: Key, value: str = "value") -> DataFrame:
    """Key..., pos, a value and the next one."""
    return df.withColumn("following", F.lead(value).over(Window.partitionBy(*key).orderBy("pos"))).where("following is not null").select(*key, "pos", value, "following")


def ridge_slope(df: DataFrame, key: Key, x: str, y: str, penalty: float = 1.0) -> DataFrame:
    """key..., slope, intercept of y on x with a penalty on the slope, from moments in one aggregation."""
    g = df.groupBy(*key).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), (F.covar_pop(x, y) * F.count("*")).alias("sxy"), (F.var_pop(x) * F.count("*")).alias("sxx"))
    g = g.withColumn("slope", F.col("sxy") / (F.col("sxx") + penalty))
    return g.select(*key, "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"))


def frequency_loss(df: DataFrame, key: Key, alpha: float = 0.5, root_h: bool = False) -> DataFrame:
    """Rows (key..., step, pred, true) of one window: key..., loss = (1 - alpha) MSE + alpha mean |FFT difference| (over the root of the number of frequencies with root_h)."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie between 0 and 1")

    @F.pandas_udf("double")
    def loss(diff: pd.Series) -> pd.Series:
        def one(d) -> float:
            f = np.abs(np.fft.rfft(np.asarray(d, float)))
            return (1 - alpha) * float(np.mean(np.square(d))) + alpha * float(f.mean()) / (np.sqrt(len(d) // 2 + 1) if root_h else 1.0)

        return diff.map(one).astype(float)

    d = F.transform(F.array_sort(F.collect_list(F.struct("step", (F.col("pred") - F.col("true")).alias("d")))), lambda s: s["d"])
    return df.groupBy(*key).agg(d.alias("d")).select(*key, loss("d").alias("loss"))
