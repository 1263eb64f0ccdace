"""Permutations, block shuffles, resampling and relabelling of ordered vectors.

A permutation is a table (key..., pos, src_pos): position pos receives what stood at
src_pos. Random orders come from md5 of a seed and the position, so every engine and every
retry gives the same one. Vectors are named by `key` columns; `pos` runs from 0 in each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriata.functions.columns import order_key

Key = Sequence[str]


def _by(key: Key, *order) -> Window:
    return Window.partitionBy(*key).orderBy(*order)


def with_pos(df: DataFrame, key: Key, *order) -> DataFrame:
    """df with pos from 0 in the given order of each key."""
    return df.withColumn("pos", (F.row_number().over(_by(key, *order)) - 1).cast("bigint"))


def full_permutation(df: DataFrame, key: Key, seed: object) -> DataFrame:
    """Key..., pos, src_pos, uniformly shuffled within each key. The key takes part in the hash, so keys get independent orders."""
    h = order_key(seed, *[F.col(k) for k in key], F.col("pos"))
    return df.select(*key, F.col("pos").alias("src_pos"), h.alias("_h")).withColumn("pos", (F.row_number().over(_by(key, "_h", "src_pos")) - 1).cast("bigint")).select(*key, "pos", "src_pos")


def with_pos_spread(df: DataFrame, key: Key, *order: str, buckets: int = 4096) -> DataFrame:
    """with_pos for keys of any size: ranges of the first order column (numeric or time) are counted, numbered within, and shifted by what lies before, so one key's rows spread over as many tasks as ranges. One running sum holds a row per key and range."""
    first = F.col(order[0])
    number = first.cast("timestamp").cast("double") if dict(df.dtypes)[order[0]].startswith(("timestamp", "date")) else first.cast("double")
    ends = df.groupBy(*key).agg(F.min(number).alias("_lo"), F.max(number).alias("_hi"))
    rows = df.join(ends, list(key))
    width = (F.col("_hi") - F.col("_lo")) / buckets
    rows = rows.withColumn("_bucket", F.coalesce(F.when(width > 0, F.floor((number - F.col("_lo")) / F.when(width > 0, width))), F.lit(-1)).cast("int")).drop("_lo", "_hi")
    at = [*key, "_bucket"]
    counts = rows.groupBy(*at).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(_by(key, "_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).drop("_n")
    own = F.row_number().over(Window.partitionBy(*at).orderBy(*order)) - 1
    return rows.withColumn("_own", own).join(counts, at).withColumn("pos", (F.col("_own") + F.col("_before")).cast("bigint")).drop("_own", "_before", "_bucket")


def full_permutation_spread(df: DataFrame, key: Key, seed: object) -> DataFrame:
    """full_permutation for keys of any size, the same orders: the hash is numbered by its ranges."""
    h = order_key(seed, *[F.col(k) for k in key], F.col("pos"))
    rows = df.select(*key, F.col("pos").alias("src_pos"), h.alias("_h")).withColumn("_x", F.conv(F.substring("_h", 1, 13), 16, 10).cast("double"))
    return with_pos_spread(rows, key, "_x", "_h", "src_pos").select(*key, "pos", "src_pos")


def block_permutation(df: DataFrame, key: Key, block: int, seed: object) -> DataFrame:
    """R2: whole blocks of `block` positions change places; the last may be short; blocks stay intact."""
    b = F.floor(F.col("pos") / block).cast("bigint")
    rows = df.select(*key, F.col("pos").alias("src_pos"), b.alias("_b"))
    rows = rows.withColumn("_h", order_key(seed, *[F.col(k) for k in key], F.col("_b")))
    return rows.withColumn("pos", (F.row_number().over(_by(key, "_h", "_b", "src_pos")) - 1).cast("bigint")).select(*key, "pos", "src_pos")


def partial_permutation(df: DataFrame, key: Key, fraction: float, seed: object) -> DataFrame:
    """round(fraction n) positions (half to even) change places among themselves; fewer than two: nothing moves."""
    cols = [F.col(k) for k in key]
    rows = df.select(*key, F.col("pos").alias("src_pos")).withColumn("_h", order_key(f"{seed}/pick", *cols, F.col("src_pos"))).withColumn("_g", order_key(f"{seed}/move", *cols, F.col("src_pos")))
    m = F.bround(F.count("*").over(Window.partitionBy(*key)) * F.lit(float(fraction)))
    picked = (F.row_number().over(_by(key, "_h", "src_pos")) <= m) & (m >= 2)
    rows = rows.withColumn("_picked", picked)
    sources = rows.where("_picked").withColumn("_k", F.row_number().over(_by(key, "_g", "src_pos"))).select(*key, "_k", "src_pos")
    places = rows.where("_picked").withColumn("_k", F.row_number().over(_by(key, "src_pos"))).select(*key, "_k", F.col("src_pos").alias("pos"))
    moved = places.join(sources, [*key, "_k"]).select(*key, "pos", "src_pos")
    still = rows.where("not _picked").select(*key, F.col("src_pos").alias("pos"), "src_pos")
    return moved.unionByName(still)


def apply_permutation(df: DataFrame, perm: DataFrame, key: Key) -> DataFrame:
    """Df with pos as the permutation places it; an equi-join on (key, pos)."""
    return df.withColumnRenamed("pos", "src_pos").join(perm, [*key, "src_pos"]).select(*key, "pos", *[c for c in df.columns if c not in (*key, "pos")])


def bijection_violations(perm: DataFrame, key: Key, index: str = "src_pos") -> DataFrame:
    """Keys whose index is not a bijection of 0..n-1, with n, distinct values, least and greatest; one partial and one final aggregation."""
    a = perm.groupBy(*key).agg(F.count("*").alias("n"), F.countDistinct(index).alias("distinct"), F.min(index).alias("low"), F.max(index).alias("high"))
    return a.where("n != distinct or low != 0 or high != n - 1 or low is null")


def unpermute(recorded: DataFrame, perm: DataFrame, key: Key) -> DataFrame:
    """recorded[pos] belongs to src_pos; gives it that position. The returned plan fails where perm is no bijection of the vector's positions."""
    bad = bijection_violations(perm, key).agg(F.count("*").alias("bad"))
    sizes = recorded.groupBy(*key).count().withColumnRenamed("count", "a").join(perm.groupBy(*key).count().withColumnRenamed("count", "b"), list(key), "full").agg(F.coalesce(F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), 0).otherwise(1)), F.lit(0)).alias("sizes"))
    guard = bad.crossJoin(sizes)  # one row
    out = recorded.join(perm, [*key, "pos"]).crossJoin(F.broadcast(guard))
    checked = F.when((F.col("bad") == 0) & (F.col("sizes") == 0), F.col("src_pos")).otherwise(F.raise_error(F.lit("unpermute: the order is not a bijection of the vector's positions")).cast("bigint"))
    return out.withColumn("pos", checked).select(*recorded.columns)


def replicates(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("replicate"))


def moving_block_indices(lengths: DataFrame, key: Key, draws: DataFrame, seed: object) -> DataFrame:
    """Lengths (key..., n, block_len) and draws (replicate) -> key..., replicate, pos, src_pos: circular moving-block bootstrap, ceil(n / b) uniform starts, cut to n."""
    rows = lengths.crossJoin(F.broadcast(draws))  # replicates are a parameter
    rows = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("block_len")).cast("int") - 1)))
    h = order_key(seed, *[F.col(k) for k in key], F.col("replicate"), F.col("_b"))
    start = F.pmod(F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint"), F.col("n"))
    rows = rows.withColumn("_start", start).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("block_len").cast("int") - 1)))
    pos = F.col("_b") * F.col("block_len") + F.col("_k")
    return rows.withColumn("pos", pos.cast("bigint")).where("pos < n").select(*key, "replicate", "pos", ((F.col("_start") + F.col("_k")) % F.col("n")).cast("bigint").alias("src_pos"))


def circular_block_permutation(df: DataFrame, key: Key, block: int, seed: object) -> DataFrame:
    """A random circular shift, then whole blocks change places."""
    n = F.count("*").over(Window.partitionBy(*key))
    shift = F.pmod(F.conv(F.substring(order_key(f"{seed}/shift", *[F.col(k) for k in key]), 1, 15), 16, 10).cast("bigint"), F.col("_n"))
    rolled = df.select(*key, F.col("pos").alias("_src")).withColumn("_n", n).withColumn("pos", F.pmod(F.col("_src") + shift, F.col("_n")))
    perm = block_permutation(rolled.select(*key, "pos"), key, block, seed)
    return perm.withColumnRenamed("src_pos", "_mid").join(rolled.select(*key, F.col("pos").alias("_mid"), F.col("_src").alias("src_pos")), [*key, "_mid"]).select(*key, "pos", "src_pos")


def rotate(df: DataFrame, key: Key, k: int) -> DataFrame:
    """Every entry moves k places on, around the end."""
    return df.withColumn("pos", F.pmod(F.col("pos") + k, F.count("*").over(Window.partitionBy(*key))))


SHARING = ("intact", "independent", "all_shared", "shared_k3", "shared_k2", "two_pairs")


def sharing_label(condition: str, arm_index: Column) -> Column:
    """Which permutation an arm gets; arms with equal labels share one, null: none. two_pairs needs four arms."""
    if condition == "intact":
        return F.lit(None).cast("int")
    if condition == "independent":
        return arm_index.cast("int")
    if condition == "all_shared":
        return F.lit(0)
    if condition == "shared_k3":
        return F.greatest(F.lit(0), arm_index - 2).cast("int")
    if condition == "shared_k2":
        return F.greatest(F.lit(0), arm_index - 1).cast("int")
    if condition == "two_pairs":
        return F.floor(arm_index / 2).cast("int")
    raise ValueError(f"unknown sharing condition {condition!r}")


def shuffled(df: DataFrame, key: Key, seed: object) -> DataFrame:
    """df in the order of full_permutation, without a join: each row finds its own place."""
    h = order_key(seed, *[F.col(k) for k in key], F.col("pos"))
    moved = df.withColumn("_h", h).withColumn("_to", (F.row_number().over(_by(key, "_h", "pos")) - 1).cast("bigint"))
    return moved.withColumn("pos", F.col("_to")).select(*df.columns)


def inject_sharing(arms: DataFrame, group: Key, condition: str, seed: object) -> DataFrame:
    """arms (group..., arm, pos, value) with each arm's values permuted by the order that its label names within its group."""
    return inject_conditions(arms, group, [condition], seed).drop("condition")


def inject_conditions(arms: DataFrame, group: Key, conditions: Sequence[str], seed: object) -> DataFrame:
    """inject_sharing for several conditions at once, with a condition column.

    Arms of one label share positions and hashes, so a position's rank among the distinct
    ones is its place: one window for all conditions and no join."""
    index = F.dense_rank().over(Window.partitionBy(*group).orderBy("arm")) - 1
    rows = arms.withColumn("_index", index).withColumn("condition", F.explode(F.array(*[F.lit(c) for c in conditions])))
    label = F.coalesce(*[F.when(F.col("condition") == c, sharing_label(c, F.col("_index"))) for c in conditions])
    key = ["condition", *group, "_label"]
    rows = rows.withColumn("_label", label)
    rows = rows.withColumn("_h", F.md5(F.concat_ws("|", F.concat(F.lit(f"{seed}/"), "condition"), *[F.col(k).cast("string") for k in group], F.col("_label").cast("string"), F.col("pos").cast("string"))))
    place = F.when(F.col("_label").isNull(), F.col("pos")).otherwise(F.dense_rank().over(_by(key, "_h", "pos")) - 1)
    return rows.withColumn("_to", place.cast("bigint")).withColumn("pos", F.col("_to")).select(*arms.columns, "condition")


def strided(df: DataFrame, strides: Sequence[int], pos: str = "pos") -> DataFrame:
    """The rows whose position each stride divides, with stride; one pass over df."""
    return df.withColumn("stride", F.explode(F.array(*[F.lit(int(s)) for s in strides]))).where(F.col(pos) % F.col("stride") == 0)


def overlap_ratio(stride: Column, seq_len: int, pred_len: int) -> Column:
    return F.greatest(F.lit(0.0), 1 - stride / F.lit(float(seq_len + pred_len)))


def least_disjoint_stride(strides: Sequence[int], seq_len: Column, pred_len: Column) -> Column:
    """The smallest of the strides at which neighbouring windows share no point; NULL if none is."""
    return F.array_min(F.filter(F.array(*[F.lit(int(s)) for s in strides]), lambda s: s >= seq_len + pred_len))


def subsample(df: DataFrame, n: int, seed: object, *unique: str) -> DataFrame:
    """N rows, the same on every run."""
    return df.withColumn("_h", order_key(seed, *[F.col(c) for c in unique])).orderBy("_h", *unique).limit(n).drop("_h")
