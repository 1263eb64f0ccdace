"""Order diagnostics: serial dependence of one vector (AOT) and rank agreement across arms (CAT).

Both tests' null is complete randomisation: p < alpha certifies a vector as ordered
(`reject` = 1); `flagged` = 1 - reject. Undefined statistics are NULL and never certify.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriata.functions.columns import indicator, stable_seed
from seriata.functions.draws import orders, seed_of
from seriata.functions.stats import normal_cdf, normal_isf, normal_sf_col

ALPHA = 0.05
Key = Sequence[str]


def lagged(df: DataFrame, key: Key, value: str = "value", pos: str = "pos") -> DataFrame:
    """Df with c (value less its mean) and nxt (the circular successor's c): one shuffle on the key."""
    whole = Window.partitionBy(*key)
    by = Window.partitionBy(*key).orderBy(pos)
    df = df.withColumn("c", F.col(value) - F.avg(value).over(whole))
    return df.withColumn("nxt", F.coalesce(F.lead("c").over(by), F.first("c").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))


def lagged_dense(df: DataFrame, key: Key, value: str = "value", pos: str = "pos") -> DataFrame:
    """The same for positions 0..n-1 by an equi-join on (key, pos): a vector of any length spreads over all tasks."""
    moments = df.groupBy(*key).agg(F.avg(value).alias("_m"), F.count("*").alias("_n"))
    c = df.join(moments, list(key)).withColumn("c", F.col(value) - F.col("_m")).drop("_m")
    before = c.select(*key, F.pmod(F.col(pos) - 1, F.col("_n")).alias(pos), F.col("c").alias("nxt"))
    return c.drop("_n").join(before, [*key, pos])


def aot_moments(df: DataFrame, key: Key, value: str = "value", pos: str = "pos", dense: bool = False) -> DataFrame:
    """key..., n, num, s2, s4: all that AOT needs, and the excess of the kurtosis."""
    rows = (lagged_dense if dense else lagged)(df, key, value, pos)
    return rows.groupBy(*key).agg(F.count(value).alias("n"), F.sum(F.col("c") * F.col("nxt")).alias("num"), F.sum(F.col("c") * F.col("c")).alias("s2"), F.sum(F.pow("c", F.lit(4.0))).alias("s4"))


def aot_statistics(m: DataFrame) -> DataFrame:
    """Moments -> n, r, null_mean, null_sd, z by the exact permutation moments. Below four values, or without spread: NULL."""
    n = F.col("n").cast("double")
    s2, s4 = F.col("s2"), F.col("s4")
    scale = F.col("s2") * F.col("s2")
    live = (F.col("n") >= 4) & (s2 > 1e-24 * F.greatest(n, F.lit(1.0)))
    var = ((scale - s4) / (n - 1) + (scale - 2 * s4) / ((n - 1) * (n - 2)) - scale / ((n - 1) * (n - 1))) / scale
    m = m.withColumn("r", F.when(live, F.col("num") / F.when(live, s2)))
    m = m.withColumn("null_mean", F.when(live, -1 / F.when(live, n - 1)))
    m = m.withColumn("_var", F.when(live, F.when(live, var)))
    m = m.withColumn("null_sd", F.when(F.col("_var") > 0, F.sqrt(F.when(F.col("_var") > 0, F.col("_var"))))).drop("_var")
    return m.withColumn("z", F.when(F.col("null_sd") > 0, (F.col("r") - F.col("null_mean")) / F.when(F.col("null_sd") > 0, F.col("null_sd")))).drop("num", "s2", "s4")


def aot(df: DataFrame, key: Key, value: str = "value", pos: str = "pos", dense: bool = False, alpha: float = ALPHA) -> DataFrame:
    """Key..., n, r, null_mean, null_sd, z, p, reject, flagged. p is computed after the aggregation, on a row per vector."""
    out = aot_statistics(aot_moments(df, key, value, pos, dense)).withColumn("p", normal_sf_col(F.col("z")))
    return out.withColumn("reject", indicator(F.col("p") < alpha)).withColumn("flagged", 1 - F.col("reject"))


def aot_certified(z: Column, alpha: float = ALPHA) -> Column:
    """reject without p: the normal tail is monotone, so z decides, in the JVM."""
    return indicator(z > F.lit(normal_isf(alpha)))


def aot_monte_carlo(df: DataFrame, key: Key, draws: int = 2000, seed: int = 0, value: str = "value", pos: str = "pos", chunk: int = 64) -> DataFrame:
    """key..., n, r, p_perm: share of shuffled copies with r at least as large. One vector at a time in memory; draws in chunks."""
    names = [*key, "n", "r", "p_perm"]

    def one(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values(pos)[value].to_numpy(float)
        r = circular_correlation(x)
        if r is None:
            return pd.DataFrame([[*k, len(x), None, None]], columns=names).astype({"r": float, "p_perm": float})
        c = x - x.mean()
        s2, own, hits = float((c * c).sum()), seed_of(seed, *k), 0
        for at in range(0, draws, chunk):
            m = c[orders(own, at, min(chunk, draws - at), len(c))]
            hits += int(((np.einsum("ij,ij->i", m[:, :-1], m[:, 1:]) + m[:, -1] * m[:, 0]) / s2 >= r - 1e-15).sum())
        return pd.DataFrame([[*k, len(x), r, (1 + hits) / (draws + 1)]], columns=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*key).schema)
    return df.groupBy(*key).applyInPandas(one, f"{fields}, n bigint, r double, p_perm double")


def circular_correlation(x: np.ndarray) -> float | None:
    c = x - x.mean() if len(x) else x
    s = float((c * c).sum())
    return float((c * np.roll(c, -1)).sum() / s) if len(x) >= 4 and s > 1e-24 * len(x) else None


def power_bound(rho: float, n: int, alpha: float = ALPHA) -> float:
    """T4."""
    return normal_cdf(rho * math.sqrt(n) - normal_isf(alpha))


def theory(spark, lengths: Sequence[int], alpha: float = ALPHA, power: float = 0.9) -> DataFrame:
    """T5/Q6: n, rho_min_detectable (size alpha, the given power), power_at_rho_0_5, power_at_rho_0_1."""
    reach = normal_isf(alpha) + normal_isf(1 - power)
    return spark.createDataFrame([(int(n), reach / math.sqrt(n), power_bound(0.5, n, alpha), power_bound(0.1, n, alpha)) for n in lengths], "n bigint, rho_min_detectable double, power_at_rho_0_5 double, power_at_rho_0_1 double")


def average_rank(value: str, key: Key) -> Column:
    """Ranks from 1, ties share their mean."""
    w = Window.partitionBy(*key)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*key, value)) - 1) / 2.0


def standardised_ranks(arms: DataFrame, group: Key, value: str = "value") -> DataFrame:
    """arms (group..., arm, pos, value) with u: average ranks, centred, of squared sum 1 within the arm; NULL for a constant arm."""
    key = [*group, "arm"]
    w = Window.partitionBy(*key)
    ranked = arms.withColumn("rank", average_rank(value, key))
    c = F.col("rank") - F.avg("rank").over(w)
    ranked = ranked.withColumn("c", c)
    s = F.sqrt(F.sum(F.col("c") * F.col("c")).over(w))
    return ranked.withColumn("u", F.when(s > 0, F.col("c") / F.when(s > 0, s))).drop("c", "rank")


def agreement(arms: DataFrame, group: Key, value: str = "value") -> DataFrame:
    """Group..., n_arms, n, rho_bar, z_corrected, z_naive: the mean of all pairs' rank correlations from one pass of squared sums, without a join of the arms."""
    u = standardised_ranks(arms, group, value)
    at = u.groupBy(*group, "pos").agg(F.sum("u").alias("s"), F.count("u").alias("k"), F.countDistinct("arm").alias("arms"))
    g = at.groupBy(*group).agg(F.max("arms").alias("n_arms"), F.count("*").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q"), F.min("k").alias("k_min"))
    k = F.col("n_arms").cast("double")
    live = (F.col("n_arms") >= 2) & (F.col("k_min") == F.col("n_arms")) & (F.col("n") >= 2)
    g = g.withColumn("rho_bar", F.when(live, (F.col("q") - k) / F.when(live, k * (k - 1))))
    g = g.withColumn("z_corrected", F.col("rho_bar") * F.sqrt(k * (k - 1) / 2 * (F.col("n") - 1))).withColumn("z_naive", F.col("rho_bar") * F.sqrt((F.col("n") - 1).cast("double")))
    return g.drop("q", "k_min")


def pairwise_spearman(arms: DataFrame, group: Key, value: str = "value") -> DataFrame:
    """Group..., arm_a, arm_b, rho, n for all pairs a < b: products of the standardised ranks at equal positions."""
    u = standardised_ranks(arms, group, value).select(*group, "arm", "pos", "u")
    b = u.select(*group, F.col("arm").alias("arm_b"), "pos", F.col("u").alias("u_b"))
    pairs = u.join(b, [*group, "pos"]).where("arm < arm_b")
    return pairs.groupBy(*group, F.col("arm").alias("arm_a"), "arm_b").agg(F.sum(F.col("u") * F.col("u_b")).alias("rho"), F.count("*").alias("n"))


def agreement_monte_carlo(arms: DataFrame, group: Key, draws: int = 2000, seed: int = 0, value: str = "value", chunk: int = 32) -> DataFrame:
    """group..., rho_bar, p, null_mean, null_sd: ranks are taken once and permuted, which preserves them. NULL for groups of one arm, of arms with gaps, and of constant arms."""
    names = [*group, "rho_bar", "p", "null_mean", "null_sd"]

    def one(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        m = rows.pivot(index="pos", columns="arm", values=value).to_numpy(float)
        r = pd.DataFrame(m).rank().to_numpy()
        r -= r.mean(0)
        size = np.sqrt((r * r).sum(0))
        n, a = r.shape
        if a < 2 or n < 2 or np.isnan(r).any() or not size.all():
            return pd.DataFrame([[*k, None, None, None, None]], columns=names).astype(dict.fromkeys(names[-4:], float))
        r /= size
        of = lambda total: ((total**2).sum(-1) - a) / (a * (a - 1))
        own, null = seed_of(seed, *k), []
        for at in range(0, draws, chunk):
            d = min(chunk, draws - at)
            o = orders(own, at * a, d * a, n).reshape(d, a, n)  # each arm of each draw its own order
            null.append(of(sum(r[o[:, j], j] for j in range(a))))
        null, rho = np.concatenate(null), float(of(r.sum(1)))
        return pd.DataFrame([[*k, rho, (1 + (null >= rho).sum()) / (draws + 1), null.mean(), null.std(ddof=1)]], columns=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in arms.select(*group).schema)
    return arms.groupBy(*group).applyInPandas(one, f"{fields}, rho_bar double, p double, null_mean double, null_sd double")


def tail_calibration(df: DataFrame, key: Key, draws: int, alphas: Sequence[float] = (1e-2, 1e-3, 1e-4, 1e-5, 1e-6), seed: int = 0, value: str = "value", chunk: int = 512, part: int = 31_250) -> DataFrame:
    """Key..., n, kurtosis, n_perm, alpha, n_reject, fpr_empirical, ratio_to_nominal, max_z: how often shuffled copies exceed the normal limits. A vector's draws go to tasks in parts of `part`, each with its own seed; the counts are summed."""
    limits = [normal_isf(a) for a in alphas]
    parts = max(1, -(-draws // part))
    names = [*key, "n", "kurtosis", "n_perm", "alpha", "n_reject", "max_z"]

    def one(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        *k, piece = k
        x = rows.sort_values("pos")[value].to_numpy(float)
        c = x - x.mean()
        n, s2, s4 = len(c), float((c**2).sum()), float((c**4).sum())
        if n < 4 or s2 <= 1e-24 * n:
            return pd.DataFrame([], columns=names)
        var = ((s2 * s2 - s4) / (n - 1) + (s2 * s2 - 2 * s4) / ((n - 1) * (n - 2)) - s2 * s2 / (n - 1) ** 2) / (s2 * s2)
        rng = np.random.default_rng(stable_seed(seed, *map(str, k), int(piece)))
        own = min(part, draws - int(piece) * part)
        hits, top = np.zeros(len(limits), int), -np.inf
        p = np.tile(c, (max(1, min(chunk, own, 4_000_000 // n)), 1))
        for at in range(0, own, len(p)):
            rng.permuted(p, axis=1, out=p)
            r = (p[:, :-1] * p[:, 1:]).sum(1) + p[:, -1] * p[:, 0]
            z = ((r / s2 + 1 / (n - 1)) / math.sqrt(var))[: own - at]
            hits += (z[:, None] > np.array(limits)).sum(0)
            top = max(top, float(z.max()))
        return pd.DataFrame([[*k, n, n * s4 / s2**2, own, a, int(h), top] for a, h in zip(alphas, hits)], columns=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*key).schema)
    pieces = F.broadcast(df.sparkSession.range(parts).select(F.col("id").alias("_part")))
    by = [*key, "_part"]
    # a fixed number of tasks: the rows are few, the draws are not
    counts = df.select(*key, "pos", value).crossJoin(pieces).repartition(parts, *by).groupBy(*by).applyInPandas(one, f"{fields}, n bigint, kurtosis double, n_perm bigint, alpha double, n_reject bigint, max_z double")
    out = counts.groupBy(*key, "alpha").agg(F.first("n").alias("n"), F.first("kurtosis").alias("kurtosis"), F.sum("n_perm").alias("n_perm"), F.sum("n_reject").alias("n_reject"), F.max("max_z").alias("max_z"))
    out = out.withColumn("fpr_empirical", F.col("n_reject") / F.col("n_perm")).withColumn("ratio_to_nominal", F.col("fpr_empirical") / F.col("alpha"))
    return out.select(*key, "n", "kurtosis", "n_perm", "alpha", "n_reject", "fpr_empirical", "ratio_to_nominal", "max_z")


def permutation_sharing(perms: DataFrame, group: Key) -> DataFrame:
    """Perms (group..., arm, pos, src_pos): group..., n_arms, n_distinct, identical_pairs, non_identity, sharing. Each order is compared through one digest, not position by position."""
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "src_pos"))), lambda s: s["src_pos"].cast("string")), ","), 256)
    arms = perms.groupBy(*group, "arm").agg(digest.alias("d"), F.max((F.col("pos") != F.col("src_pos")).cast("int")).alias("moved"))
    orders = arms.groupBy(*group, "d").agg(F.count("*").alias("c"), F.sum("moved").alias("moved"))
    g = orders.groupBy(*group).agg(F.sum("c").alias("n_arms"), F.count("*").alias("n_distinct"), F.sum(F.expr("c * (c - 1) div 2")).alias("identical_pairs"), F.sum("moved").alias("non_identity"))
    return g.withColumn("sharing", F.when(F.col("n_distinct") == 1, "all_identical").when(F.col("n_distinct") == F.col("n_arms"), "all_distinct").otherwise("partial_shared"))


def masking_check(a: DataFrame, b: DataFrame, key: Key, value: str = "value") -> DataFrame:
    """Key..., n_a, n_b, mean_rel_diff, multiset_equal: what a reordering leaves unchanged. Values are counted per side and joined, so no vector is sorted."""
    side = lambda d, n: d.groupBy(*key, F.col(value).alias("v")).agg(F.count("*").alias(n))
    both = side(a, "ca").join(side(b, "cb"), [*key, "v"], "full")
    ca, cb = F.coalesce("ca", F.lit(0)), F.coalesce("cb", F.lit(0))
    g = both.groupBy(*key).agg(F.sum(ca).alias("n_a"), F.sum(cb).alias("n_b"), F.sum(ca * F.col("v")).alias("sa"), F.sum(cb * F.col("v")).alias("sb"), F.max(F.abs(ca - cb)).alias("gap"))
    ma, mb = F.col("sa") / F.nullif(F.col("n_a"), F.lit(0)), F.col("sb") / F.nullif(F.col("n_b"), F.lit(0))
    return g.select(*key, "n_a", "n_b", (F.abs(mb - ma) / F.nullif(F.abs(ma), F.lit(0.0))).alias("mean_rel_diff"), (F.col("gap") == 0).alias("multiset_equal"))


def _cumulated(counts: DataFrame, key: Key, by: str, columns: Sequence[str], buckets: int = 1024) -> DataFrame:
    """counts (key..., by, columns) with the running and whole sums <c>_upto and <c>_all along `by`: sums within value ranges plus the totals of the ranges before, so one key's values spread over as many tasks as ranges."""
    ends = counts.groupBy(*key).agg(F.min(by).alias("_lo"), F.max(by).alias("_hi")) if key else counts.agg(F.min(by).alias("_lo"), F.max(by).alias("_hi"))
    rows = counts.join(ends, list(key)) if key else counts.crossJoin(F.broadcast(ends))  # without key: one row
    width = (F.col("_hi") - F.col("_lo")) / buckets
    rows = rows.withColumn("_bucket", F.when(width > 0, F.floor((F.col(by) - F.col("_lo")) / F.when(width > 0, width))).otherwise(0).cast("int")).drop("_lo", "_hi")
    at = [*key, "_bucket"]
    totals = rows.groupBy(*at).agg(*[F.sum(c).alias(f"_sum_{c}") for c in columns])
    whole = Window.partitionBy(*(key or [F.lit(0)]))
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*at, *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_pre_{c}") for c in columns], *[F.sum(f"_sum_{c}").over(whole).alias(f"{c}_all") for c in columns])
    inner = Window.partitionBy(*at).orderBy(by)
    rows = rows.join(totals, at).withColumns({f"{c}_upto": F.sum(c).over(inner) + F.col(f"_pre_{c}") for c in columns})
    return rows.drop("_bucket", *[f"_pre_{c}" for c in columns])


def ks_two_sample(a: DataFrame, b: DataFrame, value: str = "value", key: Key = ()) -> DataFrame:
    """Key..., d, n_a, n_b: largest gap of the two cumulative shares."""
    both = a.select(*key, F.col(value).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(*key, F.col(value).alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = both.where(F.col("v").isNotNull()).groupBy(*key, "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    rows = _cumulated(counts, key, "v", ["a", "b"])
    return rows.groupBy(*key).agg(F.max(F.abs(F.col("a_upto") / F.col("a_all") - F.col("b_upto") / F.col("b_all"))).alias("d"), F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))


def ks_one_sample(df: DataFrame, cdf: Callable[[Column], Column], value: str = "value", key: Key = ()) -> DataFrame:
    """Key..., d, n: largest gap between the values' cumulative share and cdf, on either side of each step."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*key, F.col(value).alias("v")).agg(F.count("*").alias("a"))
    rows = _cumulated(counts, key, "v", ["a"])
    f, upto = cdf(F.col("v")), F.col("a_upto") / F.col("a_all")
    return rows.groupBy(*key).agg(F.max(F.greatest(upto - f, f - (F.col("a_upto") - F.col("a")) / F.col("a_all"))).alias("d"), F.sum("a").alias("n"))
