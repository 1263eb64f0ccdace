"""Association of covariates with per-sample values, resampling inference, paired and equivalence tests."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriata.functions.columns import ceil_cube_root, finite, order_key
from seriata.functions.draws import integers, orders, seed_of
from seriata.functions.stats import normal_two_sided, signed_rank_exact, t_cdf, t_isf, t_isf_col, t_sf, t_sf_col
from seriata.operators.diagnose import average_rank

Key = Sequence[str]


def spearman(df: DataFrame, key: Key, x: str, y: str) -> DataFrame:
    """Key..., rho, n over rows where both are finite; NULL where either is constant."""
    rows = df.where(finite(F.col(x)) & finite(F.col(y)))
    rows = rows.withColumn("_x", average_rank(x, key)).withColumn("_y", average_rank(y, key))
    g = rows.groupBy(*key).agg(F.covar_pop("_x", "_y").alias("c"), F.stddev_pop("_x").alias("sx"), F.stddev_pop("_y").alias("sy"), F.count("*").alias("n"))
    live = F.col("sx") * F.col("sy") > 0
    return g.select(*key, F.when(live, F.col("c") / F.when(live, F.col("sx") * F.col("sy"))).alias("rho"), "n")


def association(df: DataFrame, key: Key, columns: Sequence[str], y: str, y_raw: str | None = None, main: str = "f_std") -> DataFrame:
    """Key..., rho_<column>, best correlation and its column, mean |rho|, z, naive p of `main`, and the ratio of the raw mean above main's 9th decile to that below its 1st.

    All columns are ranked in one long table, so there is one shuffle for them together."""
    raw = y_raw or y
    long = df.select(*key, y, F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s")).select(*key, y, "s.f", "s.x")
    per = spearman(long, [*key, "f"], "x", y)
    order = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("f"))
    g = per.groupBy(*key).agg(
        *[F.max(F.when(F.col("f") == c, F.col("rho"))).alias(f"rho_{c}") for c in columns],
        F.max_by(F.struct("rho", "f"), F.when(F.col("rho").isNotNull(), F.struct(F.abs("rho").alias("a"), (-order).alias("o")))).alias("best"),
        F.avg(F.abs("rho")).alias("assoc_abs_rho_mean"),
        F.max("n").alias("n"),
    )
    z = F.col(f"rho_{main}") * F.sqrt(F.greatest(F.col("n") - 1, F.lit(1)).cast("double"))
    g = g.withColumn("assoc_rho_best", F.col("best.rho")).withColumn("assoc_rho_best_feature", F.col("best.f")).drop("best").withColumn("assoc_z_fstd", z)
    return g.join(decile_ratio(df, key, main, raw).withColumnRenamed("decile_ratio", "decile_ratio_fstd"), list(key), "left") if key else g.crossJoin(decile_ratio(df, key, main, raw).withColumnRenamed("decile_ratio", "decile_ratio_fstd"))


def decile_ratio(df: DataFrame, key: Key, x: str, y: str) -> DataFrame:
    """Key..., decile_ratio: mean y where x is at or above its 9th decile over mean y at or below its 1st; NULL unless the latter is positive."""
    q = df.groupBy(*key).agg(F.percentile(x, 0.1).alias("_q1"), F.percentile(x, 0.9).alias("_q9"))
    rows = df.join(q, list(key)) if key else df.crossJoin(F.broadcast(q))
    g = rows.groupBy(*key).agg(F.avg(F.when(F.col(x) >= F.col("_q9"), F.col(y))).alias("hi"), F.avg(F.when(F.col(x) <= F.col("_q1"), F.col(y))).alias("lo"))
    return g.select(*key, F.when(F.col("lo") > 0, F.col("hi") / F.when(F.col("lo") > 0, F.col("lo"))).alias("decile_ratio"))


def with_naive_p(df: DataFrame, z: str = "assoc_z_fstd") -> DataFrame:
    """The p that treats overlapping windows as independent; for contrast only."""
    return df.withColumn("assoc_p_iid_naive", normal_two_sided(F.col(z)))


def block_length(n: Column, seq_len: Column, pred_len: Column) -> dict[str, Column]:
    """Block length for windows of stride 1: their span or the cube root of n, half of n at most."""
    cover, floor = (seq_len + pred_len).cast("bigint"), ceil_cube_root(n)
    want = F.greatest(cover, floor)
    used = F.greatest(F.lit(1).cast("bigint"), F.least(want, F.floor(n / 2)))
    return {"block_len": used, "block_len_requested": want, "block_len_cover": cover, "block_len_floor": floor, "block_len_capped": (used < want).cast("int"), "n_blocks": F.ceil(n / used)}


def _running_sums(a: np.ndarray) -> np.ndarray:
    """Cumulative sums down the rows, in place, by strips of rows: whole rows are added at a time."""
    n = len(a)
    size = max(1, math.isqrt(n))
    whole = n // size * size
    strips = a[:whole].reshape(-1, size, a.shape[1])
    for k in range(1, size):
        strips[:, k] += strips[:, k - 1]
    for k in range(1, len(strips)):
        strips[k] += strips[k - 1, -1]
    for k in range(whole, n):
        a[k] += a[k - 1]
    return a


class _Sorted:
    """The order of a vector's values: where each value's group of ties starts and ends in it."""

    def __init__(self, x: np.ndarray):
        self.order = np.argsort(x, kind="stable")
        v = x[self.order]
        new = np.append(True, v[1:] != v[:-1])
        self.starts = np.flatnonzero(new)
        self.ends = np.append(self.starts[1:], len(x))
        group = np.cumsum(new) - 1
        self.group_at = np.empty(len(x), np.intp)  # by position
        self.group_at[self.order] = group
        self.ranks = ((self.starts + self.ends + 1) / 2.0)[self.group_at]

    def weighted(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """w: how often each position (row) was drawn in each replicate (column). Twice the centred average ranks by position, and twice their sums of squares over the draws."""
        n = len(w)
        sums = np.empty((n + 1, w.shape[1]), w.dtype)
        sums[0] = 0
        np.take(w, self.order, axis=0, out=sums[1:])
        _running_sums(sums[1:])
        tied = len(self.starts) < n
        low, high = (sums[self.starts], sums[self.ends]) if tied else (sums[:-1], sums[1:])
        size = (high - low).astype(float) if tied else w  # without ties a group is a position, drawn 255 times at most or counted in doubles
        if not tied and w.max(initial=0) > 255:
            size = w.astype(float)
        cubes = (size * size * size).sum(0, dtype=float) - n
        return np.take(low + high - w.dtype.type(n), self.group_at, axis=0), (float(n) ** 3 - n - cubes) / 3


def _drawn(starts: np.ndarray, lengths: np.ndarray, n: int, dtype: type) -> np.ndarray:
    """(position, replicate): how often circular blocks from starts (replicate, block) cover each position."""
    c = len(starts)
    w = np.zeros((n, c), dtype)
    flat, ends, column = w.reshape(-1), starts + lengths, np.arange(c)[:, None]
    np.add.at(flat, (starts * c + column).ravel(), 1)
    inner = ends % n != 0
    np.add.at(flat, (ends % n * c + column)[inner], -1)
    w[0] += (ends > n).sum(1)
    return _running_sums(w)


def block_bootstrap(x: np.ndarray, y: np.ndarray, block: int, draws: int, seed: int, first: int = 0, chunk: int = 64) -> np.ndarray:
    """Rank correlations of circular moving-block resamples (draws number `first` on), the last block cut to the vector's length; NaN where a resample is constant.

    A resample is a count per position, so its ranks are running sums of counts in the order of the values: nothing is sorted or copied per draw."""
    n = len(x)
    sx, sy = _Sorted(x), _Sorted(y)
    blocks = -(-n // block)
    lengths = np.full(blocks, block)
    lengths[-1] = n - (blocks - 1) * block
    dtype = np.float32 if n < 1 << 22 else np.float64  # counts and twice the ranks are exact in either
    out = []
    for at in range(0, draws, chunk):
        w = _drawn(integers(seed, first + at, min(chunk, draws - at), blocks, n), lengths, n, dtype)
        (rx, xx), (ry, yy) = sx.weighted(w), sy.weighted(w)
        xy = np.einsum("ij,ij,ij->j", w, rx, ry, dtype=float) if n >= 1 << 22 else np.einsum("ij,ij->j", (w * rx).astype(float), ry)
        den = np.sqrt(np.maximum(xx, 0) * np.maximum(yy, 0))
        out.append(np.divide(xy, den, out=np.full(len(den), np.nan), where=den > 0))
    return np.concatenate(out) if out else np.empty(0)


def block_shuffles(ux: np.ndarray, uy: np.ndarray, block: int, draws: int, seed: int, first: int = 0, most: int = 1 << 25) -> np.ndarray:
    """Sums of products of ux with uy turned by a random shift and then cut into blocks that change places.

    A sum is made of one product sum per block, which depends on where the block lands and on
    which piece of uy it holds. Those are tabled for all shifts by Fourier transforms; where
    the table would pass `most` numbers, each draw is summed by itself."""
    n = len(ux)
    cuts = np.arange(0, n, block)
    k = len(cuts)
    last = n - (k - 1) * block
    placed = orders(seed, first, draws, k)
    shifts = integers(seed + 1, first, draws, 1, n)[:, 0]
    place = np.argmax(placed == k - 1, axis=1)[:, None]  # of the short block
    i = np.arange(k)
    target = i * block - np.where(i > place, block - last, 0)
    if 3 * k * n > most:
        around, lengths = np.tile(uy, 2), np.minimum(cuts + block, n) - cuts
        dots = []
        for o, s in zip(placed, shifts):
            size = lengths[o]
            dots.append(around[np.repeat(cuts[o] - np.cumsum(size) + size, size) + np.arange(n) + s] @ ux)
        return np.array(dots)
    pieces = np.zeros((3 * k, n))  # of ux: whole blocks before the short one, after it, and the short one, by place
    for j in range(k):
        pieces[j, : min(block, n - j * block)] = ux[j * block : j * block + block]
        if j:
            a = j * block - (block - last)
            pieces[k + j, : min(block, n - a)] = ux[a : a + block]
        pieces[2 * k + j, :last] = ux[j * block : j * block + last]
    table = np.fft.irfft(np.conj(np.fft.rfft(pieces)) * np.fft.rfft(uy), n)
    row = i + np.where(i > place, k, 0) + np.where(i == place, 2 * k, 0)
    return table[row, (cuts[placed] + shifts[:, None]) % n].sum(1)


_DEP_AWARE = "n bigint, assoc_rho double, ci_lo double, ci_hi double, ci_excludes_zero int, p_block double, p_boot_2sided double, boot_rho_mean double, block_len bigint, n_blocks bigint, n_boot bigint, n_perm bigint"


def _dep_aware_row(n: int, rho: float, boot: np.ndarray, null: np.ndarray, block: int) -> list:
    boot, null = boot[np.isfinite(boot)], null[np.isfinite(null)]
    lo, hi = np.percentile(boot, [2.5, 97.5]) if len(boot) else (np.nan, np.nan)
    side = 2 * min((boot <= 0).mean(), (boot >= 0).mean()) if len(boot) else np.nan
    p = (1 + (np.abs(null) >= abs(rho)).sum()) / (len(null) + 1)
    return [n, rho, lo, hi, int(bool(lo * hi > 0)), p, max(side, 1 / max(len(boot), 1)), boot.mean() if len(boot) else np.nan, block, -(-n // block), len(boot), len(null)]


def dependence_aware(df: DataFrame, key: Key, x: str, y: str, seq_len: int, pred_len: int, n_boot: int = 2000, n_perm: int = 2000, seed: int = 0, parts: int = 1) -> DataFrame:
    """Rows (key..., pos, x, y): rho with a circular moving-block bootstrap interval and a circular block permutation p. One key's vector is in memory at a time, replicates in chunks; for few long vectors, `parts` spreads a key's draws over as many tasks."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*key).schema)
    names = [c.split(" ")[0] for c in _DEP_AWARE.split(", ")]

    def drawn(k: tuple, rows: pd.DataFrame, part: int) -> tuple:
        rows = rows.sort_values("pos")
        n = len(rows)
        own = seed_of(seed, *k)  # each key has its own draws, whatever part makes them
        want = max(seq_len + pred_len, next(i for i in range(1, n + 2) if i**3 >= n))
        block = max(1, min(want, n // 2))
        vx, vy = rows[x].to_numpy(float), rows[y].to_numpy(float)
        ux, uy = (_Sorted(v).ranks - (n + 1) / 2 for v in (vx, vy))
        scale = float(np.sqrt((ux @ ux) * (uy @ uy)))
        cut = lambda total: (total * part // parts, total * (part + 1) // parts)
        (b0, b1), (p0, p1) = cut(n_boot), cut(n_perm)
        boot = block_bootstrap(vx, vy, block, b1 - b0, own, b0)
        dots = block_shuffles(ux, uy, block, p1 - p0, own + 2, p0)
        if scale > 0:  # a shuffle keeps both deviations
            return n, float(ux @ uy) / scale, boot, dots / scale, block
        return n, np.nan, boot, np.full(len(dots), np.nan), block

    if parts == 1:

        def one(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([[*k, *_dep_aware_row(*drawn(k, rows, 0))]], columns=[*key, *names])

        return df.groupBy(*key).applyInPandas(one, f"{fields}, {_DEP_AWARE}")

    def piece(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n, rho, boot, null, block = drawn(k[:-1], rows, int(k[-1]))
        return pd.DataFrame([[*k[:-1], n, rho, block, boot.tolist(), null.tolist()]], columns=[*key, "n", "rho", "block", "boot", "null"])

    def whole(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n, rho, block = (rows[c].iloc[0] for c in ("n", "rho", "block"))
        return pd.DataFrame([[*k, *_dep_aware_row(int(n), float(rho), *(np.concatenate([np.asarray(v, float) for v in rows[c]]) for c in ("boot", "null")), int(block))]], columns=[*key, *names])

    by = [*key, "_part"]
    many = df.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    drawn_parts = many.groupBy(*by).applyInPandas(piece, f"{fields}, n bigint, rho double, block bigint, boot array<double>, `null` array<double>")
    return drawn_parts.groupBy(*key).applyInPandas(whole, f"{fields}, {_DEP_AWARE}")


def _picks(clusters: DataFrame, key: Key, n_boot: int, seed: object) -> DataFrame:
    """clusters (key..., _i, _k) -> key..., replicate, _i, times: how often each cluster was drawn; a draw is md5 of seed, key, replicate and place."""
    draws = clusters.select(*key, "_i", "_k").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    h = order_key(seed, *[F.col(c) for c in key], F.col("replicate"), F.col("_i"))
    pick = F.pmod(F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint"), F.col("_k"))
    return draws.groupBy(*key, "replicate", pick.alias("_i")).agg(F.count("*").alias("times"))


def _weighted_median(values: np.ndarray, clusters: np.ndarray, times: np.ndarray) -> np.ndarray:
    """times (cluster, replicate): the median of each replicate's values, each value as often as its cluster was drawn."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    out = []
    for at in range(0, times.shape[1], 64):
        sums = _running_sums(times[clusters[order], at : at + 64].astype(np.int64))
        n = sums[-1]
        low, high = (n + 1) // 2, n // 2 + 1  # from 1
        out += [(v[np.searchsorted(s, a)] + v[np.searchsorted(s, b)]) / 2 if b <= m else np.nan for s, a, b, m in zip(sums.T, low, high, n)]
    return np.array(out)


def cluster_bootstrap(df: DataFrame, key: Key, cluster: str, value: str, n_boot: int = 2000, seed: object = 0, stat: str | Callable[[Column], Column] = "median") -> DataFrame:
    """Key..., point, ci_lo, ci_hi, boot_median, n_clusters, n_cells, n_boot: whole clusters are drawn with replacement.

    stat "mean" goes by cluster sums, a row per cluster and replicate. "median" goes by counts
    of draws per key: one key's values are in memory at a time, replicates in chunks, and no
    value is repeated per replicate. Any native aggregate can be given as a function; its rows
    are repeated as drawn."""
    rows = df.where(finite(F.col(value))).select(*key, cluster, F.col(value).alias("_v"))
    by = Window.partitionBy(*(key or [F.lit(0)]))
    sizes = rows.groupBy(*key, cluster).agg(F.count("*").alias("_n"), F.sum("_v").alias("_s"))
    sizes = sizes.withColumn("_i", F.row_number().over(by.orderBy(cluster)) - 1).withColumn("_k", F.count("*").over(by))
    picks = _picks(sizes, key, n_boot, seed)
    if stat == "mean":
        stats = picks.join(sizes, [*key, "_i"]).groupBy(*key, "replicate").agg((F.sum(F.col("times") * F.col("_s")) / F.sum(F.col("times") * F.col("_n"))).alias("s"))
    elif stat == "median":
        # the clusters' places and the draws of a key, beside its values, in one group
        code = rows.join(sizes.select(*key, cluster, "_i"), [*key, cluster]).select(*key, F.col("_v"), "_i", F.lit(None).cast("int").alias("replicate"), F.lit(None).cast("bigint").alias("times"))
        both = code.unionByName(picks.withColumn("_v", F.lit(None).cast("double")).select(*code.columns))
        fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*key).schema)

        def one(k: tuple, part: pd.DataFrame) -> pd.DataFrame:
            own, drawn = part[part["replicate"].isna()], part[part["replicate"].notna()]
            times = np.zeros((int(own["_i"].max()) + 1 if len(own) else 0, n_boot), np.int64)
            times[drawn["_i"].to_numpy(int), drawn["replicate"].to_numpy(int)] = drawn["times"].to_numpy(int)
            s = _weighted_median(own["_v"].to_numpy(float), own["_i"].to_numpy(int), times)
            return pd.DataFrame({**{c: [x] * n_boot for c, x in zip(key, k)}, "replicate": np.arange(n_boot), "s": s})

        stats = (both.groupBy(*key) if key else both.groupBy(F.lit(0).alias("_one"))).applyInPandas(one if key else lambda p: one((), p), f"{fields}replicate int, s double")
    else:
        drawn = picks.join(sizes.select(*key, cluster, "_i"), [*key, "_i"]).join(rows, [*key, cluster])
        stats = drawn.withColumn("_t", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).groupBy(*key, "replicate").agg(stat(F.col("_v")).alias("s"))
    ci = stats.groupBy(*key).agg(F.percentile("s", 0.025).alias("ci_lo"), F.percentile("s", 0.975).alias("ci_hi"), F.median("s").alias("boot_median"), F.count("*").alias("n_boot"))
    whole = F.avg if stat == "mean" else F.median if stat == "median" else stat
    point = rows.groupBy(*key).agg(whole(F.col("_v")).alias("point"), F.countDistinct(cluster).alias("n_clusters"), F.count("*").alias("n_cells"))
    return point.join(ci, list(key)) if key else point.crossJoin(ci)


def signed_rank(df: DataFrame, key: Key, diff: str) -> DataFrame:
    """Key..., n, w, z: zeros dropped, average ranks of |d|, tie-corrected normal statistic."""
    rows = df.where(finite(F.col(diff)) & (F.col(diff) != 0)).withColumn("_a", F.abs(diff))
    rows = rows.withColumn("_r", average_rank("_a", key)).withColumn("_t", F.count("*").over(Window.partitionBy(*key, "_a")))
    g = rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.when(F.col(diff) > 0, F.col("_r")).otherwise(0.0)).alias("wp"), F.sum(F.when(F.col(diff) < 0, F.col("_r")).otherwise(0.0)).alias("wm"), F.sum(F.col("_t") * F.col("_t") - 1).alias("ties"))
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48.0)
    return g.select(*key, "n", F.least("wp", "wm").alias("w"), ((F.least("wp", "wm") - n * (n + 1) / 4) / F.nullif(sd, F.lit(0.0))).alias("z"), "ties")


def signed_rank_p(df: DataFrame) -> DataFrame:
    """Rows of signed_rank with p: exact up to 50 pairs without ties, else normal."""

    @F.pandas_udf("double")
    def exact(w: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_exact(a, int(b)) if b <= 50 else None for a, b in zip(w, n)], dtype=float)

    return df.withColumn("p", F.when((F.col("n") <= 50) & (F.col("ties") == 0), exact("w", "n")).otherwise(normal_two_sided(F.col("z"))))


def paired_summary(df: DataFrame, block: str, condition: str, value: str, conditions: Sequence[str], base: str = "index") -> DataFrame:
    """Condition, n_blocks, mean_index, mean_condition, mean_diff, median_diff, w, z against the base condition; fewer than three pairs: no row. Several rows of a block and condition count by their mean."""
    wide = df.groupBy(block).pivot(condition, [base, *conditions]).agg(F.avg(value))
    long = wide.select(block, F.col(base).alias("b"), F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.col(c).alias("v")) for c in conditions])).alias("s")).select(block, "b", "s.condition", "s.v")
    rows = long.where("b is not null and v is not null").withColumn("d", F.col("v") - F.col("b"))
    g = rows.groupBy("condition").agg(F.count("*").alias("n_blocks"), F.avg("b").alias("mean_index"), F.avg("v").alias("mean_condition"), F.avg("d").alias("mean_diff"), F.median("d").alias("median_diff")).where("n_blocks >= 3")
    return g.join(signed_rank(rows, ["condition"], "d").drop("n"), "condition", "left")


def with_paired_p(summary: DataFrame) -> DataFrame:
    """Adds wilcoxon_p; 1 where all differences are zero."""
    return signed_rank_p(summary.withColumn("n", F.col("n_blocks"))).withColumn("wilcoxon_p", F.coalesce("p", F.lit(1.0))).drop("p", "n")


def equivalence_moments(df: DataFrame, key: Key, diff: str, margin: float) -> DataFrame:
    """T15 up to the t tail: key..., n, mean_diff, sd_diff, margin, t_lower, t_upper; without spread the standard error is 1e-300."""
    g = df.where(finite(F.col(diff))).groupBy(*key).agg(F.count("*").alias("n"), F.avg(diff).alias("mean_diff"), F.stddev_samp(diff).alias("sd_diff")).withColumn("margin", F.lit(float(margin)))
    se = F.when(F.col("sd_diff") > 0, F.col("sd_diff") / F.sqrt(F.col("n").cast("double"))).otherwise(F.lit(1e-300))
    return g.withColumn("se", se).withColumn("t_lower", (F.col("mean_diff") + F.col("margin")) / F.col("se")).withColumn("t_upper", (F.col("mean_diff") - F.col("margin")) / F.col("se"))


def equivalence_test(df: DataFrame, key: Key, diff: str, margin: float) -> DataFrame:
    """T15, A.5: two one-sided paired t tests and the 95 % interval; the tails are computed on a row per key."""
    g = equivalence_moments(df, key, diff, margin).withColumn("_df", F.col("n") - 1.0)
    p = F.greatest(t_sf_col(F.col("t_lower"), F.col("_df")), 1 - t_sf_col(F.col("t_upper"), F.col("_df")))
    half = t_isf_col(F.lit(0.025), F.col("_df")) * F.col("se")
    g = g.withColumn("p_tost", p).withColumn("_h", half)
    return g.withColumn("equivalent_at_05", (F.col("p_tost") < 0.05).cast("int")).withColumn("ci95_low", F.col("mean_diff") - F.col("_h")).withColumn("ci95_high", F.col("mean_diff") + F.col("_h")).drop("_df", "_h", "se")


def cluster_means(df: DataFrame, key: Key, cluster: str, diff: str) -> DataFrame:
    """key..., cluster, cluster_mean, cells over finite differences."""
    return df.where(finite(F.col(diff))).groupBy(*key, cluster).agg(F.avg(diff).alias("cluster_mean"), F.count("*").alias("cells"))


def equivalence_test_clustered(df: DataFrame, key: Key, cluster: str, diff: str, margin: float) -> DataFrame:
    """The same test over cluster means."""
    means = cluster_means(df, key, cluster, diff)
    out = equivalence_test(means, key, "cluster_mean", margin)
    sizes = means.groupBy(*key).agg(F.count("*").alias("n_clusters"), F.sum("cells").alias("n_cells"))
    return out.join(sizes, list(key)) if key else out.crossJoin(sizes)


def r_squared(df: DataFrame, key: Key, y: str, fitted: str) -> DataFrame:
    """NULL without spread."""
    g = df.groupBy(*key).agg(F.sum(F.pow(F.col(y) - F.col(fitted), F.lit(2.0))).alias("res"), (F.var_pop(y) * F.count(y)).alias("tot"))
    return g.select(*key, F.when(F.col("tot") > 0, 1 - F.col("res") / F.when(F.col("tot") > 0, F.col("tot"))).alias("r2"))


def equivalence_from_summary(n: int, mean: float, sd: float, margin: float) -> dict[str, float]:
    """The test from n, mean and deviation alone; the independent check of reported intervals."""
    se = sd / math.sqrt(n) if sd > 0 else 1e-300
    p = max(t_sf((mean + margin) / se, n - 1), t_cdf((mean - margin) / se, n - 1))
    half = t_isf(0.025, n - 1) * se
    return {"p_tost": p, "equivalent_at_05": float(p < 0.05), "ci95_low": mean - half, "ci95_high": mean + half}
