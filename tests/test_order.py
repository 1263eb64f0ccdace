"""Order operators, diagnostics and splits against enumeration and NumPy."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriata.functions import columns, stats
from seriata.operators import assoc, diagnose, features, order, split


def vectors(spark, **named):
    rows = [(k, i, None if v is None else float(v)) for k, x in named.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "k string, pos long, value double")


def ar1(rho, n, seed=0):
    rng = np.random.default_rng(seed)
    x = np.zeros(n)
    for i in range(1, n):
        x[i] = rho * x[i - 1] + math.sqrt(1 - rho * rho) * rng.normal()
    return x


def by_key(df, key="k"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("n", [5, 6, 7])
def test_moments_equal_all_permutations(spark, n):
    x = np.random.default_rng(n).gamma(2, 1, n)
    c = x - x.mean()
    r = np.array([sum(p[i] * p[(i + 1) % n] for i in range(n)) / (c @ c) for p in itertools.permutations(c)])
    row = by_key(diagnose.aot(vectors(spark, a=x), ["k"]))["a"]
    assert row.null_mean == pytest.approx(r.mean(), abs=1e-12)
    assert row.null_sd == pytest.approx(r.std(), rel=1e-9)
    assert row.r == pytest.approx(diagnose.circular_correlation(x), abs=1e-12)


def test_ordered_vectors_certify_and_shuffled_do_not(spark):
    x = ar1(0.95, 800)
    df = vectors(spark, a=x)
    perm = order.full_permutation(df, ["k"], 1)
    assert by_key(diagnose.aot(df, ["k"]))["a"].reject == 1
    assert by_key(diagnose.aot(order.apply_permutation(df, perm, ["k"]), ["k"]))["a"].z < 3
    a, b = (by_key(diagnose.aot(df, ["k"], dense=d))["a"] for d in (False, True))
    assert a.z == pytest.approx(b.z, rel=1e-9)


def test_degenerate_vectors_are_undefined(spark):
    got = by_key(diagnose.aot(vectors(spark, zeros=[0] * 3, ones=[1] * 100, same=[3] * 64, short=[1, 2, 3]), ["k"]))
    assert all(r.z is None and r.reject == 0 and r.flagged == 1 for r in got.values())


def test_monte_carlo_agrees(spark):
    x = np.random.default_rng(5).gamma(2, 1, 60)
    df = vectors(spark, a=x)
    a, m = by_key(diagnose.aot(df, ["k"]))["a"], by_key(diagnose.aot_monte_carlo(df, ["k"], 2000))["a"]
    assert abs(a.p - m.p_perm) < 0.05


def test_power_and_theory(spark):
    rows = by_key(diagnose.theory(spark, [50, 11425]), "n")
    assert rows[50].rho_min_detectable == pytest.approx((1.6448536 + 1.2815516) / math.sqrt(50), abs=1e-6)
    assert rows[11425].power_at_rho_0_5 == pytest.approx(1.0)
    assert rows[50].rho_min_detectable == pytest.approx(0.41385619122269934, abs=1e-12) and rows[50].power_at_rho_0_5 == pytest.approx(0.9706664817215228, abs=1e-12) and rows[50].power_at_rho_0_1 == pytest.approx(0.17418726161793208, abs=1e-12)


def test_permutations_are_bijections(spark):
    df = vectors(spark, a=range(103), b=range(40))
    for p in (order.full_permutation(df, ["k"], 3), order.block_permutation(df, ["k"], 8, 3), order.partial_permutation(df, ["k"], 0.3, 3), order.circular_block_permutation(df, ["k"], 8, 3)):
        assert order.bijection_violations(p, ["k"]).count() == 0
        assert order.bijection_violations(p, ["k"], "pos").count() == 0
    moved = order.partial_permutation(df, ["k"], 0.3, 3).where("k = 'a' and pos != src_pos").count()
    assert 0 < moved <= 31
    assert order.partial_permutation(df, ["k"], 0.01, 3).where("pos != src_pos").count() == 0


def test_blocks_stay_intact(spark):
    p = {r.pos: r.src_pos for r in order.block_permutation(vectors(spark, a=range(100)), ["k"], 8, 1).collect()}
    steps = sum(p[i + 1] == p[i] + 1 for i in range(99))
    assert steps >= 99 - 13


def test_unpermute_inverts_and_refuses(spark):
    df = vectors(spark, a=np.random.default_rng(0).random(50))
    p = order.full_permutation(df, ["k"], 1)
    back = {r.pos: r.value for r in order.unpermute(order.apply_permutation(df, p, ["k"]), p, ["k"]).collect()}
    assert back == {r.pos: r.value for r in df.collect()}
    bad = p.withColumn("src_pos", F.when(F.col("src_pos") == 3, 4).otherwise(F.col("src_pos")))
    with pytest.raises(Exception, match="bijection"):
        order.unpermute(df, bad, ["k"]).collect()
    with pytest.raises(Exception, match="bijection"):
        order.unpermute(df.where("pos < 10"), p, ["k"]).collect()


def test_masking(spark):
    df = vectors(spark, a=np.random.default_rng(0).random(64))
    p = order.apply_permutation(df, order.full_permutation(df, ["k"], 1), ["k"])
    row = diagnose.masking_check(df, p, ["k"]).first()
    assert row.multiset_equal and row.mean_rel_diff < 1e-12 and row.n_a == row.n_b == 64
    assert not diagnose.masking_check(df, p.withColumn("value", F.col("value") + 1), ["k"]).first().multiset_equal


def test_bootstrap_indices(spark):
    lengths = spark.createDataFrame([("a", 23, 5)], "k string, n long, block_len long")
    rows = order.moving_block_indices(lengths, ["k"], order.replicates(spark, 4), 0).collect()
    assert len(rows) == 4 * 23 and all(0 <= r.src_pos < 23 for r in rows)
    one = {r.pos: r.src_pos for r in rows if r.replicate == 0}
    assert all(one[i + 1] == (one[i] + 1) % 23 for i in range(22) if (i + 1) % 5)


def arm_matrix(spark, n=600, k=4, seed=1):
    rng = np.random.default_rng(seed)
    base = np.abs(ar1(0.9, n, seed))
    return spark.createDataFrame([("g", f"a{j}", i, float(base[i] + 0.1 * rng.normal())) for j in range(k) for i in range(n)], "g string, arm string, pos long, value double")


def test_agreement_equals_pairwise_mean(spark):
    a = arm_matrix(spark)
    pairs = [r.rho for r in diagnose.pairwise_spearman(a, ["g"]).collect()]
    row = diagnose.agreement(a, ["g"]).first()
    assert len(pairs) == 6 and row.rho_bar == pytest.approx(np.mean(pairs), abs=1e-12)
    mc = diagnose.agreement_monte_carlo(a, ["g"], 200).first()
    assert mc.rho_bar == pytest.approx(row.rho_bar, abs=1e-12) and mc.p == pytest.approx(1 / 201)


def test_sharing_conditions_order(spark):
    a = arm_matrix(spark)
    rho = {c: diagnose.agreement(order.inject_sharing(a, ["g"], c, 7), ["g"]).first().rho_bar for c in order.SHARING}
    assert rho["intact"] == pytest.approx(rho["all_shared"]) and rho["intact"] > rho["shared_k3"] > rho["two_pairs"] > rho["shared_k2"] > rho["independent"]
    z = diagnose.agreement(order.inject_sharing(a, ["g"], "independent", 7), ["g"]).first().z_corrected
    assert abs(z) < 4
    with pytest.raises(ValueError):
        order.sharing_label("other", F.lit(0))


def test_permutation_sharing_classes(spark):
    df = spark.createDataFrame([("g", a, i, (i * s) % 7) for a, s in (("x", 1), ("y", 2), ("z", 2)) for i in range(7)], "g string, arm string, pos long, src_pos long")
    row = diagnose.permutation_sharing(df, ["g"]).first()
    assert (row.n_arms, row.n_distinct, row.identical_pairs, row.non_identity, row.sharing) == (3, 2, 1, 2, "partial_shared")


def test_ks(spark):
    rng = np.random.default_rng(0)
    a, b = vectors(spark, a=rng.normal(size=400)), vectors(spark, a=rng.normal(1, 1, 300))
    x, y = (np.sort([r.value for r in d.collect()]) for d in (a, b))
    grid = np.concatenate([x, y])
    want = np.abs(np.searchsorted(x, grid, "right") / 400 - np.searchsorted(y, grid, "right") / 300).max()
    assert diagnose.ks_two_sample(a, b).first().d == pytest.approx(want)
    assert stats.kolmogorov_sf(want, 400 * 300 / 700) < 1e-6


def series(spark, x):
    x = np.atleast_2d(x.T).T
    return spark.createDataFrame([("d", c, t, float(x[t, c])) for t in range(x.shape[0]) for c in range(x.shape[1])], "d string, channel int, t long, value double")


def restated(x, L, H):
    n = len(x) - L - H + 1
    out = []
    t = np.arange(L)
    that = (t - t.mean()) / (t.std() + 1e-12)
    for o in range(n):
        w = x[o : o + L]
        m, s = w.mean(0), w.std(0)
        c = w - m
        h = L // 2
        var = (c**2).mean(0)
        p = np.abs(np.fft.rfft(w.mean(1) - w.mean())) ** 2
        p = p[1:] / (p[1:].sum() + 1e-12)
        k = x.shape[1]
        cc = [abs((c[:, i] * c[:, j]).mean()) / (s[i] * s[j] + 1e-12) for i in range(k) for j in range(i + 1, k)]
        out.append([s.mean(), np.ptp(w, 0).mean(), np.abs(np.diff(w, axis=0)).mean(), (c * that[:, None]).sum(0).mean() / L, ((c[:-1] * c[1:]).sum(0) / ((c**2).sum(0) + 1e-12)).mean(), (np.abs(w[h:].mean(0) - w[:h].mean(0)) / (s + 1e-12)).mean(), -(p * np.log(p + 1e-12)).sum() / np.log(len(p)), np.mean(cc) if cc else 0.0, (np.abs(w[-1] - m) / (s + 1e-12)).mean(), ((c**4).mean(0) / (var**2 + 1e-12)).mean()])
    return np.array(out)


def test_window_features_equal_numpy(spark):
    x = np.cumsum(np.random.default_rng(1).normal(size=(120, 3)), 0)
    want = restated(x, 24, 6)
    rows = features.window_features(series(spark, x), ["d"], 24, 6).orderBy("window_origin").collect()
    got = np.array([[r[f] for f in features.FEATURES] for r in rows])
    assert got.shape == want.shape == (91, 10)
    assert np.allclose(got, want, rtol=1e-6, atol=1e-8)
    parts = features.channel_features(series(spark, x), ["d"], 24, 6, chunks=30).orderBy("channel", "window_origin").collect()
    whole = features.channel_features(series(spark, x), ["d"], 24, 6).orderBy("channel", "window_origin").collect()
    assert len(parts) == len(whole) and np.allclose([list(r)[3:] for r in parts], [list(r)[3:] for r in whole])


def test_features_edges(spark):
    flat = features.window_features(series(spark, np.zeros((50, 2))), ["d"], 24, 6).first()
    assert flat.f_std == 0 and flat.f_kurtosis == 0
    short = series(spark, np.zeros((20, 1)))
    assert features.window_features(short, ["d"], 24, 6).count() == 0
    with pytest.raises(ValueError):
        features.window_features(short, ["d"], 24, 6, strict=True)


def test_features_do_not_see_the_target(spark):
    x = np.cumsum(np.random.default_rng(1).normal(size=(60, 1)), 0)
    y = x.copy()
    y[24:] += 100
    a, b = (features.window_features(series(spark, v), ["d"], 24, 6).where("window_origin = 0").first() for v in (x, y))
    assert a == b


def test_transforms(spark):
    df = vectors(spark, a=[1, 2, 3, 4], b=[5, 5, 5, 5])
    back = features.revin_inverse(features.revin(df, ["k"]).drop("value")).collect()
    assert {(r.k, r.pos): round(r.value, 9) for r in back} == {(r.k, r.pos): r.value for r in df.collect()}
    w = spark.createDataFrame([("w", i, float(i % 5)) for i in range(50)], "k string, k2 long, value double").withColumnRenamed("k2", "k_").withColumnRenamed("k", "w").withColumnRenamed("k_", "k")
    s = features.slice_statistics(w, ["w"], 50).collect()
    assert len(s) == 50 // features.slice_length(50)
    stats_ = features.slice_statistics(w, ["w"], 50)
    expected = features.slice_forecast(stats_, ["w"])
    normal = features.slice_normalise(w, ["w"], 50)
    assert normal.count() == 50
    flat = features.slice_denormalise(spark.createDataFrame([("w", 0, 0.0)], "w string, step int, normalised double"), expected, ["w"]).first()
    assert flat.value == pytest.approx(expected.first().mean)
    trend = features.slice_trend(stats_, ["w"], 30).agg(F.max("mean"), F.min("mean")).first()
    means = [r.mean for r in s]
    span = max(means) - min(means)
    assert trend[0] <= max(means) + span + 1e-5 and trend[1] >= min(means) - span - 1e-5
    steps = spark.createDataFrame([("w", i, 0.0, float(i)) for i in range(8)], "w string, step long, pred double, true double")
    d = -np.arange(8.0)
    assert features.frequency_loss(steps, ["w"], 0.25).first().loss == pytest.approx(0.75 * (d**2).mean() + 0.25 * np.abs(np.fft.rfft(d)).mean())
    with pytest.raises(ValueError):
        features.frequency_loss(steps, ["w"], 2)


def test_purge_rules(spark):
    cells = spark.createDataFrame([("long", 4000, 96, 720), ("short", 41, 96, 192), ("tiny", 1, 1, 1)], "c string, n long, seq_len int, pred_len int")
    d = by_key(split.audited_split(cells, "disjoint"), "c")
    assert d["long"].purge_origins == 408 and d["long"].min_origin_gap_actual == 817 and d["long"].boundary_ok == 1 and d["long"].holdout_eligible == 1
    assert d["short"].holdout_eligible == 0 and d["short"].boundary_ok == 0
    labels = by_key(split.audited_split(cells, "labels"), "c")
    assert labels["long"].purge_origins == 360 and labels["long"].min_origin_gap_actual == 721
    legacy = by_key(split.audited_split(cells, "labels", purge=F.lit(200)), "c")["long"]
    assert legacy.min_origin_gap_actual == 401 and legacy.shared_target_points_at_boundary == 319 and legacy.boundary_ok == 0
    with pytest.raises(Exception, match="purge violated"):
        split.strict(split.audited_split(cells, "labels", purge=F.lit(200))).collect()
    with pytest.raises(ValueError):
        split.required_gap(F.lit(1), F.lit(1), "other")


def test_purged_split_sides(spark):
    rows = spark.range(100).withColumnRenamed("id", "window_origin")
    got = {r.window_origin: r.side for r in split.purged_split(rows, F.lit(100), F.lit(10)).collect()}
    assert got[39] == "train" and got[40] is None and got[59] is None and got[60] == "holdout"
    two = {r.window_origin: r.side for r in split.purged_split(spark.range(2).withColumnRenamed("id", "window_origin"), F.lit(2), F.lit(10)).collect()}
    assert two == {0: "train", 1: "holdout"}


def test_distribution_functions():
    assert stats.normal_isf(0.05) == pytest.approx(1.6448536269514722, abs=1e-9)
    assert stats.t_sf(2.0, 10) == pytest.approx(0.03669401738537018, rel=1e-9)
    assert stats.t_isf(0.025, 5) == pytest.approx(2.5705818366147395, rel=1e-9)
    assert stats.t_cdf(-1.5, 3) == pytest.approx(0.11529193262241147, rel=1e-8)
    n = 9
    sums = [sum(s) for k in range(n + 1) for s in itertools.combinations(range(1, n + 1), k)]
    assert stats.signed_rank_exact(8, n) == pytest.approx(min(1, 2 * sum(x <= 8 for x in sums) / 2**n))
    assert columns.stable_seed("ab", "c") != columns.stable_seed("a", "bc") and columns.stable_seed("t1", "cell-7") == columns.stable_seed("t1", "cell-7")


def test_association_and_its_collapse(spark):
    rng = np.random.default_rng(0)
    f = rng.gamma(2, 1, 800)
    rows = spark.createDataFrame([("g", i, float(a), float(b), float(a**1.5)) for i, (a, b) in enumerate(zip(f, rng.random(800)))], "g string, pos long, f_std double, f_range double, y double")
    out = assoc.with_naive_p(assoc.association(rows, ["g"], ["f_std", "f_range"], "y")).first()
    assert out.rho_f_std == pytest.approx(1.0) and out.assoc_rho_best_feature == "f_std" and abs(out.rho_f_range) < 0.12 and out.assoc_p_iid_naive < 1e-9
    q = np.quantile(f, [0.1, 0.9])
    y = f**1.5
    assert out.decile_ratio_fstd == pytest.approx(y[f >= q[1]].mean() / y[f <= q[0]].mean())
    d = assoc.dependence_aware(rows, ["g"], "f_std", "y", 8, 4, 100, 100).first()
    assert d.assoc_rho == pytest.approx(1.0) and d.p_block == pytest.approx(1 / 101) and d.block_len == 12


def test_equivalence(spark):
    rng = np.random.default_rng(1)
    rows = [("same", f"c{i % 10}", float(x)) for i, x in enumerate(rng.normal(0, 0.3, 200))] + [("off", f"c{i % 10}", float(x)) for i, x in enumerate(rng.normal(1, 0.3, 200))] + [("flat", "c0", 0.0), ("flat", "c1", 0.0)]
    df = spark.createDataFrame(rows, "k string, c string, d double")
    got = by_key(assoc.equivalence_test(df, ["k"], "d", 0.1))
    assert got["same"].equivalent_at_05 == 1 and got["off"].equivalent_at_05 == 0 and got["flat"].equivalent_at_05 == 1
    assert got["same"].ci95_low < got["same"].mean_diff < got["same"].ci95_high
    cl = by_key(assoc.equivalence_test_clustered(df, ["k"], "c", "d", 0.2))
    assert cl["same"].n_clusters == 10 and cl["same"].n_cells == 200


@pytest.mark.parametrize(
    "n, mean, sd, margin, p, low, high",
    [
        (356, 0.0005478910344765196, 0.05272951874514077, 0.03, 4.4615626594426387e-23, -0.0049482776969003335, 0.006044059765853373),
        (7, 0.001044928830891181, 0.004220376559588606, 0.03, 8.998321522355624e-07, -0.0028582684865454786, 0.00494812614832784),
        (96, -0.5872586654287383, 2.079612329608604, 0.25, 0.9423053429183137, -1.0086272868346513, -0.16589004402282537),
        (7, -0.6218222995529816, 0.7107286532934697, 0.25, 0.8922004366496541, -1.2791366727592568, 0.03549207365329354),
        (324, 0.01595139201570863, 0.1548169925633461, 0.03, 0.051681744042137726, -0.0009695514337189244, 0.03287233546513618),
        (6, 0.02031298402508246, 0.01661946849678343, 0.03, 0.10636291265449227, 0.0028719214684293816, 0.037754046581735534),
    ],
)
def test_equivalence_of_published_summaries(n, mean, sd, margin, p, low, high):
    got = assoc.equivalence_from_summary(n, mean, sd, margin)
    assert got["p_tost"] == pytest.approx(p, rel=1e-8) and got["ci95_low"] == pytest.approx(low, rel=1e-9) and got["ci95_high"] == pytest.approx(high, rel=1e-9)


def test_signed_rank_exact_and_normal(spark):
    small = spark.createDataFrame([("a", float(x)) for x in (1, -2, 3, 4, 5, 6, 7, 0)], "k string, d double")
    row = assoc.signed_rank_p(assoc.signed_rank(small, ["k"], "d")).first()
    assert row.n == 7 and row.w == 2 and row.p == pytest.approx(stats.signed_rank_exact(2, 7))


def test_cluster_bootstrap_covers(spark):
    rng = random.Random(0)
    df = spark.createDataFrame([("g", f"c{i % 12}", rng.gauss(5, 1)) for i in range(240)], "g string, c string, v double")
    row = assoc.cluster_bootstrap(df, ["g"], "c", "v", 60).first()
    assert row.ci_lo <= row.point <= row.ci_hi and row.n_clusters == 12 and row.n_boot == 60
