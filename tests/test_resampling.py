"""The dependence-aware resampling against direct computation."""

import numpy as np
import pandas as pd
import pytest

from seriata.functions import draws
from seriata.operators import assoc, diagnose


def ranks(v):
    return pd.Series(v).rank().to_numpy()


@pytest.mark.parametrize("n, block, ties", [(5, 2, False), (50, 7, False), (50, 10, True), (97, 1, True), (240, 100, False), (12, 6, True)])
def test_bootstrap_equals_resampled_ranks(n, block, ties):
    rng = np.random.default_rng(n)
    x, y = rng.gamma(2, 1, n), rng.gamma(2, 1, n)
    if ties:
        x, y = np.round(x), np.round(y * 2)
    got = assoc.block_bootstrap(x, y, block, 70, 1, 5)
    starts = draws.integers(1, 5, 70, -(-n // block), n)
    for g, s in zip(got, starts):
        i = ((s[:, None] + np.arange(block)) % n).ravel()[:n]
        a, b = ranks(x[i]), ranks(y[i])
        if a.std() and b.std():
            assert abs(g - np.corrcoef(a, b)[0, 1]) < 1e-9
        else:
            assert np.isnan(g)


@pytest.mark.parametrize("most", [1 << 25, 0])
@pytest.mark.parametrize("n, block", [(5, 2), (50, 7), (50, 10), (97, 1), (240, 100), (3, 3)])
def test_block_shuffles_equal_direct_sums(n, block, most):
    rng = np.random.default_rng(n)
    ux, uy = rng.standard_normal((2, n))
    got = assoc.block_shuffles(ux, uy, block, 60, 2, 3, most)
    for g, o, [s] in zip(got, draws.orders(2, 3, 60, -(-n // block)), draws.integers(3, 3, 60, 1, n)):
        turned = np.roll(uy, -s)
        moved = np.concatenate([turned[b * block : (b + 1) * block] for b in o])
        assert abs(g - ux @ moved) < 1e-9


def test_parts_of_one_key_give_the_same_draws(spark):
    rng = np.random.default_rng(3)
    x = rng.gamma(2, 1, 400)
    rows = pd.DataFrame({"g": 1, "pos": np.arange(400), "x": x, "y": x**1.5 + rng.standard_normal(400)})
    df = spark.createDataFrame(pd.concat([rows, rows.assign(g=2, y=rng.standard_normal(400)), rows.head(1).assign(g=3)]))
    one, many = (assoc.dependence_aware(df, ["g"], "x", "y", 5, 3, 300, 301, parts=p).orderBy("g").toPandas() for p in (1, 4))
    pd.testing.assert_frame_equal(one, many)
    assert one["n_boot"].tolist() == [300, 300, 0] and one["p_block"][0] < 0.02 < one["p_block"][1]


def test_draws_are_spread_and_independent_of_chunks():
    a = draws.words(7, 0, 2000, 50)
    assert (draws.words(7, 100, 30, 50) == a[100:130]).all()
    share = draws.integers(7, 0, 2000, 50, 10)
    assert abs(np.bincount(share.ravel(), minlength=10) / share.size - 0.1).max() < 0.005
    o = draws.orders(3, 0, 3000, 5)
    assert len({tuple(r) for r in o}) == 120 and abs(np.corrcoef(o[:, 0], o[:, 1])[0, 1] + 0.25) < 0.06
    assert abs(np.corrcoef(a[:-1, 0].astype(float), a[1:, 0].astype(float))[0, 1]) < 0.06


def test_cluster_bootstrap_equals_repeated_rows(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"g": rng.integers(0, 3, 300), "c": [f"c{i}" for i in rng.integers(0, 9, 300)], "v": np.round(rng.gamma(2, 1, 300), 1)})
    rows.loc[::17, "v"] = np.nan
    df = spark.createDataFrame(rows)
    for fast, slow in (("median", F.median), ("mean", F.avg)):
        for key in (["g"], []):
            a, b = (assoc.cluster_bootstrap(df, key, "c", "v", 80, 4, s).orderBy(*key, "point").toPandas() for s in (fast, slow))
            pd.testing.assert_frame_equal(a, b, check_exact=False, atol=1e-9)
    assert assoc.cluster_bootstrap(df.limit(0), ["g"], "c", "v", 10).count() == 0


def test_kolmogorov_distances(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    x = np.round(rng.random(500), 2)
    df = spark.createDataFrame(pd.DataFrame({"value": x, "k": np.arange(500) % 2}))
    got = diagnose.ks_one_sample(df, lambda v: v).first()
    s = np.sort(x)
    want = max(max((s <= t).mean() - t, t - (s < t).mean()) for t in s)
    assert abs(got.d - want) < 1e-12 and got.n == 500
    two = diagnose.ks_two_sample(df.where("k = 0"), df.where("k = 1")).first()
    a, b = x[::2], x[1::2]
    assert abs(two.d - max(abs((a <= t).mean() - (b <= t).mean()) for t in s)) < 1e-12
    flat = df.withColumn("value", F.lit(3.0))
    assert diagnose.ks_two_sample(flat, flat).first().d == 0
