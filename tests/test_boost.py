"""Boosted trees against plain recursion; the regression's jobs do not grow with its rounds."""

import numpy as np
import pytest

from seriata.functions.boost import Boosting, thresholds
from seriata.operators import downstream, order


def grown(x, rest, new, depth, least, l2, rate):
    """The values of the rows new by a tree that tries every cut between two values."""
    best, here = (0.0, None, None), rest.sum() ** 2 / (len(rest) + l2)
    for j in range(x.shape[1] if depth else 0):
        values = np.unique(x[:, j])
        for cut in (values[:-1] + values[1:]) / 2:
            left = x[:, j] <= cut
            if least <= left.sum() <= len(rest) - least:
                gain = sum(rest[s].sum() ** 2 / (s.sum() + l2) for s in (left, ~left)) - here
                if gain > best[0]:
                    best = (gain, j, cut)
    _, j, cut = best
    if j is None:
        return np.full(len(new), rate * rest.sum() / (len(rest) + l2))
    out, left, side = np.empty(len(new)), x[:, j] <= cut, new[:, j] <= cut
    for s, t in ((left, side), (~left, ~side)):
        out[t] = grown(x[s], rest[s], new[t], depth - 1, least, l2, rate)
    return out


def test_trees_equal_plain_recursion():
    rng = np.random.default_rng(5)
    x, new = rng.integers(0, 60, (400, 3)) / 7, rng.normal(4, 4, (50, 3))
    y = x[:, 0] + np.where(x[:, 1] > 4, x[:, 2], -1) + rng.normal(size=400)
    learner = Boosting(iterations=6)
    fitted, out = np.full(400, y.mean()), np.full(50, y.mean())
    for _ in range(6):
        rest = y - fitted
        fitted, out = fitted + grown(x, rest, x, 3, 40, 1.0, 0.08), out + grown(x, rest, new, 3, 40, 1.0, 0.08)
    assert learner.fit_predict(x, y, new) == pytest.approx(out, abs=1e-9)
    assert learner.fit_predict(x, np.full(400, 2.0), new) == pytest.approx(2.0)
    assert learner.fit_predict(x[:30], y[:30], new) == pytest.approx(y[:30].mean())  # too few rows for any split
    assert len(thresholds(rng.normal(size=1000), 255)) == 254


def test_jobs_do_not_grow_with_rounds(spark):
    rng = np.random.default_rng(0)
    f = np.abs(np.cumsum(rng.normal(size=600))) + 1
    df = spark.createDataFrame([("g", i, float(a), float(a * b)) for i, (a, b) in enumerate(zip(f, np.exp(0.2 * rng.normal(size=600))))], "g string, pos long, f_std double, value double")
    p, c = order.full_permutation(df, ["g"], 1), order.full_permutation(df, ["g"], 2)
    joined = downstream.three_conditions(df.drop("value"), df.select("g", "pos", "value"), p, c, ["g"])
    spark.sparkContext.setJobGroup("boost", "")
    try:
        rows = downstream.difficulty_regression(joined, df, ["f_std"], 4, 2, iterations=60).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = {r.condition: r for r in rows}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("boost")) < 150  # 60 rounds of six fits were over a thousand
    assert got["index"].spearman_test > 0.9 and got["index"].r2_test > 0.8 and got["index"].spearman_holdout is not None
    assert abs(got["defect"].spearman_test) < got["index"].spearman_test and got["index"].n_val == 600
