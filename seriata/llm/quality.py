"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Per class a mean and a covariance shrunk towards its own diagonal and a multiple of the
identity, by weights chosen by cross-validation among the training rows; the score comes from the difference of the two Mahalanobis log-densities
plus the log prior ratio, scaled by a logistic curve over the training margins. Cholesky
factors are computed once, at the fit, and travel with the model. The fit reads at most
`sample` labelled rows (chosen by a hash of doc_id); the score uses the text only.

Null text counts as empty. An empty text gets a defined score (its statistics are zeros); a
text of any length is read whole. Rows without label only get scored; a repeated row gets the
same score each time, and a repeated doc_id counts once in the fit. A score of exactly the
threshold (a tie) is accepted. An empty table, or one without labels, gives a model that knows
no difference. Columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, replace
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriata.ship import ship

SAMPLE = 20_000
THRESHOLD = 0.3
SHRINK = tuple((d, i) for d in (0.05, 0.1, 0.3, 0.6) for i in (0.02, 0.1, 0.3))  # weights of the diagonal and the identity to choose from
FOLDS = 4
_CLASS = np.full(256, 5)  # 0 letters of either kind and above ASCII, 1 capitals, 2 digits, 3 white space, 4 sentence marks, 5 other
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[128:] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 4
FEATURES = ("log_words", "word_length", "capitals", "digits", "marks", "other", "repeats", "variety", "line_repeats", "top_word")


def statistics(text: str | None) -> np.ndarray:
    """The document's statistics on scales where clean text is close to normal."""
    b = (text or "").encode("utf-8", "surrogatepass")
    n = len(b)
    if not n:
        return np.zeros(len(FEATURES))
    kinds = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(b, np.uint8), minlength=256), minlength=6)
    ws = b.split()
    w = max(1, len(ws))
    counts: dict[bytes, int] = {}
    for x in ws:
        counts[x] = counts.get(x, 0) + 1
    lines = [x for x in b.split(b"\n") if x]
    solid = n - kinds[3]
    share = lambda x, of, more: np.log(x / (of + more) + 0.01)  # noqa: E731  a few cases in a short text say little
    return np.array([
        np.log1p(len(ws)),
        np.log((solid + 50) / (w + 10)),
        share(kinds[1], solid, 100),
        share(kinds[2], solid, 100),
        share(kinds[4], solid, 100),
        share(kinds[5], solid, 50),
        share(sum(map(eq, ws, ws[1:])), w, 20),
        np.log(len(counts) + 10) / np.log(w + 10),
        share(len(lines) - len(set(lines)), len(lines), 10),
        share(max(counts.values(), default=0), w, 20),
    ])


@dataclass(frozen=True)
class Discriminant:
    """means, inverse Cholesky factors and half log-determinants by class; offset: log of the prior ratio."""

    means: np.ndarray
    factors: np.ndarray
    half_logdets: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0
    shrink: tuple[float, float] = SHRINK[3]

    def margin(self, x: np.ndarray) -> np.ndarray:
        density = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.factors[c].T
            density.append(-0.5 * np.einsum("ij,ij->i", z, z) - self.half_logdets[c])
        return density[1] - density[0] + self.offset

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -500, 500)))


def calibrate(margin: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 30) -> tuple[float, float]:
    """Slope and shift of a logistic curve over the training margins: densities of real features overstate their odds."""
    scale = max(float(np.median(np.abs(margin))), 1e-9)
    z = np.stack([np.clip(margin / scale, -20, 20), np.ones(len(margin))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + ridge * (w - [1.0, 0.0])
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        w -= np.clip(np.linalg.solve(hessian, gradient), -1, 1)
    return (float(w[0] / scale), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def fit_discriminant(x: np.ndarray, y: np.ndarray, shrink: tuple[float, float] | None = None) -> Discriminant:
    """A class without rows takes the mean and covariance of all rows and half a row as its prior. shrink: the covariances' weights of their own diagonal and of the identity; chosen by cross-validation if not given."""
    d = x.shape[1]
    if not len(x):
        return Discriminant(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), 0.0)
    diagonal, identity = shrink = shrink or choose_shrinkage(x, y)
    means, factors, dets, sizes = [], [], [], []
    for c in (0, 1):
        own = x[y == c] if (y == c).any() else x
        m = own.mean(0)
        s = np.atleast_2d(np.cov(own.T, bias=True)) if len(own) > 1 else np.zeros((d, d))
        s = (1 - diagonal - identity) * s + diagonal * np.diag(np.diag(s)) + identity * max(np.trace(s) / d, 1e-3) * np.eye(d)
        low = np.linalg.cholesky(s)
        means.append(m)
        factors.append(np.linalg.inv(low))
        dets.append(float(np.log(np.diag(low)).sum()))
        sizes.append(max(0.5, float((y == c).sum())))
    model = Discriminant(np.stack(means), np.stack(factors), np.array(dets), float(np.log(sizes[1] / sizes[0])), shrink=shrink)
    if len(np.unique(y)) < 2:
        return model
    slope, shift = calibrate(model.margin(x), y)
    return replace(model, slope=slope, shift=shift)


def choose_shrinkage(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The weights with the least logarithmic loss on rows left out, every FOLDS-th row at a time; of equal ones the first. Too few rows of a class to leave any out: the default."""
    if min((y == 0).sum(), (y == 1).sum()) < 2 * FOLDS:
        return Discriminant.shrink
    part = np.empty(len(y), int)
    for c in (0, 1):
        part[y == c] = np.arange((y == c).sum()) % FOLDS
    losses = []
    for shrink in SHRINK:
        p = np.empty(len(y))
        for k in range(FOLDS):
            p[part == k] = fit_discriminant(x[part != k], y[part != k], shrink).score(x[part == k])
        p = np.clip(p, 1e-6, 1 - 1e-6)
        losses.append(-np.log(np.where(y == 1, p, 1 - p)).sum())
    return SHRINK[int(np.argmin(losses))]


def fold(doc_id) -> F.Column:
    """crc32 of doc_id as text, mod 5; held out where 0."""
    return F.crc32(doc_id.cast("string")) % 5


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Discriminant:
    """Learns from at most `sample` labelled rows outside the held-out fold; those few ids are broadcast, so no text is shuffled."""
    ship(docs.sparkSession)
    chosen = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("y")).where("id is not null and y in (0, 1)").where(fold(F.col("id")) != 0)
    chosen = chosen.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))

    @F.arrow_udf("array<double>")
    def stats(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t.as_py()).tolist() for t in texts], pa.list_(pa.float64()))

    # a repeated doc_id counts once, by the least of its texts' hashes, so the sample and the model are the same on every run
    one = rows.select("id", "y", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), stats("text").alias("x")).groupBy("id").agg(F.min(F.struct("h", "y", "x")).alias("r"))
    got = one.orderBy("id").select("r.y", "r.x").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return fit_discriminant(x, got["y"].to_numpy(int))


def score(docs: DataFrame, model: Discriminant, name: str = "score") -> DataFrame:
    """docs with the score in column `name`, which replaces one of that name; narrow."""
    ship(docs.sparkSession)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        x = np.array([statistics(t.as_py()) for t in texts]).reshape(-1, len(FEATURES))
        pa.default_memory_pool().release_unused()
        return pa.array(model.score(x), pa.float64())

    return docs.withColumn(name, of(F.col("text")))


def crc_fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5
