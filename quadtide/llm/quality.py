"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each class gets a Gaussian over transformed statistics of the text. A class covariance is shrunk
towards the pooled one and towards a scaled identity; the weights come from cross-validation. The
score is the Mahalanobis log-density difference, taken with Cholesky factors that are computed once
on the driver and sent with the task, then calibrated to a probability by logistic regression on
out-of-fold differences.

Defined cases: a null or empty text has the statistics of an empty text and gets a score; null,
repeated or contradicting labels: null labels are dropped and a document counts once, as the least
label that it has; without both classes the model scores every document 1 (nothing is rejected). One
row of each class is enough: shrinkage does the rest. A class without two rows for every pair of folds
leaves nothing to validate on, so the strongest shrinkage and an uncalibrated difference are taken.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: The most labelled rows that the model is fitted on; beyond, those with the smallest hash of doc_id.
MAX_FIT_ROWS = 20_000
THRESHOLD = 0.3
#: Weights tried for the pooled covariance and for the identity.
POOLED, IDENTITY = (0.05, 0.2, 0.5, 0.8), (0.01, 0.05, 0.2)

_SIGN = b".,;:'\"()-"
_NOISE = b"#$%&*@^~|=+<>{}[]_\\/`"


def _mask(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_CLASSES = np.stack([
    _mask(range(65, 91)),  # upper-case letters
    _mask(range(97, 123)),  # lower-case letters
    _mask(range(48, 58)),  # digits
    _mask(range(128, 256)),  # bytes of other characters
    _mask(_SIGN),
    _mask(b"!?"),
    _mask(_NOISE),
    _mask(b"\n"),
]).astype(np.float64)

FEATURES = 17


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of a whole text: logs of counts, and logs of shares with a small offset."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    size = max(len(raw), 1)
    shares = _CLASSES @ np.bincount(raw, minlength=256) / size
    words = text.split()
    n = max(len(words), 1)
    distinct = set(words)
    lines = text.split("\n")
    repeated = sum(map(eq, words, words[1:]))
    letters = sum(map(len, words))
    long_share = sum(1 for w in distinct if len(w) > 18) / max(len(distinct), 1)
    line_words = n / len(lines)
    lower_start = sum(map(str.islower, words))
    more = np.array([repeated / n, 1 - len(set(lines)) / len(lines), long_share, 1 - lower_start / n, 1 - len(distinct) / n])
    return np.concatenate([
        np.log(shares + 0.002),
        np.log(more + 0.01),
        [np.log1p(len(words)) / 4, np.log1p(letters / n), np.log1p(line_words) / 2, np.log(len(distinct) + 1) / 4],
    ])


@dataclass
class Gaussian:
    mean: np.ndarray
    factor: np.ndarray  # the inverse of the Cholesky factor of the covariance
    bias: float  # log of the determinant's share of the density

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.factor.T
        return -0.5 * (z * z).sum(1) - self.bias


@dataclass
class Model:
    centre: np.ndarray | None
    scale: np.ndarray | None
    bad: Gaussian | None
    good: Gaussian | None
    slope: float = 1.0
    offset: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.good is None:
            return np.ones(len(x))
        z = (x - self.centre) / self.scale
        diff = self.good.log_density(z) - self.bad.log_density(z)
        return 1 / (1 + np.exp(-np.clip(self.slope * squash(diff) + self.offset, -30, 30)))


def squash(diff: np.ndarray) -> np.ndarray:
    """Signed logarithm: far differences stay ordered without ruling the calibration."""
    return np.sign(diff) * np.log1p(np.abs(diff))


def _gaussian(x: np.ndarray, pooled: np.ndarray, alpha: float, gamma: float) -> Gaussian:
    mean = x.mean(0)
    own = (x - mean).T @ (x - mean) / max(len(x) - 1, 1)
    cov = (1 - alpha) * own + alpha * pooled
    cov = (1 - gamma) * cov + gamma * np.trace(cov) / len(cov) * np.eye(len(cov)) + 1e-6 * np.eye(len(cov))
    low = np.linalg.cholesky(cov)
    return Gaussian(mean, np.linalg.inv(low), float(np.log(np.diag(low)).sum()))


def _pair(x, y, alpha, gamma) -> tuple[Gaussian, Gaussian]:
    parts = [x[y == k] for k in (0, 1)]
    pooled = sum((p - p.mean(0)).T @ (p - p.mean(0)) for p in parts) / max(len(x) - 2, 1)
    if len(x) < 4:  # so few rows tell no spread: the statistics are standardised, so take that
        pooled = np.eye(x.shape[1])
    return tuple(_gaussian(p, pooled, alpha if len(p) > 1 else 1.0, gamma) for p in parts)


def _calibrate(diff: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic regression on one variable by damped Newton steps."""
    x, w = np.stack([diff, np.ones_like(diff)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (y - p) - 1e-2 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of labelled statistics; the shrinkage with the least out-of-fold log loss, up to 4 folds
    with equal shares of both classes."""
    few = int(min((y == 0).sum(), (y == 1).sum()))
    if not few:
        return Model(None, None, None, None)
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - centre) / scale
    if few < 2:
        bad, good = _pair(z, y, POOLED[-1], IDENTITY[-1])
        return Model(centre, scale, bad, good)
    folds, fold = min(4, few), np.zeros(len(y), int)
    for c in (0, 1):
        fold[y == c] = np.arange((y == c).sum()) % folds
    best = None
    for alpha in POOLED:
        for gamma in IDENTITY:
            diff = np.zeros(len(z))
            for k in range(folds):
                bad, good = _pair(z[fold != k], y[fold != k], alpha, gamma)
                diff[fold == k] = good.log_density(z[fold == k]) - bad.log_density(z[fold == k])
            slope, offset = _calibrate(squash(diff), y)
            p = np.clip(1 / (1 + np.exp(-np.clip(slope * squash(diff) + offset, -30, 30))), 1e-9, 1 - 1e-9)
            loss = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
            if best is None or loss < best[0] - 1e-6:
                best = (loss, alpha, gamma, slope, offset)
    _, alpha, gamma, slope, offset = best
    bad, good = _pair(z, y, alpha, gamma)
    return Model(centre, scale, bad, good, slope, offset)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> Model:
    """Learns labels.quality from rows that are not held out, at most max_rows of them.

    The sample's ids (at most max_rows, 16 bytes each) are broadcast, so no text is shuffled."""
    spark = prepare(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect()
    if not ids:
        return Model(None, None, None, None)
    sample = spark.createDataFrame([(r[0], r[1]) for r in ids], "doc_id long, quality int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")

    def measure(batches):
        for b in batches:
            x = np.array([statistics(t) for t in b.column("text").to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    # repeated documents add no row to the sample: one row for each id, the least by its statistics
    got = rows.mapInArrow(measure, "doc_id long, quality int, x array<double>").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).orderBy("doc_id").toArrow()
    if not got.num_rows:
        return Model(None, None, None, None)
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
    y = got.column("quality").to_numpy().astype(np.float64)
    order = np.argsort((np.arange(len(y)) * 2654435761) % 4294967296, kind="stable")  # folds don't follow ids
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of docs; one pass, no shuffle."""
    prepare(docs.sparkSession)

    def apply(batches):
        for b in batches:
            x = np.array([statistics(t) for t in b.column("text").to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns; one pass, no shuffle."""
    prepare(docs.sparkSession)

    def apply(batches):
        for b in batches:
            x = np.array([statistics(t) for t in b.column("text").to_pylist()]).reshape(-1, FEATURES)
            yield b.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(apply, docs.schema)
