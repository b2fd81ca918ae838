"""Quality by regularised quadratic discriminant analysis of document statistics.

Each class has a mean and a covariance shrunk towards its diagonal and the pooled
one; a score is the logistic of the difference of log densities, from Mahalanobis
distances by cached Cholesky factors.

Defined cases: null and empty texts have the statistics of an empty text and are
scored like others; without labelled rows of both classes each score is the base rate
(0.5 without rows); repeated rows are scored each, and equal texts alike; label rows
without id, or whose label is neither 0 nor 1, are not used; rows without doc_id are left
out; texts of any length are read whole; an empty table gives no rows; other columns are
not read.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallyfold.llm import common
from tallyfold.llm.toxicity import labelled_sample

TRAIN_ROWS = 20_000
SHRINK = 0.1
_UPPER, _LOWER = slice(65, 91), slice(97, 123)
_STOPS = np.frombuffer(b".,;:'\"()-", dtype=np.uint8)
_SYMBOLS = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{|}~!?", dtype=np.uint8)
N_STATS = 13


def statistics(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, nw, nl = max(len(raw), 1), max(len(words), 1), max(len(lines), 1)
    hist = np.bincount(raw, minlength=256)
    upper, lower = hist[_UPPER].sum(), hist[_LOWER].sum()
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    distinct = len(set(words))
    return np.array([
        np.log1p(len(words)),
        np.sqrt(upper / max(upper + lower, 1)),
        np.sqrt(hist[48:58].sum() / n),
        np.sqrt(hist[_SYMBOLS].sum() / n),
        np.sqrt(hist[_STOPS].sum() / n),
        np.log1p(lengths.mean()),
        np.log1p(lengths.std()),
        np.log1p(distinct) / np.log1p(nw),
        np.log1p(len(words) / nl),
        np.sqrt(hist[128:].sum() / n),
        np.sqrt(1 - len(set(lines)) / nl) if lines else 0.0,
        np.sqrt((lengths <= 3).mean()),
        np.sqrt(sum(map(str.isalpha, words)) / nw),
    ])


@dataclass
class Discriminant:
    """means and inverse Cholesky factors of class 0 and class 1, over scaled statistics."""

    scale: tuple[np.ndarray, np.ndarray] | None
    means: list[np.ndarray]
    whiten: list[np.ndarray]
    offsets: list[float]
    base: float

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.scale is None:
            return np.full(len(stats), self.base)
        z = (stats - self.scale[0]) / self.scale[1]
        logs = [o - 0.5 * (((z - m) @ w.T) ** 2).sum(1) for m, w, o in zip(self.means, self.whiten, self.offsets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -30, 30)))


def fit_discriminant(stats: np.ndarray, labels: np.ndarray, shrink: float = SHRINK) -> Discriminant:
    n = len(labels)
    base = float((labels.sum() + 1) / (n + 2)) if n else 0.5
    if n == 0 or min((labels == 0).sum(), (labels == 1).sum()) < 2:
        return Discriminant(None, [], [], [], base)
    mean, std = stats.mean(0), stats.std(0)
    std[std < 1e-9] = 1
    z = (stats - mean) / std
    pooled = np.cov(z.T) + 1e-6 * np.eye(z.shape[1])
    means, whiten, offsets = [], [], []
    for k in (0, 1):
        own = z[labels == k]
        cov = np.cov(own.T)
        cov = (1 - shrink) * ((1 - shrink) * cov + shrink * np.diag(np.diag(cov))) + shrink * 0.2 * pooled + 1e-3 * np.eye(z.shape[1])
        chol = np.linalg.cholesky(cov)
        means.append(own.mean(0))
        whiten.append(np.linalg.inv(chol))
        offsets.append(float(np.log(len(own) / n) - np.log(np.diag(chol)).sum()))
    return Discriminant((mean, std), means, whiten, offsets, base)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn=None, most: int = TRAIN_ROWS) -> Discriminant:
    common.prepare(spark)
    sample = labelled_sample(docs, labels, "quality", F.lit(True) if learn is None else learn, most)

    def rows(batches):
        for batch in batches:
            yield pd.DataFrame({"stats": [statistics(t) for t in batch.text], "label": batch.label})

    got = sample.mapInPandas(rows, "stats array<double>, label int").toPandas()
    stats = np.array([np.asarray(x) for x in got["stats"]]).reshape(-1, N_STATS)
    return fit_discriminant(stats, got["label"].to_numpy(dtype=np.int64))


def scorer(spark: SparkSession, model: Discriminant):
    """A column function from text to score; the model is a few hundred numbers."""

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(np.array([statistics(t or "") for t in texts]).reshape(-1, N_STATS)), dtype="float64")

    return score


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    model = train(spark, docs, common.read_table(spark, sf_dir, "labels"), learn=common.crc_of_id() % 4 != 2)
    return (
        common.keyed_texts(docs)
        .select("doc_id", (common.crc_of_id() % 4 == 2).alias("held_out"), scorer(spark, model)("text").alias("score"))
        .withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
    )
