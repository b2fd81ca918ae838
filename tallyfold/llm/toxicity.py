"""Toxicity by a factorization machine over hashed terms.

A document's features are the hashed buckets of its distinct lower-case words and of
the words' beginnings. Buckets are chosen on labelled rows by a chi-square statistic; linear weights and
factor vectors (pairwise interactions) are then learned together.

Toxic rows are the few, so they weigh POSITIVE_WEIGHT times as much in the loss.

Defined cases: a null or empty text has no features and gets the score of the bias;
with no labelled rows, or one class only, every score is the base rate (0.5 without
rows); repeated rows are scored each; a label row whose id is null, or whose label is
neither 0 nor 1, is not used, and of contradicting labels of one id the greater counts;
ties of the bucket choice go to the smaller bucket; texts of any length are read whole;
an empty table gives no rows; other columns are not read.
"""

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallyfold.llm import common

BUCKETS = 1 << 18
#: At most so many labelled documents are used to fit (the smallest hashes of doc_id).
TRAIN_ROWS = 10_000
FEATURES = 2048
FACTORS = 6
POSITIVE_WEIGHT = 8.0
PREFIXES = (5, 7)
_WORD = re.compile(r"\w+")


def term_buckets(word: str) -> list[int]:
    """Buckets of a word and of its beginnings."""
    terms = [word] + [f"^{word[:n]}" for n in PREFIXES if len(word) >= n]
    return [zlib.crc32(t.encode()) % BUCKETS for t in terms]


class TermIndex:
    """Distinct buckets of a text, or the positions of those chosen."""

    def __init__(self, chosen: np.ndarray | None = None, most_words: int = 300_000):
        self.place = None if chosen is None else {int(b): i for i, b in enumerate(chosen)}
        self.cache: dict[str, list[int]] = {}
        self.most_words = most_words

    def __call__(self, text: str) -> np.ndarray:
        words = set(_WORD.findall(text.lower()))
        if len(self.cache) > self.most_words:
            self.cache.clear()
        found: set[int] = set()
        for w in words:
            at = self.cache.get(w)
            if at is None:
                at = term_buckets(w)
                if self.place is not None:
                    at = [self.place[b] for b in at if b in self.place]
                self.cache[w] = at
            found.update(at)
        return np.fromiter(found, dtype=np.int64, count=len(found))


@dataclass
class FactorizationMachine:
    chosen: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, at: np.ndarray) -> float:
        z = self.bias
        if len(at):
            v = self.factors[at]
            z += self.weights[at].sum() + 0.5 * ((v.sum(0) ** 2) - (v**2).sum(0)).sum()  # all pairs' products at once
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, chosen: np.ndarray, epochs: int = 150, rate: float = 0.05, l2: float = 2e-4, seed: int = 7, weight: float = POSITIVE_WEIGHT) -> FactorizationMachine:
    """Adam on the log loss, toxic rows weighted; rows hold positions in chosen."""
    n, m = len(rows), len(chosen)
    p0 = (labels.sum() + 1) / (n + 2) if n else 0.5
    machine = FactorizationMachine(chosen, float(np.log(p0 / (1 - p0))), np.zeros(m), np.zeros((m, FACTORS)))
    if not n or labels.min() == labels.max() or not m:
        return machine
    x = np.zeros((n, m), dtype=np.float32)
    for i, at in enumerate(rows):
        x[i, at] = 1
    y = labels.astype(np.float32)
    share = np.where(y == 1, weight, 1.0).astype(np.float32)
    share /= share.sum()
    rng = np.random.default_rng(seed)
    theta = [np.array([machine.bias], dtype=np.float32), np.zeros(m, dtype=np.float32), rng.normal(0, 0.01, (m, FACTORS)).astype(np.float32)]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, epochs + 1):
        b, w, v = theta
        xv = x @ v
        z = b[0] + x @ w + 0.5 * ((xv**2).sum(1) - x @ (v**2).sum(1))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        xg = x.T @ g
        grads = [np.array([g.sum()]), xg + l2 * w, x.T @ (g[:, None] * xv) - v * xg[:, None] + l2 * v]
        for k, d in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d * d
            theta[k] = (theta[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return FactorizationMachine(chosen, float(theta[0][0]), theta[1].astype(float), theta[2].astype(float))


def _count_buckets(batches):
    index, seen = TermIndex(), np.zeros((2, BUCKETS), dtype=np.int64)
    for batch in batches:
        for text, label in zip(batch.text, batch.label, strict=True):
            seen[int(label), index(text)] += 1
    at = np.flatnonzero(seen.any(0))
    yield pd.DataFrame({"bucket": at, "n0": seen[0, at], "n1": seen[1, at]})


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, learn, most: int) -> DataFrame:
    """text and label of at most `most` labelled documents, by the hash of the id; the broadcast side has at most `most` rows of two numbers."""
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & learn)
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(most)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    return common.keyed_texts(docs).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label")


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn=None, most: int = TRAIN_ROWS) -> FactorizationMachine:
    """Fits on labelled documents for which `learn` (a condition on doc_id) holds."""
    common.prepare(spark)
    learn = F.lit(True) if learn is None else learn
    sample = labelled_sample(docs, labels, "toxic", learn, most)
    counts = sample.mapInPandas(_count_buckets, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n = sample.groupBy().agg(F.count("*").alias("n"), F.sum("label").alias("pos")).first()
    total, pos = n["n"], n["pos"] or 0
    a, b = F.col("n1"), F.col("n0")
    gap = a * F.lit(float(total - pos)) - b * F.lit(float(pos))
    best = counts.where((a + b >= 3) & (a + b < total)).withColumn("chi", gap * gap / ((a + b) * (F.lit(float(total)) - a - b)))
    chosen = np.array([r[0] for r in best.orderBy(F.desc("chi"), "bucket").limit(FEATURES).select("bucket").collect()], dtype=np.int64)

    def rows(batches):
        index = TermIndex(chosen)
        for batch in batches:
            yield pd.DataFrame({"at": [index(t).astype(np.int32) for t in batch.text], "label": batch.label})

    got = sample.mapInPandas(rows, "at array<int>, label int").toPandas() if total else pd.DataFrame({"at": [], "label": []})
    return fit_machine([np.asarray(x, dtype=np.int64) for x in got["at"]], got["label"].to_numpy(dtype=np.int64), chosen)


def scorer(spark: SparkSession, machine: FactorizationMachine):
    """A column function from text to score; the model (FEATURES rows) is broadcast."""
    held = spark.sparkContext.broadcast(machine)

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = TermIndex(held.value.chosen)
        for texts in batches:
            yield pd.Series([held.value.score(index(t or "")) for t in texts], dtype="float64")

    return score


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    machine = train(spark, docs, common.read_table(spark, sf_dir, "labels"), learn=common.crc_of_id() % 5 != 0)
    return (
        common.keyed_texts(docs)
        .select("doc_id", (common.crc_of_id() % 5 == 0).alias("held_out"), scorer(spark, machine)("text").alias("score"))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )
