"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document is the set of its words, of the stems of its words, of its word pairs and of its pairs with one or two words
skipped, each hashed into a fixed number of buckets. Every bucket has a learning rate of its own; the L1 term keeps nearly
all weights at exactly zero, so what goes to the executors is a short list of buckets and weights.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, ready, slices

BUCKETS = 1 << 22
#: Labelled documents that the weights are learned from, at most about; a bound on training alone.
SAMPLE = 12_000
#: Longer texts teach nothing; they are scored as any other.
SAMPLE_BYTES = 1 << 18
THRESHOLD = 0.3
#: Letters of a word's stems. Inflected forms share them, so a form that training never saw still counts.
STEMS = (3, 4, 5, 6)
SKIPS = (1, 2, 3)
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)


@cache
def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


@cache
def _powers(base: int, bits: int) -> np.ndarray:
    """base ** k modulo 2 ** 64 for k below 2 ** bits."""
    out = np.ones(1 << bits, dtype=np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def spread(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint64(kind)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(42)).astype(np.int64)


def buckets(text: str | None) -> np.ndarray:
    """The buckets of all n-grams of a whole text, repeats included (none for null and empty texts).

    Words are runs of letters. Hashes of words and stems come from running sums over the characters, so no step goes word
    by word.
    """
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = np.zeros(len(codes) + 2, dtype=np.int8)
    inside[1:-1] = letter_table()[codes]
    edges = np.diff(inside)
    start, end = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)
    if not len(start):
        return np.empty(0, dtype=np.int64)
    bits = max(12, len(codes).bit_length())
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * _powers(STEP, bits)[: len(codes)], out=sums[1:])
    back = _powers(BACK, bits)
    h = (sums[end] - sums[start]) * back[start]
    parts = [spread(h, 1)]
    for k in STEMS:
        at = start[end - start >= k]
        parts.append(spread((sums[at + k] - sums[at]) * back[at], 100 + k))
    parts += [spread(h[:-gap] * np.uint64(STEP) + (h[gap:] ^ (h[gap:] >> np.uint64(31))), 200 + gap) for gap in SKIPS if len(h) > gap]
    return np.concatenate(parts)


class Ftrl:
    """Follow the regularised leader, proximal form, for logistic loss on sets of buckets."""

    def __init__(self, rate: float = 0.3, smooth: float = 1.0, l1: float = 1.0, l2: float = 0.5):
        self.rate, self.smooth, self.l1, self.l2 = rate, smooth, l1, l2
        self.z, self.n = np.zeros(BUCKETS), np.zeros(BUCKETS)
        self.bias_z = self.bias_n = 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.smooth + np.sqrt(self.n[at])) / self.rate + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def bias(self) -> float:
        return -self.bias_z / ((self.smooth + self.bias_n**0.5) / self.rate)

    def learn(self, at: np.ndarray, label: int) -> None:
        w, b = self.weights(at), self.bias()
        p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
        g = float(p - label)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.rate * w
        self.n[at] = n + g * g
        self.bias_z += g - ((self.bias_n + g * g) ** 0.5 - self.bias_n**0.5) / self.rate * b
        self.bias_n += g * g

    def model(self) -> Model:
        at = np.flatnonzero(np.abs(self.z) > self.l1)
        return Model(at.astype(np.int32), self.weights(at).astype(np.float32), self.bias())


class Model:
    """The buckets with a weight; all that scoring needs."""

    def __init__(self, at: np.ndarray, weight: np.ndarray, bias: float):
        self.at, self.weight, self.bias = at, weight, bias
        self._dense: np.ndarray | None = None

    def __getstate__(self):
        return {"at": self.at, "weight": self.weight, "bias": self.bias, "_dense": None}

    def score(self, text: str | None) -> float:
        if self._dense is None:
            self._dense = np.zeros(BUCKETS, dtype=np.float32)
            self._dense[self.at] = self.weight
        at = buckets(text)
        at = np.unique(at[self._dense[at] != 0])  # few have a weight
        margin = float(self._dense[at].sum(dtype=np.float64)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(margin, -35, 35)))) if margin > -np.inf else 0.0


def _hash(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 500):
        sets = [np.unique(buckets(t)).astype("<i4").tobytes() for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["_order"], batch["toxic"], pa.array(sets, pa.binary())], names=["_order", "toxic", "at"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = 3) -> Model:
    """Weights from labelled documents outside the held-out fold, seen in the order of a hash of their identifiers.

    About `sample` labelled rows are hashed and come to the driver, about twice as many at most where identifiers repeat, and none
    with a text of more than SAMPLE_BYTES. Labels that are null or neither 0 nor 1 are skipped. Without any, every score is 0.
    """
    ready(docs.sparkSession)
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    share = min(1.0, sample / max(1, known.count()))
    drawn = known.withColumn("_order", F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1 << 40)))
    drawn = drawn.where(F.col("_order") < int(share * (1 << 40)))
    short = docs.select("doc_id", "text").where(F.col("text").isNull() | (F.octet_length("text") <= SAMPLE_BYTES))
    rows = short.join(F.broadcast(drawn), "doc_id").select("_order", "toxic", "text")  # `sample` labels
    n = docs.select("doc_id").join(F.broadcast(drawn), "doc_id").count()
    if n > 2 * sample:  # identifiers repeat
        rows = rows.where(F.pmod(F.xxhash64("_order", "text", "toxic"), F.lit(1 << 30)) < 2 * sample * (1 << 30) // n)
    sets = rows.mapInArrow(_hash, "_order long, toxic int, at binary").toLocalIterator()
    seen = sorted(((r["_order"], bytes(r["at"]), r["toxic"]) for r in sets))
    if not seen:
        return Model(np.empty(0, dtype=np.int32), np.empty(0, dtype=np.float32), -np.inf)
    ftrl = Ftrl()
    for _ in range(epochs):
        for _, at, label in seen:
            ftrl.learn(np.frombuffer(at, dtype="<i4"), label)
    return ftrl.model()


def rate(docs: DataFrame, model: Model, carry: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The carried columns plus score (0 to 1) and predicted (1 from `threshold`) of each row's whole text.

    Null and empty texts get what the bias says. Columns of the input named score or predicted are not carried.
    """
    ready(docs.sparkSession)
    carry = [c for c in carry if c not in ("score", "predicted")]
    schema = docs.select(*carry).schema.add("score", "double")

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            found = pa.array([model.score(t) for t in batch["_text"].to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.select(carry).columns, found], names=[*carry, "score"])

    scored = docs.select(*carry, F.col("text").alias("_text")).mapInArrow(score, schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document: doc_id, held_out, score, predicted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rated = rate(docs.select("doc_id", "text"), learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), ["doc_id"])
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
