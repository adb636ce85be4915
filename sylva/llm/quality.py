"""Quality rules and gradient-boosted trees over document statistics.

Every whole text gives a row of exact counts. Simple rules fail the worst documents; for the rest, boosted regression trees
on the logistic loss decide. The trees are flattened into numpy node arrays and scored a batch at a time. Chosen features
have a monotonic constraint: more repeated or symbol-ridden text never raises the score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, hash_words, held_out, ready, slices, windows

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_ends", "n_distinct"]
#: Labelled documents that the trees are learned from, at most about; a bound on training alone.
SAMPLE = 20_000
THRESHOLD = 0.5


def statistics(text: bytes | None) -> list[int]:
    """The counts named in COUNTS, of a whole text in UTF-8 (null: none).

    n_repeat_words counts the words in five-word windows that the text holds twice or more, the first one included;
    n_dup_lines the lines with a word that equal an earlier line.
    """
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if not x.isspace() and x]
    hashes = hash_words(words)
    runs = windows(hashes, 5)
    repeats = 0
    if len(runs):
        _, at, n = np.unique(runs, return_inverse=True, return_counts=True)
        twice = n[at] > 1
        if twice.any():
            steps = np.zeros(len(words) + 1, dtype=np.int64)
            steps[:-5] += twice[: len(words) - 4]
            steps[5:] -= twice[: len(words) - 4]
            repeats = int((np.cumsum(steps)[:-1] > 0).sum())
    codes = np.frombuffer(text, dtype=np.uint8)
    chars = int(((codes & 0xC0) != 0x80).sum()) - sum(text.count(bytes((c,))) for c in SPACES)
    hist = np.bincount(codes, minlength=256)
    return [len(words), chars, int(hist[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeats, len(lines), int(hist[65:91].sum()), int(hist[48:58].sum()), int(hist[[33, 46, 63]].sum()), len(np.unique(hashes))]


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2000):
        rows = np.array([statistics(t) for t in as_bytes(batch, "text")], dtype=np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(rows[:, k]) for k in range(len(COUNTS)))], names=["doc_id", *COUNTS])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every row's whole text."""
    ready(docs.sparkSession)
    schema = docs.select("doc_id").schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    return docs.select("doc_id", "text").mapInArrow(_measure, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


#: Name and monotonic constraint of each feature: -1, more of it never raises the score.
FEATURES = [("log_words", 0), ("chars_a_word", 0), ("symbols_a_char", -1), ("dup_lines", -1), ("repeated_words", -1), ("upper_a_char", -1), ("digits_a_char", 0), ("ends_a_word", 0), ("distinct_words", 0), ("words_a_line", 0)]


def features(rows: np.ndarray) -> np.ndarray:
    """Counts in the order of COUNTS to features in the order of FEATURES."""
    c = {name: rows[:, k].astype(np.float64) for k, name in enumerate(COUNTS)}
    some = lambda k: np.maximum(c[k], 1)
    return np.column_stack([np.log1p(c["n_words"]), c["word_chars"] / some("n_words"), c["n_symbols"] / some("word_chars"), c["n_dup_lines"] / some("n_lines"), c["n_repeat_words"] / some("n_words"), c["n_upper"] / some("word_chars"), c["n_digits"] / some("word_chars"), c["n_ends"] / some("n_words"), c["n_distinct"] / some("n_words"), c["n_words"] / some("n_lines")])


@dataclass
class Trees:
    """Flattened trees: node k sends a row left if its feature is at most the cut; feature -1 marks a leaf."""

    start: float = 0.0
    feature: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.empty(0))
    left: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int32))
    value: np.ndarray = field(default_factory=lambda: np.empty(0))
    roots: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int32))
    depth: int = 0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        at_row = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root, dtype=np.int64)
            for _ in range(self.depth):
                f = self.feature[node]
                right = x[at_row, np.maximum(f, 0)] > self.cut[node]
                node = np.where(f < 0, node, self.left[node] + right)
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


class Booster:
    """Histogram-based boosting of small trees by gradient and curvature of the logistic loss."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, least: float = 5.0, ridge: float = 1.0, signs: list[int] | None = None):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge, self.signs = trees, depth, rate, bins, least, ridge, signs

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """Rows without labels of both kinds give a constant."""
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        out = Trees(start=float(np.log(share / (1 - share))), depth=self.depth)
        if len(y) < 20 or y.min() == y.max():
            return out
        signs = self.signs or [0] * x.shape[1]
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
        margin = np.full(len(y), out.start)
        feature, cut, left, value, roots = [], [], [], [], []

        def leaf() -> int:
            for a, v in ((feature, -1), (cut, 0.0), (left, 0), (value, 0.0)):
                a.append(v)
            return len(feature) - 1

        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            grad, curve = y - p, p * (1 - p)
            roots.append(leaf())
            # node, its rows, the bounds its leaf values must keep
            level = [(roots[-1], np.arange(len(y)), -np.inf, np.inf)]
            step = np.zeros(len(y))
            for depth in range(self.depth + 1):
                below = []
                for node, rows, low, high in level:
                    g, h = grad[rows].sum(), curve[rows].sum()
                    value[node] = self.rate * float(np.clip(g / (h + self.ridge), low, high))
                    step[rows] = value[node]
                    best = self._split(binned, cuts, signs, rows, grad, curve, g, h, low, high) if depth < self.depth else None
                    if best is None:
                        continue
                    _, f, b, vl, vr = best
                    feature[node], cut[node] = f, float(cuts[f][b])
                    left[node] = leaf()
                    leaf()
                    goes = binned[rows, f] <= b
                    mid = (vl + vr) / 2
                    bounds = ((low, high), (low, high)) if not signs[f] else ((low, mid), (mid, high)) if signs[f] > 0 else ((mid, high), (low, mid))
                    below += [(left[node], rows[goes], *bounds[0]), (left[node] + 1, rows[~goes], *bounds[1])]
                level = below
            margin += step
        out.feature, out.left, out.roots = (np.array(a, dtype=np.int32) for a in (feature, left, roots))
        out.cut, out.value = np.array(cut), np.array(value)
        return out

    def _split(self, binned, cuts, signs, rows, grad, curve, g, h, low, high):
        best, base = None, g * g / (h + self.ridge)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            of = binned[rows, f]
            gl = np.cumsum(np.bincount(of, weights=grad[rows], minlength=len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(of, weights=curve[rows], minlength=len(c) + 1))[:-1]
            gr, hr = g - gl, h - hl
            vl, vr = np.clip(gl / (hl + self.ridge), low, high), np.clip(gr / (hr + self.ridge), low, high)
            gain = gl * gl / (hl + self.ridge) + gr * gr / (hr + self.ridge) - base
            fits = (hl >= self.least) & (hr >= self.least) & (signs[f] * (vr - vl) >= 0)
            if fits.any():
                b = int(np.argmax(np.where(fits, gain, -np.inf)))
                if gain[b] > 1e-6 and (best is None or gain[b] > best[0]):
                    best = (gain[b], f, b, float(vl[b]), float(vr[b]))
        return best


def learn(counts: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from the counts of labelled documents outside the held-out fold; null labels teach nothing.

    About `sample` labelled rows come to the driver: those whose identifier's hash falls below sample / their number. A
    document with both labels teaches with each; where identifiers repeat twice as many rows come at most.
    """
    known = labels.select("doc_id", "quality").where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    share = min(1.0, sample / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("quality sample")), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = counts.join(drawn, "doc_id").select("doc_id", *COUNTS, "quality").orderBy(F.xxhash64("doc_id"), "doc_id", *COUNTS, "quality").limit(2 * sample)
    rows = rows.toPandas().sort_values(["doc_id", *COUNTS, "quality"])
    x = features(rows[COUNTS].to_numpy(dtype=np.int64).reshape(-1, len(COUNTS)))
    return Booster(signs=[s for _, s in FEATURES]).fit(x, rows["quality"].to_numpy(dtype=np.float64))


def judge(counts: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """Adds quality (a probability), base_failed and kept to rows of counts."""
    ready(counts.sparkSession)
    own = counts.columns

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([batch[c].to_numpy(zero_copy_only=False) for c in COUNTS])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(trees.probability(features(rows)))], names=[*own, "quality"])

    scored = counts.mapInArrow(score, counts.select("*").schema.add("quality", "double"))
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document. A null text has no words, so it fails the rules."""
    scratch = Scratch(spark, "quality")
    counts = scratch.table(measure(spark.read.parquet(f"{sf_dir}/documents.parquet")), "counts")
    trees = learn(counts, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(counts, trees).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
