"""Language ID by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams (1 to 3 letters, words padded with a blank), best first. A
document's own list is compared with each profile by out-of-place distance: the sum over the document's n-grams of how far
apart the two ranks are, and of the profile's length where the profile lacks the n-gram.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, ready, slices

TOP = 300
#: Documents of each language that profiles are learned from, about; a bound on training alone.
SAMPLE = 2000
#: Languages that profiles are learned for, at most.
LANGUAGES = 2000
UNKNOWN = "und"


@cache
def letter_table() -> np.ndarray:
    """For each code point 2 if it is a letter, 1 if it is a mark, which stands inside words, and 0 otherwise."""
    return np.fromiter(("ML".find(unicodedata.category(chr(c))[0]) + 1 for c in range(sys.maxunicode + 1)), dtype=np.uint8, count=sys.maxunicode + 1)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text as sorted integers (21 bits a character) and how often each occurs."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    kind = letter_table()[codes]
    if not (kind == 2).any():
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    letter = kind > 0
    codes = np.where(letter, codes, 32)
    keep = np.empty(len(codes), dtype=bool)
    keep[0] = letter[0]
    keep[1:] = letter[1:] | letter[:-1]  # one blank between words
    c = np.concatenate(([32], codes[keep], [32]))
    if c[-2] == 32:
        c = c[:-1]
    one, two = c[c != 32], (c[:-1] << 21) | c[1:]
    three = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[c[1:-1] != 32]
    return np.unique(np.concatenate((one, two, three)), return_counts=True)


def most_frequent(grams: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """Best first; of equally frequent n-grams the smaller integer comes first."""
    if len(grams) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.argsort(-counts, kind="stable")[:top]]


class Profiles:
    """Profiles of all languages side by side: for each known n-gram its rank in each language."""

    def __init__(self, by_language: dict[str, list[int]], top: int = TOP):
        self.top, self.languages = top, sorted(by_language)
        self.grams = np.array(sorted({g for grams in by_language.values() for g in grams}), dtype=np.int64)
        self.ranks = np.full((len(self.languages), len(self.grams) + 1), -1, dtype=np.int64)
        for k, name in enumerate(self.languages):
            own = np.array(by_language[name], dtype=np.int64)
            self.ranks[k, np.searchsorted(self.grams, own)] = np.arange(len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 - distance / largest possible distance; (und, 0) without letters or profiles."""
        grams = most_frequent(*gram_counts(text), self.top)
        if not len(grams) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, grams)
        known = at < len(self.grams)
        known[known] = self.grams[at[known]] == grams[known]
        ranks = self.ranks[:, np.where(known, at, len(self.grams))]
        apart = np.where(ranks >= 0, np.abs(ranks - np.arange(len(grams))), self.top).sum(axis=1)
        best = int(np.argmin(apart))
        return self.languages[best], float(1 - apart[best] / (len(grams) * self.top))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 500):
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            found.setdefault(lang, []).append(gram_counts(text))
        for lang, parts in found.items():
            grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            sums = np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(grams)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(sums)], names=["lang", "gram", "n"])


def learn(docs: DataFrame, sample: int = SAMPLE, top: int = TOP) -> Profiles:
    """Profiles from text and non-null lang of documents outside the held-out fold.

    About `sample` documents of each language are read: those whose identifier's hash falls below sample / number of the
    language's documents. What comes to the driver is `top` n-grams a language, of the LANGUAGES languages with most documents.
    """
    ready(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_docs")).orderBy(F.col("_docs").desc(), "lang").limit(LANGUAGES)
    share = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.join(F.broadcast(counts), "lang").where(share * F.col("_docs") < sample).select("lang", "text")
    grams = drawn.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    best = grams.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "gram", "rank").collect()
    by_language: dict[str, list[tuple[int, int]]] = {}
    for r in best:
        by_language.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return Profiles({lang: [g for _, g in sorted(pairs)] for lang, pairs in by_language.items()}, top)


def identify(docs: DataFrame, profiles: Profiles, carry: list[str]) -> DataFrame:
    """The carried columns plus lang_pred and score of each row's whole text; one row for each row, none dropped.

    Null texts and texts without a letter get ("und", 0). Columns of the input named lang_pred or score are not carried.
    """
    ready(docs.sparkSession)
    carry = [c for c in carry if c not in ("lang_pred", "score")]
    schema = docs.select(*carry).schema.add("lang_pred", "string").add("score", "double")

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            found = [profiles.predict(t) for t in batch["_text"].to_pylist()]
            kept = batch.select(carry)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*carry, "lang_pred", "score"])

    return docs.select(*carry, F.col("text").alias("_text")).mapInArrow(label, schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document: doc_id, held_out, lang_pred, score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), learn(docs), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: Documents below this score resemble no learned language.
LEAST_SCORE = 0.1


def reject_unknown(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs whose language is known: it is not und and the score is at least `least`. All columns stay."""
    found = identify(docs, learn(docs), docs.columns)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*docs.columns)
