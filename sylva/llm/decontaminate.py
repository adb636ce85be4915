"""Benchmark decontamination by a BM25 inverted index of test items, searched with block-max WAND.

Every document is cut into overlapping passages of words, and every passage is a query. Items are grouped by length, and each
group has passages of its own size: 128 words every 64 for items of up to 64 words, twice that for up to 128, and so on. So
a copy of an item stands whole in some passage, wherever it starts and however long it is. A test item's score is divided by the
score it gives itself, so one threshold holds for all items. The index keeps, for each term, the largest score in all items
and in each block of items. Where the largest scores of a passage's terms do not add up to the threshold in any block, no item
can reach it; that is worked out for all passages of a document in one step. The other passages go through block-max WAND,
which returns every item at or above the threshold.

A candidate counts as a leak if the passage holds both the question and the answer: the share of the item's word pairs and
of those of its last words that stand in the passage.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, ready, slices

K1, B = 1.2, 0.75
#: Words of a passage, and from one passage's start to the next, for items of up to PASSAGE - STEP words; doubled for longer ones.
PASSAGE, STEP = 128, 64
THRESHOLD = 0.6
#: Blocks of items that an index has at most, and bytes of text in one index that goes to the executors.
BLOCKS, INDEX_BYTES = 64, 4 << 20
#: Share of the word pairs of question and answer that a leak must hold.
OVERLAP = 0.7
#: The answer is the last third of an item's words, four at least.
ANSWER_SHARE, ANSWER_WORDS = 3, 4
CUT = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b"abcdefghijklmnopqrstuvwxyz" + b" " * 32)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case words without ASCII signs."""
    return (text or b"").translate(CUT).split()


def length_class(n: int) -> int:
    """How often PASSAGE and STEP are doubled for an item of n words, so that it fits a passage at any start."""
    return max(0, (max(1, -(-n // (PASSAGE - STEP))) - 1).bit_length())


class Numbers(dict):
    """Term numbers; any other word gets the number after the last."""

    def __missing__(self, word: bytes) -> int:
        return len(self)


class Index:
    """Scores of all (term, item) pairs, by term, with the largest of each block of items."""

    def __init__(self, items: list[tuple[int, bytes]], total: int | None = None, frequency: dict[bytes, int] | None = None, mean: float | None = None):
        """total, frequency and mean describe all items where these are only a part of them."""
        held = sorted((length_class(len(w)), i, w) for i, w in ((i, words_of(t)) for i, t in items) if w)
        self.ids, self.words = [i for _, i, _ in held], [w for _, _, w in held]
        #: Length classes, the first item of each and the first after it.
        own = [c for c, _, _ in held]
        self.classes = [(c, bisect_left(own, c), bisect_left(own, c + 1)) for c in sorted(set(own))]
        counts = [Counter(w) for w in self.words]
        df = frequency if frequency is not None else Counter(t for c in counts for t in c)
        n, mean = total or len(held), mean or sum(map(len, self.words)) / max(1, len(held))
        idf = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for c in counts for t in c}
        self.terms = {t: k for k, t in enumerate(sorted(idf))}
        self.number = Numbers(self.terms)
        self.postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for k, c in enumerate(counts):
            norm = K1 * (1 - B + B * len(self.words[k]) / mean)
            score = {t: idf[t] * f * (K1 + 1) / (f + norm) for t, f in c.items()}
            own = sum(score.values())
            for t, x in score.items():
                self.postings[self.terms[t]].append((k, x / own))
        self.block = max(1, -(-len(held) // BLOCKS))
        self.best = [max(x for _, x in p) for p in self.postings]
        self.block_best = np.zeros((len(self.postings), BLOCKS), dtype=np.float32)
        for t, p in enumerate(self.postings):
            for k, x in p:
                self.block_best[t, k // self.block] = max(x, self.block_best[t, k // self.block])

    def search(self, terms: Iterable[int], least: float, first: int = 0, end: int | None = None) -> list[tuple[int, float]]:
        """Every item from first to before end whose score is at least `least`, by block-max WAND over the postings of the distinct terms."""
        end = len(self.ids) if end is None else end
        cursors = [[p := self.postings[t], bisect_left(p, (first,)), self.best[t], self.block_best[t].tolist(), bisect_left(p, (end,))] for t in terms]
        cursors = [c for c in cursors if c[1] < c[4]]
        out = []
        least -= 1e-9  # sums of the same numbers differ by their order
        while cursors:
            cursors.sort(key=lambda c: c[0][c[1]][0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[2]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0][cursors[pivot][1]][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0][cursors[pivot + 1][1]][0] == item:
                pivot += 1
            block = item // self.block
            if sum(c[3][block] for c in cursors[: pivot + 1]) < least - 1e-5:
                # nothing in this block before the next list's item can do
                to = (block + 1) * self.block
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0][cursors[pivot + 1][1]][0])
                moved = cursors[: pivot + 1]
                to = max(to, item + 1)
            elif cursors[0][0][cursors[0][1]][0] == item:
                score = sum(c[0][c[1]][1] for c in cursors[: pivot + 1])
                if score >= least:
                    out.append((item, score))
                moved, to = cursors[: pivot + 1], item + 1
            else:
                moved, to = [c for c in cursors[:pivot] if c[0][c[1]][0] < item], item
            for c in moved:
                postings, at = c[0], c[1]
                while at < c[4] and postings[at][0] < to:
                    at += 1
                c[1] = at
            cursors = [c for c in cursors if c[1] < c[4]]
        return out

    def overlap(self, item: int, passage: list[bytes]) -> tuple[float, float]:
        """Shares of the word pairs (words, if there is one only) of question and answer that stand in the passage."""
        own = self.words[item]
        answer = max(ANSWER_WORDS, len(own) // ANSWER_SHARE)
        pairs = lambda w: Counter(zip(w, w[1:], strict=False)) if len(w) > 1 else Counter(w)
        there = pairs(passage) + Counter(passage)
        share = lambda part: sum(min(n, there[g]) for g, n in part.items()) / max(1, part.total())
        return share(pairs(own[: -answer + 1] if len(own) > answer else own)), share(pairs(own[-answer:]))

    def leaks(self, text: bytes | None, least: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[int, float, float, float]]:
        """Item, best score, question share and answer share of every item that a passage of the text gives away."""
        words = words_of(text)
        none = len(self.terms)
        at = np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))
        hits = np.flatnonzero(at < none)
        if not len(hits):
            return []
        found: dict[int, tuple[float, float, float]] = {}
        for grade, low, high in self.classes:
            size, step = PASSAGE << grade, STEP << grade
            blocks = slice(low // self.block, (high - 1) // self.block + 1)
            # distinct terms of each stretch of `step` words, and the sums of their largest scores in each block of items
            named = np.unique((hits // step) * (none + 1) + at[hits])
            stretch, terms = np.divmod(named, none + 1)
            first = np.flatnonzero(np.diff(stretch, prepend=-1))
            sums = np.zeros((len(words) // step + size // step + 1, blocks.stop - blocks.start), dtype=np.float32)
            sums[stretch[first]] = np.add.reduceat(self.block_best[terms, blocks], first, axis=0)
            count = max(1, -(-(len(words) - size) // step) + 1)
            bound = sum(sums[k : k + count] for k in range(size // step))
            for k in np.flatnonzero(bound.max(axis=1) >= least - 1e-4):
                start = int(k) * step
                passage, own = words[start : start + size], at[start : start + size]
                distinct = np.unique(own[own < none])
                if self.block_best[distinct, blocks].sum(axis=0).max() < least - 1e-4:  # stretches had some terms in common
                    continue
                for item, score in self.search(distinct.tolist(), least, low, high):
                    question, answer = self.overlap(item, passage)
                    if question >= overlap and answer >= overlap and score > found.get(item, (0.0,))[0]:
                        found[item] = (score, question, answer)
        return [(self.ids[i], *x) for i, x in sorted(found.items())]


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of the items (item_id, text), each of about INDEX_BYTES of text at most; usually one.

    Items without words or identifier are left out; of repeated identifiers each row counts. Where there are several indexes,
    term frequencies are counted over all items first, so cutting changes no score.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("item_id is not null and text is not null")
    held = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    parts = -(-int(held["b"] or 0) // INDEX_BYTES)
    if parts <= 1:
        yield Index([(r["item_id"], bytes(r["text"])) for r in rows.collect()])
        return
    total, words, frequency = 0, 0, Counter()
    for r in rows.toLocalIterator():
        own = words_of(bytes(r["text"]))
        total, words = total + bool(own), words + len(own)
        frequency.update(set(own))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for k in range(parts):
        yield Index([(r["item_id"], bytes(r["text"])) for r in rows.where(part == k).collect()], total, frequency, words / max(1, total))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap and answer_overlap of each test item that a row of docs gives away.

    A row for each (row of docs, item): repeated rows repeat, a null doc_id stays null, null and empty texts give nothing.
    """
    ready(docs.sparkSession)
    schema = docs.select("doc_id").schema.add("item_id", "long").add("score", "double").add("question_overlap", "double").add("answer_overlap", "double")
    out = None
    for index in indexes(benchmark):

        def search(batches: Iterable[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1000):
                rows = [(doc_id, *leak) for doc_id, text in zip(batch["doc_id"].to_pylist(), as_bytes(batch, "text"), strict=True) for leak in index.leaks(text)]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                types = [batch.schema.field("doc_id").type, pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

        found = docs.select("doc_id", "text").mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return out


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak of a test item in a document."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that give no test item away. All columns stay; rows without an identifier are judged as any other."""
    ready(docs.sparkSession)
    out = docs
    for index in indexes(benchmark):

        def clean(batches: Iterable[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1000):
                keep = pa.array([not index.leaks(t) for t in as_bytes(batch, "text")], pa.bool_())
                yield batch.filter(keep)

        out = out.mapInArrow(clean, out.schema)
    return out
