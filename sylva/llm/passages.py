"""Substring dedup by collinear chaining: fuzzy passages that a document shares with earlier documents.

1. Seeds are windows of five words, thinned to minimizers: of any eight neighbouring windows the one with the smallest
   hash is a seed, so two documents that share 12 words in a row share a seed.
2. The document that holds a seed first (the smallest identifier) is its anchor. Every other occurrence is joined to the anchor
   alone, so a seed that a third of all documents hold gives as many rows as it has occurrences, never pairs among them.
   Seeds with very many occurrences are dealt over tasks.
3. The matches of a document with an anchor are chained: positions ascend in both, gaps cost, and a Fenwick tree over the
   document's positions answers which earlier chain is best to go on from.
4. Chains are aligned word by word: between seeds, across edits, and outwards at both ends until too many words differ. A chain
   is cut where it runs over unrelated words between two passages, and where it is not alike enough; each piece is judged by
   itself. Tasks get the words around a chain only; chains that go on beyond those get more in a further
   round, unless another stretch of the document covers the place.
5. A document's aligned stretches are merged where they touch, whichever anchors they came from; merged passages of at least
   fifty words are the result.

A document is an identifier and a text: rows with one identifier and different texts are documents of their own, rows that agree
in both count once. Of rows with one identifier the one with the smallest hash of its text comes first. The order of rows
changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MIX, Scratch, as_bytes, dealt_join, hash_words, hot_keys, sift, slices, windows

K, WINDOW = 5, 8
LEAST_WORDS = 50
#: Words that an aligned stretch has at least before stretches are merged, and the largest gap between merged ones.
STRETCH, TOUCH = 16, 2
IDENTITY = 0.7
#: Chain score: a seed is worth SEED, each word of gap on either side costs GAP.
SEED, GAP = 8.0, 0.15
#: Words beyond the outermost seeds that the first round of alignment looks at, and how many times more each further round does.
MARGIN, WIDER = 64, 8


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def seeds_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and word positions of a document's minimizers; none below LEAST_WORDS words, where no passage fits."""
    if len(words) < LEAST_WORDS:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)
    h = windows(hash_words(words), K)
    w = min(WINDOW, len(h))
    n = len(h) - w + 1
    least = h[:n].copy()
    for j in range(1, w):
        np.minimum(least, h[j : j + n], out=least)
    chosen = np.zeros(len(h), dtype=bool)
    for j in range(w):
        chosen[j : j + n] |= h[j : j + n] == least
    at = np.flatnonzero(chosen)
    if len(at) > 1 and ((h[at[1:]] == h[at[:-1]]) & (np.diff(at) < w)).any():
        # a short period gives the same seed over and over. Where it goes on for LEAST_WORDS words the seed has a name of its
        # own, so that its anchor has as many; one in WINDOW places is enough to find it
        long = periodic(h, w)
        h = np.where(long, h * MIX, h)
        goes_on = (h[at[1:]] == h[at[:-1]]) & (np.diff(at) < w)
        start = np.flatnonzero(np.concatenate(([True], ~goes_on)))
        run = np.repeat(at[start], np.diff(np.append(start, len(at))))
        stretch = (at - run) // w
        at = at[np.concatenate(([True], ~goes_on | (np.diff(stretch) > 0)))]
    return h[at].view(np.int64), at.astype(np.int32)


def periodic(h: np.ndarray, w: int) -> np.ndarray:
    """Which windows stand where words repeat with a period below w for LEAST_WORDS words and more."""
    out = np.zeros(len(h), dtype=bool)
    for q in range(1, min(w, len(h))):
        edge = np.flatnonzero(np.diff(np.concatenate(([False], h[q:] == h[:-q], [False]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a + q + K - 1 >= LEAST_WORDS:
                out[a : b + q] = True
    return out


def _seeds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1000):
        found = [seeds_of(words_of(t)) for t in as_bytes(batch, "text")]
        sizes = [len(h) for h, _ in found]
        of = {c: pa.array(np.repeat(batch[c].to_numpy(zero_copy_only=False), sizes)) for c in KEY}
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h for h, _ in found])), *of.values(), pa.array(np.concatenate([p for _, p in found]))], names=["seed", *KEY, "pos"])


def _held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The seeds of each row, each once."""
    for batch in slices(batches, 1000):
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.unique(seeds_of(words_of(t))[0]) for t in as_bytes(batch, "text")]))], names=["seed"])


#: What tells documents apart: the identifier, and a hash of the text where several rows share it (else 0).
KEY = ["doc", "mark"]
PAIR = ["anchor", "anchor_mark", *KEY]


def grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """The columns PAIR, positions in the anchor and positions in the document, of rows sorted by PAIR."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.column_stack([batch[c].to_numpy() for c in (*PAIR, "at", "pos")])
        if rest is not None:
            rows = np.concatenate((rest, rows))
        cuts = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
        for a, b in zip([0, *cuts[:-1]], cuts, strict=False):
            yield rows[a, :4].tolist(), rows[a:b, 4], rows[a:b, 5]
        rest = rows[cuts[-1] if len(cuts) else 0 :]
    if rest is not None:
        yield rest[0, :4].tolist(), rest[:, 4], rest[:, 5]


def chain(at: np.ndarray, pos: np.ndarray) -> list[list[int]]:
    """Disjoint collinear chains of matches, best first, as lists of indices that ascend in both positions.

    With a cost for each word of gap on either side, the score of a chain that goes on from match i to match j is
    score(i) + GAP * (at_i + pos_i) + SEED - GAP * (at_j + pos_j). So the best i is a prefix maximum over positions in the
    document, which the Fenwick tree keeps while matches come in order of the anchor's positions.
    """
    if len(at) == 1:
        return [[0]]
    order = np.lexsort((-pos, at))
    if len(order) > 1:
        a, b = at[order], pos[order]
        step = np.diff(a)
        if (np.diff(b) == step).all() and (step > 0).all() and (2 * GAP * step < SEED).all():
            return [order.tolist()]  # one diagonal without a gap that costs more than a seed is worth
    ranks = (np.searchsorted(np.unique(pos), pos) + 1).tolist()
    a, b, n = at.tolist(), pos.tolist(), max(ranks, default=0)
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (n + 1)
    score, back = [0.0] * len(a), [-1] * len(a)
    for j in order.tolist():
        best, k = (-np.inf, -1), ranks[j] - 1
        while k > 0:
            if tree[k] > best:
                best = tree[k]
            k -= k & -k
        reached = best[0] - GAP * (a[j] + b[j])
        score[j], back[j] = (SEED + reached, best[1]) if reached > 0 else (SEED, -1)
        put, k = (score[j] + GAP * (a[j] + b[j]), j), ranks[j]
        while k <= n:
            if put > tree[k]:
                tree[k] = put
            k += k & -k
    # equal positions in the anchor come in descending order of pos, so none follows another of the same position
    used, out = [False] * len(a), []
    for j in sorted(range(len(a)), key=lambda j: (-score[j], j)):
        path = []
        while j >= 0 and not used[j]:
            used[j] = True
            path.append(j)
            j = back[j]
        if path:
            out.append(path[::-1])
    return out


def _chains(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for pair, at, pos in grouped(batches):
        for path in chain(at, pos):
            rows.append((*pair, at[path].tolist(), pos[path].tolist()))
        if len(rows) > 2000:
            yield _chain_rows(rows)
            rows = []
    yield _chain_rows(rows)


CHAINS = pa.schema([*((c, pa.int64()) for c in PAIR), ("at", pa.list_(pa.int32())), ("pos", pa.list_(pa.int32()))])


def _chain_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(CHAINS)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, CHAINS, strict=True)], schema=CHAINS)


def _words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's words as 32-bit hashes."""
    for batch in slices(batches, 1000):
        found = [(hash_words(words_of(t)) >> np.uint64(32)).astype("<u4").tobytes() for t in as_bytes(batch, "text")]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in KEY), pa.array(found, pa.binary())], names=[*KEY, "words"])


def reach(a: np.ndarray, b: np.ndarray, drop: int = 8) -> tuple[int, int, bool]:
    """How far two sequences go on alike from their starts, the words that match, and whether the shorter one ended first: +1 a
    match, -2 a mismatch, until the score falls `drop` below its best."""
    best, score, matched, k, same = -2, 0, 0, 0, 0
    for place, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=False), 1):
        if x == y:
            score, matched = score + 1, matched + 1
        else:
            score -= 2
        if score > best:
            best = score
            if score > 0:
                k, same = place, matched
        elif best - score > drop:
            return k, same, False
    return k, same, True


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Words that two short stretches have in common in order: place by place if as long, else the longest common subsequence."""
    if len(a) == len(b):
        return int((a == b).sum())
    if not len(a) or not len(b):
        return 0
    if len(a) > len(b):
        a, b = b, a
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a:
        # a cell takes the larger of the cell above, or of the cell above left plus one where words match; then runs on
        new = row.copy()
        new[1:] = np.maximum(row[1:], row[:-1] + (b == x))
        row = np.maximum.accumulate(new)
    return int(row[-1])


def align(a: np.ndarray, b: np.ndarray, at: np.ndarray, pos: np.ndarray, known: dict[tuple[int, int], int] | None = None) -> tuple[int, int, int, int, int, bool, bool]:
    """Start and end in a, start and end in b, and matching words of the passage around a chain of seeds; whether it goes on to
    the very start, and to the very end, of a or b.

    known keeps the matching words before each seed that is reached over a gap, for further calls on parts of the chain.
    """
    known = {} if known is None else known
    left, more, to_start = reach(a[: at[0]][::-1], b[: pos[0]][::-1])
    a0, b0, same = int(at[0]) - left, int(pos[0]) - left, more
    end_a, end_b = int(at[0]), int(pos[0])
    for x, y in zip(at.tolist(), pos.tolist(), strict=True):
        if x < end_a or y < end_b:  # seeds overlap
            fresh = min(x + K - end_a, y + K - end_b)
            if fresh <= 0:
                continue
            if x - end_a != y - end_b:
                end_a, end_b = max(end_a, x + K - fresh), max(end_b, y + K - fresh)
            same += fresh
        else:
            if x > end_a and y > end_b and (x, y) not in known:
                known[x, y] = common(a[end_a:x], b[end_b:y])
            same += (known[x, y] if x > end_a and y > end_b else 0) + K
        end_a, end_b = x + K, y + K
    right, more, to_end = reach(a[end_a:], b[end_b:])
    return a0, end_a + right, b0, end_b + right, same + more, to_start, to_end


def alike(a: np.ndarray, b: np.ndarray, at: np.ndarray, pos: np.ndarray) -> list[tuple[int, int, int, int, int, bool, bool]]:
    """align() of the pieces of a chain that are alike enough.

    A chain is cut where STRETCH words and more between two seeds match nothing. A piece that is not alike enough as a whole is
    split at the gap that lacks the most matching words, and so on.
    """
    known: dict[tuple[int, int], int] = {}
    if len(at) == 1:  # nothing to cut; most chains are a seed that two texts share by chance
        found = align(a, b, at, pos, known)
        size = found[1] - found[0]
        return [found] if size >= STRETCH and found[4] >= IDENTITY * size else []
    gaps = np.column_stack([np.diff(at), np.diff(pos)]) - K
    for k in np.flatnonzero((gaps > 0).all(axis=1)):
        x, y = int(at[k + 1]), int(pos[k + 1])
        known[x, y] = common(a[x - gaps[k, 0] : x], b[y - gaps[k, 1] : y])
    met = np.array([known.get((x, y), 0) for x, y in zip(at[1:].tolist(), pos[1:].tolist(), strict=True)], dtype=np.int64)
    # seeds that overlap lack the words by which one side goes on further than the other
    length = gaps.max(axis=1, initial=0) - np.minimum(gaps.min(axis=1, initial=0), 0)
    cuts = [0, *(np.flatnonzero(length - met >= STRETCH) + 1).tolist(), len(at)]
    lacking = IDENTITY * length - met
    out, waiting = [], list(zip(cuts, cuts[1:], strict=False))
    while waiting:
        low, high = waiting.pop()
        a0, a1, b0, b1, same, *_ = found = align(a, b, at[low:high], pos[low:high], known)
        if same >= IDENTITY * max(a1 - a0, b1 - b0):
            if min(a1 - a0, b1 - b0) >= STRETCH:
                out.append(found)
        elif high - low > 1 and lacking[low : high - 1].max() > 0:
            cut = low + 1 + int(np.argmax(lacking[low : high - 1]))
            waiting += [(cut, high), (low, cut)]
    return out


def _align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2000):
        rows = []
        for r in batch.to_pylist():
            a, b, a_from, b_from = np.frombuffer(r["a_words"], dtype="<u4"), np.frombuffer(r["b_words"], dtype="<u4"), r["a_from"], r["b_from"]
            # whether the texts go on where the words at hand end
            before = min(r["at"][0], r["pos"][0]) > min(r["at"][0] - a_from, r["pos"][0] - b_from)
            last_a, last_b = r["at"][-1], r["pos"][-1]
            after = min(r["a_length"] - last_a, r["b_length"] - last_b) > min(a_from + len(a) - last_a, b_from + len(b) - last_b)
            for a0, a1, b0, b1, same, to_start, to_end in alike(a, b, np.array(r["at"]) - a_from, np.array(r["pos"]) - b_from):
                rows.append((r["doc"], r["mark"], b0 + b_from, b1 + b_from, same, r["anchor"], a0 + a_from, a1 + a_from, r["chain"], to_start and before, to_end and after))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(STRETCHES)
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, STRETCHES, strict=True)], schema=STRETCHES)


STRETCHES = pa.schema([*((c, pa.int64()) for c in (*KEY, "start", "end", "n_matched", "source_id", "source_start", "source_end", "chain")), ("open_start", pa.bool_()), ("open_end", pa.bool_())])


def documents(docs: DataFrame) -> DataFrame:
    """KEY and text of the documents: rows of docs (doc_id, text) that have both, each once.

    The text's hash counts only where identifiers repeat; only the texts of those are shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("mark"), "text").where("doc is not null")
    repeated = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc")
    marked = sift(rows.where("text is not null"), "doc", repeated, n := repeated.count())
    alone = marked.where("not _maybe").select("doc", F.lit(0).cast("long").alias("mark"), "text")
    return alone.unionByName(marked.where("_maybe").drop("_maybe").dropDuplicates(KEY)) if n else alone


def stretches(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Aligned stretches: which words of a document (doc, mark) match which of an earlier one (source_id).

    Rows of docs (doc_id, text) without identifier or text have none.
    """
    rows = documents(docs)
    held = rows.mapInArrow(_held, "seed long").groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = scratch.table(held, "held")
    hot = scratch.table(hot_keys(held, "n"), "hot")
    seeds = rows.mapInArrow(_seeds, "seed long, doc long, mark long, pos int")
    met = scratch.table(dealt_join(seeds, held.select("seed"), ["seed"], hot, ["doc", "pos"], "left_semi"), "met")
    first = met.groupBy("seed").agg(F.min(F.struct(*KEY, "pos")).alias("first"))
    first = first.select("seed", F.col("first.doc").alias("anchor"), F.col("first.mark").alias("anchor_mark"), F.col("first.pos").cast("long").alias("at"))
    matches = dealt_join(met, scratch.table(first, "first"), ["seed"], hot, ["doc", "pos"]).where("doc <> anchor or mark <> anchor_mark")
    dealt = matches.select(*PAIR, "at", F.col("pos").cast("long").alias("pos")).repartition(*PAIR).sortWithinPartitions(*PAIR, "at", "pos")
    chains = scratch.table(dealt.mapInArrow(_chains, ", ".join(f"{c} long" for c in PAIR) + ", at array<int>, pos array<int>").select(F.monotonically_increasing_id().alias("chain"), "*"), "chains")
    words = scratch.table(_words_of(rows, chains), "words")
    scratch.drop("held", "met", "first")
    margin, found = MARGIN, None
    while True:
        more = _aligned(chains, words, margin)
        found = scratch.table(more if found is None else found.unionByName(more), f"stretches-{margin}")
        ongoing = scratch.table(_ongoing(found), f"ongoing-{margin}")
        if not ongoing.limit(1).count():
            return found
        # chains that go on are aligned again; their new stretches hold the old ones
        found = found.join(ongoing.hint("merge"), "chain", "left_anti").select(*found.columns)
        chains, margin = chains.join(ongoing.hint("merge"), "chain", "left_semi"), margin * WIDER


def _words_of(rows: DataFrame, chains: DataFrame) -> DataFrame:
    """The words of the documents that chains name: KEY, words."""
    used = chains.select(F.explode(F.array(F.struct(F.col("anchor").alias("doc"), F.col("anchor_mark").alias("mark")), F.struct(*KEY))).alias("u")).select("u.*").distinct()
    picked = sift(rows.withColumn("_key", F.struct(*KEY)), "_key", used.select(F.struct(*KEY).alias("_key")), used.count()).where("_maybe")
    return picked.join(used.hint("merge"), KEY, "left_semi").select(*KEY, "text").mapInArrow(_words, "doc long, mark long, words binary")


def _ongoing(found: DataFrame) -> DataFrame:
    """The chains of stretches that may go on where no other stretch of the document runs over the place."""
    own = Window.partitionBy(*KEY, "part")
    ends = _merged(found).withColumn("_low", F.min("start").over(own)).withColumn("_high", F.max("end").over(own))
    return ends.where((F.col("open_start") & (F.col("start") == F.col("_low"))) | (F.col("open_end") & (F.col("end") == F.col("_high")))).select("chain").distinct()


def _merged(found: DataFrame) -> DataFrame:
    """Stretches with `part`, the number of the passage within the document that they belong to."""
    own = Window.partitionBy(*KEY).orderBy("start", "end", "source_id", "source_start")
    reached = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("_fresh", F.when(F.col("start") <= reached + TOUCH, 0).otherwise(1)).withColumn("part", F.sum("_fresh").over(own)).drop("_fresh")


def _aligned(chains: DataFrame, words: DataFrame, margin: int) -> DataFrame:
    """Stretches of chains, with the words up to `margin` beyond their outermost seeds."""
    cut = _slice(chains.join(words.hint("merge"), KEY), "pos", "b", margin)
    sources = words.select(F.col("doc").alias("anchor"), F.col("mark").alias("anchor_mark"), "words")
    counts = chains.groupBy("anchor", "anchor_mark").agg(F.count(F.lit(1)).alias("n"))
    cut = dealt_join(cut, sources, ["anchor", "anchor_mark"], hot_keys(counts, "n"), ["doc", "mark", "chain"])
    cut = _slice(cut, "at", "a", margin)
    sides = [f"{side}_{c}" for side in "ab" for c in ("from", "length", "words")]
    return cut.select(*PAIR, "chain", "at", "pos", *sides).mapInArrow(_align, ", ".join(f"{f.name} {'boolean' if f.type == pa.bool_() else 'long'}" for f in STRETCHES))


def _slice(df: DataFrame, places: str, side: str, margin: int) -> DataFrame:
    """The words around a chain instead of the document's."""
    low = F.greatest(F.element_at(places, 1) - margin, F.lit(0))
    high = F.element_at(places, -1) + K + margin
    return df.withColumn(f"{side}_from", low).withColumn(f"{side}_length", F.floor(F.octet_length("words") / 4)).withColumn(f"{side}_words", F.substring("words", low * 4 + 1, (high - low) * 4)).drop("words")


def passages_of(docs: DataFrame, scratch: Scratch, least: int = LEAST_WORDS) -> DataFrame:
    """repeated_passages() with `mark`: 0, or the hash of the text whose passage it is where rows share an identifier."""
    merged = _merged(scratch.table(stretches(docs, scratch), "stretches")).groupBy(*KEY, "part")
    merged = merged.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_set("source_id")).alias("source_ids"))
    merged = merged.withColumn("n_words", F.col("end") - F.col("start")).where(F.col("n_words") >= least)
    return merged.select(F.col("doc").alias("doc_id"), "mark", "start", "end", "n_words", "source_ids")


def repeated_passages(docs: DataFrame, scratch: Scratch, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, start, end, n_words and source_ids of each passage of at least `least` words that earlier documents hold.

    start and end count words (end is the first word after the passage). The first document that holds a passage is named in
    source_ids and has no row of its own for it, so what remains after removing the passages holds each once. A document's
    stretches come from at most as many anchors as it has seeds, so no document gathers more rows than its length allows.
    Null, empty and short texts and rows without identifier have no passages; no rows in, no rows out.
    """
    return passages_of(docs, scratch, least).drop("mark")


def without_passages(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with the repeated passages cut out of the texts; words are joined by single blanks in texts that lose some.

    No row goes and no column changes but text. Rows without identifier or text stay as they are. Where rows share an
    identifier each loses its own passages only; only texts that may lose some are shuffled.
    """
    found = passages_of(docs, scratch)
    spans = scratch.table(found.groupBy(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans")), "spans")
    marked = sift(docs.withColumn("_key", F.col("doc_id").cast("long")), "_key", spans.select("_doc"), spans.count())
    own = (F.col("_key") == F.col("_doc")) & ((F.col("_mark") == 0) | (F.col("_mark") == F.xxhash64("text")))
    joined = marked.where("_maybe").join(spans.hint("merge"), own, "left")
    words = F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")
    kept = F.filter(F.transform(words, lambda w, k: F.when(~F.exists("_spans", lambda s: (k >= s["start"]) & (k < s["end"])), w)), lambda w: w.isNotNull())
    text: Column = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.array_join(kept, " "))
    return marked.where("not _maybe").select(*docs.columns).unionByName(joined.withColumn("text", text).select(*docs.columns))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated passages of all documents."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "passages"))
