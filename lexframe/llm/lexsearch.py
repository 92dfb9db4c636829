"""Ranked lexical search with LEMP-style norm buckets.

A document is a vector over the terms of the items: coordinate t is the integer impact w(t) * ((1e9 * tf) div (1000 * tf + 20 * m)). An item is a set
of terms, its score of a document the sum of their coordinates. One pass over the texts writes the term frequencies (of the items' terms only; no text
moves) and gives N, L and the document frequencies. Vectors are then ordered by length (norm): the longest of the whole table, told by a histogram of
norm classes, are searched first and set a threshold per item, the 50th best score so far; the others are searched with it. A task orders its vectors by
length as well and cuts them into buckets. Per bucket and item

* Cauchy-Schwarz: norm of the item times largest norm of the bucket below the threshold prunes the bucket;
* coordinate bounds: the largest coordinates of the bucket sum to less than the threshold: pruned; else only documents that hold one of
  the item's leading coordinates, without which the rest of the bounds stays below the threshold, and whose sum of those plus that rest reaches it, survive;
* survivors are rescored exactly in 64-bit integers.

Bounds only leave out what is below a threshold that 50 documents reach, so the ranking equals the one of all scores. Items go in blocks of at most
``ITEMS`` items and about ``BLOCK`` terms (one item alone may have more); a block is what tasks receive. A task holds 50 documents per item of the block and
``CHUNK`` vectors. A stated query set (items) meets all rows, in blocks.

Edge cases: null and empty texts have no term, count in nothing and are in no ranking; an item without terms has no rows; rows with the same
item_id are one item with the terms of all, a null id included; rows with the same doc_id are documents of their own; a null doc_id ranks after
others of its score; very long texts are whole vectors. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexframe.llm.common import map_batches, small_batches
from lexframe.sources.workdir import written

TOP = 50
ITEMS = 20_000
BLOCK = 500_000
SEEDS = 65_536  # of the longest vectors, searched first
CHUNK = 32_768
BUCKET = 2_048

_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of digits, ASCII letters and anything beyond ASCII, only A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(_KEPT).split()


def _item_blocks(items: DataFrame) -> Iterator[tuple[list, list[bytes], np.ndarray, np.ndarray]]:
    """Item ids, vocabulary, and per item a run of vocabulary indexes (flat, with starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, texts in small_batches(batches):
            sets = [sorted(set(terms_of(t))) for t in texts]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
            yield {"item_id": ids, "term": pa.array(list(chain.from_iterable(sets)), pa.binary())}

    rows = map_batches(items.select(F.col("item_id").cast("long"), "text"), run, "item_id long, term binary").distinct()
    ids: list = []
    vocabulary: dict[bytes, int] = {}
    flat: list[int] = []
    starts: list[int] = []

    def block():
        return ids, list(vocabulary), np.array(flat, np.int64), np.array(starts, np.int64)

    for row in rows.orderBy("item_id", "term").toLocalIterator():
        if not ids or row.item_id != ids[-1]:
            if len(ids) >= ITEMS or len(flat) >= BLOCK:
                yield block()
                ids, vocabulary, flat, starts = [], {}, [], []
            ids.append(row.item_id)
            starts.append(len(flat))
        flat.append(vocabulary.setdefault(bytes(row.term), len(vocabulary)))
    if ids:
        yield block()


def vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id, n`` (terms with repeats) and the vocabulary's indexes and frequencies in each text that has a term."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        index = shared.value.get
        for batch, texts in small_batches(batches):
            words = [terms_of(t) for t in texts]
            lengths = np.array([len(w) for w in words], np.int64)
            found = np.fromiter(map(index, chain.from_iterable(words), repeat(-1)), np.int64, int(lengths.sum()))
            keys = (np.repeat(np.arange(len(words)), lengths) * size + found)[found >= 0]
            keys, tf = np.unique(keys, return_counts=True)
            ends = np.searchsorted(keys, np.arange(1, len(words) + 1) * size)
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            rows = {"doc_id": batch.column(0), "n": pa.array(lengths), "terms": pa.ListArray.from_arrays(offsets, pa.array((keys % size).astype(np.int32))),
                    "tfs": pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int64)))}
            keep = pa.array(np.flatnonzero(lengths))
            yield {k: v.take(keep) for k, v in rows.items()}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n long, terms array<int>, tfs array<long>")


class _Chunk:
    """Vectors of a chunk: rows of (term, impact), a norm each; impacts carry the weight, norms half of it."""

    def __init__(self, table: pa.Table, weight: np.ndarray, total: tuple[int, int]):
        table = table.combine_chunks()
        terms, tfs = (table.column(c).chunk(0) for c in ("terms", "tfs"))
        counts = np.diff(terms.offsets.to_numpy())
        self.term = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        tf, n = tfs.flatten().to_numpy(zero_copy_only=False), table.column("n").to_numpy()
        docs, all_terms = total
        m = 50 + (50 * n * docs) // all_terms
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, counts))
        self.impact = impact * weight[self.term]
        self.row = np.repeat(np.arange(len(n)), counts)
        self.norm = np.sqrt(np.bincount(self.row, self.impact * impact.astype(np.float64), len(n)))
        doc = table.column("doc_id")
        self.unknown = np.asarray(doc.is_null())
        self.doc = doc.fill_null(np.iinfo(np.int64).max).to_numpy()

    def buckets(self, rows: np.ndarray, size: int) -> Iterator[_Bucket]:
        order = rows[np.argsort(-self.norm[rows], kind="stable")]
        starts = np.searchsorted(self.row, np.arange(len(self.norm) + 1))
        for i in range(0, len(order), size):
            yield _Bucket(self, order[i: i + size], starts)


class _Bucket:
    """Neighbours in length: their coordinates by row and by term, and the largest of each term."""

    def __init__(self, chunk: _Chunk, rows: np.ndarray, starts: np.ndarray):
        counts = starts[rows + 1] - starts[rows]
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        at = np.arange(self.ends[-1]) + np.repeat(starts[rows] - self.starts, counts)
        self.term, self.impact = chunk.term[at], chunk.impact[at]
        self.doc, self.unknown, self.longest = chunk.doc[rows], chunk.unknown[rows], float(chunk.norm[rows].max())
        by_term = np.argsort(self.term, kind="stable")
        self.lists = (np.repeat(np.arange(len(rows)), counts)[by_term], self.impact[by_term])
        ordered = self.term[by_term]
        self.begin = np.flatnonzero(np.diff(ordered, prepend=-1))
        self.held = ordered[self.begin]
        self.until = np.append(self.begin[1:], len(ordered))
        self.top = np.maximum.reduceat(self.lists[1], self.begin)


class _Search:
    """The best documents per item so far, and the score that a document must reach."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, weight: np.ndarray, threshold: np.ndarray, top: int):
        self.flat, self.starts, self.ends, self.top = flat, starts, np.append(starts[1:], len(flat)), top
        self.threshold = threshold.copy()
        self.norm = np.sqrt(np.add.reduceat(weight[flat].astype(np.float64), starts))
        self.best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        size = len(weight)
        self.bound, self.place, self.wanted = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.zeros(size, bool)
        self.counts = {"buckets": 0, "by_norm": 0, "by_bounds": 0, "survivors": 0, "documents": 0}

    def add(self, bucket: _Bucket) -> None:
        self.bound[bucket.held], self.place[bucket.held] = bucket.top, np.arange(len(bucket.held))
        bounds = self.bound[self.flat]
        reach = self.norm * bucket.longest * (1 + 1e-9) >= self.threshold
        near = reach & (np.add.reduceat(bounds, self.starts) >= self.threshold)
        self.counts["buckets"] += len(near)
        self.counts["by_norm"] += int((~reach).sum())
        self.counts["by_bounds"] += int((reach & ~near).sum())
        for item in np.flatnonzero(near).tolist():
            terms = self.flat[self.starts[item]: self.ends[item]]
            self._one(item, terms, bounds[self.starts[item]: self.ends[item]], bucket)
        self.bound[bucket.held], self.place[bucket.held] = 0, -1

    def _one(self, item: int, terms: np.ndarray, bounds: np.ndarray, bucket: _Bucket) -> None:
        least = self.threshold[item]
        order = np.argsort(-bounds)
        rest = np.cumsum(bounds[order][::-1])[::-1]  # bound of a coordinate and all smaller ones
        leading = int(np.count_nonzero(rest >= least))
        partial = np.zeros(len(bucket.doc), np.int64)
        rows, impact = bucket.lists
        for p in self.place[terms[order[:leading]]].tolist():
            part = slice(bucket.begin[p], bucket.until[p])
            partial[rows[part]] += impact[part]  # a row is once in the list of a term
        left = int(rest[leading]) if leading < len(rest) else 0
        survivors = np.flatnonzero((partial > 0) & (partial + left >= least))
        self.counts["documents"] += len(bucket.doc)
        self.counts["survivors"] += len(survivors)
        if not len(survivors):
            return
        score = partial[survivors]
        if left:
            self.wanted[terms] = True
            counts = bucket.ends[survivors] - bucket.starts[survivors]
            ends = np.cumsum(counts)
            at = np.arange(ends[-1]) + np.repeat(bucket.starts[survivors] - (ends - counts), counts)
            score = np.add.reduceat(np.where(self.wanted[bucket.term[at]], bucket.impact[at], 0), ends - counts)
            self.wanted[terms] = False
        good = score >= least
        found = (score[good], bucket.doc[survivors[good]], bucket.unknown[survivors[good]])
        if item in self.best:
            found = tuple(np.concatenate(pair) for pair in zip(self.best[item], found, strict=True))
        if len(found[0]) > self.top:
            first = np.lexsort((found[1], found[2], -found[0]))[: self.top]
            found = tuple(x[first] for x in found)
        self.best[item] = found
        if len(found[0]) == self.top:
            self.threshold[item] = max(least, int(found[0].min()))


def _chunks(batches: Iterator[pa.RecordBatch], weight: np.ndarray, total: tuple[int, int], rows: int) -> Iterator[_Chunk]:
    held: list[pa.RecordBatch] = []
    postings = count = 0
    for batch in batches:
        batch = batch.filter(pa.array(np.diff(batch.column(2).offsets.to_numpy()) > 0))
        held.append(batch)
        count += batch.num_rows
        postings += len(batch.column(2).flatten())
        if count >= rows or postings >= rows * 256:
            yield _Chunk(pa.Table.from_batches(held), weight, total)
            held, postings, count = [], 0, 0
    if count:
        yield _Chunk(pa.Table.from_batches(held), weight, total)


def _classes(norm: np.ndarray) -> np.ndarray:
    """Norm classes: eight per power of two."""
    return np.floor(8 * np.log2(np.maximum(norm, 1))).astype(np.int64)


def _rank(found: DataFrame, top: int) -> DataFrame:
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def _block(vecs: DataFrame, total: tuple[int, int], ids: list, flat: np.ndarray, starts: np.ndarray, size: int,
           top: int, seeds: int, chunk: int, bucket: int) -> DataFrame:
    context = vecs.sparkSession.sparkContext
    held = vecs.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()  # at most the block's vocabulary
    weight = np.zeros(size, np.int64)
    for row in held:
        weight[row.t] = math.floor(1000 * math.log((2 * total[0] + 2) / (2 * row.df + 1)))

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for some in _chunks(batches, weights.value, total, chunk):
            classes, counts = np.unique(_classes(some.norm), return_counts=True)
            yield {"class": pa.array(classes), "n": pa.array(counts.astype(np.int64))}

    def search(threshold: np.ndarray, low: int, high: int) -> DataFrame:
        queries = context.broadcast((ids, flat, starts, threshold))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            names, all_terms, begin, least = queries.value
            state = _Search(all_terms, begin, weights.value, least, top)
            for some in _chunks(batches, weights.value, total, chunk):
                classes = _classes(some.norm)
                for part in some.buckets(np.flatnonzero((classes >= low) & (classes < high)), bucket):
                    state.add(part)
            for item, (score, doc, unknown) in state.best.items():
                yield {"item_id": pa.array([names[item]] * len(score), pa.int64()), "doc_id": pa.array(doc, mask=unknown), "score": pa.array(score)}

        return _rank(map_batches(vecs, run, "item_id long, doc_id long, score long"), top)

    weights = context.broadcast(weight)
    histogram = map_batches(vecs, norms, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).orderBy(F.desc("class")).collect()
    first, cut = 0, 1 << 40
    for row in histogram:  # some hundred classes
        if first >= seeds:
            break
        first, cut = first + row.n, row["class"]
    least = np.ones(len(ids), np.int64)
    head = search(least, cut, 1 << 40)
    if first == sum(row.n for row in histogram):
        return head
    head = written(head, "longest")
    place = {i: at for at, i in enumerate(ids)}
    for row in head.filter(F.col("rank") == top).select("item_id", "score").collect():  # a row per item of the block
        least[place[row.item_id]] = max(1, row.score)
    return _rank(head.drop("rank").unionByName(search(least, -1, cut).drop("rank")), top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, seeds: int = SEEDS, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item."""
    total = None
    out = None
    for ids, vocabulary, flat, starts in _item_blocks(items):
        vecs = written(vectors(docs, vocabulary), "vectors")
        if total is None:
            row = vecs.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
            total = (row.n, row.l or 0)
        if not total[0]:
            break
        found = _block(vecs, total, ids, flat, starts, len(vocabulary), top, seeds, chunk, bucket)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
