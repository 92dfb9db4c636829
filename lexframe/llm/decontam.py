"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages, weighted by TF-IDF (frequencies over all documents; a word everywhere keeps a fifth of the weight of one
nowhere, so that an item many documents hold keeps its place; a word counts once in each half of a passage) and factored by a distributed randomised
SVD: a Gaussian sketch, power iterations by sums of partial products, then an eigen-decomposition of one small matrix. Every document is cut into overlapping
windows of words. All windows meet all passages in the latent space, in block products of matrices; a window retrieves the items near it (cosine of
``COSINE`` or more), and nothing else does. An exact check follows: a region (a window with an item's length on both sides) is an item's if their
longest common subsequence of the words that tell (those not in a tenth of all documents) has half of the item's, or if it has ``PARAPHRASE`` and the
item's answer is there (its ``answer`` column, else its last sentence). Retrieved regions with fewer of the item's words than that need no subsequence.

Bounds: vocabulary and factors of at most ``MAX_WORDS`` benchmark words are sent to the tasks at a time; a larger benchmark is worked
through in parts by item, each with factors of its own. Documents are never gathered; a task holds ``GROUP`` words in windows at a time.

Edge cases: null and empty documents and items match nothing; items without a word are skipped; items with equal texts all match; repeated
document rows are judged each for itself; long documents are searched whole, in blocks. Without benchmark items every document is
clean. An empty table gives no rows. Other columns are carried along by ``decontaminate``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm.common import append, checkpoint, map_batches, ramp, ship

WINDOW = 64
STRIDE = 32
RANK = 192
OVERSAMPLE = 16
POWER = 2
MAX_WORDS = 1 << 16  # distinct benchmark words a part may have; RANK floats each
RARE = 4.0  # what a word of no document weighs beyond one of all documents
COSINE = 0.35  # of a window and an item that it retrieves
SEQUENCE = 0.5  # of the telling words of an item, in order, within the region
PARAPHRASE = 0.35  # the same if the answer is there too
COMMON = 0.1  # words in more than this share of the documents do not count in common subsequences ...
FEW = 5  # ... unless an item has fewer others
BLOCK = 1 << 15
GROUP = 1 << 16  # words of documents searched together ...
CELLS = 1 << 18  # ... and their numbers held at a time beside their windows

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.?!])\s+")
_BLANKS = {c: " " for c in range(128) if not _WORD.match(chr(c))}


def words_of(text: str | None) -> list[str]:
    lower = (text or "").lower()
    return lower.translate(_BLANKS).split() if lower.isascii() else _WORD.findall(lower)


def answer_of(text: str | None, answer: str | None = None) -> list[str]:
    if answer:
        return words_of(answer)
    parts = [p for p in _SENTENCE.split((text or "").strip()) if _WORD.search(p)]
    return words_of(parts[-1]) if parts else []


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, a machine word of ``a`` at a time (bits of a Python integer)."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b:
        match = row & at.get(x, 0)
        row = (row + match | row - match) & full
    return len(a) - row.bit_count()


def _passages(words: list[str]) -> list[list[str]]:
    return [words[i: i + WINDOW] for i in range(0, max(1, len(words) - STRIDE), STRIDE)] if len(words) > WINDOW else [words]


def _sum_by_feature(partial: DataFrame, width: int) -> DataFrame:
    """Rows ``f, x`` (vectors of one width) -> their sums by ``f``, a shard of features at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for f, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                value = x.values.to_numpy()
                total[f] = total[f] + value if f in total else value
        yield {"f": pa.array(list(total), pa.int64()), "x": pa.array(list(total.values()), pa.list_(pa.float64()))}

    return map_batches(partial.repartition("f"), add, "f long, x array<double>")


def _once_a_half(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The known words of a passage and in how many of its halves each is."""
    halves = [np.unique(ids[at: at + STRIDE]) for at in range(0, len(ids), STRIDE)]
    f, n = np.unique(np.concatenate([np.zeros(0, np.int64), *halves]), return_counts=True)
    return f[f >= 0], n[f >= 0]


class Latent:
    """Words -> weighted rows of the right factor, and the benchmark passages in the latent space."""

    def __init__(self, words: dict[str, int], idf: np.ndarray, weight: np.ndarray, factor: np.ndarray):
        self.words = words
        self.rows = np.zeros((len(words) + 1, factor.shape[1]), np.float32)  # the last row is that of all unknown words
        self.rows[:-1] = weight[:-1, None] * factor
        self.items: list[tuple[int, int, list[int], list[int], bool]] = []
        self.telling = np.append(idf[:-1] >= -np.log(COMMON), False)
        self.points, self.of = np.zeros((0, factor.shape[1]), np.float32), np.zeros(0, np.int64)  # passages, and the place of each one's item
        self.wanted: list[np.ndarray] = []  # words of each item that its regions need, and how many of them
        self.least, self.enough = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))

    def windows(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All windows of texts given by their words' ids, in the latent space; of each the text's place and the window's first word."""
        halves = np.array([max(1, -(-len(ids) // STRIDE)) for ids in parts])
        grid = np.full((halves.sum(), STRIDE), -1)
        flat, sizes = grid.reshape(-1), np.array([len(ids) for ids in parts])
        first = np.cumsum(halves) - halves
        flat[np.repeat(STRIDE * first, sizes) + ramp(sizes)] = np.concatenate(parts)
        grid.sort(axis=1)
        grid[:, 1:][grid[:, 1:] == grid[:, :-1]] = -1
        step = max(1, CELLS // (STRIDE * self.rows.shape[1]))
        sums = np.concatenate([self.rows[grid[at: at + step]].sum(axis=1) for at in range(0, len(grid), step)])
        count = np.maximum(halves - 1, 1)
        place, k = np.repeat(np.arange(len(parts)), count), ramp(count)
        at = np.repeat(first, count) + k
        z, two = sums[at], np.repeat(halves > 1, count)
        z[two] += sums[at[two] + 1]
        return z, place, STRIDE * k

    def add_items(self, items: list[tuple[int, str, str | None]]) -> None:
        points, of = [self.points], [self.of]
        for item_id, text, answer in items:
            words = words_of(text)
            if not words:
                continue
            whole, told = self.ids(words), self.ids(answer_of(text, answer))
            z = self.windows([whole])[0]
            norms = np.sqrt((z * z).sum(axis=1))
            points.append(z[norms > 1e-6] / norms[norms > 1e-6, None])
            of.append(np.full(len(points[-1]), len(self.items)))
            telling = int(self.telling[whole].sum()) >= FEW
            pick = (lambda ids: ids[self.telling[ids]].tolist()) if telling else (lambda ids: ids[ids >= 0].tolist())
            self.items.append((item_id, len(words), pick(whole), pick(told), telling))
        self.points, self.of = np.concatenate(points), np.concatenate(of)
        self.wanted = [np.unique(np.array(i[2], np.int64)) for i in self.items]
        self.least, self.enough = (np.array([_least(len(i[2]), share) for i in self.items], np.int64) for share in (PARAPHRASE, SEQUENCE))

    def retrieved(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items near the windows of the texts: place of the text, first word of the window and place of the item, ordered by item, text, window."""
        z, place, start = self.windows(parts)
        norms = np.sqrt((z * z).sum(axis=1))
        limit = np.where(norms > 1e-6, COSINE * norms, np.inf).astype(np.float32)
        step, keys = max(1, CELLS // max(1, len(self.of))), [np.zeros(0, np.int64)]
        for at in range(0, len(z), step):
            window, passage = np.nonzero(z[at: at + step] @ self.points.T >= limit[at: at + step, None])
            keys.append(np.unique(self.of[passage] * len(z) + at + window))
        item, window = np.divmod(np.sort(np.concatenate(keys)), len(z))
        return place[window], start[window], item

    def candidates(self, parts: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
        """(place of the text, first word of a window, place of the item) of the retrieved windows whose region has the words that a match needs."""
        place, start, item = self.retrieved(parts)
        sizes = np.array([len(ids) for ids in parts])
        base, flat = np.cumsum(sizes) - sizes, np.concatenate(parts)
        wants = np.zeros(len(self.words) + 1, bool)
        cuts = np.flatnonzero(np.diff(item, prepend=-1))
        for first, end in zip(cuts.tolist(), np.append(cuts, len(item))[1:].tolist(), strict=True):
            i = int(item[first])
            reach, told = self.items[i][1], bool(self.items[i][3])
            wants[self.wanted[i]] = True
            step = max(1, CELLS // (WINDOW + 2 * reach))
            for at in range(first, end, step):
                p, s = place[at: min(at + step, end)], start[at: min(at + step, end)]
                low = np.maximum(s - reach, 0)
                n = np.minimum(s + WINDOW + reach, sizes[p]) - low
                hits = wants[flat[np.repeat(base[p] + low, n) + ramp(n)]]
                near = np.add.reduceat(hits, np.cumsum(n) - n, dtype=np.int64)
                good = near >= (self.least[i] if told else self.enough[i])
                yield from zip(p[good].tolist(), s[good].tolist(), [i] * int(good.sum()), strict=True)
            wants[self.wanted[i]] = False

    def check(self, places: list[int], parts: list[np.ndarray], out: list[dict[int, float]]) -> None:
        """Adds to ``out``, at the places, the items found in the texts."""
        regions: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for part, start, item in self.candidates(parts):
            reach = self.items[item][1]
            low, high = max(0, start - reach), min(len(parts[part]), start + WINDOW + reach)
            known = regions.setdefault((part, item), [])
            if known and known[-1][1] >= high and known[-1][0] <= low:
                continue
            known.append((low, high))
        for (part, item), spans in regions.items():
            item_id, _, wanted, answer, telling = self.items[item]
            found = out[places[part]]
            for low, high in spans:
                region = parts[part][low:high]
                region = region[self.telling[region] if telling else region >= 0].tolist()
                share = lcs(wanted, region) / len(wanted)
                if share >= SEQUENCE or share >= PARAPHRASE and answer and lcs(answer, region) >= 0.8 * len(answer):
                    found[item_id] = max(found.get(item_id, 0.0), round(share, 6))

    def matches(self, texts: list[str | None]) -> list[dict[int, float]]:
        """For each text the ids of the items found in it, with their share of common subsequence."""
        out: list[dict[int, float]] = [{} for _ in texts]
        longest = max((i[1] for i in self.items), default=0)
        step = max(BLOCK, 4 * longest)
        places, parts, size = [], [], 0
        for place, text in enumerate(texts if self.items else []):
            ids = self.ids(words_of(text))
            for at in range(0, len(ids), step):  # neighbouring blocks share more than a region
                places.append(place)
                parts.append(ids[at: at + step + 2 * longest + 2 * WINDOW])
                size += len(parts[-1])
                if size >= GROUP:
                    self.check(places, parts, out)
                    places, parts, size = [], [], 0
        if parts:
            self.check(places, parts, out)
        return out


def _least(n: int, share: float) -> int:
    """The smallest count that is ``share`` of ``n`` or more."""
    return next(k for k in range(max(0, int(share * n) - 1), n + 1) if k / n >= share)


def document_frequencies(docs: DataFrame, words: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many documents each of the given words is; over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = shared.value
        seen, total = np.zeros(len(known) + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[[known[w] for w in known.keys() & set(words_of(text))]] += 1
                total += 1
        index = np.flatnonzero(seen)
        yield {"f": np.append(index, -1), "n": np.append(seen[index], total)}

    rows = map_batches(docs.select("text"), count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(len(words) + 1, np.int64), 0
    for f, n in rows:
        if f < 0:
            total = n
        else:
            df[f] = n
    return df, total


def _gauss(f: np.ndarray, width: int) -> np.ndarray:
    """A row of the Gaussian sketch for each feature, the same in every task."""
    return np.array([np.random.default_rng((97, int(x))).standard_normal(width) for x in f])


def factor(passages: DataFrame, n_words: int, rank: int = RANK) -> np.ndarray:
    """Right factor (words by rank) of the sparse rows ``f, v`` by randomised SVD; products and sums run in Spark."""
    sc = passages.sparkSession.sparkContext
    width = rank + OVERSAMPLE

    def rows(batch: pa.RecordBatch):
        for f, v in zip(batch.column(0), batch.column(1), strict=True):
            yield f.values.to_numpy(), v.values.to_numpy()

    def gram_of(right) -> np.ndarray:
        def gram(batches):
            total = np.zeros((width, width))
            for batch in batches:
                y = np.array([v @ right(f) for f, v in rows(batch)]).reshape(-1, width)
                total += y.T @ y
            yield {"i": pa.array(np.arange(width)), "x": pa.array(list(total), pa.list_(pa.float64()))}

        out = np.zeros((width, width))
        for i, x in _sum_by_feature(map_batches(passages, gram, "i long, x array<double>").toDF("f", "x"), width).collect():
            out[i] = x
        return out

    def project(right, whiten: np.ndarray) -> np.ndarray:
        """Sum over passages of v (v right whiten), by word."""
        def multiply(batches):
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for f, v in rows(batch):
                    y = v @ right(f) @ whiten
                    for i, x in zip(f.tolist(), v.tolist(), strict=True):
                        total[i] = total.get(i, 0.0) + x * y
            yield {"f": pa.array(list(total), pa.int64()), "x": pa.array(list(total.values()), pa.list_(pa.float64()))}

        out = np.zeros((n_words, width))
        for i, x in _sum_by_feature(map_batches(passages, multiply, "f long, x array<double>"), width).toLocalIterator():
            out[i] = x
        return out

    def whitening(gram: np.ndarray) -> np.ndarray:
        value, vector = np.linalg.eigh(gram)
        keep = value > max(value.max(), 1e-30) * 1e-10
        return np.where(keep, vector / np.sqrt(np.where(keep, value, 1.0)), 0.0)

    right = lambda f: _gauss(f, width)
    b = None
    for _ in range(POWER):
        b = project(right, whitening(gram_of(right)))
        held = sc.broadcast(b)
        right = lambda f, held=held: held.value[f]
    value, vector = np.linalg.eigh(b.T @ b)
    order = np.argsort(value)[::-1][:rank]
    order = order[value[order] > max(value.max(), 1e-30) * 1e-8]
    return b @ (vector[:, order] / np.sqrt(value[order]))


def fit(docs: DataFrame, items: list[tuple[int, str, str | None]], benchmark: DataFrame) -> Latent:
    words = {w: i for i, w in enumerate(sorted({w for _, text, _ in items for w in words_of(text)}))}
    df, total = document_frequencies(docs, words)
    idf = np.log((1 + total) / (1 + df)) + 1e-3
    weight = 1 + RARE * idf / (np.log(1 + total) + 1e-3)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        out_f, out_v = [], []
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for passage in _passages(words_of(text)):
                    f, n = _once_a_half(np.array([words.get(w, -1) for w in passage], np.int64))
                    if len(f):
                        v = n * weight[f]
                        out_f.append(f)
                        out_v.append(v / np.sqrt(v @ v))
        yield {"f": pa.array(out_f, pa.list_(pa.int64())), "v": pa.array(out_v, pa.list_(pa.float64()))}

    passages = checkpoint(map_batches(benchmark.select("text"), vectors, "f array<long>, v array<double>"))
    latent = Latent(words, idf, weight, factor(passages, len(words), min(RANK, max(1, len(items)))))
    latent.add_items(items)
    return latent


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` with ``_items`` (ids found, ascending) and ``_share`` (largest share)."""
    ship(docs.sparkSession)
    out = docs.withColumn("_items", F.array().cast("array<long>")).withColumn("_share", F.lit(0.0))
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    given = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", answer.alias("answer")).filter("item_id is not null and text is not null")
    n_words = given.select(F.sum(F.size(F.split("text", r"\W+")))).first()[0] or 0
    parts = -(-n_words // MAX_WORDS)
    for part in range(parts):
        some = given.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        items = sorted(((r.item_id, r.text, r.answer) for r in some.toLocalIterator()), key=repr)
        if not any(words_of(i[1]) for i in items):
            continue
        shared = docs.sparkSession.sparkContext.broadcast(fit(docs, items, some))

        def search(_, texts: list, shared=shared) -> dict:
            found = shared.value.matches(texts)
            return {"_found": pa.array([sorted(x) for x in found], pa.list_(pa.int64())),
                    "_most": pa.array([max(x.values(), default=0.0) for x in found], pa.float64())}

        out = append(out, "text", search, "_found array<long>, _most double").select(
            *docs.columns, F.array_sort(F.array_union("_items", "_found")).alias("_items"), F.greatest("_share", "_most").alias("_share"))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item is found."""
    return find(docs, benchmark).filter(F.size("_items") == 0).select(*docs.columns)
