"""Spelling variants by blocked Gram matrices of letter counts.

Words are counted over all texts (partial counts per task, then one sum per word). Two words at one edit have letter-count vectors at a squared
distance of 1 (one letter more) or 2 (one letter for another), so pairs are sought by numpy products of blocks: |a - b|^2 = |a|^2 + |b|^2 - 2ab. A block
holds words of one length whose letters fall alike into ``GROUPS`` groups of letters; its partners are of the same length or one longer, and their
group sums differ by one letter, so they are listed by their keys and no other block is met. Blocks are cut into chunks of about ``CHUNK`` bytes by
word hash, and a pair of chunks is a row with two arrays, spread over tasks. Kept pairs (distance 2 at equal length, 1 at adjacent lengths) are verified letter by
letter. A pair of chunks returns a row per word (how many near words, the best one), never its pairs; best = largest count, ties by
code-point order. The root follows forms by pointer doubling: counts double along a chain, so it has few steps and no cycle.

Edge cases: null and empty texts have no words; a null doc_id counts as empty text in the hash; words of any length are whole (a word longer than a chunk is
its own); repeated rows count each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexframe.llm.common import checkpoint, map_batches, small_batches
from lexframe.sources.workdir import written

LEAST_LETTERS = 5
LEAST_COUNT = 3
MISPRINT = 97
GROUPS = 5
CHUNK = 1 << 15  # bytes of words
FLUSH = 400_000  # distinct words that a task counts before it hands them on
CELLS = 1 << 22  # entries of a product looked at together

#: Letters of words as Latin-1 bytes, only A-Z lower-cased; anything else ends a run.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))
_LETTER = [c for c in range(256) if 97 <= c <= 122 or c >= 192]


def runs_of(text: str | None) -> list[bytes]:
    """Runs of letters as Latin-1 bytes: a byte is a code point."""
    return (text or "").encode("latin-1", "replace").translate(_LETTERS).split()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (Latin-1 bytes), ``n``: occurrences of the words that are long and frequent enough, planted misprints applied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts: Counter[bytes] = Counter()
        for batch, texts in small_batches(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                base = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(runs_of(text)).items():
                    h = crc32(word if word.isascii() else word.decode("latin-1").encode(), base)
                    if not h % MISPRINT:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    if len(word) >= LEAST_LETTERS:
                        counts[word] += n
            if len(counts) >= FLUSH:
                yield _counted(counts)
                counts = Counter()
        yield _counted(counts)

    def _counted(counts: Counter) -> dict:
        return {"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())}

    rows = map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def letter_groups() -> np.ndarray:
    """Group of each byte: letters in turn, so that neighbours in the alphabet part."""
    out = np.zeros(256, np.int64)
    out[_LETTER] = np.arange(len(_LETTER)) % GROUPS
    return out


def _keyed(words: DataFrame) -> DataFrame:
    """Words with their block: letters per group (their sum is the length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        group = letter_groups()
        for batch in batches:
            held = batch.column(0).to_pylist()
            lengths = np.array([len(w) for w in held], np.int64)
            owner = np.repeat(np.arange(len(held)), lengths)
            sums = np.bincount(owner * GROUPS + group[np.frombuffer(b"".join(held), np.uint8)], minlength=len(held) * GROUPS).reshape(-1, GROUPS)
            yield {"word": batch.column(0), "n": batch.column(1), "block": pa.array(list(sums.astype(np.int32)), pa.list_(pa.int32()))}

    return map_batches(words.select("word", "n"), run, "word binary, n long, block array<int>")


def _partners() -> list[tuple[int, ...]]:
    """Differences of the group sums of a block to those of its partners: itself, one letter more, one letter of another group for one of its own (once per pair)."""
    unit = np.eye(GROUPS, dtype=int)
    moved = [unit[i] - unit[j] for i in range(GROUPS) for j in range(GROUPS) if i < j]
    return [tuple(int(x) for x in d) for d in [np.zeros(GROUPS, int), *unit, *moved]]


class Block:
    """Words of one length as letters and letter counts."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.letters = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)
        length = self.letters.shape[1]
        # squares and products of counts stay exact: below 2 ** 24 in single precision
        kind = np.float32 if length < 2000 else np.float64
        cells = np.arange(len(words))[:, None] * 256 + self.letters
        self.counts = np.bincount(cells.ravel(), minlength=len(words) * 256).reshape(-1, 256)[:, _LETTER].astype(kind)
        self.square = (self.counts * self.counts).sum(axis=1)


def near(a: Block, b: Block, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of words at exactly one edit; ``b`` is as long as ``a`` or one letter longer; ``same``: the two are one block, pairs once."""
    longer = b.letters.shape[1] - a.letters.shape[1]
    wanted = 1 if longer else 2
    step = max(1, CELLS // len(b.words))
    for at in range(0, len(a.words), step):
        gram = a.counts[at: at + step] @ b.counts.T
        distance = a.square[at: at + step, None] + b.square[None, :] - 2 * gram
        x, y = np.nonzero(distance == wanted)
        x += at
        if same:
            x, y = x[x < y], y[x < y]
        for i in range(0, len(x), 1 << 16):  # candidates verified together
            left, right = x[i: i + (1 << 16)], y[i: i + (1 << 16)]
            good = _one_edit(a.letters[left], b.letters[right])
            yield left[good], right[good]


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    ahead = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= a.shape[1]


class _Best:
    """Number of near words per word, and the one of largest count."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        # smallest rank wins: largest count first, then code-point order
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        self.words, self.counts = words, counts
        self.rank = np.empty(len(words), np.int64)
        self.rank[order] = np.arange(len(words))


def _pair_rows(x: np.ndarray, own: _Best, y: np.ndarray, other: _Best) -> dict:
    """Rows for the words ``x`` of ``own``: how many of ``other`` are near, and the best."""
    if not len(x):
        return {}
    order = np.lexsort((other.rank[y], x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.diff(x, prepend=-1))
    best = [int(i) for i in y[first]]
    return {"word": pa.array([own.words[i] for i in x[first].tolist()], pa.binary()), "near": pa.array(np.diff(np.append(first, len(x)))),
            "best_n": pa.array([int(other.counts[i]) for i in best], pa.int64()), "best": pa.array([other.words[i] for i in best], pa.binary())}


def near_words(words: DataFrame) -> DataFrame:
    """``word, n`` -> ``word, n_near, best, best_n`` for words that have near ones."""
    keyed = checkpoint(_keyed(words))
    width = F.length("word")
    blocks = keyed.groupBy("block").agg(F.ceil(F.sum(width) / F.lit(CHUNK)).cast("int").alias("chunks"))
    cut = F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int")
    # a chunk is bounded by its share of the block's bytes
    chunks = checkpoint(keyed.join(blocks, "block").groupBy("block", cut.alias("chunk")).agg(
        F.collect_list("word").alias("words"), F.collect_list("n").alias("counts")))
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*[F.lit(s) for s in d]).alias("d")) for k, d in enumerate(_partners())])
    met = blocks.select("block", "chunks", F.explode(steps).alias("s")).select(
        F.col("block").alias("a"), F.col("chunks").alias("a_chunks"), (F.col("s.k") == 0).alias("own"),
        F.zip_with("block", "s.d", lambda u, v: u + v).alias("b"))
    met = met.join(blocks.select(F.col("block").alias("b"), F.col("chunks").alias("b_chunks")), "b")
    met = met.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("a_chunks") - 1)))
    low = F.when(F.col("own"), F.col("i")).otherwise(F.lit(0))
    met = met.withColumn("j", F.explode(F.sequence(low, F.col("b_chunks") - 1)))
    left = chunks.select(F.col("block").alias("a"), F.col("chunk").alias("i"), F.col("words").alias("aw"), F.col("counts").alias("an"))
    right = chunks.select(F.col("block").alias("b"), F.col("chunk").alias("j"), F.col("words").alias("bw"), F.col("counts").alias("bn"))
    pairs = met.select("a", "i", "b", "j", (F.col("own") & (F.col("i") == F.col("j"))).alias("same")).join(left, ["a", "i"]).join(right, ["b", "j"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for same, aw, an, bw, bn in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                one, two = _Best(aw, np.array(an)), _Best(bw, np.array(bn))
                for x, y in near(Block(aw), Block(bw), same):
                    for rows in (_pair_rows(x, one, y, two), _pair_rows(y, two, x, one)):
                        if rows:
                            yield rows

    found = map_batches(pairs.select("same", "aw", "an", "bw", "bn"), run, "word binary, near long, best_n long, best binary")
    best = F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.w").alias("best"), (-F.col("b.k")).alias("best_n"))


def _text(word: Column) -> Column:
    return F.decode(word, "ISO-8859-1")


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word."""
    words = written(word_counts(docs), "words")
    named = words.join(near_words(words), "word", "left")
    has_form = F.col("best_n") >= 2 * F.col("n")
    named = written(named.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("best")).alias("form"),
                                 F.when(has_form, F.col("best_n")).alias("form_n")), "forms")
    return named.join(_roots(named.filter("form is not null").select("word", "form")), "word", "left").select(
        _text(F.col("word")).alias("word"), _text(F.col("form")).alias("form"), _text(F.coalesce("root", "word")).alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """``word, form`` (no cycles) -> ``word, root``: each round doubles the steps that a pointer spans."""
    ahead = links.select("word", F.col("form").alias("root"), F.lit(True).alias("open"))
    while True:
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = checkpoint(ahead.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")))
        if not ahead.filter("open").head(1):
            return ahead.select("word", "root")
