"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Learning: document frequencies of hashed n-grams come from all learning documents; a bounded sample per language (``SAMPLE``, the smallest
hashes of the doc_id) trains the weights by follow-the-regularised-leader with L1 and L2 penalties; another part of that sample fits the
temperature. Documents whose crc32(doc_id as text) mod 5 is 0 are never learned from. Prediction reads the text alone.

Edge cases: null texts and texts without a letter are ``und`` with score 0; repeated rows are predicted each for itself; long texts are
used whole; a null doc_id counts as held out; null langs are not learned from. With no learning document everything is ``und``. Of ties the
language first in order wins. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexframe.llm.common import append, map_batches, small_batches

ORDERS = (1, 2, 3)
BITS = 15  # 2 ** BITS hashed features, the size of all that is sent to the driver
SAMPLE = 600  # learning documents per language
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
UNKNOWN = "und"


def held_out(doc_id):
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(True))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a whole text and their counts, as arrays sorted by feature."""
    counts = np.zeros(1 << BITS, np.int64)
    step = 1 << 20
    for at in range(0, max(len(text), 1), step):  # pieces overlap, so no n-gram is lost or counted twice
        lower = np.frombuffer(text[at: at + step + max(ORDERS) - 1].lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        keys = lower + np.uint64(1)
        whole = len(text) <= at + step
        for order in range(1, max(ORDERS) + 1):
            if order > 1:
                if len(keys) < 2:
                    break
                keys = keys[:-1] * np.uint64(0x9E3779B1) + lower[order - 1:] + np.uint64(order)
            if order in ORDERS:
                mixed = keys if whole else keys[:step]
                mixed = (mixed ^ (mixed >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
                counts += np.bincount((mixed >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    index = np.flatnonzero(counts)
    return index, counts[index]


def _vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    index, counts = features(text)
    value = (1 + np.log(counts)) * idf[index]
    norm = np.sqrt(value @ value)
    return index, value / norm if norm else value


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Of every feature, over all documents: summed within tasks, then by Spark; 2 ** BITS rows reach the driver at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen = np.zeros(1 << BITS, np.int64)
        total = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if has_letter(text):
                    seen[features(text)[0]] += 1
                    total += 1
        index = np.flatnonzero(seen)
        yield {"f": np.append(index, -1), "n": np.append(seen[index], total)}

    rows = map_batches(docs.select("text"), count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(1 << BITS, np.int64)
    total = 0
    for f, n in rows:
        if f < 0:
            total = n
        else:
            df[f] = n
    return df, total


def sample(docs: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """At most ``per_language`` documents of each language: those with the smallest hashes of their ids."""
    sizes = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return docs.select("lang", "doc_id", "text")
    # a share of the hash range that holds about four times the sample: no task sorts a whole language
    share = F.element_at(F.create_map(*[F.lit(x) for l, n in sizes.items() for x in (l, min(1.0, 4 * per_language / n))]), F.col("lang"))
    some = docs.select("lang", "doc_id", F.xxhash64("text").alias("h"), F.xxhash64("doc_id").alias("place")).filter(
        (F.col("place") / 2.0**64 + 0.5) <= share)
    rank = F.row_number().over(W.partitionBy("lang").orderBy("place", "doc_id", "h"))
    chosen = some.withColumn("n", rank).filter(F.col("n") <= per_language).select("lang", "doc_id", "h").distinct()
    # per_language rows of each language at most, fewer than the weights that the model sends to the tasks
    return docs.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "doc_id", "h"], "left_semi").select("lang", "doc_id", "text")


class Model:
    """Weights per language over hashed TF-IDF features, with a temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.languages, self.idf, self.weights, self.bias, self.temperature = languages, idf, weights, bias, temperature

    def logits(self, text: str) -> np.ndarray:
        index, value = _vector(text, self.idf)
        return value @ self.weights[index] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = _softmax(self.logits(text) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Proximal updates per coordinate; a weight is zero while its gathered gradient is within L1. The last feature is the bias, unpenalised by L1."""
    size = (1 << BITS) + 1
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(index: np.ndarray, l1: np.ndarray) -> np.ndarray:
        zi = z[index]
        w = -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(n[index])) / ALPHA + L2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            index = np.append(rows[i][0], size - 1)
            value = np.append(rows[i][1], 1.0)
            l1 = np.where(index == size - 1, 0.0, L1)[:, None]
            w = weights(index, l1)
            p = _softmax(value @ w)
            p[y[i]] -= 1
            g = value[:, None] * p
            step = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA
            z[index] += g - step * w
            n[index] += g * g
    every = np.arange(size)
    w = weights(every, np.where(every == size - 1, 0.0, L1)[:, None])
    return w[:-1], w[-1]


def fit(docs: DataFrame, per_language: int = SAMPLE) -> Model:
    """Learns from ``doc_id, text, lang``; the driver gets frequencies (2 ** BITS) and the feature counts of the bounded sample."""
    learn = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    df, total = document_frequencies(learn)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, texts in small_batches(batches, 2):
            keep = [i for i, t in enumerate(texts) if has_letter(t)]
            found = [features(texts[i]) for i in keep]
            yield {"lang": batch.column(0).take(pa.array(keep, pa.int64())), "doc_id": batch.column(1).take(pa.array(keep, pa.int64())),
                   "f": pa.array([x[0].astype(np.int32) for x in found], pa.list_(pa.int32())), "n": pa.array([x[1].astype(np.int32) for x in found], pa.list_(pa.int32()))}

    got = map_batches(sample(learn, per_language).select("lang", "doc_id", "text"), counted, "lang string, doc_id long, f array<int>, n array<int>").toPandas()
    got = got.sort_values(["lang", "doc_id"], kind="stable", na_position="last").reset_index(drop=True)
    languages = sorted(set(got["lang"]))
    idf = np.log((1 + total) / (1 + df)) + 1
    if not languages:
        return Model([], idf, np.zeros((1 << BITS, 0)), np.zeros(0))
    rows = []
    for f, n in zip(got["f"], got["n"], strict=True):
        value = (1 + np.log(np.asarray(n))) * idf[np.asarray(f, np.int64)]
        rows.append((np.asarray(f, np.int64), value / np.sqrt(value @ value)))
    y = np.searchsorted(languages, got["lang"].to_numpy())
    calibrate = np.arange(len(rows)) % 5 == 4
    train = [i for i in range(len(rows)) if not calibrate[i]]
    w, b = _ftrl([rows[i] for i in train], y[train], len(languages))
    model = Model(languages, idf, w, b)
    rest = np.flatnonzero(calibrate)
    if len(rest):
        logits = np.array([rows[i][1] @ w[rows[i][0]] + b for i in rest])
        scales = np.exp(np.linspace(-3, 3, 121))
        losses = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(rest)), y[rest]], 1e-12)).mean() for t in scales]
        model.temperature = float(scales[int(np.argmin(losses))])
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, held_out, lang_pred, score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # size: 2 ** BITS features by the languages learned

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, texts in small_batches(batches):
            found = [shared.value.predict(t) for t in texts]
            yield {"doc_id": batch.column(0), "lang_pred": [x[0] for x in found], "score": pa.array([x[1] for x in found], pa.float64())}

    out = map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def annotate(docs: DataFrame, model: Model, lang: str, score: str) -> DataFrame:
    """The rows of ``docs`` with the predicted language and its score in columns of the given names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def told(_, texts: list) -> dict:
        found = [shared.value.predict(t) for t in texts]
        return {lang: pa.array([x[0] for x in found], pa.string()), score: pa.array([x[1] for x in found], pa.float64())}

    return append(docs, "text", told, f"{lang} string, {score} double")
