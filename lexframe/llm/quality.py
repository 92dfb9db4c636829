"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Documents are kept in compressed blocks (a table bucketed by block, so that nothing below moves texts again). Counts of the trusted
documents' n-grams are summed per task, then by Spark; counts, continuation counts, discounts and back-off weights are groupings of the count table. A block
asks for its distinct n-grams only; the questions are joined with the model, sharded by n-gram, and the answers go back to the block.
The threshold of a language is a quantile of the perplexities of its trusted documents; languages without any use the quantile of all.

An n-gram is up to four characters of 16 bits in a long (characters beyond that share one symbol), lower-cased; a text starts with padding.

Edge cases: null and empty texts have a null perplexity and are kept, for lack of evidence; without trusted text so is everything. A null
lang uses the threshold of all. Repeated rows are scored each for itself; repeated labels count once (trusted if any says so and none
says toxic). Long texts are scored whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm.blocks import blocks_of, texts_of
from lexframe.llm.common import checkpoint, map_batches

ORDER = 4
BLOCK = 1 << 23  # bytes
QUANTILE = 0.998
PART = 1 << 20
SALTS = 64
OTHER = 0xFFFF
START = 1


def keys_of(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """n-grams of each order at every character of the texts, and how many characters each text has."""
    lower = [t.lower() for t in texts]
    sizes = np.array([len(t) for t in lower], np.int64)
    pad = chr(START) * (ORDER - 1)
    points = np.frombuffer((pad + pad.join(lower)).encode("utf-32-le", "replace"), np.uint32)
    points = np.where(points == 0, 2, np.minimum(points, OTHER)).astype(np.uint64)
    starts = np.cumsum(sizes + ORDER - 1) - sizes
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    whole = np.zeros(len(at), np.uint64)
    out = []
    for order in range(1, ORDER + 1):
        whole |= points[at - (order - 1)] << np.uint64(16 * (order - 1))
        out.append(whole.copy())
    return out, sizes


def _parts(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of bounded size; a longer text is a run of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= PART or i + 1 == len(texts):
            yield start, texts[start: i + 1]
            start, size = i + 1, 0


def trusted_ids(labels: DataFrame) -> DataFrame:
    facts = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    return facts.filter("doc_id is not null and q = 1 and coalesce(t, 0) <> 1").select("doc_id")


def count_grams(blocks: DataFrame, trusted: DataFrame) -> DataFrame:
    """``key, n``: n-grams of the highest order in the trusted documents."""
    chosen = blocks.select("block", F.explode("ids").alias("doc_id")).join(trusted, "doc_id").select(F.col("block").alias("at"), "doc_id")

    def count(block: pd.DataFrame, inside: pd.DataFrame) -> pd.DataFrame:
        ids = set(inside["doc_id"].tolist())
        out = [pd.DataFrame({"key": [], "n": []}, dtype="int64")]
        for own, sizes, payload in zip(block["ids"], block["sizes"], block["payload"], strict=True):
            texts = [t for i, t in zip(own, texts_of(payload, sizes), strict=True) if i in ids]
            found = [np.unique(keys_of(part)[0][-1], return_counts=True) for _, part in _parts(texts)]
            if found:
                key, where = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                out.append(pd.DataFrame({"key": key.view(np.int64), "n": np.bincount(where, np.concatenate([f[1] for f in found])).astype(np.int64)}))
        return pd.concat(out)

    grouped = blocks.select("block", "ids", "sizes", "payload").groupBy("block")
    counts = grouped.cogroup(chosen.groupBy("at")).applyInPandas(count, "key long, n long")
    return counts.groupBy("key").agg(F.sum("n").alias("n"))


def train(counts: DataFrame) -> DataFrame:
    """``key, alpha, gamma``: discounted probability of an n-gram, and back-off weight of it as a context; key 0 is the empty context."""
    levels = {ORDER: checkpoint(counts)}
    for order in range(ORDER - 1, 0, -1):
        below = F.col("key").bitwiseAND(F.lit((1 << 16 * order) - 1))
        levels[order] = checkpoint(levels[order + 1].groupBy(below.alias("key")).agg(F.count(F.lit(1)).alias("n")))
    rows = None
    for order, level in levels.items():
        few = {r.n: r.k for r in level.filter("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
        d = discounts([few.get(i, 0) for i in range(1, 5)])
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        context = F.shiftrightunsigned("key", 16) if order > 1 else F.lit(0).cast("long")
        facts = level.select("key", "n", cut.alias("cut"), context.alias("context"))
        sums = facts.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("held"))
        none = F.lit(None).cast("double")
        share, rest = (F.col("n") - F.col("cut")) / F.col("total"), F.col("held") / F.col("total")
        if order > 1:
            whole = facts.join(sums, "context")
        else:  # one context: its sums are two numbers
            root = facts.agg(F.sum("n").alias("total"), F.sum("cut").alias("held")).first()
            whole = facts.withColumn("total", F.lit(root.total))
        alpha = whole.select("key", share.alias("alpha"), none.alias("gamma"))
        gamma = sums.select(F.col("context").alias("key"), none.alias("alpha"), rest.alias("gamma"))
        both = alpha.unionByName(gamma)
        rows = both if rows is None else rows.unionByName(both)
    return rows.groupBy("key").agg(F.max("alpha").cast("float").alias("alpha"), F.max("gamma").cast("float").alias("gamma"))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2 and more, from how many n-grams have counts 1 to 4."""
    if not n[0] or not n[1]:
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 2.0]
    return tuple(min(max(x, 0.01), i + 0.99) for i, x in enumerate(d))


def _questions(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for row in batch.to_pylist():
            asked = [np.zeros(1, np.uint64)]
            for _, part in _parts(texts_of(row["payload"], row["sizes"])):
                asked.append(np.unique(keys_of(part)[0][-1]))
            top = np.unique(np.concatenate(asked))
            every = [top]
            for order in range(ORDER - 1, 0, -1):  # n-grams to predict are endings, contexts are beginnings
                mask = np.uint64((1 << 16 * order) - 1)
                every += [np.unique(top & mask), np.unique(top >> np.uint64(16 * (ORDER - order)))]
            key = np.unique(np.concatenate(every))
            yield {"block": pa.array(np.full(len(key), row["block"], np.int64)), "key": pa.array(key.view(np.int64))}


def log_probabilities(top: np.ndarray, key: np.ndarray, alpha: np.ndarray, gamma: np.ndarray, symbols: int) -> np.ndarray:
    """Of n-grams of the highest order, given the model's rows sorted by ``key``."""

    def find(wanted: np.ndarray, values: np.ndarray, default: float) -> np.ndarray:
        at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        got = np.where(key[at] == wanted, values[at], np.nan)
        return np.where(np.isnan(got), default, got)

    p = np.full(len(top), 1.0 / symbols)
    for order in range(1, ORDER + 1):
        gram = top & np.uint64((1 << 16 * order) - 1)
        p = find(gram, alpha, 0.0) + find(gram >> np.uint64(16), gamma, 1.0) * p
    return np.log(p)


def perplexities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, lang, perplexity`` of every document."""
    blocks = blocks_of(docs, BLOCK, lang=True)
    model = checkpoint(train(count_grams(blocks, trusted_ids(labels))))
    symbols = model.filter("alpha is not null and key > 0 and key < 65536").count() + 1
    asked = map_batches(blocks.select("block", "sizes", "payload"), _questions, "block long, key long")
    answers = asked.join(model, "key").select("block", "key", "alpha", "gamma")

    def score(block: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        key = answer["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(key)
        key, alpha, gamma = key[order], answer["alpha"].to_numpy(np.float64)[order], answer["gamma"].to_numpy(np.float64)[order]
        out = []
        for ids, langs, sizes, payload in zip(block["ids"], block["langs"], block["sizes"], block["payload"], strict=True):
            values: list[float] = []
            for _, part in _parts(texts_of(payload, sizes)):
                grams, lengths = keys_of(part)
                if not len(key):
                    values += [np.nan] * len(part)
                    continue
                top = np.unique(grams[-1])
                logs = log_probabilities(top, key, alpha, gamma, symbols)[np.searchsorted(top, grams[-1])]
                sums = np.concatenate(([0.0], np.cumsum(logs)))
                ends = np.cumsum(lengths)
                with np.errstate(invalid="ignore", divide="ignore"):
                    values += np.exp(-(sums[ends] - sums[ends - lengths]) / lengths).tolist()
            out.append(pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "lang": list(langs), "perplexity": pd.array(values, "Float64")}))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "lang": [], "perplexity": []})

    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score, "doc_id long, lang string, perplexity double")
    return checkpoint(scored.select("doc_id", "lang", F.when(~F.isnan("perplexity"), F.col("perplexity")).alias("perplexity")))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``doc_id, lang, perplexity, threshold, kept`` of every document."""
    scored = perplexities(docs, labels)
    known = scored.filter("perplexity is not null").join(trusted_ids(labels), "doc_id", "left_semi")
    limit = F.percentile_approx("perplexity", quantile, 10_000)
    by_lang = known.filter("lang is not null").groupBy("lang").agg(limit.alias("own"))
    threshold = F.coalesce("own", F.lit(known.agg(limit).first()[0]).cast("double"))
    # a language may have most documents: its rows and its limit are spread over SALTS keys
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    limits = by_lang.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(limits, ["lang", "salt"], "left").select(
        "doc_id", "lang", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(True)).alias("kept"))
