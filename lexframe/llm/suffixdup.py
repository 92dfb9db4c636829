"""Repeated 50-byte strings across documents by bucket-pointer refinement.

Suffixes are sampled so that nothing is lost: of the q-grams within every ``LENGTH`` bytes the one with the least hash (leftmost of equal
ones) is its anchor, so equal strings have equal anchors at equal places. An anchor stands for a run of neighbouring strings.

1. Initial buckets: the anchors' q-grams. Each block of documents tells the distinct ones it has; those of a single document in the whole
   table are dropped.
2. Refinement: of the others each block sends its distinct runs (whole bytes, smallest document). Equal runs share a bucket; buckets of one
   q-gram with different runs are refined by sorting on the bucket pointers of suffixes further on, and the pointers
   found at one depth are used again for the double depth, until depth ``LENGTH`` tells equal strings exactly.
3. A string is removed if its smallest document is smaller than the one it is in; each block cuts its own texts.

A text moves once, into a block table. A run that occurs in very many documents is one row per block, never one per document.

Edge cases: null and empty texts, and texts shorter than ``LENGTH``, lose nothing; documents with one doc_id do not count against each
other (repeated rows); a null doc_id counts as larger than all others; matches never cross documents; long texts are worked in slices.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm.blocks import blocks_of, unpack
from lexframe.llm.common import checkpoint, map_batches, ramp

LENGTH = 50
GRAM = 24
BLOCK = 1 << 23
SLICE_BITS = 18
KEYS = 3_000_000  # initial buckets of a shard, about
RUNS = 150_000  # runs refined together
NO_ID = np.iinfo(np.int64).max
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_FACTOR), n, 1 << 64))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed hashes of all GRAM-byte strings: 8 bytes, then 16, then 24."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    depth = 1
    while depth < 8:
        h = h[:-depth] * _power(depth) + h[depth:]
        depth *= 2
    h16 = h[:-8] * _power(8) + h[8:]
    whole = h16[: len(h16) - 8] * _power(8) + h[16:]
    whole ^= whole >> np.uint64(29)
    whole *= np.uint64(0xBF58476D1CE4E5B9)
    whole ^= whole >> np.uint64(32)
    return whole


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts with one anchor: (first start, number of starts, 48-bit key); ``ends``: where each document ends."""
    firsts, counts, keys = [], [], []
    span = LENGTH - GRAM + 1
    step = (1 << SLICE_BITS) - LENGTH
    begins = np.concatenate(([0], ends[:-1]))
    for at in range(0, max(len(data) - LENGTH + 1, 0), step):
        part = data[at: at + step + LENGTH - 1]
        h = _gram_hashes(part)
        v = (h & ~np.uint64((1 << SLICE_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            v = np.minimum(v[:-width], v[width:])
            width *= 2
        v = np.minimum(v[: len(v) - (span - width)], v[span - width:])
        place = (v & np.uint64((1 << SLICE_BITS) - 1)).astype(np.int64)
        # starts too near the end of their document have no string
        good = np.zeros(len(place) + 1, np.int64)
        low, high = np.searchsorted(ends, at, "right"), np.searchsorted(begins, at + len(place), "left")
        a = np.clip(begins[low:high] - at, 0, len(place))
        b = np.clip(ends[low:high] - LENGTH + 1 - at, 0, len(place))
        some = b > a
        np.add.at(good, a[some], 1)
        np.add.at(good, b[some], -1)
        place[np.cumsum(good[:-1]) == 0] = -1
        doc_start = np.zeros(len(place), bool)
        doc_start[a[some]] = True
        new = np.flatnonzero((np.diff(place, prepend=-2) != 0) | doc_start)
        size = np.diff(np.append(new, len(place)))
        keep = place[new] >= 0
        new, size = new[keep], size[keep]
        firsts.append(new + at)
        counts.append(size)
        keys.append(h[place[new]] >> np.uint64(16))
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(firsts), np.concatenate(counts), np.concatenate(keys)


class Block:
    """A block's bytes, its documents and its runs; the same each time it is opened."""

    def __init__(self, ids, sizes, payload: bytes):
        self.data = np.frombuffer(unpack(payload), np.uint8)
        self.ends = np.cumsum(np.asarray(sizes, np.int64))
        self.ids = np.array([NO_ID if i is None or i != i else i for i in ids], np.int64)
        self.first, self.count, self.key = anchors(self.data, self.ends)
        self.doc = self.ids[np.searchsorted(self.ends, self.first, "right")]

    def buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, and whether the block has them in several documents."""
        order = np.lexsort((self.doc, self.key))
        key, doc = self.key[order], self.doc[order]
        start = np.flatnonzero(np.diff(key, prepend=np.uint64(1 << 63)) != 0)
        if not len(start):
            return key, np.zeros(0, bool)
        last = np.append(start[1:], len(key)) - 1
        return key[start], doc[start] != doc[last]

    def repeated(self, marks: dict[int, bytes], shards: int) -> None:
        """Keeps the runs whose keys are marked: a bit for each distinct key of a shard, in order."""
        key, _ = self.buckets()
        shard = (key % np.uint64(shards)).astype(np.int64)
        hit = np.zeros(len(key), bool)
        for s, bits in marks.items():
            own = np.flatnonzero(shard == s)
            hit[own] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
        keep = hit[np.searchsorted(key, self.key)] if len(key) else np.zeros(0, bool)
        self.first, self.count, self.key, self.doc = self.first[keep], self.count[keep], self.key[keep], self.doc[keep]
        raw, found = self.data.tobytes(), {}
        of = np.empty(len(self.first), np.int64)
        for i, (k, a, n) in enumerate(zip(self.key.tolist(), self.first.tolist(), self.count.tolist(), strict=True)):
            of[i] = found.setdefault((k, raw[a: a + n + LENGTH - 1]), len(found))
        self.run_of, self.runs = of, list(found)
        self.run_doc = np.full(len(found), NO_ID, np.int64)
        np.minimum.at(self.run_doc, of, self.doc)


def _pack(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack_ints(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unpack(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def _marks_of(shard: pd.DataFrame) -> pd.DataFrame:
    """Which of the keys that blocks told a shard are in several documents: those of several blocks, or of several documents of one."""
    parts = [np.cumsum(_unpack_ints(k)) for k in shard["keys"]]
    sizes = [len(p) for p in parts]
    multi = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n).astype(bool) for m, n in zip(shard["multi"], sizes, strict=True)])
    key = np.concatenate(parts)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    start = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] + np.uint64(1)) != 0)
    times = np.diff(np.append(start, len(key)))
    several = np.logical_or.reduceat(multi[order], start) | (times > 1)
    hit = np.empty(len(key), bool)
    hit[order] = np.repeat(several, times)
    bits = [np.packbits(h).tobytes() for h in np.split(hit, np.cumsum(sizes)[:-1])]
    return pd.DataFrame({"block": shard["block"], "kind": 1, "shard": shard["shard"], "bits": bits})


def refine(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bucket pointers of the strings of LENGTH bytes at ``starts``: equal if and only if the strings are."""
    padded = np.concatenate((data, np.zeros(LENGTH + 16, np.uint8)))
    wide = np.zeros(len(padded) - 8, np.uint64)
    for i in range(8):
        wide |= padded[i: i + len(wide)].astype(np.uint64) << np.uint64(8 * i)
    pointer = np.unique(wide, return_inverse=True)[1].astype(np.int64)
    depth = 8
    while 2 * depth <= LENGTH:
        pair = pointer[:-depth] * np.int64(pointer.max() + 1) + pointer[depth:]
        pointer = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        depth *= 2
    later = LENGTH - depth
    pair = pointer[starts] * np.int64(pointer.max() + 1) + pointer[starts + later]
    return np.unique(pair, return_inverse=True)[1].astype(np.int64)


def _smaller(key: np.ndarray, doc: np.ndarray, runs: list[bytes]) -> list[np.ndarray]:
    """For each run, which of its strings start in a document smaller than the run's own."""
    found: dict[tuple[int, bytes], int] = {}
    of = np.fromiter((found.setdefault(x, len(found)) for x in zip(key.tolist(), runs, strict=True)), np.int64, len(runs))
    content = [r for _, r in found]
    whole_key = np.array([k for k, _ in found], np.uint64)
    least = np.full(len(content), NO_ID, np.int64)
    np.minimum.at(least, of, doc)
    counts = np.array([len(c) - LENGTH + 1 for c in content], np.int64)
    begin = np.cumsum(counts) - counts
    string_least = np.repeat(least, counts)
    _, group, size = np.unique(whole_key, return_inverse=True, return_counts=True)
    hard = np.flatnonzero(size[group] > 1)
    if len(hard):
        data = np.frombuffer(b"".join([content[i] for i in hard.tolist()]), np.uint8)
        lengths = counts[hard] + LENGTH - 1
        starts = np.repeat(np.cumsum(lengths) - lengths, counts[hard]) + ramp(counts[hard])
        bucket = refine(data, starts)
        at = np.repeat(begin[hard], counts[hard]) + ramp(counts[hard])
        best = np.full(bucket.max() + 1, NO_ID, np.int64)
        np.minimum.at(best, bucket, string_least[at])
        string_least[at] = best[bucket]
    return [string_least[b: b + n] < d for b, n, d in zip(begin[of].tolist(), counts[of].tolist(), doc.tolist(), strict=True)]


def _refined(shard: pd.DataFrame) -> pd.DataFrame:
    keys = [_unpack_ints(k) for k in shard["keys"]]
    docs = [_unpack_ints(d).view(np.int64) for d in shard["docs"]]
    sizes = [_unpack_ints(s).astype(np.int64) for s in shard["sizes"]]
    rows = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    key, doc, size = np.concatenate(keys), np.concatenate(docs), np.concatenate(sizes)
    runs: list[bytes] = []
    for row, own in zip(shard["runs"], sizes, strict=True):
        raw = unpack(row)
        ends = np.cumsum(own).tolist()
        runs += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    out: list[np.ndarray | None] = [None] * len(runs)
    parts = max(1, -(-len(runs) // RUNS))
    part = ((key * _FACTOR) >> np.uint64(32)) % np.uint64(parts)
    for p in range(parts):
        chosen = np.flatnonzero(part == np.uint64(p))
        for i, bits in zip(chosen.tolist(), _smaller(key[chosen], doc[chosen], [runs[i] for i in chosen.tolist()]), strict=True):
            out[i] = bits
    ends = np.searchsorted(rows, np.arange(len(keys)), "right").tolist()
    bits = [np.packbits(np.concatenate(out[a:b])).tobytes() if b > a else b"" for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return pd.DataFrame({"block": shard["block"], "kind": 2, "shard": shard["shard"], "bits": bits})


def _split(answers: pd.DataFrame, kind: int) -> dict[int, bytes]:
    own = answers[answers["kind"] == kind]
    return dict(zip(own["shard"].tolist(), own["bits"], strict=True))


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the remaining bytes)."""
    blocks = blocks_of(docs, BLOCK)
    n_bytes = blocks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    shards = max(1, n_bytes * 2 // (LENGTH - GRAM + 2) // KEYS)
    run_shards = 4 * shards

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                key, multi = Block(row["ids"], row["sizes"], row["payload"]).buckets()
                shard = (key % np.uint64(shards)).astype(np.int64)
                for s in np.unique(shard).tolist():
                    own = np.flatnonzero(shard == s)
                    yield {"shard": pa.array([s], pa.int64()), "block": pa.array([row["block"]], pa.int64()),
                           "keys": pa.array([_pack(np.diff(key[own], prepend=np.uint64(0)))], pa.binary()), "multi": pa.array([np.packbits(multi[own]).tobytes()], pa.binary())}

    told = map_batches(blocks.select("block", "ids", "sizes", "payload"), tell, "shard long, block long, keys binary, multi binary")
    answer = "block long, kind int, shard long, bits binary"
    marks = checkpoint(told.groupBy("shard").applyInPandas(_marks_of, answer))

    def opened(block: pd.DataFrame, answers: pd.DataFrame) -> Iterator[tuple[int, Block]]:
        for name, ids, sizes, payload in zip(block["block"], block["ids"], block["sizes"], block["payload"], strict=True):
            out = Block(ids, sizes, payload)
            out.repeated(_split(answers, 1), shards)
            yield name, out

    def send(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for name, b in opened(block, answers):
            key = np.array([k for k, _ in b.runs], np.uint64)
            shard = (key % np.uint64(run_shards)).astype(np.int64)
            for s in np.unique(shard).tolist():
                own = np.flatnonzero(shard == s)
                content = [b.runs[i][1] for i in own.tolist()]
                rows.append((s, name, _pack(key[own]), _pack(b.run_doc[own].view(np.uint64)), _pack(np.array([len(c) for c in content], np.uint64)),
                             zstandard.ZstdCompressor(level=3).compress(b"".join(content))))
        return pd.DataFrame(rows, columns=["shard", "block", "keys", "docs", "sizes", "runs"])

    grouped = blocks.select("block", "ids", "sizes", "payload").groupBy("block")
    sent = grouped.cogroup(marks.groupBy("block")).applyInPandas(send, "shard long, block long, keys binary, docs binary, sizes binary, runs binary")
    smaller = sent.groupBy("shard").applyInPandas(_refined, answer)

    def cut(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, b in opened(block, answers):
            strings = np.array([len(r) - LENGTH + 1 for _, r in b.runs], np.int64)
            shard = np.array([k % run_shards for k, _ in b.runs], np.int64)
            begin = np.cumsum(strings) - strings
            elsewhere = np.zeros(int(strings.sum()), bool)
            for s, bits in _split(answers, 2).items():
                own = np.flatnonzero(shard == s)
                at = np.repeat(begin[own], strings[own]) + ramp(strings[own])
                elsewhere[at] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(at)).astype(bool)
            where = np.repeat(begin[b.run_of], b.count) + ramp(b.count)
            gone = elsewhere[where] | np.repeat(b.doc > b.run_doc[b.run_of], b.count)
            starts = (np.repeat(b.first, b.count) + ramp(b.count))[gone]
            change = np.zeros(len(b.data) + 1, np.int32)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + LENGTH, -1)
            covered = np.cumsum(change[:-1]) > 0
            low = 0
            for doc_id, high in zip(b.ids.tolist(), b.ends.tolist(), strict=True):
                mask = covered[low:high]
                kept = b.data[low:high][~mask].tobytes()
                edges = int((np.diff(mask.astype(np.int8), prepend=0) == 1).sum())
                rows.append((None if doc_id == NO_ID else doc_id, high - low, high - low - len(kept), edges, hashlib.sha256(kept).hexdigest(), kept))
                low = high
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        return out.astype({"doc_id": "Int64"})

    return grouped.cogroup(marks.unionByName(smaller).groupBy("block")).applyInPandas(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
