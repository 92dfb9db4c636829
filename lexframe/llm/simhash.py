"""SimHash near-duplicates with a Gray-order hierarchical index.

A fingerprint has a bit set if over half of the shingle hashes have it. Two fingerprints link at ``radius`` or fewer differing bits.

Distribution: the bits are cut in ``radius + 2`` blocks. Two blocks of any linked pair agree, so a row of each distinct fingerprint for each
choice of two blocks, keyed by their bits, brings every linked pair together in some bucket. Rows of a bucket are sorted by the Gray
rank of the fingerprint with the key's blocks moved to the front; the index over that order has, in each upper node, the bits all
members share (mask and pattern). The self-join goes down from the top with pairs of nodes: bits at which both masks hold and the
patterns differ accumulate, and a pair of groups is pruned once more than ``radius`` are known to differ. A large bucket is walked in slices of
bounded size, and only a forest of its links is returned, never all pairs.

Edge cases: null and empty texts have fingerprint zero and link like any other; fewer words than a shingle are one shingle; equal
texts are one fingerprint, so hot copies meet only in sums; rows with the same doc_id share a component; null ids keep their
fingerprint and component counts them as no candidate for the smallest id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm.common import append, checkpoint, components, forest, map_batches, ramp, runs, small_batches

SHINGLE = 4
RADIUS = 4
SEED = 42
FAN = 8
SLICE = 1 << 18  # node pairs looked at together
_ROW = "_simhash_row"


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """bytes.lower() changes A-Z only and bytes.split() splits at the six ASCII blanks only."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    stops = (ends - 1).tolist()
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    total, counts = len(words) - size + 1, np.zeros(64, np.int64)
    for at in range(0, total, 1 << 16):
        end = min(total, at + (1 << 16))
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:end], stops[at + size - 1: end + size - 1], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, fp``: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, texts in small_batches(batches):
            found = np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)
            yield {"doc_id": batch.column(0), "fp": pa.array(found)}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def _layouts(blocks: int) -> list[list[tuple[int, int]]]:
    """For each choice of two blocks: all blocks as (lowest bit, width), the chosen ones first."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(edges[i], edges[i + 1] - edges[i]) for i in range(blocks)]
    return [[parts[i] for i in pair] + [p for k, p in enumerate(parts) if k not in pair] for pair in combinations(range(blocks), 2)]


def _permuted(fp: np.ndarray, layout: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros_like(fp)
    for low, width in layout:
        out = (out << np.uint64(width)) | ((fp >> np.uint64(low)) & np.uint64((1 << width) - 1))
    return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray order."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """Codes in Gray order within groups; level k has a node for each FAN ** k neighbours of a group: mask and pattern of shared bits."""

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        full = np.full(len(codes), np.iinfo(np.uint64).max)
        self.levels = [(full, codes, np.arange(len(codes)), np.ones(len(codes), np.int64))]
        while True:
            mask, pattern, _, _ = self.levels[-1]
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            first = np.repeat(starts, np.diff(np.append(starts, len(group))))
            node = (np.arange(len(group)) - first) // FAN
            begin = np.flatnonzero((np.diff(node, prepend=-1) != 0) | (np.diff(group, prepend=-1) != 0))
            if len(begin) == len(group):
                break
            same = np.bitwise_and.reduceat(mask, begin) & ~(np.bitwise_or.reduceat(pattern, begin) ^ np.bitwise_and.reduceat(pattern, begin))
            self.levels.append((same, pattern[begin] & same, begin, np.diff(np.append(begin, len(group)))))
            group = group[begin]

    def close_pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions in one group at ``radius`` or fewer differing bits, once each; depth first, so memory is bounded."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][1]))
        todo = [(top, roots[i: i + SLICE], roots[i: i + SLICE]) for i in range(0, len(roots), SLICE)]
        while todo:
            level, a, b = todo.pop()
            mask, pattern, first, count = self.levels[level]
            near = np.bitwise_count(mask[a] & mask[b] & (pattern[a] ^ pattern[b])) <= radius
            a, b = a[near], b[near]
            if not level:
                off = a < b
                if off.any():
                    yield a[off], b[off]
                continue
            wide = count[b]
            left = np.repeat(np.arange(len(a)), count[a])
            child = np.repeat(first[a], count[a]) + ramp(count[a])
            times = wide[left]
            x = np.repeat(child, times)
            y = np.repeat(first[b][left], times) + ramp(times)
            keep = x <= y
            x, y = x[keep], y[keep]
            todo += [(level - 1, x[i: i + SLICE], y[i: i + SLICE]) for i in range(0, len(x), SLICE)]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints ``fp`` -> links ``u, v`` whose components are those of all pairs within ``radius``."""
    layouts = _layouts(radius + 2)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for t, layout in enumerate(layouts):
                width = layout[0][1] + layout[1][1]
                code = _permuted(fp, layout)
                yield {"bucket": pa.array(((code >> np.uint64(64 - width)) | np.uint64(t << width)).view(np.int64)),
                       "rank": pa.array((gray_rank(code) ^ np.uint64(1 << 63)).view(np.int64)), "code": pa.array(code.view(np.int64)), "fp": batch.column(0),
                       "t": pa.array(np.full(len(fp), t, np.int32))}

    rows = map_batches(fps.select("fp"), spread, "bucket long, rank long, code long, fp long, t int")
    placed = rows.repartition("bucket").sortWithinPartitions("bucket", "rank").select("bucket", "code", "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in runs(batches, 1):
            yield from found(np.column_stack([batch.column(i).to_numpy() for i in range(3)]))

    def found(rows: np.ndarray) -> Iterator[dict]:
        code, fp = np.ascontiguousarray(rows[:, 1]).view(np.uint64), rows[:, 2]
        for a, b in GrayIndex(code, rows[:, 0]).close_pairs(radius):
            # a tree per slice: as many links at most as members
            a, b = forest(a, b)
            yield {"u": pa.array(fp[a]), "v": pa.array(fp[b])}

    return map_batches(placed, search, "u long, v long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id`` (smallest doc_id reachable), ``kept`` (is that document)."""
    rows = checkpoint(fingerprints(docs, size))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    comps = components(links(least.select("fp"), radius))
    named = least.join(comps, least["fp"] == comps["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    ids = named.groupBy("c").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(ids, "c").select("fp", "component_id"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def representatives(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` (a table: it is read twice) per group: smallest doc_id, null last; of repeated rows the first. Rows that go are
    named by an anti join, so texts stay in place as long as those fit a broadcast that adaptive execution sizes."""
    numbered = docs.withColumn(_ROW, F.monotonically_increasing_id())
    prints = append(numbered.select(_ROW, F.col("doc_id").cast("long").alias("doc_id"), "text"), "text",
                    lambda _, texts: {"fp": pa.array(np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64))}, "fp long")
    rows = checkpoint(prints.select("doc_id", _ROW, "fp"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col(_ROW).alias("row"))
    first = rows.groupBy("fp").agg(F.min(place).alias("first"))
    comps = components(links(first.select("fp"), radius))
    named = first.join(comps, first["fp"] == comps["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    best = named.groupBy("c").agg(F.min("first").alias("best"))
    gone = rows.join(named.join(best, "c").select("fp", F.col("best.row").alias("stays")), "fp").filter(F.col(_ROW) != F.col("stays"))
    return numbered.join(gone.select(_ROW), _ROW, "left_anti").select(*docs.columns)
