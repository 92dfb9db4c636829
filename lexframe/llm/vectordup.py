"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes is learned on a bounded sample so that signs are balanced (iterative quantisation). The bits of a code are cut in
groups, a table for each. Retrieval is exact: for unit vectors a cosine of at least ``least`` bounds the squared distance by t = 2 - 2 least, so some
group has at most its share of t; a bit differs there only if both coordinates lie on either side of zero, so in one direction the
squares of the coordinates to flip sum to half the share at most. Each vector probes every such flip set, hence no pair is lost.
Pairs that meet are compared by their original vectors. A pair counts at the first table that finds it, in one direction.

Equal vectors of a label are one node with a multiplicity; nodes of a crowded bucket are compared in blocks; only sums per node and
a forest of links leave a task, never all pairs.

Edge cases: vectors that are null, zero, or hold null or non-finite components, and rows without a label, link with nothing; vectors of other
lengths never link; repeated rows are vectors of their own; a null vec_id links but is no smallest id (alone, its component is null). An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm.common import checkpoint, components, forest, map_batches, ramp, runs

COSINE = 0.98
SAMPLE = 4096  # vectors that the rotation is learned on, per length
ROUNDS = 30
BLOCK = 1024  # nodes of a side of a block within a bucket
SLICE = 1 << 15
SLACK = 1e-9


class Rotation:
    """Codes of unit vectors: signs of rotated, centred coordinates."""

    def __init__(self, centre: np.ndarray, axes: np.ndarray, tables: int, share: float):
        self.centre, self.axes, self.share = centre, axes, share
        self.groups = np.array_split(np.arange(axes.shape[1]), max(1, min(tables, axes.shape[1])))

    def place(self, unit: np.ndarray) -> np.ndarray:
        return np.round((unit - self.centre) @ self.axes, 10)  # the same in blocks of any shape

    def half(self) -> float:
        return self.share / len(self.groups) / 2 + SLACK


def learn(unit: np.ndarray, tables: int, least: float) -> Rotation:
    """Principal axes, turned so that the signs are close to the coordinates; the axes stay orthonormal."""
    centre = unit.mean(axis=0)
    bits = min(64, unit.shape[1])
    _, _, axes = np.linalg.svd(unit - centre, full_matrices=True)
    axes = axes[:bits].T
    v = (unit - centre) @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(5).standard_normal((bits, bits)))
    for _ in range(ROUNDS):
        code = np.where(v @ turn > 0, 1.0, -1.0)
        a, _, b = np.linalg.svd(code.T @ v)
        turn = b.T @ a.T
    return Rotation(centre, axes @ turn, tables, 2 - 2 * least)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def flips(squares: np.ndarray, limit: float) -> list[int]:
    """Masks of all sets of coordinates whose squares sum to the limit at most; the empty set first."""
    order = np.argsort(squares)
    order = order[squares[order] <= limit].tolist()
    value = squares.tolist()
    out, todo = [], [(0, 0, limit)]
    while todo:
        mask, i, left = todo.pop()
        out.append(mask)
        for k in range(i, len(order)):
            rest = left - value[order[k]]
            if rest < 0:
                break
            todo.append((mask | 1 << order[k], k + 1, rest))
    return out


def usable(label: str = "label", vector: str = "embedding"):
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(label).isNotNull() & F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nodes_of(rows: DataFrame) -> DataFrame:
    """Distinct usable vectors per label: ``node, label, embedding, size, mult, first``. Checkpointed, so the numbers stay."""
    grouped = rows.filter(usable()).groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("mult"), F.min("vec_id").alias("first"))
    return checkpoint(grouped.select(F.monotonically_increasing_id().alias("node"), "label", "embedding", F.size("embedding").alias("size"), "mult", "first"))


def links(nodes: DataFrame, least: float = COSINE) -> DataFrame:
    """``u, v, n``: for u = v, n is how many vectors of other nodes link with each vector of u; else u and v are linked nodes of a forest."""
    spark = nodes.sparkSession
    total = nodes.agg(F.count(F.lit(1))).first()[0]
    tables = max(1, 64 // max(16, math.ceil(math.log2(max(total, 2)))))  # longer keys for larger tables; exact with any number
    rotations = {}
    for (size,) in nodes.select("size").distinct().collect():
        some = nodes.filter(F.col("size") == size).orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("embedding").toPandas()["embedding"]
        rotations[size] = learn(units(np.array([np.asarray(x, np.float64) for x in some])), tables, least)
    shared = spark.sparkContext.broadcast(rotations)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                rotation = shared.value[int(size)]
                place = rotation.place(units(_matrix(part.column(1))))
                node, table, key, own = [], [], [], []
                for g, group in enumerate(rotation.groups):
                    local = place[:, group]
                    codes = ((local > 0) @ (1 << np.arange(len(group), dtype=np.int64))).astype(np.int64).tolist()
                    for i, code in enumerate(codes):
                        masks = flips(local[i] ** 2, rotation.half())
                        node += [i] * len(masks)
                        table += [g] * len(masks)
                        key += [_signed(code ^ m) for m in masks]
                        own += [True] + [False] * (len(masks) - 1)
                at = pa.array(node, pa.int64())
                yield {"node": part.column(0).take(at), "label": part.column(3).take(at), "size": part.column(2).take(at),
                       "g": pa.array(table, pa.int32()), "key": pa.array(key, pa.int64()), "own": pa.array(own, pa.bool_())}

    label_type = dict(nodes.dtypes)["label"]
    probes = checkpoint(map_batches(nodes.select("node", "embedding", "size", "label"), keys,
                                    f"node long, label {label_type}, size int, g int, key long, own boolean"))
    bucket = ["label", "size", "g", "key"]
    crowd = probes.groupBy(*bucket).agg(F.count(F.lit(1)).alias("probing"), F.sum(F.col("own").cast("long")).alias("stored")).filter("stored > 0 and probing > 1")
    met = probes.join(crowd, bucket).withColumn("p_chunks", F.ceil(F.col("probing") / BLOCK).cast("int")).withColumn("s_chunks", F.ceil(F.col("stored") / BLOCK).cast("int"))
    mine = lambda n: F.pmod(F.xxhash64("node", F.lit(1)), F.col(n).cast("long")).cast("int")
    name = F.xxhash64(*bucket)
    asking = met.select("node", "g", name.alias("h"), mine("p_chunks").alias("p"), F.explode(F.sequence(F.lit(0), F.col("s_chunks") - 1)).alias("s"), F.lit(False).alias("stored"))
    holding = met.filter("own").select("node", "g", name.alias("h"), F.explode(F.sequence(F.lit(0), F.col("p_chunks") - 1)).alias("p"), mine("s_chunks").alias("s"), F.lit(True).alias("stored"))
    rows = asking.unionByName(holding).join(nodes.select("node", "embedding", "size", "mult"), "node")
    blocks = rows.repartition("h", "p", "s").sortWithinPartitions("h", "p", "s", "g", "stored", "node").select("h", "p", "s", "g", "stored", "node", "mult", "size", "embedding")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for block in runs(batches, 3):
            sizes = block.column(7).to_numpy()
            for size in np.unique(sizes):
                yield from meet(block.filter(pa.array(sizes == size)), shared.value[int(size)])

    def meet(block: pa.RecordBatch, rotation: Rotation) -> Iterator[dict]:
        group = np.cumsum(np.any([np.diff(block.column(i).to_numpy().astype(np.int64), prepend=-1) != 0 for i in range(3)], axis=0)) - 1
        g, stored = block.column(3).to_numpy(), block.column(4).to_numpy(zero_copy_only=False)
        node, mult = block.column(5).to_numpy(), block.column(6).to_numpy()
        unit = units(_matrix(block.column(8)))
        place = rotation.place(unit)
        holds = np.bincount(group[stored], minlength=group[-1] + 1)
        held = np.flatnonzero(stored)
        first = np.cumsum(holds) - holds
        asking = np.flatnonzero(~stored)
        counts = holds[group[asking]]
        gained: dict[int, int] = {}
        ends = np.cumsum(counts)
        at = 0
        while at < len(asking):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
            x = np.repeat(asking[at:to], counts[at:to])
            y = held[np.repeat(first[group[asking[at:to]]], counts[at:to]) + ramp(counts[at:to])]
            at = to
            near = (node[x] != node[y]) & (np.einsum("ij,ij->i", unit[x], unit[y]) >= least)
            x, y = x[near], y[near]
            mine = first_found(place[x], place[y], rotation, g[x], node[x] < node[y])
            x, y = x[mine], y[mine]
            for a, b, m, n in zip(node[x].tolist(), node[y].tolist(), mult[x].tolist(), mult[y].tolist(), strict=True):
                gained[a] = gained.get(a, 0) + n
                gained[b] = gained.get(b, 0) + m
            u, v = forest(node[x], node[y])
            yield {"u": pa.array(u), "v": pa.array(v), "n": pa.array(np.zeros(len(u), np.int64))}
        yield {"u": pa.array(list(gained), pa.int64()), "v": pa.array(list(gained), pa.int64()), "n": pa.array(list(gained.values()), pa.int64())}

    return checkpoint(map_batches(blocks, compare, "u long, v long, n long"))


def first_found(x: np.ndarray, y: np.ndarray, rotation: Rotation, g: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether x probing y in table g is the one time the pair counts."""
    limit = rotation.half()
    differ = (x > 0) != (y > 0)
    keep = np.ones(len(x), bool)
    for table, group in enumerate(rotation.groups):
        d = differ[:, group]
        x_finds = _reached(x[:, group], d, limit)
        y_finds = _reached(y[:, group], d, limit)
        keep &= ~((table < g) & (x_finds | y_finds))
        keep &= ~((table == g) & y_finds & ~ordered)
    return keep


def _reached(x: np.ndarray, differ: np.ndarray, limit: float) -> np.ndarray:
    """The test of ``flips`` for one mask: subtracts in the same order, so that both agree to the last bit."""
    squares = np.where(differ, x ** 2, 0.0)
    left = np.full(len(x), limit)
    ordered = np.sort(squares, axis=1)
    for k in range(ordered.shape[1]):
        left = left - ordered[:, k]
    return left >= 0


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def near_duplicates(rows: DataFrame, least: float = COSINE) -> DataFrame:
    """``vec_id, embedding, label`` -> ``vec_id, n_links, component_id, kept`` for every row."""
    rows = rows.select(F.col("vec_id").cast("long"), "embedding", "label")
    nodes = nodes_of(rows)
    found = links(nodes, least)
    gained = found.filter("u = v").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    comps = components(found.filter("u <> v").select("u", "v"))
    named = nodes.join(comps, "node", "left").join(gained, "node", "left").select(
        "label", "embedding", "first", "mult", F.coalesce("component", "node").alias("c"), F.coalesce("n", F.lit(0)).alias("n"))
    ids = named.groupBy("c").agg(F.min("first").alias("component_id"))
    facts = named.join(ids, "c").select("label", "embedding", (F.col("n") + F.col("mult") - 1).alias("n_links"), "component_id")
    out = rows.join(facts, ["label", "embedding"], "left")
    # a usable row without a smallest id has none of its own either
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
