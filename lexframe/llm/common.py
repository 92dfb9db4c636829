"""What the operators share: reading tables, texts in blocks for tasks, components of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexframe.sources.shipping import ship
from lexframe.sources.workdir import checkpoint

__all__ = ["append", "checkpoint", "components", "forest", "map_batches", "ramp", "read", "runs", "ship", "small_batches"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with a function from a stream of batches to a stream of column dicts."""
    ship(df.sparkSession)
    names = [part.split()[0] for part in _fields(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays([columns[n] if isinstance(columns[n], pa.Array) else pa.array(columns[n]) for n in names], names=names)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return df.mapInArrow(run, schema)


def small_batches(batches: Iterator[pa.RecordBatch], column: int = 1, chars: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with about ``chars`` of text each, and their texts; a longer text is a slice of its own."""
    for batch in batches:
        sizes = (pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy() + 64).tolist()
        start = size = 0
        for i, n in enumerate(sizes):
            size += n
            if size >= chars or i + 1 == len(sizes):
                part = batch.slice(start, i + 1 - start)
                yield part, part.column(column).to_pylist()  # never all texts of a batch as Python strings
                start, size = i + 1, 0


def _fields(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i])
            start = i + 1
    return [*out, schema[start:]]


def append(df: DataFrame, text: str, fn, added: str) -> DataFrame:
    """Rows with the columns ``added`` that ``fn(slice, texts)`` makes; slices are small, so long texts do not pile up in a worker."""
    ship(df.sparkSession)
    new = T.StructType.fromDDL(added)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in [*df.schema.fields, *new.fields]])
    names, at, made = schema.names, df.columns.index(text), new.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in small_batches(batches, at):
            columns = fn(part, texts)
            yield pa.RecordBatch.from_arrays([*part.columns, *[columns[n] for n in made]], names=names)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def ramp(counts: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each count n, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut anew so that rows equal in the first ``keys`` columns stay together."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        rows = pa.Table.from_batches([held, batch] if held is not None and held.num_rows else [batch]).combine_chunks().to_batches()
        if not rows:
            continue
        new = np.any([np.diff(rows[0].column(i).to_numpy(zero_copy_only=False)) != 0 for i in range(keys)], axis=0)
        cut = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
        if cut:
            yield rows[0].slice(0, cut)
        held = rows[0].slice(cut)
    if held is not None and held.num_rows:
        yield held


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links those that join two trees: as many as there are nodes at most."""
    parent: dict[int, int] = {}
    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = _top(parent, x), _top(parent, y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(i)
    return a[keep], b[keep]


def _top(parent: dict[int, int], x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Links of a partition -> stars of its local components: never more rows than links came in."""
    parent: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = _top(parent, a), _top(parent, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, _top(parent, x)) for x in list(parent) if _top(parent, x) != x]
    yield {"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())}


def components(links: DataFrame) -> DataFrame:
    """Links ``u, v`` (longs) -> ``node, component``: the smallest node reachable, for nodes with a link to another one.

    Alternating stars: every node tells its larger neighbours of its smallest one, then its smaller ones. Rounds end when the
    links no longer change; each round's links are checkpointed. A node with many neighbours is only ever grouped by a minimum,
    which is aggregated before the shuffle, and its rows meet that one minimum in a join that adaptive execution can split.
    """
    links = links.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v")
    stars = checkpoint(map_batches(links, _stars, "u long, v long").distinct())

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()

    seen = state(stars)
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("l")
        ).select("l.u", "l.v").filter("u <> v").distinct()
        stars = checkpoint(small)
        now = state(stars)
        if now == seen:
            return stars.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        seen = now
