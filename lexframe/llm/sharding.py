"""Sharding by k-d tree partitioning: cells are split at weighted medians along their widest metadata dimension until leaves have the target bytes.

A document is a point of metadata (numbers as they are, strings by a hash, the size by its logarithm) with its bytes as weight. A level first takes count,
bytes and range of each dimension per cell; the dimension that is widest against its range over the whole table is cut where half the bytes (of an odd
number of leaves the nearest share) lie on each side. The cut is found by histograms of the key: position along the dimension, then hash of the text,
hash of the id, a salt of the row, so equal texts stay neighbours and only a group at a cut is parted, however many rows share a point. A pass adds
``BITS`` bits of the key until the bin at the cut holds one document or at most ``tolerance`` of the cell. Passes read narrow rows written once; a bin is a
sum before the shuffle, and only a row per cell comes to the driver. The tree (at most ``LEAVES`` leaves, some 60 bytes each) is what routes rows, by a
broadcast per level.

Edge cases: a null text has size 1, null and non-finite metadata are 0; a null doc_id is a row like others; repeated rows are each one row and are
told apart by the salt; a document is never cut, so a leaf may differ by one document's bytes and tolerance; fewer documents than leaves leave empty
shards. An empty table gives no rows. Metadata columns that are missing are left out; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexframe.llm.common import map_batches
from lexframe.sources.workdir import written

SHARDS = 8
LEAVES = 65_536
METADATA = ("lang", "source")
POSITION = 20  # bits of the key for the place along a dimension; 20 for the text, 12 for the id, 8 for the row
KEY = 60
BITS = 12
TOLERANCE = 0.001

Level = list[tuple[int, int, float, float, int, int]]  # cell, dimension, low, scale, cut, right cell


def _point(docs: DataFrame, metadata: tuple[str, ...]) -> list[Column]:
    types = dict(docs.dtypes)
    size = F.coalesce(F.octet_length("text").cast("long"), F.lit(0)) + 1

    def place(name: str) -> Column:
        if types[name] == "string":
            return F.crc32(F.col(name).cast("binary")) + F.lit(1.0)
        number = F.col(name).cast("double")
        return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)

    at = [F.log2(size.cast("double"))] + [place(c) for c in metadata if c in types]
    text = F.shiftleft(F.xxhash64("text").bitwiseAND(0xFFFFF), 20)
    doc = F.shiftleft(F.xxhash64("doc_id").bitwiseAND(0xFFF), 8)
    row = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(0xFF)
    return [
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.array(*[F.coalesce(c, F.lit(0.0)) for c in at]).alias("at"), text.bitwiseOR(doc).bitwiseOR(row).alias("tie"),
    ]


def points(docs: DataFrame, metadata: tuple[str, ...] = METADATA) -> DataFrame:
    """``doc_id, size, text_crc32, at`` (place per dimension), ``tie`` (low bits of the key); other columns of ``docs`` go."""
    return docs.select(*_point(docs, metadata))


def _small(rows: DataFrame, values: list[tuple], fields: dict[str, pa.DataType]) -> DataFrame:
    """A row per cell of the driver's list, to be broadcast."""
    columns = list(zip(*values, strict=True))
    return F.broadcast(rows.sparkSession.createDataFrame(pa.table({n: pa.array(c, t) for (n, t), c in zip(fields.items(), columns, strict=True)})))


def _at_cell(rows: DataFrame, level: Level) -> DataFrame:
    """Rows with the facts of their cell (null if it is a leaf) and their ``key`` along its dimension."""
    cells = _small(rows, level, {"shard": pa.int32(), "_dim": pa.int32(), "_low": pa.float64(), "_scale": pa.float64(), "_cut": pa.int64(), "_right": pa.int32()})
    place = F.floor((F.element_at("at", F.col("_dim") + 1) - F.col("_low")) * F.col("_scale"))
    inside = F.least(F.greatest(place, F.lit(0)), F.lit((1 << POSITION) - 1)).cast("long")
    return rows.join(cells, "shard", "left").withColumn("key", F.shiftleft(inside, KEY - POSITION).bitwiseOR(F.col("tie")))


def _step(rows: DataFrame, level: Level) -> DataFrame:
    """Rows moved to the cells of the next level."""
    moved = F.when(F.col("key") >= F.col("_cut"), F.col("_right")).otherwise(F.col("shard")).cast("int")
    return _at_cell(rows, level).withColumn("shard", moved).drop("_dim", "_low", "_scale", "_cut", "_right", "key")


def _cuts(rows: DataFrame, cells: dict[int, dict], tolerance: float) -> None:
    """Sets ``cut`` of each cell: the key at which about the wanted bytes lie below."""
    todo = dict(cells)
    done = 0
    for cell in todo.values():
        cell |= {"prefix": 0, "below": 0}
    while todo and done < KEY:
        shift = KEY - done - BITS
        level = [(c, v["dim"], v["low"], v["scale"], v["prefix"], 0) for c, v in todo.items()]
        keyed = _at_cell(rows, level).filter(F.col("_dim").isNotNull() & (F.shiftright("key", shift + BITS) == F.col("_cut")))
        bins = keyed.groupBy("shard", F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
        wanted = _small(rows, [(c, v["wanted"] - v["below"]) for c, v in todo.items()], {"shard": pa.int32(), "wanted": pa.float64()})
        upto = F.sum("bytes").over(Window.partitionBy("shard").orderBy("bin"))
        bins = bins.withColumn("upto", upto).join(wanted, "shard").filter(F.col("upto") >= F.col("wanted"))
        for row in bins.groupBy("shard").agg(F.min_by(F.struct("bin", "bytes", "upto", "n"), "bin").alias("b")).collect():  # a row per cell
            cell = todo[row.shard]
            start = cell["below"] + row.b.upto - row.b.bytes
            end = start + row.b.bytes
            cell |= {"prefix": row.b.bin, "below": start}
            if not shift or row.b.n == 1 or row.b.bytes <= tolerance * cell["bytes"]:
                after = end - cell["wanted"] < cell["wanted"] - start  # the nearer side of the bin
                cell["cut"] = (row.b.bin + after) << shift
                del todo[row.shard]
        done += BITS


def grow(rows: DataFrame, leaves: int, tolerance: float = TOLERANCE) -> tuple[DataFrame, list[Level]]:
    """``points`` rows (a table, read once per pass) -> the rows with ``shard``, and the levels of the tree."""
    if not 0 < leaves <= LEAVES:
        raise ValueError(f"1 to {LEAVES} leaves")
    rows = rows.withColumn("shard", F.lit(0))
    parts = {0: leaves}  # cell = its first leaf -> how many leaves it becomes
    ranges: list[float] | None = None
    levels: list[Level] = []
    width = len(rows.select("at").head().at) if leaves > 1 and rows.head(1) else 0
    while width and any(k > 1 for k in parts.values()):
        low = [F.min(F.element_at("at", d + 1)).alias(f"low{d}") for d in range(width)]
        high = [F.max(F.element_at("at", d + 1)).alias(f"high{d}") for d in range(width)]
        open_cells = rows.filter(F.col("shard").isin([c for c, k in parts.items() if k > 1])) if len(parts) < 100 else rows
        cells = {}
        for row in open_cells.groupBy("shard").agg(F.sum("size").alias("bytes"), *low, *high).collect():  # a row per cell
            if parts[row.shard] == 1:
                continue
            spans = [row[f"high{d}"] - row[f"low{d}"] for d in range(width)]
            ranges = ranges or spans
            dim = max(range(width), key=lambda d: spans[d] / ranges[d] if ranges[d] else 0.0)
            scale = ((1 << POSITION) - 1) / spans[dim] if spans[dim] else 0.0
            left = parts[row.shard] // 2
            cells[row.shard] = {"dim": dim, "low": row[f"low{dim}"], "scale": scale if math.isfinite(scale) else 0.0, "bytes": row.bytes,
                                "left": left, "wanted": row.bytes * left / parts[row.shard]}
        if not cells:
            break
        _cuts(rows, cells, tolerance)
        levels.append([(c, v["dim"], v["low"], v["scale"], v["cut"], c + v["left"]) for c, v in cells.items()])
        parts = {c: k for c, k in parts.items() if k == 1} | {c: v["left"] for c, v in cells.items()} | {
            c + v["left"]: parts[c] - v["left"] for c, v in cells.items()}
        rows = _step(rows, levels[-1])
        if not len(levels) % 6:  # deep trees: rows move on from here
            rows = written(rows, "cells")
    return rows, levels


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``slot``: 0 .. n - 1 in each shard, by counts of the tasks that met them; no shard passes one task."""
    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.LongType()), T.StructField("_index", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        met: dict[int, int] = {}
        for batch in batches:
            shard = batch.column(batch.schema.get_field_index("shard")).to_numpy()
            index = np.empty(len(shard), np.int64)
            for s in np.unique(shard).tolist():
                own = np.flatnonzero(shard == s)
                index[own] = met.get(s, 0) + np.arange(len(own))
                met[s] = met.get(s, 0) + len(own)
            yield {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True)} | {
                "_part": pa.array(np.full(len(shard), part)), "_index": pa.array(index)}

    # written: the numbers of a task must not change when another one is run again
    table = written(map_batches(rows, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)), "numbered")
    counts = table.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("n")
    starts = counts.select("shard", "_part", before.alias("_start"))
    return table.join(starts, ["shard", "_part"]).withColumn("slot", F.col("_start") + F.col("_index")).drop("_part", "_index", "_start")


def shard(docs: DataFrame, shards: int = SHARDS, target_bytes: int | None = None, metadata: tuple[str, ...] = METADATA,
          tolerance: float = TOLERANCE) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``; ``target_bytes`` gives the number of shards by the size of the table."""
    rows = written(points(docs, metadata), "points")
    if target_bytes:
        shards = max(1, math.ceil((rows.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    placed, _ = grow(rows, shards, tolerance)
    return _numbered(placed.select("doc_id", "size", "text_crc32", "shard"))


def route(docs: DataFrame, levels: list[Level], metadata: tuple[str, ...] = METADATA) -> DataFrame:
    """Documents with all their columns and ``shard`` (in place of a column of that name) by a grown tree; nothing moves."""
    kept = [c for c in docs.columns if c != "shard"]
    rows = docs.select(F.struct(*kept).alias("_row"), F.struct(*_point(docs, metadata)).alias("_p")).select("_row", "_p.*", F.lit(0).alias("shard"))
    for level in levels:
        rows = _step(rows, level)
    return rows.select("_row.*", "shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files: int = 8, metadata: tuple[str, ...] = METADATA) -> None:
    """Whole documents as a table with a folder per shard and about ``files`` files in each."""
    _, levels = grow(written(points(docs, metadata), "points"), shards)
    placed = route(docs, levels, metadata)
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(files))
    placed.repartition(shards * files, "shard", spread).write.partitionBy("shard").parquet(path)
