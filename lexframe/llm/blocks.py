"""Documents as compressed blocks of bounded size in a bucketed table: what is learned elsewhere about a block joins it without moving texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm.common import map_batches
from lexframe.sources.workdir import new_dir


def blocks_of(docs: DataFrame, size: int, lang: bool = False) -> DataFrame:
    """``block, ids, sizes, payload`` (and ``langs``) of about ``size`` bytes each; a longer text is in a block with what came before it."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        base, made = TaskContext.get().partitionId() << 24, 0
        rows: list[tuple] = []
        held = 0

        def block() -> dict:
            out = {"block": pa.array([base + made], pa.int64()), "ids": pa.array([[r[0] for r in rows]], pa.list_(pa.int64())),
                   "sizes": pa.array([[len(r[1]) for r in rows]], pa.list_(pa.int64())),
                   "payload": pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join([r[1] for r in rows]))], pa.binary())}
            return out | ({"langs": pa.array([[r[2] for r in rows]], pa.list_(pa.string()))} if lang else {})

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows.append((row[0], (row[1] or "").encode("utf-8", "replace"), *row[2:]))
                held += len(rows[-1][1])
                if held >= size:
                    yield block()
                    made += 1
                    rows, held = [], 0
        if rows:
            yield block()

    source = docs.select(F.col("doc_id").cast("long"), "text", *([F.col("lang").cast("string")] if lang else []))
    buckets = min(max(source.rdd.getNumPartitions(), 1), 50_000)
    rows = map_batches(source, collect, "block long, ids array<long>, sizes array<long>, payload binary" + ", langs array<string>" * lang)
    name = f"document_blocks_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, "block").option("path", new_dir(docs.sparkSession, name)).saveAsTable(name)
    return docs.sparkSession.table(name)


def unpack(payload: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(payload)


def texts_of(payload: bytes, sizes) -> list[str]:
    raw = unpack(payload)
    ends = np.cumsum(np.asarray(sizes, np.int64)).tolist()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends[:-1]], ends, strict=True)]
