"""Line dedup by overlapping windows of three lines.

Lines with a visible character are numbered within their document; every three consecutive ones are a window, hashed to 128 bits. The
first occurrence of a window is its smallest (doc_id, row, line). Later occurrences cover their three lines; a document loses the merged covered
lines. Blank lines are in no window and stay, except that they go with a covered line right before them.

Edge cases: documents with fewer than three visible lines have no window and stay as they are, as do null and empty texts; windows
repeated within a document count; repeated rows (also of one doc_id) are documents of their own, in the order of
their place in the input, so one of them keeps its lines. Null doc_ids come last. An empty table gives no rows. Other columns are carried along.
Lines end at ``\\n`` only. The input is read twice and its rows numbered each time: give a table on disk, or a checkpointed frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm.common import append, map_batches, small_batches

WINDOW = 3
_ROW = "_line_dedup_row"
_STARTS = "_line_dedup_starts"
_TEXT, _COUNT = "_line_dedup_text", "_line_dedup_count"


def window_hashes(text: str | None, size: int = WINDOW) -> list[bytes]:
    lines = [x for x in (text or "").split("\n") if x and not x.isspace()]
    coded = [x.encode("utf-8", "replace") for x in lines]
    return [xxhash.xxh3_128_digest(b"\n".join(coded[i: i + size])) for i in range(len(coded) - size + 1)]


def remove_lines(text: str, starts: list[int], size: int = WINDOW) -> tuple[str, int]:
    """The text without the windows that start at these lines, and the number of lines removed."""
    lines = text.split("\n")
    visible = np.array([bool(x) and not x.isspace() for x in lines])
    number = np.cumsum(visible) - 1
    at = np.zeros(int(visible.sum()) + 1, np.int64)
    np.add.at(at, starts, 1)
    np.add.at(at, np.asarray(starts) + size, -1)
    covered = np.append(np.cumsum(at)[:-1] > 0, False)
    gone = np.where(number >= 0, covered[number], False)
    return "\n".join([x for x, g in zip(lines, gone.tolist(), strict=True) if not g]), int((gone & visible).sum())


def _numbered(docs: DataFrame) -> DataFrame:
    # follows from the input split alone, hence the same in each use and when a task runs again
    return docs.withColumn(_ROW, F.monotonically_increasing_id())


def repeated_windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """For each row (numbered as by ``_numbered``) the lines where a later occurrence of a window starts."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, texts in small_batches(batches):
            found = [window_hashes(t, size) for t in texts]
            counts = np.array([len(x) for x in found])
            flat = np.frombuffer(b"".join([b"".join(x) for x in found]), np.int64).reshape(-1, 2)
            of = pa.array(np.repeat(np.arange(len(texts)), counts))
            yield {"h": flat[:, 0], "g": flat[:, 1], "doc_id": batch.column(0).take(of), "row": batch.column(2).take(of),
                   "line": np.concatenate([np.arange(n) for n in counts]).astype(np.int32) if len(counts) else np.zeros(0, np.int32)}

    rows = map_batches(docs.select(F.col("doc_id").cast("long"), "text", _ROW), hashes, "h long, g long, doc_id long, row long, line int")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "line")
    first = rows.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("end")).filter("first <> end").select("h", "g", "first")
    later = rows.join(first, ["h", "g"]).filter((F.col("first.row") != F.col("row")) | (F.col("first.line") != F.col("line")))
    return later.groupBy(F.col("row").alias(_ROW)).agg(F.sort_array(F.collect_set("line")).alias(_STARTS))


def dedup_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` with the remaining text in ``text``, and ``n_lines_removed``."""
    numbered = _numbered(docs)
    joined = numbered.join(repeated_windows(numbered, size), _ROW, "left")

    place = joined.columns.index(_STARTS)

    def rest(part: pa.RecordBatch, texts: list) -> dict:
        done = [(t, 0) if s is None else remove_lines(t, s, size) for t, s in zip(texts, part.column(place).to_pylist(), strict=True)]
        return {_TEXT: pa.array([d[0] for d in done], pa.string()), _COUNT: pa.array([d[1] for d in done], pa.int64())}

    out = append(joined, "text", rest, f"{_TEXT} string, {_COUNT} long")
    return out.select(*[F.col(_TEXT).alias(c) if c == "text" else F.col(c) for c in docs.columns], F.col(_COUNT).alias("n_lines_removed"))
