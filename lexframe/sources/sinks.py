"""Sinks for token tables and scripts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.operators.tokens import token_positions, tokenize
from lexframe.sources.shipping import ship


def write_tokens(scripts: DataFrame, path: str) -> None:
    """Token listing of scripts as parquet, one folder per (lower-case) extension.

    The extension rides along with the text, so no join and no second shuffle is needed; scripts stay
    spread over the tasks by id, so one extension holding most scripts makes no hot task.
    """
    ext = F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1))
    tagged = scripts.withColumn("script_id", F.struct("script_id", ext.alias("ext")))
    tokens = token_positions(tokenize(tagged))
    tokens.select("script_id.*", "pos", "kind", "family", "text", "line", "col", "off", "newline_before").write.partitionBy(
        "ext"
    ).parquet(path)


def write_scripts(scripts: DataFrame, path: str) -> None:
    """Each ``src`` and a line end as a file of its own in the folder ``path``, written by the tasks themselves.

    Spark's writer sets up and moves every file, which takes far longer than its text; it still serves for file systems that Arrow
    does not know. A file is named after its partition and row, so a task that runs again writes the same files.
    """
    spark = scripts.sparkSession
    ship(spark)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
    uri = whole.removeprefix("file:") if whole.startswith("file:/") else whole
    try:
        store, folder = pa_fs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid:
        scripts.select("src").write.option("maxRecordsPerFile", 1).text(path)
        return
    store.create_dir(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pa_fs.FileSystem.from_uri(uri)
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for text in batch.column(0):
                with store.open_output_stream(f"{folder}/part-{part:05d}-{n:08d}.txt") as out:
                    out.write(text.as_py() or b"")
                    out.write(b"\n")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    scripts.select(F.col("src").cast("binary")).mapInArrow(write, "n long").agg(F.sum("n")).first()
