"""Structured Streaming jobs that reuse the batch operators."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexframe.operators.blocks import BLOCK, block_number
from lexframe.operators.logs import error_messages, write_error_log
from lexframe.operators.rules import all_diagnostics, script_verdict
from lexframe.operators.runs import merged
from lexframe.operators.tokens import tokenize
from lexframe.operators.traces import read_trace
from lexframe.sources.shipping import ship
from lexframe.sources.workdir import new_dir


def run_available(stream: DataFrame, write_batch, mode: str, checkpoint_dir: str) -> None:
    """Processes all data at hand in micro-batches and stops."""
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True).foreachBatch(write_batch).start()
    )
    query.awaitTermination()


def stream_verdict(scripts: DataFrame, *, log_path: str | None = None) -> str:
    """Checks arriving scripts; returns the folder of the verdict table.

    With ``log_path`` the diagnostics are also written there as log lines, a folder per batch; they are computed once for both.
    """
    out = new_dir(scripts.sparkSession, "verdicts")

    def write(df: DataFrame, batch_id: int) -> None:
        diagnostics = all_diagnostics(tokenize(df)).persist()
        try:
            if log_path is not None:
                located = diagnostics.join(df.select("script_id", "path"), "script_id")
                write_error_log(located, f"{log_path}/batch={batch_id}", mode="overwrite")
            script_verdict(df, diagnostics).write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")
        finally:
            diagnostics.unpersist()

    run_available(scripts, write, "append", f"{out}/checkpoint")
    return f"{out}/data"


def stream_error_counts(lines: DataFrame) -> str:
    """Running counts per message and category of a growing log; returns the folder of the tables per batch."""
    counts = error_messages(lines).groupBy("message", "category").agg(
        F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line")
    )
    out = new_dir(lines.sparkSession, "error-counts")

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    run_available(counts, write, "complete", f"{out}/checkpoint")
    return f"{out}/data"


def latest_batch(df: DataFrame) -> DataFrame:
    """Rows of the last batch of a complete-mode table (its batch numbers come from the folder names)."""
    return df.filter(F.col("batch") == df.agg(F.max("batch")).scalar()).drop("batch")


# --- traces ----------------------------------------------------------------------------------------------

_EVENT = ["kind", "token", "stack", "parent", "rule", "rule_line"]
_SUMMARY = "trace_id long, block long, run string"
_REPORT = "trace_id long, last_line long, max_stack int, peak_alive int, n_splits long, top_token string, top_rule string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Line numbers per page; a batch opens the pages its lines fall into.
PAGE = 1 << 16


def _blocks(page: int) -> StatefulProcessor:
    """A processor that travels by value: Spark also loads it in a process of the driver that lacks shipped packages."""

    class Blocks(StatefulProcessor):
        """State of one block of a trace: its pages of events, each with its summary."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self._pages = handle.getMapState("pages", "page long", "events string")
            self._runs = handle.getMapState("runs", "page long", "run string")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
            from lexframe.operators.runs import merged, summarize

            arrived: dict[int, dict[int, tuple]] = {}
            for pdf in rows:
                pdf = pdf.astype(object).where(pdf.notna(), None)
                for line, *event in zip(pdf["line_no"], *(pdf[c] for c in _EVENT)):
                    # frames carry integers that have gaps as floats
                    numbers = [None if v is None else int(v) for v in event[2:]]
                    arrived.setdefault(int(line) // page, {})[int(line)] = (*event[:2], *numbers)
            runs = {number: run for (number,), (run,) in self._runs.iterator()}
            for number, events in arrived.items():
                if number in runs:
                    held = json.loads(self._pages.getValue((number,))[0])
                    events = {line: tuple(event) for line, event in held} | events
                runs[number] = summarize(events).dump()
                self._pages.updateValue((number,), (json.dumps(list(events.items())),))
                self._runs.updateValue((number,), (runs[number],))
            total = merged([runs[number] for number in sorted(runs)])
            yield pd.DataFrame({"trace_id": [key[0]], "block": [key[1]], "run": [total.dump()]})

        def close(self) -> None:
            pass

    return Blocks()


def _report(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    run = merged(list(pdf.sort_values("block")["run"]))

    def most(counts: dict) -> object:
        return max(counts, key=lambda k: (counts[k][0], -counts[k][1]), default=None)

    rule = most(run.rules)
    rule = None if rule is None else "@".join(str(part) for part in rule if part is not None)
    n_splits = sum(n for n, _ in run.tokens.values())
    row = (key[0], run.last_line, run.max_stack, max(1, run.peak({0})), n_splits, most(run.tokens), rule)
    return pd.DataFrame([row], columns=["trace_id", "last_line", "max_stack", "peak_alive", "n_splits", "top_token", "top_rule"])


def trace_summaries(lines: DataFrame, state_dir: str, *, block: int = BLOCK, page: int = PAGE) -> DataFrame:
    """Takes in all lines at hand; returns the newest summary of each block, ``trace_id, block, run``.

    The state store keeps the events of each block in pages. A batch opens the pages its lines fall into, and a row leaves for each block it
    touches; blocks and pages without new lines are not read. A line's place is its number, so lines may arrive in any order and late;
    a line that arrives again replaces itself. Called again with the same ``state_dir``, a stream goes on where it stopped.
    """
    spark = lines.sparkSession
    ship(spark)
    kinds = ["next_token", "reduce", "die", "rename", "split"]
    events = read_trace(lines).filter(F.col("kind").isin(kinds)).withColumn("block", block_number("line_no", block))
    keyed = events.select("trace_id", "block", "line_no", *_EVENT).groupBy("trace_id", "block")
    blocks = keyed.transformWithStateInPandas(_blocks(page), _SUMMARY, "Update", "None")

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{state_dir}/data/batch={batch_id}")

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        run_available(blocks, write, "update", f"{state_dir}/checkpoint")
    finally:
        spark.conf.set(_PROVIDER, before)
    rows = spark.read.schema(f"{_SUMMARY}, batch long").parquet(f"{state_dir}/data")
    return rows.groupBy("trace_id", "block").agg(F.max_by("run", "batch").alias("run"))


def stream_trace(lines: DataFrame, *, state_dir: str | None = None, block: int = BLOCK, page: int = PAGE) -> str:
    """Takes in all lines at hand and reports on each trace; returns the folder of the table.

    The report merges a summary per block and reads no events. Its rows equal ``trace_report`` over all lines so far.
    """
    spark = lines.sparkSession
    summaries = trace_summaries(lines, state_dir or new_dir(spark, "trace-state"), block=block, page=page)
    out = new_dir(spark, "traces")
    summaries.groupBy("trace_id").applyInPandas(_report, _REPORT).write.parquet(out)
    return out
