"""Analytics over debug traces of a parser that splits, merges and drops stacks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexframe.operators.blocks import BLOCK, block_number, carry_last
from lexframe.sources.shipping import ship

# --- fixed values: line formats, tried in this order ----------------------------------------------
NEXT_TOKEN = "Next token is token"
SPLIT = r"Splitting off stack (\d+) from (\d+)"
DIES = r"Stack (\d+)"
RENAME = r"Rename stack (\d+) -> (\d+)"
REDUCED = r"Reduced stack (\d+) by rule (\d+) \(line (\d+)\)"
# --------------------------------------------------------------------------------------------------


def read_trace(lines: DataFrame) -> DataFrame:
    """``trace_id, line_no, kind, token, stack, parent, rule, rule_line`` events of trace lines."""
    text = F.trim("text")
    kind = (
        F.when(text.startswith(NEXT_TOKEN), "next_token")
        .when(text.contains("Splitting off stack"), "split")
        .when(text.contains("Stack ") & text.contains("dies"), "die")
        .when(text.startswith("Rename stack"), "rename")
        .when(text.startswith("Cleanup:"), "cleanup")
        .when(text.startswith("[PASS]") | text.startswith("[FAIL]"), "verdict")
        .when(text.startswith("Reduced stack"), "reduce")
    )

    def number(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group).try_cast("int")

    def per_kind(**columns: Column) -> Column:
        out = F.lit(None).cast("int")
        for name, value in columns.items():
            out = F.when(F.col("kind") == name, value).otherwise(out)
        return out

    df = lines.select("trace_id", "line_no", "text", kind.alias("kind")).filter(F.col("kind").isNotNull())
    token = F.try_element_at(F.split(text, r"\s+"), F.lit(5))
    return df.select(
        "trace_id",
        "line_no",
        "kind",
        F.when(F.col("kind") == "next_token", token).alias("token"),
        per_kind(
            split=number(SPLIT, 1), die=number(DIES, 1), rename=number(RENAME, 2), reduce=number(REDUCED, 1)
        ).alias("stack"),
        per_kind(split=number(SPLIT, 2), rename=number(RENAME, 1)).alias("parent"),
        per_kind(reduce=number(REDUCED, 2)).alias("rule"),
        per_kind(reduce=number(REDUCED, 3)).alias("rule_line"),
    )


def split_tokens(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """Splits with the lookahead token current at their line (null before the first)."""
    relevant = events.filter(F.col("kind").isin("next_token", "split"))
    token = F.when(F.col("kind") == "next_token", F.coalesce("token", F.lit("")))
    df = carry_last(
        relevant, ["trace_id"], "line_no", token, "current", where=F.col("kind") == "split", block=block
    )
    return df.select("trace_id", "line_no", "stack", F.nullif("current", F.lit("")).alias("token"))


def split_parent_rule(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """Splits with the latest reduction on their parent stack."""
    is_split = F.col("kind") == "split"
    relevant = events.filter(
        (is_split | (F.col("kind") == "reduce")) & F.col("stack").isNotNull()
    ).withColumn("stack_key", F.when(is_split, F.col("parent")).otherwise(F.col("stack")))
    reduction = F.when(F.col("kind") == "reduce", F.struct("rule", "rule_line"))
    df = carry_last(
        relevant.select("trace_id", "stack_key", "line_no", "kind", "stack", "rule", "rule_line"),
        ["trace_id", "stack_key"], "line_no", reduction, "last", where=is_split, block=block,
    )
    return df.select(
        "trace_id", "line_no", "stack", F.col("stack_key").alias("parent"),
        F.col("last.rule").alias("rule"), F.col("last.rule_line").alias("rule_line"),
    )


def splits_by_token(events: DataFrame, block: int = BLOCK) -> DataFrame:
    return (
        split_tokens(events, block).filter(F.col("token").isNotNull())
        .groupBy("trace_id", "token").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"))
    )


def splits_by_rule(events: DataFrame, block: int = BLOCK) -> DataFrame:
    return (
        split_parent_rule(events, block).filter(F.col("rule").isNotNull())
        .groupBy("trace_id", "rule", "rule_line")
        .agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"))
    )


def _top(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent per trace, ties first seen; the window sees one row per distinct value."""
    place = F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc("n"), "first_line"))
    return counts.withColumn("rank", place).filter(F.col("rank") <= k)


def topk_split_tokens(events: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    return _top(splits_by_token(events, block), k)


def topk_split_rules(events: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    return _top(splits_by_rule(events, block), k)


def trace_max_stack(events: DataFrame) -> DataFrame:
    """Largest stack number split off per trace, 0 without splits."""
    split = F.when(F.col("kind") == "split", F.col("stack"))
    return events.groupBy("trace_id").agg(F.coalesce(F.max(split), F.lit(0)).alias("max_stack"))


def trace_report(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per trace: last line, largest stack, peak of live stacks, splits, and the token and rule with most of them."""
    kind = F.col("kind")
    own = events.filter(kind.isin("next_token", "reduce", "die", "rename", "split"))
    split = F.when(kind == "split", F.col("stack"))
    facts = own.groupBy("trace_id").agg(F.max("line_no").alias("last_line"), F.coalesce(F.max(split), F.lit(0)).alias("max_stack"))
    read = own.filter((kind != "split") | F.col("stack").isNotNull())
    most = F.struct("n", -F.col("first_line"))
    tokens = splits_by_token(read, block).groupBy("trace_id").agg(F.sum("n").alias("n_splits"), F.max_by("token", most).alias("top_token"))
    rules = splits_by_rule(read, block).groupBy("trace_id").agg(
        F.max_by(F.concat_ws("@", F.col("rule").cast("string"), F.col("rule_line").cast("string")), most).alias("top_rule"))
    peaks = trace_peak_alive(own, clears=False, block=block)
    return facts.join(peaks, "trace_id").join(tokens, "trace_id", "left").join(rules, "trace_id", "left").select(
        "trace_id", "last_line", "max_stack", "peak_alive", F.coalesce("n_splits", F.lit(0)).alias("n_splits"), "top_token", "top_rule")


def trace_compare(events: DataFrame, a: int, b: int, block: int = BLOCK) -> DataFrame:
    """Two traces side by side: splits per token and per rule, largest stack and peak of live stacks (``measure, name, n_a, n_b, delta``)."""
    own = events.filter(F.col("trace_id").isin(a, b))
    rule = F.concat_ws("@", F.col("rule").cast("string"), F.col("rule_line").cast("string"))
    none = F.lit(None).cast("string")
    rows = splits_by_token(own, block).select("trace_id", F.lit("token").alias("measure"), F.col("token").alias("name"), "n")
    rows = rows.unionByName(splits_by_rule(own, block).select("trace_id", F.lit("rule").alias("measure"), rule.alias("name"), "n"))
    rows = rows.unionByName(trace_max_stack(own).select("trace_id", F.lit("max_stack").alias("measure"), none.alias("name"), F.col("max_stack").cast("long").alias("n")))
    rows = rows.unionByName(trace_peak_alive(own, block=block).select("trace_id", F.lit("peak_alive").alias("measure"), none.alias("name"), F.col("peak_alive").cast("long").alias("n")))

    def of(trace: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("trace_id") == trace, F.col("n"))), F.lit(0))

    both = rows.groupBy("measure", "name").agg(of(a).alias("n_a"), of(b).alias("n_b"))
    return both.withColumn("delta", F.col("n_b") - F.col("n_a"))


# --- live stacks ----------------------------------------------------------------------------------
# The live set starts as {0}; a split adds, a death removes, a rename moves a live stack, a clearing
# event empties it.  What a run of events does to the set does not need the set itself: whether a stack
# is live afterwards is a constant or depends on whether some stacks were live before.  So blocks are
# summarized alone, the small summaries are chained, and each block is then replayed from its true set.
# A task streams through many sorted blocks; a block costs no call of its own and is never held.

_SUMMARY = "trace_id long, super long, block long, stacks array<int>, after array<array<int>>, clears boolean"
_ENTRY = "trace_id long, super long, block long, live array<int>"
_STATE_EVENTS = ["split", "die", "rename", "cleanup", "verdict"]
_SPLIT, _DIE, _RENAME, _CLEAR, _ENTER = range(5)
#: Blocks per superblock.
FAN_OUT = 1024

#: Per touched stack the stacks of which one must have been live before; None: live for sure.
_Effect = dict[int, frozenset | None]
_NONE: frozenset = frozenset()


def _events(effect: _Effect, clears: bool, rows: Iterator[tuple[int, int, int]]) -> bool:
    """Adds events to the effect in place; returns whether the set was cleared."""
    for op, stack, parent in rows:
        if op == _SPLIT:
            effect[stack] = None
        elif op == _DIE:
            effect[stack] = _NONE
        elif op == _RENAME:
            moved = effect[parent] if parent in effect else _NONE if clears else frozenset([parent])
            effect[parent] = _NONE
            there = effect[stack] if stack in effect else _NONE if clears else frozenset([stack])
            effect[stack] = None if moved is None or there is None else there | moved
        else:
            effect.clear()
            clears = True
    return clears


def _then(effect: _Effect, clears: bool, stacks: list[int], after: list[list[int] | None], cleared: bool) -> tuple[_Effect, bool]:
    """The effect followed by the one of a summary."""
    new: _Effect = {}
    for s, wanted in zip(stacks, after, strict=True):
        before = None if wanted is None else [effect[a] if a in effect else _NONE if clears else frozenset([a]) for a in wanted]
        new[s] = None if before is None or None in before else _NONE.union(*before)
    return (new if cleared else effect | new), clears or cleared


def _apply(live: set[int], stacks: list[int], after: list[list[int] | None], clears: bool) -> set[int]:
    kept = set() if clears else live.difference(stacks)
    return kept.union(s for s, wanted in zip(stacks, after, strict=True) if wanted is None or not live.isdisjoint(wanted))


def _segments(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch, int, int]]:
    """Runs of rows equal in the first columns, as key, batch and range; a run may go on in the next batch."""
    for batch in batches:
        if batch.num_rows:
            columns = [batch.column(i).to_numpy() for i in range(keys)]
            cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1
            for low, high in pairwise([0, *cuts.tolist(), batch.num_rows]):
                yield tuple(int(c[low]) for c in columns), batch, low, high


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _plain(effect: _Effect) -> tuple[list[int], list[list[int] | None]]:
    return list(effect), [None if a is None else sorted(a) for a in effect.values()]


def _summaries_of_events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``trace_id, super, block, op, stack, parent`` in order -> a summary per block."""
    effect, clears, now, at, lists = {}, False, None, None, ()
    for key, batch, low, high in _segments(batches, 3):
        if key != now:
            if now is not None:
                yield (*now, *_plain(effect), clears)
            effect, clears, now = {}, False, key
        if batch is not at:
            at, lists = batch, [batch.column(i).to_pylist() for i in (3, 4, 5)]
        clears = _events(effect, clears, zip(*[x[low:high] for x in lists], strict=True))
    if now is not None:
        yield (*now, *_plain(effect), clears)


def _summaries_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Summaries of blocks in order -> a summary per superblock."""
    effect, clears, now = {}, False, None
    for key, batch, low, high in _segments(batches, 2):
        if key != now:
            if now is not None:
                yield (*now, None, *_plain(effect), clears)
            effect, clears, now = {}, False, key
        for row in zip(*[batch.column(i).slice(low, high - low).to_pylist() for i in (3, 4, 5)], strict=True):
            effect, clears = _then(effect, clears, *row)
    if now is not None:
        yield (*now, None, *_plain(effect), clears)


def _walk_supers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Summaries of superblocks in order -> the live set before each."""
    live, now = {0}, None
    for key, batch, low, high in _segments(batches, 1):
        if key != now:
            live, now = {0}, key
        for number, *summary in zip(*[batch.column(i).slice(low, high - low).to_pylist() for i in (1, 3, 4, 5)], strict=True):
            yield (*key, number, None, sorted(live))
            live = _apply(live, *summary)


def _walk_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Summaries of blocks in order, each with the live set before its superblock -> the live set before each block."""
    live, now = set(), None
    for key, batch, low, high in _segments(batches, 2):
        if key != now:
            live, now = set(batch.column(6)[low].as_py()), key
        for block, *summary in zip(*[batch.column(i).slice(low, high - low).to_pylist() for i in range(2, 6)], strict=True):
            yield (*key, block, sorted(live))
            live = _apply(live, *summary)


def _peaks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``trace_id, op, stack, parent, live`` in order, the live set before each block -> a peak per trace."""
    live, peak, now, at, lists = set(), 0, None, None, ()
    for key, batch, low, high in _segments(batches, 1):
        if key != now:
            if now is not None:
                yield (*now, peak)
            peak, now = 0, key
        if batch is not at:
            at, lists = batch, [batch.column(i).to_pylist() for i in (1, 2, 3)]
        for i, (op, stack, parent) in enumerate(zip(*[x[low:high] for x in lists], strict=True), low):
            if op == _SPLIT:
                live.add(stack)
                peak = max(peak, len(live))
            elif op == _DIE:
                live.discard(stack)
            elif op == _RENAME:
                if parent in live:
                    live.discard(parent)
                    live.add(stack)
            elif op == _CLEAR:
                live.clear()
            else:
                live = set(batch.column(4)[i].as_py())
    if now is not None:
        yield (*now, peak)


def _stream(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], ddl: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return df.mapInArrow(lambda batches: _batches(fn(batches), schema), ddl)


def trace_peak_alive(
    events: DataFrame, *, clears: bool = True, block: int = BLOCK, fan_out: int = FAN_OUT
) -> DataFrame:
    """Peak number of live stacks per trace, at least 1.

    ``clears=False`` ignores clean-up and verdict lines, as the line-by-line analyzer does. Tasks take whole blocks, in
    order, and keep the live set or the effect on it of one block at a time. Events without a line number do not count.
    """
    ship(events.sparkSession)
    wanted = _STATE_EVENTS if clears else _STATE_EVENTS[:3]
    complete = F.col("stack").isNotNull() & (F.col("parent").isNotNull() | (F.col("kind") == "die"))
    kind = F.col("kind")
    op = F.when(kind == "split", _SPLIT).when(kind == "die", _DIE).when(kind == "rename", _RENAME).otherwise(_CLEAR)
    state = events.filter(
        kind.isin(wanted) & (complete | kind.isin("cleanup", "verdict")) & F.col("trace_id").isNotNull() & F.col("line_no").isNotNull()
    ).select(
        F.col("trace_id").cast("long").alias("trace_id"),
        block_number("line_no", block).alias("block"),
        "line_no", op.alias("op"), "stack", "parent",
    )
    number = F.floor(F.col("block") / fan_out).cast("long").alias("super")
    ordered = state.repartition("trace_id", "block").sortWithinPartitions("trace_id", "block", "line_no")
    summaries = _stream(ordered.select("trace_id", number, "block", "op", "stack", "parent"), _summaries_of_events, _SUMMARY)
    chains = summaries.repartition("trace_id", "super")
    in_order = ["trace_id", "super", "block"]
    supers = _stream(chains.sortWithinPartitions(*in_order), _summaries_of_blocks, _SUMMARY)
    super_entry = _stream(supers.repartition("trace_id").sortWithinPartitions("trace_id", "super"), _walk_supers, _ENTRY)
    # a left join, so that nothing is filtered below it and the exchange of the summaries serves twice
    walked = chains.join(super_entry.drop("block"), ["trace_id", "super"], "left").sortWithinPartitions(*in_order)
    block_entry = _stream(walked, _walk_blocks, _ENTRY).select("trace_id", "block", F.lit(_ENTER).alias("op"), "live")
    # the set comes first in its block: it has no line number
    replayed = state.unionByName(block_entry, allowMissingColumns=True).repartition("trace_id", "block").sortWithinPartitions(
        "trace_id", "block", F.asc_nulls_first("line_no"))
    peaks = _stream(replayed.select("trace_id", "op", "stack", "parent", "live"), _peaks, "trace_id long, peak int")
    found = peaks.groupBy("trace_id").agg(F.max("peak").alias("peak"))
    # with the line number this reads the lines as the passes above do; without it the kinds are tested on the scan, four times as slow
    every = events.groupBy("trace_id").agg(F.max("line_no").alias("last_line"))
    peak = F.when(F.col("last_line").isNotNull(), F.greatest(F.lit(1), F.coalesce("peak", F.lit(1)))).otherwise(F.lit(1))
    return every.join(found, "trace_id", "left").select("trace_id", peak.alias("peak_alive"))
