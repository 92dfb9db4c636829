import random

import pytest
from pyspark.sql import functions as F

from lexframe.operators import blocks as B
from lexframe.operators import logs as L
from lexframe.operators import traces as T

SCHEMA = "trace_id long, line_no long, text string"


def _trace(seed: int, n: int = 400) -> list[str]:
    rnd = random.Random(seed)
    made = []
    for _ in range(n):
        a, b = rnd.randrange(8), rnd.randrange(8)
        made.append(rnd.choice([
            f"Next token is token {rnd.choice(['ID', 'NUM', 'STR'])} ()", "Next token is token", f"Splitting off stack {a} from {b}.",
            f"Splitting off stack {a} from {b}.", f"Stack {a} dies.", f"Rename stack {a} -> {b}.",
            f"Reduced stack {a} by rule {b} (line {b * 3}); done", "Entering state 3",
        ] + (["Cleanup: x", "[PASS] y"] if rnd.random() < 0.1 else [])))
    return made


def _replay(lines, clears=True):
    """The same by brute force, one line after the other."""
    live, peak, token, tokens, last, rules = {0}, 1, None, {}, {}, {}
    for line in lines:
        words = line.split()
        if line.startswith("Next token"):
            token = words[4] if len(words) >= 5 else None
        elif line.startswith("Splitting"):
            new, parent = int(words[3]), int(words[5].rstrip("."))
            live.add(new)
            peak = max(peak, len(live))
            if token:
                tokens[token] = tokens.get(token, 0) + 1
            if parent in last:
                rules[last[parent]] = rules.get(last[parent], 0) + 1
        elif line.startswith("Stack"):
            live.discard(int(words[1]))
        elif line.startswith("Rename"):
            old, new = int(words[2]), int(words[4].rstrip("."))
            if old in live:
                live.discard(old)
                live.add(new)
        elif line.startswith("Reduced"):
            last[int(words[2])] = (int(words[5]), int(words[7].rstrip(");")))
        elif clears and line.startswith(("Cleanup", "[PASS]")):
            live.clear()
    return peak, tokens, rules


@pytest.mark.parametrize("block,fan_out", [(7, 3), (50, 2), (1 << 20, 1024)])
def test_traces_against_replay(spark, block, fan_out):
    traces = {i: _trace(i) for i in range(3)}
    rows = [(i, n * 2, t) for i, lines in traces.items() for n, t in enumerate(lines)]
    events = T.read_trace(spark.createDataFrame(rows, SCHEMA).repartition(5))
    peaks = {r.trace_id: r.peak_alive for r in T.trace_peak_alive(events, block=block, fan_out=fan_out).collect()}
    free = {r.trace_id: r.peak_alive for r in T.trace_peak_alive(events, clears=False, block=block, fan_out=fan_out).collect()}
    tokens = {(r.trace_id, r.token): r.n for r in T.splits_by_token(events, block).collect()}
    rules = {(r.trace_id, r.rule, r.rule_line): r.n for r in T.splits_by_rule(events, block).collect()}
    for i, lines in traces.items():
        peak, by_token, by_rule = _replay(lines)
        assert peaks[i] == peak and free[i] == _replay(lines, clears=False)[0]
        assert {k[1]: v for k, v in tokens.items() if k[0] == i} == by_token
        assert {k[1:]: v for k, v in rules.items() if k[0] == i} == by_rule


def test_running_count_in_blocks(spark):
    df = spark.range(0, 1000, 3).select(F.col("id").alias("line_no"))
    rows = B.running_count(df, "line_no", block=64).orderBy("line_no").collect()
    assert [r.running for r in rows] == list(range(1, len(rows) + 1))


LINES = [
    "a/x.js:1:2: syntax error, unexpected end of file", "b/x.js:3:4: memory exhausted", "", "broken line",
    "C:/w.js:5:6: note: nested: text", "a/x.js:7:8: syntax is ambiguous", "c/y.js:9:1: premature end of file",
]


def test_log_reports(spark):
    lines = spark.createDataFrame(list(enumerate(LINES)), "line_no long, text string")
    lazy = {r.line_no: r for r in L.read_error_log(lines).collect()}
    assert lazy[4].path == "C:/w.js" and lazy[3]["_bad"] and 2 not in lazy
    assert L.read_error_log(lines, strict_path=True).filter("line_no = 4").first()["_bad"]
    assert {r.line_no: r.category for r in L.error_messages(lines).collect()} == {
        0: "unexpected", 1: "memory exhausted", 4: "other", 5: "syntax is ambiguous", 6: "end of file",
    }
    assert L.error_messages(lines).filter("line_no = 4").first().message == "note: nested: text"
    files = spark.createDataFrame([("a/x.js", 10), ("b/x.js", 30)], "path string, size long")
    ranked = L.log_sorted_by_size(lines, files, block=2).collect()
    assert [(r["rank"], r.line_no) for r in ranked] == [(1, 1), (2, 5), (3, 0)]
    assert [r.line_no for r in L.log_sorted_by_size(lines, files, ascending=True, block=2).collect()] == [0, 5, 1]
    assert {r.path for r in L.missing_files(lines, files).collect()} == {"C:/w.js", "c/y.js"}
    scripts = files.withColumn("script_id", F.col("path"))
    assert [(r.basename, r.path) for r in L.offending_scripts(lines, scripts).collect()] == [("x.js", "b/x.js")]


def test_stream_equals_batch_however_lines_arrive(spark, tmp_path):
    from lexframe.streaming import jobs as J

    rows = [(i, n, t) for i in range(2) for n, t in enumerate(_trace(i))]
    frame = spark.createDataFrame(rows, SCHEMA)
    frame.repartition(6, "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = spark.read.parquet(J.stream_trace(stream)).collect()
    assert len(got) == 2
    assert sorted(got) == sorted(T.trace_report(T.read_trace(frame)).collect())
    for r in got:
        peak, tokens, rules = _replay(_trace(r.trace_id), clears=False)
        assert (r.peak_alive, r.n_splits) == (peak, sum(tokens.values()))


def test_live_stacks_take_no_call_per_block(spark):
    # a block per event: 6,000 blocks that were 6,000 pandas groups, three times over
    lines = _trace(5, 6000)
    events = T.read_trace(spark.createDataFrame([(1, n * 10, t) for n, t in enumerate(lines)], SCHEMA))
    peaks = T.trace_peak_alive(events, block=10, fan_out=7)
    assert peaks.first().peak_alive == _replay(lines)[0]
    plan = peaks._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and "FlatMapCoGroups" not in plan


def test_events_without_line_or_trace_do_not_count(spark):
    rows = [(1, None, "Splitting off stack 1 from 0."), (1, 5, "Splitting off stack 2 from 0."), (1, 6, "Splitting off stack 3 from 0."), (None, 7, "Splitting off stack 4 from 0.")]
    peaks = T.trace_peak_alive(T.read_trace(spark.createDataFrame(rows, SCHEMA)), block=2)
    assert sorted((r.trace_id or 0, r.peak_alive) for r in peaks.collect()) == [(0, 1), (1, 3)]
