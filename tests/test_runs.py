"""Mergeable trace summaries against a line-by-line replay, and the stream that keeps them as state."""

import random

import pytest

from lexframe.operators import traces as T
from lexframe.operators.runs import Run, merged, summarize
from tests.test_logs_traces import SCHEMA, _replay, _trace


def _events(spark, lines):
    rows = [(0, n, t) for n, t in enumerate(lines)]
    found = T.read_trace(spark.createDataFrame(rows, SCHEMA)).filter("kind not in ('cleanup', 'verdict')").collect()
    return {r.line_no: (r.kind, r.token, r.stack, r.parent, r.rule, r.rule_line) for r in found}


@pytest.mark.parametrize("seed", range(4))
def test_any_grouping_equals_replay(spark, seed):
    lines = _trace(seed, 300)
    events = _events(spark, lines)
    peak, tokens, rules = _replay(lines, clears=False)
    for size in (1, 3, 20, 1000):
        parts = [{n: e for n, e in events.items() if n // size == k} for k in range(len(lines) // size + 1)]
        runs = [summarize(p) for p in parts]
        # neighbours first, then the whole, through text
        pairs = [merged([r.dump() for r in runs[i:i + 2]]) for i in range(0, len(runs), 2)]
        run = merged([p.dump() for p in pairs])
        assert max(1, run.peak({0})) == peak
        assert {k: n for k, (n, _) in run.tokens.items()} == tokens
        assert {k: n for k, (n, _) in run.rules.items()} == rules
        assert Run.load(run.dump()).dump() == run.dump()


def test_peak_holds_for_every_start(spark):
    rnd = random.Random(5)
    for _ in range(60):
        events = {}
        for n in range(rnd.randrange(1, 25)):
            kind = rnd.choice(["split", "die", "rename"])
            events[n] = (kind, None, rnd.randrange(6), rnd.randrange(6), None, None)
        cut = rnd.randrange(25)
        run = summarize({n: e for n, e in events.items() if n < cut}).then(summarize({n: e for n, e in events.items() if n >= cut}))
        for mask in range(64):
            live = {s for s in range(6) if mask >> s & 1}
            want, now = 0, set(live)
            for kind, _, stack, parent, _, _ in events.values():
                if kind == "split":
                    now.add(stack)
                    want = max(want, len(now))
                elif kind == "die":
                    now.discard(stack)
                elif parent in now:
                    now.discard(parent)
                    now.add(stack)
            assert run.peak(live) == want


def test_state_carries_over(spark, tmp_path):
    """A second call sees new lines only: the files of the first are gone by then. Late lines land in blocks of the first call."""
    import pathlib

    from lexframe.streaming import jobs as J

    rows = [(i, 3 * n, t) for i in range(2) for n, t in enumerate(_trace(i))]
    random.Random(1).shuffle(rows)
    inbox, state = tmp_path / "in", str(tmp_path / "state")

    def arrive(part):
        spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(str(inbox))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(inbox))
        return sorted(spark.read.parquet(J.stream_trace(stream, state_dir=state, block=200, page=30)).collect())

    def expected(part):
        return sorted(T.trace_report(T.read_trace(spark.createDataFrame(part, SCHEMA))).collect())

    assert arrive(rows[:500]) == expected(rows[:500])
    for old in pathlib.Path(inbox).glob("*.parquet"):
        old.unlink()
    assert arrive(rows[500:]) == expected(rows)
    newest = spark.read.parquet(f"{state}/data").groupBy("batch").count().collect()
    assert len(newest) >= 4


def test_only_touched_blocks_are_written(spark, tmp_path):
    from lexframe.streaming import jobs as J

    inbox, state = str(tmp_path / "in"), str(tmp_path / "state")
    for part in ([(0, n, t) for n, t in enumerate(_trace(3))], [(0, 250, "Stack 1 dies.")]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
        J.stream_trace(spark.readStream.schema(SCHEMA).parquet(inbox), state_dir=state, block=100, page=10)
    blocks = {(r.batch, r.block) for r in spark.read.parquet(f"{state}/data").select("batch", "block").collect()}
    assert blocks == {(0, 0), (0, 1), (0, 2), (0, 3), (1, 2)}
