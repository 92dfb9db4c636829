"""Operators that work on whole scripts in one pass: one sort of the token rows, the same rows wherever batches end."""

import numpy as np
import pyarrow as pa
import pytest

from lexframe.functions.vectors import Rows, V, case
from lexframe.operators import nodes as N
from lexframe.operators import passes
from lexframe.operators import patterns as B
from lexframe.operators import rules as R
from lexframe.operators import structure as S
from lexframe.operators import tokens as K

OPERATORS = {
    "bracket_match": S.bracket_match, "brace_kind": S.brace_kind, "methods": N.methods, "var_decls": N.var_decls, "patterns": B.patterns,
    "pattern_bindings": B.pattern_bindings, "generators_async": N.generators_async, "imports": N.imports, "exports": N.exports,
    "rule_clause": R.clause_rows, "rule_class_prefix": lambda tokens: R.rule_rows(tokens, ["class_prefix"]), "adjacency_errors": R.adjacency_errors,
    "all_diagnostics": R.all_diagnostics, "diagnosed": R.diagnosed,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_sort(spark, scripts_of, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = OPERATORS[name](K.tokenize(scripts_of("a")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Sort [") == 1 and plan.count("Exchange") == 1


def test_scripts_stay_whole():
    sizes = [3, passes.BATCH - 2, 5, passes.BATCH * 2, 1, 7]
    script = np.repeat(np.arange(len(sizes)), sizes)
    first = np.diff(script, prepend=-1) > 0
    rows = pa.record_batch({"script": script, "_first": first})
    batches = [rows.slice(i, 10_000) for i in range(0, len(script), 10_000)]
    tables = list(passes._whole_scripts(iter([rows.slice(0, 0), *batches])))
    assert np.array_equal(np.concatenate([t["script"].to_numpy() for t in tables]), script)
    assert all(t["_first"][0].as_py() for t in tables) and len(tables) > 2
    assert list(passes._whole_scripts(iter([]))) == []


def test_nulls_as_in_sql():
    def three(c):
        return [None if c.ok is not None and not ok else bool(v) for v, ok in zip(c.v, c.there().v)]

    a = V(np.repeat([True, False, False], 3), np.repeat([True, True, False], 3))
    b = V(np.tile([True, False, False], 3), np.tile([True, True, False], 3))
    assert three(a & b) == [True, False, None, False, False, False, None, False, None]
    assert three(a | b) == [True, True, True, True, False, None, True, None, None]
    assert three(~b) == [False, True, None] * 3
    assert three(case((a, b), other=False)) == [True, False, None] + [False] * 6


def test_windows_against_loops():
    """Groups, positions that come twice and nulls; a window up to the current row takes all rows of its position."""
    rng = np.random.default_rng(3)
    script, pos, key = np.sort(rng.integers(0, 9, 400)), np.zeros(400, int), rng.integers(-2, 4, 400)
    for s in range(9):
        pos[script == s] = np.sort(rng.integers(0, 30, (script == s).sum()))
    x, test = V(rng.integers(-50, 50, 400), rng.random(400) < 0.7), V(rng.random(400) < 0.3)
    rows = Rows(script, pos)
    for w, same in ((rows.by_pos, np.zeros(400, int)), (rows.window(key), key)):
        got = {n: f for n, f in (
            ("last", w.last(test)), ("before", w.last(test, own=False)), ("next", w.next(test)), ("max", w.max(x)), ("min", w.min(x)),
            ("max_before", w.max(x, own=False)), ("lag", w.before(2)), ("lead", w.behind(3)))}
        sums, behind = w.sum(x.v), w.sum_behind(x.v)
        for i in range(400):
            group = [j for j in range(400) if script[j] == script[i] and same[j] == same[i]]
            to = [j for j in group if pos[j] <= pos[i]]
            # from behind, rows of one position keep their order
            ahead = [j for j in group if j < i]
            after = sorted((j for j in group if (-pos[j], j) < (-pos[i], i)), key=lambda j: (pos[j], -j))

            behind_ = [j for j in group if j > i]

            def extreme(f, some):
                return f([x.v[j] for j in some if x.ok[j]], default=None)

            want = {
                "last": max([j for j in to if test.v[j]], default=None), "before": max([j for j in ahead if test.v[j]], default=None),
                "next": next((j for j in after if test.v[j]), None), "max": extreme(max, to), "min": extreme(min, to),
                "max_before": extreme(max, ahead), "lag": ahead[-2] if len(ahead) > 1 else None, "lead": behind_[2] if len(behind_) > 2 else None,
            }
            assert {n: v.v[i] if v.there().v[i] else None for n, v in got.items()} == want
            assert sums[i] == x.v[to].sum() and behind[i] == x.v[after].sum()


def test_script_that_comes_twice(spark, scripts_of):
    """Its rows share their windows, rows of one position in the order that a sort leaves them in."""
    once = scripts_of('import "./a.js";', "for (let [p, , q = 1] of pairs) use(p);")
    tokens = K.tokenize(once.union(once))
    assert [(r.pos, r.source) for r in N.imports(tokens).collect()] == [(0, None)]
    assert B.patterns(tokens).filter("position = 'declaration'").count() == 0


def test_counts_and_places_as_of_the_rows(spark, scripts_of):
    twice = scripts_of(*[""] * 4, '1 "aaaaaaaaaa\nb"', "a b\n) c").filter("script_id > '003'")
    tokens = K.tokenize(scripts_of("a b\n) c", "x = 1;", "(\n\n` 1 2", "\n  @ @").union(twice).union(twice))
    rows = R.all_diagnostics(tokens).collect()
    want = {i: (sum(r.script_id == i for r in rows), *min((r.line, r.col) for r in rows if r.script_id == i)) for i in {r.script_id for r in rows}}
    assert {r.script_id: (r.error_count, r.first.line, r.first.col) for r in R.diagnosed(tokens).collect()} == want
    assert set(want) == {"000", "002", "003", "004", "005"} and any(r.col < 1 for r in rows)
