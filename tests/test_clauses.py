"""Clauses that lack a part fail; whole ones of every kind pass."""

import re

import pytest

from lexframe.operators import rules as R
from lexframe.operators import tokens as K
from lexframe.sources import snippets

BROKEN = {
    "while () x": "empty_header", "if () x": "empty_header", "switch () { }": "empty_header", "if (a; b) x": "empty_header", "for (;) x": "for_header",
    "for (a; b) x": "for_header", "for (a) x": "for_header", "for (;;;) x": "for_header", "try { }": "try_alone", "do x;": "do_alone",
    "f(() => { do x; });": "do_alone", "a ? b;": "ternary_open", "switch (a) { b }": "switch_body", "f(a,,b)": "list_comma", "f(,a)": "list_comma",
    "x = {a:1,,b:2}": "list_comma", "function () {}": "unnamed", "function* () {}": "unnamed", "class { }": "unnamed", "a; class extends B { }": "unnamed",
}
WHOLE = [
    "while (a) x;", "for (;;) x;", "for (a; b; c) x;", "for (k in o) x;", "for (const [of] of of) x;", "for (;;) { for (a of b) ; }", "try { } catch (e) { }",
    "try { } finally { }", "do x; while (a);", "do { while (a) b; } while (c)", "do if (a) b; else c; while (d)", "a ? b : c ? d : e;", "x = { a: b ? c : d };",
    "switch (a) { }", "switch (a) { default: b }", "f(a, b)", "x = {a: 1, b: 2,}", "[, a, , b]", "(function () {})", "export default function () {}",
    "export default class { }", "x = class { };", "x = function* () {}", "class A { function() {} do() {} while() {} }", "x = { function() {}, do: 1, while: 2 }",
    "o.do(1); o.while(2); o.class = 3;", "export default async function () {}",
]


@pytest.fixture(scope="module")
def found(spark, scripts_of):
    rows = R.clause_rows(K.tokenize(scripts_of(*BROKEN, *WHOLE))).collect()
    return [{r.rule for r in rows if int(r.script_id) == i} for i in range(len(BROKEN) + len(WHOLE))]


def test_broken_clauses_fail(found):
    assert dict(zip(BROKEN, found)) == {t: {r} for t, r in BROKEN.items()}


def test_whole_clauses_pass(found):
    assert {t: f for t, f in zip(WHOLE, found[len(BROKEN):]) if f} == {}


def test_valid_snippets_pass(spark, scripts_of):
    texts = [re.sub("@[A-Z]", "9", re.sub("@[EF]", ".js", s)) for s in snippets.VALID]
    verdicts = R.script_verdict(scripts_of(*texts), R.all_diagnostics(K.tokenize(scripts_of(*texts)))).filter("verdict <> 'PASS'").collect()
    assert verdicts == []
    broken = scripts_of(*BROKEN)
    assert R.script_verdict(broken, R.all_diagnostics(K.tokenize(broken))).filter("verdict = 'PASS'").count() == 0
