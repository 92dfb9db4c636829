from lexframe.operators import rules as R
from lexframe.operators import structure as S
from lexframe.operators import tokens as K
from lexframe.sources import snippets as N


def test_bracket_match_and_roles(spark, scripts_of):
    tokens = K.tokenize(scripts_of("if (f(a)) { x = (b) => [1]; } )"))
    match = {r.pos: (r.kind, r.partner_pos) for r in S.bracket_match(tokens).collect()}
    assert match[1] == ("(", 6) and match[3] == ("(", 5)
    assert all(match[p][1] is None or match[match[p][1]][1] == p for p in match)
    assert [p for p in match if match[p][1] is None] == [max(match)]
    roles = {r.pos: r.paren_role for r in S.paren_role(tokens).collect()}
    assert (roles[1], roles[3], roles[10]) == ("control", "other", "arrow")


def test_brace_kinds(spark, scripts_of):
    tokens = K.tokenize(scripts_of("var o = {a: {b: {}}}\n{ c: { d } }", "function f() {} x = y ? {} : {}", "l: { m: {} }"))
    kinds: dict = {}
    for r in S.brace_kind(tokens).orderBy("script_id", "pos").collect():
        kinds.setdefault(r.script_id, []).append(r.brace_kind)
    assert kinds["000"] == ["object"] * 3 + ["block"] * 2
    assert kinds["001"] == ["function", "object", "object"]
    assert kinds["002"] == ["block", "block"]


def test_ternary(spark, scripts_of):
    df = S.conditionals(S.brackets(S.neighbours(K.tokenize(scripts_of("a ? b ? c : d : { k: 1 }; l: x")))))
    assert {(r.question_pos, r.colon_pos) for r in S.ternary_match(df).collect()} == {(1, 7), (3, 5)}


def test_semicolons(spark, scripts_of):
    sources = ["a\nb", "return\nx", "a\n, b", "a\n&& b", "do { n-- } while (n)\nx", "f()\n(function () {})()", "x = {a: 1\n}"]
    rows = S.asi_points(K.tokenize(scripts_of(*sources))).collect()
    at = {(r.script_id, r.kind): (r.asi_reference, r.asi_standard) for r in rows}
    assert at["000", "IDENTIFIER"] == ("newline", "newline")
    assert at["001", "IDENTIFIER"] == ("restricted", "restricted")
    assert at["002", ","] == ("newline", None)
    assert at["003", "&&"] == ("newline", None)
    assert at["004", "IDENTIFIER"] == (None, "do_while")
    assert at["005", "("] == ("function_paren", "function_paren")
    assert ("006", "}") not in at


REJECTED = {
    "for (var i = 0 i < 5; i++) {}": "adjacency",
    "for (var i = 0; i < 3; i++ { }": "bracket_unmatched",
    "var o = { name \"x\" };": "adjacency",
    "if (true) {\n  var v = 1;\n": "bracket_unmatched",
    "const b = (v)\n=> v;": "newline_arrow",
    "const i = (...rest, last) => rest;": "rest_last",
    "const t = `value ${}`;": "adjacency",
    "for (const v = 0 of s) { v; }": "adjacency",
    "function* g() {\n  yield\n  1;\n}": "newline_yield",
    "class A { get x(v) {} }": "getter_arity",
    "class A { set x() {} }": "setter_arity",
    "class A { static constructor() {} }": "static_constructor",
    "class A { odd x() {} }": "class_prefix",
    "import { a } form 'x';": "expected_from",
    "f((1 + 2];": "bracket_crossing",
}


def test_rejected(spark, scripts_of):
    found: dict = {}
    for r in R.all_diagnostics(K.tokenize(scripts_of(*REJECTED))).collect():
        found.setdefault(r.script_id, set()).add(r.rule)
    for i, (source, rule) in enumerate(REJECTED.items()):
        assert rule in found.get(f"{i:03d}", set()), source


def test_no_false_alarm(spark, scripts_of):
    filled = [s for s in N.ALL]
    for i, mark in enumerate(N.PLACEHOLDERS):
        filled = [s.replace("@" + mark, str(i + 1)) for s in filled]
    scripts = scripts_of(*filled)
    verdicts = R.script_verdict(scripts, R.all_diagnostics(K.tokenize(scripts))).collect()
    failed = {int(v.script_id) for v in verdicts if v.verdict == "FAIL"}
    assert failed == set(range(len(N.VALID), N.COUNT))
