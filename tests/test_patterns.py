"""Destructuring, rows written by hand."""

import pytest

from lexframe.operators import patterns as N
from lexframe.operators import tokens as K

SCRIPTS = [
    "function f({ a, b: { c = 1, ...d } = {} }, [e, , g = 2] = [], ...rest) {}\n",
    "const h = ({ r }, [s, { t: [u] }]) => r;\n",
    "const { a: { b }, c = { x: 1 }, [k]: v, 'q w': w, ...d } = o, [y] = z;\n",
    "[a, b] = [b, a];\n({ p: obj.x, q: [m[0], this.n] } = load(...args));\nx[0] = { not: [1, 2] };\n",
    "try {} catch ({ message, info: [first] }) {}\nfor (const [k, { v }] of m) {}\nfor ({ z } of list) {}\n",
    "class A { set p({ q = [1] }) {} m([i]) {} }\nconst lit = { a: { b: [c] }, d };\ncall({ n: 1 }, [o]);\n",
    "let [[[deep]], { a: { b: { c: { d: leaf = () => { const { own } = deep; } } } } }] = q;\n",
]
BINDINGS = [
    (0, "a", "parameter", ".a", False, False, True), (0, "c", "parameter", ".b.c", True, False, True), (0, "d", "parameter", ".b...", False, True, False),
    (0, "e", "parameter", "[0]", False, False, False), (0, "g", "parameter", "[2]", True, False, False),
    (1, "r", "arrow_parameter", ".r", False, False, True), (1, "s", "arrow_parameter", "[0]", False, False, False),
    (1, "u", "arrow_parameter", "[1].t[0]", False, False, False),
    (2, "b", "declaration", ".a.b", False, False, True), (2, "c", "declaration", ".c", True, False, True), (2, "v", "declaration", "[*]", False, False, False),
    (2, "w", "declaration", ".'q w'", False, False, False), (2, "d", "declaration", "...", False, True, False), (2, "y", "declaration", "[0]", False, False, False),
    (3, "a", "assignment", "[0]", False, False, False), (3, "b", "assignment", "[1]", False, False, False), (3, "obj", "assignment", ".p", False, False, False),
    (3, "m", "assignment", ".q[0]", False, False, False), (3, "this", "assignment", ".q[1]", False, False, False),
    (4, "message", "catch", ".message", False, False, True), (4, "first", "catch", ".info[0]", False, False, False),
    (4, "k", "declaration", "[0]", False, False, False), (4, "v", "declaration", "[1].v", False, False, True), (4, "z", "loop", ".z", False, False, True),
    (5, "q", "parameter", ".q", True, False, True), (5, "i", "parameter", "[0]", False, False, False),
    (6, "deep", "declaration", "[0][0][0]", False, False, False), (6, "leaf", "declaration", "[1].a.b.c.d", True, False, False),
    (6, "own", "declaration", ".own", False, False, True),
]
#: script, shape, position, nesting, path, has_default, names, defaults, holes, computed_keys
PATTERNS = [
    (0, "object", "parameter", 0, "", False, 1, 1, 0, 0), (0, "object", "parameter", 1, ".b", True, 2, 1, 0, 0), (0, "array", "parameter", 0, "", True, 2, 1, 1, 0),
    (0, "element", "rest", None, None, None, 0, 0, 0, 0), (0, "element", "rest", None, None, None, 0, 0, 0, 0),
    (2, "object", "declaration", 0, "", True, 4, 1, 0, 1), (2, "object", "declaration", 1, ".a", False, 1, 0, 0, 0),
    (2, "array", "declaration", 0, "", True, 1, 0, 0, 0), (2, "element", "rest", None, None, None, 0, 0, 0, 0),
    (3, "array", "assignment", 0, "", True, 2, 0, 0, 0), (3, "object", "assignment", 0, "", True, 0, 0, 0, 0), (3, "array", "assignment", 1, ".q", False, 0, 0, 0, 0),
    (3, "element", "spread", None, None, None, 0, 0, 0, 0),
]


@pytest.fixture(scope="module")
def tokens(spark):
    rows = [(str(i), f"t/{i}.js", s) for i, s in enumerate(SCRIPTS)]
    return K.tokenize(spark.createDataFrame(rows, "script_id string, path string, src string")).cache()


def test_bindings(tokens):
    got = [(int(r.script_id), r.name, r.position, r.path, r.has_default, r.is_rest, r.shorthand) for r in N.pattern_bindings(tokens).collect()]
    assert sorted(got) == sorted(BINDINGS)


def test_members_are_no_names(tokens):
    got = {(r.script_id, r.name) for r in N.pattern_bindings(tokens).filter("target = 'member'").collect()}
    assert got == {("3", "obj"), ("3", "m"), ("3", "this")}


def test_patterns(tokens):
    columns = "shape position nesting path has_default names defaults holes computed_keys".split()
    got = [(int(r.script_id), *r[1:]) for r in N.patterns(tokens).filter("script_id in ('0', '2', '3')").select("script_id", *columns).collect()]
    assert sorted(got, key=repr) == sorted(PATTERNS, key=repr)


def test_plan_adds_no_exchange(spark, scripts_of):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = N.patterns(K.tokenize(scripts_of("let {a} = b;")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == len([x for x in plan.splitlines() if "REPARTITION_BY_NUM" in x])
