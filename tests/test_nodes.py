"""Rows of the code-structure tables written by hand, so that they do not come from the engine or its SQL."""

import pytest

from lexframe.operators import nodes as N
from lexframe.operators import tokens as K

SCRIPTS = [
    "import d, { a as b } from './m.js';\nimport * as ns from 'lib';\nexport const x = 1;\nexport default function f() {}\nexport { x as y };\n",
    "class A extends B {\n  constructor() {\n    super();\n  }\n  static get k() {\n    return 1;\n  }\n  async *it() {}\n}\n",
    "function* g(a, b = 1) {\n  yield a;\n}\nconst h = async (x) => await x;\nconst one = y => y ** 2;\n",
    "if (a) b.c(1); else for (const k of o) f(k);\nlet q = new Foo(1), r = a.b.c();\n",
    "const t = `x${a}y${b}`;\ntag`z`;\nx += 1;\n!y;\nconst u = `${`${`${1}`}`}`;\n",
    "class A { static async *delete() {} set if(v) {} }\nconst o = { async for(x) {}, async catch() {} };\n",
    "new X;\nnew a.b.C;\nnew D();\n",
]
EXPECTED = {
    "imports": ("local imported is_namespace is_default source", [
        (0, "d", "default", False, True, "./m.js"), (0, "b", "a", False, False, "./m.js"), (0, "ns", None, True, False, "lib")]),
    "exports": ("local exported is_default declaration", [
        (0, "x", "x", False, "const"), (0, "f", "default", True, "function"), (0, "x", "y", False, None)]),
    "var_decls": ("decl_kind name has_initializer", [
        (0, "const", "x", True), (2, "const", "h", True), (2, "const", "one", True), (3, "const", "k", False), (3, "let", "q", True),
        (3, "let", "r", True), (4, "const", "t", True), (4, "const", "u", True), (5, "const", "o", True)]),
    "functions": ("form name generator is_async param_count", [(0, "declaration", "f", False, False, 0), (2, "declaration", "g", True, False, 2)]),
    "arrows": ("is_async expression_body param_count single_identifier", [(2, True, True, 1, False), (2, False, True, 1, True)]),
    "classes": ("form name has_superclass member_count", [(1, "declaration", "A", True, 3), (5, "declaration", "A", False, 2)]),
    "methods": ("owner name is_static generator is_async method_kind param_count", [
        (1, "class", "constructor", False, False, False, "constructor", 0), (1, "class", "k", True, False, False, "get", 0),
        (1, "class", "it", False, True, True, "method", 0), (5, "class", "delete", True, True, True, "method", 0),
        (5, "class", "if", False, False, False, "set", 1), (5, "object", "for", False, False, True, "method", 1),
        (5, "object", "catch", False, False, True, "method", 0)]),
    "control_flow": ("construct", [(1, "return"), (3, "if"), (3, "else"), (3, "for-of")]),
    "calls": ("callee is_new member_depth arg_count", [
        (1, "super", False, 0, 0), (3, "c", False, 1, 1), (3, "f", False, 0, 1), (3, "Foo", True, 0, 1), (3, "c", False, 2, 0),
        (6, "X", True, 0, 0), (6, "C", True, 2, 0), (6, "D", True, 0, 0)]),
    "templates": ("tagged substitutions", [(4, False, 2), (4, True, 0), (4, False, 1), (4, False, 1), (4, False, 1)]),
    "generators_async": ("pos construct body_pos", [
        (2, 11, "yield", 10), (2, 23, "await", 23)]),
    "operators": ("operator operator_class", [
        (0, "=", "assignment"), (2, "=", "assignment"), (2, "=", "assignment"), (2, "=", "assignment"), (2, "await", "unary"), (2, "**", "binary"),
        (3, "=", "assignment"), (3, "=", "assignment"), (4, "=", "assignment"), (4, "=", "assignment"), (4, "+=", "assignment"), (4, "!", "unary"),
        (5, "=", "assignment")]),
}


@pytest.fixture(scope="module")
def tokens(spark):
    rows = [(str(i), f"t/{i}.js", s) for i, s in enumerate(SCRIPTS)]
    return K.tokenize(spark.createDataFrame(rows, "script_id string, path string, src string")).cache()


@pytest.mark.parametrize("table", EXPECTED)
def test_rows(tokens, table):
    columns, expected = EXPECTED[table]
    got = [(int(r.script_id), *r[1:]) for r in getattr(N, table)(tokens).select("script_id", *columns.split()).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
