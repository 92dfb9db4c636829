from pyspark.sql import functions as F

from lexframe.operators import nodes as N
from lexframe.operators import rules as R
from lexframe.operators import shapes as H
from lexframe.operators import tokens as K

SOURCES = [
    "var a12 = f7(3, 0x1F, 017, 08, 1.05e20);", "var a98 = f5(9, 0x2E, 017, 08, 2.05e31);", "var a98 = f5(9, 0x2E, 017, 08, 2.05e31);",
    "new Foo12; x.p34.q5(`t${y67}z8`); class C9 {}\nlet u = \\u0061bc$_19 /12/ 3;", "new Foo21; x.p43.q6(`t${y76}z9`); class C8 {}\nlet u = \\u0061bc$_91 /21/ 4;",
    "if (a10 {", "if (a20 {", "b = 1 ` 2 } 33 @ 44\n'5", None, "", "\\u12x9 /* 7", "9" * 5000,
]


def _rows(df):
    return sorted(map(repr, (r.asDict() for r in df.select(*sorted(df.columns)).collect())))


def test_digits_of_a_run_do_not_change_tokens(scripts_of):
    src = scripts_of(*[s for s in SOURCES if s])
    shape = src.withColumn("src", H.masked(F.col("src")))
    assert {len(r.src) for r in shape.filter("script_id = '000'").collect()} == {len(SOURCES[0])}
    kept = ["script_id", "pos", "kind", "newline_before", "off", "line", "col"]
    assert _rows(K.token_positions(K.tokenize(src)).select(*kept)) == _rows(K.token_positions(K.tokenize(shape)).select(*kept))


def test_one_shape_for_scripts_that_differ_in_digits(scripts_of):
    split = H.parts(scripts_of(*SOURCES))
    assert split.shapes.count() == 7 and split.members.count() == 10
    assert {r.script_id for r in split.alone.collect()} == {"008", "011"}


def _odd(scripts):
    """With an id that comes twice and rows without an id."""
    again = scripts.filter("script_id = '003'")
    return scripts.union(again).union(again.withColumn("script_id", F.lit(None).cast("string")))


def test_same_rows_as_by_script(scripts_of):
    scripts = _odd(scripts_of(*SOURCES)).withColumns({"ext": F.lit(".js"), "size": F.length("src").cast("long")})
    tokens = K.tokenize(scripts)
    assert _rows(H.token_rows(scripts)) == _rows(tokens.drop("raw"))
    assert _rows(H.identifier_freq(scripts)) == _rows(K.identifier_freq(tokens))
    assert _rows(H.per_shape(scripts, N.calls_located, text="callee", at="callee_pos")) == _rows(N.calls(tokens))
    assert _rows(H.per_shape(scripts, N.member_access_located, text="property", at="property_pos")) == _rows(N.member_access(tokens))


def test_verdicts_as_by_script(scripts_of):
    scripts = _odd(scripts_of(*SOURCES))
    tokens = K.tokenize(scripts)
    assert _rows(R.verdicts(scripts)) == _rows(R.script_verdict(scripts, R.all_diagnostics(tokens)))
