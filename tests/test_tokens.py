from lexframe.operators import tokens as K
from lexframe.sources import snippets as N

CASES = {
    "return /a[/]b/g;": ["RETURN", "REGEX", ";"],
    "x = /* c */ /re/.y": ["IDENTIFIER", "=", "REGEX", ".", "IDENTIFIER"],
    "(a) / b / c": ["(", "IDENTIFIER", ")", "/", "IDENTIFIER", "/", "IDENTIFIER"],
    "a >>>= b >>> c <<= d >>= e": ["IDENTIFIER", ">>>=", "IDENTIFIER", ">>>", "IDENTIFIER", "<<=", "IDENTIFIER", ">>=", "IDENTIFIER"],
    "0x1F 017 .5e3 1. 08": ["NUMBER"] * 6,
    '"two\nlines" \'open': ["STRING", "STRING"],
    "`open ${a": ["ERROR", "IDENTIFIER", "IDENTIFIER", "{", "IDENTIFIER"],
    "`a${`b${c}`}d`": ["TEMPLATE_HEAD", "TEMPLATE_HEAD", "IDENTIFIER", "TEMPLATE_TAIL", "TEMPLATE_TAIL"],
    "`${}`": ["TEMPLATE_HEAD", "TEMPLATE_TAIL"],
    "\ufeffvar é": ["ERROR", "VAR", "ERROR"],
    "variable undefined \\u0061b $_": ["IDENTIFIER", "UNDEFINED", "IDENTIFIER", "IDENTIFIER"],
    "": [],
    "/***/ a /* ** */ b // c": ["IDENTIFIER", "IDENTIFIER"],
}


def test_kinds(spark, scripts_of):
    rows = K.tokenize(scripts_of(*CASES)).orderBy("script_id", "pos").collect()
    for i, (source, expected) in enumerate(CASES.items()):
        got = [r.kind for r in rows if r.script_id == f"{i:03d}"]
        assert got == expected + ["EOF"], source


H, M, T = "TEMPLATE_HEAD", "TEMPLATE_MIDDLE", "TEMPLATE_TAIL"
DEEP = {
    "`${" * 10 + "x" + "}`" * 10: [H] * 10 + ["IDENTIFIER"] + [T] * 10,
    "t=`${f({a:{b:{c:1}}})}`;": ["IDENTIFIER", "=", H, "IDENTIFIER", "(", "{", "IDENTIFIER", ":", "{", "IDENTIFIER", ":", "{", "IDENTIFIER", ":", "NUMBER", "}", "}", "}", ")", T, ";"],
    '`${s.replace(/"/g, "x")}`': [H, "IDENTIFIER", ".", "IDENTIFIER", "(", "REGEX", ",", "STRING", ")", T],
    "`a${/}/}b${ '}' /* } */ }c` / 2": [H, "REGEX", M, "STRING", T, "/", "NUMBER"],
    "`${a}${`$${b}` /c/ d}`": [H, "IDENTIFIER", M, H, "IDENTIFIER", T, "/", "IDENTIFIER", "/", "IDENTIFIER", T],
    "`${g(function (x) { if (x) { for (;;) { y(); } } })}`": [H, "IDENTIFIER", "(", "FUNCTION", "(", "IDENTIFIER", ")", "{", "IF", "(", "IDENTIFIER", ")", "{", "FOR", "(", ";", ";", ")", "{", "IDENTIFIER", "(", ")", ";", "}", "}", "}", ")", T],
    "a`b` + `c${ /* t */ }` // ${": ["IDENTIFIER", "TEMPLATE_NO_SUB", "+", H, T],
    "`a ${ `b` + `c": ["ERROR", "IDENTIFIER", "IDENTIFIER", "{", "TEMPLATE_NO_SUB", "+", "ERROR", "IDENTIFIER"],
    "x = { /re/: `${ { } }` }": ["IDENTIFIER", "=", "{", "REGEX", ":", H, "{", "}", T, "}"],
}


def test_templates_of_any_depth(spark, scripts_of):
    from lexframe.operators import rules as R

    scripts = scripts_of(*DEEP)
    tokens = K.tokenize(scripts)
    rows = tokens.orderBy("script_id", "pos").collect()
    for i, (source, expected) in enumerate(DEEP.items()):
        own = [r for r in rows if r.script_id == f"{i:03d}"]
        assert [r.kind for r in own] == expected + ["EOF"], source
        assert "".join(r.raw for r in own) == source + "\n\x03"
    valid = [i for i, e in enumerate(DEEP.values()) if "ERROR" not in e and "/re/" not in list(DEEP)[i] and "/* t" not in list(DEEP)[i]]  # an empty substitution is no expression
    failed = {r.script_id for r in R.script_verdict(scripts, R.all_diagnostics(tokens)).filter("verdict = 'FAIL'").collect()}
    assert not failed & {f"{i:03d}" for i in valid}


def test_a_long_script(spark, scripts_of):
    part = "var a = `x${ f({ k: `${ b }` }) }y`; /* c */ call(a / 2, /re/);\n"
    assert K.tokenize(scripts_of(part * 50_000)).count() == 25 * 50_000 + 1


def test_lexemes_give_back_the_text(spark, scripts_of):
    sources = [*CASES, *N.ALL, "x" * 300_000, "f(" * 5_000, '"' + "a\\n" * 50_000 + '"', "/* " + "*" * 50_000 + "/ a"]
    rows = K.lexemes(scripts_of(*sources)).orderBy("script_id", "pos").collect()
    for i, source in enumerate(sources):
        assert "".join(r.raw for r in rows if r.script_id == f"{i:03d}") == source + "\n\x03"


def test_positions_against_the_text(spark, scripts_of):
    rows = K.token_positions(K.tokenize(scripts_of(*N.ALL))).collect()
    for r in rows:
        text = N.ALL[int(r.script_id)] + "\n\x03"
        before = text[: r.off]
        assert text[r.off : r.off + len(r.text)] == r.text
        assert r.line == before.count("\n") + 1
        assert r.col == len(before) - (before.rfind("\n") + 1) + 1


def test_literal_values(spark, scripts_of):
    rows = K.literal_values(K.tokenize(scripts_of("x = [0x1F, 017, 1.5e1, 'a\\'b', /x\\/y/gi, true, null]"))).orderBy("pos").collect()
    assert [r.number_value for r in rows[:3]] == [31.0, 17.0, 15.0]
    assert rows[3].string_value == "a\\'b"
    assert (rows[4].regex_pattern, rows[4].regex_flags) == ("x\\/y", "gi")
    assert rows[5].boolean_value is True and rows[6].literal_kind == "null"


def test_counts_stop_at_the_first_error(spark, scripts_of):
    rows = {r.script_id: r for r in K.token_counts(K.tokenize(scripts_of("a b", "a # b c"))).collect()}
    assert (rows["000"].n_tokens, rows["000"].last_kind) == (3, "EOF")
    assert (rows["001"].n_tokens, rows["001"].last_kind) == (2, "ERROR")


def test_one_exchange(spark, scripts_of):
    """Scripts are shuffled once, as texts; no window over the tokens shuffles again."""
    from lexframe.operators.structure import asi_points

    plan = asi_points(K.tokenize(scripts_of("a")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_partitions_follow_the_texts(spark, scripts_of):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert K.partitions_for(scripts_of("a")) == least
    scripts = spark.range(16).selectExpr("cast(id as string) as script_id", "'' as path", f"repeat('a ', {K.PARTITION_TEXT // 2}) as src")
    assert K.partitions_for(scripts) == 16
    assert K.tokenize(scripts).rdd.getNumPartitions() == 16


def test_scripts_without_a_mark_give_no_tokens(spark):
    from pyspark.sql import functions as F

    rows = [("a", "x = 1"), ("b", "y => 1"), ("c", "z"), ("c", "v => 2"), (None, None), (None, "w => 3")]
    scripts = spark.createDataFrame(rows, "script_id string, src string")
    whole, part = K.tokenize(scripts), K.tokenize(scripts, only=F.contains("src", F.lit("=>")))
    # rows of one id stay together, null ids included
    assert sorted(map(str, part.collect())) == sorted(map(str, whole.filter("script_id <> 'a' or script_id is null").collect()))
