"""Syntax diagnostics: a screen of necessary conditions, evaluated over the tokens of whole scripts.

It rejects a script on lexical errors, unmatched brackets, token pairs no grammar production allows and
a number of clause rules.  It is not a full grammar, so it accepts some scripts a parser rejects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexframe.functions import adjacency as A
from lexframe.functions.memo import once_per_frame
from lexframe.functions.vectors import V, at, case, true
from lexframe.operators.passes import Found, Tokens, rows_of, scan
from lexframe.operators.structure import BLOCK_AFTER, CAN_END, CONTROL, NAMES, YIELD_NEWLINE_OK
from lexframe.operators.shapes import expanded, parts
from lexframe.operators.tokens import by_pos, partitions_for, spread_scripts, tokenize
from lexframe.sources.workdir import written

# --- fixed values -------------------------------------------------------------------------------------
MESSAGES = {
    "bad_character": "unexpected character",
    "template_unparsed": "template literal not closed or nested too deep",
    "bracket_unmatched": "bracket without a partner",
    "bracket_crossing": "bracket closed by one of another kind",
    "newline_arrow": "LineTerminator not allowed before '=>'",
    "newline_yield": "LineTerminator not allowed after 'yield'",
    "getter_arity": "Getter must not have parameters",
    "setter_arity": "Setter must have exactly one parameter",
    "static_constructor": "Class constructor cannot be static",
    "class_prefix": "Unexpected identifier before class element",
    "expected_from": "Expected 'from' in module statement",
    "expected_as": "Expected 'as' in module statement",
    "expected_of": "Expected 'of' in for-of statement",
    "rest_last": "rest element must be last",
    "empty_header": "header needs an expression",
    "for_header": "header of a loop needs two semicolons, 'in' or 'of'",
    "list_comma": "comma without an item before it",
    "switch_body": "body of a switch starts with 'case' or 'default'",
    "try_alone": "try needs 'catch' or 'finally'",
    "do_alone": "do needs 'while'",
    "ternary_open": "conditional expression needs ':'",
    "unnamed": "declaration needs a name",
    "adjacency": "syntax error, unexpected token",
}
JS_EXTENSIONS = [".js", ".mjs", ".cjs"]
EXPECT_ERROR = "(test_error|temp)"
# --------------------------------------------------------------------------------------------------------


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def in_members() -> Column:
    """For a parenthesis before a brace: directly inside braces that are no block, so its keyword is the name of a method."""
    brace = F.col("brace")
    return _true((F.col("b.after") == "{") & (F.col("level") == brace.level + 1) & ~brace.p1.isin(BLOCK_AFTER))


@once_per_frame
def with_methods(df: DataFrame) -> DataFrame:
    """Adds ``method``: facts of a method header on its opening parenthesis (null elsewhere).

    Takes the columns of ``around`` and ``conditionals``.
    A method is ``key ( ... ) {`` directly inside braces, its parentheses heading nothing else.
    """
    key_words = NAMES + ["STRING", "NUMBER", "]"] + [w for w in A.WORDS if w not in ("FUNCTION",)]
    computed = F.col("p1") == "]"

    df = df.withColumn("_key", F.lag("b.key_before").over(by_pos()))

    def before(n: int, suffix: str) -> Column:
        """The n-th token before the key."""
        return F.when(computed, F.col(f"_key.p{n}{suffix}")).otherwise(F.col(f"p{n + 1}{suffix}"))

    # staged as columns, so that the conditions below stay small
    df = df.withColumns({f"_b{n}{x}": before(n, x) for n in (1, 2, 3, 4) for x in ("", "t")})
    c = F.col
    star = _true(c("_b1") == "*")
    df = df.withColumn("_star", star).withColumns(
        {
            "_c1": F.when(c("_star"), c("_b2")).otherwise(c("_b1")),
            "_c1t": F.when(c("_star"), c("_b2t")).otherwise(c("_b1t")),
            "_c2": F.when(c("_star"), c("_b3")).otherwise(c("_b2")),
            "_c2t": F.when(c("_star"), c("_b3t")).otherwise(c("_b2t")),
            "_c3t": F.when(c("_star"), c("_b4t")).otherwise(c("_b3t")),
        }
    )
    df = df.withColumn("_async", _true(c("_c1") == "ASYNC")).withColumns(
        {
            "_named1": _true(F.when(c("_async"), c("_c2")).otherwise(c("_c1")) == "IDENTIFIER"),
            "_word1": F.when(c("_async"), c("_c2t")).otherwise(c("_c1t")),
            "_named2": ~c("_async") & _true(c("_c2") == "IDENTIFIER"),
            "_word2": F.when(c("_async"), c("_c3t")).otherwise(c("_c2t")),
        }
    )
    star, is_async = c("_star"), c("_async")
    named1, named2, word1, word2 = c("_named1"), c("_named2"), c("_word1"), c("_word2")
    accessor = F.when(named1 & word1.isin("get", "set"), word1)
    is_static = (named1 & (word1 == "static")) | (named1 & named2 & (word2 == "static"))
    is_class = _true(c("brace.p1").isin([x for x in CAN_END if x != "DEFAULT"] + ["CLASS"]))
    prefix_ok = ~named1 | F.when(named2, (word2 == "static") & word1.isin("get", "set")).otherwise(
        word1.isin("static", "get", "set")
    )
    key_text = F.when(computed, F.lit(None).cast("string")).otherwise(F.col("p1t"))
    constructor = is_class & ~is_static & _true(key_text == "constructor")
    plain = F.col("b.head").isNull() & F.col("b.head_standard").isNull()
    is_method = (
        (F.col("kind") == "(") & (F.col("b.after") == "{") & (plain | (F.col("p1").isin(CONTROL) & in_members()))
        & F.col("p1").isin(key_words) & (F.col("level") == F.col("brace.level") + 1)
        & ~_true(c("_b1").isin(".", "NEW"))
    )
    facts = F.struct(
        F.when(is_class, "class").otherwise("object").alias("owner"),
        key_text.alias("name"),
        computed.alias("computed"),
        is_static.alias("is_static"),
        star.alias("generator"),
        is_async.alias("is_async"),
        F.when(accessor.isNotNull(), accessor).when(constructor, "constructor").otherwise("method").alias("method_kind"),
        F.col("b.items").alias("param_count"),
        prefix_ok.alias("prefix_ok"),
        F.col("brace.pos").alias("owner_pos"),
    )
    df = df.withColumn("method", F.when(_true(is_method), facts))
    return df.drop(*[x for x in df.columns if x.startswith("_")])


CLAUSE_RULES = ["empty_header", "for_header", "list_comma", "switch_body", "try_alone", "do_alone", "ternary_open", "unnamed"]


@once_per_frame
def _with_clause(df: DataFrame) -> DataFrame:
    """``clause_pos``: the import or export keyword whose clause (up to its source or end) holds the token."""
    kind = F.col("kind")
    before = by_pos().rowsBetween(Window.unboundedPreceding, -1)
    opens = kind.isin("IMPORT", "EXPORT") & ~_true(F.col("p1") == ".") & F.col("n1").isin(NAMES + ["{", "*"])
    ends = kind.isin("STRING", ";") | (kind.isin("IMPORT", "EXPORT", "VAR", "LET", "CONST", "FUNCTION", "CLASS", "="))
    mark = F.when(opens, F.col("pos")).when(ends, F.lit(-1))
    clause = F.last(mark, ignorenulls=True).over(before)
    return df.withColumn("clause_pos", F.when(clause >= 0, clause))


def _rule_tests(t: Tokens) -> dict[str, Callable[[], V]]:
    """Where each rule is broken; a rule is worked out when it is called."""
    kind, word = t.kind, t.word
    p1, n1, n2, n3 = t.p(1), t.n_(1), t.n_(2), t.n_(3)
    name = kind.isin(*NAMES)
    p1_word = t.p(1, "word")
    mates = {"(": ")", "[": "]", "{": "}", "TEMPLATE_HEAD": "TEMPLATE_TAIL"}
    crossing = lambda: case(*[(kind == c, at(t.partner, kind) != o) for o, c in mates.items()])

    def encl(column: V) -> V:
        return at(t.encl, column)

    def m(key: str, *values: str) -> V:
        return t.method["there"] & t.method[key].isin(*values)

    def rest_last() -> V:
        rest_end = case((n1.isin("[", "{"), t.by_pos.lead(t.after)), other=n2)
        params = (encl(kind) == "(") & ((encl(t.head_standard) == "function") | (encl(t.paren_role) == "arrow") | (encl(t.after) == "{"))
        pattern = encl(kind).isin("[", "{") & encl(t.open_p1).isin(*A.DECLARE)
        trailing = (encl(kind) == "[") & (rest_end == ",") & n1.isin(*NAMES) & (n3 == "]")
        return (kind == "...") & (params | pattern) & rest_end.isin(",", "=") & ~true(trailing)

    in_for = lambda: (encl(t.open_p1) == "FOR") | ((encl(t.open_p1) == "AWAIT") & (encl(t.open_p2) == "FOR"))
    return {
        "template_unparsed": lambda: (kind == "ERROR") & (word == "`"),
        "bad_character": lambda: (kind == "ERROR") & (word != "`"),
        "bracket_unmatched": lambda: (t.is_open | t.is_close) & t.partner.null(),
        "bracket_crossing": lambda: t.is_close & crossing(),
        "newline_arrow": lambda: (kind == "=>") & t.newline,
        "newline_yield": lambda: (p1 == "YIELD") & t.newline & ~kind.isin(*YIELD_NEWLINE_OK, "EOF"),
        "getter_arity": lambda: m("method_kind", "get") & (t.items != 0),
        "setter_arity": lambda: m("method_kind", "set") & (t.items != 1),
        "static_constructor": lambda: m("owner", "class") & t.method["is_static"] & (t.method["word"] == "constructor"),
        "class_prefix": lambda: m("owner", "class") & ~t.method["prefix_ok"],
        "expected_from": lambda: t.in_clause & name & (n1 == "STRING") & p1.isin(*NAMES, "}", "*") & (word != "from"),
        "expected_as": lambda: t.in_clause & name & p1.isin(*NAMES, "DEFAULT", "*") & n1.isin(*NAMES, "DEFAULT") & (word != "as") & (p1_word != "as"),
        "expected_of": lambda: in_for() & name & p1.isin(*NAMES, "]", "}") & (word != "of") & (p1_word != "of"),
        "rest_last": rest_last,
    }


def _clause_tests(t: Tokens) -> dict[str, Callable[[], V]]:
    """Clauses that lack a part, from the counts of each bracket and what stands around it."""
    kind, p1, p2, n1, n2 = t.kind, t.p(1), t.p(2), t.n_(1), t.n_(2)
    header = lambda: (kind == "(") & (t.head_standard == "control") & ~t.in_members()
    loop = p1.isin("FOR", "AWAIT")

    def unnamed() -> V:
        inner = case((n1 == "*", t.by_pos.lead(t.brace, 2)), other=t.by_pos.lead(t.brace))
        before = at(inner, t.open_p1)
        stands = inner.null() | before.null() | before.isin(*BLOCK_AFTER)
        nameless = (n1 == "(") | ((n1 == "*") & (n2 == "("))
        default = true(p1.isin("DEFAULT", "CASE")) | true((p1 == "ASYNC") & p2.isin("DEFAULT", "CASE"))
        return ((kind == "FUNCTION") & (t.function_form == "declaration") & nameless & stands & ~default) | (
            (kind == "CLASS") & t.statement_position & n1.isin("{", "EXTENDS") & ~default)

    return {
        "empty_header": lambda: header() & ~loop & (t.empty | (t.marks("semis") > 0)),
        "for_header": lambda: header() & loop & ~((t.marks("semis") == 2) | ((t.marks("semis") == 0) & (t.marks("loops") > 0))),
        "list_comma": lambda: kind.isin(")", "}", "EOF") & (t.marks("gaps") > 0),
        "switch_body": lambda: (kind == "{") & (t.body_p1 == "SWITCH") & ~t.empty & ~n1.isin("CASE", "DEFAULT"),
        "try_alone": lambda: (kind == "}") & (t.open_p1 == "TRY") & ~n1.isin("CATCH", "FINALLY"),
        "do_alone": lambda: kind.isin(")", "]", "}", "EOF") & (t.marks("does") > 0),
        "ternary_open": lambda: t.ternary_open,
        "unnamed": unnamed,
    }


def _broken(t: Tokens, names: list[str] | None = None, mode: str = "standard") -> Iterator[tuple[str, np.ndarray]]:
    """Rules (all of them without ``names``) and the tokens that break them."""
    tests = _rule_tests(t) | _clause_tests(t) | {"adjacency": lambda: t.illegal(mode)}
    for rule in names or tests:
        if (rows := rows_of(tests[rule]())).size:
            yield rule, rows


def rule_rows(tokens: DataFrame, rules: list[str]) -> DataFrame:
    """Violations of the named rules: ``script_id, pos, rule``."""

    def find(t: Tokens, schema: pa.Schema) -> list[pa.RecordBatch]:
        return [Found(t, rows).batch(schema, pos=t.pos, rule=rule) for rule, rows in _broken(t, rules)]

    return scan(tokens, find, "pos int, rule string")


def clause_rows(tokens: DataFrame) -> DataFrame:
    """Clauses that lack a part: ``script_id, pos, rule``."""
    return rule_rows(tokens, CLAUSE_RULES)


def adjacency_errors(tokens: DataFrame, mode: str = "standard") -> DataFrame:
    """Tokens that cannot follow the token before them."""

    def find(t: Tokens, schema: pa.Schema) -> list[pa.RecordBatch]:
        return [Found(t, rows_of(t.illegal(mode))).batch(schema, pos=t.pos, left_class=t.left_class(mode), right_class=t.right_class)]

    return scan(tokens, find, "pos int, left_class string, right_class string")


def all_diagnostics(tokens: DataFrame, mode: str = "standard") -> DataFrame:
    """Diagnostics of every kind in one pass: ``script_id, pos, line, col, rule, message``."""

    def find(t: Tokens, schema: pa.Schema) -> list[pa.RecordBatch]:
        line, col = t.places
        return [
            Found(t, rows).batch(schema, pos=t.pos, line=line, col=col, rule=rule, message=MESSAGES[rule]) for rule, rows in _broken(t, mode=mode)
        ]

    return scan(tokens, find, "pos int, line int, col int, rule string, message string", places=True)


def diagnosed(tokens: DataFrame, mode: str = "standard") -> DataFrame:
    """Scripts with diagnostics: how many (``error_count``) and the place of the ``first``, as of the rows of ``all_diagnostics``."""

    def find(t: Tokens, schema: pa.Schema) -> list[pa.RecordBatch]:
        n = np.zeros(t.n, np.int64)
        for _, rows in _broken(t, mode=mode):
            n[rows] += 1
        rows = np.flatnonzero(n)
        if not rows.size:
            return []
        starts = np.flatnonzero(np.diff(t.script[rows], prepend=-1))
        line, col = t.places
        # columns of scripts that come twice may be negative
        first = np.minimum.reduceat((line.v[rows].astype(np.int64) << 32) + col.v[rows] + (1 << 31), starts)
        columns = {"error_count": np.add.reduceat(n[rows], starts), "line": first >> 32, "col": (first & 0xFFFFFFFF) - (1 << 31)}
        return [Found(t, rows[starts]).batch(schema, **{k: pa.array(v) for k, v in columns.items()})]

    found = scan(tokens, find, "error_count long, line int, col int", places=True)
    return found.select("script_id", "error_count", F.struct("line", "col").alias("first"))


def ext_ok(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^.]*$", 0)).isin(JS_EXTENSIONS)


def ext_gate(scripts: DataFrame) -> DataFrame:
    return scripts.select("script_id", "path", ext_ok(F.col("path")).alias("ext_ok"))


def expected_outcome(path: Column) -> Column:
    return path.rlike(EXPECT_ERROR)


def _per_script(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("script_id").agg(
        F.count(F.lit(1)).alias("error_count"), F.min(F.struct("line", "col")).alias("first")
    )


def script_verdict(scripts: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """PASS or FAIL per script with the number and place of diagnostics; notes on odd extensions."""
    return _verdict_rows(scripts, _per_script(diagnostics))


def _verdict_rows(scripts: DataFrame, per_script: DataFrame) -> DataFrame:
    df = spread_scripts(scripts.select("script_id", "path"), partitions_for(scripts)).join(per_script, "script_id", "left")
    return df.select(*_verdict_columns())


def _verdict_columns() -> list[Column]:
    """Verdict from ``path``, ``error_count`` (null: none) and ``first``."""
    failed = F.col("error_count").isNotNull()
    ok = ext_ok(F.col("path"))
    return [
        F.col("script_id"),
        F.col("path"),
        F.when(failed, "FAIL").otherwise("PASS").alias("verdict"),
        F.coalesce("error_count", F.lit(0)).alias("error_count"),
        ok.alias("ext_ok"),
        F.when(~ok, F.when(failed, "HINT").otherwise("WARN")).alias("ext_note"),
        F.col("first.line").alias("first_line"),
        F.col("first.col").alias("first_col"),
    ]


def verdicts_of(scripts: DataFrame, rule_sets: list[str]) -> list[DataFrame]:
    """Verdicts by several sets of rules (tests of ``rule``); diagnostics are made once and once per shape of text."""
    split = parts(scripts)
    needed = ["script_id", "line", "col", "rule"]
    found, of_shapes = (
        written(all_diagnostics(tokenize(x)).select(*needed), "diagnostics") for x in (split.alone, split.shapes)
    )
    return [
        script_verdict(split.alone, found.filter(rules)).unionByName(
            expanded(split, _per_script(of_shapes.filter(rules)), *_verdict_columns(), how="left")
        )
        for rules in rule_sets
    ]


def verdicts(scripts: DataFrame) -> DataFrame:
    """PASS or FAIL per script by all rules."""
    split = parts(scripts)
    of_shapes = written(diagnosed(tokenize(split.shapes)), "diagnostics")
    return _verdict_rows(split.alone, diagnosed(tokenize(split.alone))).unionByName(
        expanded(split, of_shapes, *_verdict_columns(), how="left")
    )


def test_outcomes(verdicts: DataFrame) -> DataFrame:
    """Outcome of each script as a test: a path can say that an error is expected."""
    expected, failed = expected_outcome(F.col("path")), F.col("verdict") == "FAIL"
    outcome = (
        F.when(expected & failed, "PASS (caught)")
        .when(expected, "FAIL (unexpected success)")
        .when(failed, "FAIL")
        .otherwise("PASS")
    )
    return verdicts.select("script_id", "path", outcome.alias("outcome"))


def test_report(verdicts: DataFrame) -> DataFrame:
    """Counts per outcome: in total and per directory."""
    df = test_outcomes(verdicts).withColumn("dir", F.regexp_replace("path", r"/[^/]*$", ""))
    counted = df.rollup("dir").agg(
        F.count(F.lit(1)).alias("total"),
        *[
            F.count_if(F.col("outcome") == o).alias(a)
            for o, a in [("PASS", "passed"), ("PASS (caught)", "caught"), ("FAIL", "failed"), ("FAIL (unexpected success)", "unexpected")]
        ],
    )
    return counted.withColumn("dir", F.coalesce("dir", F.lit("(all)")))
