"""Code-structure tables: one row per construct, found by token patterns over the annotated tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexframe.functions import adjacency as A
from lexframe.functions.vectors import Rows, V, at, case, either, true
from lexframe.operators.passes import OPERAND_END, Found, Tokens, rows_of, scan
from lexframe.operators.rules import _true, _with_clause, with_methods
from lexframe.operators.shapes import parts
from lexframe.operators.structure import (
    NAMES, annotate, around, brackets, enclosing, is_close, is_open, neighbours,
)
from lexframe.operators.tokens import by_pos, literal_values, tokenize

ASSIGNMENTS = ["="] + A.ASSIGN
LOGICAL = ["&&", "||"]
BINARY = [o for o in A.INFIX if o not in LOGICAL] + ["+", "-", "*", "IN"]


class _Columns:
    """Token columns by name: ``c.p1`` is the column ``p1``."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


c = _Columns()


def no_text() -> Column:
    return F.lit(None).cast("string")


def _property() -> Column:
    """A keyword used as a property name: after a dot, as a key before a colon, or as the name of a method behind its modifiers."""
    modifier = (c.p1 == "ASYNC") | ((c.p1 == "IDENTIFIER") & c.p1t.isin("get", "set", "static") & ~c.kind.isin("IN", "INSTANCEOF"))
    star = (c.p1 == "*") & (c.p2.isin("{", "}", ";", ",", "ASYNC") | (c.p2t == "static"))
    method = c.kind.isin([w for w in A.WORDS if w != "FUNCTION"]) & (c.n1 == "(") & (modifier | star) & ~F.col("newline_before")
    return _true(c.p1 == ".") | _true((c.n1 == ":") & c.p1.isin("{", ",")) | _true(method)


def _keyword(*names: str) -> Column:
    return c.kind.isin(*names) & ~_property()


def _exclusive(*tests: V) -> list[np.ndarray]:
    """Rows of each test that none before it has."""
    left, out = np.ones(len(tests[0].v), bool), []
    for x in tests:
        out.append(np.flatnonzero(left & x.v))
        left &= ~x.v
    return out


def _unquoted(found: Found, row: V) -> pa.Array:
    return pa.array([None if x is None or len(x) < 3 else x[1:-1] for x in found.text(row).to_pylist()], pa.string())


def _imports(t: Tokens, schema: pa.Schema) -> list[pa.RecordBatch]:
    kind, p1, n1 = t.kind, t.p(1), t.n_(1)
    bare = t.keyword("IMPORT") & ((n1 == "STRING") | ((n1 == "{") & (t.n_(2) == "}")))
    in_import = t.in_clause & (t.clause_kind == "IMPORT")
    named = in_import & kind.isin(*NAMES, "DEFAULT") & (at(t.encl, kind) == "{") & p1.isin("{", ",")
    default = kind.isin(*NAMES) & (p1 == "IMPORT")
    namespace = in_import & kind.isin(*NAMES) & (t.p(1, "word") == "as") & (t.p(2) == "*")
    none, own = t.nothing, t.row
    renamed = case((t.n_(1, "word") == "as", t.n_(2, "row")), other=own)
    out = []
    for rows, local, imported, is_namespace, is_default in zip(
        _exclusive(bare, default, namespace, named), [none, own, own, renamed], [none, None, none, own], [False, False, True, False], [False, True, False, False],
        strict=True,
    ):
        if rows.size:
            found = Found(t, rows)
            out.append(found.batch(
                schema, pos=t.pos, local=found.text(local), imported="default" if imported is None else found.text(imported),
                is_namespace=pa.array([is_namespace] * len(rows)), is_default=pa.array([is_default] * len(rows)), source=_unquoted(found, t.source_row),
            ))
    return out


def imports(tokens: DataFrame) -> DataFrame:
    """One row per imported name; an import without names has null names."""
    return scan(tokens, _imports, "pos int, local string, imported string, is_namespace boolean, is_default boolean, source string")


def _exports(t: Tokens, schema: pa.Schema) -> list[pa.RecordBatch]:
    kind, n1, n2 = t.kind, t.n_(1), t.n_(2)
    spec = kind.isin(*NAMES, "DEFAULT") & (at(t.encl, kind) == "{") & (at(t.encl, t.open_p1) == "EXPORT") & t.p(1).isin("{", ",")
    word = t.keyword("EXPORT")
    variable = t.declared_by.there() & true(at(t.declared_by, t.p(1)) == "EXPORT")
    none = t.nothing

    def after(k: int) -> V:
        name = lambda i: case((t.n_(i).isin(*NAMES), t.n_(i, "row")))
        return case((true(t.n_(k) == "*"), name(k + 1)), other=name(k))

    def declared_name(k: int, keyword: V) -> V:
        """Name after the declaring keyword at offset ``k``, behind ``function`` of ``async`` and a star."""
        return case((keyword == "ASYNC", after(k + 2)), (keyword.isin("FUNCTION", "CLASS"), after(k + 1)))

    def what(keyword: V, other: str | None = None) -> V:
        return case((keyword.isin("FUNCTION", "ASYNC"), "function"), (keyword == "CLASS", "class"), other=other) if other else case(
            (keyword.isin("FUNCTION", "ASYNC"), "function"), (keyword == "CLASS", "class"))

    as_next = t.n_(1, "word") == "as"
    alias = case((as_next, t.n_(2, "row")))
    star_alias = case((t.n_(2, "word") == "as", t.n_(3, "row")))
    own = case((kind.isin(*NAMES), t.row))
    kinds = [
        (spec, t.row, case((as_next, t.n_(2, "row")), other=t.row), False, False, alias, none, case((true(at(t.encl, t.after_word) == "from"), t.source_row))),
        (word & (n1 == "*"), none, star_alias, False, True, star_alias, none, t.source_row),
        (word & (n1 == "DEFAULT"), declared_name(2, n2), "default", True, False, none, what(n2, "expression"), none),
        (word & n1.isin("FUNCTION", "CLASS", "ASYNC"), declared_name(1, n1), declared_name(1, n1), False, False, none, what(n1), none),
        (variable, own, own, False, False, none, at(t.declared_by, kind), none),
    ]
    out = []
    for rows, (_, local, exported, is_default, is_all, other, declaration, source) in zip(_exclusive(*[x[0] for x in kinds]), kinds, strict=True):
        if rows.size:
            found = Found(t, rows)
            declaration = pa.nulls(len(rows), pa.string()) if declaration is none else _lower(found.of(declaration))
            out.append(found.batch(
                schema, pos=t.pos, local=found.text(local), exported=exported if isinstance(exported, str) else found.text(exported), alias=found.text(other),
                is_default=pa.array([is_default] * len(rows)), is_all=pa.array([is_all] * len(rows)), declaration=declaration, source=_unquoted(found, source),
            ))
    return out


def exports(tokens: DataFrame) -> DataFrame:
    """One row per exported name, ``export *`` or default export."""
    return scan(tokens, _exports, "pos int, local string, exported string, is_default boolean, is_all boolean, alias string, declaration string, source string")


def detailed(tokens: DataFrame) -> DataFrame:
    return with_methods(around(enclosing(annotate(tokens))))


def _with_declarators(df: DataFrame) -> DataFrame:
    """``declares``: the token starts a declarator; ``decl_kind`` and ``decl_export`` of its statement; ``separates``: a comma between declarators.

    A comma separates declarators if the latest statement mark on its own nesting level is var, let or const.
    """
    here = Window.partitionBy("script_id", "level").orderBy("pos")
    word = c.kind.isin(A.DECLARE) & ~_property()
    ends = c.kind.isin(";", "IN") | ((c.kind == "IDENTIFIER") & (c.text == "of")) | is_open() | F.col(
        "asi_standard"
    ).isNotNull()
    mark = F.when(word, F.struct(F.lower(c.kind).alias("k"), (c.p1 == "EXPORT").alias("x"))).when(
        ends, F.struct(no_text().alias("k"), F.lit(False).alias("x"))
    )
    df = df.withColumn("_mark", F.last(mark, ignorenulls=True).over(here))
    separates = (c.kind == ",") & F.col("_mark.k").isNotNull()
    df = df.withColumns({"_split": F.when(word | separates, F.col("_mark")), "separates": _true(separates)})
    prev = F.lag("_split").over(by_pos())
    return df.withColumns({"declares": prev.isNotNull() & c.kind.isin(NAMES + ["{", "["]), "_prev": prev}).withColumns(
        {"decl_kind": F.col("_prev.k"), "decl_export": _true(F.col("_prev.x"))}
    ).drop("_mark", "_split", "_prev")


def _lower(names: pa.Array) -> pa.Array:
    return pc.utf8_lower(names)


def _var_decls(t: Tokens, schema: pa.Schema) -> list[pa.RecordBatch]:
    found = Found(t, rows_of(t.declared_by.there()))
    pattern = t.kind.isin("{", "[")
    started = true(case((pattern, t.after), other=t.n_(1)) == "=")
    return [found.batch(
        schema, pos=t.pos, decl_kind=_lower(found.of(at(t.declared_by, t.kind))), name=found.text(case((t.kind.isin(*NAMES), t.row))),
        is_pattern=pattern, has_initializer=started,
    )]


def var_decls(tokens: DataFrame) -> DataFrame:
    return scan(tokens, _var_decls, "pos int, decl_kind string, name string, is_pattern boolean, has_initializer boolean")


def functions(tokens: DataFrame) -> DataFrame:
    """``function`` declarations and expressions with their header."""
    df = around(annotate(tokens))
    star = _true(c.n1 == "*")
    named = F.when(star, c.n2.isin(NAMES)).otherwise(c.n1.isin(NAMES))
    step = 1 + star.cast("int") + named.cast("int")
    items = [F.lead("b.items", i).over(by_pos()) for i in (1, 2, 3)]
    df = df.withColumns({f"_n{i + 1}": items[i] for i in range(3)})
    return df.filter(c.kind.eqNullSafe("FUNCTION") & ~_property()).select(
        "script_id", "pos", F.col("function_form").alias("form"),
        F.when(named, F.when(star, c.n2t).otherwise(c.n1t)).alias("name"),
        star.alias("generator"), _true(c.p1 == "ASYNC").alias("is_async"),
        F.when(step == 1, F.col("_n1")).when(step == 2, F.col("_n2")).otherwise(F.col("_n3")).alias("param_count"),
        "depth",
    )


def arrows(tokens: DataFrame) -> DataFrame:
    """Arrow functions; the single-identifier form has no parentheses."""
    df = around(brackets(neighbours(tokens)))
    back = F.lag("b.items").over(by_pos())
    before = F.lag("b.open_p1").over(by_pos())
    df = df.withColumns({"_items": back, "_before": before}).filter(c.kind == "=>")
    single = c.p1 != ")"
    return df.select(
        "script_id", "pos",
        _true(F.when(single, c.p2 == "ASYNC").otherwise(F.col("_before") == "ASYNC")).alias("is_async"),
        (c.n1 != "{").alias("expression_body"),
        F.when(single, 1).otherwise(F.col("_items")).alias("param_count"),
        single.alias("single_identifier"),
    )


def classes(tokens: DataFrame) -> DataFrame:
    """Classes with their number of methods."""
    df = detailed(tokens)
    named = c.n1.isin(NAMES)
    # members name their body; the body is the first brace on the level of the class keyword
    starts = _keyword("CLASS")
    outer = F.when(is_open(), F.col("depth") - 1).otherwise(F.col("depth"))
    df = df.withColumn("_outer", outer)
    here = Window.partitionBy("script_id", "_outer").orderBy("pos")
    opener = is_open() & (c.kind == "{") & _true(F.col("b.open_p1").isin(OPERAND_END + ["CLASS"]))
    df = df.withColumn("_class", F.last(F.when(starts, F.col("pos")), ignorenulls=True).over(here))
    df = df.withColumn("_opens", F.when(opener & F.col("_class").isNotNull(), F.col("_class")))
    first = F.row_number().over(Window.partitionBy("script_id", "_opens").orderBy("pos")) == 1
    df = df.withColumn("_body_of", F.when(F.col("_opens").isNotNull() & first, F.col("_opens")))
    rows = df.select(
        "script_id",
        F.when(starts, F.col("pos")).when(F.col("_body_of").isNotNull(), F.col("_body_of"))
        .when(F.col("method").isNotNull(), -1).alias("class_pos"),
        F.when(F.col("_body_of").isNotNull(), F.col("pos")).when(F.col("method").isNotNull(), F.col("method.owner_pos")).alias("body_pos"),
        F.when(starts, F.struct(
            F.when(_true(F.col("statement_position")) | c.p1.isin("EXPORT", "DEFAULT") | F.col("asi_standard").isNotNull(), "declaration")
            .otherwise("expression").alias("form"),
            F.when(named, c.n1t).alias("name"),
            _true(F.when(named, c.n2).otherwise(c.n1) == "EXTENDS").alias("has_superclass"),
        )).alias("head"),
    ).filter(F.col("class_pos").isNotNull())
    members = rows.filter(F.col("class_pos") == -1).groupBy("script_id", "body_pos").agg(F.count(F.lit(1)).alias("n"))
    found = rows.filter(F.col("class_pos") >= 0).groupBy("script_id", F.col("class_pos").alias("pos")).agg(
        F.max("head").alias("head"), F.max("body_pos").alias("body_pos")
    )
    return found.join(members, ["script_id", "body_pos"], "left").select(
        "script_id", "pos", "head.*", F.coalesce("n", F.lit(0)).cast("int").alias("member_count")
    )


def _methods(t: Tokens, schema: pa.Schema) -> list[pa.RecordBatch]:
    m = t.method
    found = Found(t, rows_of(m["there"]))
    columns = {n: m[n] for n in ("owner", "computed", "is_static", "generator", "is_async", "method_kind")}
    return [found.batch(schema, pos=t.pos, name=found.text(m["name"]), param_count=t.items, **columns)]


def methods(tokens: DataFrame) -> DataFrame:
    return scan(tokens, _methods, "pos int, owner string, name string, computed boolean, is_static boolean, generator boolean, is_async boolean, method_kind string, param_count int")


def _control_construct() -> Column:
    in_header = F.col("header_kind")
    simple = {
        "WHILE": "while", "DO": "do", "SWITCH": "switch", "CASE": "case", "TRY": "try", "CATCH": "catch",
        "FINALLY": "finally", "WITH": "with", "BREAK": "break", "CONTINUE": "continue", "THROW": "throw",
        "RETURN": "return", "IF": "if", "ELSE": "else",
    }
    out = F.when(_keyword("FOR"), F.when(c.n1 == "AWAIT", "for-await").otherwise(F.coalesce(in_header, F.lit("for"))))
    for k_, name in simple.items():
        out = out.when(_keyword(k_), name)
    out = out.when((c.kind == "DEFAULT") & (c.n1 == ":") & ~_true(c.p1.isin(",", ".")) & ~_true((F.col("brace_kind_in") == "object")), "default")
    label = c.kind.isin(NAMES) & (c.n1 == ":") & (c.p1.isNull() | c.p1.isin(";", "}", ")", "{", "ELSE", "DO", ":") | F.col("asi_standard").isNotNull())
    return out.when(label & ~_true(F.col("brace_kind_in") == "object") & ~_true(F.col("next_conditional")), "label")


def control_flow(tokens: DataFrame) -> DataFrame:
    """Control statements; a ``for`` is told by the separator of its header."""
    return _with_control(around(annotate(tokens))).filter(F.col("construct").isNotNull()).select("script_id", "pos", "construct")


def _with_control(df: DataFrame) -> DataFrame:
    # the header of "for" ends with its closing parenthesis; the separator inside is seen from behind
    here = Window.partitionBy("script_id", "level").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    separator = (
        F.when(c.kind == ";", "for").when(c.kind == "IN", "for-in").when((c.kind == "IDENTIFIER") & (c.text == "of"), "for-of")
        .when(is_close(), "none")
    )
    df = df.withColumn("_first", F.last(separator, ignorenulls=True).over(here))
    df = df.withColumns(
        {
            "header_kind": F.lead(F.when(c.kind == "(", F.nullif("_first", F.lit("none")))).over(by_pos()),
            "next_conditional": F.lead("conditional").over(by_pos()),
        }
    )
    # kind of the braces a token is directly in
    braces = Window.partitionBy("script_id", "brace_depth").orderBy("pos")
    df = df.withColumn("brace_kind_in", F.last(F.when(c.kind == "{", F.col("brace_kind")), ignorenulls=True).over(braces))
    return df.withColumn("construct", _control_construct()).drop("_first")


def calls(tokens: DataFrame) -> DataFrame:
    """Calls and ``new`` with the last name of the callee, its member depth and the number of arguments."""
    return calls_located(tokens).drop("callee_pos")


def calls_located(tokens: DataFrame) -> DataFrame:
    """``calls`` with the token number of ``callee``."""
    return _call_rows(_with_member_chain(around(brackets(neighbours(tokens)))))


def _with_member_chain(df: DataFrame) -> DataFrame:
    """``chain_start``: where the run of names and dots that a token is part of begins."""
    part = c.kind.isin(NAMES + ["THIS", "SUPER"]) | (c.kind == ".") | _true(c.p1 == ".")
    starts = part & ~_true((c.p1 == ".") | ((c.kind == ".") & c.p1.isin(NAMES + ["THIS", "SUPER"])) | ((c.kind == ".") & (c.p2 == ".")))
    df = df.withColumn("_start", F.when(starts, F.struct("pos", "p1")))
    return df.withColumn("chain", F.when(part, F.last("_start", ignorenulls=True).over(by_pos()))).drop("_start")


def _call_rows(df: DataFrame) -> DataFrame:
    chain = F.lag("chain").over(by_pos())
    df = df.withColumn("_chain", chain)
    callee_end = c.p1.isin(NAMES + ["THIS", "SUPER", ")", "]", "}", "TEMPLATE_NO_SUB", "TEMPLATE_TAIL"]) | _true(c.p2 == ".")
    is_call = (
        (c.kind == "(") & callee_end & F.col("b.head_standard").isNull() & (F.coalesce("b.after", F.lit("")) != "{")
        & (F.col("b.paren_role") != "arrow")
    )
    # "new" without parentheses: a chain that ends in its last name
    goes_on = F.coalesce(c.n1, F.lit("")).isin("(", ".", "[", "TEMPLATE_NO_SUB", "TEMPLATE_HEAD")
    bare = _true((F.col("chain.p1") == "NEW") & (c.kind != ".")) & ~goes_on
    own = F.when(bare, F.col("chain")).otherwise(F.col("_chain"))
    dots = ((F.col("pos") - F.when(bare, 0).otherwise(1) - own.pos) / 2).cast("int")
    callee = F.when(c.p1.isin(NAMES + ["THIS", "SUPER"]) | _true(c.p2 == "."), c.p1t)
    return df.filter(is_call | bare).select(
        "script_id", "pos",
        F.when(bare, c.text).otherwise(callee).alias("callee"),
        _true(own.p1 == "NEW").alias("is_new"),
        F.coalesce(F.when(own.isNotNull(), dots), F.lit(0)).alias("member_depth"),
        F.when(bare, 0).otherwise(F.coalesce("b.items", F.lit(0))).alias("arg_count"),
        F.when(bare, F.col("pos")).when(callee.isNotNull(), F.col("pos") - 1).alias("callee_pos"),
    )


def classes_located(tokens: DataFrame) -> DataFrame:
    """``classes`` with the token number of ``name``."""
    return classes(tokens).withColumn("name_pos", F.when(F.col("name").isNotNull(), F.col("pos") + 1))


def member_access_located(tokens: DataFrame) -> DataFrame:
    """``member_access`` with the token number of ``property``."""
    return member_access(tokens).withColumn("property_pos", F.when(F.col("property").isNotNull(), F.col("pos") + 1))


def member_access(tokens: DataFrame) -> DataFrame:
    """Property accesses; computed ones have no name."""
    df = neighbours(tokens)
    dotted = (c.kind == ".") & _true(c.n1.isin(A.WORDS + ["IDENTIFIER"]))
    computed = (c.kind == "[") & _true(c.p1.isin(OPERAND_END) | (c.p2 == ".")) & ~_true((c.p1 == "}") & F.col("newline_before"))
    return df.filter(dotted | computed).select(
        "script_id", "pos", F.when(dotted, c.n1t).alias("property"), computed.alias("computed")
    )


def _operator_class() -> Column:
    operand = _true(c.p1.isin(OPERAND_END) | (c.p2 == "."))
    return (
        F.when(c.kind.isin("++", "--"), F.when(operand & ~F.col("newline_before"), "update_postfix").otherwise("update_prefix"))
        .when(c.kind.isin("TYPEOF", "DELETE", "VOID", "!", "~") & ~_property(), "unary")
        .when(c.kind == "AWAIT", F.when(~_true(c.p1 == "FOR"), "unary"))
        .when(c.kind.isin("+", "-"), F.when(operand, "binary").otherwise("unary"))
        .when(c.kind == "*", F.when(operand & ~_true(c.p1.isin(";", "{", "}")), "binary"))
        .when(c.kind.isin(LOGICAL), "logical")
        .when(c.kind.isin(ASSIGNMENTS), "assignment")
        .when(c.kind == "?", "ternary")
        .when(c.kind.isin(BINARY) & ~_property(), "binary")
    )


# --- fixed values: binding strength of operators, loosest first ---------------------------------------------
COMMA, ARROW, ASSIGNMENT, CONDITIONAL, UNARY, POWER, POSTFIX = 0, 1, 2, 3, 14, 15, 16
STRENGTH = {
    "||": 4, "&&": 5, "|": 6, "^": 7, "&": 8,
    "==": 9, "!=": 9, "===": 9, "!==": 9,
    "<": 10, ">": 10, "<=": 10, ">=": 10, "IN": 10, "INSTANCEOF": 10,
    "<<": 11, ">>": 11, ">>>": 11,
    "+": 12, "-": 12, "*": 13, "/": 13, "%": 13,
}
STATEMENT_WORDS = ["RETURN", "THROW", "VAR", "LET", "CONST", "CASE", "DEFAULT", "ELSE", "DO", "EXPORT", "IMPORT", "YIELD"]
# ------------------------------------------------------------------------------------------------------------
_FIRM, _OPERAND_ONLY = -1, 17


def _sequence_comma() -> Column:
    """A comma that is an operator: not between arguments, parameters, elements, properties, specifiers or declarators."""
    p1, p2 = F.col("around_it.p1"), F.col("around_it.p2")
    called = p1.isin(OPERAND_END + ["ASYNC"]) | _true(p2 == ".")
    control = _true(F.col("around_it.head_standard") == "control") & ~_true(p2.isin(".", "ASYNC", "*"))
    grouping = control | (F.col("around_it.head_standard").isNull() & (F.col("around_it.paren_role") != "arrow") & ~_true(called))
    kind = F.col("around_it.kind")
    inside = (
        F.when(kind.isNull(), True).when(kind == "(", grouping).when(kind == "[", _true(p1.isin(OPERAND_END)))
        .when(kind == "{", F.col("around_it.brace_kind") != "object").otherwise(True)
    )
    return (c.kind == ",") & _true(inside) & ~F.col("separates") & ~_true(c.p2 == "IMPORT")


def _strengths(mapping: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[c.kind]


def operators(tokens: DataFrame) -> DataFrame:
    """Operators with their class and the tokens of their operands: the left one starts at ``left_start``, the right one ends at ``right_end``.

    A prefix operator has no left operand and a postfix one no right operand; a conditional reaches from its condition to its last branch. A ``sequence`` is a
    comma between expressions. An operand ends at the nearest token of its nesting level that binds less than the operator, so one running maximum (or
    minimum, from behind) per binding strength over the same window gives all of them. Statement words and heads, blocks, inserted semicolons
    and the bracket around it end any operand.
    """
    df = _with_declarators(around(enclosing(annotate(tokens))))
    inside = Window.partitionBy("script_id", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    facts = F.struct("pos", "kind", "b.head_standard", "b.paren_role", "brace_kind", F.col("b.open_p1").alias("p1"), F.col("b.open_p2").alias("p2"))
    df = df.withColumn("around_it", F.last(F.when(is_open(), facts), ignorenulls=True).over(inside))
    # the lexical contract has no "**": two stars in a row are the power operator
    power, second = _true((c.kind == "*") & (c.n1 == "*")), _true((c.kind == "*") & (c.p1 == "*"))
    df = df.withColumn("operator_class", F.when(second, None).when(_sequence_comma(), "sequence").otherwise(_operator_class()))
    cls = F.col("operator_class")
    colon = _true((c.kind == ":") & F.col("conditional"))
    strength = (
        F.when(cls == "sequence", COMMA).when(cls == "assignment", ASSIGNMENT).when((cls == "ternary") | colon, CONDITIONAL)
        .when(cls.isin("unary", "update_prefix"), UNARY).when(cls == "update_postfix", POSTFIX)
        .when(cls.isNotNull(), F.when(power, POWER).otherwise(_strengths(STRENGTH)))
    )
    df = df.withColumns({"_on": F.col("depth") + F.when(is_open(), -1).when(is_close(), 1).otherwise(0), "_strength": strength})
    infix = cls.isin("sequence", "assignment", "ternary", "binary", "logical") | colon
    inserted = F.col("asi_standard").isNotNull()
    of = (c.kind == "IDENTIFIER") & (c.text == "of") & _true(c.p1.isin(NAMES + ["]", "}"]))
    firm = c.kind.isin(";", ",", ":", "TEMPLATE_MIDDLE") & F.col("_strength").isNull() | is_close()
    head = (c.kind == "(") & _true(F.col("b.head_standard") == "control")
    # bodies of function and class declarations end a statement, those of expressions do not
    before = Window.partitionBy("script_id", "_on").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    declared = F.when(_keyword("FUNCTION"), _true(F.col("function_form") == "declaration") | inserted).when(
        _keyword("CLASS"), _true(F.col("statement_position")) | inserted)
    df = df.withColumn("_declared", _true(F.last(declared, ignorenulls=True).over(before)))
    class_body = _true((F.col("brace_kind") == "object") & F.col("b.open_p1").isin(OPERAND_END + ["CLASS"]))
    body = (F.col("brace_kind") == "function") | class_body
    block = (c.kind == "{") & _true((F.col("brace_kind") == "block") | (body & F.col("_declared"))) & ~_true(F.col("b.open_p1") == "=>")
    # where an operand behind the token may start at the earliest, and how strong an operator does not look past it
    prefix = cls.isin("unary", "update_prefix")
    starts = F.when(head | block, F.col("b.partner_pos") + 1).when(
        firm | infix | of | _keyword(*STATEMENT_WORDS) | prefix | (c.kind == "=>"), F.col("pos") + 1)
    looser = F.when(infix | prefix, F.col("_strength")).when(c.kind == "=>", ARROW).otherwise(_FIRM)
    behind = Window.partitionBy("script_id", "_on").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({"_start": starts, "_looser": F.when(starts.isNotNull(), looser), "_inserted": F.when(inserted, F.col("pos"))})
    ends = firm | inserted | (c.kind == "EOF")
    df = df.withColumn("_ends", F.when(ends, _FIRM).when(_true(infix), F.col("_strength")))
    # weakest operators that may be part of the left and of the right operand
    kept_left = (
        F.when(prefix, None).when(cls == "ternary", CONDITIONAL + 1).when(cls == "assignment", _OPERAND_ONLY)
        .when(power | (cls == "update_postfix"), POSTFIX).otherwise(F.col("_strength"))
    )
    kept_right = (
        F.when(cls == "update_postfix", None).when(cls.isin("ternary", "assignment"), ASSIGNMENT).when(power, POWER).otherwise(F.col("_strength") + 1)
    )
    binary = sorted(set(STRENGTH.values()))
    left = {k: F.max(F.when(F.col("_looser") < k, F.col("_start")).otherwise(F.col("_inserted"))).over(before) for k in [COMMA, *binary, POSTFIX, _OPERAND_ONLY]}
    right = {k: F.min(F.when(F.col("_ends") < k, F.col("pos"))).over(behind) for k in [COMMA + 1, ASSIGNMENT, *[k + 1 for k in binary], POWER]}

    def of_strength(found: dict[int, Column], wanted: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("int"))
        for k, value in found.items():
            out = out.when(wanted == k, value)
        return out

    df = df.withColumn("_left", F.when(kept_left.isNotNull(), F.coalesce(F.greatest(of_strength(left, kept_left), F.col("around_it.pos") + 1), F.lit(0))))
    # as for bodies of arrows: the colon of a conditional that was open before ends what is open in its branch
    closing = F.coalesce(F.sum(F.when(c.kind == "?", -1).when(colon, 1).otherwise(0)).over(behind), F.lit(0))
    df = df.withColumns({"_right": of_strength(right, kept_right), "_open": closing + colon.cast("int")})
    # a conditional counts as closed here, so that its own colon is not taken
    same = Window.partitionBy("script_id", "_on", "_open").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_open", F.col("_open") + F.when(c.kind == "?", -1).otherwise(0)).withColumn("_colon", F.min(F.when(colon, F.col("pos"))).over(same))
    return df.filter("operator_class is not null").select(
        "script_id", "pos", F.when(power, "**").otherwise(F.lower(c.kind)).alias("operator"), "operator_class",
        F.col("_left").cast("int").alias("left_start"),
        F.when(kept_right.isNotNull(), F.least("_right", "_colon") - 1).cast("int").alias("right_end"),
    )


def literals(tokens: DataFrame) -> DataFrame:
    """Census of literal kinds with the range of their values."""
    values = literal_values(tokens)
    return values.groupBy("literal_kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("number_value").alias("min_number"), F.max("number_value").alias("max_number"),
        F.max(F.length("string_value")).alias("max_string_length"),
    )


def templates(tokens: DataFrame) -> DataFrame:
    """Template literals: tagged or not, and how many substitutions."""
    df = neighbours(tokens)
    inside = Window.partitionBy("script_id", "level").orderBy("pos")
    middles = F.sum(F.when(c.kind == "TEMPLATE_MIDDLE", 1).otherwise(0)).over(inside)
    heads = F.last(F.when(c.kind == "TEMPLATE_HEAD", F.struct("pos", "p1", F.col("_m"))), ignorenulls=True).over(inside)
    df = df.withColumn("_m", middles).withColumn("_head", heads)
    is_tail = c.kind == "TEMPLATE_TAIL"
    df = df.filter(is_tail | (c.kind == "TEMPLATE_NO_SUB"))
    before = F.when(is_tail, F.col("_head.p1")).otherwise(c.p1)
    return df.select(
        "script_id",
        F.when(is_tail, F.col("_head.pos")).otherwise(F.col("pos")).alias("pos"),
        _true(before.isin(OPERAND_END)).alias("tagged"),
        F.when(is_tail, F.col("_m") - F.col("_head._m") + 1).otherwise(0).cast("int").alias("substitutions"),
    )


def _generators_async(t: Tokens, schema: pa.Schema) -> list[pa.RecordBatch]:
    kind, n1 = t.kind, t.n_(1)
    construct = case(
        (t.keyword("YIELD") & (n1 == "*"), "yield*"), (t.keyword("YIELD"), "yield"),
        (t.keyword("AWAIT") & true(t.p(1) == "FOR"), "for await"), (t.keyword("AWAIT"), "await"),
    )
    wanted = rows_of(construct.there())
    if not wanted.size:
        return []
    after_head = (t.open_p1 == ")") & ~true(t.body_of_standard == "control")
    block = (kind == "{") & true(after_head | (t.open_p1 == "=>"))
    end = at(t.expression_end, t.pos)
    expression = true((kind == "=>") & (n1 != "{")) & either(end > t.pos + 1, True)
    starts, arrows = rows_of(block), rows_of(expression & ~block)
    wanted = wanted[~(block.v | expression.v)[wanted]]
    close = at(t.partner, t.pos)
    closed, ended = starts[close.ok[starts]], arrows[end.ok[arrows]]
    rows = np.concatenate([closed, ended, starts, arrows, wanted])
    pos = np.concatenate([close.v[closed], end.v[ended], t.at_pos[starts], t.at_pos[arrows] + 1, t.at_pos[wanted]])
    # at one token bodies end before others start, and the token is inside of these
    rank = np.repeat(np.array([0, 0, 1, 1, 2], np.int8), [len(closed), len(ended), len(starts), len(arrows), len(wanted)])
    order = np.lexsort([rank, pos, t.script[rows]])
    rows, pos, rank = rows[order], pos[order], rank[order]
    events = Rows(t.script[rows], np.arange(len(rows)))
    nest = events.by_pos.sum(np.array([-1, 1, 0])[rank])
    started = at(events.window(nest).last(V(rank == 1)), V(pos.astype(np.int32)))
    body = case((V(nest > 0), started))
    own = np.flatnonzero(rank == 2)
    found = Found(t, rows[own])
    return [found.batch(schema, pos=t.pos, construct=construct, body_pos=Found(t, own).of(body))]


def generators_async(tokens: DataFrame) -> DataFrame:
    """``yield``, ``yield*``, ``await`` and ``for await`` with the innermost function body around them.

    ``body_pos`` is the first token of the body: its brace, or the first token of an arrow's expression; null outside of functions. Bodies are
    intervals, each within another or apart from it. In a sweep over where they start and end, the innermost around a token is the one that started last
    among those as deep as the token.
    """
    return scan(tokens, _generators_async, "pos int, construct string, body_pos int")


# --- unified node table --------------------------------------------------------------------------------


def constructs(tokens: DataFrame) -> DataFrame:
    """Every construct as ``script_id, pos, node, name``, in one pass over the annotated tokens."""
    df = _with_control(_with_declarators(detailed(tokens)))
    df = _with_member_chain(df)
    operator = _operator_class()
    callee_end = c.p1.isin(NAMES + ["THIS", "SUPER", ")", "]", "}", "TEMPLATE_NO_SUB", "TEMPLATE_TAIL"]) | _true(c.p2 == ".")
    is_call = (
        (c.kind == "(") & callee_end & F.col("b.head_standard").isNull() & (F.coalesce("b.after", F.lit("")) != "{")
        & (F.col("b.paren_role") != "arrow")
    )
    name = F.when(c.kind.isin(NAMES), c.text)
    rows = {
        "import": (_keyword("IMPORT") & c.n1.isin(NAMES + ["{", "*", "STRING"]), no_text()),
        "export": (_keyword("EXPORT"), no_text()),
        "var_decl": (F.col("declares"), name),
        "function": (_keyword("FUNCTION"), F.when(c.n1.isin(NAMES), c.n1t).when((c.n1 == "*") & c.n2.isin(NAMES), c.n2t)),
        "arrow": (c.kind == "=>", no_text()),
        "class": (_keyword("CLASS"), F.when(c.n1.isin(NAMES), c.n1t)),
        "method": (F.col("method").isNotNull(), F.col("method")["name"]),
        "call": (is_call, F.when(c.p1.isin(NAMES + ["THIS", "SUPER"]) | _true(c.p2 == "."), c.p1t)),
        "member": (
            ((c.kind == ".") & _true(c.n1.isin(A.WORDS + ["IDENTIFIER"])))
            | ((c.kind == "[") & _true(c.p1.isin(OPERAND_END) | (c.p2 == ".")) & ~_true((c.p1 == "}") & F.col("newline_before"))),
            F.when(c.kind == ".", c.n1t),
        ),
        "literal": (c.kind.isin("NUMBER", "STRING", "REGEX", "TRUE", "FALSE", "NULL", "UNDEFINED"), c.text),
        "template": (c.kind.isin("TEMPLATE_NO_SUB", "TEMPLATE_HEAD"), no_text()),
        "identifier": (c.kind == "IDENTIFIER", c.text),
        "yield": (_keyword("YIELD"), no_text()),
        "spread_or_rest": (c.kind == "...", no_text()),
    }
    found = [
        F.when(_true(test), F.struct(F.lit(n).alias("node"), v.cast("string").alias("name"))) for n, (test, v) in rows.items()
    ]
    found.append(F.when(operator.isNotNull(), F.struct(operator.alias("node"), F.lower(c.kind).alias("name"))))
    found.append(F.when(F.col("construct").isNotNull(), F.struct(F.col("construct").alias("node"), no_text().alias("name"))))
    df = df.select("script_id", "pos", F.array_compact(F.array(*found)).alias("_found")).filter(F.size("_found") > 0)
    return df.select("script_id", "pos", F.explode("_found").alias("_n")).select("script_id", "pos", "_n.node", "_n.name")


def visit(nodes: DataFrame, *aggregates: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Runs user aggregates (Columns, pandas aggregates) over every construct, per ``by`` columns or overall."""
    return nodes.groupBy(*by).agg(*aggregates) if by else nodes.agg(*aggregates)


def per_script(nodes: DataFrame) -> DataFrame:
    """Constructs per script and kind, with the length of the longest name."""
    return nodes.groupBy("script_id", "node").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("name")).alias("longest"))


def node_census(scripts: DataFrame) -> DataFrame:
    """Constructs per kind and extension with all subtotals; counting per script, or per shape of scripts, comes first."""
    split = parts(scripts)
    ext = F.lower("ext").alias("ext")
    alone = per_script(constructs(tokenize(split.alone))).join(split.alone.select("script_id", ext), "script_id")
    sizes = split.members.groupBy("shape", ext).agg(F.count(F.lit(1)).alias("m"))
    shared = per_script(constructs(tokenize(split.shapes))).withColumnRenamed("script_id", "shape").join(sizes, "shape")
    counted = alone.select("node", "ext", "n", F.lit(1).alias("m")).unionByName(
        shared.select("node", "ext", (F.col("n") * F.col("m")).alias("n"), "m")
    )
    return counted.groupBy("node", "ext").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).cube("node", "ext").agg(
        F.sum("n").alias("n_nodes"), F.sum("m").alias("n_scripts"), F.grouping_id().alias("level")
    )


def feature_stage(tokens: DataFrame) -> DataFrame:
    """Which of six language stages a script uses."""
    df = _with_clause(_with_declarators(detailed(tokens)))
    binding = c.kind.isin("[", "{") & (F.col("declares") | ((F.col("b.after") == "=") & is_open()))
    stages = {
        "destructuring": binding,
        "arrows": c.kind == "=>",
        "templates": c.kind.startswith("TEMPLATE"),
        "classes": _keyword("CLASS"),
        "iteration_async": c.kind.isin("ASYNC", "AWAIT", "YIELD") | ((c.kind == "IDENTIFIER") & (c.text == "of") & _true(F.col("encl.p1") == "FOR"))
        | (c.kind == "..."),
        "modules": _keyword("IMPORT", "EXPORT"),
    }
    return df.groupBy("script_id").agg(*[F.max(_true(c).cast("int")).alias(n) for n, c in stages.items()])


def nesting_stats(tokens: DataFrame) -> DataFrame:
    """Depths, length and tokens per statement of each script."""
    df = annotate(tokens)
    statement_end = (c.kind == ";").cast("int") + F.col("asi_standard").isNotNull().cast("int")
    per_script = df.groupBy("script_id").agg(
        F.max("depth").alias("max_depth"),
        F.avg("depth").alias("avg_depth"),
        F.count(F.lit(1)).alias("n_tokens"),
        F.sum(statement_end).alias("n_statements"),
    )
    return per_script.withColumn("tokens_per_statement", F.col("n_tokens") / F.greatest("n_statements", F.lit(1)))


def nesting_quantiles(stats: DataFrame) -> DataFrame:
    """Quantiles of depth and length over the corpus (values that occur), from counts per distinct value."""

    def quantiles(name: str) -> Column:
        parts = ", ".join(f"cast(percentile_disc({p}) within group (order by {name}) as bigint)" for p in (0.5, 0.9, 0.99))
        return F.expr(f"array({parts})")

    return stats.agg(
        quantiles("max_depth").alias("depth_quantiles"), quantiles("n_tokens").alias("token_quantiles"), F.max("n_tokens").alias("longest"),
    )
