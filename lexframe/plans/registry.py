"""Registered queries: every operator over whole supplied tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexframe.sources import corpus as C

Query = Callable[[SparkSession, str], DataFrame]


_CORPORA: WeakKeyDictionary[SparkSession, dict[tuple[str, str], DataFrame]] = WeakKeyDictionary()


def corpus(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """The (lazy) frame of a corpus, shared by the queries of a session."""
    made = _CORPORA.setdefault(spark, {})
    if (sf_dir, which) not in made:
        made[sf_dir, which] = _corpus(spark, sf_dir, which)
    return made[sf_dir, which]


def _corpus(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """``gen``: generated scripts; ``code``: with page scripts; ``all``: with prose as the negative corpus.

    Tokens, checks and verdicts are for any text, so they take all. Tables of code constructs take code: what they would find in
    prose is chance. The module graph takes the scripts that have module paths.
    """
    df = C.generated_scripts(spark, sf_dir)
    if which in ("code", "all"):
        df = df.unionByName(C.page_scripts(C.table(spark, sf_dir, "pages")))
    if which == "all":
        df = df.unionByName(C.prose_scripts(C.table(spark, sf_dir, "documents")))
    return df


_TOKENS: WeakKeyDictionary[SparkSession, dict[tuple[str, str], DataFrame]] = WeakKeyDictionary()


def _tokens(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Token frame of a corpus; the lazy frame is shared by the queries of a session, its rows are not kept."""
    from lexframe.operators.tokens import tokenize

    made = _TOKENS.setdefault(spark, {})
    if (sf_dir, which) not in made:
        made[sf_dir, which] = tokenize(corpus(spark, sf_dir, which))
    return made[sf_dir, which]


def _on_tokens(fn: Callable[..., DataFrame], which: str, *args) -> Query:
    return lambda spark, sf_dir: fn(_tokens(spark, sf_dir, which), *args)


def _per_shape(fn: Callable[..., DataFrame], which: str, **text: str) -> Query:
    """Scripts that differ in digits only are worked on once."""
    from lexframe.operators.shapes import per_shape

    return lambda spark, sf_dir: per_shape(corpus(spark, sf_dir, which), fn, **text)


def _on_scripts_with(mark: str, fn: Callable[..., DataFrame], which: str) -> Query:
    """For a construct that no script without ``mark`` can hold: other texts are left out before they become tokens."""
    from lexframe.operators.tokens import tokenize

    return lambda spark, sf_dir: fn(tokenize(corpus(spark, sf_dir, which).filter(F.contains("src", F.lit(mark)))))


#: Constructs and rules that need certain words or marks: any of these sets, each whole. Keywords stand literally in the text.
_ACCESSORS = [("get", "(", "{"), ("set", "(", "{")]
NEEDS: dict[str, list[tuple[str, ...]]] = {
    "functions": [("function",)],
    "function_position": [("function",)],
    "brace_kind": [("{",)],
    "ternary_match": [("?",)],
    "methods": [("(", "{")],
    "generators_async": [("yield",), ("await",)],
    "var_decls": [("var",), ("let",), ("const",)],
    "rule_bracket": [(c,) for c in "()[]{}`"],
    "rule_newline_arrow": [("=>",)],
    "rule_newline_yield": [("yield",)],
    "rule_accessor_arity": _ACCESSORS,
    "rule_static_constructor": [("static", "constructor", "(", "{")],
    "rule_class_prefix": [("(", "{")],
    "rule_contextual": [("import",), ("export",), *[("for", c) for c in "([{`"]],
    "rule_rest_last": [("...",)],
    "import_edges": [("import",)],
    "export_edges": [("export",)],
}


def _needed_tokens(spark: SparkSession, sf_dir: str, which: str, name: str) -> DataFrame:
    """Tokens of the scripts that can hold what ``name`` looks for; the others are read, but never become tokens."""
    from lexframe.operators.tokens import tokenize

    def holds(marks: tuple[str, ...]):
        return reduce(and_, [F.contains("src", F.lit(m)) for m in marks])

    return tokenize(corpus(spark, sf_dir, which), only=reduce(or_, [holds(marks) for marks in NEEDS[name]]))


def _on_needed(name: str, fn: Callable[..., DataFrame], which: str, *args) -> Query:
    return lambda spark, sf_dir: fn(_needed_tokens(spark, sf_dir, which, name), *args)


def _on_log(fn: Callable[..., DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(C.log_lines(C.table(spark, sf_dir, "events")))


def _on_log_files(fn: Callable[..., DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(C.log_lines(C.table(spark, sf_dir, "events")), C.files(spark, sf_dir))


def _on_trace(fn: Callable[..., DataFrame], *args) -> Query:
    from lexframe.operators.traces import read_trace

    return lambda spark, sf_dir: fn(read_trace(C.trace_lines(C.table(spark, sf_dir, "lineitem"))), *args)


def token_class(tokens: DataFrame) -> DataFrame:
    """Tokens and distinct texts per kind; counting per text first keeps hot kinds apart."""
    return (
        tokens.groupBy("kind", "family", "text").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("kind", "family").agg(F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_texts"))
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every script."""
    from lexframe.operators import rules as R

    return R.verdicts(corpus(spark, sf_dir, "all"))


def _test_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexframe.operators import rules as R

    return R.test_report(flagship(spark, sf_dir))


def _run_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rule sets as two runs over the same scripts: clause rules only, then without two lexical rules."""
    from lexframe.operators import rules as R
    from lexframe.operators.logs import run_delta

    sets = ["rule <> 'adjacency'", "rule not in ('bad_character', 'newline_arrow')"]
    return run_delta(*R.verdicts_of(corpus(spark, sf_dir, "code"), sets))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexframe.operators import modules as M
    from lexframe.operators import nodes as N
    from lexframe.sources.workdir import checkpoint

    scripts = corpus(spark, sf_dir, "gen")
    # each side is read more than once below
    imports = checkpoint(N.imports(_needed_tokens(spark, sf_dir, "gen", "import_edges")))
    exports = checkpoint(N.exports(_needed_tokens(spark, sf_dir, "gen", "export_edges")))
    return M.module_edges(imports, exports, scripts)


def _reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexframe.operators.modules import module_reach

    return module_reach(_edges(spark, sf_dir).filter("status <> 'external'"))


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexframe.operators.components import strong_components

    return strong_components(_edges(spark, sf_dir).filter("status <> 'external'"))


def _reach_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexframe.operators.components import reach_sizes, strong_components
    from lexframe.sources.workdir import checkpoint

    edges = checkpoint(_edges(spark, sf_dir).filter("status <> 'external'").select("path", "target_path").distinct())
    return reach_sizes(edges, strong_components(edges))


def _census(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexframe.operators import nodes as N

    return N.node_census(corpus(spark, sf_dir, "code"))


def _visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexframe.operators import nodes as N
    from lexframe.operators.shapes import per_shape

    # counting per script first: exact distinct counts without one hot group
    per_script = per_shape(corpus(spark, sf_dir, "code"), lambda tokens: N.per_script(N.constructs(tokens)))
    return N.visit(
        per_script,
        F.sum("n").alias("n_nodes"),
        F.count_distinct("node").alias("n_kinds"),
        F.count_distinct("script_id").alias("n_scripts"),
        F.coalesce(F.sum(F.when(F.col("node") == "call", F.col("n"))), F.lit(0)).alias("n_calls"),
        F.max("longest").alias("longest_name"),
    )


def _write_and_read_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexframe.sources.sinks import write_tokens
    from lexframe.sources.workdir import new_dir

    scripts = corpus(spark, sf_dir, "code")
    out = new_dir(spark, "tokens")
    write_tokens(scripts, out)
    return spark.read.parquet(out).groupBy("ext").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.count_distinct("script_id").alias("n_scripts")
    )


def _write_and_read_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexframe.operators import logs as L
    from lexframe.operators import rules as R
    from lexframe.operators.shapes import per_shape
    from lexframe.sources.workdir import new_dir

    scripts = corpus(spark, sf_dir, "code")
    out = new_dir(spark, "log")
    L.write_error_log(per_shape(scripts, R.all_diagnostics).join(scripts.select("script_id", "path"), "script_id"), out)
    return L.read_error_log(L.scan_log(spark, out)).select("path", "line", "col", "message", "_bad")


def _scan_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes each page script to a file of its own and scans the tree of files."""
    from lexframe.sources.sinks import write_scripts
    from lexframe.sources.workdir import new_dir

    out = new_dir(spark, "scripts")
    write_scripts(C.page_scripts(C.table(spark, sf_dir, "pages")), out)
    return C.scan_scripts(spark, out, glob="*.txt").select("ext", "size", "src")


def _stream_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexframe.streaming import jobs as J

    schema = C.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    return J.latest_batch(spark.read.parquet(J.stream_error_counts(C.log_lines(events))))


def _stream_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexframe.streaming import jobs as J

    schema = C.table(spark, sf_dir, "pages").schema
    pages = spark.readStream.schema(schema).parquet(f"{sf_dir}/pages*.parquet")
    return spark.read.parquet(J.stream_verdict(C.page_scripts(pages))).drop("batch")


def _stream_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexframe.sources.workdir import new_dir
    from lexframe.streaming import jobs as J

    # numbering the lines needs a whole table, so they are written out first and the files streamed
    out = new_dir(spark, "trace-lines")
    C.trace_lines(C.table(spark, sf_dir, "lineitem")).write.parquet(out)
    lines = spark.readStream.schema("trace_id long, line_no long, text string").parquet(out)
    return spark.read.parquet(J.stream_trace(lines))


def queries() -> dict[str, Query]:
    from lexframe.operators import logs as L
    from lexframe.operators import nodes as N
    from lexframe.operators import patterns as B
    from lexframe.operators import rules as R
    from lexframe.operators import shapes
    from lexframe.operators import structure as S
    from lexframe.operators import tokens as K
    from lexframe.operators import traces as T
    from lexframe.operators.shapes import per_shape

    token_columns = ["script_id", "pos", "kind", "family", "text", "newline_before"]
    out: dict[str, Query] = {
        # sources and sinks
        "scan_scripts": _scan_scripts,
        "page_scripts": lambda spark, d: C.page_scripts(C.table(spark, d, "pages")),
        "write_error_log": _write_and_read_log,
        "write_tokens": _write_and_read_tokens,
        # tokens
        "tokenize": lambda spark, d: shapes.token_rows(corpus(spark, d, "all")).select(*token_columns),
        "token_class": _on_tokens(token_class, "all"),
        "token_positions": lambda spark, d: K.token_positions(_tokens(spark, d, "all")).select(
            "script_id", "pos", "kind", "off", "line", "col"
        ),
        "module_mode": lambda spark, d: _tokens(spark, d, "code").filter(
            F.col("kind").isin("IMPORT", "EXPORT", "IDENTIFIER")
        ).select(
            "script_id", "pos", F.col("kind").alias("module_kind"),
            K.module_mode(F.col("kind"), F.lit("script")).alias("script_kind"),
        ),
        "literal_values": lambda spark, d: K.literal_values(shapes.token_rows(corpus(spark, d, "code"), K.LITERAL_KINDS)),
        "literals": lambda spark, d: N.literals(shapes.token_rows(corpus(spark, d, "code"), K.LITERAL_KINDS)),
        "lex_errors": _per_shape(K.lex_errors, "all"),
        "token_counts": _on_tokens(K.token_counts, "all"),
        "identifier_freq": lambda spark, d: shapes.identifier_freq(corpus(spark, d, "all")),
        "identifier_topk": lambda spark, d: K.most_frequent(shapes.identifier_freq(corpus(spark, d, "all"))),
        "identifier_cardinality": _on_tokens(K.identifier_cardinality, "all"),
        "template_segments": _on_tokens(K.template_segments, "code"),
        # structure
        "bracket_depth": _on_tokens(S.bracket_depth, "code"),
        "bracket_match": _on_tokens(S.bracket_match, "code"),
        "paren_role": _on_tokens(S.paren_role, "code"),
        "ternary_match": _on_needed(
            "ternary_match", lambda tokens: S.ternary_match(S.conditionals(S.brackets(S.neighbours(tokens)))), "code"
        ),
        "brace_kind": _on_needed("brace_kind", S.brace_kind, "code"),
        "function_position": _on_needed("function_position", S.function_position, "code"),
        "asi_points": _per_shape(S.asi_points, "code"),
        # checks
        "rule_bracket": _on_needed("rule_bracket", R.rule_rows, "all", ["bracket_unmatched", "bracket_crossing"]),
        "rule_newline_arrow": _on_needed("rule_newline_arrow", R.rule_rows, "all", ["newline_arrow"]),
        "rule_newline_yield": _on_needed("rule_newline_yield", R.rule_rows, "all", ["newline_yield"]),
        "rule_accessor_arity": _on_needed("rule_accessor_arity", R.rule_rows, "all", ["getter_arity", "setter_arity"]),
        "rule_static_constructor": _on_needed("rule_static_constructor", R.rule_rows, "all", ["static_constructor"]),
        "rule_class_prefix": _on_needed("rule_class_prefix", R.rule_rows, "all", ["class_prefix"]),
        "rule_contextual": _on_needed("rule_contextual", R.rule_rows, "all", ["expected_from", "expected_as", "expected_of"]),
        "rule_rest_last": _on_needed("rule_rest_last", R.rule_rows, "all", ["rest_last"]),
        "rule_clause": _per_shape(R.clause_rows, "all"),
        "adjacency_errors": _per_shape(R.adjacency_errors, "all"),
        "all_diagnostics": _per_shape(R.all_diagnostics, "all"),
        "script_verdict": flagship,
        "test_report": _test_report,
        "ext_gate": lambda spark, d: R.ext_gate(corpus(spark, d, "all")),
        "expected_outcome": lambda spark, d: corpus(spark, d, "all").select(
            "script_id", "path", R.expected_outcome(F.col("path")).alias("error_expected")
        ),
        "run_delta": _run_delta,
        # code structure
        "node_census": _census,
        "visit": _visit,
        "module_edges": _edges,
        "module_reach": _reach,
        "module_components": _components,
        "module_reach_sizes": _reach_sizes,
        "nesting_quantiles": lambda spark, d: N.nesting_quantiles(per_shape(corpus(spark, d, "code"), N.nesting_stats)),
        "patterns": _on_tokens(B.patterns, "code"),
        "pattern_bindings": _on_tokens(B.pattern_bindings, "code"),
        # logs
        "read_error_log": _on_log(L.read_error_log),
        "error_category": _on_log(L.error_messages),
        "error_type_counts": _on_log(L.error_type_counts),
        "error_category_counts": _on_log(L.error_category_counts),
        "error_totals": _on_log(L.error_totals),
        "error_running": _on_log(L.error_running),
        "error_files": _on_log(L.error_files),
        "log_with_size": _on_log_files(L.log_with_size),
        "log_sorted_by_size": _on_log_files(L.log_sorted_by_size),
        "missing_files": _on_log_files(L.missing_files),
        "offending_scripts": lambda spark, d: L.offending_scripts(
            C.log_lines(C.table(spark, d, "events")), C.generated_scripts(spark, d)
        ),
        # traces
        "read_trace": _on_trace(lambda events: events),
        "split_tokens": _on_trace(T.split_tokens),
        "split_parent_rule": _on_trace(T.split_parent_rule),
        "splits_by_token": _on_trace(T.splits_by_token),
        "splits_by_rule": _on_trace(T.splits_by_rule),
        "topk_split_tokens": _on_trace(T.topk_split_tokens),
        "topk_split_rules": _on_trace(T.topk_split_rules),
        "trace_max_stack": _on_trace(T.trace_max_stack),
        "trace_compare": _on_trace(T.trace_compare, 0, 1),
        "trace_peak_alive": _on_trace(T.trace_peak_alive),
        "trace_peak_unbroken": _on_trace(lambda events: T.trace_peak_alive(events, clears=False)),
        # streams
        "stream_error_counts": _stream_errors,
        "stream_verdict": _stream_verdict,
        "stream_trace": _stream_trace,
    }
    for name in [
        "imports", "exports", "var_decls", "functions", "arrows", "classes", "methods", "control_flow", "calls",
        "member_access", "operators", "templates", "generators_async", "feature_stage", "nesting_stats",
    ]:
        out[name] = _on_tokens(getattr(N, name), "code")
    for name in NEEDS.keys() & {"functions", "methods", "generators_async", "var_decls"}:
        out[name] = _on_needed(name, getattr(N, name), "code")
    for name in ["control_flow", "operators", "feature_stage", "nesting_stats"]:
        out[name] = _per_shape(getattr(N, name), "code")
    out["calls"] = _per_shape(N.calls_located, "code", text="callee", at="callee_pos")
    out["member_access"] = _per_shape(N.member_access_located, "code", text="property", at="property_pos")
    for name, mark in {"imports": "import", "exports": "export", "arrows": "=>", "templates": "`"}.items():
        out[name] = _on_scripts_with(mark, getattr(N, name), "code")
    out["classes"] = lambda spark, d: per_shape(
        corpus(spark, d, "code").filter(F.contains("src", F.lit("class"))), N.classes_located, text="name", at="name_pos"
    )
    return out
