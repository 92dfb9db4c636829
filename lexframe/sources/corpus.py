"""Corpora built from the supplied tables, and readers of real script and log files.

The adapters are plain projections (one ``row_number`` for traces), so they scale with their table.
Expressions in SQL text here are valid in any ANSI dialect with ``%`` and ``floor``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexframe.sources import snippets as S

# --- fixed values: messages a syntax checker of this kind writes ---------------------------------
MESSAGES = [
    "memory exhausted",
    "syntax is ambiguous",
    "syntax error, unexpected IDENTIFIER, expecting ':'",
    "syntax error, unexpected end of file",
    "premature end of file in comment",
    "LineTerminator not allowed before '=>'",
    "LineTerminator not allowed after 'yield'",
    "Getter must not have parameters",
    "Setter must have exactly one parameter",
    "Class constructor cannot be static",
    "Unexpected identifier before class element",
    "Expected 'from' in module statement",
    "Expected 'as' in module statement",
    "Expected 'of' in for-of statement",
    "note: rest element: must be last",
]
TRACE_TOKENS = ["IDENTIFIER", "'('", "'.'", "','", "'{'", "STRING", "'='", "NUMBER", "ARROW_HEAD", "FUNCTION", "'['", "ASYNC"]
# -------------------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def block_of(k: str) -> str:
    return f"cast(floor(({k}) / {S.COUNT}) as bigint)"


def ext_of_block(b: str) -> str:
    return (
        f"case ({b}) % 7 when 0 then '.mjs' when 1 then '.cjs' when 2 then '.JS' when 3 then '.txt' else '.js' end"
    )


def path_of_key(k: str) -> str:
    """Path of the script made from order key ``k``."""
    b = block_of(k)
    return (
        f"'gen/d' || cast({b} % 97 as string) || "
        f"case when ({k}) % {S.COUNT} >= {len(S.VALID)} then '/test_error_m' else '/m' end || "
        f"cast({k} as string) || {ext_of_block(b)}"
    )


def placeholder_values() -> dict[str, str]:
    k = "o_orderkey"
    b = block_of(k)
    first = f"({k} - {k} % {S.COUNT})"
    return {
        "K": f"cast({k} as string)",
        "C": "cast(o_custkey as string)",
        "S": "o_orderstatus",
        "P": "cast(cast(floor(o_totalprice) as bigint) as string)",
        "M": f"cast({first} as string)",
        "E": ext_of_block(b),
        # chains of modules are cut every fifth block
        "G": f"cast((({b}) - 1) % 97 as string)",
        "N": f"case when {b} % 5 = 0 then 'none' else cast({first} - {S.COUNT} as string) end",
        "F": ext_of_block(f"{b} - 1"),
    }


def generated_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snippet per order with its placeholders filled in: the positive corpus with known faults."""
    orders = table(spark, sf_dir, "orders")
    texts = F.array(*[F.lit(s) for s in S.ALL])
    src = F.element_at(texts, (F.col("o_orderkey") % S.COUNT + 1).cast("int"))
    for mark, value in placeholder_values().items():
        src = F.replace(src, F.lit("@" + mark), F.expr(value))
    return _as_scripts(
        orders.select(
            F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("script_id"),
            F.expr(path_of_key("o_orderkey")).alias("path"),
            src.alias("src"),
        )
    )


def page_scripts(pages: DataFrame) -> DataFrame:
    """Bodies of inline ``<script>`` elements of web pages."""
    bodies = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1))
    df = pages.select("page_id", "url", F.posexplode(bodies).alias("n", "src"))
    return _as_scripts(
        df.select(
            F.concat_ws(":", F.lit("p"), F.col("page_id").cast("string"), F.col("n").cast("string")).alias("script_id"),
            F.concat("url", F.lit("#"), F.col("n").cast("string"), F.lit(".js")).alias("path"),
            "src",
        )
    )


def prose_scripts(documents: DataFrame) -> DataFrame:
    """Documents as scripts: the negative corpus."""
    return _as_scripts(
        documents.select(
            F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("script_id"),
            F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
            F.col("text").alias("src"),
        )
    )


def extension(path):
    """The last dot and what follows it; empty without a dot in the path."""
    return F.regexp_extract(path, r"\.[^.]*$", 0)


def _as_scripts(df: DataFrame) -> DataFrame:
    return df.select("script_id", "path", extension(F.col("path")).alias("ext"), F.length("src").cast("long").alias("size"), "src")


def scan_scripts(spark: SparkSession, path: str, *, glob: str = "*") -> DataFrame:
    """Reads a directory tree of script files, one whole text per row, malformed UTF-8 replaced.

    ``size`` is the file size in bytes and ``script_id`` the path.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    )
    text = F.col("content").cast("string")
    return files.select(
        F.col("path").alias("script_id"),
        "path",
        extension(F.col("path")).alias("ext"),
        F.col("length").alias("size"),
        F.make_valid_utf8(text).alias("src"),
    )


def log_line_columns() -> dict[str, str]:
    """``line_no`` and ``text`` of the error log kept in ``events``, with damaged and blank lines."""
    key = "(cast(floor(event_id / 4) as bigint) * 8)"
    loc = "':' || cast(event_id % 400 + 1 as string) || ':' || cast(event_id % 80 + 1 as string) || ': '"
    cases = " ".join(f"when {i} then '{m.replace(chr(39), chr(39) * 2)}'" for i, m in enumerate(MESSAGES))
    message = f"case event_id % {len(MESSAGES)} {cases} end"
    return {
        "line_no": "event_id",
        "text": (
            "case when event_id % 101 = 0 then '  ' when event_id % 97 = 0 then 'parser stopped at ' || cast(event_id as string) "
            f"else case when event_id % 53 = 0 then 'C:/' else '' end || {path_of_key(key)} || {loc} || {message} end"
        ),
    }


def log_lines(events: DataFrame) -> DataFrame:
    """``line_no, text`` lines of an error log from the error events."""
    return events.filter("event_type = 'error'").selectExpr(*[_requote(v) + f" as {k}" for k, v in log_line_columns().items()])


def _requote(sql: str) -> str:
    """Rewrites doubled quotes inside literals as backslash escapes, the form Spark reads."""
    out, i, inside = [], 0, False
    while i < len(sql):
        if sql[i] == "'":
            if inside and sql[i + 1 : i + 2] == "'":
                out.append("\\'")
                i += 2
                continue
            inside = not inside
        out.append(sql[i])
        i += 1
    return "".join(out)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, size`` of the script files at hand; every seventh script is not there."""
    scripts = generated_scripts(spark, sf_dir).withColumn("k", F.substring("script_id", 2, 20).cast("long"))
    return scripts.filter("k % 7 <> 3").select("path", "size")


#: Order within ``l_orderkey``; rows equal in all of these give the same trace line.
TRACE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]


def trace_line_text() -> str:
    stack, parent = "cast(l_suppkey % 12 as string)", "cast(l_partkey % 9 as string)"
    tokens = " ".join(
        f"when {i} then '{t.replace(chr(39), chr(39) * 2)}'" for i, t in enumerate(TRACE_TOKENS)
    )
    token = f"case l_suppkey % {len(TRACE_TOKENS)} {tokens} end"
    rule = "cast(l_partkey % 40 as string)"
    return f"""case
        when l_partkey % 211 = 0 then 'Next token is token'
        when l_partkey % 223 = 0 then 'Splitting off stack from nowhere'
        when l_partkey % 227 = 0 then 'Cleanup: popping'
        when l_partkey % 229 = 0 then '[PASS] done'
        when l_partkey % 233 = 0 then '[FAIL] done'
        when l_partkey % 10 in (0, 1, 2) then 'Next token is token ' || {token} || ' (1.1: )'
        when l_partkey % 10 in (3, 4) then 'Splitting off stack ' || {stack} || ' from ' || {parent} || '.'
        when l_partkey % 10 = 5 then 'Stack ' || {stack} || ' dies.'
        when l_partkey % 10 = 6 then 'Rename stack ' || {stack} || ' -> ' || {parent} || '.'
        when l_partkey % 10 in (7, 8) then 'Reduced stack ' || {parent} || ' by rule ' || {rule} || ' (line ' || cast(l_partkey % 40 * 11 + 500 as string) || '); action resolved.'
        else 'Entering state ' || {rule} end"""


def trace_lines(lineitem: DataFrame) -> DataFrame:
    """``trace_id, line_no, text``: 16 parser traces in the order of the line items.

    Line numbers are unique and increasing but not dense; numbering is per order, so no trace is sorted whole.
    """
    within = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*TRACE_ORDER))
    return lineitem.select(
        (F.col("l_orderkey") % 16).alias("trace_id"),
        (F.col("l_orderkey") * 1000 + within).alias("line_no"),
        F.expr(_requote(trace_line_text())).alias("text"),
    )
