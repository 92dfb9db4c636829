"""Scripts to token rows.

The text of a script is one row, so tokenizing is narrow: one ``regexp_extract_all`` builds the lexemes
(leading trivia plus token), composites and templates are taken apart inside the array, and one
``posexplode`` makes the rows.  The scripts are hash-partitioned by ``script_id`` *before* that, so the
exchange moves the compact texts once, and every later window or aggregate per script reuses the
partitioning instead of shuffling the token rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexframe.functions import patterns as P
from lexframe.functions import templates
from lexframe.functions.memo import once_per_frame
from lexframe.functions.tokenclass import number_value, token_family, token_kind, unquote
from lexframe.sources.shipping import ship


def by_pos():
    """The one ordering of the tokens of a script; every running window uses it."""
    return Window.partitionBy("script_id").orderBy("pos")


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _split_heads(lexemes: Column) -> Column:
    """Takes "keyword or operator + regex literal" composites apart."""

    def split(x: Column) -> Column:
        composite = F.contains(x, F.lit("/")) & x.rlike(P.SPLIT_HEAD)
        parts = F.array(F.regexp_extract(x, P.SPLIT_HEAD, 1), F.regexp_extract(x, P.SPLIT_HEAD, 2))
        return F.when(composite, parts).otherwise(F.array(x))

    return F.flatten(F.transform(lexemes, split))


def _template_lexemes(pieces: Column) -> Column:
    """Lexemes of a text with template substitutions: its pieces of code, each followed by a template segment."""

    def lex(piece: Column) -> Column:
        code = F.when(piece.after, _all(piece.code, P.AFTER_LEXEME)).otherwise(_all(piece.code, P.BODY_LEXEME))
        return F.transform(
            F.array(F.struct(_split_heads(code).alias("b"), piece.segment.alias("s"))),
            # trailing trivia of the code leads the segment
            lambda p: F.when(p.s == "", p.b).when(
                (F.size(p.b) > 0) & F.element_at(p.b, -1).rlike(P.ONLY_TRIVIA),
                F.concat(F.slice(p.b, F.lit(1), F.size(p.b) - 1), F.array(F.concat(F.element_at(p.b, -1), p.s))),
            ).otherwise(F.concat(p.b, F.array(p.s))),
        )[0]

    return F.flatten(F.transform(pieces, lex))


def _cut(texts):
    import pandas as pd

    names = ("code", "segment", "after")
    return pd.Series([None if t is None else [dict(zip(names, p, strict=True)) for p in templates.pieces(t)] for t in texts])


#: Characters of text per partition. Code has a token every three or four, and the sorts of a task keep a row of some hundred bytes for each.
PARTITION_TEXT = 2 << 20


@once_per_frame
def partitions_for(scripts: DataFrame) -> int:
    """Partitions whose token rows fit in the memory of a task: the session's shuffle partitions, more if the texts need more.

    Adds up the sizes of the scripts, which runs a job without a shuffle of texts.
    """
    least = int(scripts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = {"size": F.col("size"), "src": F.length("src")}
    size = next((sizes[c] for c in sizes if c in scripts.columns), None)
    if size is None or scripts.isStreaming:
        return least
    total = scripts.agg(F.sum(size)).first()[0] or 0
    return max(least, -(-total // PARTITION_TEXT))


def spread_scripts(scripts: DataFrame, partitions: int | None = None) -> DataFrame:
    """Hash-partitions scripts by id, by default into as many partitions as their texts need.

    The number is given explicitly because adaptive execution would size the partitions by the texts,
    which grow about tenfold as token rows.
    """
    return scripts.repartition(partitions or partitions_for(scripts), "script_id")


def read_text(src: Column) -> Column:
    """The text as it is tokenized: with a final newline and the end mark, which it holds nowhere else."""
    return F.concat(F.translate(src, P.END_MARK, "�"), F.lit("\n" + P.END_MARK))


def lexemes(scripts: DataFrame, *, spread: bool = True, only: Column | None = None) -> DataFrame:
    """One row per lexeme: ``script_id, pos, raw`` where ``raw`` is leading trivia plus token text.

    Concatenating ``raw`` in ``pos`` order gives back the text (a final newline and the end mark added). With ``only`` (a test of ``src``) scripts
    that fail it give no lexemes, unless another row of the same id passes it: rows of one id share their windows.
    """
    ship(scripts.sparkSession)
    ended = read_text(F.col("src"))
    df = scripts.select("script_id", ended.alias("src"), (F.lit(True) if only is None else only).alias("_only"))
    # a substitution needs a backtick as well; all other texts are tokenized by one expression. Texts are cut before they are
    # spread, as Spark takes the output of Python for unpartitioned
    has_sub = F.contains("src", F.lit("${")) & F.contains("src", F.lit("`"))
    cut = F.pandas_udf(_cut, templates.PIECES)
    df = df.select("script_id", "_only", F.when(~has_sub, F.col("src")).alias("src"), cut(F.when(has_sub, F.col("src"))).alias("pieces"))
    if spread:
        df = spread_scripts(df, partitions_for(scripts))
    if only is not None:
        df = df.withColumn("_only", F.max("_only").over(Window.partitionBy("script_id"))).filter("_only")
    df = df.select("script_id", "pieces", F.contains("src", F.lit("/")).alias("slash"), _all(F.col("src"), P.LEXEME).alias("lx"))
    plain = F.when(F.col("slash"), _split_heads(F.col("lx"))).otherwise(F.col("lx"))
    df = df.select("script_id", F.coalesce(plain, _template_lexemes(F.col("pieces"))).alias("lx"))
    # the outer form keeps the optimizer from adding (and pushing to the scan) a filter on the array size,
    # which would tokenize every text twice; the array always holds the end mark
    return df.select("script_id", F.posexplode_outer("lx").alias("pos", "raw"))


def token_text(raw: Column) -> Column:
    """Token text of a lexeme (its leading trivia removed)."""
    bare = F.ltrim(raw, F.lit(" \n\t\r"))
    commented = bare.startswith("//") | bare.startswith("/*")
    return F.when(commented, F.regexp_replace(bare, P.LEADING_TRIVIA, "")).otherwise(bare)


def tokenize(scripts: DataFrame, *, spread: bool = True, mode: str = "module", only: Column | None = None) -> DataFrame:
    """``script_id, pos, kind, family, text, newline_before, raw``; the last row of a script is EOF. ``only`` as for ``lexemes``."""
    df = lexemes(scripts, spread=spread, only=only).withColumn("text", token_text(F.col("raw")))
    df = df.withColumn("kind", module_mode(token_kind(F.col("text")), F.lit(mode)))
    lead = F.expr("left(raw, length(raw) - length(text))")
    return df.select(
        "script_id",
        "pos",
        "kind",
        token_family(F.col("kind")).alias("family"),
        "text",
        F.contains(lead, F.lit("\n")).alias("newline_before"),
        "raw",
    )


def module_mode(kind: Column, mode: Column) -> Column:
    """In script mode ``import`` and ``export`` are plain identifiers."""
    return F.when((mode == "script") & kind.isin("IMPORT", "EXPORT"), "IDENTIFIER").otherwise(kind)


@once_per_frame
def token_positions(tokens: DataFrame) -> DataFrame:
    """Adds ``off`` (0-based), ``line`` and ``col`` (1-based, in characters)."""
    raw, text = F.col("raw"), F.col("text")
    size = F.length(raw)
    lead = F.length(raw) - F.length(text)
    newlines = F.length(raw) - F.length(F.translate(raw, "\n", ""))
    own = F.length(text) - F.length(F.translate(text, "\n", ""))
    # characters after the last newline of the lexeme / of its trivia
    after = F.instr(F.reverse(raw), "\n") - 1
    lead_text = F.expr("left(raw, length(raw) - length(text))")
    lead_after = F.instr(F.reverse(lead_text), "\n") - 1
    df = tokens.withColumns(
        {
            "_end": F.sum(size).over(by_pos()),
            "_lines": F.sum(newlines).over(by_pos()),
        }
    )
    last_nl = F.max(F.when(newlines > 0, F.col("_end") - after)).over(by_pos().rowsBetween(Window.unboundedPreceding, -1))
    off = F.col("_end") - F.length(text)
    return df.withColumns(
        {
            "off": off.cast("int"),
            "line": (F.col("_lines") - own + 1).cast("int"),
            "col": F.when(lead_after >= 0, lead_after + 1)
            .otherwise(F.col("_end") - size + lead - F.coalesce(last_nl, F.lit(0)) + 1)
            .cast("int"),
        }
    ).drop("_end", "_lines")


LITERAL_KINDS = ["NUMBER", "STRING", "REGEX", "TRUE", "FALSE", "NULL", "UNDEFINED"]


def literal_values(tokens: DataFrame) -> DataFrame:
    """Values of literal tokens: number, unquoted string, regex pattern and flags, boolean."""
    text, kind = F.col("text"), F.col("kind")
    return tokens.filter(kind.isin(LITERAL_KINDS)).select(
        "script_id",
        "pos",
        F.when(kind.isin("TRUE", "FALSE"), "boolean").otherwise(F.lower(kind)).alias("literal_kind"),
        F.when(kind == "NUMBER", number_value(text)).alias("number_value"),
        F.when(kind == "STRING", unquote(text)).alias("string_value"),
        F.when(kind == "REGEX", F.regexp_extract(text, r"\A/([\s\S]*)/[a-z]*\z", 1)).alias("regex_pattern"),
        F.when(kind == "REGEX", F.regexp_extract(text, r"([a-z]*)\z", 1)).alias("regex_flags"),
        F.when(kind.isin("TRUE", "FALSE"), kind == "TRUE").alias("boolean_value"),
    )


def lex_errors(tokens: DataFrame) -> DataFrame:
    """ERROR tokens with the first of each script marked; a lone backtick is a template that did not close."""
    errors = token_positions(tokens).filter(F.col("kind") == "ERROR")
    return errors.select(
        "script_id",
        "pos",
        "line",
        "col",
        "text",
        F.when(F.col("text") == "`", "template_unparsed").otherwise("bad_character").alias("rule"),
        (F.row_number().over(by_pos()) == 1).alias("is_first"),
    )


def token_counts(tokens: DataFrame) -> DataFrame:
    """Tokens per script up to and including EOF or the first ERROR."""
    first_error = F.min(F.when(F.col("kind") == "ERROR", F.col("pos")))
    per_script = tokens.groupBy("script_id").agg(
        F.count(F.lit(1)).alias("n_all"), first_error.alias("first_error")
    )
    return per_script.select(
        "script_id",
        F.coalesce(F.col("first_error") + 1, F.col("n_all")).cast("long").alias("n_tokens"),
        F.when(F.col("first_error").isNotNull(), "ERROR").otherwise("EOF").alias("last_kind"),
    )


def identifier_freq(tokens: DataFrame) -> DataFrame:
    """Occurrences and scripts per identifier."""
    return (
        tokens.filter(F.col("kind") == "IDENTIFIER")
        # two levels keep the distinct count exact without one group per hot name
        .groupBy("text", "script_id").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(F.col("text").alias("name"))
        .agg(F.sum("n").alias("n_uses"), F.count(F.lit(1)).alias("n_scripts"))
    )


def identifier_topk(tokens: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most frequent identifiers, ties by name."""
    return most_frequent(identifier_freq(tokens), k)


def most_frequent(names: DataFrame, k: int = 20) -> DataFrame:
    return names.orderBy(F.desc("n_uses"), "name").limit(k)


def identifier_cardinality(tokens: DataFrame) -> DataFrame:
    """Number of distinct identifiers per script; exact at no extra cost, as the rows of a script are together already."""
    names = tokens.filter(F.col("kind") == "IDENTIFIER").groupBy("script_id", "text").agg(F.count(F.lit(1)).alias("n"))
    return names.groupBy("script_id").agg(F.count(F.lit(1)).alias("n_distinct"))


def template_segments(tokens: DataFrame) -> DataFrame:
    """Segments of template literals with their cooked-out text and nesting level."""
    kind, text = F.col("kind"), F.col("text")
    step = F.when(kind == "TEMPLATE_HEAD", 1).when(kind == "TEMPLATE_TAIL", -1).otherwise(0)
    level = F.sum(step).over(by_pos()) + F.when(kind.isin("TEMPLATE_TAIL", "TEMPLATE_NO_SUB"), 1).otherwise(0)
    body = F.expr("substring(text, 2, length(text) - 2)")
    inner = F.when(kind.isin("TEMPLATE_HEAD", "TEMPLATE_MIDDLE"), F.expr("substring(text, 2, length(text) - 3)"))
    return (
        tokens.withColumn("level", level.cast("int"))
        .filter(kind.startswith("TEMPLATE"))
        .select("script_id", "pos", "kind", "level", inner.otherwise(body).alias("segment"))
    )
