"""Work once per shape of text: scripts that differ in digits only share their tokens, offsets and structure.

The lexer never tells the digits of a run apart that starts with 1 to 9: such a run is consumed whole by whatever token reaches it
(number, name, string, template, regex literal, comment), and no keyword holds a digit. Masking these digits, one for one, keeps every token
boundary, kind, line, column and bracket. So what depends on nothing else is found once per masked text and joined back to all scripts
of it; texts with digits are cut out of the script at the offsets of the shape. Runs that start with 0 (octal, hexadecimal) are left as they are.

Exact copies, generated modules and versions of a bundle are most of what a large collection holds; they come down to a row each. Scripts
longer than ``LONGEST``, without a text or whose id is null or not unique are worked on as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexframe.operators.tokens import read_text, token_positions, tokenize
from lexframe.sources.workdir import written

#: Characters; cutting a token out of a text reads the text up to it.
LONGEST = 4096
_DIGITS = r"(?<![0-9])[1-9]|(?<!^)\G[0-9]"


def masked(src: Column) -> Column:
    """The text with every digit of a run that starts with 1 to 9 replaced by 1."""
    return F.regexp_replace(src, _DIGITS, "1")


class Parts(NamedTuple):
    alone: DataFrame  #: scripts worked on as they are
    members: DataFrame  #: the others, with the key of their ``shape``; ``src`` as it is tokenized
    shapes: DataFrame  #: ``script_id`` (that key), ``src`` (the masked text), ``size``


def parts(scripts: DataFrame) -> Parts:
    """Every script is in ``alone`` or in ``members``."""
    counted = scripts.groupBy("script_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = written(counted.filter((F.col("n") > 1) & F.col("script_id").isNotNull()).select("script_id"), "repeated")
    short = F.coalesce((F.length("src") <= LONGEST) & F.col("script_id").isNotNull(), F.lit(False))
    members = scripts.filter(short).join(repeated, "script_id", "left_anti").select(*scripts.columns, masked(F.col("src")).alias("_masked"))
    members = members.withColumn("shape", F.sha2("_masked", 256))
    shapes = members.select(F.col("shape").alias("script_id"), F.col("_masked").alias("src")).distinct()
    shapes = written(shapes.withColumn("size", F.length("src").cast("long")), "shapes")
    alone = scripts.filter(~short).unionByName(scripts.filter(short).join(repeated, "script_id", "left_semi").select(*scripts.columns))
    return Parts(alone, members.withColumn("src", read_text(F.col("src"))).drop("_masked"), shapes)


def expanded(split: Parts, rows: DataFrame, *columns: str | Column, how: str = "inner") -> DataFrame:
    """Rows of shapes for each of their scripts, with these columns."""
    return split.members.join(rows.withColumnRenamed("script_id", "shape"), "shape", how).select(*columns)


def _off_and_size(tokens: DataFrame) -> DataFrame:
    """Where the texts with digits stand; all others are the same in every script of the shape."""
    return token_positions(tokens).filter(F.contains("text", F.lit("1"))).select("script_id", F.col("pos").alias("_at"), "off", F.length("text").alias("len"))


def _cut(name: str) -> Column:
    return F.when(F.col("off").isNull(), F.col(name)).otherwise(F.substring("src", F.col("off") + 1, F.col("len"))).alias(name)


def per_shape(scripts: DataFrame, find: Callable[[DataFrame], DataFrame], *, text: str | None = None, at: str | None = None) -> DataFrame:
    """The rows ``find`` makes of tokens, one script at a time, for all scripts.

    ``find`` may look at digits only through ``text``: the column that holds the text of the token number ``at`` (dropped in the end).
    """
    split = parts(scripts)
    alone = find(tokenize(split.alone))
    tokens = tokenize(split.shapes)
    rows = find(tokens)
    columns = [c for c in rows.columns if c != at]
    if text is None:
        return alone.unionByName(expanded(split, written(rows, "found"), *columns))
    found = rows.withColumnRenamed(at, "_at").join(_off_and_size(tokens), ["script_id", "_at"], "left").drop("_at")
    return alone.drop(at).unionByName(expanded(split, written(found, "found"), *[_cut(c) if c == text else c for c in columns]))


_TOKEN = ["script_id", "pos", "kind", "family", "text", "newline_before"]


def _shape_tokens(split: Parts, kinds: list[str] | None) -> DataFrame:
    tokens = token_positions(tokenize(split.shapes))
    digits = F.contains("text", F.lit("1"))
    found = tokens if kinds is None else tokens.filter(F.col("kind").isin(kinds))
    return written(found.select(*_TOKEN, F.when(digits, F.col("off")).alias("off"), F.when(digits, F.length("text")).alias("len")), "found")


def token_rows(scripts: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """``script_id, pos, kind, family, text, newline_before`` of all tokens or of some kinds."""
    split = parts(scripts)
    alone = tokenize(split.alone)
    if kinds is not None:
        alone = alone.filter(F.col("kind").isin(kinds))
    return alone.select(*_TOKEN).unionByName(
        expanded(split, _shape_tokens(split, kinds), *[_cut(c) if c == "text" else c for c in _TOKEN])
    )


def identifier_freq(scripts: DataFrame) -> DataFrame:
    """Occurrences and scripts per identifier: names without digits are counted by shape, the others by script."""
    split = parts(scripts)
    alone = tokenize(split.alone).filter(F.col("kind") == "IDENTIFIER").select("script_id", "text")
    rows = _shape_tokens(split, ["IDENTIFIER"])
    n = F.count(F.lit(1))
    sizes = split.members.groupBy("shape").agg(n.alias("_members"))
    by_shape = rows.filter("off is null").groupBy("script_id", "text").agg(n.alias("n")).withColumnRenamed("script_id", "shape")
    same = by_shape.join(sizes, "shape").select("text", (F.col("n") * F.col("_members")).alias("n"), F.col("_members").alias("m"))
    own = expanded(split, rows.filter("off is not null"), "script_id", _cut("text"))
    by_script = alone.unionByName(own).groupBy("text", "script_id").agg(n.alias("n")).select("text", "n", F.lit(1).alias("m"))
    return by_script.unionByName(same).groupBy(F.col("text").alias("name")).agg(F.sum("n").alias("n_uses"), F.sum("m").alias("n_scripts"))
