"""Analytics over error logs of lines ``path:line:col: message``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexframe.functions.paths import normalize
from lexframe.operators.blocks import BLOCK, block_number, running_count
from lexframe.sources.workdir import checkpoint

# --- fixed values: the two line formats ----------------------------------------------------------
#: The path holds no colon.
STRICT_LINE = r"^([^:]+):([0-9]+):([0-9]+):(.*)$"
#: The path ends at the first ``:number:number: ``.
LAZY_LINE = r"^(.+?):([0-9]+):([0-9]+): (.+)$"
#: First match wins.
CATEGORIES = ["memory exhausted", "syntax is ambiguous", "unexpected", "end of file"]
# -------------------------------------------------------------------------------------------------


def scan_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a log directory as ``line_no, text``; numbers increase within each input split."""
    lines = spark.read.text(path)
    return lines.select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("text"))


def read_error_log(lines: DataFrame, *, strict_path: bool = False) -> DataFrame:
    """Parses log lines; blank lines are skipped, unparsable ones kept with ``_bad``."""
    text = F.col("text") if strict_path else F.trim("text")
    pattern = STRICT_LINE if strict_path else LAZY_LINE
    kept = lines.filter(F.trim("text") != "").select("line_no", text.alias("text"))

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract("text", pattern, i), F.lit(""))

    return kept.select(
        "line_no",
        part(1).alias("path"),
        part(2).try_cast("int").alias("line"),
        part(3).try_cast("int").alias("col"),
        F.trim(part(4)).alias("message"),
        (~F.col("text").rlike(pattern)).alias("_bad"),
    )


def write_error_log(diagnostics: DataFrame, path: str, mode: str = "append") -> None:
    """Writes diagnostics as text lines, by default after those already there."""
    line = F.format_string("%s:%d:%d: %s", "path", "line", "col", "message")
    diagnostics.select(line.alias("value")).write.mode(mode).text(path)


def error_category(message: Column) -> Column:
    out = F.when(F.contains(message, F.lit(CATEGORIES[0])), CATEGORIES[0])
    for c in CATEGORIES[1:]:
        out = out.when(F.contains(message, F.lit(c)), c)
    return out.otherwise("other")


def error_messages(lines: DataFrame) -> DataFrame:
    """``line_no, message, category``; the message follows the first colon and blank of the line."""
    text = F.trim("text")
    at = F.instr(text, ": ")
    found = lines.filter((at > 0) & (F.length(text) > at + 1))
    message = F.substring(text, at + 2, F.length(text))
    return found.select("line_no", message.alias("message"), error_category(message).alias("category"))


def _counts(messages: DataFrame, key: str) -> DataFrame:
    counted = messages.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line")
    )
    # a one-row subquery, so that the counts are not gathered for the total
    total = counted.agg(F.sum("n").alias("total")).scalar()
    return counted.withColumn("share", F.col("n") * 100.0 / total)


def error_type_counts(lines: DataFrame) -> DataFrame:
    """Count and percentage per message, most frequent first, ties by first occurrence."""
    return _counts(error_messages(lines), "message").orderBy(F.desc("n"), "first_line")


def error_category_counts(lines: DataFrame) -> DataFrame:
    return _counts(error_messages(lines), "category").drop("first_line").orderBy(F.desc("n"), "category")


def error_totals(lines: DataFrame) -> DataFrame:
    """Number of messages and of distinct messages; counting per message first spreads hot messages."""
    per_message = error_messages(lines).groupBy("message").agg(F.count(F.lit(1)).alias("n"))
    return per_message.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_errors"), F.count(F.lit(1)).alias("distinct_messages")
    )


def error_running(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """Running number of errors by line."""
    return running_count(error_messages(lines).select("line_no", "message"), "line_no", block)


def good_entries(lines: DataFrame, *, strict_path: bool) -> DataFrame:
    return read_error_log(lines, strict_path=strict_path).filter(~F.col("_bad")).drop("_bad")


def _by_file(df: DataFrame) -> DataFrame:
    """Adds the key that log entries and files meet by: the path without dot segments."""
    return df.withColumn("_file", normalize(F.col("path")))


def log_with_size(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Log entries with the size of their file; entries without a file are dropped.

    ``files`` has one row per path, so a path with very many entries is split by adaptive skew handling. Of files whose paths differ in
    dot segments only, the largest size counts.
    """
    sizes = _by_file(files).groupBy("_file").agg(F.max("size").alias("size"))
    found = _by_file(good_entries(lines, strict_path=True)).join(sizes, "_file").drop("_file")
    return found.select("path", *[c for c in found.columns if c != "path"])


def log_sorted_by_size(lines: DataFrame, files: DataFrame, *, ascending: bool = False, block: int = BLOCK) -> DataFrame:
    """Log entries ranked by (file size, line number), both descending unless ``ascending``.

    The rank is built from three parts: entries of other sizes, entries of this size in other line blocks,
    and the place within the block.  Only counts per size and per (size, block) are ordered as a whole.
    """
    # read four times below
    df = checkpoint(log_with_size(lines, files).withColumn("_b", block_number("line_no", block)))
    order = F.asc if ascending else F.desc
    per_block = df.groupBy("size", "_b").agg(F.count(F.lit(1)).alias("_n"))
    per_size = per_block.groupBy("size").agg(F.sum("_n").alias("_n"))
    upto = (Window.unboundedPreceding, -1)
    # one row per distinct file size
    sizes = per_size.select(
        "size", F.coalesce(F.sum("_n").over(Window.orderBy(order("size")).rowsBetween(*upto)), F.lit(0)).alias("_other")
    )
    in_size = Window.partitionBy("size").orderBy(order("_b")).rowsBetween(*upto)
    blocks = per_block.select("size", "_b", F.coalesce(F.sum("_n").over(in_size), F.lit(0)).alias("_earlier"))
    place = F.row_number().over(Window.partitionBy("size", "_b").orderBy(order("line_no")))
    ranked = df.withColumn("_place", place).join(blocks, ["size", "_b"]).join(sizes, "size")
    return ranked.select(
        (F.col("_other") + F.col("_earlier") + F.col("_place")).cast("long").alias("rank"),
        "size", "line_no", "path", "line", "col", "message",
    ).orderBy("rank")


def error_files(lines: DataFrame) -> DataFrame:
    """Distinct paths that occur in the log."""
    return good_entries(lines, strict_path=False).select("path").distinct()


def missing_files(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Paths of the log without a file; paths are made distinct before the join."""
    return _by_file(error_files(lines)).join(_by_file(files).select("_file"), "_file", "left_anti").select("path")


def offending_scripts(lines: DataFrame, scripts: DataFrame) -> DataFrame:
    """Scripts of the log, one per base name: the last path in sort order."""
    hit = _by_file(scripts).join(_by_file(error_files(lines)), "_file", "left_semi").drop("_file")
    base = F.regexp_extract("path", r"[^/]*$", 0)
    rest = [c for c in scripts.columns if c != "path"]
    picked = hit.groupBy(base.alias("basename")).agg(
        F.max(F.struct("path", *rest)).alias("s")
    )
    return picked.select("basename", "s.*")


def run_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Scripts newly failing, newly passing and still failing between two verdict tables, each with one row per script."""

    old = before.select("script_id", F.col("verdict").alias("_old"))
    new = after.select("script_id", F.col("verdict").alias("_new"))
    failed, passed = (F.coalesce(F.col(c) == v, F.lit(False)) for c, v in (("_old", "FAIL"), ("_old", "PASS")))
    fails, passes = (F.coalesce(F.col(c) == v, F.lit(False)) for c, v in (("_new", "FAIL"), ("_new", "PASS")))
    change = (
        F.when(fails & ~failed, "newly failing").when(passes & ~passed, "newly passing").when(fails & failed, "still failing")
    )
    return old.join(new, "script_id", "full_outer").select("script_id", change.alias("change")).filter("change is not null")
