"""Order-dependent operators over long sequences, done block by block.

A log or a trace can hold most of the rows of a table, so it is never sorted or folded in one task.
Rows are cut into blocks of consecutive line numbers; each block is worked on alone, and only one small
row per block and key takes part in the sequential step that carries state from block to block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Line numbers per block; unique line numbers bound the rows of a block by it.
BLOCK = 1 << 20


def block_number(order: str, block: int) -> Column:
    return F.floor(F.col(order) / F.lit(block)).cast("long")


def running_count(df: DataFrame, order: str, block: int = BLOCK) -> DataFrame:
    """Adds ``running``: rows up to and including this one in ``order``."""
    df = df.withColumn("_b", block_number(order, block))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # one row per block reaches this window
    offsets = df.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select(
        "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    local = F.row_number().over(Window.partitionBy("_b").orderBy(order))
    return (
        df.withColumn("_local", local)
        .join(offsets, "_b")
        .withColumn("running", (F.col("_before") + F.col("_local")).cast("long"))
        .drop("_b", "_local", "_before")
    )


def carry_last(
    df: DataFrame, keys: list[str], order: str, value: Column, name: str, *, where: Column, block: int = BLOCK
) -> DataFrame:
    """Rows matching ``where`` with the latest non-null ``value`` of earlier rows of the same keys.

    The backward as-of of a row to its own table: exact for any length of a key's sequence.
    """
    df = df.withColumns({"_b": block_number(order, block), "_v": value})
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    between = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    last_of_block = df.groupBy(*keys, "_b").agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_last")
    )
    carried = last_of_block.select(*keys, "_b", F.last("_last", ignorenulls=True).over(between).alias("_carry"))
    carried = carried.filter(F.col("_carry").isNotNull())
    local = df.withColumn("_local", F.last("_v", ignorenulls=True).over(inside)).filter(where)
    return (
        local.join(carried, [*keys, "_b"], "left")
        .withColumn(name, F.coalesce("_local", "_carry"))
        .drop("_b", "_v", "_local", "_carry")
    )
