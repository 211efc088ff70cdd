"""Positions, successors and running sums without a one-task window per drawing.

Rows are sorted over all partitions at once, so a drawing that holds a large
share of the rows is spread over many tasks; only per-partition counts, one row
per partition and group, are brought into order by a window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetweave.operators.joining import large
from sheetweave.scratch import Scratch

BLOCK = 65_536


def with_position(df: DataFrame, keys: list[str], order: list[Column | str],
                  name: str = "position") -> DataFrame:
    """Adds the 0-based place of each row in its group; the order must be total."""
    scratch = Scratch(df.sparkSession)
    placed = scratch.save(df.orderBy(*keys, *order)
                          .withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33).alias("_part")
    pieces = placed.groupBy(*keys, part).agg(F.count("*").alias("_n"), F.min("_row").alias("_low"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    pieces = pieces.select(*keys, "_part", "_low",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    pieces = pieces.withColumnsRenamed({c: f"_k_{c}" for c in (*keys, "_part")})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*keys, "_part")))
    joined = placed.withColumn("_part", F.shiftright("_row", 33)).join(large(pieces), same)
    return (joined.drop(*(f"_k_{c}" for c in (*keys, "_part"))).withColumn(name, F.col("_before") + F.col("_row") - F.col("_low"))
            .drop("_row", "_part", "_low", "_before"))


def with_successor(df: DataFrame, keys: list[str], position: str, columns: list[str],
                   prefix: str = "next_", how: str = "inner") -> DataFrame:
    """Joins each row with the one at the next position of its group."""
    following = df.select(*keys, (F.col(position) - 1).alias(position),
                          *(F.col(c).alias(prefix + c) for c in columns))
    return df.join(large(following), [*keys, position], how)


def with_sum_before(df: DataFrame, keys: list[str], position: str, value: str,
                    name: str, block: int = BLOCK) -> DataFrame:
    """Adds the sum of the values at all earlier positions of the group."""
    blocked = df.withColumn("_block", F.floor(F.col(position) / block))
    sums = blocked.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_block",
                       F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(
        Window.unboundedPreceding, -1)
    return (blocked.join(large(sums), [*keys, "_block"])
            .withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .drop("_block", "_base"))
