"""Joins of tables that grow with the items of drawings."""

from __future__ import annotations

from pyspark.sql import DataFrame


def large(df: DataFrame) -> DataFrame:
    """Marks a side of a join as one to be shuffled and sorted, never broadcast.

    Spark takes an exploded table for as small as the one it comes from, and a written one for as small as
    its compressed files, and would gather millions of rows on the driver to broadcast them.
    """
    return df.hint("merge")
