"""Connected components of links between long ids, by star rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sheetweave.llm.store import Store


def _stars(links: DataFrame) -> DataFrame:
    """One large star and one small star: neighbours move to the lowest node in sight.

    Minima combine before the shuffle; the joins back are split at hot nodes by AQE."""
    both = links.selectExpr("hi u", "lo v").unionByName(links.selectExpr("lo u", "hi v"))
    low = both.groupBy("u").agg(F.min("v").alias("low"))
    large = (links.selectExpr("lo u", "hi v").join(low, "u")
             .selectExpr("v hi", "least(u, low) lo").distinct())
    least = large.groupBy("hi").agg(F.min("lo").alias("low"))
    moved = large.join(least, "hi").where("lo > low").selectExpr("lo hi", "low lo")
    return least.selectExpr("hi", "low lo").unionByName(moved).distinct()


def components(store: Store, links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b); a component is its lowest node.

    The number of rounds grows with the logarithm of the longest path. Loops end when a
    round leaves the table as it was."""
    current = store.save(links.where("a <> b").selectExpr("greatest(a, b) hi", "least(a, b) lo").distinct())
    mark = None
    while True:
        found = current.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if found == mark or found[0] == 0:
            break
        mark = found
        following = store.save(_stars(current))
        store.forget(current)
        current = following
    roots = current.selectExpr("lo node", "lo component").distinct()
    return current.selectExpr("hi node", "lo component").unionByName(roots)
