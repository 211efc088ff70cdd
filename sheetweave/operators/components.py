"""Connected components of a graph given as (drawing_id, a, b) rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetweave.operators.joining import large
from sheetweave.scratch import Scratch

ID_SPAN = 65_536


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replaces the links of one Arrow batch by stars around their lowest node."""
    for links in batches:
        n = len(links)
        ends = pd.DataFrame({
            "drawing_id": np.concatenate([links["drawing_id"], links["drawing_id"]]),
            "node": np.concatenate([links["hi"], links["lo"]])})
        groups = ends.groupby(["drawing_id", "node"], sort=True)
        code = groups.ngroup().to_numpy()
        a, b = code[:n], code[n:]
        label = np.arange(code.max() + 1)
        while True:
            low = np.minimum(label[a], label[b])
            moved = label.copy()
            for side in (a, b):
                np.minimum.at(moved, side, low)
                np.minimum.at(moved, label[side], low)
            moved = moved[moved]
            if (moved == label).all():
                break
            label = moved
        nodes = ends.iloc[np.unique(code, return_index=True)[1]].reset_index(drop=True)
        leaf = np.flatnonzero(label != np.arange(len(label)))
        yield pd.DataFrame({"drawing_id": nodes["drawing_id"].to_numpy()[leaf],
                            "hi": nodes["node"].to_numpy()[leaf],
                            "lo": nodes["node"].to_numpy()[label[leaf]]})


def _contract_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contracts batch after batch together with the stars so far; holds the nodes of one partition."""
    held = None
    for links in batches:
        held = next(_contract(iter([links if held is None else pd.concat([held, links])])))
    if held is not None:
        yield held


def _small_star(links: DataFrame) -> DataFrame:
    """Ties all lower neighbours of a node to the lowest of them."""
    low = links.groupBy("drawing_id", "hi").agg(F.min("lo").alias("low"))
    moved = (links.join(large(low), ["drawing_id", "hi"]).where("lo > low")
             .selectExpr("drawing_id", "lo hi", "low lo"))
    return low.selectExpr("drawing_id", "hi", "low lo").unionByName(moved).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Ties all higher neighbours of a node to the lowest node it knows."""
    both = links.selectExpr("drawing_id", "hi u", "lo v").unionByName(
        links.selectExpr("drawing_id", "lo u", "hi v"))
    low = both.groupBy("drawing_id", "u").agg(F.min("v").alias("low"))
    return (links.selectExpr("drawing_id", "lo u", "hi v").join(large(low), ["drawing_id", "u"])
            .selectExpr("drawing_id", "v hi", "least(u, low) lo").distinct())


def _is_settled(links: DataFrame) -> bool:
    """Every node hangs on one lower node which hangs on none."""
    twice = links.groupBy("drawing_id", "hi").count().where("count > 1").select("drawing_id")
    inner = links.join(large(links.selectExpr("drawing_id", "lo hi")), ["drawing_id", "hi"],
                       "left_semi").select("drawing_id")
    return twice.unionByName(inner).isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """(drawing_id, node, component), the component being its lowest node.

    Links are first contracted within partitions, of which AQE makes few when there
    is little; what crosses partitions is settled by alternating star rounds, of
    which the number grows with the logarithm of the size. Nodes without links are left out.
    """
    scratch = Scratch(links.sparkSession)
    directed = scratch.save(links.where("a <> b")
                            .selectExpr("drawing_id", "greatest(a, b) hi", "least(a, b) lo"))
    spread = (directed.repartition("drawing_id", F.floor(F.col("hi") / ID_SPAN))
              .sortWithinPartitions("drawing_id"))
    current = scratch.save(spread.mapInPandas(_contract_partition, directed.schema))
    while not _is_settled(current):
        following = scratch.save(_small_star(_large_star(current)))
        scratch.forget(current)
        current = following
    return _with_roots(current)


def _with_roots(stars: DataFrame) -> DataFrame:
    roots = stars.selectExpr("drawing_id", "lo node", "lo component").distinct()
    return stars.selectExpr("drawing_id", "hi node", "lo component").unionByName(roots)
