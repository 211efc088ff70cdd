"""Suppression, spatial joins and positions on skewed data."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sheetweave.functions import geometry as g
from sheetweave.functions.geometry import box
from sheetweave.operators import graph, ordering, spatial, suppression, tilefold
from sheetweave.operators.foldrules import iou_above
from tests import twins

BOXES = "drawing_id long, id long, score double, x1 long, y1 long, x2 long, y2 long"


def crowded_boxes(seed):
    """A third of all boxes are copies of one, another third lies on one spot."""
    rnd, rows = random.Random(seed), []
    for i in range(60):
        rows.append((0, i, rnd.randrange(8) / 8, 10, 10, 40, 30))
    for i in range(60, 120):
        x, y = rnd.randrange(12), rnd.randrange(12)
        rows.append((0, i, rnd.randrange(8) / 8, x, y, x + rnd.randrange(20, 40), y + rnd.randrange(20, 40)))
    for d in (1, 2):
        for i in range(30):
            x, y = rnd.randrange(200), rnd.randrange(200)
            rows.append((d, i, rnd.random(), x, y, x + rnd.randrange(0, 60), y + rnd.randrange(0, 60)))
    return rows


@pytest.mark.parametrize("capacity", [4, 1000])
def test_suppression(spark, partitions, capacity):
    rows = crowded_boxes(5)
    df = spark.createDataFrame(rows, BOXES)
    kept = suppression.suppress(df, iou_above(0.35), capacity)
    have = {(r.drawing_id, r.id) for r in kept.collect()}
    want = {(d, i) for d in (0, 1, 2) for i in twins.nms([(r[1], r[2], r[3:]) for r in rows if r[0] == d], 0.35)}
    assert have == want


@pytest.mark.parametrize("capacity, size", [(1000, 1000), (40, 200)])
def test_suppression_of_a_long_chain(spark, monkeypatch, capacity, size):
    """A chain of boxes in which each hits the next: rounds grow with the tiles, not with the boxes."""
    rounds, run = [], tilefold.run_tiles
    monkeypatch.setattr(tilefold, "run_tiles", lambda *a: rounds.append(1) or run(*a))
    rows = [(0, i, float(size - i), 12 * i, 0, 12 * i + 30, 40) for i in range(size)]
    df = spark.createDataFrame(rows, BOXES)
    kept = suppression.suppress(df, iou_above(0.35), capacity)
    assert {r.id for r in kept.collect()} == set(range(0, size, 2))
    assert len(rounds) <= 2 * size / capacity + 2


@pytest.mark.parametrize("block", [5, 10_000])
def test_pair_join_equals_plain_join(spark, partitions, block):
    """Boxes from points to the whole page, and cells of more rows than a block."""
    rows = crowded_boxes(6) + [(1, 900 + i, 0.5, -50 * i, -9, 400 * i, 300) for i in range(4)] + [(2, 950, 0.1, 60, 60, 60, 60)]
    a = spark.createDataFrame(rows, BOXES).selectExpr("drawing_id", "id a", "x1 a_x1", "y1 a_y1", "x2 a_x2", "y2 a_y2")
    b = spark.createDataFrame(rows, BOXES).selectExpr("drawing_id", "id b", "x1 b_x1", "y1 b_y1", "x2 b_x2", "y2 b_y2")
    near = g.box_gap(box("a_"), box("b_")) <= 15
    grid = spatial.pair_join(a, b, box("a_"), box("b_"), 20, 15, block=block).where(near).select("drawing_id", "a", "b")
    plain = a.join(b, "drawing_id").where(near).select("drawing_id", "a", "b")
    assert sorted(map(tuple, grid.collect())) == sorted(map(tuple, plain.collect()))


def test_page_size_boxes_take_few_cells(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(spatial, "dealt", lambda a, b, on, block: seen.extend((a, b)) or (a, b, on))
    a = spark.createDataFrame([(0, i, i, i, i + 9, i + 9) for i in range(50)] + [(0, 90, 0, 0, 7000, 5000)],
                              "drawing_id long, a long, a_x1 long, a_y1 long, a_x2 long, a_y2 long")
    b = a.selectExpr("drawing_id", "a b", *(f"a_{c} b_{c}" for c in ("x1", "y1", "x2", "y2")))
    assert spatial.pair_join(a, b, box("a_"), box("b_"), 20).where("a = 90 OR b = 90").count() == 101
    assert all(side.count() <= 4 * 2 * 51 for side in seen)


def test_nearest_symbol_of_copies(spark):
    symbols = spark.createDataFrame([(0, i, 10, 10, 20, 20) for i in range(40)] + [(0, 50, 200, 10, 210, 20)],
                                    "drawing_id long, symbol_id long, x1 long, y1 long, x2 long, y2 long")
    texts = spark.createDataFrame(
        [(0, i, 30, 10, 60, 18, "T", 1.0) for i in range(40)] + [(0, 60, 900, 900, 910, 910, "far", 1.0), (0, 61, 10, 10, 20, 20, " ", 1.0)],
        "drawing_id long, text_id long, x1 long, y1 long, x2 long, y2 long, text string, score double")
    got = graph.assign_texts(texts, symbols).collect()
    assert {r.text_id for r in got} == set(range(40)) and {r.symbol_id for r in got} == {0}
    pages = graph.caption_pages(graph.assign_texts(texts, symbols), page_size=16).orderBy("page").collect()
    assert [len(r.captions) for r in pages] == [16, 16, 8]
    assert {r.symbol_id: r.text_id for r in graph.nearest_texts(texts, symbols, top=1).collect()} == {i: 0 for i in range(40)}


def test_path_positions(spark):
    """Points near and very far, ties of members, chains without points and points without chains."""
    rnd = random.Random(11)
    members = [(d, c, m, *(rnd.randrange(300) for _ in range(4))) for d in range(2) for c in range(3) for m in range(12)]
    members += [(0, 0, 12, *members[0][3:])]
    points = [(d, c, rnd.choice([rnd.randrange(300), rnd.randrange(-9000, 9000)]) / 2, rnd.randrange(300) / 2)
              for d in range(2) for c in range(4) for _ in range(12)]
    got = graph.path_positions(
        spark.createDataFrame(members, "drawing_id long, chain_id long, member_pos long, x1 long, y1 long, x2 long, y2 long"),
        spark.createDataFrame(points, "drawing_id long, chain_id long, px double, py double"), ["drawing_id", "chain_id"], 16)
    want = {}
    for d, c, px, py in points:
        start, best = 0.0, None
        for _, _, m, x1, y1, x2, y2 in sorted(r for r in members if r[:2] == (d, c)):
            length = math.hypot(x2 - x1, y2 - y1)
            t = max(0.0, min(1.0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / length ** 2)) if length else 0.0
            off = math.hypot(px - x1 - t * (x2 - x1), py - y1 - t * (y2 - y1))
            if best is None or off < best[0] - 1e-9:
                best = off, m, start + t * length
            start += length
        if best:
            want[d, c, px, py] = best[1:]
    have = {(r.drawing_id, r.chain_id, r.px, r.py): (r.member_pos, r.pos) for r in got.collect()}
    assert have.keys() == want.keys()
    assert all(have[k][0] == want[k][0] and abs(have[k][1] - want[k][1]) < 1e-6 for k in want)


def test_positions_over_partitions(spark, partitions):
    rows = [(0 if i % 3 else 1, (i * 37) % 101, i) for i in range(500)]
    df = spark.createDataFrame(rows, "drawing_id long, value long, id long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = ordering.with_position(df, ["drawing_id"], ["value", "id"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for d in (0, 1):
        want = [r[2] for r in sorted(r for r in rows if r[0] == d)]
        assert [r.id for r in sorted((r for r in placed if r.drawing_id == d), key=lambda r: r.position)] == want


def test_sum_before_in_blocks(spark):
    df = spark.range(20).selectExpr("0L drawing_id", "id position", "id*id value")
    got = ordering.with_sum_before(df, ["drawing_id"], "position", "value", "before", block=3).collect()
    assert {r.position: r.before for r in got} == {i: sum(k * k for k in range(i)) for i in range(20)}


def test_degenerate_geometry(spark):
    row = spark.range(1).selectExpr("5L x1", "5L y1", "5L x2", "5L y2", "8L px", "9L py")
    got = row.select(
        g.point_segment_distance(F.col("px"), F.col("py"), box()).alias("d"), g.segment_length(box()).alias("len"),
        g.iou(box(), box()).alias("iou"), g.cover_share(box(), box()).alias("cover"),
        g.aspect(box()).alias("aspect"), g.clamp_box(box(), F.lit(3), F.lit(3)).x2.alias("cx2"),
        g.point_box_distance(F.col("x1"), F.col("y1"), box()).alias("inside")).first()
    assert tuple(got) == (5.0, 0.0, 0.0, 0.0, 0.0, 3, 0.0)
