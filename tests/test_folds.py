"""Order-dependent operators on crowded random drawings, against their SQL, plain twins or properties.

Capacities of a few items cut a drawing into many tiles, so decisions cross them all the time.
"""

import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheetweave.operators import components, foldrules, folds, masks as m
from sheetweave.plans.catalog import iterative
from sheetweave.plans.catalog.registry import SOURCE
from tests import twins

PLACE = ["x1", "y1", "x2", "y2"]


def random_lines(seed, drawings=6, count=60, size=400):
    rnd, rows = random.Random(seed), []
    for d in range(drawings):
        # Drawing 0 holds as many lines as all others together.
        for i in range(count * 3 if d == 0 else count):
            x, y, run = rnd.randrange(size), rnd.randrange(size), rnd.randrange(1, 90)
            tilt = rnd.randrange(-3, 4)
            dx, dy = (run, tilt) if rnd.random() < 0.5 else (tilt, run)
            rows.append((d, i, rnd.choice(["solid", "dashed"]), rnd.choice(["none", "forward", "backward"]),
                         x, y, x + dx, y + dy))
    return rows


@pytest.fixture(scope="module")
def lines(spark):
    rows = random_lines(1)
    return rows, spark.createDataFrame(
        rows, "drawing_id long, line_id long, line_type string, direction string, x1 long, y1 long, x2 long, y2 long")


def by_drawing(rows):
    out = {}
    for row in rows:
        out.setdefault(row[0], []).append(row[1:])
    return out


LINES = ["drawing_id", "line_id", "line_type", "direction", *PLACE]
CAPACITIES = pytest.mark.parametrize("capacity", [9, 1000])


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    cursor = con.execute(sql)
    return {tuple(r) for r in cursor.fetchall()}, [d[0] for d in cursor.description]


@pytest.fixture(scope="module")
def merged(lines):
    """Rows of the SQL of the merge, on lines with long runs of parts in a row added."""
    rows, df = lines
    chance = random.Random(12)
    extra = []
    for d in (0, 3):
        for track in range(2):
            places = list(range(0, 600, 30))
            chance.shuffle(places)
            extra += [(d, 1000 + 100 * track + n, "solid", "none", x, 50 * track + chance.randrange(9), x + 22,
                       50 * track + chance.randrange(9)) for n, x in enumerate(places)]
    frame = pd.DataFrame(rows + extra, columns=LINES)
    want, names = by_sql(SOURCE["it_merge_segments"], lines_v=frame)
    return df.unionByName(df.sparkSession.createDataFrame(extra, df.schema)), want, names


@CAPACITIES
def test_merge_segments(merged, capacity):
    df, want, names = merged
    assert {tuple(r) for r in folds.merge_segments(df, capacity=capacity).select(*names).collect()} == want


@CAPACITIES
def test_dedup_in_tiles(lines, capacity):
    """Lines on a tenth of the page lie on heaps that many tiles share."""
    rows, df = lines
    small = df.selectExpr("drawing_id", "line_id - 5 line_id", *(f"CAST(floor({c}/3) AS BIGINT) {c}" for c in PLACE))
    sql = "WITH RECURSIVE l AS (SELECT drawing_id, line_id, x1, y1, x2, y2 FROM lines_v)," + iterative.DEDUP
    want, _ = by_sql(sql + "SELECT drawing_id, line_id FROM distinct_lines", lines_v=small.toPandas())
    assert {tuple(r) for r in folds.dedup_lines(small, capacity=capacity).select("drawing_id", "line_id").collect()} == want


def gap(a, b):
    """Distance of two segments, by the worse of two matched ends."""
    matched = ((a[:2], b[:2]), (a[2:], b[2:])), ((a[:2], b[2:]), (a[2:], b[:2]))
    return min(max(math.dist(*pair) for pair in pairs) for pairs in matched)


def test_dedup_lines(lines, partitions):
    """No two lines left are near each other; what is dropped has a near line not shorter than itself."""
    rows, df = lines
    left = {tuple(r) for r in folds.dedup_lines(df).select("drawing_id", "line_id").collect()}
    for d, part in by_drawing(rows).items():
        segments = {r[0]: r[3:] for r in part}
        for i, s in segments.items():
            near = [j for j, t in segments.items() if j != i and gap(s, t) < 25.0]
            if (d, i) in left:
                assert not any((d, j) in left for j in near)
            else:
                assert any((length(segments[j]), -j) > (length(s), -i) for j in near)


def length(s):
    return math.hypot(s[2] - s[0], s[3] - s[1])


def test_editor_lines(lines):
    rows, df = lines
    want, names = by_sql(SOURCE["it_merge_editor_lines"], lines_v=pd.DataFrame(rows, columns=LINES))
    got = folds.merge_editor_lines(df, min_length=60.0).select(*names)
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("distance", [30.0, 120.0])
def test_chains(lines, distance, partitions):
    """Paths cover all lines once, hang together from end to end, and cannot take in any later line."""
    rows, df = lines
    source = {(d, r[0]): r[1:] for d, part in by_drawing(rows).items() for r in part}
    found = folds.chain_lines(df, distance).select("drawing_id", "chain_id", "member_pos", "line_id").collect()
    assert sorted((r.drawing_id, r.line_id) for r in found) == sorted(source)
    paths = {}
    for d, chain, place, i in sorted(map(tuple, found)):
        paths.setdefault((d, chain), []).append(i)
        assert place == len(paths[d, chain]) - 1
    def touches(segment, point):
        return min(math.dist(segment[:2], point), math.dist(segment[2:], point)) < distance / 2

    for (d, chain), path in paths.items():
        assert chain == min(path)
        kinds, shapes = zip(*((source[d, i][0], source[d, i][2:]) for i in path))
        assert len(set(kinds)) == 1
        assert all(touches(b, a[2:]) or touches(a, b[:2]) for a, b in zip(shapes, shapes[1:]))
        later = [i for (e, c), other in paths.items() if e == d and c > chain for i in other
                 if source[d, i][0] == kinds[0]]
        assert not any(touches(source[d, i][2:], shapes[0][:2]) or touches(source[d, i][2:], shapes[-1][2:])
                       for i in later)


def test_string_drawings(lines):
    _, df = lines
    named = df.withColumn("drawing_id", F.format_string("sheet-%d", "drawing_id"))
    got = folds.chain_lines(named, 50.0)
    assert got.count() == df.count() and dict(got.dtypes)["drawing_id"] == "string"


WORDS = ["MAIN", "STEAM", "V1001A", "FO", "32", "a", "pump", "IN", "T-204", "low flow", "LINE"]


@pytest.fixture(scope="module")
def texts(spark):
    rnd, rows = random.Random(2), []
    for d in range(5):
        for i in range(90 if d == 0 else 35):
            x, y = rnd.randrange(300), rnd.randrange(40) * 5
            rows.append((d, i, x, y, x + rnd.randrange(5, 60), y + rnd.randrange(6, 20),
                         f" {rnd.choice(WORDS)}  {rnd.choice(WORDS)} " if rnd.random() < 0.3 else rnd.choice(WORDS),
                         rnd.randrange(1000) / 1000))
    pages = spark.createDataFrame([(d, 700) for d in range(5)], "drawing_id long, width long")
    return rows, spark.createDataFrame(
        rows, "drawing_id long, text_id long, x1 long, y1 long, x2 long, y2 long, text string, score double"), pages


def normal(rows):
    return [(r[0], r[1:5], " ".join(r[5].split()), r[6]) for r in rows]


def flat(df):
    return {tuple(r) for r in df.select("drawing_id", "text_id", *PLACE, "text", "score").collect()}


@CAPACITIES
def test_close_texts(texts, capacity):
    rows, df, _ = texts
    want = {(d, i, *b, t, s) for d, part in by_drawing(rows).items()
            for i, b, t, s in twins.close_texts([(r[0], r[1:5], r[5], r[6]) for r in part])}
    assert flat(folds.merge_close_texts(df, capacity=capacity)) == want


@CAPACITIES
def test_rows(texts, capacity):
    rows, df, pages = texts
    want = {(d, i, *b, t, s) for d, part in by_drawing(rows).items() for i, b, t, s in twins.merge_rows(normal(part), 700)}
    assert flat(folds.merge_horizontal(df, pages, capacity)) == want


@CAPACITIES
def test_blocks(texts, capacity):
    rows, df, pages = texts
    want = {(d, i, *b, t, s) for d, part in by_drawing(rows).items() for i, b, t, s in twins.merge_blocks(normal(part))}
    assert flat(folds.merge_vertical(df, pages, capacity)) == want


@CAPACITIES
def test_masks(spark, capacity):
    rnd, rows, runs = random.Random(3), [], []
    for d in range(3):
        for i in range(24):
            x, y, w, h = rnd.randrange(220), rnd.randrange(160), rnd.randrange(3, 40), rnd.randrange(3, 40)
            rows.append((d, i, rnd.randrange(20) / 20))
            for row in range(y, y + h):
                a, b = x + rnd.randrange(3), x + w - rnd.randrange(3)
                if b > a:
                    runs.append((d, i, row, a, b))
    names = ["drawing_id", "mask_id", "y", "x_start", "x_end"]
    masks = spark.createDataFrame(rows, "drawing_id long, mask_id long, score double")
    df = spark.createDataFrame(runs, "drawing_id long, mask_id long, y long, x_start long, x_end long")
    want, order = by_sql(SOURCE["it_merge_masks"], runs_v=pd.DataFrame(runs, columns=names),
                         dets_v=pd.DataFrame(rows, columns=["drawing_id", "det_id", "score"]))
    got = folds.merge_masks(masks, df, m.mask_features(df), capacity=capacity).withColumn("members", F.size("members"))
    assert {tuple(r) for r in got.select(*order).collect()} == want


def test_components_in_rounds(spark, monkeypatch):
    """A long path and a star over many partitions in small batches, settled by star rounds."""
    monkeypatch.setattr(components, "ID_SPAN", 16)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        order = list(range(300))
        random.Random(4).shuffle(order)
        links = [(1, a, b) for a, b in zip(order, order[1:])] + [(2, 5, i) for i in range(6, 90)] + [(3, 8, 9), (3, 9, 8)]
        got = components.connected_components(spark.createDataFrame(links, "drawing_id long, a long, b long"))
        have = {(r.drawing_id, r.node): r.component for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {(1, i): 0 for i in order} | {(2, i): 5 for i in range(5, 90)} | {(3, 8): 8, (3, 9): 8}
    assert have == want


def test_masks_are_put_to_the_test_of_their_overlap_alone(monkeypatch):
    import numpy as np

    from sheetweave.operators import foldrules

    def belongs(box, area, kept, areas, shared):
        return foldrules.same_symbol(box, area, np.array(kept), np.array(areas), np.array(shared), 0.8, 20).tolist()

    box, area = [0, 0, 10, 10], 100
    kept = [[0, 0, 10, 10], [4, 0, 14, 10], [12, 0, 22, 10], [300, 300, 310, 310]]  # the same, over, beside, far off
    areas, shared = [100, 100, 100, 100], [100, 60, 0, 0]
    expected = [True, True, True, False]
    assert belongs(box, area, kept, areas, shared) == expected
    assert [belongs(box, area, [k], [a], [s])[0] for k, a, s in zip(kept, areas, shared)] == expected
    seen, plain = [], foldrules._neighbours
    monkeypatch.setattr(foldrules, "_neighbours", lambda *a: seen.append(len(a[3])) or plain(*a))
    belongs(box, area, kept, areas, shared)
    belongs(box, area, kept[:2], areas[:2], shared[:2])
    assert seen == [2]  # of masks without overlap only


@pytest.mark.parametrize("room", [1, 200, 1 << 20])
def test_near_copies_are_found_for_many_lines_at_once(room):
    rows = [r[4:] for r in random_lines(3, drawings=1, count=50)] + [(5, 5, 5, 5)] * 3
    at = np.array(rows, float).T
    rule = foldrules.NearCopies(25.0)
    near = lambda a, b: min(max(math.dist(a[:2], b[:2]), math.dist(a[2:], b[2:])),
                            max(math.dist(a[:2], b[2:]), math.dist(a[2:], b[:2]))) < 25
    want = {i: [j for j in range(i + 1, len(rows)) if near(rows[i], rows[j])] for i in range(len(rows))}
    found = [(i, later.tolist()) for i, later in rule.copies(*at, room)]
    assert found == [(i, later) for i, later in want.items() if later] and len(found) > 10
    assert list(rule.copies(*at[:, :0], room)) == []


def test_solid_lines_are_looked_up_once(spark, monkeypatch):
    from sheetweave.plans import digitize
    from sheetweave.plans.catalog import QUERIES

    plans = []
    monkeypatch.setattr(digitize.folds, "merge_segments", lambda df: plans.append(df._jdf.queryExecution().toString()) or df)
    assert QUERIES["it_clean_lines"](spark, "/root/testdata/sf0.001").count() > 0
    assert "MapInArrow" not in plans[0]  # the fold reads its items twice
