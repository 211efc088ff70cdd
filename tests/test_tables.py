"""Documents, ink, edits, clusters and incremental work."""

import json
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheetweave.operators import graph, clusters, editlog, ink, masks, prompts
from sheetweave.sources import readers, sinks
from sheetweave.sources.fixtures import Fixtures
from sheetweave.streaming import ingest


def test_readers_of_mixed_documents(spark, tmp_path):
    (tmp_path / "a_step4_lines.json").write_text(json.dumps({
        "solid": [[0, 0, 5, 5], {"line": [1, 1, 9, 1], "direction": "forward"}, {"line": [2, 2, 3, 3]}],
        "dashed": [[7, 7, 8, 8]], "scale": 8.08}, indent=2))
    docs = readers.documents(spark, str(tmp_path))
    lines = readers.parse_lines(docs).orderBy("line_id").collect()
    assert [(r.drawing_id, r.line_id, r.line_type, r.direction, r.x2) for r in lines] == [
        ("a", 0, "solid", "none", 5), ("a", 1, "solid", "forward", 9), ("a", 2, "solid", "none", 3), ("a", 3, "dashed", "none", 8)]
    head = readers.parse_line_header(docs).first()
    assert head.scale == 8.08 and head.resized_width is None and head.target_width is None


def documents(spark, **values):
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in values.items()], "drawing_id string, value string")


def test_readers_of_defaults(spark):
    docs = documents(spark, list=[{"bbox": [1, 2, 3, 4], "text": "A", "score": 0.5}, {"bbox": [1, 2, 3, 4]}],
                     wrapped={"detections": [{"bbox": [1, 2, 3, 4], "text": "B"}]}, other={"x": 1})
    assert {(r.drawing_id, r.text, r.score) for r in readers.parse_texts(docs).collect()} == {("list", "A", 0.5), ("wrapped", "B", 1.0)}
    assert {r.drawing_id for r in readers.parse_texts(docs, wrapped=False).collect()} == {"list"}
    found = readers.parse_detections(documents(spark, d={"masks_info": [
        {"id": 0, "score": 1, "area": 4, "bbox": [0, 0, 2, 2]}, {"id": None, "bbox": [0, 0, 1, 1]}, {"id": 3, "bbox": []}, {"id": 4}]}))
    assert [r.det_id for r in found.collect()] == [0]
    rows = documents(spark, d=[["symbol_1", [1, 1, 2, 2], "valve", [3, 3, 4, 4]], ["symbol_2", "pump"], [[5, 5, 6, 6]]])
    assert [(r.ann_id, r.x1, r.symbol_type) for r in readers.parse_annotations(rows).orderBy("ann_id").collect()] == [(0, 3, "valve"), (2, 5, None)]
    assert readers.parse_annotations(rows, first_box=True).orderBy("ann_id").first().x1 == 1


def test_documents_in_parts(spark):
    nodes = spark.range(5).selectExpr("7L drawing_id", "id symbol_id", "0 page", "'pump' category", "array('a', 'b') captions")
    links = spark.createDataFrame([(7, 0, 1, 2, "solid", "bidirectional"), (7, 1, 2, 3, "dashed", "none")],
                                  "drawing_id long, link_id long, source long, target long, type string, used string")
    links = links.withColumn("quality", F.struct(F.col("used").alias("direction_used")))
    whole = [json.loads(r.value) for r in sinks.compact_graph(nodes, links).collect()]
    assert whole == [{"nodes": [{"id": i, "category": "pump", "captions": ["a", "b"]} for i in range(5)],
                      "links": [{"from": 1, "to": 2, "type": "solid", "bidirectional": True}, {"from": 2, "to": 3, "type": "dashed"}]}]
    parts = {r.part: json.loads(r.value) for r in sinks.compact_graph(nodes, links, part_size=2).collect()}
    assert {p: [n["id"] for n in d["nodes"]] for p, d in parts.items()} == {0: [0, 1], 1: [2, 3], 2: [4]}


def test_parts_go_by_place(spark):
    """Ids far apart stay in one document, and parts are filled in order of the ids."""
    ids = [0, 60_000, 9_000_000, -5, 2**62]
    nodes = spark.createDataFrame([(7, i) for i in ids], "drawing_id long, symbol_id long").selectExpr(
        "drawing_id", "symbol_id", "0 page", "'pump' category", "array('a') captions")
    whole = sinks.compact_graph(nodes).collect()
    assert [r.part for r in whole] == [0]
    assert [n["id"] for n in json.loads(whole[0].value)["nodes"]] == sorted(ids)
    parts = {r.part: [n["id"] for n in json.loads(r.value)["nodes"]] for r in sinks.compact_graph(nodes, part_size=2).collect()}
    assert parts == {0: sorted(ids)[:2], 1: sorted(ids)[2:4], 2: sorted(ids)[4:]}


def test_first_lines_by_place(spark):
    lines = spark.createDataFrame([(d, 100 + 7 * i, i) for d in (1, 2) for i in range(30)], "drawing_id long, line_id long, i long")
    assert sorted((r.drawing_id, r.i) for r in graph.first_lines(lines).collect()) == [(d, i) for d in (1, 2) for i in range(10)]


def test_edits_keep_their_columns(spark):
    """Whole numbers beyond 2**53 beside nulls come back as they were."""
    big = 2**53 + 1
    log = spark.createDataFrame([(1, 0, "set", big), (1, 1, "set", None), (1, 2, "undo", None), (1, 3, "set", big + 2)],
                                "drawing_id long, seq long, op string, value long")
    assert sorted(map(tuple, editlog.surviving_edits(log).collect())) == [(1, 0, "set", big), (1, 3, "set", big + 2)]


def test_erase_long_runs(spark):
    rnd = random.Random(8)
    runs = [(0, y, s, s + rnd.randrange(1, 150)) for y in range(12) for s in (rnd.randrange(100),)]
    boxes = [(0, x, y, x + rnd.randrange(0, 30), y + rnd.randrange(0, 5)) for x, y in ((rnd.randrange(200), rnd.randrange(12)) for _ in range(15))]
    left = ink.erase(spark.createDataFrame(runs, "drawing_id long, y long, x_start long, x_end long"),
                     spark.createDataFrame(boxes, "drawing_id long, x1 long, y1 long, x2 long, y2 long"), 1)
    have = [(r.y, x) for r in left.collect() for x in range(r.x_start, r.x_end)]
    want = [(y, x) for _, y, s, e in runs for x in range(s, e)
            if not any(b[1] - 1 <= x <= b[3] + 1 and b[2] - 1 <= y <= b[4] + 1 for b in boxes)]
    assert sorted(have) == sorted(want)


@pytest.mark.parametrize("block", [7, 1000])
def test_undo_redo(spark, partitions, block):
    """Logs cut into blocks, against one pass over the whole; drawing 2 has no id."""
    rnd = random.Random(9)
    log = [(None if d == 2 else d, i, rnd.choice(["set", "set", "undo", "undo", "redo", None])) for d in range(3) for i in range(200)]
    have = {(r.drawing_id, r.seq) for r in editlog.surviving_edits(
        spark.createDataFrame(log, "drawing_id long, seq long, op string"), 4, block).collect()}
    want = set()
    for d in (0, 1, None):
        applied, depth, undone = [], 0, []
        for _, seq, op in (e for e in log if e[0] == d):
            if op == "undo":
                if depth:
                    undone.append(applied.pop())
                    depth -= 1
            elif op == "redo":
                if undone:
                    applied.append(undone.pop())
                    depth = min(depth + 1, 4)
            else:
                applied.append(seq)
                depth, undone = min(depth + 1, 4), []
        want |= {(d, s) for s in applied}
    assert have == want


def test_density_clusters(spark):
    rnd = random.Random(10)
    points = [(i, rnd.gauss(c, 0.5), rnd.gauss(c, 0.5)) for i in range(90) for c in ((0, 6)[i % 2],)]
    points += [(100 + i, 0.05, 0.05) for i in range(60)] + [(200, 50.0, 50.0)]
    eps, need, steps = 1.0, 4, 4
    got = {r.row_id: r.cluster_id for r in clusters.density_clusters(
        spark.createDataFrame(points, "row_id long, px double, py double"), "row_id", eps, need, 5, steps).collect()}
    cell = {i: (x // (eps / steps), y // (eps / steps)) for i, x, y in points}
    near = {i: [j for j in cell if (cell[i][0] - cell[j][0]) ** 2 + (cell[i][1] - cell[j][1]) ** 2 <= steps**2] for i in cell}
    core = {i for i in cell if len(near[i]) >= need}
    groups, seen = [], set()
    for i in core:
        if i not in seen:
            stack, group = [i], set()
            while stack:
                k = stack.pop()
                if k not in group:
                    group.add(k)
                    stack += [j for j in near[k] if j in core]
            seen |= group
            groups.append(group)
    want = {frozenset(x) for x in groups if len(x) >= 5}
    have = {}
    for i, c in got.items():
        have.setdefault(c, set()).add(i)
    noise = have.pop(-1)
    assert {frozenset(x) for x in have.values()} == want and 200 in noise and len(got) == len(points)


def test_kmeans_and_elbow(spark):
    rows = spark.range(60).selectExpr("id", "array(CAST(id%3*10 + id/100 AS FLOAT), CAST(id%3 AS FLOAT)) e")
    found = clusters.kmeans(rows, "e", 3, restarts=2).groupBy("cluster_id").count().collect()
    assert sorted(r["count"] for r in found) == [20, 20, 20]
    assert clusters.cluster(rows, "e", "low").groupBy("cluster_id").count().count() >= 3
    costs = spark.createDataFrame([(2, 100.0), (3, 40.0), (4, 30.0), (5, 25.0)], "k long, inertia double")
    assert clusters.elbow(costs).first().k == 4
    assert clusters.largest_k(30) == 10 and clusters.density_parameters(1000) == (20, 10)


def test_many_models(spark, partitions):
    """Costs and assignments of all models against numpy; rows without a vector have no cluster."""
    chance = np.random.default_rng(6)
    x = chance.normal(size=(200, 4)) + 6 * np.eye(4)[chance.integers(0, 4, 200)]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, e array<double>").repartition(5)
    runs = [(k, s) for k in (1, 3, 4, 7) for s in (1, 2)]
    models, costs = clusters.fit_many(rows, "e", runs, passes=60)
    for n, (k, _) in enumerate(runs):
        centres = models.of(n)
        far = ((x[:, None] - centres) ** 2).sum(axis=2)
        assert len(centres) == k and costs[n] == pytest.approx(far.min(axis=1).sum())
        means = np.array([x[far.argmin(axis=1) == j].mean(axis=0) for j in range(k)])
        assert np.allclose(means, centres, atol=1e-3)
    found = {r.id: r.cluster_id for r in clusters.kmeans(rows, "e", 4, restarts=3).collect()}
    assert found.pop(900) is None and len(set(found.values())) == 4
    own = np.array([found[i] for i in range(200)])
    means = np.array([x[own == j].mean(axis=0) for j in range(4)])
    assert (((x[:, None] - means) ** 2).sum(axis=2).argmin(axis=1) == own).all()


def test_negative_points_are_free(spark):
    symbols = spark.createDataFrame([(0, i, 30 * i, 30, 30 * i + 20, 50) for i in range(5)] + [(1, 0, 0, 0, 40, 40)],
                                    "drawing_id long, symbol_id long, x1 long, y1 long, x2 long, y2 long")
    pages = spark.createDataFrame([(0, 200, 120), (1, 40, 40)], "drawing_id long, width long, height long")
    runs = symbols.selectExpr("drawing_id", "symbol_id mask_id", "explode(sequence(y1, y2-1)) y", "x1 x_start", "x2 x_end")
    points = prompts.negative_points(symbols, pages, runs, 2)
    assert points.count() == 12
    bad = {r.drawing_id: (r.points, r.on_mask) for r in prompts.count_on_masks(points, runs).collect()}
    # The second page is all symbol: only the last resort is left there.
    assert bad == {0: (10, 0), 1: (2, 2)}


def test_runs_are_repeatable(spark, tmp_path):
    path = str(tmp_path / "out")
    drawings = spark.range(10).withColumnRenamed("id", "drawing_id")
    stage = (lambda rows: rows.withColumn("done", F.lit(True)))
    ingest.run_missing(drawings.where("drawing_id < 4"), stage, path, "a")
    ingest.run_missing(drawings.where("drawing_id < 4"), stage, path, "a")
    assert ingest.run_missing(drawings, stage, path, "b").count() == 6
    assert sorted(r.drawing_id for r in spark.read.parquet(path).collect()) == list(range(10))


def test_results_of_a_run_that_died(spark, tmp_path):
    """Results that no manifest names are not seen, whoever does the drawings next; compaction keeps all."""
    path = str(tmp_path / "out")
    drawings = spark.createDataFrame([(i,) for i in (1, 2, 3, None)], "drawing_id long")
    stage = (lambda rows: rows.withColumn("done", F.lit(True)))
    stage(drawings).write.parquet(f"{path}/run=died")
    for run in ("b", "c"):
        ingest.run_missing(drawings, stage, path, run)
    ingest.compact(spark, path)
    ingest.run_missing(drawings.union(spark.createDataFrame([(9,)], "drawing_id long")), stage, path, "d")
    rows = ingest.results(spark, path).collect()
    assert sorted(((r.drawing_id, r.run) for r in rows), key=repr) == [(1, "b"), (2, "b"), (3, "b"), (9, "d"), (None, "b")]


def test_packed_documents(spark, tmp_path):
    path = str(tmp_path / "docs")
    docs = spark.createDataFrame([(f"sheet {i}", p, f'{{"n": {i}}}') for i in range(300) for p in range(2)],
                                 "drawing_id string, part long, value string").repartition(7)
    sinks.write_packed(docs, path, 4)
    assert len(list((tmp_path / "docs").rglob("*.parquet"))) == 4
    assert sorted(map(tuple, sinks.read_packed(spark, path, buckets=4).collect())) == sorted(map(tuple, docs.collect()))
    one = sinks.read_packed(spark, path, "sheet 17", 4)
    assert sorted(map(tuple, one.collect())) == [("sheet 17", p, '{"n": 17}') for p in range(2)]
    assert len(one.inputFiles()) == 4 and "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString()


def test_drawings_without_results_are_done(spark, tmp_path):
    path = str(tmp_path / "out")
    drawings = spark.range(6).withColumnRenamed("id", "drawing_id")
    stage = (lambda rows: rows.where("drawing_id % 2 = 0"))
    assert ingest.run_missing(drawings, stage, path, "a").count() == 6
    assert ingest.run_missing(drawings, stage, path, "b").count() == 0
    assert sorted(r.drawing_id for r in spark.read.parquet(path).collect()) == [0, 2, 4]


def test_stream_takes_up_new_files(spark, tmp_path):
    docs, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(*ids):
        sinks.write_documents(spark.createDataFrame(
            [(i, 0, '{"solid": [[0, 0, 1, 1]], "dashed": []}') for i in ids], "drawing_id long, part long, value string"), docs)
        stream = ingest.stream_documents(spark, docs)
        ingest.follow(stream, readers.parse_lines, out, str(tmp_path / "progress")).awaitTermination()
        return sorted(r.drawing_id for r in spark.read.parquet(out).collect())

    assert arrive(1, 2) == [1, 2]
    assert arrive(3) == [1, 2, 3]


def test_a_results_document_is_parsed_once_and_not_for_each_entry(spark):
    from sheetweave.plans.catalog import QUERIES

    plan = QUERIES["sink_results_json"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    generate = next(n for n, line in enumerate(plan) if "Generate explode" in line)
    assert not any("from_json" in line for line in plan[:generate])
    assert sum(line.count("from_json(") for line in plan[generate:]) == 2  # the counter and the entries


@pytest.mark.parametrize("sampling", [ink.Sampling(), ink.Sampling(half=2), ink.Sampling(None, 3, 2, whole=True)])
def test_points_are_made_in_portions_and_near_the_square_alone(monkeypatch, sampling):
    draw = random.Random(5)
    lines = np.array([[draw.randrange(-300, 1500) for _ in range(4)] for _ in range(60)] + [[7, 7, 7, 7], [0, 0, 40000, 0]])
    monkeypatch.setattr(ink, "POINTS", 4000)
    sizes = sampling.counts(lines) * sampling.across
    portions = sampling.portions(lines)
    assert [n for a, b in portions for n in range(a, b)] == list(range(len(lines)))
    assert all(b == a + 1 or sizes[a:b].sum() < 4000 + sizes[a:b].max() for a, b in portions)
    assert sampling.portions(lines[:0]) == []
    every = list(zip(*(c.tolist() for c in sampling.points(lines))))
    squares = {(r, x // ink.TILE, y // ink.TILE) for r, _, x, y in every}
    row, _, x, y = sampling.points(lines)
    assert list(zip(*(c.tolist() for c in ink._squares(row, x // ink.TILE, y // ink.TILE)))) == sorted(squares)
    for tx, ty in {s[1:] for s in squares}:
        there = lambda p: p[2] // ink.TILE == tx and p[3] // ink.TILE == ty
        near = list(zip(*(c.tolist() for c in sampling.points(lines, (tx, ty)))))
        assert list(filter(there, near)) == list(filter(there, every)) and len(near) < len(every)


def test_hits_of_chains_are_found_once_for_all_counters(spark):
    from sheetweave.plans.catalog import QUERIES

    plan = QUERIES["agg_metadata"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "cell_x" not in plan  # the join of lines and symbols by cells is behind a written table


@pytest.mark.parametrize("share, batch", [(8192, "10000"), (3, "7")])
def test_squares_are_looked_at_together_whatever_the_batch(spark, monkeypatch, share, batch):
    """Long runs over several squares, repeated and overlapping ink, lines beyond the page, crowded squares and tiny batches."""
    draw = random.Random(9)
    lines = [(d, n, *(draw.randrange(-40, 700) for _ in range(4))) for d in (1, 2, 5) for n in range(40)] + [(3, 0, 1, 1, 9, 9)]
    ink_runs = [(d, y, a, a + draw.choice([0, 1, 5, 300, 600])) for d in (1, 2, 4) for y in range(-3, 640)
                for a in (draw.randrange(-20, 600), draw.randrange(-20, 600))] * 2 + [(None, 1, 0, 5)]
    pages = {1: (600, 500), 2: (640, 640), 5: (600, 600)}
    held = spark.createDataFrame(lines, "drawing_id long, line_id long, x1 long, y1 long, x2 long, y2 long")
    held_ink = spark.createDataFrame(ink_runs, "drawing_id long, y long, x_start long, x_end long")
    held_pages = spark.createDataFrame([(d, *s) for d, s in pages.items()], "drawing_id long, width long, height long")
    black = {(d, x, y) for d, y, a, b in ink_runs for x in range(a, b)}
    monkeypatch.setattr(ink, "SHARE", share)
    saved, save = [], ink.Scratch.save
    monkeypatch.setattr(ink.Scratch, "save", lambda self, df: saved.append([t for _, t in df.dtypes]) or save(self, df))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = {(r[0], r[1]): r for r in ink.solid_stats(held, held_ink, held_pages).collect()}
        bands = {(r[0], r[1]): r for r in ink.band_scores(held, held_ink, held_pages).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert saved and not any(t.startswith("array") for table in saved for t in table)  # the ink of a square was a row once
    assert set(found) == set(bands) == {(d, n) for d, n, *_ in lines if d in pages}
    for d, n, *place in lines:
        if d not in pages:
            continue
        on_page = lambda x, y: 0 <= x < pages[d][0] and 0 <= y < pages[d][1]
        _, _, xs, ys = ink.Sampling(80).points(np.array([place]))
        flags = [(d, x, y) in black for x, y in zip(xs.tolist(), ys.tolist()) if on_page(x, y)]
        gap = max(map(len, "".join("01"[f] for f in flags).split("1")))
        flips = sum(a != b for a, b in zip(flags, flags[1:]))
        expected = (sum(flags) / len(flags), gap, flips) if len(flags) >= 10 else (0.0, 999, 999)
        assert tuple(found[d, n])[2:] == expected
        _, _, xs, ys = ink.Sampling(80, half=2).points(np.array([place]))
        there = [on_page(x, y) for x, y in zip(xs.tolist(), ys.tolist())]
        hits = [t and (d, x, y) in black for t, x, y in zip(there, xs.tolist(), ys.tolist())]
        middle = hits[2::5]
        assert tuple(bands[d, n])[2:] == (sum(hits) / max(sum(there), 1), sum(a != b for a, b in zip(middle, middle[1:])))


def test_tasks_of_a_union_grow_with_the_runs(spark, monkeypatch):
    rows = [(d, m, y, 3 * m, 3 * m + 5) for d in range(4) for m in range(6) for y in range(50)]
    runs = spark.createDataFrame(rows, "drawing_id long, mask_id long, y long, x_start long, x_end long")
    listed = spark.createDataFrame([(d, m, 0.5, m // 3) for d in range(4) for m in range(6)],
                                   "drawing_id long, mask_id long, score double, group_id long")
    monkeypatch.setattr(masks, "SHARE", 100)
    merged, features = masks.union_masks(runs, listed, "group_id")
    assert merged.rdd.getNumPartitions() == 12  # 1,200 runs, which no later step gathers again
    assert {tuple(r) for r in features.collect()} == {
        (d, g, 9 * g, 0, 9 * g + 11, 50, 550, 0.5, 0.5, 3) for d in range(4) for g in range(2)}
    none = masks.union_masks(runs.where("false"), listed, "group_id")[1]
    assert none.count() == 0


def test_pages_are_made_in_several_tasks(spark):
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    rows = fx.pixel_rows.withColumn("task", F.spark_partition_id())
    made = rows.groupBy("drawing_id").agg(F.collect_set("task").alias("tasks"), F.count_distinct("y").alias("n")).collect()
    assert len({t for r in made for t in r.tasks}) == len(made) == 2 and {r.n for r in made} == {1100}  # one task once
    grey = "transform(sequence(0L, 1599L), x -> CAST((x*13+y*7+drawing_id*5)%256 AS SMALLINT))"
    assert rows.where(f"NOT grey <=> {grey}").count() == 0
    assert fx.dealt_runs.exceptAll(fx.runs).count() == 0 == fx.runs.exceptAll(fx.dealt_runs).count()


@pytest.mark.parametrize("share, block, near, batch", [(1_000_000, 1 << 18, 64, "10000"), (300, 40, 2, "7")])
def test_pixels_are_read_by_pieces_near_masks(spark, monkeypatch, share, block, near, batch):
    """Runs beyond the row and beyond all arrays, equal and empty runs, rows without pixels, null pixels, wide values."""
    draw = random.Random(4)
    runs = [(d, draw.choice([None, 0, 1, 2, 3]), draw.randrange(-2, 70), a, a + draw.choice([-3, 0, 1, 30, 90]))
            for d in (1, 2, 3) for a in draw.choices(range(-40, 500), k=400)]
    runs += [*runs[:9], (1, 7, 3, -2**62, 2**62), (1, 8, 4, 2**40, 2**41), (None, 1, 1, 0, 5), (1, 1, None, 0, 5), (1, 1, 1, None, 5)]
    grey = [(d, y, draw.choice([None, [], *[[draw.choice([None, -3, 239, 240, 241, 30000]) for _ in range(w)] for w in (1, 260, 600)]]))
            for d in (1, 2, 4) for y in range(-2, 66)]
    grey += [(2, 5, [9] * 50), (None, 1, [1]), (1, None, [1])]
    for name, value in (("SHARE", share), ("BLOCK", block), ("NEAR", near)):
        monkeypatch.setattr(masks, name, value)
    held = spark.createDataFrame(runs, "drawing_id long, mask_id long, y long, x_start long, x_end long")
    rows = spark.createDataFrame(grey, "drawing_id long, y long, grey array<smallint>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        stats = masks.pixel_stats(held, rows)
        found = {(r[0], r[1]): tuple(r)[2:] for r in stats.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    under = {}
    for d, m, y, a, b in runs:
        for page, row, values in grey:
            if None not in (d, y, a) and (d, y) == (page, row) and values:
                under.setdefault((d, m), []).extend(v or 0 for v in values[max(a, 0):max(b, 0)])
    expected = {}
    for key, v in under.items():
        if v:
            n, s, q = len(v), sum(v), sum(x * x for x in v)
            expected[key] = (n, sum(x > 240 for x in v) / n, math.sqrt(n * q - s * s) / n)
    assert found == expected and len(found) > 8
    # A row of pixels goes to Python without what is far from masks, and once however many masks lie over it.
    table = pa.table([[1] * 5 + [2], [*range(6)], [0] * 5 + [0], [10, 10, 12, 400, 900, 10], [20, 50, 30, 420, 901, 11]],
                     names=["drawing_id", "mask_id", "y", "x_start", "x_end"])
    pieces = masks._pieces(table.to_batches())
    assert [tuple(p[c] for c in ("drawing_id", "low", "high", "masks", "starts", "ends")) for p in pieces.to_pylist()] == [
        (1, 10, 50, [0, 1, 2], [0, 0, 2], [10, 40, 20]), (1, 400, 420, [3], [0], [20]), (1, 900, 901, [4], [0], [1]), (2, 10, 11, [5], [0], [1])]
