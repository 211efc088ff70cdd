"""Tables that grow with the items of drawings are never gathered on the driver, however small Spark takes them for."""

import uuid

import pytest

from sheetweave.operators import editlog, edits, filters, folds, graph, ink, masks, matching, ordering, prompts, suppression
from sheetweave.operators.foldrules import iou_above
from sheetweave.plans import digitize
from sheetweave.scratch import Scratch
from sheetweave.sources import sinks

PAGES = "drawing_id long, width long, height long"
RUNS = "drawing_id long, mask_id long, y long, x_start long, x_end long"
INK = "drawing_id long, y long, x_start long, x_end long"
BOXES = "drawing_id long, mask_id long, det_id long, symbol_id long, text_id long, id long, score double, area long, x1 long, y1 long, x2 long, y2 long"
LINES = "drawing_id long, line_id long, line_type string, direction string, x1 long, y1 long, x2 long, y2 long"
GREY = "drawing_id long, y long, grey array<short>"
SIZES = "drawing_id long, mask_id long, x1 long, y1 long, x2 long, y2 long, area long, has_long_line boolean"


class Tables:
    def __init__(self, spark, folder):
        self.make = make = lambda rows, schema: written(spark.createDataFrame(rows, schema), folder)
        self.pages = make([(0, 40, 30)], PAGES)
        self.runs = make([(0, m, y, 2, 8) for m in range(3) for y in range(4)], RUNS)
        self.ink = make([(0, y, 1, 30) for y in range(20)], INK)
        self.boxes = make([(0, i, i, i, i, i, 0.5, 40, 2 + i, 0, 10 + i, 5) for i in range(3)], BOXES)
        self.lines = make([(0, i, "solid", "none", 0, i, 20, i) for i in range(3)], LINES)
        self.grey = make([(0, y, [200] * 40) for y in range(30)], GREY)
        self.sizes = make([(0, m, 2, 0, 8, 4, 24, False) for m in range(3)], SIZES)
        self.batches = make([(0, m, 0) for m in range(3)], "drawing_id long, mask_id long, batch long")
        self.chosen = make([(0, 0, m) for m in range(2)], "drawing_id long, selection long, mask_id long")
        self.points = make([(0, 3.0, 2.0)], "drawing_id long, x double, y double")
        self.turns = make([(0, 0, 0, "forward")], "drawing_id long, line_id long, seq long, value string")


def written(df, folder):
    """Read from files, as Spark knows the size of these."""
    path = f"{folder}/{uuid.uuid4().hex}"
    df.coalesce(1).write.parquet(path)
    return df.sparkSession.read.parquet(path)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    return Tables(spark, tmp_path_factory.mktemp("tables"))


CASES = {
    "evaluate": lambda t: masks.evaluate(t.runs, t.runs, t.batches),
    "overlaps": lambda t: masks.overlaps(t.runs, t.runs, ordered=True),
    "content": lambda t: masks.content_verdicts(t.batches, t.runs, t.grey),
    "union": lambda t: masks.union_masks(t.runs, t.boxes.withColumnRenamed("id", "g"), "g")[1],
    "negatives": lambda t: prompts.negative_points(t.boxes, t.pages, t.runs),
    "count_on_masks": lambda t: prompts.count_on_masks(t.points, t.runs),
    "blobs": lambda t: filters.compact_blobs(t.sizes, t.runs, min_area=1),
    "uncovered": lambda t: filters.uncovered_lines(t.lines, t.boxes, t.boxes),
    "erase": lambda t: ink.erase(t.ink, t.boxes),
    "collinear": lambda t: matching.collinear_pairs(t.lines),
    "pairs": lambda t: matching.overlapping_pairs(t.boxes, "id", 0.1),
    "ends": lambda t: graph.connect_ends(t.lines, t.boxes),
    "multi": lambda t: graph.symbols_at_ends(t.lines, t.boxes),
    "combine": lambda t: edits.combine_masks(t.boxes, t.runs, t.chosen),
    "absorbed": lambda t: suppression.absorbed_by(t.boxes, iou_above(0.3)),
    "directions": lambda t: edits.set_directions(t.lines, t.turns),
    "position": lambda t: ordering.with_position(t.lines, ["drawing_id"], ["line_id"]),
    "sum_before": lambda t: ordering.with_sum_before(t.lines, ["drawing_id"], "line_id", "x2", "start"),
    "networks": lambda t: folds.line_networks(t.lines),
}


@pytest.mark.parametrize("name", CASES)
def test_items_are_shuffled(tables, name):
    plan = CASES[name](tables)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan


def test_ink_meets_its_page_by_shuffle(tables):
    t = tables
    frames = t.make([(0, 0, 0, 20, 20)], "drawing_id long, x1 long, y1 long, x2 long, y2 long")
    kept = ink.keep_area(t.ink, t.pages, frames)
    top = next(x for x in kept._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x)
    assert "SortMergeJoin" in top
    assert {(r.y, r.x_start, r.x_end) for r in kept.collect()} == {(y, 1, 20) for y in range(20)}


def test_result_documents_are_shuffled(tables):
    t = tables
    headers = t.make([(0, "a.png", {})], "drawing_id long, image_path string, params map<string,string>")
    docs = sinks.results(t.boxes, headers)
    top = next(x for x in docs._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x)
    assert "SortMergeJoin" in top and docs.count() == 1


def test_runs_of_combined_masks_are_met_once(tables):
    t = tables
    runs = t.make([(0, m, y, 2 + m, 8) for m in range(4) for y in range(4)], RUNS)  # mask 3 is in no selection
    made = edits.combine_masks(t.boxes, runs, t.chosen)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan
    assert {(r.mask_id, r.x1, r.y1, r.x2, r.y2, r.area) for r in made.collect()} == {(0, 2, 0, 8, 4, 24), (2, 4, 0, 12, 5, 40)}


def test_joins_of_a_replayed_log_are_shuffled(tables, monkeypatch):
    plans, save = [], Scratch.save

    def noted(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(self, df)

    monkeypatch.setattr(Scratch, "save", noted)
    place = "x1 long, y1 long, x2 long, y2 long"
    lines = tables.make([(0, k, "solid", "none", 0, 9 * k, 30, 9 * k) for k in range(4)],
                        f"drawing_id long, line_id long, line_type string, direction string, {place}")
    log = tables.make([(0, 1, "delete", [3], *[None] * 6), (0, 2, "combine", [0, 1], *[None] * 6)],
                      f"drawing_id long, seq long, op string, targets array<long>, value string, line_type string, {place}")
    assert {r.line_id for r in editlog.replay_lines(lines, log).collect()} == {2, 4}
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_erased_ink_is_read_by_the_next_step_not_made_again(tables, monkeypatch):
    plans, save = [], Scratch.save

    def noted(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(self, df)

    monkeypatch.setattr(Scratch, "save", noted)
    t = tables
    symbols = t.make([(0, 25, 0, 30, 25)], "drawing_id long, x long, y long, w long, h long")
    lines = digitize.clean_lines(t.lines, t.ink, t.pages, t.boxes, 0, symbols=symbols)
    # Erased ink is the runs that meet no box and the pieces of others: three joins, nine more if made three times.
    assert max(p.count("SortMergeJoin") for p in plans) == 3
    assert lines.columns == ["drawing_id", "line_id", "x1", "y1", "x2", "y2"] and lines.count() == 0
