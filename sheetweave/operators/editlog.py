"""Edit logs of any length: which edits are in force, and their replay over a table of lines.

Undo takes back the last edit, at most ``depth`` in a row; redo brings back the last one taken back; a
new edit forgets those. A log is cut into blocks that are worked on side by side. How many edits can
be undone and redone is all that a block needs from those before it, and these two counts change by fixed
rules: a block becomes a function on the pairs of counts, and functions compose. With its counts
known, a block is gone through once more with placeholders for what came before. Edits that drop
out of reach are decided there; at most ``2 depth`` open ones go from block to block.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sheetweave.operators.joining import large
from sheetweave.operators.ordering import with_position
from sheetweave.scratch import Scratch

UNDO_DEPTH, BLOCK = 50, 65_536
#: Steps after which equal pairs of counts are folded.
FOLD = 64


def start_pairs(depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (undoable, redoable): they never exceed the depth together."""
    pairs = [(d, u) for d in range(depth + 1) for u in range(depth + 1 - d)]
    return tuple(np.array(c, np.int64) for c in zip(*pairs))


def counts_after(ops: list[str], depth: int) -> np.ndarray:
    """For each start pair the pair after the operations, as undoable * (depth + 1) + redoable."""
    done, undone = start_pairs(depth)
    place = np.arange(len(done))
    for n, op in enumerate(ops):
        if op == "undo":
            step = done > 0
            done, undone = done - step, undone + step
        elif op == "redo":
            step = undone > 0
            done, undone = done + step, undone - step
        else:
            done, undone = np.minimum(done + 1, depth), np.zeros_like(undone)
        if n % FOLD == 0 and len(done) > 1:
            codes, back = np.unique(done * (depth + 1) + undone, return_inverse=True)
            done, undone, place = codes // (depth + 1), codes % (depth + 1), back[place]
    return (done * (depth + 1) + undone)[place]


def resolved(steps: list[tuple[int, str]], done: int, undone: int, depth: int) -> tuple[list, list, list]:
    """Goes through (seq, op) with placeholders (0, n) and (1, n) for the edits that can be undone and
    redone at the start, the last one first; own edits are (2, seq). Returns what went out of
    reach of undo, and what can be undone and redone at the end."""
    front = deque((0, n) for n in range(done - 1, -1, -1))
    back = [(1, n) for n in range(undone - 1, -1, -1)]
    fixed = []
    for seq, op in steps:
        if op == "undo":
            if front:
                back.append(front.pop())
            continue
        if op == "redo":
            if not back:
                continue
            front.append(back.pop())
        else:
            back = []
            front.append((2, seq))
        if len(front) > depth:
            fixed.append(front.popleft())
    return fixed, list(front), back


def surviving_edits(log: DataFrame, depth: int = UNDO_DEPTH, block: int = BLOCK) -> DataFrame:
    """Edits in force at the end of each log, with all columns of (drawing_id, seq, op, ...)."""
    scratch = Scratch(log.sparkSession)
    drawing, seq = (log.schema[c].dataType.simpleString() for c in ("drawing_id", "seq"))
    keys = log.select("drawing_id", "seq", F.coalesce("op", F.lit("")).alias("op"))
    placed = scratch.save(with_position(keys, ["drawing_id"], ["seq", "op"], "_at")
                          .withColumn("_block", F.floor(F.col("_at") / block)).drop("_at"))
    of_block = ["drawing_id", "_block"]

    def summary(part: pd.DataFrame) -> pd.DataFrame:
        ops = part.sort_values(["seq", "op"])["op"].tolist()
        return pd.DataFrame({"drawing_id": part["drawing_id"].iloc[:1], "_block": part["_block"].iloc[:1],
                             "after": [counts_after(ops, depth).tolist()]})

    def begin(parts: pd.DataFrame) -> pd.DataFrame:
        parts, rows, state = parts.sort_values("_block"), [], (0, 0)
        pairs = {pair: n for n, pair in enumerate(zip(*(c.tolist() for c in start_pairs(depth))))}
        for number, after in zip(parts["_block"], parts["after"]):
            rows.append((number, *state))
            state = divmod(int(after[pairs[state]]), depth + 1)
        out = pd.DataFrame(rows, columns=["_block", "done", "undone"])
        out.insert(0, "drawing_id", parts["drawing_id"].iat[0])
        return out

    def go(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["seq", "op"])
        fixed, front, back = resolved(list(zip(part["seq"], part["op"])), int(part["done"].iat[0]), int(part["undone"].iat[0]), depth)
        rows = [(k, n, *ref) for k, refs in (("fixed", fixed), ("front", front), ("back", back)) for n, ref in enumerate(refs)]
        out = pd.DataFrame(rows, columns=["state", "place", "kind", "seq"])
        out.insert(0, "drawing_id", part["drawing_id"].iat[0])
        out.insert(1, "_block", part["_block"].iat[0])
        return out

    def chain(parts: pd.DataFrame) -> pd.DataFrame:
        front, back, kept = [], [], []
        for _, part in parts.sort_values(["_block", "place"]).groupby("_block", sort=True):
            before = {0: front[::-1], 1: back[::-1]}
            named = {state: [before[k][s] if k < 2 else s for k, s in zip(p["kind"], p["seq"])]
                     for state, p in part.groupby("state")}
            kept += named.get("fixed", [])
            front, back = named.get("front", []), named.get("back", [])
        out = pd.DataFrame({"seq": kept + front})
        out.insert(0, "drawing_id", parts["drawing_id"].iat[0])
        return out

    schema = f"drawing_id {drawing}, _block bigint"
    after = placed.groupBy(*of_block).applyInPandas(summary, f"{schema}, after array<int>")
    starts = scratch.save(after.groupBy("drawing_id").applyInPandas(begin, f"{schema}, done int, undone int"))
    same = placed["drawing_id"].eqNullSafe(starts["drawing_id"]) & (placed["_block"] == starts["_block"])
    known = placed.join(large(starts), same).select(placed["*"], "done", "undone")
    gone = scratch.save(known.groupBy(*of_block).applyInPandas(go, f"{schema}, state string, place int, kind int, seq {seq}"))
    # Own edits out of reach need nothing more; the others of a block are 2 depth at most.
    own = gone.where("state = 'fixed' AND kind = 2").select("drawing_id", "seq")
    open_ = gone.where("NOT (state = 'fixed' AND kind = 2)")
    ends = open_.groupBy("drawing_id").applyInPandas(chain, f"drawing_id {drawing}, seq {seq}")
    kept = scratch.save(own.unionByName(ends)).withColumnsRenamed({"drawing_id": "_d", "seq": "_s"})
    return log.join(large(kept), log["drawing_id"].eqNullSafe(kept["_d"]) & (log["seq"] == kept["_s"]), "left_semi").where(
        "NOT coalesce(op, '') IN ('undo', 'redo')")


def replay_lines(lines: DataFrame, log: DataFrame) -> DataFrame:
    """The lines after all edits in force, as (drawing_id, line_id, line_type, direction, x1 .. y2).

    The log has (drawing_id, seq, op, targets ARRAY, value, line_type, x1 .. y2). delete removes its targets,
    direction gives them ``value``, combine makes two or more of one type the line between their furthest ends,
    create adds a line of at least five pixels. An edit takes only targets that are there when its
    turn comes; combine leaves selections of both types alone. The n-th combine or create of a log
    makes the id behind the last line's, so later edits can name it.
    """
    from sheetweave.operators.edits import combine_lines

    scratch = Scratch(lines.sparkSession)
    edits = scratch.save(surviving_edits(log))
    last = lines.groupBy("drawing_id").agg(F.max("line_id").alias("_last"))
    makers = with_position(edits.where("op IN ('combine', 'create')").select("drawing_id", "seq"), ["drawing_id"], ["seq"], "_n")
    made = scratch.save(makers.join(large(last), "drawing_id", "left")
                        .selectExpr("drawing_id", "seq", "coalesce(_last, -1) + 1 + _n made"))
    named = edits.join(large(made), ["drawing_id", "seq"], "left")
    drawn = (F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= 5)
    created = named.where((F.col("op") == "create") & drawn).select(
        "drawing_id", F.col("made").alias("line_id"), "line_type", F.coalesce("value", F.lit("none")).alias("direction"),
        "x1", "y1", "x2", "y2", F.col("seq").alias("born"))
    takers = scratch.save(named.where("op IN ('combine', 'delete')").select(
        "drawing_id", "seq", "op", "made", F.explode(F.array_distinct("targets")).alias("line_id")))
    columns = ["drawing_id", "line_id", "line_type", "direction", "x1", "y1", "x2", "y2"]
    first = lines.select(*columns).withColumn("born", F.lit(None).cast("bigint")).unionByName(created)
    kinds = scratch.save(first.select("drawing_id", "line_id", "line_type", "born"))
    ends = None
    while True:  # each round is right for edits that hang on one more edit
        alive = kinds if ends is None else kinds.unionByName(ends["products"])
        there = takers.join(large(alive), ["drawing_id", "line_id"]).where("born IS NULL OR born < seq")
        if ends is not None:
            there = (there.join(large(ends["taken"]), ["drawing_id", "line_id"], "left")
                     .where("taken IS NULL OR taken >= seq"))
        valid = (there.groupBy("drawing_id", "seq", "op", "made")
                 .agg(F.count("*").alias("n"), F.min("line_type").alias("line_type"), F.max("line_type").alias("other"))
                 .where("op = 'delete' OR (n >= 2 AND line_type = other)"))
        products = scratch.save(valid.where("op = 'combine'").selectExpr("drawing_id", "made line_id", "line_type", "seq born"))
        doing = there.join(large(valid.select("drawing_id", "seq")), ["drawing_id", "seq"], "left_semi")
        taken = scratch.save(doing.groupBy("drawing_id", "line_id").agg(F.min("seq").alias("taken")))
        now = {"products": products, "taken": taken}
        if ends is not None and all(now[k].exceptAll(ends[k]).isEmpty() and ends[k].exceptAll(now[k]).isEmpty() for k in now):
            break
        ends = now
    return _built(scratch, first, takers, ends, edits, combine_lines)


def _built(scratch: Scratch, first: DataFrame, takers: DataFrame, ends: dict, edits: DataFrame, combine) -> DataFrame:
    """Lines generation by generation: a product is made once all its members are."""
    key = ["drawing_id", "line_id"]
    turns = scratch.save(edits.where("op = 'direction'").select(
        "drawing_id", "seq", "value", F.explode("targets").alias("line_id")))
    members = scratch.save(takers.where("op = 'combine'").join(large(ends["taken"]), key).where("taken = seq")
                           .select("drawing_id", "seq", "made", "line_id"))

    def turned(rows: DataFrame) -> DataFrame:
        """Each line with the last direction set while it was there."""
        held = (turns.join(large(rows.select(*key, "born")), key).join(large(ends["taken"]), key, "left")
                .where("(born IS NULL OR born < seq) AND (taken IS NULL OR taken > seq)")
                .groupBy(*key).agg(F.max_by("value", "seq").alias("_value")))
        return (rows.join(large(held), key, "left").withColumn("direction", F.coalesce("_value", "direction")).drop("_value"))

    ready = scratch.save(turned(first))
    while True:  # as many rounds as products are made of products
        left = members.join(large(ready.selectExpr("drawing_id", "line_id made")), ["drawing_id", "made"], "left_anti")
        waiting = left.join(large(ready.select(*key)), key, "left_anti").select("drawing_id", "made")
        next_ = scratch.save(left.join(large(waiting), ["drawing_id", "made"], "left_anti"))
        if next_.isEmpty():
            break
        chosen = next_.selectExpr("drawing_id", "made selection", "line_id")
        whole = combine(ready.drop("born"), chosen, keep_selection=True)
        products = turned(whole.join(large(ends["products"].select(*key, "born")), key))
        ready = scratch.save(ready.unionByName(products.select(*ready.columns)))
    return ready.join(large(ends["taken"]), key, "left_anti").drop("born")
