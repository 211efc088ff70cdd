"""Ordered folds over drawings of any size, tile by tile.

The rule "go through the items in order; each joins the first group that takes it in, or
opens one" is sequential, but an item only reads groups near it. Drawings are cut into
quadtree tiles of at most ``CAPACITY`` items, each item at home in the tile of its middle. A task
goes through the items of its tile in order. What it knows of other tiles is what they told
in the round before: the states of their groups over time, and which of their items joined a
group of this tile. After a round every tile that was told something new is folded again.
When nothing changes, every decision agrees with all earlier ones, so by induction over the
order it is that of one fold over the whole drawing. A round settles all that depends on one more
tile, so rounds grow with the tiles that a chain of decisions crosses, not with its length. Messages
are only those of groups that share a grid cell with another tile. A drawing in one tile needs one
round and no messages.

Passes are part of the order: a rule that repeats goes through the groups of the pass before until
a pass changes nothing.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sheetweave.operators.joining import large
from sheetweave.scratch import Scratch

CAPACITY = 16384
#: Side of a tile that is not cut again, how often a side can double up to the whole, and the
#: side of the cells by which tiles find what lies near their items.
FINEST, LEVELS, CELL = 8, 24, 128
BOX = ["x1", "y1", "x2", "y2"]
TILE = ["drawing_id", "tile"]
MESSAGE = ("kind string, id bigint, pass bigint, key array<bigint>, owner bigint, other string, cx bigint, cy bigint, "
           "digest string, x1 bigint, y1 bigint, x2 bigint, y2 bigint")


class Rule:
    """What a fold needs to know of its items: state columns beyond the box, and the decisions."""

    columns: dict[str, str] = {}
    repeat = False

    def load(self, *values) -> tuple:
        """Further state from the values of ``columns``."""
        return values

    def dump(self, extra: tuple) -> tuple:
        return extra

    def result(self, extra: tuple) -> tuple:
        """The same for a final state; what only the fold needs may be left out."""
        return extra

    def order(self, box: np.ndarray, extra: tuple) -> tuple[int, ...]:
        """What a pass is ordered by; ties keep the order of the pass before, at first that of the ids."""
        return ()

    def grown(self, boxes: np.ndarray) -> np.ndarray:
        """Boxes that meet whenever a group can take in an item."""
        return boxes

    def absorbs(self, boxes: np.ndarray, extras: list[tuple], box: np.ndarray, extra: tuple) -> np.ndarray:
        """Which of some groups take in an item."""
        raise NotImplementedError

    def take(self, box: np.ndarray, extra: tuple, other: np.ndarray, other_extra: tuple) -> tuple[np.ndarray, tuple]:
        """The group with the item in it."""
        raise NotImplementedError

    def fold(self, home: list[Item], told: Told) -> Outcome:
        return fold_tile(self, home, told)


@dataclass
class Item:
    id: int
    box: np.ndarray
    extra: tuple


@dataclass
class Foreign:
    """A group of another tile: its first state, later ones by pass, and the pass in which it joined another."""

    tile: str
    first: Item
    states: dict[int, list] = field(default_factory=lambda: defaultdict(list))
    gone: int | None = None

    def key(self, rule: Rule, number: int) -> tuple:
        """The key with which the group begins a pass."""
        found: tuple = (self.first.id,)
        for earlier in range(number + 1):
            state = self.before(earlier)
            found = rule.order(state.box, state.extra) + found
        return found

    def before(self, number: int) -> Item:
        earlier = [p for p in self.states if p < number]
        return self.states[max(earlier)][-1][1] if earlier else self.first


@dataclass
class Told:
    """Messages of other tiles: groups by id, and joins (key, owner, item) by pass."""

    groups: dict[int, Foreign] = field(default_factory=dict)
    joins: dict[int, list] = field(default_factory=lambda: defaultdict(list))

    def last_change(self) -> int:
        passes = [-1, *self.joins]
        for group in self.groups.values():
            passes += group.states
            passes += [] if group.gone is None else [group.gone]
        return max(passes)


@dataclass
class Outcome:
    """Final groups, (item, owner) of joins, and what other tiles may want to know: states as
    (pass, key, item), joins of foreign groups, and all boxes that were in use by id."""

    final: list[Item] = field(default_factory=list)
    parts: list[tuple[int, int]] = field(default_factory=list)
    states: list[tuple[int, tuple | None, Item]] = field(default_factory=list)
    joins: list[tuple[int, tuple, int, str, Item]] = field(default_factory=list)
    used: dict[int, list] = field(default_factory=lambda: defaultdict(list))


def meets(boxes: np.ndarray, box: np.ndarray) -> np.ndarray:
    return (boxes[:, 0] <= box[2]) & (box[0] <= boxes[:, 2]) & (boxes[:, 1] <= box[3]) & (box[1] <= boxes[:, 3])


class Groups:
    """States of groups as growing arrays."""

    def __init__(self, room: int):
        self.boxes, self.grown = np.zeros((room, 4), np.int64), np.zeros((room, 4))
        self.extras: list[tuple] = []
        self.ids: list[int] = []

    def add(self, item: Item, grown: np.ndarray) -> None:
        self.boxes[len(self.ids)], self.grown[len(self.ids)] = item.box, grown
        self.extras.append(item.extra)
        self.ids.append(item.id)

    def hits(self, rule: Rule, item: Item, grown: np.ndarray, open_: np.ndarray | None = None) -> np.ndarray:
        """Places of the groups that take in an item, in order."""
        flags = meets(self.grown[:len(self.ids)], grown)
        near = np.flatnonzero(flags if open_ is None else flags & open_)
        if not len(near):
            return near
        return near[rule.absorbs(self.boxes[near], [self.extras[k] for k in near], item.box, item.extra)]


def fold_tile(rule: Rule, home: list[Item], told: Told) -> Outcome:
    """Goes through the items of one tile, pass by pass."""
    out, number, last = Outcome(), 0, told.last_change()
    alive, start = home, {i.id: (i.id,) for i in home}
    for item in home:
        out.used[item.id].append(item.box)
    while True:
        merged, heads = False, Groups(len(alive))
        places: dict[int, int] = {}
        start = {i.id: rule.order(i.box, i.extra) + start[i.id] for i in alive}
        steps = [(start[i.id], None, i) for i in alive]
        steps += told.joins.get(number, [])
        steps.sort(key=lambda step: step[0])
        others, spans, tiles = foreign_states(rule, told, number)
        rank = {key: n for n, key in enumerate(sorted({s[0] for s in steps} | {k for span in spans for k in span if k}))}
        begin, end, lead = (np.array([rank[s[c]] if s[c] else len(rank) for s in spans], np.int64) for c in range(3))
        grown = dict(zip((i.id for i in alive), rule.grown(np.array([i.box for i in alive], np.int64).reshape(-1, 4))))
        for key, owner, item in steps:
            if owner is not None:  # an item of another tile joins a group of this one
                place = places.get(owner)
                if place is not None and rule.absorbs(heads.boxes[place:place + 1], [heads.extras[place]], item.box, item.extra)[0]:
                    merged |= absorb(rule, heads, place, item, number, key, out)
                continue
            box, time = grown[item.id], rank[key]
            own = heads.hits(rule, item, box)
            far = others.hits(rule, item, box, (begin < time) & (time <= end)) if len(begin) else own[:0]
            first = far[np.argmin(lead[far])] if len(far) else None
            if first is not None and (not len(own) or lead[first] < rank[start[heads.ids[own[0]]]]):
                out.joins.append((number, key, others.ids[first], tiles[first], item))
                out.parts.append((item.id, others.ids[first]))
                out.states.append((number, None, item))
                merged = True
            elif len(own):
                out.parts.append((item.id, heads.ids[own[0]]))
                out.states.append((number, None, item))
                merged |= absorb(rule, heads, own[0], item, number, key, out)
            else:
                places[item.id] = len(heads.ids)
                heads.add(item, box)
                if not number:
                    out.states.append((number, key, item))
        opened = {i.id: i for i in alive}
        alive = [opened[i] if (heads.boxes[n] == opened[i].box).all() and heads.extras[n] is opened[i].extra
                 else Item(i, heads.boxes[n].copy(), heads.extras[n]) for n, i in enumerate(heads.ids)]
        if not rule.repeat or not (merged or last >= number):
            out.final = alive
            return out
        number += 1


def absorb(rule: Rule, heads: Groups, place: int, item: Item, number: int, key: tuple, out: Outcome) -> bool:
    before = heads.boxes[place].copy()
    box, extra = rule.take(before, heads.extras[place], item.box, item.extra)
    if (box == before).all() and extra is heads.extras[place]:
        return True
    heads.boxes[place], heads.extras[place] = box, extra
    heads.grown[place] = rule.grown(np.asarray(box, np.int64)[None])[0]
    state = Item(heads.ids[place], np.array(box, np.int64), extra)
    out.states.append((number, key, state))
    out.used[state.id].append(state.box)
    return True


def foreign_states(rule: Rule, told: Told, number: int) -> tuple[Groups, list, list[str]]:
    """States of foreign groups in a pass, each with the keys after which it begins, with which it
    ends (None: never), and with which its group began the pass."""
    found, spans, tiles = [], [], []
    for group in told.groups.values():
        if group.gone is not None and group.gone <= number:
            continue
        first = group.key(rule, number)
        steps = [(first, group.before(number)), *group.states.get(number, [])]
        for (key, state), following in zip(steps, [*steps[1:], None]):
            found.append(state)
            spans.append((key, following[0] if following else None, first))
            tiles.append(group.tile)
    states = Groups(len(found))
    if found:
        for item, box in zip(found, rule.grown(np.array([i.box for i in found], np.int64))):
            states.add(item, box)
    return states, spans, tiles


def cells_of(rule: Rule, boxes: Iterable[np.ndarray]) -> set[tuple[int, int]]:
    found = set()
    for x1, y1, x2, y2 in np.floor(rule.grown(np.array(list(boxes), np.int64).reshape(-1, 4)) / CELL).astype(np.int64).tolist():
        found.update((x, y) for x in range(x1, x2 + 1) for y in range(y1, y2 + 1))
    return found


# --- Spark ---------------------------------------------------------------------


def with_tiles(items: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, bool]:
    """Adds ``tile``: empty for drawings of at most ``capacity`` items, else the largest quadtree cell
    around the middle with no more. Cells of the finest size are not cut. Also tells if any tile is a cell."""
    scratch = Scratch(items.sparkSession)
    middle = {"_px": F.floor((F.col("x1") + F.col("x2")) / (2 * FINEST)), "_py": F.floor((F.col("y1") + F.col("y2")) / (2 * FINEST))}
    placed = items.withColumns(middle)
    base = scratch.save(placed.groupBy("drawing_id", "_px", "_py").agg(F.count("*").alias("_n")))
    big = scratch.save(base.groupBy("drawing_id").agg(F.sum("_n").alias("_n")).where(F.col("_n") > capacity)
                       .select("drawing_id", F.lit(True).alias("_big")))
    if big.isEmpty():
        return items.withColumn("tile", F.lit("")), False
    levels = (base.join(big, "drawing_id").withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
              .withColumns({"_qx": F.expr("shiftright(_px, _level)"), "_qy": F.expr("shiftright(_py, _level)")}))
    cell = ["drawing_id", "_level", "_qx", "_qy"]
    fits = levels.groupBy(*cell).agg(F.sum("_n").alias("_sum")).where(F.col("_sum") <= capacity).select(*cell)
    leaf = (levels.join(large(fits), cell).groupBy("drawing_id", "_px", "_py").agg(F.max("_level").alias("_level")))
    name = F.expr("concat_ws(':', coalesce(_level, 0), shiftright(_px, coalesce(_level, 0)), shiftright(_py, coalesce(_level, 0)))")
    return (placed.join(big, "drawing_id", "left").join(large(leaf), ["drawing_id", "_px", "_py"], "left")
            .withColumn("tile", F.when(F.col("_big"), name).otherwise(F.lit("")))
            .select(*items.columns, "tile")), True


def run_tiles(rows: DataFrame, rule: Rule, parts: bool) -> DataFrame:
    """One call of the rule for each tile, over its items and messages."""
    spark = rows.sparkSession
    drawing = rows.schema["drawing_id"].dataType.simpleString()
    extra = list(rule.columns)
    names = ["drawing_id", "tile", "kind", "id", "pass", "key", "owner", "other", "cx", "cy", "digest", *BOX, *extra]
    schema = f"drawing_id {drawing}, tile string, {MESSAGE}" + "".join(f", {c} {t}" for c, t in rule.columns.items())
    empty = (None,) * (4 + len(extra))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        drawing, tile = group["drawing_id"].iat[0], group["tile"].iat[0]
        boxes = group[BOX].fillna(0).to_numpy(np.int64)
        extras = zip(*(group[c] for c in extra)) if extra else iter([()] * len(group))
        home, told, later = [], Told(), []
        keys = [None if k is None else tuple(int(v) for v in k) for k in group["key"]]
        for kind, id_, number, key, owner, other, box, values in zip(
                group["kind"], group["id"], group["pass"], keys, group["owner"], group["other"], boxes, extras):
            item = Item(int(id_), box, rule.load(*values))
            if kind == "item":
                home.append(item)
            elif kind == "join":
                told.joins[int(number)].append((key, int(owner), item))
            else:
                later.append((key is None, int(number), key or (), other, item))
        later.sort(key=lambda m: m[:3])
        for gone, number, key, other, item in later:
            if item.id not in told.groups:
                told.groups[item.id] = Foreign(other, item)
            elif gone:
                told.groups[item.id].gone = number
            else:
                told.groups[item.id].states[number].append((key, item))
        out = rule.fold(home, told)

        def row(kind, item=None, number=None, key=None, owner=None, other=None, cx=None, cy=None, digest=None, values=None):
            place = empty if item is None else (*item.box.tolist(), *(rule.dump(item.extra) if values is None else values))
            return kind, None if item is None else item.id, number, key, owner, other, cx, cy, digest, *place

        rows = [row("final", i, values=rule.result(i.extra)) for i in out.final]
        if parts:
            rows += [("part", a, None, None, b, None, None, None, None, *empty) for a, b in out.parts]
        if tile:
            heads = {i.id for number, key, i in out.states if not number and key is not None}
            message = [row("time", i, number, list(key) if key else None) for number, key, i in out.states if i.id in heads]
            message += [row("join", i, number, list(key), owner, other) for number, key, owner, other, i in out.joins]
            message += [row("cell", cx=x, cy=y) for x, y in sorted(cells_of(rule, (b for bs in out.used.values() for b in bs)))]
            message += [("reach", i, None, None, None, None, x, y, None, *empty) for i in sorted(heads)
                        for x, y in sorted(cells_of(rule, out.used[i]))]
            rows += message + [row("digest", digest=hashlib.sha256(repr(message).encode()).hexdigest())]
        return pd.DataFrame([(drawing, tile, *r) for r in rows], columns=names).astype(
            {c: "Int64" for c in ("id", "pass", "owner", "cx", "cy", *BOX)})

    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.fillna(0, ["pass", "owner"])  # whole numbers stay exact in pandas
    return rows.repartition(count, *TILE).groupBy(*TILE).applyInPandas(run, schema)


def messages(out: DataFrame) -> DataFrame:
    """What each tile (``tile``) is told by others (``other``): states of groups that share a cell
    with something of it, and joins of its groups."""
    cell = ["drawing_id", "cx", "cy"]
    of = lambda kind: out.where(F.col("kind") == kind)
    near = (of("reach").select(*cell, "id", "tile").join(large(of("cell").select(*cell, F.col("tile").alias("to"))), cell)
            .where("tile <> to").select("drawing_id", "id", "tile", "to").distinct())
    times = (of("time").join(large(near), ["drawing_id", "id", "tile"])
             .withColumns({"other": F.col("tile"), "tile": F.col("to")}).select(*out.columns))
    joins = of("join").withColumns({"tile": F.col("other"), "other": F.col("tile")}).select(*out.columns)
    return times.unionByName(joins)


def fold(items: DataFrame, rule: Rule, capacity: int = CAPACITY, parts: bool = False) -> DataFrame:
    """Final states (drawing_id, id, x1 .. y2, the rule's columns) of the fold over each drawing; with
    ``parts`` (drawing_id, id, owner) of the items that joined a group instead."""
    scratch = Scratch(items.sparkSession)
    tiled, cut = with_tiles(items, capacity)
    plain = [f"CAST(NULL AS {t}) {c}" for c, t in (x.split() for x in MESSAGE.split(", ")) if c not in ("kind", "id", *BOX)]
    own = tiled.selectExpr(*TILE, "'item' kind", "id", *plain, *BOX, *rule.columns)
    own = scratch.save(own) if cut else own
    out = scratch.save(run_tiles(own, rule, parts))
    told = None
    while cut:  # each round settles what depends on one more tile
        before, told = told, scratch.save(messages(out))
        if before is None:
            stale = told.select(*TILE).distinct()
        else:
            digest = lambda of, name: of.where("kind = 'digest'").select(*TILE, F.col("digest").alias(name))
            changed = (digest(out, "new").join(digest(last, "old"), TILE).where("new <> old")
                       .select("drawing_id", F.col("tile").alias("other")))
            stale = reduce(DataFrame.unionByName, [t.join(changed, ["drawing_id", "other"], "left_semi").select(*TILE)
                                                   for t in (told, before)]).distinct()
        stale = scratch.save(stale)
        if stale.isEmpty():
            break
        again = own.join(stale, TILE, "left_semi").unionByName(told.join(stale, TILE, "left_semi"))
        last, out = out, scratch.save(run_tiles(again, rule, parts).unionByName(out.join(stale, TILE, "left_anti")))
    if parts:
        return out.where("kind = 'part'").select("drawing_id", "id", "owner")
    return out.where("kind = 'final'").select("drawing_id", "id", *BOX, *rule.columns)
