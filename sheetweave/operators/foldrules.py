"""Decisions of the ordered folds, on numpy arrays of boxes.

Rules tell the tile fold (tilefold.py) which group takes in an item; the other functions see one
group of touching items that Spark has found (folds.py).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import deque
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from sheetweave.functions.textrules import TAG, WORDY
from sheetweave.operators.tilefold import Outcome, Rule

_TAG, _WORDY = re.compile(TAG), re.compile(WORDY)


def sweep(count: int, start: Callable, absorbs: Callable, take: Callable,
          rescan: bool = False) -> tuple[list, list]:
    """Each item in turn takes in later free ones and grows as it goes.

    ``absorbs(state, indices)`` gives a flag per index. Returns the final states
    as (first index, state), and all states in between.
    """
    free = np.ones(count, dtype=bool)
    final, between = [], []
    for i in range(count):
        if not free[i]:
            continue
        free[i] = False
        state, last, grown = start(i), i, False
        while True:
            later = last + 1 + np.flatnonzero(free[last + 1:])
            hit = absorbs(state, later) if len(later) else np.zeros(0, dtype=bool)
            if hit.any():
                last = int(later[np.argmax(hit)])
                state, grown = take(state, last), True
                free[last] = False
                between.append((i, state))
            elif rescan and grown:
                last, grown = i, False
            else:
                break
        final.append((i, state))
    return final, between


# --- segments ----------------------------------------------------------------


def _perpendicular(px, py, x1, y1, x2, y2):
    vx, vy = x2 - x1, y2 - y1
    return np.abs(vx * (py - y1) - vy * (px - x1)) / (np.hypot(vx, vy) + 1e-9)


def mergeable(a: np.ndarray, b: np.ndarray, angle=5.0, gap=30.0, perp=20.0) -> np.ndarray:
    """Flags of the segments a (rows) that are nearly collinear with b and nearly touch it."""
    x1, y1, x2, y2 = a.T
    la, lb = np.hypot(x2 - x1, y2 - y1), np.hypot(b[2] - b[0], b[3] - b[1])
    aa = np.degrees(np.arctan2(y2 - y1, x2 - x1))
    d = np.abs(aa - np.degrees(np.arctan2(b[3] - b[1], b[2] - b[0]))) % 360.0
    d = np.minimum(d, 360.0 - d)
    turn = np.minimum(d, np.abs(d - 180.0))
    off = np.minimum.reduce([_perpendicular(b[0], b[1], x1, y1, x2, y2), _perpendicular(b[2], b[3], x1, y1, x2, y2),
                             _perpendicular(x1, y1, *b), _perpendicular(x2, y2, *b)])
    ux, uy = np.cos(np.radians(aa)), np.sin(np.radians(aa))
    ta = (x2 - x1) * ux + (y2 - y1) * uy
    t1 = (b[0] - x1) * ux + (b[1] - y1) * uy
    t2 = (b[2] - x1) * ux + (b[3] - y1) * uy
    space = np.maximum(np.minimum(0.0, ta), np.minimum(t1, t2)) - np.minimum(np.maximum(0.0, ta), np.maximum(t1, t2))
    return (la >= 1) & (lb >= 1) & (turn <= angle) & (off <= perp) & (space <= gap)


def extreme_ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The outermost two of the four endpoints along segment a."""
    points = np.array([a[:2], a[2:], b[:2], b[2:]], dtype=float)
    angle = np.radians(np.degrees(np.arctan2(a[3] - a[1], a[2] - a[0])))
    t = (points[:, 0] - a[0]) * np.cos(angle) + (points[:, 1] - a[1]) * np.sin(angle)
    return np.rint(np.concatenate([points[np.argmin(t)], points[np.argmax(t)]])).astype(np.int64)


class Segments(Rule):
    """Collinear segments merged, until a pass merges none."""

    repeat = True

    def grown(self, boxes):
        reach = 29.5 + 0.0875 * np.hypot(boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1])[:, None]
        one, two = boxes[:, :2], boxes[:, 2:]
        return np.concatenate((np.minimum(one, two) - reach, np.maximum(one, two) + reach), axis=1)

    def absorbs(self, boxes, extras, box, extra):
        return mergeable(boxes, box)

    def take(self, box, extra, other, other_extra):
        return extreme_ends(box, other), extra


class NearCopies(Rule):
    """Of two lines with both ends near each other the longer one stays. Items do not grow; what tiles
    tell each other is when an item was dropped, by the id of the line whose turn it was."""

    def __init__(self, limit: float):
        self.limit = limit

    def grown(self, boxes):
        """Twice the reach of a turn, shared by both sides: a turn hangs on what is near its line."""
        x, y = (boxes[:, 0] + boxes[:, 2]) / 2, (boxes[:, 1] + boxes[:, 3]) / 2
        reach = self.limit + 1
        return np.stack((x - reach, y - reach, x + reach, y + reach), 1)

    def copies(self, x1, y1, x2, y2, room: int = 1 << 20):
        """Each line that has near copies after it, with their places; about ``room`` pairs are looked at at once."""
        x, y = (x1 + x2) / 2, (y1 + y2) / 2
        step = max(1, room // max(1, len(x)))
        for start in range(0, len(x), step):
            rows = slice(start, start + step)
            # Middles are no further apart than ends.
            close = ((np.abs(x[rows, None] - x[start:]) < self.limit) & (np.abs(y[rows, None] - y[start:]) < self.limit))
            a, b = np.nonzero(np.triu(close, 1))
            a, b = a + start, b + start
            same = np.maximum(np.hypot(x1[a] - x1[b], y1[a] - y1[b]), np.hypot(x2[a] - x2[b], y2[a] - y2[b]))
            turned = np.maximum(np.hypot(x1[a] - x2[b], y1[a] - y2[b]), np.hypot(x2[a] - x1[b], y2[a] - y1[b]))
            near = np.minimum(same, turned) < self.limit
            a, b = a[near], b[near]
            first = np.flatnonzero(np.diff(a, prepend=-1))
            yield from zip(a[first].tolist(), np.split(b, first[1:]))

    def fold(self, home, told):
        items = sorted([(i.id, i.box, None) for i in home] + [
            (id_, g.first.box, g) for id_, g in told.groups.items()], key=lambda i: i[0])
        ids = [i[0] for i in items]
        own = np.array([g is None for *_, g in items], bool)
        never = float("inf")
        # Which turn dropped an item: its place, or between two places if it is out of sight.
        turn = np.array([never if g is None or g.gone is None else place_of(ids, g.gone) for *_, g in items])
        x1, y1, x2, y2 = np.array([b for _, b, _ in items], float).reshape(-1, 4).T
        length = np.hypot(x2 - x1, y2 - y1)
        for i, later in self.copies(x1, y1, x2, y2):
            if turn[i] < i:
                continue
            near = later[turn[later] >= i]
            longer = np.flatnonzero(length[near] > length[i])
            if len(longer):
                near = near[:longer[0]]
                if own[i]:
                    turn[i] = i
            turn[near[own[near]]] = i
        out = Outcome()
        by_id = {i.id: i for i in home}
        for n, id_ in enumerate(ids):
            if own[n]:
                item = by_id[id_]
                out.used[id_].append(item.box)
                out.states.append((0, (id_,), item))
                if turn[n] == never:
                    out.final.append(item)
                else:
                    out.states.append((ids[int(turn[n])], None, item))
        return out


def place_of(ids: list[int], id_: int) -> float:
    """The place of an id in a sorted list; between two places if it is not in it."""
    at = bisect_left(ids, id_)
    return at if at < len(ids) and ids[at] == id_ else at - 0.5


def join_editor_lines(ids: np.ndarray, segments: np.ndarray, directions: list[str],
                      distance: float = 15.0, angle: float = 5.0) -> list[tuple]:
    """Collinear lines with near ends joined; the first given direction holds."""
    ends = segments.astype(float)
    tilt = np.degrees(np.arctan2(ends[:, 3] - ends[:, 1], ends[:, 2] - ends[:, 0])) % 180

    def absorbs(state, later):
        s = np.array(state[0], dtype=float)
        if s[0] == s[2] and s[1] == s[3]:
            return np.zeros(len(later), dtype=bool)
        turn = np.abs(np.degrees(np.arctan2(s[3] - s[1], s[2] - s[0])) % 180 - tilt[later])
        turn = np.where(turn > 90, 180 - turn, turn)
        o = ends[later]
        near = np.minimum.reduce([np.hypot(o[:, c] - s[a], o[:, c + 1] - s[a + 1])
                                  for a in (0, 2) for c in (0, 2)])
        return (turn < angle) & (near <= distance)

    def take(state, j):
        (x1, y1, x2, y2), direction = state
        length = np.hypot(x2 - x1, y2 - y1)
        points = [(x1, y1), (x2, y2), tuple(segments[j][:2]), tuple(segments[j][2:])]
        along = sorted(((px - x1) * ((x2 - x1) / length) + (py - y1) * ((y2 - y1) / length), px, py)
                       for px, py in points)
        joined = tuple(int(v) for v in (*along[0][1:], *along[-1][1:]))
        return joined, direction if direction != "none" else directions[j]

    final, _ = sweep(len(ids), lambda i: (tuple(segments[i]), directions[i]), absorbs, take, rescan=True)
    return [(ids[i], *s, direction) for i, (s, direction) in final]


# --- texts -------------------------------------------------------------------


@lru_cache(1 << 14)
def _marks(text: str) -> tuple[bool, bool, bool]:
    """Whether a text is like a tag, like a word, and short."""
    return (bool(_TAG.match(text.replace(" ", ""))), bool(_WORDY.match(text.upper())), len(text) <= 2)


def _union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate((np.minimum(a[:2], b[:2]), np.maximum(a[2:], b[2:])))


class MergedTexts(Rule):
    """Parts of one row joined, or rows of one block, until a pass joins none."""

    columns = {"text": "string", "score": "double", "page_width": "bigint"}
    repeat = True

    def __init__(self, vertical: bool, width_share: float = 0.22):
        self.vertical, self.width_share = vertical, width_share

    def load(self, text, score, page_width):
        return text, float(score), int(page_width)

    def order(self, box, extra):
        return int(box[1]), int(box[0])

    def grown(self, boxes):
        if self.vertical:
            reach = 12.5 + 0.175 * np.maximum(1, boxes[:, 2] - boxes[:, 0]) + 1
        else:
            reach = 0.6 * np.maximum(1, boxes[:, 3] - boxes[:, 1]) + 1
        return np.concatenate((boxes[:, :2] - reach[:, None], boxes[:, 2:] + reach[:, None]), axis=1)

    def absorbs(self, boxes, extras, box, extra):
        lo, hi, side, depth = (0, 2, 1, 3) if self.vertical else (1, 3, 0, 2)
        a, marks = boxes, np.array([_marks(text) for text, *_ in extras])
        shared = np.minimum(a[:, hi], box[hi]) - np.maximum(a[:, lo], box[lo])
        smaller = np.maximum(1, np.minimum(a[:, hi] - a[:, lo], box[hi] - box[lo]))
        beside = np.maximum(0, shared) / smaller >= 0.55
        gap = np.where(box[side] < a[:, side], a[:, side] - box[depth], box[side] - a[:, depth])
        tag, wordy, short = _marks(extra[0])
        if self.vertical:
            return beside & ~((gap > 0.35 * smaller) & (gap > 25)) & (marks[:, 1] | wordy)
        wide = np.maximum(a[:, 2], box[2]) - np.minimum(a[:, 0], box[0])
        return (beside & (gap <= 1.2 * smaller) & (marks.any(axis=1) | tag | wordy | short)
                & (wide <= self.width_share * extra[2]))

    def take(self, box, extra, other, other_extra):
        (tag, _, short), (other_tag, _, other_short) = _marks(extra[0]), _marks(other_extra[0])
        tight = not self.vertical and (tag or short or other_tag or other_short)
        text = (extra[0] + ("" if tight else " ") + other_extra[0]).strip()
        return _union(box, other), (text, max(extra[1], other_extra[1]), extra[2])


class CloseTexts(Rule):
    """Texts of one row appended to the growing right edge, without a joiner."""

    columns = {"text": "string", "score": "double"}

    def __init__(self, y_tolerance: float, x_gap: float):
        self.y_tolerance, self.x_gap = y_tolerance, x_gap

    def load(self, text, score):
        return text, float(score)

    def order(self, box, extra):
        return int(box[1]), int(box[0])

    def grown(self, boxes):
        """Corners as far apart as a gap may be; only the left edges and the top count."""
        x, reach = np.sort(boxes[:, [0, 2]], axis=1), np.array([self.x_gap, self.y_tolerance])
        return np.stack((x[:, 0] - reach[0], boxes[:, 1] - reach[1], x[:, 1] + reach[0], boxes[:, 1] + reach[1]), 1)

    def absorbs(self, boxes, extras, box, extra):
        gap = box[0] - boxes[:, 2]
        return (np.abs(box[1] - boxes[:, 1]) < self.y_tolerance) & (gap > 0) & (gap < self.x_gap)

    def take(self, box, extra, other, other_extra):
        return np.array([box[0], box[1], other[2], box[3]]), (extra[0] + other_extra[0], extra[1])


# --- masks -------------------------------------------------------------------


def _bitmap(box, ys, starts, ends) -> np.ndarray:
    pixels = np.zeros((box[3] - box[1], box[2] - box[0]), dtype=bool)
    for y, s, e in zip((ys - box[1]).tolist(), (starts - box[0]).tolist(), (ends - box[0]).tolist()):
        pixels[y, s:e] = True
    return pixels


def same_symbol(box, area, kept: np.ndarray, areas: np.ndarray, shared: np.ndarray,
                iou_limit: float, reach: float) -> np.ndarray:
    """Flags of the kept masks that belong to the same symbol as the given one.

    Each is put to the test that its overlap calls for, and to no other.
    """
    union = area + areas - shared
    iou = np.where(union > 0, shared / np.maximum(union, 1), 0.0)
    found, apart = iou > iou_limit, (shared == 0) | (iou < 0.1)
    for rows, test in ((~found & apart, _neighbours), (~found & ~apart, _inside_reach)):
        some = np.flatnonzero(rows)
        if len(some):
            found[some] = test([float(v) for v in box], area, kept[some].T.astype(float), areas[some], reach)
    return found


def _neighbours(box, area, k: np.ndarray, areas: np.ndarray, reach: float) -> np.ndarray:
    """Masks close by, in a row or column, and of like size and shape."""
    x1, y1, x2, y2 = box
    dx = np.maximum.reduce([np.zeros(len(areas)), k[0] - x2, x1 - k[2]])
    dy = np.maximum.reduce([np.zeros(len(areas)), k[1] - y2, y1 - k[3]])
    gap = np.hypot(dx, dy)
    size = np.maximum(area, areas) / np.maximum(np.minimum(area, areas), 1)
    w, h, kw, kh = x2 - x1, y2 - y1, k[2] - k[0], k[3] - k[1]
    asp, kasp = w / max(h, 1), kw / np.maximum(kh, 1)
    stretch = np.maximum(asp, kasp) / np.maximum(np.minimum(asp, kasp), 0.01)
    ox, oy = np.abs((x1 + x2) / 2 - (k[0] + k[2]) / 2), np.abs((y1 + y2) / 2 - (k[1] + k[3]) / 2)
    row = np.where(ox > 0, 1 - np.minimum(oy / np.maximum((h + kh) / 2, 1), 1.0), 1.0)
    column = np.where(oy > 0, 1 - np.minimum(ox / np.maximum((w + kw) / 2, 1), 1.0), 1.0)
    score = np.maximum(row, column)
    score = np.where((dx == 0) | (dy == 0), np.minimum(score * 1.2, 1.0), score * 0.8)
    hull = ((np.maximum(x2, k[2]) - np.minimum(x1, k[0])) * (np.maximum(y2, k[3]) - np.minimum(y1, k[1])))
    filled = (area + areas) / np.maximum(hull, 1)
    return (gap <= reach) & (
        ((score > 0.5) & (size < 5) & (stretch < 4) & (filled > 0.2))
        | ((gap < reach * 0.6) & (score > 0.4) & (size < 6) & (filled > 0.15))
        | ((score > 0.7) & (gap < reach * 0.8) & (size < 8)))


def _inside_reach(box, area, k: np.ndarray, areas: np.ndarray, reach: float) -> np.ndarray:
    """Masks that hold most of the box when grown by the reach."""
    x1, y1, x2, y2 = box
    iw = np.minimum(x2, k[2] + reach) - np.maximum(x1, k[0] - reach)
    ih = np.minimum(y2, k[3] + reach) - np.maximum(y1, k[1] - reach)
    return np.maximum(iw, 0) * np.maximum(ih, 0) / max((x2 - x1) * (y2 - y1), 1) > 0.6


class Masks(Rule):
    """Each mask joins the first kept one it belongs to, best score first, or is kept itself."""

    columns = {"area": "bigint", "score": "double", "members": "array<bigint>", "ys": "array<bigint>",
               "starts": "array<bigint>", "ends": "array<bigint>"}

    def __init__(self, iou_limit: float, reach: float):
        self.iou_limit, self.reach = iou_limit, reach

    def load(self, area, score, members, ys, starts, ends):
        return int(area), float(score), [int(m) for m in members], Pixels(ys, starts, ends)

    def dump(self, extra):
        area, score, members, pixels = extra
        return area, score, members, *pixels.runs()

    def result(self, extra):
        return *extra[:3], None, None, None

    def order(self, box, extra):
        return (whole_order(-extra[1]),)

    def grown(self, boxes):
        reach = self.reach / 2 + 1
        return boxes + np.array([-reach, -reach, reach, reach])

    def absorbs(self, boxes, extras, box, extra):
        shared = np.array([extra[3].shared(box, other[3], b) for b, other in zip(boxes, extras)])
        areas = np.array([other[0] for other in extras])
        return same_symbol(box, extra[0], boxes, areas, shared, self.iou_limit, self.reach)

    def take(self, box, extra, other, other_extra):
        joined = _union(box, other)
        pixels = Pixels.union(joined, (box, extra[3]), (other, other_extra[3]))
        area = int(np.count_nonzero(pixels.bits))
        return joined, (area, max(extra[1], other_extra[1]), extra[2] + other_extra[2], pixels)


class Pixels:
    """A mask as runs, made into a bitmap of its box when it is first needed."""

    def __init__(self, ys, starts, ends):
        self.ys, self.starts, self.ends = (np.asarray(a, np.int64) for a in (ys, starts, ends))
        self.bits: np.ndarray | None = None

    def drawn(self, box) -> np.ndarray:
        if self.bits is None:
            self.bits = _bitmap(box, self.ys, self.starts, self.ends)
            self.corner = box[:2]
        return self.bits

    def shared(self, box, other: Pixels, other_box) -> int:
        x1, y1 = max(box[0], other_box[0]), max(box[1], other_box[1])
        x2, y2 = min(box[2], other_box[2]), min(box[3], other_box[3])
        if x2 <= x1 or y2 <= y1:
            return 0
        a = self.drawn(box)[y1 - box[1]:y2 - box[1], x1 - box[0]:x2 - box[0]]
        b = other.drawn(other_box)[y1 - other_box[1]:y2 - other_box[1], x1 - other_box[0]:x2 - other_box[0]]
        return int(np.count_nonzero(a & b))

    @staticmethod
    def union(box, *parts) -> Pixels:
        out = Pixels([], [], [])
        out.bits, out.corner = np.zeros((box[3] - box[1], box[2] - box[0]), dtype=bool), box[:2]
        for b, pixels in parts:
            out.bits[b[1] - box[1]:b[3] - box[1], b[0] - box[0]:b[2] - box[0]] |= pixels.drawn(b)
        return out

    def runs(self) -> tuple[list[int], list[int], list[int]]:
        if self.bits is None:
            return self.ys.tolist(), self.starts.tolist(), self.ends.tolist()
        edges = np.diff(np.pad(self.bits, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        y, start = np.nonzero(edges == 1)
        end = np.nonzero(edges == -1)[1]
        return (y + self.corner[1]).tolist(), (start + self.corner[0]).tolist(), (end + self.corner[0]).tolist()


# --- suppression -------------------------------------------------------------


class Suppressed(Rule):
    """Boxes in order of their score, best first: one in conflict with a kept one is dropped."""

    columns = {"score": "double"}

    def __init__(self, conflict: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        self.conflict = conflict

    def order(self, box, extra):
        (score,) = extra
        return (whole_order(float("inf") if score is None or score != score else -score),)

    def absorbs(self, boxes, extras, box, extra):
        return self.conflict(boxes, box)

    def take(self, box, extra, other, other_extra):
        return box, extra


def whole_order(value: float) -> int:
    """A whole number for each double, in the same order."""
    bits = int(np.float64(value + 0.0).view(np.int64))
    return bits if bits >= 0 else bits ^ 0x7FFFFFFFFFFFFFFF


def _shared_area(boxes: np.ndarray, box: np.ndarray) -> np.ndarray:
    w = np.minimum(boxes[:, 2], box[2]) - np.maximum(boxes[:, 0], box[0])
    h = np.minimum(boxes[:, 3], box[3]) - np.maximum(boxes[:, 1], box[1])
    return np.maximum(w, 0) * np.maximum(h, 0)


def iou_above(limit: float):
    """Conflict of boxes by geometry.iou."""

    def conflict(boxes, box):
        inter = _shared_area(boxes, box)
        size = lambda b: np.maximum(b[..., 2] - b[..., 0], 0) * np.maximum(b[..., 3] - b[..., 1], 0)
        return (inter > 0) & (inter / np.maximum(size(boxes) + size(box) - inter, 1e-6) > limit)

    return conflict


def plain_iou_from(limit: float):
    """Conflict of boxes by geometry.iou_plain."""

    def conflict(boxes, box):
        inter = _shared_area(boxes, box)
        size = lambda b: (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1])
        return (inter > 0) & (inter / (size(boxes) + size(box) - inter + 1e-9) >= limit)

    return conflict


# --- chains ------------------------------------------------------------------


def walk_chains(ids: np.ndarray, segments: np.ndarray, reach: float) -> list[tuple]:
    """(chain, place, id): paths grown at both tips by the lowest free line near one.

    Lines keep their own direction: a path starts where its first line starts and
    ends where its last line ends. The grid holds the free lines by endpoint cell.
    """
    order = np.argsort(ids)
    ids, lines = ids[order], segments[order].astype(float)
    cell = max(reach, 1.0)
    grid: dict[tuple[int, int], list[int]] = {}
    for i, (x1, y1, x2, y2) in enumerate(lines):
        for x, y in {(x1 // cell, y1 // cell), (x2 // cell, y2 // cell)}:
            grid.setdefault((int(x), int(y)), []).append(i)
    free = np.ones(len(ids), dtype=bool)

    def lowest_near(x: float, y: float) -> int:
        best = len(ids)
        cx, cy = int(x // cell), int(y // cell)
        for key in ((cx + dx, cy + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)):
            held = grid.get(key)
            if not held:
                continue
            if sum(1 for i in held[:8] if not free[i]) > 4:
                held = grid[key] = [i for i in held if free[i]]
            for i in held:
                if i >= best:
                    break
                if free[i] and min(np.hypot(lines[i, 0] - x, lines[i, 1] - y),
                                   np.hypot(lines[i, 2] - x, lines[i, 3] - y)) < reach:
                    best = i
                    break
        return best

    out = []
    for seed in range(len(ids)):
        if not free[seed]:
            continue
        free[seed] = False
        path = deque([seed])
        while True:
            ahead = lowest_near(*lines[path[0], :2])
            behind = lowest_near(*lines[path[-1], 2:])
            j = min(ahead, behind)
            if j == len(ids):
                break
            free[j] = False
            path.appendleft(j) if ahead == j else path.append(j)
        out += [(ids[seed], place, ids[i]) for place, i in enumerate(path)]
    return out
