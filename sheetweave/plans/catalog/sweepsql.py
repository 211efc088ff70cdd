"""SQL that walks through ordered items step by step, for comparison in DuckDB.

Each row of the recursion is one drawing; a step takes in the next item that
joins the open one, or closes it and opens the next, or starts another pass.
"""

from __future__ import annotations

from collections.abc import Callable


def walk(name: str, source: str, keys: str, fields: str, order: str, joins: Callable[[str, str], str],
         union: Callable[[str, str], str], passes: bool = True, resort: str | None = None,
         rescan: bool = False) -> str:
    """CTEs ending in ``name`` with the final items ``o`` of each group of ``source``.

    ``joins`` and ``union`` get the SQL names of the open and the other item;
    extra columns of the source (page width) are taken along as ``w``.
    """
    again = "WHEN cur IS NOT NULL AND grew THEN 'again'" if rescan else ""
    following = "WHEN changed THEN 'pass'" if passes else ""
    ordered = "out" if resort is None else (
        f"list_transform(list_sort(list_transform(out, lambda o, i: {{'k': {resort}, 'i': i, 'o': o}})), lambda q: q.o)")
    return f"""
{name}_packed AS (SELECT {keys}, any_value(w) w, list({{{fields}}} ORDER BY {order}) items FROM {source} GROUP BY {keys}),
{name}_walk AS (SELECT {keys}, w, 0 step, items, list_transform(items, lambda q: true) free, items[1] cur, false open,
  0 pos, items[1:0] out, false changed, false grew, false done FROM {name}_packed
 UNION ALL
 SELECT {keys}, w, step+1, CASE act WHEN 'pass' THEN {ordered} ELSE items END,
  CASE act WHEN 'pass' THEN list_transform(items[1:len(out)], lambda q: true)
   WHEN 'take' THEN list_transform(free, lambda f, i: f AND i <> nxt)
   WHEN 'seed' THEN list_transform(free, lambda f, i: f AND i <> sd) ELSE free END,
  CASE act WHEN 'take' THEN {union('cur', 'items[nxt]')} WHEN 'seed' THEN items[sd] ELSE cur END,
  CASE act WHEN 'emit' THEN false WHEN 'seed' THEN true ELSE open END,
  CASE act WHEN 'take' THEN nxt WHEN 'seed' THEN sd WHEN 'again' THEN 0 ELSE pos END,
  CASE act WHEN 'emit' THEN list_append(out, cur) WHEN 'pass' THEN items[1:0] ELSE out END,
  CASE act WHEN 'take' THEN true WHEN 'pass' THEN false ELSE changed END,
  CASE act WHEN 'take' THEN true WHEN 'again' THEN false WHEN 'seed' THEN false ELSE grew END, act = 'stop'
 FROM (SELECT *, CASE WHEN open AND nxt IS NOT NULL THEN 'take' {again.replace('cur IS NOT NULL', 'open')}
   WHEN open THEN 'emit' WHEN sd IS NOT NULL THEN 'seed' {following} ELSE 'stop' END act
  FROM (SELECT *, list_filter(range(1, len(items)+1), lambda j: free[j])[1] sd,
    CASE WHEN open THEN list_filter(range(pos+1, len(items)+1), lambda j: free[j] AND {joins('cur', 'items[j]')})[1] END nxt
   FROM {name}_walk WHERE NOT done) a) b),
{name} AS (SELECT {keys}, w, unnest(out) o FROM {name}_walk WHERE done)"""


# --- texts -------------------------------------------------------------------

TEXT_FIELDS = "'id': text_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 't': t, 's': score"
READING = "{'y': o.y1, 'x': o.x1}"


def tag(t: str) -> str:
    return rf"regexp_full_match(replace({t}.t, ' ', ''), '[A-Z]{{1,3}}-?\d{{2,5}}[A-Z]?|SG\d+|PC|FO|N\d+|E\d+|ATM')"


def wordy(t: str) -> str:
    return rf"regexp_full_match(upper({t}.t), '[A-Z][A-Z\s\-]{{2,}}')"


def _shared(a: str, b: str, axis: str) -> str:
    return (f"greatest(0, least({a}.{axis}2, {b}.{axis}2)-greatest({a}.{axis}1, {b}.{axis}1))"
            f"/greatest(1, least({a}.{axis}2-{a}.{axis}1, {b}.{axis}2-{b}.{axis}1))")


def _gap(a: str, b: str, axis: str) -> str:
    return f"CASE WHEN {b}.{axis}1 < {a}.{axis}1 THEN {a}.{axis}1-{b}.{axis}2 ELSE {b}.{axis}1-{a}.{axis}2 END"


def rows_join(a: str, b: str) -> str:
    return (f"({_shared(a, b, 'y')} >= 0.55 AND {_gap(a, b, 'x')} <= 1.2*greatest(1, least({a}.y2-{a}.y1, {b}.y2-{b}.y1))"
            f" AND ({tag(a)} OR {tag(b)} OR {wordy(a)} OR {wordy(b)} OR length({a}.t) <= 2 OR length({b}.t) <= 2)"
            f" AND greatest({a}.x2, {b}.x2)-least({a}.x1, {b}.x1) <= 0.22*w)")


def blocks_join(a: str, b: str) -> str:
    gap = _gap(a, b, "y")
    return (f"({_shared(a, b, 'x')} >= 0.55 AND ({wordy(a)} OR {wordy(b)})"
            f" AND NOT ({gap} > 0.35*greatest(1, least({a}.x2-{a}.x1, {b}.x2-{b}.x1)) AND {gap} > 25))")


def _united(a: str, b: str, text: str) -> str:
    return (f"{{'id': {a}.id, 'x1': least({a}.x1, {b}.x1), 'y1': least({a}.y1, {b}.y1), 'x2': greatest({a}.x2, {b}.x2),"
            f" 'y2': greatest({a}.y2, {b}.y2), 't': {text}, 's': greatest({a}.s, {b}.s)}}")


def rows_union(a: str, b: str) -> str:
    tight = f"{tag(a)} OR {tag(b)} OR length({a}.t) <= 2 OR length({b}.t) <= 2"
    return _united(a, b, f"trim({a}.t || CASE WHEN {tight} THEN '' ELSE ' ' END || {b}.t)")


def blocks_union(a: str, b: str) -> str:
    return _united(a, b, f"trim({a}.t || ' ' || {b}.t)")


def close_join(a: str, b: str) -> str:
    return f"(abs({b}.y1-{a}.y1) < 6 AND {b}.x1-{a}.x2 > 0 AND {b}.x1-{a}.x2 < 12)"


def close_union(a: str, b: str) -> str:
    return (f"{{'id': {a}.id, 'x1': {a}.x1, 'y1': {a}.y1, 'x2': {b}.x2, 'y2': {a}.y2, 't': {a}.t || {b}.t, 's': {a}.s}}")


# --- lines -------------------------------------------------------------------

LINE_FIELDS = "'id': line_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2"


def _length(s: str) -> str:
    return f"sqrt(({s}.x2-{s}.x1)*({s}.x2-{s}.x1)+({s}.y2-{s}.y1)*({s}.y2-{s}.y1))"


def _angle(s: str) -> str:
    return f"degrees(atan2({s}.y2-{s}.y1, {s}.x2-{s}.x1))"


def _off(s: str, p: str, n: int) -> str:
    return (f"abs(({s}.x2-{s}.x1)*({p}.y{n}-{s}.y1)-({s}.y2-{s}.y1)*({p}.x{n}-{s}.x1))/({_length(s)}+1e-9)")


def _along(a: str, p: str, n: int) -> str:
    return f"(({p}.x{n}-{a}.x1)*cos(radians({_angle(a)}))+({p}.y{n}-{a}.y1)*sin(radians({_angle(a)})))"


def segments_join(a: str, b: str) -> str:
    d = f"(abs({_angle(a)}-{_angle(b)})%360.0)"
    fold = f"least({d}, 360.0-{d})"
    t = [_along(a, b, 1), _along(a, b, 2)]
    end = _along(a, a, 2)
    return (f"({_length(a)} >= 1 AND {_length(b)} >= 1 AND least({fold}, abs({fold}-180.0)) <= 5"
            f" AND least({_off(a, b, 1)}, {_off(a, b, 2)}, {_off(b, a, 1)}, {_off(b, a, 2)}) <= 20"
            f" AND greatest(least(0, {end}), least({t[0]}, {t[1]}))-least(greatest(0, {end}), greatest({t[0]}, {t[1]})) <= 30)")


def segments_union(a: str, b: str) -> str:
    ends = ", ".join(f"{{'t': {_along(a, p, n)}, 'i': {{s}}{i}, 'x': {p}.x{n}, 'y': {p}.y{n}}}"
                     for i, (p, n) in enumerate(((a, 1), (a, 2), (b, 1), (b, 2))))
    low, high = f"list_min([{ends.replace('{s}', '')}])", f"list_max([{ends.replace('{s}', '-')}])"
    return f"{{'id': {a}.id, 'x1': {low}.x, 'y1': {low}.y, 'x2': {high}.x, 'y2': {high}.y}}"


def editor_join(a: str, b: str) -> str:
    d = f"abs(({_angle(a)}%180+180)%180-({_angle(b)}%180+180)%180)"
    near = ", ".join(f"sqrt(power({a}.x{i}-{b}.x{j}, 2)+power({a}.y{i}-{b}.y{j}, 2))" for i in (1, 2) for j in (1, 2))
    return f"(least({d}, 180-{d}) < 5 AND {_length(a)} > 0 AND least({near}) <= 15)"


def editor_union(a: str, b: str) -> str:
    ux, uy = f"(({a}.x2-{a}.x1)/{_length(a)})", f"(({a}.y2-{a}.y1)/{_length(a)})"
    ends = ", ".join(f"{{'t': ({p}.x{n}-{a}.x1)*{ux}+({p}.y{n}-{a}.y1)*{uy}, 'x': {p}.x{n}, 'y': {p}.y{n}}}"
                     for p in (a, b) for n in (1, 2))
    return (f"{{'id': {a}.id, 'x1': list_min([{ends}]).x, 'y1': list_min([{ends}]).y, 'x2': list_max([{ends}]).x,"
            f" 'y2': list_max([{ends}]).y, 'd': CASE WHEN {a}.d <> 'none' THEN {a}.d ELSE {b}.d END}}")


# --- masks -------------------------------------------------------------------


def shared_pixels(a: str, b: str) -> str:
    """Pixels that two lists of strips share."""
    return (f"coalesce(list_sum(list_transform({a}, lambda p: coalesce(list_sum(list_transform(list_filter({b},"
            f" lambda q: q.k = p.k), lambda q: bit_count(q.b & p.b))), 0))), 0)")


def united_pixels(a: str, b: str) -> str:
    both = (f"list_transform({a}, lambda p: {{'k': p.k, 'b': p.b | coalesce(list_filter({b}, lambda q: q.k = p.k)[1].b, 0)}})")
    return f"list_concat({both}, list_filter({b}, lambda q: len(list_filter({a}, lambda p: p.k = q.k)) = 0))"


def masks_join(a: str, b: str, iou_limit: float = 0.8, reach: int = 20) -> str:
    """Whether mask b belongs to the kept mask a."""
    dx = f"greatest(0, {a}.x1-{b}.x2, {b}.x1-{a}.x2)"
    dy = f"greatest(0, {a}.y1-{b}.y2, {b}.y1-{a}.y2)"
    near = f"sqrt({dx}*{dx}+{dy}*{dy})"
    touch = f"({a}.x1 < {b}.x2 AND {b}.x1 < {a}.x2 AND {a}.y1 < {b}.y2 AND {b}.y1 < {a}.y2)"
    inter = f"(CASE WHEN {touch} THEN {shared_pixels(f'{a}.px', f'{b}.px')} ELSE 0 END)"
    iou = f"({inter}/({a}.area+{b}.area-{inter}))"

    def ratio(p, q, least):
        return f"greatest({p}, {q})/greatest(least({p}, {q}), {least})"

    size = ratio(f"{a}.area", f"{b}.area", 1)
    stretch = ratio(*(f"(({m}.x2-{m}.x1)/greatest({m}.y2-{m}.y1, 1))" for m in (a, b)), 0.01)
    ox, oy = (f"(abs(({a}.{c}1+{a}.{c}2)/2-({b}.{c}1+{b}.{c}2)/2))" for c in "xy")

    def aligned(off, side):
        return f"(1-least({off}/greatest((({a}.{side}2-{a}.{side}1)+({b}.{side}2-{b}.{side}1))/2, 1), 1))"

    best = (f"greatest(CASE WHEN {ox} > 0 THEN {aligned(oy, 'y')} ELSE 1.0 END, CASE WHEN {oy} > 0 THEN {aligned(ox, 'x')} ELSE 1.0 END)")
    score = f"(CASE WHEN {dx} = 0 OR {dy} = 0 THEN least({best}*1.2, 1.0::DOUBLE) ELSE {best}*0.8 END)"
    filled = (f"({a}.area+{b}.area)/greatest((greatest({a}.x2, {b}.x2)-least({a}.x1, {b}.x1))"
              f"*(greatest({a}.y2, {b}.y2)-least({a}.y1, {b}.y1)), 1)")
    beside = (f"({near} <= {reach} AND (({score} > 0.5 AND {size} < 5 AND {stretch} < 4 AND {filled} > 0.2)"
              f" OR ({near} < {0.6 * reach} AND {score} > 0.4 AND {size} < 6 AND {filled} > 0.15)"
              f" OR ({score} > 0.7 AND {near} < {0.8 * reach} AND {size} < 8)))")
    w = f"greatest(least({b}.x2, {a}.x2+{reach})-greatest({b}.x1, {a}.x1-{reach}), 0)"
    h = f"greatest(least({b}.y2, {a}.y2+{reach})-greatest({b}.y1, {a}.y1-{reach}), 0)"
    inside = f"{w}*{h}/greatest(({b}.x2-{b}.x1)*({b}.y2-{b}.y1), 1) > 0.6"
    return (f"({near} <= {reach} AND CASE WHEN {iou} > {iou_limit} THEN true WHEN {inter} = 0 OR {iou} < 0.1 THEN {beside}"
            f" ELSE {inside} END)")
