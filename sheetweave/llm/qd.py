"""Singular values and right singular vectors of a small triangular matrix.

Householder reflections make it bidiagonal, dqds finds the squared singular values to high relative
accuracy, and twisted factorisations of B'B - lambda give the vectors. ``q`` holds the squares of
the diagonal and ``e`` those of the superdiagonal throughout.
"""

from __future__ import annotations

import numpy as np

EPSILON = np.finfo(np.float64).eps
#: Neighbouring eigenvalues closer than this share are made orthogonal to each other.
CLOSE = 1e-3


def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """The unit normal of the mirror that takes ``x`` to a multiple of the first axis, and that multiple."""
    size = float(np.linalg.norm(x))
    if size == 0:
        return np.zeros_like(x), 0.0
    to = -size if x[0] >= 0 else size
    normal = x.copy()
    normal[0] -= to
    return normal / np.linalg.norm(normal), to


def bidiagonal(square: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal, none negative, and the orthogonal V of square = U B V'."""
    a = square.astype(np.float64, copy=True)
    size = len(a)
    turn = np.eye(size)
    for k in range(size):
        normal, a[k, k] = reflector(a[k:, k])
        a[k + 1:, k] = 0
        a[k:, k + 1:] -= 2 * np.outer(normal, normal @ a[k:, k + 1:])
        if k + 1 < size:
            normal, to = reflector(a[k, k + 1:])
            a[k, k + 1:] = 0
            a[k, k + 1] = to
            a[k + 1:, k + 1:] -= 2 * np.outer(a[k + 1:, k + 1:] @ normal, normal)
            turn[:, k + 1:] -= 2 * np.outer(turn[:, k + 1:] @ normal, normal)
    main, upper = np.diag(a).copy(), np.diag(a, 1).copy()
    sign = 1.0
    for k in range(size):  # signs go into V
        turn[:, k] *= sign
        sign = sign if main[k] >= 0 else -sign
        if k + 1 < size:
            sign = sign if upper[k] >= 0 else -sign
    return np.abs(main), np.abs(upper), turn


def sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One differential qd transform with a shift; None if the shift exceeds the smallest value."""
    d, new_q, new_e = q[0] - shift, [], []
    for k in range(len(e)):
        if d < 0:
            return None
        new_q.append(d + e[k])
        share = q[k + 1] / new_q[k]
        new_e.append(e[k] * share)
        d = d * share - shift
    return None if d < 0 else (new_q + [d], new_e)


def lower_bound(q: list[float], e: list[float]) -> float:
    """A lower bound of the smallest value: one over the trace of the inverse, whose terms are all positive."""
    term = trace = 0.0
    for k in range(len(q) - 1, -1, -1):
        if q[k] == 0:
            return 0.0
        term = (1 + (e[k] * term if k < len(e) else 0.0)) / q[k]
        trace += term
    return (1 - 8 * EPSILON * len(q)) / trace if trace < float("inf") else 0.0


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """All squared singular values, falling. Segments split where ``e`` is negligible."""
    scale = float(max(q.max(initial=0), e.max(initial=0)))
    if scale == 0:
        return np.zeros(len(q))
    values: list[float] = []
    open_ = [((q / scale).tolist(), (e / scale).tolist(), 0.0)]
    sweeps = 0
    while open_:
        q_, e_, moved = open_.pop()
        cut = next((k for k in range(len(e_)) if e_[k] <= EPSILON ** 2 * (moved + min(q_[k], q_[k + 1]))
                    or e_[k] <= EPSILON ** 2 * moved), None)
        if len(q_) == 1:
            values.append(q_[0] + moved)
        elif cut is not None:
            open_ += [(q_[:cut + 1], e_[:cut], moved), (q_[cut + 1:], e_[cut + 1:], moved)]
        else:
            if 1.5 * q_[0] < q_[-1]:
                q_, e_ = q_[::-1], e_[::-1]
            shift = lower_bound(q_, e_)
            while (found := sweep(q_, e_, shift)) is None:
                shift = shift / 4 if shift > 1e-300 else 0.0
            open_.append((*found, moved + shift))
            sweeps += 1
            if sweeps > 200 * len(q):
                raise ArithmeticError("dqds does not converge")
    return np.sort(np.array(values))[::-1] * scale


def twisted(q: np.ndarray, e: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For T = B'B - value: the factors above and below each twist, and the twists' pivots."""
    size, tiny = len(q), np.finfo(np.float64).tiny / EPSILON
    cross = np.sqrt(q[:-1]) * np.sqrt(e)
    down, up = np.empty(max(size - 1, 0)), np.empty(max(size - 1, 0))
    s, p = np.empty(size), np.empty(size)
    s[0], p[-1] = -value, q[-1] - value
    for k in range(size - 1):
        pivot = s[k] + q[k]
        pivot = pivot if abs(pivot) > tiny else tiny
        down[k] = cross[k] / pivot
        s[k + 1] = e[k] * (s[k] / pivot) - value
    for k in range(size - 2, -1, -1):
        pivot = e[k] + p[k + 1]
        pivot = pivot if abs(pivot) > tiny else tiny
        up[k] = cross[k] / pivot
        p[k] = q[k] * (p[k + 1] / pivot) - value
    return down, up, s + p + value


def solve(down: np.ndarray, up: np.ndarray, at: int) -> np.ndarray:
    """The unit vector that the twist at ``at`` gives."""
    z = np.zeros(len(down) + 1)
    z[at] = 1
    for k in range(at - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
        if abs(z[k]) > 1e100:
            z /= abs(z[k])
    for k in range(at, len(down)):
        z[k + 1] = -up[k] * z[k]
        if abs(z[k + 1]) > 1e100:
            z /= abs(z[k + 1])
    return z / np.linalg.norm(z)


def vectors(q: np.ndarray, e: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Columns: orthonormal eigenvectors of B'B for the first ``count`` of the falling ``values``.
    Vectors of close values come from the twists that give the clearest new direction."""
    found = np.zeros((len(q), count))
    for k in range(count):
        first = k
        while first and values[first - 1] - values[k] <= CLOSE * values[first - 1]:
            first -= 1
        down, up, pivots = twisted(q, e, float(values[k]))
        best, norm = None, 0.0
        for at in np.argsort(np.abs(pivots), kind="stable"):
            z = solve(down, up, int(at))
            for _ in range(2):
                z = z - found[:, first:k] @ (found[:, first:k].T @ z)
            own = float(np.linalg.norm(z))
            if own > norm:
                best, norm = z / own, own
            if norm > 0.5:
                break
        found[:, k] = best - found[:, first:k] @ (found[:, first:k].T @ best)
        found[:, k] /= np.linalg.norm(found[:, k])
    return found


def decompose(square: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """All squared singular values, falling, and the right singular vectors (columns) of the first ``count``."""
    main, upper, turn = bidiagonal(square)
    scale = float(max(main.max(initial=0), upper.max(initial=0)))
    if scale == 0:
        return np.zeros(len(main)), np.eye(len(main))[:, :count]
    q, e = (main / scale) ** 2, (upper / scale) ** 2
    values = dqds(q, e)
    return values * scale ** 2, turn @ vectors(q, e, values, count)
