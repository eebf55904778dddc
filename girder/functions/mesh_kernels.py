"""Kernels on single meshes with numpy: triangulation, solids from profiles, curves, contours.

They run inside Arrow batches (operators.meshes); nothing here knows Spark.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np

SNAP = 1e-4


def newell(points: np.ndarray) -> np.ndarray:
    """The normal of a loop, as long as twice its area."""
    nxt = np.roll(points, -1, 0)
    return np.array([((points[:, i] - nxt[:, i]) * (points[:, j] + nxt[:, j])).sum() for i, j in ((1, 2), (2, 0), (0, 1))])


def plane_axes(normal: np.ndarray) -> tuple[int, int]:
    """The two coordinates to keep when projecting along the largest part of a normal, orientation kept."""
    k = int(np.abs(normal).argmax())
    a, b = (k + 1) % 3, (k + 2) % 3
    return (a, b) if normal[k] >= 0 else (b, a)


def _area(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _same(a, b) -> bool:
    return a[0] == b[0] and a[1] == b[1]


def _bridge(outer: list[int], hole: list[int], flat: dict) -> list[int]:
    """One loop through a hole: from its rightmost point to the nearest outer point that it sees."""
    start = max(range(len(hole)), key=lambda k: flat[hole[k]][0])
    p = flat[hole[start]]

    def crosses(q) -> bool:
        for loop in (outer, hole):
            for k in range(len(loop)):
                a, b = flat[loop[k]], flat[loop[(k + 1) % len(loop)]]
                if _same(a, p) or _same(a, q) or _same(b, p) or _same(b, q):
                    continue
                if _area(p, q, a) * _area(p, q, b) < 0 and _area(a, b, p) * _area(a, b, q) < 0:
                    return True
        return False

    order = sorted(range(len(outer)), key=lambda k: (flat[outer[k]][0] - p[0]) ** 2 + (flat[outer[k]][1] - p[1]) ** 2)
    at = next((k for k in order if not crosses(flat[outer[k]])), order[0])
    turned = hole[start:] + hole[:start]
    return outer[: at + 1] + turned + [turned[0]] + outer[at:]


def _loop_axes(points: list) -> tuple[int, int]:
    """plane_axes(newell(points)) of a loop as a list: numpy costs more than the sums of a few points."""
    n = [0.0, 0.0, 0.0]
    for k in range(len(points)):
        a, b = points[k], points[(k + 1) % len(points)]
        n[0] += (a[1] - b[1]) * (a[2] + b[2])
        n[1] += (a[2] - b[2]) * (a[0] + b[0])
        n[2] += (a[0] - b[0]) * (a[1] + b[1])
    size = [abs(x) for x in n]
    k = size.index(max(size))
    i, j = (k + 1) % 3, (k + 2) % 3
    return (i, j) if n[k] >= 0 else (j, i)


def triangulate(points, outer: list[int], holes: list[list[int]] = ()) -> list[tuple[int, int, int]]:
    """Triangles of a flat polygon with holes, by cutting ears. Indices are into points, an array or a list of x, y, z.

    Only points of the polygon are read; floats are plain ones, which are far faster one by one than numpy's.
    """
    if len(outer) < 3:
        return []
    if len(outer) == 3 and not holes:
        return [tuple(outer)]
    if isinstance(points, np.ndarray):
        named = sorted({k for loop in (outer, *holes) for k in loop})
        points = dict(zip(named, points[named].tolist(), strict=True))
    u, v = _loop_axes([points[k] for k in outer])
    flat = {k: (points[k][u], points[k][v]) for loop in (outer, *holes) for k in loop}
    loop = list(outer)
    for hole in sorted(holes, key=lambda h: -max(flat[k][0] for k in h)):
        turn = sum(_area(flat[hole[0]], flat[hole[k]], flat[hole[k + 1]]) for k in range(1, len(hole) - 1))
        loop = _bridge(loop, hole if turn < 0 else hole[::-1], flat)
    out: list[tuple[int, int, int]] = []
    while len(loop) > 3:
        n = len(loop)
        best = None
        for k in range(n):
            i, j, m = loop[k - 1], loop[k], loop[(k + 1) % n]
            a, b, c = flat[i], flat[j], flat[m]
            turn = _area(a, b, c)
            if turn < -1e-12:
                continue
            if turn > 1e-12 and any(
                x not in (i, j, m) and _area(a, b, flat[x]) >= 0 and _area(b, c, flat[x]) >= 0 and _area(c, a, flat[x]) >= 0 and not any(_same(flat[x], y) for y in (a, b, c)) for x in loop
            ):
                continue
            best = (k, (i, j, m), turn)
            break
        if best is None:  # no ear is left but for crossing outlines: cut anywhere
            best = (0, (loop[-1], loop[0], loop[1]), 1.0)
        k, triangle, turn = best
        if turn > 1e-12:
            out.append(triangle)
        loop.pop(k)
    if _area(*(flat[k] for k in loop)) > 1e-12:
        out.append(tuple(loop))
    return out


def shell_triangles(points: np.ndarray, profiles: list[list[int]], holes: list[tuple[int, list[int]]] = ()) -> list[tuple[int, int, int]]:
    """Triangles of all profiles, each with the holes that name it."""
    out = []
    for k, profile in enumerate(profiles):
        out += triangulate(points, list(profile), [list(h) for p, h in holes if p == k])
    return out


def raw_shell(points: np.ndarray, triangles: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """A shell with one profile for each triangle, equal points merged."""
    keys, inverse = np.unique(np.round(points / SNAP).astype(np.int64), axis=0, return_inverse=True)
    return keys * SNAP, inverse.ravel()[np.asarray(triangles)].tolist()


def extrude(profile: np.ndarray, direction=(0.0, 0.0, 1.0), length: float = 1.0, cap: bool = True) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The solid that a closed profile sweeps along a direction."""
    d = np.asarray(direction, float)
    d = d / np.linalg.norm(d) * length
    n = len(profile)
    if newell(profile) @ d < 0:
        profile = profile[::-1]
    points = np.concatenate([profile, profile + d])
    out = []
    for k in range(n):
        m = (k + 1) % n
        out += [(k, m, n + m), (k, n + m, n + k)]
    if cap:
        lid = triangulate(points, list(range(n)))
        out += [(a, c, b) for a, b, c in lid] + [(a + n, b + n, c + n) for a, b, c in lid]
    return points, out


def wall(start=(0.0, 0.0, 0.0), end=(1.0, 0.0, 0.0), height: float = 3.0, thickness: float = 0.1, offset: float = 0.0, up=(0.0, 1.0, 0.0)) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """A straight wall: its footprint to both sides of the axis, extruded upwards."""
    a, b, u = np.asarray(start, float), np.asarray(end, float), np.asarray(up, float)
    side = np.cross(b - a, u)
    side = side / np.linalg.norm(side)
    footprint = np.array([p + side * s for p, s in ((a, offset - thickness / 2), (b, offset - thickness / 2), (b, offset + thickness / 2), (a, offset + thickness / 2))])
    return extrude(footprint, u, height)


def revolve(profile: np.ndarray, start: float = 0.0, end: float = 180.0, segments: int = 12) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The surface that a profile sweeps about the z axis, angles in degrees."""
    angles = np.radians(np.linspace(start, end, segments + 1))
    turn = lambda t: np.array([[math.cos(t), -math.sin(t), 0], [math.sin(t), math.cos(t), 0], [0, 0, 1]])
    points = np.concatenate([profile @ turn(t).T for t in angles])
    n, out = len(profile), []
    for r in range(segments):
        for k in range(n - 1):
            a, b = r * n + k, (r + 1) * n + k
            out += [(a, b, b + 1), (a, b + 1, a + 1)]
    return points, out


def arc(radius_x: float = 1.0, radius_y: float = 1.0, segments: int = 12, start: float = 0.0, end: float = math.pi) -> np.ndarray:
    t = np.linspace(start, end, segments + 1)
    return np.stack([radius_x * np.cos(t), radius_y * np.sin(t), np.zeros_like(t)], 1)


def parabola(segments: int = 12, length: float = 10.0, height: float = 2.0, gradient: float = 5.0, end_gradient: float = 0.0) -> np.ndarray:
    """A vertical curve whose gradient goes evenly from one value to another."""
    x = np.linspace(0.0, length, segments + 1)
    return np.stack([x, height + gradient * x + (end_gradient - gradient) * x * x / (2 * length), np.zeros_like(x)], 1)


def box(low=(0.0, 0.0, 0.0), high=(1.0, 1.0, 1.0)) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    a, b = np.asarray(low, float), np.asarray(high, float)
    base = np.array([[a[0], a[1], a[2]], [b[0], a[1], a[2]], [b[0], b[1], a[2]], [a[0], b[1], a[2]]])
    return extrude(base, (0, 0, 1), b[2] - a[2])


def volume(points: np.ndarray, triangles) -> float:
    t = points[np.asarray(triangles)]
    return float(np.einsum("ij,ij->i", t[:, 0], np.cross(t[:, 1], t[:, 2])).sum() / 6)


def circle_through(a, b, c) -> tuple[np.ndarray, float, float]:
    """Centre, radius and signed angle of the arc from a over b to c."""
    a, b, c = (np.asarray(x, float) for x in (a, b, c))
    u, v = b - a, c - a
    n = np.cross(u, v)
    if (nn := n @ n) < 1e-18:
        return a, math.inf, 0.0
    centre = a + (np.cross(n, u) * (v @ v) + np.cross(v, n) * (u @ u)) / (2 * nn)
    x = a - centre
    y = np.cross(n / math.sqrt(nn), x)
    at = lambda p: math.atan2((p - centre) @ y, (p - centre) @ x) % (2 * math.pi)
    return centre, float(np.linalg.norm(x)), at(c)


def stitch(segments: np.ndarray) -> list[tuple[list[tuple[float, float]], bool]]:
    """Chains of flat segments that share end points (to SNAP), and whether each is closed; points are dropped of no length."""
    ends = [((a, b), (c, d)) for a, b, c, d in np.trunc(np.asarray(segments, float).reshape(-1, 4) / SNAP).astype(np.int64).tolist()]
    at: dict[tuple, list[int]] = {}
    live = [k for k, (a, b) in enumerate(ends) if a != b]
    for k in reversed(live):  # the first of a point is its list's last
        for e in (0, 1):
            at.setdefault(ends[k][e], []).append(k)
    used, out = set(), []
    for first in live:
        if first in used:
            continue
        used.add(first)
        chain = deque(ends[first])
        for grow in (1, 0):
            while True:
                tip = chain[-1] if grow else chain[0]
                here = at[tip]
                while here and here[-1] in used:
                    here.pop()
                if not here:
                    break
                nxt = here.pop()
                used.add(nxt)
                far = ends[nxt][1] if ends[nxt][0] == tip else ends[nxt][0]
                chain.append(far) if grow else chain.appendleft(far)
        closed = len(chain) > 3 and chain[0] == chain[-1]
        if closed:
            chain.pop()
        out.append(([(x * SNAP, y * SNAP) for x, y in chain], closed))
    return out


def hit_triangles(origin: np.ndarray, direction: np.ndarray, triangles: np.ndarray) -> np.ndarray:
    """Distances along a ray to triangles (n, 3, 3); infinite where it misses."""
    a, e1, e2 = triangles[:, 0], triangles[:, 1] - triangles[:, 0], triangles[:, 2] - triangles[:, 0]
    p = np.cross(direction, e2)
    det = np.einsum("ij,ij->i", e1, p)
    with np.errstate(divide="ignore", invalid="ignore"):
        s = origin - a
        u = np.einsum("ij,ij->i", s, p) / det
        w = np.cross(s, e1)
        v = w @ direction / det
        t = np.einsum("ij,ij->i", e2, w) / det
        good = (np.abs(det) > 1e-12) & (u >= -1e-9) & (v >= -1e-9) & (u + v <= 1 + 1e-9) & (t >= 0)
    return np.where(good, t, np.inf)
