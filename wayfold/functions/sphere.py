"""Spherical geometry on numpy arrays: vectors, edges, triangles, loops, polylines, caps, rectangles, cells, coverings.

Points are unit vectors in the last axis. Orientation is decided in floating point and, where that is not safe, in exact
rational arithmetic, so the sign of three distinct points is never 0 unless they lie on one great circle.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np

from wayfold.functions.cells import POSITION, TURN

MAX_LEVEL = 30
DEFAULT_MAX_CELLS = 8


def point(lat, lng) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lng)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=-1)


def lat_lng(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.degrees(np.arctan2(p[..., 2], np.hypot(p[..., 0], p[..., 1]))), np.degrees(np.arctan2(p[..., 1], p[..., 0]))


def unit(p: np.ndarray) -> np.ndarray:
    return p / np.maximum(np.linalg.norm(p, axis=-1, keepdims=True), 1e-300)


def angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arctan2(np.linalg.norm(np.cross(a, b), axis=-1), (a * b).sum(axis=-1))


def rotate(p: np.ndarray, axis: np.ndarray, radians: float) -> np.ndarray:
    axis = unit(axis)
    along = axis * (p * axis).sum(axis=-1, keepdims=True)
    return along + (p - along) * np.cos(radians) + np.cross(axis, p) * np.sin(radians)


def interpolate(t: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The point at fraction ``t`` of the arc from a to b; beyond 0 and 1 it goes on."""
    theta = angle(a, b)
    if theta == 0:
        return a
    tangent = unit(np.cross(np.cross(a, b), a))
    return unit(a * np.cos(t * theta) + tangent * np.sin(t * theta))


# ---------------------------------------------------------------- predicates


def sign(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> int:
    """1 if a, b, c turn left, -1 if right, 0 if they lie on one great circle (exactly)."""
    det = float(np.dot(np.cross(a, b), c))
    if abs(det) > 4e-15:
        return 1 if det > 0 else -1
    x, y, z = ([Fraction(float(v)) for v in p] for p in (a, b, c))
    det = x[0] * (y[1] * z[2] - y[2] * z[1]) - x[1] * (y[0] * z[2] - y[2] * z[0]) + x[2] * (y[0] * z[1] - y[1] * z[0])
    return (det > 0) - (det < 0)


def compare_distances(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> int:
    """-1 if a is nearer to x than b, 1 if farther, 0 if as far; exact for the vectors as given."""
    d = float(np.dot(x, b) - np.dot(x, a))
    if abs(d) > 1e-15:
        return -1 if d < 0 else 1
    f = lambda p: sum(Fraction(float(u)) * Fraction(float(v)) for u, v in zip(x, p, strict=True))
    n = lambda p: sum(Fraction(float(v)) ** 2 for v in p)
    l, r = f(b) * abs(f(b)) * n(a), f(a) * abs(f(a)) * n(b)
    return (l > r) - (l < r)


def crossing(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> int:
    """1 if edges ab and cd cross inside, 0 if they share a vertex, -1 if neither."""
    same = lambda p, q: bool((p == q).all())
    if same(a, c) or same(a, d) or same(b, c) or same(b, d):
        return 0
    if same(a, b) or same(c, d):
        return -1
    abc, bcd = sign(a, b, c), sign(b, c, d)
    return 1 if abc and -abc == sign(a, b, d) and bcd == -sign(a, c, d) and sign(c, d, a) == -sign(c, d, b) and abc == -sign(a, b, d) and _faces(a, b, c, d) else -1


def _faces(a, b, c, d) -> bool:
    """Edges that are told apart by signs may still lie on opposite sides of the sphere."""
    x = np.cross(np.cross(a, b), np.cross(c, d))
    return bool(np.dot(x, a + b) * np.dot(x, c + d) > 0)


def intersection(a, b, c, d) -> np.ndarray:
    x = unit(np.cross(np.cross(a, b), np.cross(c, d)))
    return x if np.dot(x, a + b) >= 0 else -x


# ---------------------------------------------------------------- edges and polylines


def closest_on_edge(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = np.cross(a, b)
    if np.linalg.norm(n) < 1e-300:
        return a
    p = unit(x - n * (np.dot(x, n) / np.dot(n, n)))
    if np.dot(np.cross(n, a), p) >= 0 and np.dot(np.cross(b, n), p) >= 0:
        return p
    return a if angle(x, a) <= angle(x, b) else b


def edge_distance(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    return float(angle(x, closest_on_edge(x, a, b)))


def edge_pair_distance(a, b, c, d) -> float:
    if crossing(a, b, c, d) >= 0:
        return 0.0
    return min(edge_distance(a, c, d), edge_distance(b, c, d), edge_distance(c, a, b), edge_distance(d, a, b))


def length(line: np.ndarray) -> float:
    return float(angle(line[:-1], line[1:]).sum()) if len(line) > 1 else 0.0


def along(line: np.ndarray, fraction: float) -> np.ndarray:
    """The point at a fraction of the line's length; below 0 and above 1 its ends."""
    if fraction <= 0 or len(line) == 1:
        return line[0]
    steps = angle(line[:-1], line[1:])
    left = fraction * steps.sum()
    for k, s in enumerate(steps):
        if left < s:
            return interpolate(left / s, line[k], line[k + 1])
        left -= s
    return line[-1]


def project(line: np.ndarray, x: np.ndarray) -> tuple[int, np.ndarray]:
    """Nearest edge (the first of equals) and nearest point."""
    if len(line) == 1:
        return 0, line[0]
    best = min(range(len(line) - 1), key=lambda k: (edge_distance(x, line[k], line[k + 1]), k))
    return best, closest_on_edge(x, line[best], line[best + 1])


def fraction_of(line: np.ndarray, x: np.ndarray) -> float:
    k, p = project(line, x)
    whole = length(line)
    return min(1.0, (length(line[: k + 1]) + float(angle(line[k], p))) / whole) if whole else 0.0


def subsample(line: np.ndarray, tolerance: float) -> list[int]:
    """Vertices to keep: each time the farthest next vertex such that all vertices between lie within ``tolerance`` of the edge."""
    keep, at = [0], 0
    while at + 1 < len(line):
        far = at + 1
        for k in range(at + 2, len(line)):
            if angle(line[at], line[k]) > np.pi / 2 or any(edge_distance(line[m], line[at], line[k]) > tolerance for m in range(at + 1, k)):
                break
            far = k
        at = far
        if not (line[at] == line[keep[-1]]).all():
            keep.append(at)
    return keep


def lines_intersect(p: np.ndarray, q: np.ndarray) -> bool:
    return any(crossing(p[i], p[i + 1], q[j], q[j + 1]) >= 0 for i in range(len(p) - 1) for j in range(len(q) - 1))


# ---------------------------------------------------------------- triangles and loops


def signed_area(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
    """Area of a triangle, negative if it turns right."""
    num = float(np.dot(a, np.cross(b, c)))
    return 2 * np.arctan2(num, 1 + float(np.dot(a, b) + np.dot(b, c) + np.dot(c, a)))


def triangle_area(a, b, c) -> float:
    return abs(signed_area(a, b, c))


def turn_angle(a, b, c) -> float:
    """Exterior angle at b, positive for a left turn."""
    t = float(angle(np.cross(a, b), np.cross(b, c)))
    return t if sign(a, b, c) > 0 else -t


def loop_area(loop: np.ndarray) -> float:
    """Area to the left of a loop, 0 to 4 pi."""
    if len(loop) < 3:
        return 0.0
    total = sum(signed_area(loop[0], loop[k], loop[k + 1]) for k in range(1, len(loop) - 1))
    return float(total if total >= 0 else total + 4 * np.pi)


def loop_centroid(loop: np.ndarray) -> np.ndarray:
    """True centroid times area: half the sum over edges of the arc's normal times its angle."""
    nxt = np.roll(loop, -1, axis=0)
    n = np.cross(loop, nxt)
    size = np.linalg.norm(n, axis=1, keepdims=True)
    return 0.5 * (n / np.maximum(size, 1e-300) * angle(loop, nxt)[:, None]).sum(axis=0)


def turning(loop: np.ndarray) -> float:
    n = len(loop)
    return sum(turn_angle(loop[k - 1], loop[k], loop[(k + 1) % n]) for k in range(n))


def loop_contains(loop: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Which points (rows) a loop contains: winding of the loop seen from each point, area to the left inside."""
    if len(loop) < 3:
        return np.zeros(len(p), bool)
    nxt = np.roll(loop, -1, axis=0)
    cross = np.cross(loop, nxt)
    turn = np.zeros(len(p))
    for k in range(len(loop)):
        a, b = loop[k], nxt[k]
        y = p @ cross[k]
        x = (p @ a) * (p @ b) * -1 + float(np.dot(a, b))
        turn += np.arctan2(y, x)
    inside = turn > np.pi
    small = loop_area(loop) <= 2 * np.pi
    return inside if small else ~(turn < -np.pi)


def polygon_contains(loops: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """Points in an odd number of loops (shells and holes both run with their own inside to the left)."""
    out = np.zeros(len(p), bool)
    for loop in loops:
        out ^= loop_contains(loop, p)
    return out


def polygon_area(loops: list[np.ndarray]) -> float:
    """Shells less holes, by depth of nesting."""
    total = 0.0
    for i, loop in enumerate(loops):
        middle = unit(loop[:3].sum(axis=0))[None]
        depth = sum(bool(loop_contains(o, middle)[0]) for j, o in enumerate(loops) if j != i)
        total += -loop_area(loop) if depth % 2 else loop_area(loop)
    return total


def loop_distance(loop: np.ndarray, x: np.ndarray) -> float:
    return min(edge_distance(x, loop[k], loop[(k + 1) % len(loop)]) for k in range(len(loop)))


def regular_loop(center: np.ndarray, radius: float, n: int) -> np.ndarray:
    axis = np.array([0.0, 0, 1]) if abs(center[2]) < 0.9 else np.array([1.0, 0, 0])
    x = unit(np.cross(axis, center))
    y = np.cross(center, x)
    t = np.arange(n) * 2 * np.pi / n
    return unit(center * np.cos(radius) + (x * np.cos(t)[:, None] + y * np.sin(t)[:, None]) * np.sin(radius))


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
    return float((b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]))


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Hull of points within a hemisphere, turning left: the monotone chain on their gnomonic projection about their mean.
    Fewer than three distinct points give themselves; points over more than a hemisphere give an empty array."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points
    c = unit(points.sum(axis=0))
    if (points @ c <= 1e-12).any():
        return points[:0]
    axis = np.eye(3)[int(np.argmin(np.abs(c)))]
    x = unit(np.cross(axis, c))
    y = np.cross(c, x)
    flat = np.stack([points @ x, points @ y], axis=1) / (points @ c)[:, None]
    order = np.lexsort((flat[:, 1], flat[:, 0]))

    def half(ids) -> list[int]:
        out: list[int] = []
        for k in ids:
            while len(out) > 1 and _turn(flat[out[-2]], flat[out[-1]], flat[k]) <= 0:
                out.pop()
            out.append(int(k))
        return out[:-1]

    return points[half(order) + half(order[::-1])]


# ---------------------------------------------------------------- cells

_UV = lambda s: (4 * s * s - 1) / 3 if s >= 0.5 else (1 - 4 * (1 - s) * (1 - s)) / 3


def face_xyz(face: int, u: float, v: float) -> np.ndarray:
    return np.array([(1, u, v), (-u, 1, v), (-u, -v, 1), (-1, -v, -u), (v, -1, -u), (v, u, -1)][face], float)


def _face_uv(p) -> tuple[int, float, float]:
    x, y, z = (float(v) for v in p)
    axis = 0 if abs(x) >= abs(y) and abs(x) >= abs(z) else 1 if abs(y) >= abs(z) else 2
    face = axis + (3 if (x, y, z)[axis] < 0 else 0)
    w = (x, y, z)[axis]
    u, v = ((y, z), (-x, z), (-x, -y), (z, y), (z, -x), (-y, -x))[face]
    u, v = u / w, v / w
    return face, u, v


def _st(u: float) -> float:
    return 0.5 * (1 + 3 * u) ** 0.5 if u >= 0 else 1 - 0.5 * (1 - 3 * u) ** 0.5


def cell_at(face: int, i: int, j: int, level: int = MAX_LEVEL) -> int:
    """Unsigned id of the cell of ``level`` that holds leaf (i, j) of a face."""
    cid, o = face, face & 1
    for k in range(29, 29 - level, -1):
        pos = POSITION[o][2 * (i >> k & 1) + (j >> k & 1)]
        cid, o = 4 * cid + pos, o ^ TURN[pos]
    return (2 * cid + 1) << (2 * (MAX_LEVEL - level))


def cell_of(p: np.ndarray, level: int = MAX_LEVEL) -> int:
    face, u, v = _face_uv(p)
    ij = [min((1 << 30) - 1, max(0, int(np.floor(_st(w) * (1 << 30))))) for w in (u, v)]
    return cell_at(face, *ij, level)


def cell_level(cid: int) -> int:
    return MAX_LEVEL - ((cid & -cid).bit_length() - 1) // 2


def cell_parent(cid: int, level: int) -> int:
    lsb = 1 << (2 * (MAX_LEVEL - level))
    return (cid & -lsb) & ((1 << 64) - 1) | lsb


def cell_children(cid: int) -> list[int]:
    lsb = (cid & -cid) >> 2
    return [cid + (2 * k - 3) * lsb for k in range(4)]


def cell_range(cid: int) -> tuple[int, int]:
    return cid - (cid & -cid) + 1, cid + (cid & -cid) - 1


def cell_ij(cid: int) -> tuple[int, int, int, int]:
    """Face, lowest i and j of its leaves, and their number along an edge."""
    level, face = cell_level(cid), cid >> 61
    i = j = 0
    o = face & 1
    for k in range(29, 29 - level, -1):
        pos = cid >> (2 * k + 1) & 3
        q = POSITION[o].index(pos)
        i, j, o = 2 * i + (q >> 1), 2 * j + (q & 1), o ^ TURN[pos]
    size = 1 << (MAX_LEVEL - level)
    return face, i * size, j * size, size


def cell_vertices(cid: int) -> np.ndarray:
    """The four vertices, turning left."""
    face, i, j, size = cell_ij(cid)
    lo, hi = (_UV(i / (1 << 30)), _UV(j / (1 << 30))), (_UV((i + size) / (1 << 30)), _UV((j + size) / (1 << 30)))
    return unit(np.stack([face_xyz(face, u, v) for u, v in ((lo[0], lo[1]), (hi[0], lo[1]), (hi[0], hi[1]), (lo[0], hi[1]))]))


def cell_center(cid: int) -> np.ndarray:
    face, i, j, size = cell_ij(cid)
    return unit(face_xyz(face, _UV((i + size / 2) / (1 << 30)), _UV((j + size / 2) / (1 << 30))))


def cell_area(cid: int) -> float:
    v = cell_vertices(cid)
    return triangle_area(v[0], v[1], v[2]) + triangle_area(v[0], v[2], v[3])


def average_area(level: int) -> float:
    return 4 * np.pi / 6 / 4**level


def cell_contains(cid: int, p: np.ndarray) -> bool:
    lo, hi = cell_range(cid)
    return lo <= cell_of(p) <= hi


def cell_distance(cid: int, p: np.ndarray) -> float:
    """Angle from a point to a cell, 0 inside."""
    return 0.0 if cell_contains(cid, p) else loop_distance(cell_vertices(cid), p)


def cell_max_distance(cid: int, p: np.ndarray) -> float:
    """Angle from a point to the farthest point of a cell: what lies nearest to the antipode."""
    return float(np.pi) - cell_distance(cid, -p)


def _wrapped(face: int, i: int, j: int, level: int) -> int:
    """Cell of (i, j), which may lie one cell beyond its face."""
    if 0 <= i < 1 << 30 and 0 <= j < 1 << 30:
        return cell_at(face, i, j, level)
    to = lambda k: max(-1.0, min(1.0, 2 * (k + 0.5) / (1 << 30) - 1)) * (1 + 1e-9) if 0 <= k < 1 << 30 else (1 + 1e-9) * (1 if k > 0 else -1)
    # along the edge the quadratic grid holds on both faces, so only the crossing coordinate is moved just beyond the face
    u = _UV((i + 0.5) / (1 << 30)) if 0 <= i < 1 << 30 else to(i)
    v = _UV((j + 0.5) / (1 << 30)) if 0 <= j < 1 << 30 else to(j)
    return cell_of(face_xyz(face, u, v), level)


def edge_neighbors(cid: int) -> list[int]:
    """The cells of the same level across the four edges: down, right, up, left."""
    face, i, j, size = cell_ij(cid)
    level, half = cell_level(cid), size // 2
    return [_wrapped(face, a, b, level) for a, b in ((i + half, j - 1), (i + size, j + half), (i + half, j + size), (i - 1, j + half))]


def all_neighbors(cid: int, level: int) -> list[int]:
    """All cells of ``level`` (at least the cell's own) that touch it, each once."""
    face, i, j, size = cell_ij(cid)
    step = 1 << (MAX_LEVEL - level)
    out = []
    for k in range(-step, size + step, step):
        at = k + step // 2
        for a, b in ((at, -1), (at, size), (-1, at), (size, at)):
            a, b = (i + a, j + b)
            outside = int(not 0 <= a < 1 << 30) + int(not 0 <= b < 1 << 30)
            if outside < 2:
                out.append(_wrapped(face, a, b, level))
    lo, hi = cell_range(cid)
    return list(dict.fromkeys(c for c in out if not lo <= c <= hi))


def vertex_neighbors(cid: int, level: int) -> list[int]:
    """The three or four cells of ``level`` around its vertex nearest to the cell."""
    c = cell_center(cid)
    mine = cell_parent(cid, level)
    corners = cell_vertices(mine)
    v = corners[int(np.argmax(corners @ c))]
    close = 0.01 * float(angle(corners[0], corners[1]))
    return [x for x in dict.fromkeys([mine, *all_neighbors(mine, level)]) if float(angle(cell_vertices(x), v).min()) < close]


# ---------------------------------------------------------------- unions of cells


def normalize(cells: list[int]) -> list[int]:
    """Sorted, without cells inside others, and four children joined to their parent."""
    out: list[int] = []
    for c in sorted(set(cells)):
        if out and cell_range(out[-1])[0] <= c <= cell_range(out[-1])[1]:
            continue
        while out and cell_range(c)[0] <= out[-1] <= cell_range(c)[1]:
            out.pop()
        out.append(c)
        while len(out) >= 4 and cell_level(out[-1]) > 0:
            up = cell_parent(out[-1], cell_level(out[-1]) - 1)
            if out[-4:] != cell_children(up):
                break
            out[-4:] = [up]
    return out


def union_contains(cells: list[int], c: int) -> bool:
    return any(cell_range(x)[0] <= c <= cell_range(x)[1] for x in cells)


def union_intersection(a: list[int], b: list[int]) -> list[int]:
    """Of every pair that overlaps the smaller cell; both sides are normalised."""
    return normalize([x for x in a if union_contains(b, x)] + [y for y in b if union_contains(a, y)])


def union_difference(a: list[int], b: list[int]) -> list[int]:
    out, todo = [], list(a)
    while todo:
        c = todo.pop()
        lo, hi = cell_range(c)
        if union_contains(b, c):
            continue
        if any(lo <= y <= hi for y in b):
            todo += cell_children(c)
        else:
            out.append(c)
    return normalize(out)


def denormalize(cells: list[int], least: int, step: int = 1) -> list[int]:
    """Cells replaced by descendants so that levels are at least ``least`` and least plus a multiple of ``step``."""
    out = []
    for c in cells:
        level = max(cell_level(c), least)
        level = min(MAX_LEVEL, level + (-(level - least)) % step)
        stack = [c]
        for _ in range(level - cell_level(c)):
            stack = [k for x in stack for k in cell_children(x)]
        out += stack
    return sorted(out)


def leaf_count(cells: list[int]) -> int:
    return sum(c & -c for c in cells)


def expand(cells: list[int], level: int) -> list[int]:
    """The union and all cells of ``level`` around it."""
    out = []
    for c in cells:
        if cell_level(c) > level:
            c = cell_parent(c, level)
        out += [c, *all_neighbors(c, level)]
    return normalize(out)


def expand_by(cells: list[int], radius: float, max_level_diff: int = 4) -> list[int]:
    """The union and all within ``radius`` (radians) of it, by cells no narrower than that and at most ``max_level_diff`` levels
    finer than the union's coarsest."""
    widest = int(np.floor(np.log2(2 * 2**0.5 / 3 / radius))) if radius > 0 else MAX_LEVEL
    if widest < 0:
        return [cell_at(f, 0, 0, 0) for f in range(6)] if cells else []
    return expand(cells, min(MAX_LEVEL, widest, min(map(cell_level, cells), default=0) + max_level_diff))


# ---------------------------------------------------------------- regions and coverings


class Cap:
    def __init__(self, axis: np.ndarray, radius: float):
        self.axis, self.radius = unit(np.asarray(axis, float)), radius

    def contains(self, p: np.ndarray) -> np.ndarray:
        return angle(self.axis, p) <= self.radius + 1e-15

    def contains_cap(self, o: "Cap") -> bool:
        return o.radius < 0 or float(angle(self.axis, o.axis)) + o.radius <= self.radius + 1e-15

    def intersects_cap(self, o: "Cap") -> bool:
        return self.radius >= 0 and o.radius >= 0 and float(angle(self.axis, o.axis)) <= self.radius + o.radius

    def add_point(self, p: np.ndarray) -> "Cap":
        return Cap(p, 0.0) if self.radius < 0 else Cap(self.axis, max(self.radius, float(angle(self.axis, p))))

    def add_cap(self, o: "Cap") -> "Cap":
        if self.radius < 0 or o.radius < 0:
            return o if self.radius < 0 else self
        return Cap(self.axis, min(np.pi, max(self.radius, float(angle(self.axis, o.axis)) + o.radius)))

    def complement(self) -> "Cap":
        return Cap(-self.axis, np.pi - self.radius if self.radius >= 0 else np.pi)

    def area(self) -> float:
        return 2 * np.pi * (1 - np.cos(self.radius)) if self.radius >= 0 else 0.0

    def may_intersect(self, cid: int) -> bool:
        return self.radius >= 0 and cell_distance(cid, self.axis) <= self.radius

    def contains_cell(self, cid: int) -> bool:
        v = cell_vertices(cid)
        return bool(self.contains(v).all()) and (self.radius < np.pi / 2 or cell_distance(cid, -self.axis) >= np.pi - self.radius)


class Rect:
    """Latitudes and longitudes in degrees; lng_lo > lng_hi crosses the antimeridian."""

    def __init__(self, lat_lo: float, lat_hi: float, lng_lo: float, lng_hi: float):
        self.lat, self.lng = (lat_lo, lat_hi), (lng_lo, lng_hi)

    def _in(self, lng) -> np.ndarray:
        lo, hi = self.lng
        return (lng >= lo) & (lng <= hi) if lo <= hi else (lng >= lo) | (lng <= hi)

    def contains(self, p: np.ndarray) -> np.ndarray:
        lat, lng = lat_lng(p)
        return (lat >= self.lat[0]) & (lat <= self.lat[1]) & self._in(lng)

    def area(self) -> float:
        width = self.lng[1] - self.lng[0]
        return float(np.radians(width if width >= 0 else width + 360) * (np.sin(np.radians(self.lat[1])) - np.sin(np.radians(self.lat[0]))))

    def corners(self) -> np.ndarray:
        return point(np.array([self.lat[0], self.lat[0], self.lat[1], self.lat[1]]), np.array([self.lng[0], self.lng[1], self.lng[1], self.lng[0]]))

    def may_intersect(self, cid: int) -> bool:
        """Never false where they meet; tested by the bounds of the cell."""
        v = cell_vertices(cid)
        lat, lng = lat_lng(v)
        if bool(self.contains(np.vstack([v, cell_center(cid)[None]])).any()) or any(cell_contains(cid, c) for c in self.corners()):
            return True
        if cell_level(cid) < 2:
            return True
        spread = float(angle(v[0], v[2])) * 57.2958
        if lat.max() + spread / 4 < self.lat[0] or lat.min() - spread / 4 > self.lat[1]:
            return False
        if abs(lat).max() > 85:
            return True
        mid = float(lng[0])
        off = (lng - mid + 180) % 360 - 180
        lo, hi = mid + off.min(), mid + off.max()
        return any(self._in(np.array(x))[()] for x in ((lo + 180) % 360 - 180, (hi + 180) % 360 - 180)) or (self.lng[0] - lo) % 360 <= hi - lo

    def contains_cell(self, cid: int) -> bool:
        return cell_level(cid) >= 2 and bool(self.contains(cell_vertices(cid)).all()) and self.lat[0] <= lat_lng(cell_center(cid))[0] <= self.lat[1]


class Polygon:
    def __init__(self, loops: list[np.ndarray]):
        self.loops = loops

    def contains(self, p: np.ndarray) -> np.ndarray:
        return polygon_contains(self.loops, p)

    def _meets_edge(self, cid: int) -> bool:
        v = cell_vertices(cid)
        return any(crossing(v[k], v[(k + 1) % 4], loop[m], loop[(m + 1) % len(loop)]) >= 0 for loop in self.loops for m in range(len(loop)) for k in range(4))

    def may_intersect(self, cid: int) -> bool:
        return bool(self.contains(cell_vertices(cid)).any()) or any(cell_contains(cid, p) for loop in self.loops for p in loop) or self._meets_edge(cid)

    def contains_cell(self, cid: int) -> bool:
        return bool(self.contains(cell_vertices(cid)).all()) and not self._meets_edge(cid) and not any(cell_contains(cid, p) for loop in self.loops for p in loop)


class Intersection:
    def __init__(self, *regions):
        self.regions = regions

    def contains(self, p):
        return np.logical_and.reduce([r.contains(p) for r in self.regions])

    def may_intersect(self, cid: int) -> bool:
        return all(r.may_intersect(cid) for r in self.regions)

    def contains_cell(self, cid: int) -> bool:
        return all(r.contains_cell(cid) for r in self.regions)


class Union:
    def __init__(self, *regions):
        self.regions = regions

    def contains(self, p):
        return np.logical_or.reduce([r.contains(p) for r in self.regions])

    def may_intersect(self, cid: int) -> bool:
        return any(r.may_intersect(cid) for r in self.regions)

    def contains_cell(self, cid: int) -> bool:
        return any(r.contains_cell(cid) for r in self.regions)


def _snapped(level: int, min_level: int, level_mod: int) -> int:
    """The finest of the levels ``min_level``, ``min_level + level_mod``, ... that is no finer than ``level``."""
    return max(min_level, level - (level - min_level) % level_mod)


def normalize_covering(cells: list[int], max_cells: int = DEFAULT_MAX_CELLS, min_level: int = 0, max_level: int = MAX_LEVEL, level_mod: int = 1) -> list[int]:
    """A covering made to fit the limits: cells too fine or between allowed levels become ancestors, and while there are too
    many, the two neighbours along the curve with the deepest common ancestor are joined in it (never above ``min_level``)."""
    fitted = normalize([cell_parent(c, _snapped(min(cell_level(c), max_level), min_level, level_mod)) if cell_level(c) > min_level else c for c in cells])
    while len(fitted) > max_cells:
        deepest, at = -1, -1
        for k in range(len(fitted) - 1):
            a, b = fitted[k], fitted[k + 1]
            if a >> 61 == b >> 61:
                level = min(cell_level(a), cell_level(b))
                while cell_parent(a, level) != cell_parent(b, level):
                    level -= 1
                if level > deepest:
                    deepest, at = level, k
        if deepest < 0 or (level := _snapped(deepest, min_level, level_mod)) < min_level or deepest < min_level:
            break
        fitted = normalize([*fitted, cell_parent(fitted[at], level)])
    return denormalize(fitted, min_level, level_mod)


def simple_covering(region, start: np.ndarray, level: int) -> list[int]:
    """All cells of ``level`` that meet a connected region, from the one of ``start`` on across edges."""
    first = cell_of(start, level)
    seen, todo, out = {first}, [first], []
    while todo:
        c = todo.pop()
        if region.may_intersect(c):
            out.append(c)
            for k in edge_neighbors(c):
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
    return sorted(out)


def fast_covering(cap: "Cap", max_cells: int = DEFAULT_MAX_CELLS, min_level: int = 0, max_level: int = MAX_LEVEL, level_mod: int = 1) -> list[int]:
    """A coarse covering of a cap without refinement: the cells around the vertex nearest to its centre, of the finest level
    whose cells are wide enough; the faces if none is."""
    level = int(np.floor(np.log2(2 * 2**0.5 / 3 / (2 * cap.radius)))) if cap.radius > 0 else MAX_LEVEL
    level = min(MAX_LEVEL - 1, level - 1)
    found = [cell_at(f, 0, 0, 0) for f in range(6)] if level < 0 else vertex_neighbors(cell_of(cap.axis), level)
    return normalize_covering(found, max_cells, min_level, max_level, level_mod)


def covering(region, max_cells: int = DEFAULT_MAX_CELLS, min_level: int = 0, max_level: int = MAX_LEVEL, interior: bool = False, level_mod: int = 1) -> list[int]:
    """Cells that cover a region (or lie inside it): the largest cells are refined first, among equals those with fewest
    children that meet the region, while there is room for their children. With ``level_mod`` levels are ``min_level`` plus a
    multiple of it."""
    out: list[int] = []
    queue: list[tuple[int, int, int, list[int]]] = []

    def offer(c: int) -> None:
        if not region.may_intersect(c):
            return
        level = cell_level(c)
        if level >= min_level and region.contains_cell(c):
            out.append(c)
        elif level >= max_level:
            if not interior:
                out.append(c)
        else:
            inner = [k for k in cell_children(c) if region.may_intersect(k)]
            if inner:
                heapq.heappush(queue, (level, len(inner), c, inner))

    for face in range(6):
        offer(cell_at(face, 0, 0, 0))
    while queue and (not interior or len(out) < max_cells):
        level, n, c, inner = heapq.heappop(queue)
        if level < min_level or n == 1 or len(out) + len(queue) + n <= max_cells or interior:
            for k in inner:
                if interior and len(out) >= max_cells:
                    break
                offer(k)
        else:
            out.append(c)
    if level_mod > 1:
        return denormalize(normalize(out), min_level, level_mod) if interior else normalize_covering(out, max_cells, min_level, max_level, level_mod)
    return normalize(out) if min_level == 0 else denormalize(normalize(out), min_level)


def signed_ids(cells: list[int]) -> list[int]:
    return [c - (1 << 64) if c >= 1 << 63 else c for c in cells]


def unsigned_ids(cells) -> list[int]:
    return [int(c) & ((1 << 64) - 1) for c in cells]


# ---------------------------------------------------------------- text


def parse_points(text: str) -> np.ndarray:
    """'lat:lng, lat:lng' in degrees."""
    pairs = [p.split(":") for p in text.replace(" ", "").split(",") if p]
    return point(np.array([float(a) for a, _ in pairs]), np.array([float(b) for _, b in pairs])) if pairs else np.zeros((0, 3))


def parse_polygon(text: str) -> list[np.ndarray]:
    return [parse_points(t) for t in text.split(";") if t.strip()]


def format_points(p: np.ndarray) -> str:
    lat, lng = lat_lng(p)
    return ", ".join(f"{a:.15g}:{b:.15g}" for a, b in zip(lat, lng, strict=True))
