import numpy as np
import pytest

from wayfold.functions import sphere as S

rng = np.random.default_rng(20)


def test_golden_cells():
    for lat, lng, leaf in ((37.7749, 122.4194, 3856441151893051681), (23.3967826, 113.46415649, 3747873649987277921), (0, 0, 1152921504606846977), (-33.8663457, 151.1960891, 7715420666353859897), (40, -100, -8674032032207620599)):
        assert S.signed_ids([S.cell_of(S.point(lat, lng))]) == [leaf]
    ends = [S.cell_of(S.point(a, b), 22) for a, b in ((-33.8663457, 151.1960891), (-33.866094000000004, 151.19517439999998))]
    assert [f"{c:016x}".rstrip("0") for c in ends] == ["6b12ae37cebb", "6b12ae36313d"]


def test_cell_round_trips():
    for _ in range(300):
        p = S.unit(rng.normal(size=3))
        level = int(rng.integers(0, 31))
        c = S.cell_of(p, level)
        assert S.cell_level(c) == level and S.cell_contains(c, p) and S.cell_of(S.cell_center(c), level) == c
        if level:
            up = S.cell_parent(c, level - 1)
            assert c in S.cell_children(up) and sum(S.cell_range(up)) == 2 * up


def test_neighbors():
    for _ in range(60):
        level = int(rng.integers(2, 20))
        c = S.cell_of(S.unit(rng.normal(size=3)), level)
        edges = S.edge_neighbors(c)
        assert len(set(edges)) == 4 and c not in edges and all(c in S.edge_neighbors(e) for e in edges)
        around = S.all_neighbors(c, level)
        assert set(edges) <= set(around) and len(around) in (7, 8)
        assert len(S.vertex_neighbors(c, level - 1)) in (3, 4)


def test_areas():
    assert sum(S.cell_area(S.cell_at(f, 0, 0, 0)) for f in range(6)) == pytest.approx(4 * np.pi)
    octant = S.point(np.array([0, 0, 90.0]), np.array([0, 90.0, 0]))
    assert S.loop_area(octant) == pytest.approx(np.pi / 2) and S.loop_area(octant[::-1]) == pytest.approx(4 * np.pi - np.pi / 2)
    loop = S.regular_loop(S.point(30, 40), 0.1, 200)
    assert S.loop_area(loop) == pytest.approx(S.Cap(S.point(30, 40), 0.1).area(), rel=1e-3)
    assert S.turning(loop) == pytest.approx(2 * np.pi - S.loop_area(loop), abs=1e-6)
    c = S.loop_centroid(loop)
    assert S.angle(c, S.point(30, 40)) < 1e-9 and np.linalg.norm(c) == pytest.approx(S.loop_area(loop), rel=1e-2)


def test_loop_contains():
    for _ in range(20):
        center, r = S.unit(rng.normal(size=3)), rng.uniform(0.05, 1.4)
        loop = S.regular_loop(center, r, 64)
        p = S.unit(rng.normal(size=(200, 3)))
        d = S.angle(p, center)
        sure = (d < r * 0.99) | (d > r * 1.001)
        assert (S.loop_contains(loop, p)[sure] == (d < r)[sure]).all()
        assert (S.loop_contains(loop[::-1], p)[sure] == (d >= r)[sure]).all()
    shell, hole = S.regular_loop(S.point(0, 0), 0.5, 40), S.regular_loop(S.point(0, 0), 0.2, 40)
    assert S.polygon_contains([shell, hole], S.point(np.array([0.0, 20.0, 40.0]), np.zeros(3))).tolist() == [False, True, False]
    assert S.polygon_area([shell, hole]) == pytest.approx(S.loop_area(shell) - S.loop_area(hole))


def test_signs_and_crossings():
    a, b, c, d = S.point(np.array([0, 10.0, 5, 5]), np.array([0.0, 0, -5, 5]))
    assert S.crossing(a, b, c, d) == 1 and S.crossing(a, b, b, d) == 0 and S.crossing(a, c, b, d) == -1
    assert S.angle(S.intersection(a, b, c, d), S.point(5.019, 0)) < 1e-3
    assert S.sign(a, a, b) == 0 and S.sign(a, b, c) == -S.sign(b, a, c) == S.sign(b, c, a)
    assert S.compare_distances(a, b, c) == 1 and S.compare_distances(a, a, c) == -1 and S.compare_distances(a, b, b) == 0


def test_polylines():
    line = S.point(np.array([0.0, 0, 0]), np.array([0.0, 10, 20]))
    assert S.length(line) == pytest.approx(np.radians(20))
    assert S.angle(S.along(line, 0.25), S.point(0, 5)) < 1e-12
    assert S.fraction_of(line, S.point(3, 5)) == pytest.approx(0.25)
    assert S.project(line, S.point(3, 15))[0] == 1
    assert S.subsample(S.point(np.array([0, 0.0001, 0, 5]), np.array([0.0, 1, 2, 3])), np.radians(0.01)) == [0, 2, 3]
    assert S.lines_intersect(line, S.point(np.array([-1.0, 1]), np.array([5.0, 5])))
    assert S.edge_pair_distance(*S.point(np.array([0, 0, 1, 1.0]), np.array([0.0, 10, 0, 10]))) == pytest.approx(np.radians(1), rel=1e-2)


def test_hull():
    p = S.unit(S.point(20, 20) + rng.normal(size=(60, 3)) * 0.1)
    hull = S.convex_hull(p)
    inner = [q for q in p if not (hull == q).all(axis=1).any()]
    assert S.loop_contains(hull, np.array(inner)).all() and S.loop_area(hull) < 2 * np.pi


def test_coverings():
    for _ in range(12):
        cap = S.Cap(rng.normal(size=3), 10 ** rng.uniform(-3, 0))
        cells = S.covering(cap, 12)
        p = S.unit(cap.axis + rng.normal(size=(300, 3)) * cap.radius)
        p = p[cap.contains(p)]
        assert len(cells) <= 12 and all(S.union_contains(cells, S.cell_of(x)) for x in p)
        inside = S.covering(cap, 12, interior=True, max_level=12)
        assert all(cap.contains(S.cell_vertices(c)).all() for c in inside)
    rect = S.Rect(10, 20, 170, -170)
    cells = S.covering(rect, 20)
    assert all(S.union_contains(cells, S.cell_of(S.point(a, b))) for a in (10.1, 15, 19.9) for b in (171, 180, -171))
    poly = S.Polygon([S.regular_loop(S.point(5, 5), 0.2, 12)])
    both = S.Intersection(poly, rect)
    assert S.covering(both, 8) == [] and S.covering(S.Union(poly, rect), 8)


def test_unions():
    c = S.cell_of(S.point(10, 10), 8)
    kids = S.cell_children(c)
    assert S.normalize([*kids, kids[0]]) == [c] and S.normalize([c, kids[1]]) == [c]
    assert S.union_intersection([c], kids[:2]) == sorted(kids[:2]) and S.union_difference([c], kids[:1]) == sorted(kids[1:])
    assert S.leaf_count([c]) == 4**22 and len(S.denormalize([c], 10)) == 16 and len(S.expand([c], 8)) > 1


def test_covering_options():
    rng = np.random.default_rng(3)
    for _ in range(6):
        cap = S.Cap(S.point(rng.uniform(-80, 80), rng.uniform(-180, 180)), 10 ** rng.uniform(-4, -1))
        inside = S.unit(cap.axis + cap.radius * rng.uniform(-0.57, 0.57, (200, 3)))
        inside = inside[cap.contains(inside)]
        for cells in (S.fast_covering(cap), S.simple_covering(cap, cap.axis, min(30, 3 + S.cell_level(S.fast_covering(cap)[0]))), S.covering(cap, 12, level_mod=2), S.covering(cap, 12, min_level=3, level_mod=3)):
            assert all(any(S.cell_contains(c, p) for c in cells) for p in inside)
        assert all(S.cell_level(c) % 2 == 0 for c in S.covering(cap, 12, level_mod=2))
        assert all((S.cell_level(c) - 3) % 3 == 0 for c in S.covering(cap, 12, min_level=3, level_mod=3))
        fine = S.covering(cap, 40)
        few = S.normalize_covering(fine, 4)
        assert len(few) <= max(4, len({c >> 61 for c in fine})) and S.union_difference(fine, few) == []
        grown = S.expand_by(fine, cap.radius / 2)
        ring = S.regular_loop(cap.axis, cap.radius * 1.45, 30)
        assert all(any(S.cell_contains(c, p) for c in grown) for p in ring)
        p = S.unit(rng.normal(size=3))
        c = S.cell_of(cap.axis, 6)
        far = S.cell_max_distance(c, p)
        assert far >= max(float(S.angle(p, v)) for v in S.cell_vertices(c)) - 1e-9
