import datetime as dt

import numpy as np

import pytest
from pyspark.sql import functions as F

from wayfold.functions import cells, geo, scalars, sphere, tracks


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_coordinates(spark):
    a, b = geo.wgs_to_gcj(F.lit(23.5388), F.lit(116.370743))
    c, d = geo.gcj_to_bd(a, b)
    e, f = geo.bd_to_wgs(c, d)
    g, h = geo.wgs_to_gcj(F.lit(0.0), F.lit(0.0))
    r = one(spark, a=a, b=b, c=c, d=d, e=e, f=f, g=g, h=h)
    assert (round(r.a, 7), round(r.b, 7), round(r.c, 7), round(r.d, 7)) == (23.5364004, 116.3754491, 23.5425017, 116.3819441)
    assert abs(r.e - 23.5388) < 2e-5 and abs(r.f - 116.370743) < 2e-5 and (r.g, r.h) == (0, 0)


def test_distances():
    p = [(23.3967826, 113.46415649), (23.3967770, 113.46419673), (23.396577, 113.464189), (23.397729, 113.462625), (23.397749, 113.462635)]
    assert [round(float(tracks.distance(*p[0], *q)), 3) for q in p[1:]] == pytest.approx([4.1535, 23.1012, 188.418, 188.829], abs=1e-3)
    assert tracks.centroid(*np.array(p[:3]).T) == pytest.approx((23.3967122, 113.46418074), abs=1e-7)


CELLS = [(37.7749, 122.4194, 3856441151893051681, "3584d4cb9", 2326906923972792320), (23.3967826, 113.46415649, 3747873649987277921, "34031f3a5", 2326905267364188160), (0.0, 0.0, 1152921504606846977, "100000001", 21057846695170048),
         (-33.8663457, 151.1960891, 7715420666353859897, "6b12ae37d", 6938581457010413568), (40.0, -100.0, -8674032032207620599, "879fa5d2d", -9202323400082403328)]


def test_cells(spark):
    df = spark.createDataFrame([(a, b) for a, b, *_ in CELLS], "a double, b double").coalesce(1)
    leaf = cells.cell_id(F.col("a"), F.col("b"))
    mid = cells.cell_id(F.col("a"), F.col("b"), 16)
    df = spark.createDataFrame(df.select("a", "b", leaf.alias("leaf"), mid.alias("mid")).collect()).coalesce(1)
    df = spark.createDataFrame(df.select("*", cells.encode(F.lit(598), F.col("mid")).alias("code")).collect()).coalesce(1)
    leaf, mid, code = F.col("leaf"), F.col("mid"), F.col("code")
    got = df.select(
        leaf.alias("leaf"), cells.token(mid).alias("token"), code.alias("code"), (cells.parent(leaf, 16) == mid).alias("up"), cells.code_slot(code).alias("slot"), (cells.code_cell(code) == mid).alias("back"), cells.level_of(mid).alias("level"),
        (cells.from_token(cells.token(mid)) == mid).alias("token_back"), cells.contains(mid, leaf).alias("inside"), cells.is_valid(leaf).alias("valid"), cells.common_level(leaf, mid).alias("common"), cells.cell_center(leaf).alias("at"), cells.children(mid).alias("kids"), "a", "b",
        (cells.code_cell(cells.code_at_level(code, 10)) == cells.parent(mid, 10)).alias("coarse"),
    ).collect()
    for r, (a, b, leaf, token, code) in zip(got, CELLS, strict=True):
        assert (r.leaf, r.token, r.code, r.slot, r.level, r.common) == (leaf, token, code, 598, 16, 16)
        assert r.up and r.back and r.token_back and r.inside and r.valid and r.coarse
        assert r["at"]["lat"] == pytest.approx(a, abs=1e-6) and r["at"]["lng"] == pytest.approx(b, abs=1e-6)
        assert sphere.unsigned_ids(r.kids) == sphere.cell_children(sphere.unsigned_ids([cells_id(r)])[0])
    with pytest.raises(Exception, match="slot out of range"):
        one(spark, x=cells.encode(F.lit(65536), F.lit(1).cast("long")))


def cells_id(r) -> int:
    lat, lng = r["a"], r["b"]
    return sphere.signed_ids([sphere.cell_of(sphere.point(lat, lng), 16)])[0]


def test_scalars(spark):
    r = one(spark, a=scalars.base70(F.lit("AB12")), b=scalars.base70(F.lit("Z9")), c=scalars.base70(F.lit("#A")), d=scalars.base70_text(F.lit(354789)), e=scalars.base70_text(scalars.base70(F.lit("#A"))))
    assert (r.a, r.b, r.c, r.d, r.e) == (354789, 1856, 1, "AB12", "A")
    got = spark.createDataFrame([(0,), (987,), (9876,), (897012,), (9872908,)], "n int").select(scalars.digit_info(F.col("n")).alias("i")).collect()
    assert [tuple(x.i) for x in got] == [(1, 0), (987, 0), (987, 1), (897, 3), (999, 3)]
    with pytest.raises(Exception, match="no plate symbol"):
        one(spark, x=scalars.base70(F.lit("a!")))
    assert [scalars.next_prime(n) for n in (1, 2, 10, 100, 1000)] == [2, 3, 11, 101, 1009]
    noon = "2023-07-04 12:30:00"
    r = one(spark, a=scalars.epoch_seconds(F.lit(noon)), b=scalars.epoch_seconds(F.lit(noon), True), z=scalars.unzigzag(scalars.zigzag(F.lit(-7).cast("long"))), i=scalars.interleave(F.lit(3), F.lit(1)))
    assert r.a - r.b == 43200 and r.z == -7 and r.i == 7
    days = spark.createDataFrame([(dt.date(2023, 7, 15),), (dt.date(2023, 7, 16),), (dt.date(2023, 8, 31),), (dt.date(2023, 9, 1),)], "d date").select(scalars.period(F.col("d")).alias("p")).collect()
    assert [x.p for x in days] == ["Jul 1-15", "Jul 16-31", "Aug 16-31", None]
    assert scalars.threshold(4, 27) == pytest.approx(0.439, abs=1e-3) and scalars.bands_for(4, 0.4, 0.95) == 116
    r = one(spark, p=scalars.hit_chance(F.lit(0.4), 4, 27), q=scalars.hit_chance(F.lit(0.4), 4, 65), i=scalars.feature_bits(F.lit(1), F.lit(2), F.lit("b"), F.lit(9.1)), o=scalars.feature_bits(F.lit(1), F.lit(2), F.lit("x"), F.lit(9.1), True))
    assert (round(r.p, 3), round(r.q, 3), r.i, r.o) == (0.504, 0.815, 1 << 18 | 2 << 11 | 1 << 8 | 2, 1 << 18 | 2 << 11 | 5 << 3 | 2)


# ---------------------------------------------------------------- kernels against line-by-line models


def model_purify(t, lat, lng, speed=50.0, reach=12000.0):
    seen, chunks = set(), []
    for i in range(len(t)):
        if i in seen:
            continue
        seen.add(i)
        chunk, at = [i], i
        for j in range(i + 1, len(t)):
            d, step = float(tracks.distance(lat[at], lng[at], lat[j], lng[j])), abs(t[j] - t[at])
            if step > 0 and d / step < speed and d < reach:
                chunk.append(j)
                seen.add(j)
                at = j
        chunks.append(chunk)
    return max(reversed(chunks), key=lambda c: (len({(lat[k], lng[k]) for k in c}), abs(t[c[0]] - t[c[-1]])))


def model_similarity(t1, p1, t2, p2, err, tol):
    n, m = len(t1), len(t2)
    total, length = np.zeros((n, m)), np.zeros((n, m))
    for i in range(n):
        for j in range(m):
            d = float(tracks.distance(*p1[i], *p2[j], radius=6371010.0))
            s = (1 if d < tol else 0.5 if d < 2 * tol else 0) if abs(t1[i] - t2[j]) < err else 0
            if i == 0 and j == 0:
                total[i, j], length[i, j] = s, 1
                continue
            steps = [(i - 1, j - 1), (i, j - 1), (i - 1, j)]
            steps = [x for x in steps if min(x) >= 0]
            best = max(total[x] for x in steps)
            k = next(x for x in steps if total[x] == best)
            total[i, j], length[i, j] = best + s, length[k] + 1
    return total[-1, -1] / length[-1, -1]


def test_kernels_match_models():
    rng = np.random.default_rng(4)
    for _ in range(25):
        n = int(rng.integers(1, 40))
        t = np.sort(rng.integers(0, 600, n))
        lat, lng = 23 + np.round(rng.normal(0, 0.02, n), 3), 113 + np.round(rng.normal(0, 0.02, n), 3)
        assert tracks.purify(t, lat, lng).tolist() == model_purify(t.tolist(), lat.tolist(), lng.tolist())
        m = int(rng.integers(1, 30))
        u, a, b = np.sort(rng.integers(0, 600, m)), 23 + rng.normal(0, 0.003, m), 113 + rng.normal(0, 0.003, m)
        lat, lng = 23 + rng.normal(0, 0.003, n), 113 + rng.normal(0, 0.003, n)
        want = model_similarity(t, list(zip(lat, lng, strict=True)), u, list(zip(a, b, strict=True)), 120, 200)
        assert tracks.similarity(t, lat, lng, u, a, b, 120, 200) == pytest.approx(want)
        d = tracks.distance(lat[:, None], lng[:, None], lat[None], lng[None])
        if n > 1:
            pairs = d[np.triu_indices(n, 1)]
            own = d.mean(axis=1)
            want = (own <= 50) | (pairs.var() <= 20) | (np.abs(own - pairs.mean()) <= 2 * pairs.std())
            assert (tracks.calm(lat, lng) == want).all()


def test_kernel_edges():
    same = np.array([0, 0])
    assert len(tracks.purify(same, np.zeros(2), np.zeros(2))) == 1 and len(tracks.purify(same[:0], same[:0], same[:0])) == 0
    assert len(tracks.purify(np.zeros(20001), np.zeros(20001), np.zeros(20001))) == 20001
    t, lat, lng = np.array([0, 10]), np.array([23.0, 23.0]), np.array([113.0, 113.0])
    assert tracks.similarity(t, lat, lng, t, lat, lng, 120, 200) == 1
    assert tracks.similarity(t[:1], lat[:1], lng[:1], t[:1] + 120, lat[:1], lng[:1], 120, 200) == 0
    assert tracks.similarity(t[:1], lat[:1], lng[:1], t[:1], lat[:1] + 0.0027, lng[:1], 120, 200) == 0.5
    got = tracks.cluster(np.array([0, 1, 2]), np.array([23.0, 24.0, 23.0]), np.array([113.0, 113.0, 113.0001]), 50)
    assert len(got) == 2 and got[0][:2] == pytest.approx((24, 113)) and got[1][2] == 0



def test_diameter_kernel():
    """The hull path and the plain path against all pairs."""
    import numpy as np

    from wayfold.functions import tracks

    rng = np.random.default_rng(2)
    for n, centre, spread in ((1, 20, 1), (2, 20, 1), (300, 23, 0.01), (2000, -40, 3.0), (1500, 0, 80.0), (500, 89, 0.5)):
        lat, lng = np.clip(centre + spread * rng.uniform(-1, 1, n), -90, 90), rng.uniform(-1, 1, n) * min(180, spread * 2) + 100
        lat, lng = np.r_[lat, lat[:5]], np.r_[lng, lng[:5]]
        want = tracks.distance(lat[:, None], lng[:, None], lat[None], lng[None]).max()
        assert abs(tracks.diameter(lat, lng) - want) <= 1e-6 * max(1.0, want)
        d = tracks.distance(lat[:, None], lng[:, None], lat[None], lng[None])[np.triu_indices(len(lat), 1)]
        mean, variance = tracks.pair_moments(lat, lng)
        assert mean == (0.0 if len(d) == 0 else pytest.approx(d.mean())) and variance == (0.0 if len(d) == 0 else pytest.approx(d.var(), rel=1e-6, abs=1e-3))


def test_walks_are_inverse():
    from wayfold.functions import cells

    side = 1 << cells.CHUNK
    for o in range(4):
        for i in range(side):
            for j in range(side):
                t = cells._THERE[(o * side + i) * side + j]
                assert cells._BACK[o * side * side + (t >> 2)] == i << 32 | j << 2 | t & 3
