import math
import random

from stimlake.llm.nearest_time import match_nearest

ROW = "entity long, id long, t double, kind string, cell string"
TOL = "entity long, tol double, t double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], ROW)


def brute(left, rights, tol):
    out = set()
    for e, i, t in {r for r in left if None not in r and not math.isnan(r[2])}:
        for kind, rows in rights.items():
            c = [(abs(u - t), u, j) for f, j, u in rows if None not in (f, j, u) and f == e and abs(u - t) < tol.get(e, 0)]
            if c:
                out.add((i, kind, min(c)[2]))
    return out


def test_against_brute_force_with_dirt_and_a_hot_entity(spark):
    rng = random.Random(1)
    left = [(1 if rng.random() < 0.7 else rng.randint(2, 4), i, round(rng.uniform(0, 100), 3)) for i in range(400)]
    rights = {k: [(rng.choice([1, 1, 2, 3, 4]), 1000 * (n + 1) + i, round(rng.uniform(0, 100), 3)) for i in range(500)] for n, k in enumerate(("tick", "daq"))}
    left += [left[3], (None, 900, 1.0), (1, 901, None), (1, 902, math.nan), (1, None, 2.0)]
    rights["tick"] += [rights["tick"][0], (1, 9000, None), (1, 9001, math.nan), (None, 9002, 5.0)]
    tol = {1: 0.4, 2: 1.5, 3: 0.05}
    t = spark.createDataFrame([(e, x, 0.0) for e, x in tol.items()], TOL)
    for cell in (3.0, 20.0):
        got = match_nearest(frame(spark, left), {k: frame(spark, v) for k, v in rights.items()}, t, cell=cell).collect()
        assert len(got) == len({(r.id, r.kind) for r in got})
        assert {(r.id, r.kind, r.ref_id) for r in got} == brute(left, rights, tol)


def test_ties_exact_times_bounds_and_empty(spark):
    t = spark.createDataFrame([(1, 1.0, 0.0)], TOL)
    left, right = [(1, 1, 10.0), (1, 2, 20.0), (1, 3, 30.0), (1, 4, 40.0)], [(1, 11, 9.5), (1, 12, 10.5), (1, 23, 20.0), (1, 22, 20.0), (1, 31, 31.0)]
    got = {r.id: (r.ref_id, r.dt) for r in match_nearest(frame(spark, left), {"k": frame(spark, right)}, t).collect()}
    assert got == {1: (11, -0.5), 2: (22, 0.0)}  # the earlier of two, the least id, strictly inside
    assert match_nearest(frame(spark, []), {"k": frame(spark, right)}, t).count() == 0
    assert match_nearest(frame(spark, left), {"k": frame(spark, [])}, t).count() == 0


def test_a_tolerance_wider_than_the_cells(spark):
    rng = random.Random(5)
    left = [(e, 100 * e + i, round(rng.uniform(0, 500), 2)) for e in (1, 2) for i in range(40)]
    right = [(e, 1000 * e + i, round(rng.uniform(0, 500), 2)) for e in (1, 2) for i in range(12)]
    tol = {1: 30.0, 2: 200.0}
    t = spark.createDataFrame([(e, x, 0.0) for e, x in tol.items()], TOL)
    got = match_nearest(frame(spark, left), {"k": frame(spark, right)}, t, cell=5.0).collect()
    assert {(r.id, r.kind, r.ref_id) for r in got} == brute(left, {"k": right}, tol) and len(got) == len({r.id for r in got})
