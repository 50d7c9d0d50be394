import math

import numpy as np

from stimlake.llm.clusters import dense_places, describe, located_clusters, propagate, tables
from stimlake.llm.knn import Layout, Pivots, most_similar, thin_copies

DIM = 24


def test_search_recall_dirt_and_blocks(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((80, DIM))
    x = (np.repeat(centres, 10, 0) + 0.35 * rng.standard_normal((800, DIM))).round(3)
    rows = [(i, [float(v) * (1 + i % 5) for v in x[i]], "z") for i in range(800)]
    rows[7][1][3] = math.nan
    x[7, 3] = 0
    rows += [rows[0], (801, None, ""), (802, [0.0] * DIM, ""), (803, [1.0], ""), (None, [1.0] * DIM, ""), (804, rows[5][1], "")]
    ids, x = np.r_[np.arange(800), 804], np.vstack([x, x[5]])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    v = spark.createDataFrame(rows, "id long, vec array<double>, other string")
    q = spark.createDataFrame([(i,) for i in (*range(0, 800, 20), 802, 5, 5)], "id long")
    got = most_similar(v, q, dim=DIM, k=5, block_rows=150, query_rows=9).collect()
    asked = [*range(0, 800, 20), 5]
    assert {r.id for r in got} == set(asked) and all(1 <= r.place <= 5 for r in got)
    hit = 0
    for i in asked:
        s = u @ u[list(ids).index(i)]
        s[list(ids).index(i)] = -2
        best = {int(ids[j]) for j in np.argsort(-s)[:5]}
        mine = {r.other: r.cosine for r in got if r.id == i}
        assert len(mine) == 5 and i not in mine
        assert all(abs(c - s[list(ids).index(o)]) < 1e-5 for o, c in mine.items())
        hit += len(best & set(mine))
    assert hit >= 0.9 * 5 * len(asked)


def test_search_in_full_is_exact(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((500, DIM))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    v = spark.createDataFrame([(i, f.tolist()) for i, f in enumerate(x)], "id long, vec array<double>")
    q = spark.createDataFrame([(i,) for i in range(0, 500, 20)], "id long")
    got = {(r.id, r.place): r.other for r in most_similar(v, q, dim=DIM, k=5, length=None, visits=None, candidates=None, block_rows=60, query_rows=7).collect()}
    for i in range(0, 500, 20):
        s = u @ u[i]
        s[i] = -2
        assert [got[i, p] for p in range(1, 6)] == np.argsort(-s)[:5].tolist()


def test_nearest_pivots_through_runs():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 24))
    p, x = (unit(np.repeat(centres, k, 0) + 0.3 * rng.standard_normal((40 * k, 24))).astype(np.float32) for k in (8, 5))
    found = Pivots(p)
    assert sorted(map(tuple, found.all)) == sorted(map(tuple, p))
    exact = np.argsort(-(x @ found.all.T), axis=1, kind="stable")[:, :5]
    assert (found.nearest(x, 5, None) == exact).all()
    some = found.nearest(x, 5, 6)
    assert np.mean([len(set(a) & set(b)) for a, b in zip(exact.tolist(), some.tolist())]) > 4.5
    assert (np.diff(np.take_along_axis(x @ found.all.T, some, 1), axis=1) <= 1e-6).all()
    assert Pivots(p[:1]).nearest(x[:3], 1, 8).tolist() == [[0]] * 3 and found.nearest(x[:2], 320, 1).shape == (2, 320) and found.nearest(x[:0], 5, 6).shape == (0, 5)


def test_parts_of_the_index():
    x = np.repeat(np.eye(4, dtype=np.float32), 3, 0)
    assert thin_copies(x, np.array([9, 5, 5, 1, 2, 3, 4, 4, 4, 7, 6, 8]), 2).tolist() == [0, 1, 3, 4, 6, 9, 10]
    held, asking = np.array([10, 250, 0, 30, 5]), np.array([1, 1000, 0, 2, 3])
    plan = Layout.of(held, asking, 100, 300)
    assert np.diff(plan.first).tolist() == [1, 3, 1, 1, 1] and plan.tasks == plan.task[-1] >= 4
    part, ids = np.repeat(np.arange(5), held), np.arange(295)
    row, task = plan.homes(part, ids)
    # wherever a query goes, it meets each vector of a part it visits exactly once
    q_row, q_task = plan.visited(np.array([[1, 3], [0, 4]] * 50), np.arange(100))
    for q in range(4):
        met = row[np.isin(task, q_task[q_row == q])]
        wanted = np.flatnonzero(np.isin(part, [1, 3] if q % 2 == 0 else [0, 4]))
        assert set(wanted) <= set(met.tolist()) and len(met) == len(set(met.tolist()))


def test_search_on_nothing(spark):
    e = spark.createDataFrame([], "id long, vec array<double>")
    assert most_similar(e, e.select("id"), dim=3).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "id long, vec array<double>")
    assert most_similar(one, one.select("id"), dim=3).count() == 0


def clusters(spark, points, **how):
    at = spark.createDataFrame([(i, y, x, "k") for i, y, x, _ in points], "id long, y double, x double, label string")
    v = spark.createDataFrame([(i, f, 1) for i, _, _, f in points], "id long, vec array<double>, n int")
    return located_clusters(at, v, **{"dim": DIM} | how)


def test_clusters_with_dirt(spark):
    rng = np.random.default_rng(5)
    base = np.linalg.qr(rng.standard_normal((DIM, DIM)))[0]
    pts, want = [], {}

    def add(i, y, x, m, noise=0.08, gain=1.0):
        pts.append((i, float(y), float(x), [float(v) for v in gain * (m + noise * rng.standard_normal(DIM))]))

    for c, (y, x, m, n) in enumerate([(500, 500, 0, 12), (2500, 300, 0, 9), (520, 480, 1, 40), (1500, 1500, 2, 8)]):
        for j in range(n):
            add(1000 * (c + 1) + j, y + rng.uniform(-40, 40), x + rng.uniform(-40, 40), base[m], gain=float(rng.uniform(0.2, 5)))
            want[1000 * (c + 1) + j] = 1000 * (c + 1)
    for j in range(7):  # one too few
        add(9000 + j, 3000 + j, 3000, base[3])
    for j in range(300):
        add(20000 + j, rng.uniform(0, 4000), rng.uniform(0, 4000), rng.standard_normal(DIM) / 5)
    pts += [pts[0], (5, None, 1.0, [1.0] * DIM), (6, 500.0, math.nan, [1.0] * DIM), (7, 500.0, 500.0, None), (8, 500.0, 500.0, [0.0] * DIM), (None, 1.0, 1.0, [1.0] * DIM)]
    got = clusters(spark, pts).cache()
    assert {r.id: r.cluster for r in got.collect()} == want
    said = {r.cluster: r for r in describe(got).collect()}
    assert {k: r.size for k, r in said.items()} == {1000: 12, 2000: 9, 3000: 40, 4000: 8}
    best = sorted((-r.to_top, r.id) for r in got.collect() if r.cluster == 3000)[:3]
    assert said[3000].typical == [i for _, i in best]


def test_copies_of_one_point_and_nothing(spark):
    pts = [(i, 10.0, 10.0, [1.0] + [0.0] * (DIM - 1)) for i in range(30)]
    assert {(r.id, r.cluster, r.size) for r in clusters(spark, pts).collect()} == {(i, 0, 30) for i in range(30)}
    assert clusters(spark, [(1, None, 1.0, [1.0] * DIM)]).count() == 0


def test_labels_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (200, 200), (None, 3)], "a long, b long")
    got = {r.node: r.label for r in propagate(e).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200}


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def around_mean(rng, m, n, cosine):
    """n unit vectors of equal cosine to m, whose mean they have."""
    e = rng.standard_normal((n, len(m)))
    e -= np.outer(e @ m, m)
    e = unit(e - e.mean(0))
    return cosine * m + math.sqrt(1 - cosine**2) * e


def test_small_clusters_in_a_crowded_place(spark):
    rng = np.random.default_rng(8)
    pts, want = [], {}
    for c, m in enumerate(unit(rng.standard_normal((30, 96)))):
        y, x = rng.uniform(60, 140, 2)
        for j, f in enumerate(around_mean(rng, m, 8, 0.88)):
            pts.append((100 * c + j, float(y + rng.uniform(-30, 30)), float(x + rng.uniform(-30, 30)), f.tolist()))
            want[100 * c + j] = 100 * c
    # most points lie in one place, those elsewhere keep the mean occupancy low
    pts += [(10_000 + i, *rng.uniform(0, 200, 2).tolist(), f.tolist()) for i, f in enumerate(unit(rng.standard_normal((3000, 96))))]
    pts += [(20_000 + i, 1000.0 + 500 * (i // 20), 500.0 * (i % 20), f.tolist()) for i, f in enumerate(unit(rng.standard_normal((400, 96))))]
    got = {r.id: r.cluster for r in clusters(spark, pts, dim=96).collect()}
    assert {i: got.get(i) for i in want} == want


def test_recall_of_dense_places_over_splits():
    rng = np.random.default_rng(3)
    for unrelated in (500, 20_000):
        mean, centre = unit(rng.standard_normal((50, 96))), rng.uniform(60, 340, (50, 2))
        u = np.concatenate([*(around_mean(rng, m, 8, 0.86) for m in mean), unit(rng.standard_normal((unrelated, 96)))]).astype(np.float32)
        yx = np.concatenate([np.repeat(centre, 8, 0) + rng.uniform(-40, 40, (400, 2)), rng.uniform(0, 400, (unrelated, 2))])
        _, at, m, _ = dense_places(u, yx[:, 0], yx[:, 1], 100.0, 0.85, 8, 1)
        assert sum(((m @ a >= 0.8) & (np.hypot(*(at - c).T) <= 100)).any() for a, c in zip(mean, centre)) >= 49
    assert tables(0, 0.85, 8) == 1 and all(a <= b for a, b in zip(*(map(lambda k: tables(k, 0.85, 8), r) for r in (range(12), range(1, 13)))))


def test_mixed_neighbourhood_does_not_cost_a_cluster_its_place():
    rng = np.random.default_rng(12)
    m = np.eye(96)[0]
    # around eight members a crowd too far from their mean direction to belong, on the same side of most planes
    u = np.concatenate([around_mean(rng, m, 8, 0.9), around_mean(rng, m, 900, 0.72)]).astype(np.float32)
    yx = np.concatenate([np.column_stack([100.0 + np.arange(8), np.full(8, 100.0)]), rng.uniform(60, 140, (900, 2))])
    _, at, found, _ = dense_places(u, yx[:, 0], yx[:, 1], 100.0, 0.85, 8, 1)
    assert ((found @ m >= 0.9) & (np.hypot(*(at - 100).T) <= 50)).any()


def test_second_choice_where_the_most_similar_cluster_is_too_far(spark):
    rng = np.random.default_rng(6)
    a, d = np.eye(DIM)[0], np.eye(DIM)[1]
    pts = []

    def add(i, x, f):
        pts.append((i, 500.0 + i % 7, 500.0 + x + i % 3, (f + 0.02 * rng.standard_normal(DIM)).tolist()))

    for j in range(5):  # those of the second half lean to the direction of a cluster about 140 um away
        add(j, -200.0, a - 0.25 * d)
        add(10 + j, -130.0, a + 0.25 * d)
    for j in range(30):
        add(100 + j, 5.0 * (j % 2), a + 0.3 * d)
    got = {r.id: r.cluster for r in clusters(spark, pts).collect()}
    assert got == {i: 0 for j in range(5) for i in (j, 10 + j)} | {100 + j: 100 for j in range(30)}


def test_search_among_many_copies(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((60, DIM))
    x = np.vstack([np.repeat(x[:1], 500, 0) * rng.uniform(0.2, 5, (500, 1)), x[0] + 0.05 * rng.standard_normal((6, DIM)), np.repeat(x, 16, 0) + 0.4 * rng.standard_normal((960, DIM))])
    order = rng.permutation(len(x))
    x = x[order]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    v = spark.createDataFrame([(i, f.tolist()) for i, f in enumerate(x)], "id long, vec array<double>")
    asked = [int(np.flatnonzero(order == j)[0]) for j in (3, *range(500, 506), *range(510, 1400, 40))]
    got = {}
    for r in most_similar(v, spark.createDataFrame([(i,) for i in asked], "id long"), dim=DIM, k=5, candidates=256, block_rows=2000).collect():
        got.setdefault(r.id, {})[r.place] = r.other
    hit = 0
    for i in asked:
        s = np.round(u @ u[i], 6)
        s[i] = -2
        best = np.lexsort((np.arange(len(u)), -s))[:5].tolist()
        mine = [got[i][p] for p in range(1, 6)]
        hit += len(set(best) & set(mine))
        if order[i] < 506:
            assert mine == best
    assert hit >= 0.97 * 5 * len(asked)
