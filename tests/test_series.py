import math
import random

import pytest

from stimlake.operators import align
from stimlake.operators.series import asof, following, numbered, previous, running_sum, running_total

ROW = "expt long, id long, t double, v double, extra string"


def rows(spark, data):
    return spark.createDataFrame([(*r, "x") for r in data], ROW)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(4)
    return [(rng.choice([1, 1, 1, 2, 3]), i, round(rng.uniform(0, 60) if i % 7 else 30.0, 2), round(rng.gauss(0, 1), 3)) for i in range(500)]


@pytest.mark.parametrize("width", [0.7, 5.0, 1000.0])
def test_carried_over_cells(spark, data, width):
    df = rows(spark, [*data, (None, 900, 1.0, 1.0), (1, 901, None, 1.0)])
    p = {r.id: (r.prev_id, r.prev_v) for r in previous(df, ["expt"], ["t", "id"], ["id", "v"], width).collect()}
    f = {r.id: r.next_id for r in following(df, ["expt"], ["t", "id"], ["id"], width).collect()}
    n = {r.id: r.nth for r in numbered(df, ["expt"], ["t", "id"], width).collect()}
    s = {r.id: r.s for r in running_sum(df, ["expt"], ["t", "id"], df.v, width, "s").collect()}
    assert len(p) == len(data)
    for e in (1, 2, 3):
        own = sorted((t, i, v) for x, i, t, v in data if x == e)
        for k, (_, i, _) in enumerate(own):
            assert p[i] == ((own[k - 1][1], own[k - 1][2]) if k else (None, None))
            assert f[i] == (own[k + 1][1] if k + 1 < len(own) else None)
            assert n[i] == k and math.isclose(s[i], sum(x[2] for x in own[: k + 1]), abs_tol=1e-9)


@pytest.mark.parametrize(("forward", "strict"), [(False, False), (False, True), (True, False), (True, True)])
def test_asof(spark, data, forward, strict):
    left, right = data[:200], data[200:]
    r = rows(spark, right).selectExpr("expt", "t", "t AS rt")
    got = asof(rows(spark, left).select("expt", "id", "t"), r, ["expt"], "t", ["rt"], 3.0, forward=forward, strict=strict).collect()
    assert len(got) == 200
    for x in got:
        ok = [t for e, _, t, _ in right if e == x.expt and (t < x.t if not forward else t > x.t) or (e == x.expt and t == x.t and not strict)]
        assert x.rt == ((min if forward else max)(ok) if ok else None)


def test_edges_trials_and_empty(spark):
    v = [0, 0, 2, 2, 0, None, 2, math.nan, 0, 2]
    sig = rows(spark, [(1, i, float(i), None if x is None else float(x)) for i, x in enumerate(v)])
    ids = lambda **k: sorted(r.id for r in align.edges(sig, 1.0, width=2.0, **k).collect())
    assert ids(side="after") == [2, 4, 6, 8, 9] and ids() == [1, 3, 4, 6, 8]
    assert ids(kind="falling") == [3, 6] and ids(kind="rising", side="after") == [2, 6, 9]
    flips = rows(spark, [(1, i, float(i), 0.0) for i in range(7)] + [(2, 50 + i, float(i), 0.0) for i in range(3)] + [(3, 90, 1.0, 0.0)])
    w = {(r.expt, r.trial): (r.t_start, r.t_end, r.complete) for r in align.trial_windows(flips, 3, width=2.0).collect()}
    # the seventh flip begins a trial without length, which is dropped
    assert w == {(1, 0): (0.0, 3.0, True), (1, 1): (3.0, 6.0, True), (2, 0): (0.0, 2.0, False)}
    none = rows(spark, [])
    assert align.edges(none, 1.0).count() == align.trial_windows(none, 3).count() == align.counter_rises(none).count() == 0
    assert align.interpolate_at(none, flips).select("value").distinct().collect()[0].value == 0.0


def test_interpolation_outside_and_between(spark):
    s = rows(spark, [(1, 1, 0.0, 0.0), (1, 2, 10.0, 5.0), (1, 3, 20.0, None)])
    e = rows(spark, [(1, 11, -1.0, 0.0), (1, 12, 0.0, 0.0), (1, 13, 4.0, 0.0), (1, 14, 11.0, 0.0), (2, 15, 4.0, 0.0)])
    got = {r.id: r.value for r in align.interpolate_at(s, e, outside=None, width=3.0).collect()}
    assert got == {11: None, 12: 0.0, 13: 2.0, 14: None, 15: None}


def test_running_total_over_ranges(spark, data):
    df = spark.createDataFrame([(v, 1) for v in sorted({r[3] for r in data})] + [(None, 1)], "v double, n long")
    for size in (7, 10_000):
        got = {r.v: r.upto for r in running_total(df, "v", df.n, "upto", rows=size).collect()}
        assert got == {v: i + 1 for i, v in enumerate(sorted({r[3] for r in data}))}
    assert running_total(df.limit(0), "v", df.n, "upto").count() == 0


def test_photodiode_flips_and_events(spark):
    level = [0.0] * 10 + [5.0] * 10 + [0.1] * 10 + [5.1] * 10
    level[4], level[25] = 5.0, 5.0  # single outliers are no flips
    signal = rows(spark, [(1, i, float(i), v) for i, v in enumerate(level)] + [(1, 90, 50.0, None), (1, 91, 51.0, math.nan), (2, 92, 0.0, 1.0)])
    for width in (3.0, 1000.0):
        middle = align.level_middle(align.median_filtered(signal, width=width))
        flips = align.photodiode_flips(signal, middle, width=width)
        assert sorted((r.expt, r.t, r.high) for r in flips.collect()) == [(1, 10.0, True), (1, 20.0, False), (1, 30.0, True)]
        events = rows(spark, [(1, 1, 9.5, 0.0), (1, 2, 20.0, 0.0), (1, 3, 31.0, 0.0), (2, 4, 0.0, 0.0)])
        after = {r.id: r.flip_t for r in align.align_to_flips(events, flips, "after", width=width).collect()}
        before = {r.id: r.flip_t for r in align.align_to_flips(events, flips, "before", width=width).collect()}
        assert after == {1: 10.0, 2: 20.0, 3: None, 4: None} and before == {1: None, 2: 20.0, 3: 30.0, 4: None}
    with pytest.raises(ValueError, match="edge"):
        align.align_to_flips(events, flips, "near")


def test_kinds_of_interpolation(spark):
    samples = rows(spark, [(1, 1, 0.0, 1.0), (1, 2, 10.0, 3.0), (1, 3, 20.0, None)])
    events = rows(spark, [(1, 1, 4.0, 0.0), (1, 2, 5.0, 0.0), (1, 3, 10.0, 0.0), (1, 4, 12.0, 0.0)])
    want = {"linear": [1.8, 2.0, 3.0, None], "previous": [1.0, 1.0, 3.0, None], "next": [3.0, 3.0, 3.0, None], "nearest": [1.0, 1.0, 3.0, None]}
    for kind, values in want.items():
        got = {r.id: r.value for r in align.interpolate_at(samples, events, kind=kind, outside=None).collect()}
        assert [got[i] for i in (1, 2, 3, 4)] == values
    with pytest.raises(ValueError, match="kind"):
        align.interpolate_at(samples, events, kind="cubic")
