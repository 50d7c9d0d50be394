import math

import numpy as np

from stimlake.operators.implausible import Params, Profile, away_from_levels, flag_readings, forward_backward

SCHEMA = "src long, channel string, row_id long, t double, v double, flag string, src_2 string"
LIMITS = {"piezo": (-10.0, 10.0), "count": (0.0, 1e9)}
PROFILES = {"piezo": Profile(), "count": Profile("counter", False, 3.0), "still": Profile("rest", False)}


def series(n, seed=1, src=1, channel="piezo", first=0):
    rng = np.random.default_rng(seed)
    return [[src, channel, first + i, i * 0.02, round(0.4 + float(rng.normal(0, 0.02)), 4), None, "x"] for i in range(n)]


def flags(spark, rows, **params):
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    got = flag_readings(df, LIMITS, PROFILES, Params(**params)).collect()
    assert len({(r.src, r.channel, r.row_id) for r in got}) == len(got)
    return {(r.src, r.row_id): r.flag for r in got}


def test_kinds_of_flags_and_dirt(spark):
    rows = series(300)
    rows[50][4] = 3.0
    rows[80][4], rows[81][4] = -2.0, -2.1
    for i in range(120, 140):
        rows[i][4] = 0.41
    for i in range(200, 208):
        rows[i][4] = 0.42  # too short to be frozen
    rows[250][4] = 99.0
    rows[260][4] = None
    rows[261][4] = math.nan
    rows[262][3] = None
    rows.append(list(rows[50]))
    want = {(1, 50): "spike", (1, 80): "spike", (1, 81): "spike", (1, 250): "out_of_range"} | {(1, i): "stuck" for i in range(120, 140)}
    assert flags(spark, rows) == want


def test_hot_source_in_chunks_gives_the_same(spark):
    rows = series(3000, seed=4)
    for i in (5, 499, 500, 1001, 2998):
        rows[i][4] = 4.0
    for i in range(990, 1030):
        rows[i][4] = 0.4
    whole = flags(spark, rows)
    assert flags(spark, rows, max_rows=500, chunk_rows=500, halo=64) == whole
    assert sum(f == "spike" for f in whole.values()) == 5 - 1  # one of them lies in the frozen stretch
    assert sum(f == "stuck" for f in whole.values()) in (39, 40)


def test_counter_and_resting_channel(spark):
    rows = [[2, "count", i, float(i), float(i // 2), None, ""] for i in range(100)]
    rows[40][4] = 90.0
    rest = [[3, "still", i, float(i), 0.0, None, ""] for i in range(60)]
    assert flags(spark, rows + rest) == {(2, 40): "spike"}


def test_empty_constant_tiny_and_null_sources(spark):
    assert flags(spark, []) == {}
    assert flags(spark, [[1, "piezo", 1, 0.0, 1.0, None, ""], [None, "piezo", 2, 0.0, 99.0, None, ""], [1, None, 3, 0.0, 99.0, None, ""]]) == {}
    same = flags(spark, [[1, "piezo", i, float(i), 1.0, None, ""] for i in range(20)])
    assert len(same) == 20 and set(same.values()) == {"stuck"}
    assert flags(spark, [[1, "piezo", 1, 0.0, math.inf, None, ""]]) == {(1, 1): "out_of_range"}


def test_forward_backward_against_plain_recursion():
    rng = np.random.default_rng(0)
    n, s = 333, 4
    e, first = rng.random((n, s)) + 0.01, np.zeros(n, bool)
    first[[0, 100, 101]] = True
    move, start = rng.dirichlet(np.ones(s), s), rng.dirichlet(np.ones(s))
    want = np.empty((n, s))
    for a, b in ((0, 100), (100, 101), (101, n)):
        al, be = np.empty((b - a, s)), np.ones((b - a, s))
        al[0] = start * e[a]
        for i in range(1, b - a):
            al[i] = (al[i - 1] @ move) * e[a + i]
            al[i] /= al[i].sum()
        for i in range(b - a - 2, -1, -1):
            be[i] = move @ (e[a + i + 1] * be[i + 1])
            be[i] /= be[i].sum()
        want[a:b] = al * be / (al * be).sum(1, keepdims=True)
    assert np.allclose(forward_backward(e, first, move, start, length=16), want)


def test_levels():
    v = np.array([0.0, 1.0] * 50 + [0.5])
    d = away_from_levels(v, reach=20, k=6)
    assert d[:100].max() == 0 and d[100] == 0.5


def test_chunks_are_judged_by_the_whole_source(spark):
    rng = np.random.default_rng(7)
    rows = series(1001, seed=3)
    for i in range(300):  # a quiet part, where the whole source's scatter counts
        rows[i][4] = round(0.4 + float(rng.normal(0, 0.0015)), 4)
    for i in (60, 150, 240):
        rows[i][4] = 0.46
    for i in range(940, 1000):  # a burst before the end, and a spike in the small rest
        rows[i][4] = round(0.4 + float(rng.normal(0, 0.5)), 4)
    rows[700][4] = 4.0
    rows += [list(rows[i]) for i in (499, 500, 700)]
    assert flags(spark, rows, max_rows=500, chunk_rows=250, halo=64) == flags(spark, rows)


def test_a_source_that_grows_noisy_is_not_implausible(spark):
    rng = np.random.default_rng(1)
    sd = np.repeat([0.02, 0.5], 2000)
    rows = [[1, "piezo", i, i * 0.02, round(0.4 + float(rng.normal(0, sd[i])), 4), None, "x"] for i in range(4000)]
    large = list(range(100, 1900, 150)) + list(range(2100, 3900, 150))
    for i in large:
        rows[i][4] = 9.0 if i % 300 == 100 else -9.0
    rows += [list(rows[i]) for i in (1999, 2000, *large[:3])]
    whole = flags(spark, rows)
    assert {i for (_, i), f in whole.items() if f == "spike"} >= set(large) and len(whole) <= len(large) + 12
    assert flags(spark, rows, max_rows=500, chunk_rows=800) == whole


def test_a_burst_of_readings_is_cut_finer(spark):
    rows = series(1200, seed=9)
    for i in range(1, 1100):  # nearly all readings within a short time
        rows[i][3] = 10.0 + i * 1e-5
    rows[0][3], rows[600][4] = -1e5, 5.0
    rows += [[1, "piezo", 5000 + i, 10.00500001, 0.4 + 0.001 * (i % 7), None, ""] for i in range(300)]  # and some at one time
    whole = flags(spark, rows)
    assert whole[1, 600] == "spike"
    assert flags(spark, rows, max_rows=200, chunk_rows=100, halo=70) == whole
