import json
import math
import os

import numpy as np
import pytest

from stimlake import config
from stimlake import functions as X
from stimlake.operators import correlate, gabor, models, protocol, responses, smoothing, spatial, tuning
from stimlake.sources import cached, load_array, load_results, resolve, save_results, text_log
from stimlake.streaming import delivery_rates, once


def test_blocked_correlation_is_pearson(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(5, 1, (90, 13)), rng.normal(-3, 2, (90, 7))
    x[:, 4], y[:, 2] = 1.5, 0.0
    y[:, 5] = x[:, 1]
    f = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(0, [float(v) for v in x[0]]), (500, [0.0] * 13)], "frame long, vec array<double>")
    r = spark.createDataFrame([(i, [float(v) for v in q], "k") for i, q in enumerate(y)], "frame long, resp array<double>, vec string")
    got = {(a.neuron, a.feature): a.r for a in correlate.cross_correlation(f, r, n_features=13, n_neurons=7, feature_block=5, neuron_block=3, frame_block=16).collect()}
    assert len(got) == 13 * 7
    for j in range(7):
        for i in range(13):
            want = 0.0 if i == 4 or j == 2 else np.corrcoef(x[:, i], y[:, j])[0, 1]
            assert math.isclose(got[j, i], want, abs_tol=1e-9)
    p = correlate.peaks(spark.createDataFrame([(1, 0, 0.5), (1, 3, -0.5), (2, 1, None), (2, 2, 0.1)], "neuron long, feature long, r double").fillna(0.0), 1, 2, 2)
    assert {(q.neuron, q.x, q.o, q.s, q.peak) for q in p.collect()} == {(1, 0, 0, 0, 0.5), (2, 0, 1, 0, 0.1)}


def weight(r, c, theta, sigma, frequency, offset):
    across, along = c * math.cos(theta) + r * math.sin(theta), -c * math.sin(theta) + r * math.cos(theta)
    return math.exp(-0.5 * (across**2 + along**2) / sigma**2) / (2 * math.pi * sigma**2) * math.cos(2 * math.pi * frequency * across + offset)


def test_bank_and_projection(spark):
    b = gabor.bank(gabor.filters(spark, 6, 5, 3, [1.0], [0.0, math.pi / 2]), 6, 5)
    rows = b.collect()
    assert all(0 <= r.pixel < 30 for r in rows)
    mid = next(r for r in rows if (r.x, r.y, r.o, r.phase, r.pixel) == (2, 2, 0, 0, 2 * 6 + 2))
    assert math.isclose(mid.w, 1 / (2 * math.pi))
    rng = np.random.default_rng(0)
    v = rng.choice([-1, 1], (4, 30))
    f = spark.createDataFrame([(i, [int(k) for k in r]) for i, r in enumerate(v)] + [(9, [1]), (10, None)], "frame long, pixels array<int>")
    k = gabor.kernels(gabor.parameters(spark, 3, [1.0], [0.0, math.pi / 2]))
    c = gabor.long_coefficients(gabor.project(f, k, 6, 5), 6, 5, 3).collect()
    assert len(c) == 4 * 6 * 5 * 3 * 2
    for r in c[::37]:
        want = sum(k.w * v[r.frame, k.pixel] for k in rows if (k.x, k.y, k.o, k.s, k.phase) == (r.x, r.y, r.o, r.s, r.phase))
        assert math.isclose(r.coef, want, abs_tol=1e-9)
    rough = {(r.o, r.phase, r.r, r.c): r.w for r in gabor.kernels(gabor.parameters(spark, 3, [1.0], [0.0, math.pi / 2]), sixteen_bit=True).collect()}
    assert all(rough[r.o, r.phase, r.r, r.c] == float(np.float16(r.w)) for r in k.collect())
    one = gabor.resize_frames(spark.createDataFrame([(0, [1.0] * 36)], "frame long, pixels array<double>"), (6, 6), (2, 3), binarise=None).first()
    assert np.allclose(one.pixels, 1.0) and len(one.pixels) == 6


def test_projection_and_coarse_power_at_the_default_size(spark):
    c = config.settings()
    nx, ny, n = c.bank.nx, c.bank.ny, c.bank.orientations
    rng = np.random.default_rng(3)
    v = rng.choice([-1, 1], (2, ny, nx))
    f = spark.createDataFrame([(i, [int(k) for k in r.ravel()]) for i, r in enumerate(v)], "frame long, pixels array<int>")
    coefs = gabor.project(f, gabor.kernels(gabor.parameters(spark, n, list(c.bank.sizes), config.offsets(c.bank))), nx, ny)
    got = {(r.frame, r.s): np.array(r.coef).reshape(2, nx, ny, n) for r in coefs.collect()}
    assert len(got) == 2 * len(c.bank.sizes)
    for frame, s, phase, x, y, o in [(0, 0, 0, 3, 50, 2), (1, 5, 1, 134, 0, 7), (0, 3, 1, 70, 27, 0), (1, 4, 0, 20, 30, 5)]:
        sigma, theta = c.bank.sizes[s], o * math.pi / n
        h = math.ceil(max(3 * sigma * max(abs(math.cos(theta)), abs(math.sin(theta))), 1))
        want = sum(weight(r, q, theta, sigma, -0.016 * sigma + 0.148, phase * math.pi / 2) * v[frame, y + q, x + r] for r in range(-h, h + 1) for q in range(-h, h + 1) if 0 <= x + r < nx and 0 <= y + q < ny)
        assert math.isclose(got[frame, s][phase, x, y, o], want, abs_tol=1e-9)
    small = {(r.frame, r.s): r for r in gabor.coarse(coefs, (nx, ny), n, (27, 11)).collect()}
    assert all(len(r.power) == len(r.re) == 27 * 11 * n for r in small.values())
    flat = (got[1, 2] ** 2).sum(0)
    assert math.isclose(np.mean(small[1, 2].power), flat.mean(), rel_tol=0.05) and min(small[1, 2].power) >= 0


def test_a_made_up_cell_is_its_own_peak(spark):
    rng = np.random.default_rng(5)
    v = rng.choice([-1, 1], (300, 64))
    f = spark.createDataFrame([(i, [int(k) for k in r]) for i, r in enumerate(v)], "frame long, pixels array<int>")
    power = gabor.frame_vectors(gabor.power(gabor.project(f, gabor.kernels(gabor.parameters(spark, 4, [1.0, 1.5], [0.0, math.pi / 2])), 8, 8)), "power")
    wanted = {0: 1 * 256 + 3 * 32 + 4 * 4 + 2, 1: 0 * 256 + 6 * 32 + 1 * 4 + 1}  # s, x, y, o
    cells = power.select("frame", *[(power["vec"][k] * 3 + 1).alias(f"n{n}") for n, k in wanted.items()]).collect()
    noisy = [(r.frame, [r.n0 + 0.02 * float(rng.standard_normal()), r.n1 + 0.02 * float(rng.standard_normal())]) for r in cells]
    field = correlate.cross_correlation(power, spark.createDataFrame(noisy, "frame long, resp array<double>"), n_features=512, n_neurons=2, feature_block=200, frame_block=7, fold=3)
    best = {r.neuron: r.feature for r in correlate.strongest(field, 1).collect()}
    assert best == wanted
    again = correlate.preferred_series(power, spark.createDataFrame([(n, k) for n, k in wanted.items()] + [(7, wanted[0]), (8, 9999), (None, 1)], "neuron long, feature long"))
    assert again.count() == 900 and {r.neuron for r in again.collect()} == {0, 1, 7}


def test_lowpass_kernel_is_the_recursion():
    k = math.tan(math.pi * 2 / 30)
    b, a = k / (1 + k), (k - 1) / (k + 1)
    x = np.random.default_rng(0).normal(size=80)
    y = np.zeros(80)
    for i in range(80):
        y[i] = b * x[i] + (b * x[i - 1] - a * y[i - 1] if i else 0)
    taps = smoothing.lowpass(2.0, 30.0)
    z = [sum(w * x[i + o] for o, w in taps.items() if 0 <= i + o < 80) for i in range(80)]
    assert np.allclose(y, z, atol=1e-6)


@pytest.mark.parametrize("edge", ["zero", "nearest", "reflect"])
def test_convolution_edges(spark, edge):
    x = np.random.default_rng(2).normal(size=9)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)] + [(2, 0, 3.0)], "k long, i long, value double")
    got = {(r.k, r.i): r.smooth for r in smoothing.convolve(df, ["k"], {-2: 0.5, 0: 0.2, 1: 0.3}, edge=edge).collect()}
    pad = np.pad(x, 3, **{"zero": {"mode": "constant"}, "nearest": {"mode": "edge"}, "reflect": {"mode": "symmetric"}}[edge])
    for i in range(9):
        assert math.isclose(got[1, i], 0.5 * pad[i + 1] + 0.2 * pad[i + 3] + 0.3 * pad[i + 4], abs_tol=1e-12)


def test_models(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(x), float(np.clip(1.7 * x, -0.5, 10) + rng.normal(0, 0.05))) for k in (1, 2) for x in rng.normal(0, 2, 300)] + [(3, 1.0, 1.0), (3, None, 2.0)]
    got = {r.k: r for r in models.fit_nonlinearity(spark.createDataFrame(rows, "k long, x double, y double"), "k", "x", "y").collect()}
    assert got[1].r2 > 0.98 and abs(got[1].params[1] - 1.7) < 0.1 and got[3].r2 is None
    whole = {r.k: r for r in models.fit_nonlinearity(spark.createDataFrame(rows, "k long, x double, y double"), "k", "x", "y", bins=None).collect()}
    assert abs(whole[1].r2 - got[1].r2) < 1e-3 and whole[1].rmse <= got[1].rmse + 1e-9
    x = np.arange(8)
    y = 3 * np.exp(-((x - 4.2) ** 2) / 2) + 1
    p = models.gaussians(np.stack([y, y * 2]))
    assert np.allclose(p[:, 1], 4.2, atol=1e-3) and np.allclose(p[0], [3, 4.2, 1, 1], atol=1e-2)
    v = np.zeros((4, 3, 2, 1))
    v[3, 2, 1, 0], v[2, 1, 1, 0] = 2.0, 1.0
    f = spark.createDataFrame([(k, [float(a) for a in v.ravel()] if k != 2 else None, at) for k, at in ((1, None), (2, [0.0]), (3, [2.0, 1.0]), (4, [9.0, 1.0]))], "neuron long, f array<double>, at array<double>")
    assert {(r.neuron, r.x, r.y, r.o, r.value) for r in models.climb(f, "f", (4, 3, 2, 1), "at").collect()} == {(k, 3, 2, 1, 2.0) for k in (1, 3, 4)}
    v[0, 0, 0, 0] = 0.5
    far = spark.createDataFrame([(5, [float(a) for a in v.ravel()], [0.0, 0.0])], "neuron long, f array<double>, at array<double>")
    assert [(r.x, r.y, r.value) for r in models.climb(far, "f", (4, 3, 2, 1), "at", reach=1).collect()] == [(0, 0, 0.5)]  # a peak of its own surroundings
    t = models.two_means(spark.createDataFrame([(1, v) for v in [0.0, 0.1, 0.2] * 9 + [5.0, 5.1]], "k int, v double"), "k", "v").first()
    assert 0.2 < t.threshold < 5.0
    t = models.two_means(spark.createDataFrame([(1, v) for v in [0.0, 0.1, 0.2] * 9 + [5.0, 5.1]], "k int, v double"), "k", "v", cells=None).first()
    assert math.isclose(t.threshold, (0.1 + 5.05) / 2)
    a, b, c = rng.random(3) + 0.1, rng.random(2) + 0.1, rng.random(4) + 0.1
    cells = np.einsum("i,j,k->ijk", a, b, c)
    r = tuning.rank_one(spark.createDataFrame([(1, [None if i == 5 else float(x) for i, x in enumerate(cells.ravel())])], "neuron int, cells array<double>"), "neuron", (3, 2, 4)).first()
    assert r.error < 0.05


def test_radius_medians_against_brute_force(spark):
    rng = np.random.default_rng(6)
    at, pref = rng.uniform(0, 100, (150, 2)), rng.integers(0, 6, (150, 2))
    df = spark.createDataFrame([(i, float(a[0]), float(a[1]), int(p[0]), int(p[1])) for i, (a, p) in enumerate(zip(at, pref))] + [(900, None, 1.0, 1, 1)], "id long, y double, x double, pref_x int, pref_y int")
    got = {r.id: (r.smooth_x, r.smooth_y) for r in spatial.smooth_positions(df, 11.0, 6).collect()}
    assert set(got) == set(range(150))
    for i in range(150):
        near = np.hypot(*(at - at[i]).T) <= 11.0
        assert got[i] == tuple(int(m) for m in np.median(pref[near], axis=0))


def test_responses_with_gaps_and_constants(spark):
    rows = [(1, t, f, float((f * 7 + t) % 5)) for t in range(4) for f in range(6)] + [(2, t, f, 3.0) for t in range(4) for f in range(6)] + [(3, 0, 0, 1.0)]
    df = spark.createDataFrame(rows, "neuron long, trial int, frame long, value double")
    r = {x.neuron: x.repeatability for x in responses.repeatability_split(df, 4).collect()}
    assert r[2] == 0.0 and 3 not in r
    assert {x.repeatability for x in responses.repeatability_split(df, 7).collect()} == {0.0}
    back = responses.undo_zscore(responses.zscore(df, ["neuron"], keep_stats=True).withColumnRenamed("value", "was"))
    assert all(math.isclose(x.was, x.value, abs_tol=1e-9) for x in back.collect())
    assert {x.scaled for x in responses.rescale(df, ["neuron"], 2.0).filter("neuron = 2").collect()} == {0.0}
    assert responses.quality(df.limit(0), 4).count() == 0


def test_settings(tmp_path):
    c = config.settings({"N_thetas": "4", "Phases": "[0, 90]", "Theme": "dark"}, {"Experiment Info": "('s', '2024-01-02', 3)"})
    assert len(config.angles(c.bank)) == 4 and math.isclose(config.offsets(c.bank)[1], math.pi / 2) and config.offsets(c.bank, "raw") == [0, 90]
    assert c.run.experiment == ("s", "2024-01-02", "3") and config.experiment_folder(c.run) == "./s/2024-01-02/3"
    assert config.analysed_sizes(c.run) == [4, 6, 8, 10, 12, 16]  # in degrees of the analysed part: 135 degrees on 135 pixels
    assert config.analysed_shares(c.run) == (0.75, 1.0) and config.analysed_pixels(c.run, 54, 180) == (0, 54, 0, 135)
    assert c.run.spikes is None and c.run.folders == (".",) and config.settings(config.written("bank", c.bank)).bank == c.bank
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"gabor_param": {"Save Path": "{PROJECT_ROOT}/lib"}, "param_defaults": {"Hz": "60", "Dirs": "['~', '$HOME/x']"}}))
    got = config.settings_file(str(p), "/r")
    assert got.bank.saved_at == "/r/lib" and got.run.rate == 60 and got.run.folders == (os.path.expanduser("~"), os.path.expandvars("$HOME/x"))
    with pytest.raises(ValueError, match="needs 4 values"):
        config.settings(None, {"Visual Coverage": "[1, 2, 3]"})
    for bad in ({"Hz": "2.5"}, {"Hz": "None"}, {"Sigmas": "[1, 'a']"}):
        with pytest.raises(ValueError, match="cannot be read"):
            config.settings(None, bad)


def test_sources(spark, tmp_path):
    a = np.arange(12, dtype=np.float32).reshape(3, 4)
    np.save(tmp_path / "a.npy", a)
    got = load_array(spark, str(tmp_path / "a.npy")).orderBy("i").collect()
    assert [r["values"] for r in got] == a.tolist()
    assert [r.i for r in load_array(spark, str(tmp_path / "a.npy"), rows=(1, 3)).orderBy("i").collect()] == [1, 2]
    assert load_array(spark, str(tmp_path / "a.npy"), rows=(2, 2)).count() == 0 and load_array(spark, str(tmp_path / "a.npy"), rows=(2, 9)).count() == 1
    save_results({"fits": spark.range(4), "peaks": spark.range(2)}, str(tmp_path / "run"))
    assert {n: d.count() for n, d in load_results(spark, str(tmp_path / "run"), "fits", "peaks").items()} == {"fits": 4, "peaks": 2}
    spark.range(5).write.parquet(str(tmp_path / "a.parquet"))
    assert load_array(spark, str(tmp_path / "a.npy")).count() == 5  # the table beside it comes first
    assert load_array(spark, str(tmp_path / "b.npy"), missing_ok=True) is None
    np.save(tmp_path / "o.npy", np.array({"x": 1}), allow_pickle=True)
    with pytest.raises(Exception, match="pickled"):
        load_array(spark, str(tmp_path / "o.npy")).collect()
    assert resolve("a.npy", ["/nowhere", str(tmp_path)]) == str(tmp_path / "a.npy")
    built = []
    for _ in range(2):
        assert cached(spark, str(tmp_path / "c"), lambda: built.append(1) or spark.range(3)).count() == 3
    assert built == [1]
    (tmp_path / "log.txt").write_text("one\ntwo")
    assert [(r.at, r.line) for r in text_log(spark, str(tmp_path / "log.txt")).orderBy("at").collect()] == [(0, "one"), (1, "two")]


def test_functions(spark):
    names = X.register(spark)
    assert "sl_relu" in names
    r = spark.sql("SELECT sl_relu(-3, 0.5) AS a, sl_sigmoid(0, 1, 0, 2) AS b, sl_decay(0, 2, 0) AS c").first()
    assert (r.a, r.b, r.c) == (0.5, 1.0, 0.25)


def test_stream(spark, tmp_path):
    rows = spark.sql("SELECT id AS row_id, 1L AS expt, ' Piezo' AS channel, double(id) AS v, timestamp'2024-01-01' + make_dt_interval(0, 0, 0, id) AS logged_at FROM range(10)")
    rows.unionByName(rows.limit(3)).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = once(s).writeStream.format("memory").queryName("got_once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("got_once").count() == 10
    assert delivery_rates(s).isStreaming


def test_cut_and_register(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() >= 0


def test_tuning_curves_find_a_separable_cell(spark):
    rng = np.random.default_rng(8)
    rho, phi, d = rng.uniform(0, 2, 6000), rng.uniform(0, 2 * math.pi, 6000), rng.uniform(-1, 1, 6000)
    w = (rho > 1) * (1 + np.cos(phi - 2)) * (d > 0)
    df = spark.createDataFrame([(1, i % 2, float(a), float(b), float(c), float(x)) for i, (a, b, c, x) in enumerate(zip(rho, phi, d, w))], "k long, trial int, rho double, phi double, dphi double, w double")
    v = tuning.tuning_volume(df, ["k"], "trial", 1.0, 8)
    assert math.isclose(sum(r["count"] for r in v.collect()), 3000) and math.isclose(sum(r.weighted for r in v.collect()), w.sum() / 2)
    c = tuning.tuning_curves(v, "k", 8, 1.0, smooth=3).first()
    assert c.drift > 0 and 0.3 < c.half_rho < 0.7 and abs(int(np.argmax(c.f_phi)) - 2) <= 1
    p = tuning.predict_from_curves(df, tuning.tuning_curves(v, "k", 8, 1.0, 3), df.selectExpr("k", "rho AS rho_hi", "phi AS phi_hi").groupBy("k").max("rho_hi", "phi_hi").toDF("k", "rho_hi", "phi_hi"), ["k"], 8, 1.0)
    got = np.array([(r.pred, r.w) for r in p.collect()])
    assert np.corrcoef(got.T)[0, 1] > 0.9


def test_hann_goes_round():
    v = np.zeros((1, 5, 6, 4))
    v[0, 2, 0, 1] = 1.0
    s = tuning.hann_volume(v, 3)
    assert math.isclose(s.sum(), 1.0) and math.isclose(s[0, 2, 5, 1], s[0, 2, 1, 1])


def test_cells_maps_and_sets(spark):
    c = spark.createDataFrame([(1, True, 1), (2, False, 1), (3, None, 1), (4, True, 0), (5, True, None), (6, True, 2), (6, True, 2), (None, True, 1)], "neuron long, iscell boolean, plane int")
    peaks = spark.createDataFrame([(1, 0.5), (6, 0.2), (6, 0.3), (4, 0.9)], "neuron long, peak double")
    assert {(r.neuron, r.peak) for r in spatial.select_cells(c, peaks=peaks).collect()} == {(1, 0.5), (6, 0.3)}
    assert {r.neuron for r in spatial.select_cells(c, without_planes=()).collect()} == {1, 4, 6}
    at = [(1, -150.0, -20.0, 2, 1), (2, -150.0, -20.0, 2, 1), (3, 260.0, 5.0, 4, 0), (4, None, 0.0, 1, 1)]
    cells = spark.createDataFrame(at, "id long, y double, x double, pref_x int, pref_y int")
    got = {(r.gy, r.gx): (r.med_x, r.med_y) for r in spatial.preference_map(cells, 100.0, 100.0, 6).collect()}
    assert got == {(-2, 0): (2.0, 1.0), (-1, 0): (2.0, 1.0), (2, 0): (4.0, 0.0), (-2, -1): (2.0, 1.0), (-1, -1): (2.0, 1.0)}
    assert spatial.preference_map(cells.limit(0), 100.0, 100.0, 6).count() == 0
    m = tuning.moved(spark.createDataFrame([(1, i, float(i)) for i in range(4)], "k long, i long, v double"), ["k"], "v", 3)
    assert {r.i: r.moved for r in m.collect()} == {0: 3.0, 1: 0.0, 2: 0.0, 3: 0.0}
    parts = [r.part for r in protocol.split_rows(spark.range(4000), "id", {"a": 3.0, "b": 1.0}, seed=1).collect()]
    assert abs(parts.count("a") / 4000 - 0.75) < 0.03 and set(parts) == {"a", "b"}


def test_matched_distribution_of_many_values(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(0, 1, 900).round(3), rng.exponential(1, 700).round(3)
    df = lambda v: spark.createDataFrame([(float(a),) for a in v] + [(None,), (math.nan,)], "value double")
    for size in (50, 20_000):
        got = {r.value: r.matched for r in smoothing.match_distribution(df(x), df(y), cell_rows=size).collect()}
        v, n = np.unique(x, return_counts=True)
        w, m = np.unique(y, return_counts=True)
        assert np.allclose([got[a] for a in v], np.interp(np.cumsum(n) / n.sum(), np.cumsum(m) / m.sum(), w))
    assert smoothing.match_distribution(df([]), df(y)).count() == 0


def test_two_branches(spark):
    rng = np.random.default_rng(3)
    a, b, e = rng.normal(size=(3, 400))
    rows = [(k, i, float(a[i]), float(b[i]), float(y)) for k, f in ((1, lambda i: 2 * a[i] + 0.1 * e[i]), (2, lambda i: a[i] + 3 * b[i]), (3, lambda i: 1.0)) for i in range(400) for y in (f(i),)]
    rows += [(1, 999, None, 1.0, 1.0), (4, 0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, i int, a double, b double, y double")
    got = {r.k: r for r in models.two_branches(df, "k", "y", "a", "b", df.i % 2 == 0).collect()}
    assert got[1].best == 1 and got[1].cc_first > 0.99 and abs(got[1].w_first - 2) < 0.05
    assert got[2].best == 2 and got[2].double and abs(got[2].w_second - 3) < 1e-9 and math.isclose(got[2].cc_both, 1.0)
    assert got[3].cc_both == got[3].cc_first == 0 and not got[3].double and got[4].w_first == 0 and got[4].n_test == 0


def test_drifting_response(spark):
    coefs = spark.createDataFrame([(i, 0, 0, [float(10 * i + j) for j in range(6)]) for i in (0, 1, 2, 3, 5)], "frame long, f int, s int, coef array<double>")
    got = {r.frame: r.response for r in gabor.drifting_response(coefs, 3).collect()}
    assert got == {0: [0 + 12 + 24, 1 + 13 + 25], 1: [10 + 22 + 34, 11 + 23 + 35]}
    assert gabor.drift(0.0, 1.0, 3) == [0.0, 0.5, 1.0] and gabor.drift(0.5, 1.0, 1) == [0.5]
