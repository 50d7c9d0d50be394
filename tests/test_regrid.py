import math

import numpy as np
import pytest

from stimlake.operators.regrid import regrid

R = "src long, row_id long, t double, v double, width double, slot string"
G = "src long, t0 double, width double, n_slots int, t string"


def brute(reads, t0, width, n, reach=2.0, least=1.5):
    out = {}
    for k in range(n):
        mid = t0 + (k + 0.5) * width
        u = np.array([(t - mid) / (reach * width) for t, _ in reads])
        v = np.array([v for _, v in reads])
        w = np.where(abs(u) < 1, (1 - np.minimum(abs(u), 1) ** 3) ** 3, 0)
        sup = w.sum() ** 2 / (w * w).sum() if (w > 0).any() else 0.0
        val = None
        if sup >= least:
            det = w.sum() * (w * u * u).sum() - (w * u).sum() ** 2
            val = ((w * u * u).sum() * (w * v).sum() - (w * u).sum() * (w * u * v).sum()) / det if det > 1e-6 * w.sum() ** 2 else (w * v).sum() / w.sum()
        out[k] = (val, sup, sum(t0 + k * width <= t < t0 + (k + 1) * width for t, _ in reads))
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(3)
    grids, rows, want = [], [], {}
    for src in range(1, 5):
        t0, width, n = float(rng.uniform(0, 50)), 0.37, 60
        reads = [(float(t), float(np.sin(t))) for t in np.sort(rng.uniform(t0 - 1, t0 + n * width + 1, 70)) if not t0 + 5 < t < t0 + 8]
        rows += [(src, 100 * src + i, t, v, width, "x") for i, (t, v) in enumerate(reads)]
        grids.append((src, t0, width, n, "x"))
        want[src] = brute(reads, t0, width, n)
    rows += [rows[0], (1, 9001, None, 1.0, 0.37, ""), (1, 9002, grids[0][1] + 6, None, 0.37, ""), (1, 9003, grids[0][1] + 6, math.nan, 0.37, ""), (77, 9004, 1.0, 1.0, 0.37, "")]
    grids += [grids[0], (9, None, 0.37, 5, ""), (10, 0.0, 0.37, None, ""), (11, 0.0, 0.0, 3, "")]
    got = regrid(spark.createDataFrame(rows, R), spark.createDataFrame(grids, G), block_slots=block, rows_per_task=40).collect()
    assert len(got) == 4 * 60
    for r in got:
        val, sup, n = want[r.src][r.slot]
        assert r.n_readings == n and r.missing == (n == 0)
        assert math.isclose(r.support, sup, abs_tol=1e-9)
        assert (r.value is None) == (val is None) and (val is None or math.isclose(r.value, val, abs_tol=1e-9))


def test_empty(spark):
    none, grid = spark.createDataFrame([], R), spark.createDataFrame([(1, 0.0, 1.0, 3, "")], G)
    assert [(r.slot, r.value, r.missing) for r in regrid(none, grid).orderBy("slot").collect()] == [(0, None, True), (1, None, True), (2, None, True)]
    assert regrid(none, spark.createDataFrame([], G)).count() == 0
