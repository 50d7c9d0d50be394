"""Models of single cells: a nonlinearity on a prediction, tuning curves, and the search for the best feature.

What a model needs of a cell is first aggregated to a bounded summary (bins of the prediction with counts and
sums), however long the recording; fitting then is map-only over one row for each cell.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stimlake.operators.tuning import bin_of
from stimlake.tables import spread

BINS = 256
#: Cells that are fitted side by side.
BATCH = 64


def _sigmoid(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    return p[..., 2:3] / (1 + np.exp(-np.clip(p[..., 0:1] * (p[..., 3:4] * x - p[..., 1:2]), -500, 500)))


def _relu(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(p[..., 1:2] * x, p[..., 0:1], 10_000)


#: The families by name: function of parameters and x, and the bounds of the search by the greatest |x|.
FAMILIES: dict[str, tuple[Callable, Callable[[float], list[tuple[float, float]]]]] = {
    "sigmoid": (_sigmoid, lambda top: [(0, 2), (0, 100), (0, 100), (-10, 10)]),
    "relu": (_relu, lambda top: [(-2 * top - 1e-9, 2 * top + 1e-9), (-10, 10)]),
}


def evolve(loss: Callable[[np.ndarray], np.ndarray], lo: np.ndarray, hi: np.ndarray, seed: int = 2, generations: int = 40, size: int = 12) -> np.ndarray:
    """The best points of differential evolutions side by side: lo, hi and the result are (cells, parameters).

    loss takes (cells, points, parameters). All cells share the random numbers, so the result of one does not depend
    on its company.
    """
    rng = np.random.default_rng(seed)
    cells, d = lo.shape
    n, all_ = size * d, np.arange(cells)
    lo, wide = lo[:, None], (hi - lo)[:, None]
    x = lo + rng.random((n, d)) * wide
    f = loss(x)
    for _ in range(generations):
        a, b = (x[:, rng.integers(0, n, n)] for _ in range(2))
        best = x[all_, f.argmin(1)][:, None]
        trial = np.where(rng.random((n, d)) < 0.7, best + rng.uniform(0.5, 1.0) * (a - b), x)
        trial = np.where((trial < lo) | (trial > lo + wide), lo + rng.random((n, d)) * wide, trial)
        g = loss(trial)
        better = g < f
        x, f = np.where(better[..., None], trial, x), np.where(better, g, f)
    return x[all_, f.argmin(1)]


def refine(residual: Callable[[np.ndarray], np.ndarray], p: np.ndarray, steps: int = 40) -> np.ndarray:
    """Levenberg-Marquardt from each row of p side by side, with numerical derivatives; residual: (cells, parameters) to (cells, values)."""
    d = p.shape[1]
    damp, r = np.full(len(p), 1e-2), residual(p)
    going = np.ones(len(p), bool)
    for _ in range(steps):
        h = 1e-6 * np.maximum(np.abs(p), 1e-3)
        j = np.stack([(residual(p + h * (np.arange(d) == i)) - r) / h[:, i : i + 1] for i in range(d)], axis=2)
        a = np.einsum("kni,knj->kij", j, j)
        a += (damp[:, None] * np.einsum("kii->ki", a) + 1e-12)[:, :, None] * np.eye(d)
        step = np.linalg.solve(a, -np.einsum("kni,kn->ki", j, r)[..., None])[..., 0]
        new = residual(p + step)
        cost = (new * new).sum(1)
        gain = (r * r).sum(1) - cost
        ok = going & (gain > 0)
        p, r = np.where(ok[:, None], p + step, p), np.where(ok[:, None], new, r)
        damp = np.where(gain > 0, np.maximum(damp / 5, 1e-9), np.minimum(damp * 5, 1e9))
        going &= ~((gain > 0) & (gain <= 1e-12 * cost))
        if not going.any():
            break
    return p


def fit_nonlinearity(df: DataFrame, key: str, x: str, y: str, family: str = "relu", bins: int | None = BINS) -> DataFrame:
    """Fit a named nonlinearity of x to y for each key: key, ``params, rmse, r2, n``.

    x is taken by ``bins`` bins of each key (their means), y by counts, sums and squares, of which the squared error
    of any function of x follows. With bins None every distinct x is a bin, which is exact; a key's distinct values then
    have to fit into a task. Null and NaN values take no part; r2 is null for a constant y.
    """
    f, bounds = FAMILIES[family]
    ok = df.filter(F.col(x).isNotNull() & ~F.isnan(x) & F.col(y).isNotNull() & ~F.isnan(y))
    if bins is None:
        placed = ok.withColumn("b", F.col(x))
    else:
        span = ok.groupBy(key).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
        placed = ok.join(span, key).withColumn("b", bin_of(F.col(x), F.col("lo"), F.col("hi"), bins))
    binned = placed.groupBy(key, "b").agg(F.count("*").alias("n"), F.avg(x).alias("x"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("ss"))
    rows = binned.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("b", "n", "x", "s", "ss"))).alias("bins"))

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = max(len(b) for b in pdf["bins"])
        n, xs, s, ss = (np.array([[e[c] for e in b] + [0.0] * (wide - len(b)) for b in pdf["bins"]], float) for c in ("n", "x", "s", "ss"))
        held = np.maximum(n, 1)
        mean, total = s / held, n.sum(1)
        inner = (ss - s * s / held).sum(1)
        loss = lambda p: (n[:, None] * (f(p, xs[:, None]) - mean[:, None]) ** 2).sum(-1) + inner[:, None]
        lo, hi = np.array([bounds(float(np.abs(row).max())) for row in xs], float).transpose(2, 0, 1)
        p = evolve(loss, lo, hi)
        p = refine(lambda q: np.sqrt(n) * (f(q, xs) - mean), p)
        sse = loss(p[:, None])[:, 0]
        var = ss.sum(1) / total - (s.sum(1) / total) ** 2
        r2 = [1 - e / t / v if v > 1e-300 else None for e, t, v in zip(sse, total, var)]
        return pd.DataFrame({key: pdf[key], "params": list(p), "rmse": np.sqrt(sse / total), "r2": pd.Series(r2, pdf.index, dtype=float), "n": total.astype(np.int64)})

    def run(batches):
        for pdf in batches:
            # cells with like numbers of bins side by side
            pdf = pdf.iloc[np.argsort([len(b) for b in pdf["bins"]], kind="stable")]
            for a in range(0, len(pdf), BATCH):
                yield some(pdf.iloc[a : a + BATCH])

    got = spread(rows, key).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, params array<double>, rmse double, r2 double, n long")
    return got.withColumn("r2", F.when(~F.isnan("r2"), F.col("r2")))


def two_branches(df: DataFrame, key: str, y: str, first: str, second: str, train: Column) -> DataFrame:
    """Whether one of two predictions, or both together, says more of a response.

    On the rows that ``train`` holds for, y is fitted by a weighted sum of the two and a constant; on the others
    the correlations with y are taken. Everything follows from sums, so one aggregation with map-side partials does.
    Result: key, ``cc_first, cc_second``, ``best`` (1 or 2, the first if they are equal), ``w_first, w_second``,
    ``cc_both``, ``double`` (whether both together do better) and ``n_test``. Rows with a null or NaN value take no
    part; a correlation with a constant, and weights of predictions that are constant or proportional, are 0.
    """
    ok = df
    for c in (first, second, y):
        ok = ok.filter(F.col(c).isNotNull() & ~F.isnan(c))
    pairs = {"aa": (first, first), "bb": (second, second), "ab": (first, second), "ay": (first, y), "by": (second, y), "yy": (y, y)}
    part = {"t": train, "h": ~train}
    sums = [F.covar_pop(F.when(p, F.col(a)), F.when(p, F.col(b))).alias(f"{h}_{n}") for h, p in part.items() for n, (a, b) in pairs.items()]
    g = ok.groupBy(key).agg(*sums, F.count(F.when(~train, 1)).alias("n_test"))
    c = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    over = lambda a, b: F.coalesce(F.when(b > 0, a / b), F.lit(0.0))
    det = c("t_aa") * c("t_bb") - c("t_ab") * c("t_ab")
    good = det > 1e-12 * c("t_aa") * c("t_bb")
    w1 = F.when(good, (c("t_ay") * c("t_bb") - c("t_by") * c("t_ab")) / det).otherwise(0.0)
    w2 = F.when(good, (c("t_by") * c("t_aa") - c("t_ay") * c("t_ab")) / det).otherwise(0.0)
    g = g.withColumns({"w_first": w1, "w_second": w2, "cc_first": over(c("h_ay"), F.sqrt(c("h_aa") * c("h_yy"))), "cc_second": over(c("h_by"), F.sqrt(c("h_bb") * c("h_yy")))})
    a, b = F.col("w_first"), F.col("w_second")
    g = g.withColumn("cc_both", over(a * c("h_ay") + b * c("h_by"), F.sqrt((a * a * c("h_aa") + 2 * a * b * c("h_ab") + b * b * c("h_bb")) * c("h_yy"))))
    return g.select(key, "cc_first", "cc_second", F.when(F.col("cc_first") >= F.col("cc_second"), 1).otherwise(2).alias("best"), "w_first", "w_second", "cc_both", (F.col("cc_both") > F.greatest("cc_first", "cc_second")).alias("double"), "n_test")


def gaussians(y: np.ndarray, steps: int = 40) -> np.ndarray:
    """Height, centre, width and offset of a Gaussian fitted to each row of y; the centre stays on the curve."""
    n, length = y.shape
    x = np.arange(length, dtype=float)
    w = np.maximum(y - y.min(1, keepdims=True), 1e-12)
    mu = (w * x).sum(1) / w.sum(1)
    p = np.stack([np.ptp(y, axis=1), mu, np.maximum(np.sqrt((w * (x - mu[:, None]) ** 2).sum(1) / w.sum(1)), 0.3), y.min(1)], axis=1)
    lo, hi = np.array([-np.inf, 0, 0.1, -np.inf]), np.array([np.inf, length - 1, 2.0 * length, np.inf])

    def parts_of(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = x - q[:, 1:2]
        e = np.exp(-d * d / (2 * q[:, 2:3] ** 2))
        he = q[:, :1] * e
        j = np.stack([e, he * d / q[:, 2:3] ** 2, he * d * d / q[:, 2:3] ** 3, np.ones_like(e)], axis=2)
        return he + q[:, 3:] - y, j

    damp = np.full(n, 1e-2)
    r, j = parts_of(p)
    cost = (r * r).sum(1)
    for _ in range(steps):
        a = np.einsum("nli,nlj->nij", j, j)
        a += (damp[:, None] * np.maximum(np.einsum("nii->ni", a), 1e-9))[:, :, None] * np.eye(4)
        q = np.clip(p - np.linalg.solve(a, np.einsum("nli,nl->ni", j, r)[..., None])[..., 0], lo, hi)
        r2, j2 = parts_of(q)
        cost2 = (r2 * r2).sum(1)
        ok = cost2 < cost
        p[ok], r[ok], j[ok], cost[ok] = q[ok], r2[ok], j2[ok], cost2[ok]
        damp = np.where(ok, np.maximum(damp / 5, 1e-9), np.minimum(damp * 5, 1e9))
    return p


def fit_gaussian(curves: DataFrame, key: str, vec: str, length: int) -> DataFrame:
    """A Gaussian with offset fitted to each curve of ``length`` values: key, ``height, mu, sigma, offset, r2``.

    Null and NaN values count as 0; r2 is null for a constant curve; curves of another length have no row.
    """

    def run(batches):
        for pdf in batches:
            y = np.nan_to_num(np.array(pdf[vec].tolist(), dtype=float)).reshape(-1, length)
            p = gaussians(y)
            fit = p[:, :1] * np.exp(-((np.arange(length) - p[:, 1:2]) ** 2) / (2 * p[:, 2:3] ** 2)) + p[:, 3:]
            var = y.var(1)
            r2 = np.where(var > 0, 1 - ((fit - y) ** 2).mean(1) / np.where(var > 0, var, 1), np.nan)
            yield pd.DataFrame({key: pdf[key], "height": p[:, 0], "mu": p[:, 1], "sigma": p[:, 2], "offset": p[:, 3], "r2": r2})

    got = curves.filter(F.size(vec) == length).select(key, vec).mapInPandas(run, f"{key} {dict(curves.dtypes)[key]}, height double, mu double, sigma double, offset double, r2 double")
    return got.withColumn("r2", F.when(~F.isnan("r2"), F.col("r2")))


def climb(fields: DataFrame, vec: str, shape: tuple[int, int, int, int], start: str, reach: int = 10, rounds: int = 10) -> DataFrame:
    """Coordinate ascent to each field's best feature: neuron, ``x, y, o, s, value, rounds``.

    From the place in ``start`` (an array that begins with x and y; the middle of the field where it is null or lies
    outside), usually the peak of a coarser field, the best (o, s) at a fixed place and the best place within
    ``reach`` alternate until nothing changes, or ``rounds`` are over.
    """
    nx, ny, no, ns = shape
    begin = [F.coalesce(F.when(F.get(start, i).between(0, n - 1), F.get(start, i)), F.lit(n // 2)).cast("int").alias(f"at{i}") for i, n in ((0, nx), (1, ny))]

    def run(batches):
        for pdf in batches:
            v = np.abs(np.nan_to_num(np.array(pdf[vec].tolist(), np.float64))).reshape(-1, nx, ny, no * ns)
            out = []
            for k, a, x, y in zip(pdf["neuron"], v, pdf["at0"], pdf["at1"]):
                os, n = -1, 0
                while n < rounds:
                    n += 1
                    now = int(a[x, y].argmax())
                    x0, y0 = max(0, x - reach), max(0, y - reach)
                    part = a[x0 : x + reach + 1, y0 : y + reach + 1, now]
                    i, j = np.unravel_index(part.argmax(), part.shape)
                    if (x0 + i, y0 + j, now) == (x, y, os):
                        break
                    x, y, os = int(x0 + i), int(y0 + j), now
                out.append((k, x, y, os // ns, os % ns, float(a[x, y, os]), n))
            yield pd.DataFrame(out, columns=["neuron", "x", "y", "o", "s", "value", "rounds"])

    return fields.filter(F.size(vec) == nx * ny * no * ns).select("neuron", vec, *begin).mapInPandas(run, "neuron long, x int, y int, o int, s int, value double, rounds int")


def two_means(df: DataFrame, key: str, value: str, cells: int | None = 512, rounds: int = 50) -> DataFrame:
    """The middle between the two means that part each key's values best: key, ``low, high, threshold``.

    Values are counted in ``cells`` cells of each key's span first, so that a long signal is a short histogram. With
    cells None every distinct value is one, which is exact; those of a key then have to fit into a task.
    """
    ok = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    span = ok.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    cell = F.col(value) if cells is None else bin_of(F.col(value), F.col("lo"), F.col("hi"), cells)
    h = ok.join(span, key).groupBy(key, cell.alias("b")).agg(F.count("*").alias("n"), F.avg(value).alias("v"))
    rows = h.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("b", "n", "v"))).alias("h"))

    def run(batches):
        for pdf in batches:
            out = []
            for k, cells_ in zip(pdf[key], pdf["h"]):
                n, v = (np.array([c[x] for c in cells_], float) for x in ("n", "v"))
                a, b = v[0], v[-1]
                for _ in range(rounds):
                    up = v > (a + b) / 2
                    a2 = np.average(v[~up], weights=n[~up]) if (~up).any() else a
                    b2 = np.average(v[up], weights=n[up]) if up.any() else b
                    if (a2, b2) == (a, b):
                        break
                    a, b = a2, b2
                out.append((k, float(a), float(b), float((a + b) / 2)))
            yield pd.DataFrame(out, columns=[key, "low", "high", "threshold"])

    return rows.mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, low double, high double, threshold double")
