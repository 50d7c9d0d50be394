"""

Each reads the parquet files of $BENCH_SF_DIR and computes the query's whole result in memory on one machine, without
writing it. Prints one line of JSON: seconds by query.
"""

from __future__ import annotations

import json
import math
import os
import time

import numpy as np
import pandas as pd

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def read(name: str, *columns: str) -> pd.DataFrame:
    return pd.read_parquet(f"{SF_DIR}/{name}.parquet", columns=list(columns) or None)


def movie() -> np.ndarray:
    return np.where(np.stack(read("embeddings", "embedding")["embedding"].to_numpy()) > 0, 1.0, -1.0)


def bank() -> np.ndarray:
    """Pixels by filters (phase, s, x, y, o) of the 8 by 8 bank."""
    out = []
    for offset in (0, math.pi / 2):
        for sigma in (1.0, 1.5):
            for x in range(8):
                for y in range(8):
                    for o in range(4):
                        t = o * math.pi / 4
                        h = math.ceil(max(3 * sigma * max(abs(math.cos(t)), abs(math.sin(t))), 1))
                        c, r = np.arange(8)[:, None] - y, np.arange(8)[None] - x
                        a, b = c * math.cos(t) + r * math.sin(t), -c * math.sin(t) + r * math.cos(t)
                        w = np.exp(-0.5 * (a * a + b * b) / sigma**2) / (2 * math.pi * sigma**2) * np.cos(2 * math.pi * (-0.016 * sigma + 0.148) * a + offset)
                        out.append(np.where((abs(c) <= h) & (abs(r) <= h), w, 0).ravel())
    return np.array(out).T


def wavelet_projection():
    return movie() @ bank()


def rf_cross_corr():
    c = wavelet_projection()
    power = c[:, :512] ** 2 + c[:, 512:] ** 2
    y = (read("embeddings", "label")["label"].to_numpy()[:, None] == np.arange(10)).astype(float)
    z = lambda m: (m - m.mean(0)) / np.where(m.std(0) > 0, m.std(0), 1)
    return z(y).T @ z(power) / len(y)


def rf_peak():
    return np.abs(rf_cross_corr()).argmax(1)


def fields() -> tuple[np.ndarray, np.ndarray]:
    rf = read("rf", "neuron", "rfs").dropna().drop_duplicates("neuron")
    return rf["neuron"].to_numpy(), np.nan_to_num(np.stack(rf["rfs"].to_numpy()).astype(float))


def rf_table_peaks():
    ids, v = fields()
    return np.column_stack([ids, *np.unravel_index(np.abs(v).argmax(1), (6, 2, 8, 1)), np.abs(v).max(1)])


def spikes() -> pd.DataFrame:
    t = read("trace", "row_id", "neuron", "t", "v").dropna().drop_duplicates("row_id")
    t = t[t["v"].between(0, 65535)]
    n = read("neurons", "neuron", "expt", "t0", "n_scans").dropna().drop_duplicates("neuron").merge(read("recordings", "expt", "scan_period"), on="expt")
    t = t.merge(n[["neuron", "t0", "scan_period"]], on="neuron")
    k = np.floor((t["t"] - t["t0"]) / t["scan_period"]).astype(int)
    t = t.assign(trial=k % 4, frame=k // 4)[k >= 0]
    return t.groupby(["neuron", "trial", "frame"], as_index=False)["v"].mean()


def trial_zscore_shift():
    s = spikes()
    g = s.groupby(["neuron", "trial"])["v"]
    z = (s["v"] - g.transform("mean")) / (g.transform("std", ddof=0) + 1e-5)
    return z - z.groupby([s["neuron"], s["trial"]]).transform("min")


def repeatability_split():
    s = spikes()
    w = s.assign(half=s["trial"] % 2).groupby(["neuron", "frame", "half"])["v"].mean().unstack().dropna()
    return w.groupby("neuron").apply(lambda g: np.cov(g[0], g[1], ddof=0)[0, 1] / ((g[0].std(ddof=0) + 1e-9) * (g[1].std(ddof=0) + 1e-9)))


def series(name: str, key: str) -> pd.DataFrame:
    return read(name, key, "expt", "t").dropna().drop_duplicates(key).astype({"expt": int}).sort_values("t")


def channel(name: str) -> pd.DataFrame:
    t = read("timeline", "row_id", "expt", "channel", "t", "v").dropna()
    return t[t["channel"].str.strip().str.lower() == name].drop_duplicates("row_id").sort_values(["t", "row_id"])


def asof_backward():
    return pd.merge_asof(series("sync_flips", "flip_id"), series("frame_times", "tick_id").assign(tick_t=lambda d: d["t"]), on="t", by="expt")


def sync_flips_before():
    e = channel("syncecho").sort_values(["expt", "t", "row_id"])
    high = e["v"] > 1
    return e[(high != high.groupby(e["expt"]).shift(-1).fillna(high)).to_numpy()]


def interp_at_events():
    f, p = series("sync_flips", "flip_id"), channel("piezo").drop_duplicates(["expt", "t"])
    return [np.interp(own["t"], g["t"], g["v"], 0, 0) for k, own in f.groupby("expt") if len(g := p[p["expt"] == k])]


def gaussian_1d():
    t = read("trace", "row_id", "neuron", "t", "v").dropna().drop_duplicates("row_id")
    t = t[t["v"].between(0, 65535)].sort_values(["neuron", "t", "row_id"])
    k = np.exp(-0.5 * np.arange(-4, 5) ** 2)
    return [np.convolve(np.pad(v.to_numpy(), 4, "symmetric"), k / k.sum(), "valid") for _, v in t.groupby("neuron")["v"]]


def radius_median():
    ids, v = fields()
    at = read("neurons", "neuron", "py", "px").dropna().drop_duplicates("neuron")
    at = at.merge(pd.DataFrame({"neuron": ids, "pref": np.abs(v).argmax(1) // 16}), on="neuron").sort_values("py")
    y, x, p = (at[c].to_numpy() for c in ("py", "px", "pref"))
    lo, hi = np.searchsorted(y, y - 30), np.searchsorted(y, y + 30, side="right")
    return [np.median(p[a:b][np.hypot(y[a:b] - y[i], x[a:b] - x[i]) <= 30]) for i, (a, b) in enumerate(zip(lo, hi))]


def p3_found():
    f = series("sync_flips", "flip_id").merge(read("recordings", "expt", "tol_s"), on="expt").sort_values("t")
    daq = read("timeline", "row_id", "expt", "channel", "t").dropna(subset=["expt", "t", "channel"])
    daq = daq[daq["channel"].str.strip().str.lower() == "rotary_encoder"].drop_duplicates("row_id").sort_values("t")
    got = [pd.merge_asof(f, r.assign(at=r["t"]), on="t", by="expt", direction="nearest") for r in (series("frame_times", "tick_id"), daq)]
    return [g[(g["at"] - g["t"]).abs() < g["tol_s"]] for g in got]


def p4_found():
    t = read("trace", "neuron", "t", "v").dropna()
    n = read("neurons", "neuron", "expt", "t0", "n_scans").dropna().drop_duplicates("neuron").merge(read("recordings", "expt", "scan_period"), on="expt")
    t = t.merge(n, on="neuron")
    slot = np.floor((t["t"] - t["t0"]) / t["scan_period"]).astype(int)
    have = set(zip(t["neuron"], slot))
    return [(k, s) for k, m in zip(n["neuron"], n["n_scans"].astype(int)) for s in range(m) if (k, s) not in have]


def p5_found():
    ids, v = fields()
    some = np.abs(v).max(1) > 0
    ids, v = ids[some], v[some] / np.linalg.norm(v[some], axis=1, keepdims=True)
    q = np.flatnonzero(np.isin(ids, read("probes", "neuron")["neuron"]))
    s = v[q] @ v.T
    s[np.arange(len(q)), q] = -2
    return np.argpartition(-s, 5, axis=1)[:, :5]


QUERIES = [wavelet_projection, rf_cross_corr, rf_peak, rf_table_peaks, repeatability_split, trial_zscore_shift, asof_backward, interp_at_events, sync_flips_before, gaussian_1d, radius_median, p3_found, p4_found, p5_found]


def main() -> None:
    took = {}
    for q in QUERIES:
        began = time.time()
        q()
        took[q.__name__] = round(time.time() - began, 3)
    print(json.dumps({"metric": "seconds on one node with pandas and NumPy", "queries": took, "sf": SF_DIR}))


if __name__ == "__main__":
    main()
