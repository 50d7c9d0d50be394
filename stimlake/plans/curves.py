"""Queries of smoothing, tuning, spatial maps and protocols."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stimlake import functions as X
from stimlake.operators import protocol as P
from stimlake.operators import smoothing as S
from stimlake.operators import spatial as M
from stimlake.operators import tuning as T
from stimlake.operators.correlate import array_peak
from stimlake.operators.series import numbered, previous
from stimlake.plans.alignment import TRACES_SQL, channel_matrix, possible, span_sql, traces
from stimlake.plans.responses import rounded
from stimlake.tables import cut, maybe_broadcast, table, usable

WIDTH = 300.0


def dense(s: SparkSession, d: str) -> DataFrame:
    """Readings of each neuron in order, numbered from 0: neuron, i, value."""
    return numbered(traces(s, d), ["neuron"], ["t", "row_id"], WIDTH, "i").select("neuron", "i", F.col("v").alias("value"))


def _smooth(kernel: dict[int, float], **how):
    return lambda s, d: rounded(S.convolve(dense(s, d), ["neuron"], kernel, **how), "smooth")


def pairs(s: SparkSession, d: str) -> DataFrame:
    """Photodiode and piezo as the two parts of an angle, with the encoder: expt, i, t, c, s, w."""
    m = channel_matrix(s, d, whole=False).dropna()
    m = numbered(m, ["expt"], ["t"], WIDTH, "i")
    return m.select("expt", "i", "t", (F.col("photodiode") - 1).alias("c"), F.col("piezo").alias("s"), F.greatest("rotary_encoder", F.lit(0.0)).alias("w"))


def angles(s: SparkSession, d: str) -> DataFrame:
    rho, phi = T.polar(F.col("c"), F.col("s"))
    p = pairs(s, d).withColumns({"rho": rho, "phi": phi})
    p = previous(p, ["expt"], ["t"], ["phi"], WIDTH)
    return p.withColumn("dphi", F.coalesce(S.unwrapped_step(F.col("phi"), F.col("prev_phi")), F.col("phi"))).drop("prev_phi")


def polar_features(s: SparkSession, d: str) -> DataFrame:
    return rounded(angles(s, d).select("expt", "i", "rho", "phi"), "rho", "phi")


def phase_unwrap_diff(s: SparkSession, d: str) -> DataFrame:
    """Steps of the angle; those of 3 or more are gaps (null)."""
    step = F.when(F.abs("dphi") < 3, F.col("dphi"))
    return rounded(angles(s, d).select("expt", "i", step.alias("dphi")), "dphi")


def gap_fill(s: SparkSession, d: str) -> DataFrame:
    """The steps with gaps filled linearly between their neighbours, held at the ends."""
    from stimlake.operators.series import asof

    a = angles(s, d).select("expt", F.col("i").cast("double").alias("t"), F.when(F.abs("dphi") < 3, F.col("dphi")).alias("dphi"))
    known = a.filter("dphi IS NOT NULL").select("expt", "t", F.col("t").alias("k"), F.col("dphi").alias("v"))
    b = asof(a.select("expt", "t"), known, ["expt"], "t", ["k", "v"], 20_000.0).withColumnsRenamed({"k": "k0", "v": "v0"})
    b = asof(b, known, ["expt"], "t", ["k", "v"], 20_000.0, forward=True)
    v = F.when(F.col("k0").isNull(), F.col("v")).when(F.col("k").isNull() | (F.col("k") == F.col("k0")), F.col("v0")).otherwise(F.col("v0") + (F.col("v") - F.col("v0")) * (F.col("t") - F.col("k0")) / (F.col("k") - F.col("k0")))
    return b.select("expt", F.col("t").cast("long").alias("i"), F.round(v, 6).alias("dphi"))


def binned_mean_2d(s: SparkSession, d: str) -> DataFrame:
    g = T.binned_mean(pairs(s, d), ["expt"], {"bc": ("c", 10), "bs": ("s", 10)}, "w")
    return rounded(g, "mean")


def tuning_volume_3d(s: SparkSession, d: str) -> DataFrame:
    """Encoder movement by radius, angle and step, each recording's halves being two trials."""
    a = angles(s, d).withColumn("trial", F.pmod(F.floor(F.col("i") / 64), F.lit(2))).withColumn("dphi", F.greatest(F.least("dphi", F.lit(math.pi)), F.lit(-math.pi)))
    return rounded(T.tuning_volume(a, ["expt"], "trial", 4.0, 8), "weighted", "count", "mean")


def sta_lags(s: SparkSession, d: str) -> DataFrame:
    return rounded(T.triggered_average(pairs(s, d), ["expt"], "w", "s", 5), "sta")


def stc_lags(s: SparkSession, d: str) -> DataFrame:
    return rounded(T.triggered_covariance(pairs(s, d), ["expt"], "w", "s", "c", 3), "stc", places=5)


def _rf(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "rf").filter("rfs IS NOT NULL").dropDuplicates(["neuron"])


def circular_variance(s: SparkSession, d: str) -> DataFrame:
    e = _rf(s, d).select("neuron", F.posexplode("rfs").alias("i", "r")).select("neuron", (F.pmod("i", F.lit(8)) * 22.5).alias("angle"), F.abs(F.coalesce(F.when(~F.isnan("r"), F.col("r").cast("double")), F.lit(0.0))).alias("r"))
    v = T.circular_variance(e, ["neuron"], "angle", "r")
    return v.select("neuron", F.round(F.cos(F.radians(F.col("preferred") * 2)), 5).alias("preferred_cos"), F.round("variance", 6).alias("variance"))


def rf_marginals(s: SparkSession, d: str) -> DataFrame:
    return T.rank_two_marginals(_rf(s, d), "rfs", 6, 2, 8)


def parafac_rank1(s: SparkSession, d: str) -> DataFrame:
    v = _rf(s, d).select("neuron", F.transform("rfs", lambda x: F.abs(x.cast("double"))).alias("cells"))
    return T.rank_one(v, "neuron", (6, 2, 8))


def cells(s: SparkSession, d: str) -> DataFrame:
    """Neurons with a position and a field: id, y, x and the preferred place."""
    at = table(s, d, "neurons").filter("py IS NOT NULL AND px IS NOT NULL").dropDuplicates(["neuron"]).select("neuron", F.col("py").alias("y"), F.col("px").alias("x"))
    # the peaks are taken before copies are dropped, so that no field is shuffled; the cells are used more than once
    peak = array_peak(table(s, d, "rf").filter("rfs IS NOT NULL"), "rfs", 2, 8, 1).select("neuron", F.col("x").alias("pref_x"), F.col("y").alias("pref_y")).dropDuplicates(["neuron"])
    return cut(at.join(peak, "neuron").withColumnRenamed("neuron", "id"), "cells")


def selected_cells(s: SparkSession, d: str) -> DataFrame:
    """Cells outside plane 0 whose field has a peak above 0.2."""
    peaks = array_peak(_rf(s, d), "rfs", 2, 8, 1).select("neuron", "peak")
    got = M.select_cells(table(s, d, "neurons").select("neuron", "expt", "iscell", "plane", "py", "px"), peaks=peaks)
    return rounded(got.select("neuron", "expt", "plane", "py", "px", "peak"), "peak")


def neuropil(s: SparkSession, d: str) -> DataFrame:
    """Readings of the cells less 0.7 of their surround: what all regions of their plane show on average in the same second."""
    who = table(s, d, "neurons").filter("neuron IS NOT NULL").groupBy("neuron").agg(F.coalesce(F.bool_or("iscell"), F.lit(False)).alias("iscell"))
    t = possible(s, d, table(s, d, "trace").filter(usable("t") & usable("v")), "cell_trace").dropDuplicates(["row_id"]).withColumn("second", F.floor("t")).join(who, "neuron")
    surround = t.groupBy("expt", "plane", "second").agg(F.avg("v").alias("surround"))
    got = t.filter("iscell").join(surround, ["expt", "plane", "second"])
    return got.select("neuron", "row_id", F.round(X.neuropil_corrected(F.col("v"), F.col("surround")) + 1e-9, 5).alias("v"))


def lead_zero_fill(s: SparkSession, d: str) -> DataFrame:
    """The reading five places further on, 0 beyond the end."""
    return T.moved(dense(s, d), ["neuron"], "value", 5).select("neuron", "i", "moved")


def split_sets(s: SparkSession, d: str) -> DataFrame:
    """Neurons put into three sets by a seeded hash."""
    return P.split_rows(table(s, d, "neurons").select("neuron").filter("neuron IS NOT NULL").distinct(), "neuron", {"train": 0.7, "test": 0.2, "check": 0.1}, seed=3)


def radius_median(s: SparkSession, d: str) -> DataFrame:
    return M.smooth_positions(cells(s, d), 30.0, 6)


def preference_map(s: SparkSession, d: str) -> DataFrame:
    return M.preference_map(cells(s, d), 100.0, 100.0, 6)


def sign_map(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.sign_map(M.preference_map(cells(s, d), 100.0, 100.0, 6)), "sign")


def unwrap_strips(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.unwrap_strips(cells(s, d).select("id", "y", "x"), 1.3671), "uy", "ux")


def hann_2d(s: SparkSession, d: str) -> DataFrame:
    g = T.binned_mean(pairs(s, d), ["expt"], {"by": ("c", 10), "bx": ("s", 10)}, "w").select("expt", "by", "bx", F.col("mean").alias("value"))
    return rounded(S.hann_grid(g, ["expt"], 5), "smooth")


def cdf_match(s: SparkSession, d: str) -> DataFrame:
    """The encoder's distribution matched to that of the piezo channel."""
    m = channel_matrix(s, d, whole=False)
    values = lambda c: m.select((F.col(c) + 0.0).alias("value"))
    return rounded(S.match_distribution(values("rotary_encoder"), values("piezo")), "matched")


def log_lines(s: SparkSession, d: str) -> DataFrame:
    """Log lines written from the events of each user."""
    e = table(s, d, "events").filter("ts IS NOT NULL")
    at = F.date_format("ts", "HH:mm")
    line = F.when(F.col("event_type") == "signup", F.concat(F.lit("t "), at, F.lit(" Starting Series on "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" no "), F.col("event_id").cast("string")))
    line = line.when(F.col("event_type") == "purchase", F.concat(F.lit("t "), at, F.lit(" Completed"))).when(F.col("event_type") == "click", F.concat(F.lit("t Loaded parameter file c:\\p\\"), F.col("event_id").cast("string"))).when(F.col("event_type") == "error", F.concat(F.lit("t "), at, F.lit(" Interrupted")))
    return e.select("user_id", F.struct("ts", "event_id").alias("at"), line.alias("line"))


def log_sessions(s: SparkSession, d: str) -> DataFrame:
    r = P.log_sessions(log_lines(s, d), "user_id", "at", "line")
    return r.select("user_id", "overall_id", "date", "num", "pfile", "start", "end", F.col("dur").cast("long").alias("dur"), F.size("log").alias("n_log"))


def sequence_invert(s: SparkSession, d: str) -> DataFrame:
    """Which line came when in each order: the positions of each part's lines, inverted."""
    rows = table(s, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("seq"))
    return P.invert_sequence(rows, ["l_orderkey"], "l_partkey", "seq")


def stim_matrix_first_n(s: SparkSession, d: str) -> DataFrame:
    r = P.first_repeats(table(s, d, "lineitem"), "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], 8)
    return r.select("l_suppkey", "repeat", "l_extendedprice")


def stim_contrast_mean(s: SparkSession, d: str) -> DataFrame:
    return rounded(P.group_means(table(s, d, "lineitem"), ["l_suppkey", "l_returnflag"], "l_extendedprice", F.col("l_linestatus") == "O"), "mean", places=4)


def param_sweep(s: SparkSession, d: str) -> DataFrame:
    """Trials of a sweep: readings below each threshold in each plane."""
    g = P.sweep(s, threshold=[500.0, 1000.0, 2000.0], plane=[0, 1, 2, 3, 4])
    t = table(s, d, "trace").filter(usable("v")).groupBy("plane", F.floor("v").alias("v")).agg(F.count("*").alias("k"))
    return maybe_broadcast(g).join(t, "plane").groupBy("run", "threshold", "plane").agg(F.sum(F.when(F.col("v") < F.col("threshold"), F.col("k")).otherwise(0)).alias("n"))


def signed_angle(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    x = [F.element_at("embedding", i).cast("double") for i in (1, 2, 3, 4)]
    return e.select("vec_id", F.round(P.signed_angle(*x), 5).alias("angle"), F.round(X.angle_unsigned(F.array(x[0], x[1]), F.array(x[2], x[3])), 5).alias("unsigned"))


def event_numbers(s: SparkSession, d: str) -> DataFrame:
    """What events say: a number of their JSON text, as a label in multiples of pi, their value in 8 bits of its type's
    greatest, and the numbers of the message made of them."""
    e = table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    top = e.groupBy("event_type").agg(X.finite_top(F.col("value")).alias("top"))
    label = X.pi_label((F.pmod("k", F.lit(5)) - 2) * math.pi)
    return e.join(top, "event_type").select("event_id", "k", label.alias("label"), X.to_byte(F.col("value"), F.lit(0.0), F.col("top")).alias("byte"), *P.split_words(F.concat_ws(" ", "event_type", "k", "value"), 2))


def relu_sigmoid_predict(s: SparkSession, d: str) -> DataFrame:
    p = pairs(s, d)
    x = X.weighted([F.col("c"), F.col("s")], [1.5, -0.5])
    return rounded(p.select("expt", "i", X.sigmoid(x, 1.2, 0.3, 4.0).alias("sigmoid"), X.relu(x, 0.1).alias("relu"), X.gaussian(x, 0.2, 0.7).alias("gaussian"), X.decay(F.abs(x), 1.8).alias("decay")), "sigmoid", "relu", "gaussian", "decay")


_N = f"SELECT neuron, v AS value, row_number() OVER (PARTITION BY neuron ORDER BY t, row_id) - 1 AS i FROM ({TRACES_SQL})"
_M = "SELECT expt, t, " + ", ".join(f"max(CASE WHEN lower(trim(channel)) = '{n}' THEN v END) AS {n}" for n in ("photodiode", "piezo", "rotary_encoder")) + " FROM timeline WHERE t IS NOT NULL AND NOT isnan(t) AND v IS NOT NULL AND NOT isnan(v) AND " + span_sql("v", "lower(trim(timeline.channel))") + " GROUP BY expt, t"
_P = f"SELECT expt, t, row_number() OVER (PARTITION BY expt ORDER BY t) - 1 AS i, photodiode - 1 AS c, piezo AS s, greatest(rotary_encoder, 0) AS w FROM ({_M}) WHERE photodiode IS NOT NULL AND piezo IS NOT NULL AND rotary_encoder IS NOT NULL"
_A = f"SELECT *, coalesce(phi - p - 2 * pi() * round((phi - p) / (2 * pi())), phi) AS dphi FROM (SELECT *, lag(phi) OVER (PARTITION BY expt ORDER BY t) AS p FROM (SELECT *, sqrt(c * c + s * s) AS rho, CASE WHEN atan2(s, c) < 0 THEN atan2(s, c) + 2 * pi() ELSE atan2(s, c) END AS phi FROM ({_P})))"
_ROWS = "sum(value) OVER (PARTITION BY neuron ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


def _kernel_sql(kernel: dict[int, float], edge: str) -> str:
    taps = ", ".join(f"({o}, {w!r}::DOUBLE)" for o, w in kernel.items())
    at = {"zero": "n.i + o", "nearest": "greatest(0, least(m - 1, n.i + o))", "reflect": "CASE WHEN n.i + o < 0 THEN -1 - n.i - o WHEN n.i + o >= m THEN 2 * m - 1 - n.i - o ELSE n.i + o END"}[edge]
    return f"WITH n AS (SELECT *, count(*) OVER (PARTITION BY neuron) AS m FROM ({_N})), k(o, w) AS (VALUES {taps}), e AS (SELECT neuron, n.i, {at} AS j, w FROM n, k) SELECT e.neuron, e.i, round(sum(w * v.value), 6) AS smooth FROM e JOIN n v ON v.neuron = e.neuron AND v.i = e.j GROUP BY e.neuron, e.i"


_BIN = "CAST(least(floor(({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) * 10), 9) AS INTEGER)"
_GRID = f"SELECT expt, bc, bs, avg(w) AS mean, count(w) AS n FROM (SELECT expt, {_BIN.format('c')} AS bc, {_BIN.format('s')} AS bs, w AS w FROM ({_P}) WINDOW w AS (PARTITION BY expt)) GROUP BY ALL".replace("w AS w FROM", "w FROM").replace("OVER w", "OVER ww").replace("WINDOW w AS", "WINDOW ww AS")
_LAG = ", ".join(f"lag(s, {k}) OVER w AS s{k}, lag(c, {k}) OVER w AS c{k}" for k in range(5))
_LAGS = f"(SELECT *, {_LAG} FROM (SELECT expt, i, c, s, w AS z FROM ({_P})) WINDOW w AS (PARTITION BY expt ORDER BY i))"
_DIST = "SELECT value, n, sum(n) OVER (ORDER BY value) / sum(n) OVER () AS q FROM (SELECT {c} + 0.0 AS value, count(*) AS n FROM (" + _M + ") WHERE {c} IS NOT NULL GROUP BY 1)"
_V1 = "(SELECT DISTINCT ON (neuron) neuron, rfs FROM rf WHERE rfs IS NOT NULL)"
_E1 = f"(SELECT neuron, i - 1 AS i, CASE WHEN rfs[i] IS NULL OR isnan(rfs[i]) THEN 0 ELSE abs(CAST(rfs[i] AS DOUBLE)) END AS r FROM (SELECT neuron, rfs, unnest(range(1, 97)) AS i FROM {_V1}))"
_CELLS = f"(SELECT n.neuron AS id, py AS y, px AS x, CAST(i // 16 AS INTEGER) AS pref_x, CAST(i % 16 // 8 AS INTEGER) AS pref_y FROM (SELECT DISTINCT neuron, py, px FROM neurons WHERE py IS NOT NULL AND px IS NOT NULL) n JOIN (SELECT neuron, i, row_number() OVER (PARTITION BY neuron ORDER BY r DESC, i) AS k FROM {_E1}) p ON n.neuron = p.neuron AND k = 1)"
_PREF = f"(WITH c AS {_CELLS}, g AS (SELECT gy, gx FROM (SELECT unnest(range(CAST(floor(min(y) / 100) AS BIGINT), CAST(floor(max(y) / 100) AS BIGINT) + 1)) AS gy, CAST(floor(min(x) / 100) AS BIGINT) AS l, CAST(floor(max(x) / 100) AS BIGINT) AS m FROM c), LATERAL (SELECT unnest(range(l, m + 1)) AS gx)) SELECT gy, gx, median(pref_x) AS med_x, median(pref_y) AS med_y FROM g JOIN c ON c.y BETWEEN gy * 100 - 100 AND gy * 100 + 100 AND c.x BETWEEN gx * 100 - 100 AND gx * 100 + 100 AND sqrt((c.y - gy * 100) ** 2 + (c.x - gx * 100) ** 2) <= 100 GROUP BY gy, gx)"


def _grad(v: str, axis: str) -> str:
    w = f"(PARTITION BY {'gx' if axis == 'gy' else 'gy'} ORDER BY {axis})"
    lo, hi = f"lag({v}) OVER {w}", f"lead({v}) OVER {w}"
    return f"CASE WHEN {lo} IS NULL AND {hi} IS NULL THEN 0 WHEN {lo} IS NULL THEN {hi} - {v} WHEN {hi} IS NULL THEN {v} - {lo} ELSE ({hi} - {lo}) / 2 END"


_LOGS = r"""WITH l AS (SELECT user_id, ts, event_id, event_type AS k, strftime(ts, '%H:%M') AS hm, strftime(ts, '%Y-%m-%d') AS dt FROM events WHERE ts IS NOT NULL AND event_type IN ('signup', 'purchase', 'click', 'error')),
r AS (SELECT *, count(*) FILTER (k = 'signup') OVER w AS run, coalesce(last_value(CASE WHEN k = 'click' THEN CAST(event_id AS VARCHAR) END IGNORE NULLS) OVER w, '') AS pfile FROM l WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
g AS (SELECT user_id, run, max(dt) FILTER (k = 'signup') AS date, max(CAST(event_id AS VARCHAR)) FILTER (k = 'signup') AS num, max(pfile) FILTER (k = 'signup') AS pfile, max(hm) FILTER (k = 'signup') AS s, arg_max(hm, (ts, event_id)) FILTER (k = 'purchase') AS e, count(*) FILTER (k = 'error') AS n_log FROM r WHERE run > 0 GROUP BY user_id, run),
h AS (SELECT *, lead(run) OVER (PARTITION BY user_id ORDER BY run) AS later FROM g)
SELECT user_id, count(e) OVER (PARTITION BY user_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS overall_id, date, num, pfile, s AS "start", coalesce(e, '-1') AS "end",
  CAST(coalesce(CAST(e[1:2] AS INTEGER) * 3600 + CAST(e[4:5] AS INTEGER) * 60 - CAST(s[1:2] AS INTEGER) * 3600 - CAST(s[4:5] AS INTEGER) * 60, -1) AS BIGINT) AS dur, CAST(n_log AS INTEGER) AS n_log FROM h WHERE e IS NOT NULL OR later IS NULL"""

_KERNELS = {
    "trailing_mean": (S.trailing(3), "zero"),
    "causal_ma": (S.causal(3), "nearest"),
    "centred_ma": (S.centred(5), "reflect"),
    "gaussian_1d": (S.gaussian(1.0), "reflect"),
    "decay_convolution": (S.decay(1.8, 1e-6), "zero"),
    "iir_lowpass": (S.lowpass(2.0, 10.0), "zero"),
}
QUERIES = {n: _smooth(k, edge=e) for n, (k, e) in _KERNELS.items()} | {
    "rolling_full": _smooth(S.rolling(4), full=True),
    "hann_2d": hann_2d,
    "cdf_match": cdf_match,
    "polar_features": polar_features,
    "phase_unwrap_diff": phase_unwrap_diff,
    "gap_fill": gap_fill,
    "binned_mean_2d": binned_mean_2d,
    "tuning_volume_3d": tuning_volume_3d,
    "sta_lags": sta_lags,
    "stc_lags": stc_lags,
    "circular_variance": circular_variance,
    "rf_marginals": rf_marginals,
    "parafac_rank1": parafac_rank1,
    "selected_cells": selected_cells,
    "neuropil": neuropil,
    "lead_zero_fill": lead_zero_fill,
    "split_sets": split_sets,
    "radius_median": radius_median,
    "preference_map": preference_map,
    "sign_map": sign_map,
    "unwrap_strips": unwrap_strips,
    "log_sessions": log_sessions,
    "sequence_invert": sequence_invert,
    "stim_matrix_first_n": stim_matrix_first_n,
    "stim_contrast_mean": stim_contrast_mean,
    "param_sweep": param_sweep,
    "signed_angle": signed_angle,
    "event_numbers": event_numbers,
    "relu_sigmoid_predict": relu_sigmoid_predict,
}
SQL = {n: _kernel_sql(k, e) for n, (k, e) in _KERNELS.items()} | {
    "rolling_full": f"WITH n AS ({_N}) SELECT neuron, i + o AS i, round(sum(value / 4), 6) AS smooth FROM n, (SELECT unnest(range(4)) AS o) GROUP BY neuron, i + o",
    "hann_2d": f"WITH g AS ({_GRID}), h AS (SELECT o, 0.5 - 0.5 * cos(2 * pi() * (o + 2) / 4) AS w FROM (SELECT unnest(range(-2, 3)) AS o)), k AS (SELECT a.o AS a, b.o AS b, a.w * b.w / (SELECT sum(x.w * y.w) FROM h x, h y) AS w FROM h a, h b) SELECT g.expt, g.bc AS by, g.bs AS bx, round(sum(s.mean * k.w), 6) AS smooth FROM g, k JOIN g s ON s.expt = g.expt AND s.bc = g.bc + k.a AND s.bs = g.bs + k.b WHERE k.w > 0 GROUP BY ALL",
    "cdf_match": f"""WITH a AS ({_DIST.format(c="rotary_encoder")}), b AS ({_DIST.format(c="piezo")}), l AS (SELECT a.value, a.n, a.q, b.q AS q0, b.value AS v0 FROM a ASOF LEFT JOIN b ON a.q >= b.q)
        SELECT l.value, l.n, round(CASE WHEN q0 IS NULL THEN b.value WHEN b.q IS NULL OR b.q = q0 THEN v0 ELSE v0 + (b.value - v0) * (l.q - q0) / (b.q - q0) END, 6) AS matched FROM l ASOF LEFT JOIN b ON l.q <= b.q""",
    "polar_features": f"SELECT expt, i, round(rho, 6) AS rho, round(phi, 6) AS phi FROM ({_A})",
    "phase_unwrap_diff": f"SELECT expt, i, round(CASE WHEN abs(dphi) < 3 THEN dphi END, 6) AS dphi FROM ({_A})",
    "gap_fill": f"""WITH a AS (SELECT expt, i, CASE WHEN abs(dphi) < 3 THEN dphi END AS d FROM ({_A})), k AS (SELECT * FROM a WHERE d IS NOT NULL), l AS (SELECT a.expt, a.i, k.i AS i0, k.d AS d0 FROM a ASOF LEFT JOIN k ON a.expt = k.expt AND a.i >= k.i)
        SELECT l.expt, l.i, round(CASE WHEN i0 IS NULL THEN k.d WHEN k.i IS NULL OR k.i = i0 THEN d0 ELSE d0 + (k.d - d0) * (l.i - i0) / (k.i - i0) END, 6) AS dphi FROM l ASOF LEFT JOIN k ON l.expt = k.expt AND l.i <= k.i""",
    "binned_mean_2d": f"SELECT expt, bc, bs, round(mean, 6) AS mean, n FROM ({_GRID})",
    "tuning_volume_3d": f"""WITH a AS (SELECT *, i // 64 % 2 AS trial, greatest(least(dphi, pi()), -pi()) AS dp FROM ({_A})), t AS (SELECT expt, max(rho) AS r, max(phi) AS f, count(DISTINCT trial) AS k FROM a GROUP BY expt)
        SELECT expt, CAST(least(floor(rho / r * 8), 7) AS INTEGER) AS b_rho, CAST(least(floor(phi / f * 8), 7) AS INTEGER) AS b_phi, CAST(least(floor((dp + 4) / 8 * 8), 7) AS INTEGER) AS b_dphi, round(sum(w) / any_value(k), 6) AS weighted, round(count(*) / any_value(k), 6) AS count, round(sum(w) / count(*), 6) AS mean FROM a JOIN t USING (expt) GROUP BY 1, 2, 3, 4""",
    "sta_lags": " UNION ALL ".join(f"SELECT expt, {k} AS lag, round(sum(z * s{k}) / nullif(sum(z), 0), 6) AS sta FROM {_LAGS} WHERE i >= 5 GROUP BY expt" for k in range(5)),
    "stc_lags": " UNION ALL ".join(f"SELECT expt, {a} AS lag_a, {b} AS lag_b, round(sum(z * s{a} * c{b}) / nullif(sum(z), 0) - sum(z * s{a}) / nullif(sum(z), 0) * sum(z * c{b}) / nullif(sum(z), 0), 5) AS stc FROM {_LAGS} WHERE i >= 3 GROUP BY expt" for a in range(3) for b in range(3)),
    "circular_variance": f"SELECT neuron, round(cos(atan2(im, re)), 5) AS preferred_cos, round(1 - sqrt(re * re + im * im), 6) AS variance FROM (SELECT neuron, sum(r * cos(radians(i % 8 * 45.0))) / nullif(sum(r), 0) AS re, sum(r * sin(radians(i % 8 * 45.0))) / nullif(sum(r), 0) AS im FROM {_E1} GROUP BY neuron)",
    "selected_cells": f"SELECT n.neuron, expt, plane, py, px, round(p.peak, 6) AS peak FROM (SELECT DISTINCT neuron, expt, plane, py, px FROM neurons WHERE iscell AND plane <> 0) n JOIN (SELECT neuron, max(r) AS peak FROM {_E1} GROUP BY neuron) p ON n.neuron = p.neuron WHERE p.peak > 0.2",
    "neuropil": f"""WITH w AS (SELECT neuron, coalesce(bool_or(iscell), false) AS iscell FROM neurons WHERE neuron IS NOT NULL GROUP BY neuron), t AS (SELECT DISTINCT row_id, neuron, expt, plane, v, floor(t) AS second, iscell FROM trace JOIN w USING (neuron) WHERE t IS NOT NULL AND NOT isnan(t) AND v IS NOT NULL AND NOT isnan(v) AND {span_sql("v", "'cell_trace'")}),
        s AS (SELECT expt, plane, second, avg(v) AS surround FROM t GROUP BY ALL) SELECT neuron, row_id, round(v - 0.7 * surround + 1e-9, 5) AS v FROM t JOIN s USING (expt, plane, second) WHERE iscell""",
    "lead_zero_fill": f"SELECT neuron, i, coalesce(lead(value, 5) OVER (PARTITION BY neuron ORDER BY i), 0) AS moved FROM ({_N})",
    "split_sets": "SELECT neuron, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.7 + 0.2 THEN 'test' ELSE 'check' END AS part FROM (SELECT neuron, CAST(('0x' || substr(md5('3:' || neuron), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM (SELECT DISTINCT neuron FROM neurons WHERE neuron IS NOT NULL))",
    "radius_median": f"WITH c AS {_CELLS} SELECT a.id, CAST(trunc(median(b.pref_x)) AS INTEGER) AS smooth_x, CAST(trunc(median(b.pref_y)) AS INTEGER) AS smooth_y FROM c a JOIN c b ON b.y BETWEEN a.y - 30 AND a.y + 30 AND b.x BETWEEN a.x - 30 AND a.x + 30 AND sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2) <= 30 GROUP BY a.id",
    "preference_map": f"SELECT gy, gx, CAST(med_x AS DOUBLE) AS med_x, CAST(med_y AS DOUBLE) AS med_y FROM {_PREF}",
    "sign_map": f"SELECT gy, gx, round(sin(atan2(xx, xy) - atan2(yx, yy)), 6) AS sign FROM (SELECT gy, gx, {_grad('med_x', 'gx')} AS xx, {_grad('med_x', 'gy')} AS xy, {_grad('med_y', 'gx')} AS yx, {_grad('med_y', 'gy')} AS yy FROM {_PREF})",
    "unwrap_strips": f"WITH c AS {_CELLS}, m AS (SELECT ceil(max(y) / 3) AS ly, ceil(max(x)) AS lx FROM c) SELECT id, round((y - k * ly) * 1.3671, 6) AS uy, round((x + k * lx) * 1.3671, 6) AS ux FROM (SELECT *, CASE WHEN y > ly AND y <= 2 * ly THEN 1 WHEN y > 2 * ly THEN 2 ELSE 0 END AS k FROM c, m)",
    "log_sessions": _LOGS,
    "sequence_invert": "SELECT l_orderkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) - 1 AS INTEGER) AS repeat, l_linenumber AS position FROM lineitem",
    "stim_matrix_first_n": "SELECT l_suppkey, repeat, l_extendedprice FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS INTEGER) AS repeat, count(*) OVER (PARTITION BY l_suppkey) AS k FROM lineitem) WHERE repeat <= 8 AND k >= 8",
    "stim_contrast_mean": "SELECT l_suppkey, l_returnflag, round(avg(l_extendedprice), 4) AS mean, count(l_extendedprice) AS n FROM lineitem WHERE l_linestatus <> 'O' GROUP BY ALL",
    "param_sweep": "SELECT CAST(a * 5 + plane AS INTEGER) AS run, threshold, plane, CAST(count(*) FILTER (floor(v) < threshold) AS BIGINT) AS n FROM (VALUES (0, 500.0::DOUBLE), (1, 1000.0::DOUBLE), (2, 2000.0::DOUBLE)) g(a, threshold), trace WHERE v IS NOT NULL AND NOT isnan(v) AND plane BETWEEN 0 AND 4 GROUP BY ALL",
    "signed_angle": "SELECT vec_id, round(CASE WHEN a[1] * a[4] - a[2] * a[3] < 0 THEN -1 ELSE 1 END * u, 5) AS angle, round(u, 5) AS unsigned FROM (SELECT vec_id, a, degrees(acos(greatest(least((a[1] * a[3] + a[2] * a[4]) / (sqrt(a[1] ** 2 + a[2] ** 2) * sqrt(a[3] ** 2 + a[4] ** 2)), 1), -1))) AS u FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings))",
    "event_numbers": """SELECT event_id, k, CASE k % 5 - 2 WHEN 0 THEN '0' WHEN 1 THEN 'π' WHEN -1 THEN '-π' ELSE (k % 5 - 2) || 'π' END AS label, CAST(trunc(greatest(least(value / top, 1), 0) * 255) AS INTEGER) AS byte, CAST(k AS DOUBLE) AS v0, value AS v1
        FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k, max(abs(value)) OVER (PARTITION BY event_type) AS top FROM events)""",
    "relu_sigmoid_predict": f"SELECT expt, i, round(4 / (1 + exp(-1.2 * (x - 0.3))), 6) AS sigmoid, round(least(greatest(x, 0.1), 10000), 6) AS relu, round(exp(-((x - 0.2) * (x - 0.2)) / (2 * 0.49)) / (0.7 * sqrt(2 * pi())), 6) AS gaussian, round(exp(-abs(x) / 1.8) / 1.8 * 0.5 * (sign(abs(x)) + 1), 6) AS decay FROM (SELECT expt, i, c * 1.5 - s * 0.5 AS x FROM ({_P}))",
}
