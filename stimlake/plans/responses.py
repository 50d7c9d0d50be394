"""Queries over trial responses; the response tensor is made of all trace readings.

The scan slots of a neuron count as interleaved trials: slot k is frame k div 4 of trial k mod 4, its value the
mean of the readings in it that the hardware can produce.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stimlake.operators import responses as R
from stimlake.plans.alignment import span_sql, traces
from stimlake.tables import maybe_broadcast, table

N_TRIALS = 4


def spikes(s: SparkSession, d: str) -> DataFrame:
    period = table(s, d, "recordings").select("expt", "scan_period").dropDuplicates(["expt"])
    n = table(s, d, "neurons").filter("n_scans IS NOT NULL AND t0 IS NOT NULL").dropDuplicates(["neuron"]).join(maybe_broadcast(period), "expt").select("neuron", "t0", "scan_period")
    t = traces(s, d).select("neuron", "t", "v").join(n, "neuron")
    k = F.floor((F.col("t") - F.col("t0")) / F.col("scan_period"))
    t = t.withColumn("k", k).filter("k >= 0")
    return t.groupBy("neuron", F.pmod("k", F.lit(N_TRIALS)).cast("int").alias("trial"), F.floor(F.col("k") / N_TRIALS).alias("frame")).agg(F.avg("v").alias("value"))


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


def prediction(sp: DataFrame) -> DataFrame:
    return sp.filter("trial IN (0, 2)").groupBy("neuron", "frame").agg(F.avg("value").alias("pred"))


def q_trial_zscore_shift(s, d):
    return rounded(R.trial_shift(spikes(s, d)).select("neuron", "trial", "frame", "shifted"), "shifted")


def q_zscore_undo(s, d):
    z = R.undo_zscore(R.zscore(spikes(s, d), ["neuron"], keep_stats=True))
    return z.groupBy("neuron").agg(F.round(F.min("z"), 6).alias("min_z"), F.round(F.max("value"), 7).alias("most"), F.round(F.max("z"), 6).alias("max_z"))


def q_stats(col: str, f):
    return lambda s, d: rounded(f(spikes(s, d)).select("neuron", "trial", "frame", col), col)


def q_per_neuron(f, *cols: str):
    return lambda s, d: rounded(f(spikes(s, d)), *cols)


SPIKES = f"""SELECT neuron, CAST(k % 4 AS INTEGER) AS trial, CAST(k // 4 AS BIGINT) AS frame, avg(v) AS value FROM (
  SELECT DISTINCT t.row_id, t.neuron, t.v, CAST(floor((t.t - n.t0) / c.scan_period) AS BIGINT) AS k
  FROM trace t JOIN (SELECT DISTINCT neuron, expt, t0 FROM neurons WHERE n_scans IS NOT NULL AND t0 IS NOT NULL) n ON t.neuron = n.neuron JOIN (SELECT DISTINCT expt, scan_period FROM recordings) c ON n.expt = c.expt
  WHERE t.t IS NOT NULL AND NOT isnan(t.t) AND t.v IS NOT NULL AND NOT isnan(t.v) AND {span_sql('t.v', chr(39) + 'cell_trace' + chr(39))}) WHERE k >= 0 GROUP BY ALL"""
_S = f"WITH s AS ({SPIKES}) "
_R = "covar_pop({0}, {1}) / ((stddev_pop({0}) + 1e-9) * (stddev_pop({1}) + 1e-9))"


def _wide(**sets: str) -> str:
    cols = ", ".join(f"avg(value) FILTER (trial IN ({v})) AS {k}" for k, v in sets.items())
    return f"(SELECT * FROM (SELECT neuron, frame, {cols} FROM s GROUP BY neuron, frame) WHERE {' AND '.join(f'{k} IS NOT NULL' for k in sets)})"


_SPLIT = f"SELECT neuron, {_R.format('a', 'b')} AS repeatability FROM {_wide(a='0, 2', b='1, 3')} GROUP BY neuron"
_SKEW = "SELECT neuron, CASE WHEN var_pop(v) > 0 THEN (avg(v ** 3) - 3 * avg(v) * avg(v ** 2) + 2 * avg(v) ** 3) / var_pop(v) ** 1.5 END AS skewness FROM (SELECT neuron, v - avg(v) OVER (PARTITION BY neuron) AS v FROM (SELECT neuron, frame, avg(value) AS v FROM s GROUP BY ALL)) GROUP BY neuron"

QUERIES = {
    "trial_zscore_shift": q_trial_zscore_shift,
    "zscore_undo": q_zscore_undo,
    "standardize": q_stats("scaled", lambda x: R.standardize(x, ["neuron"])),
    "rescale_pm_a": q_stats("scaled", lambda x: R.rescale(x, ["neuron"], 2.0)),
    "scale_std": q_stats("z", lambda x: R.zscore(x, ["neuron"], eps=1e-6, shift=False)),
    "moving_zscore": q_stats("z", lambda x: R.block_zscore(x, ["neuron", "trial"], "frame", 8)),
    "zscore_by_group": q_stats("z", lambda x: R.zscore(x, ["neuron", "frame"])),
    "leave_one_out": q_stats("others", R.leave_one_out),
    "residual": q_stats("residual", lambda x: R.residual(x, (0, 2))),
    "repeatability_pairs": q_per_neuron(R.repeatability_pairs, "repeatability"),
    "repeatability_loo": q_per_neuron(R.repeatability_loo, "repeatability"),
    "repeatability_split": q_per_neuron(lambda x: R.repeatability_split(x, N_TRIALS), "repeatability"),
    "quality_filter": q_per_neuron(lambda x: R.quality(x, N_TRIALS), "repeatability", "skewness"),
    "signal_variance": q_per_neuron(lambda x: R.signal_variance(x, (0, 2), (1, 3)), "fraction", "ratio"),
    "snr": q_per_neuron(lambda x: R.signal_to_noise(x, ["neuron"]), "snr"),
    "feve_ev_cc": q_per_neuron(lambda x: R.prediction_metrics(x.filter("trial IN (1, 3)"), prediction(x)), "feve", "ev", "cc"),
    "trial_bins": q_per_neuron(lambda x: R.bin_trials(x, 2), "value"),
    "response_spread": lambda s, d: spikes(s, d).groupBy("neuron", "frame").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most")).select("neuron", "frame", "mean", F.round("least", 6).alias("least"), F.round("most", 6).alias("most")),
}
SQL = {
    "trial_zscore_shift": _S + ", z AS (SELECT *, (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-5) AS z FROM s WINDOW w AS (PARTITION BY neuron, trial)) SELECT neuron, trial, frame, round(z - min(z) OVER (PARTITION BY neuron, trial), 6) AS shifted FROM z",
    "zscore_undo": _S + ", z AS (SELECT *, (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-5) AS z FROM s WINDOW w AS (PARTITION BY neuron)) SELECT neuron, round(min(z), 6) AS min_z, round(max(value), 7) AS most, round(max(z), 6) AS max_z FROM z GROUP BY neuron",
    "standardize": _S + "SELECT neuron, trial, frame, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0 END, 6) AS scaled FROM s WINDOW w AS (PARTITION BY neuron)",
    "rescale_pm_a": _S + "SELECT neuron, trial, frame, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN 4 * (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) - 2 ELSE 0 END, 6) AS scaled FROM s WINDOW w AS (PARTITION BY neuron)",
    "scale_std": _S + "SELECT neuron, trial, frame, round(value / (stddev_pop(value) OVER (PARTITION BY neuron) + 1e-6), 6) AS z FROM s",
    "moving_zscore": _S + "SELECT neuron, trial, frame, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-5), 6) AS z FROM s WINDOW w AS (PARTITION BY neuron, trial, frame // 8)",
    "zscore_by_group": _S + "SELECT neuron, trial, frame, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-5), 6) AS z FROM s WINDOW w AS (PARTITION BY neuron, frame)",
    "leave_one_out": _S + "SELECT neuron, trial, frame, round((sum(value) OVER w - value) / nullif(count(*) OVER w - 1, 0), 6) AS others FROM s WINDOW w AS (PARTITION BY neuron, frame)",
    "residual": _S + "SELECT neuron, trial, frame, round(value - avg(value) FILTER (trial IN (0, 2)) OVER (PARTITION BY neuron, frame), 6) AS residual FROM s",
    "repeatability_pairs": _S + f"SELECT neuron, round(({_R.format('a', 'b')} + {_R.format('a', 'c')} + {_R.format('b', 'c')}) / 3, 6) AS repeatability FROM {_wide(a='0', b='1', c='2')} GROUP BY neuron",
    "repeatability_loo": _S + f", o AS (SELECT *, (sum(value) OVER w - value) / nullif(count(*) OVER w - 1, 0) AS others FROM s WINDOW w AS (PARTITION BY neuron, frame)) SELECT neuron, round(avg(r), 6) AS repeatability FROM (SELECT neuron, trial, {_R.format('value', 'others')} AS r FROM o WHERE others IS NOT NULL GROUP BY ALL) GROUP BY neuron",
    "repeatability_split": _S + f"SELECT neuron, round(repeatability, 6) AS repeatability FROM ({_SPLIT})",
    "quality_filter": _S + f"SELECT neuron, round(repeatability, 6) AS repeatability, round(skewness, 6) AS skewness FROM ({_SPLIT}) JOIN ({_SKEW}) USING (neuron) WHERE repeatability >= 0.2 AND skewness <= 20",
    "signal_variance": _S + f"SELECT neuron, round(f, 6) AS fraction, round(f / nullif(1 - f, 0), 6) AS ratio FROM (SELECT neuron, covar_pop(a, b) / nullif((var_pop(a) + var_pop(b)) / 2, 0) AS f FROM {_wide(a='0, 2', b='1, 3')} GROUP BY neuron)",
    "snr": _S + "SELECT neuron, round(coalesce(avg(value) / nullif(stddev_pop(value), 0), 0), 6) AS snr FROM s GROUP BY neuron",
    "feve_ev_cc": _S + """, f AS (SELECT neuron, frame, avg(value) AS m, var_pop(value) AS w, list(value) AS v FROM s WHERE trial IN (1, 3) GROUP BY ALL), p AS (SELECT neuron, frame, avg(value) AS pred FROM s WHERE trial IN (0, 2) GROUP BY ALL),
        j AS (SELECT * FROM f JOIN p USING (neuron, frame)), a AS (SELECT neuron, avg((pred - m) ** 2) AS mse, avg(w) ** 2 AS s2, var_pop(pred - m) AS ve, var_pop(m) AS vm, covar_pop(m, pred) / nullif(stddev_pop(m) * stddev_pop(pred), 0) AS cc FROM j GROUP BY neuron),
        g AS (SELECT neuron, var_pop(x) AS vg FROM (SELECT neuron, unnest(v) AS x FROM j) GROUP BY neuron)
        SELECT neuron, round(1 - (mse - s2) / nullif(vg - s2, 0), 6) AS feve, round(1 - ve / nullif(vm, 0), 6) AS ev, round(cc, 6) AS cc FROM a JOIN g USING (neuron)""",
    "trial_bins": _S + "SELECT neuron, CAST(trial // 2 AS BIGINT) AS bin, frame, round(avg(value), 6) AS value FROM s GROUP BY ALL HAVING count(*) = 2".replace("GROUP BY ALL", "GROUP BY neuron, trial // 2, frame"),
    "response_spread": _S + "SELECT neuron, frame, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most FROM s GROUP BY neuron, frame",
}
