"""Queries of model fitting; those that iterate have no SQL and are tested against plain NumPy."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stimlake.operators import models as M
from stimlake.operators import responses as R
from stimlake.operators import smoothing as S
from stimlake.operators import tuning as T
from stimlake.plans.alignment import TRACES_SQL, channel, possible, traces
from stimlake.plans.curves import _rf, angles, pairs
from stimlake.plans.responses import SPIKES, prediction, rounded, spikes
from stimlake.tables import cut


def model_fit(s: SparkSession, d: str) -> DataFrame:
    """For each neuron a rectifier from the mean of its even trials to its odd trials."""
    sp = cut(spikes(s, d), "spikes")
    both = sp.filter("trial IN (1, 3)").join(prediction(sp), ["neuron", "frame"])
    mean = both.groupBy("neuron").agg(F.avg("pred").alias("m"), F.stddev_pop("pred").alias("sd"))
    scaled = both.join(mean, "neuron").select("neuron", *[((F.col(c) - F.col("m")) / (F.col("sd") + 1e-5)).alias(c) for c in ("pred", "value")])
    return M.fit_nonlinearity(cut(scaled, "scaled"), "neuron", "pred", "value")


def sigmoid_fit(s: SparkSession, d: str) -> DataFrame:
    """Encoder movement as a sigmoid of the photodiode, for each recording."""
    return M.fit_nonlinearity(pairs(s, d), "expt", "c", "w", "sigmoid")


def gaussian_fit(s: SparkSession, d: str) -> DataFrame:
    """A Gaussian over the orientations of each recorded field."""
    curve = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda o: F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0.0), lambda a, k: a + F.abs(F.coalesce(F.nanvl(F.get("rfs", k * 8 + o).cast("double"), F.lit(0.0)), F.lit(0.0)))))
    return M.fit_gaussian(_rf(s, d).select("neuron", curve.alias("curve")), "neuron", "curve", 8)


def fine_search(s: SparkSession, d: str) -> DataFrame:
    """Search of each recorded field from the noted peak, two places at a time."""
    return M.climb(_rf(s, d), "rfs", (6, 2, 8, 1), "best_params", reach=2)


def kmeans_threshold(s: SparkSession, d: str) -> DataFrame:
    return M.two_means(possible(s, d, channel(s, d, "photodiode"), "photodiode"), "expt", "v")


BINS, LIMIT = 20, math.pi


def _features(s: SparkSession, d: str) -> DataFrame:
    """Angle features of each recording, blocks of 64 samples being trials in turn, with the encoder's response."""
    a = angles(s, d).withColumn("dphi", F.greatest(F.least("dphi", F.lit(LIMIT)), F.lit(-LIMIT)))
    return a.select("expt", "i", "rho", "phi", "dphi", "w", F.pmod(F.floor(F.col("i") / 64), F.lit(4)).cast("int").alias("trial"))


def tuning_curves(s: SparkSession, d: str) -> DataFrame:
    v = T.tuning_volume(_features(s, d).filter("trial IN (0, 2)"), ["expt"], "trial", LIMIT, BINS)
    return T.tuning_curves(v, "expt", BINS, LIMIT)


def simple_model(s: SparkSession, d: str) -> DataFrame:
    """The simple model from end to end: tuning volume of the training trials, curves, prediction, nonlinearity on
    it, and how well it does on the other trials (explained variance and correlation)."""
    f = cut(_features(s, d), "features")
    train = f.filter("trial IN (0, 2)")
    curves = cut(T.tuning_curves(T.tuning_volume(train, ["expt"], "trial", LIMIT, BINS), "expt", BINS, LIMIT), "curves")
    tops = train.groupBy("expt").agg(F.max("rho").alias("rho_hi"), F.max("phi").alias("phi_hi"))
    p = cut(T.predict_from_curves(f, curves, tops, ["expt"], BINS, LIMIT), "pred")
    fit = M.fit_nonlinearity(p.filter("trial IN (0, 2)"), "expt", "pred", "w").select("expt", "params", "r2")
    relu = F.least(F.greatest(F.get("params", 1) * F.col("pred"), F.get("params", 0)), F.lit(10_000.0))
    test = p.filter("trial IN (1, 3)").join(fit, "expt").withColumn("fit", relu)
    score = test.groupBy("expt").agg((1 - F.try_divide(F.var_pop(F.col("fit") - F.col("w")), F.var_pop("w"))).alias("ev"), F.try_divide(F.covar_pop("fit", "w"), F.stddev_pop("fit") * F.stddev_pop("w")).alias("cc"), F.count("*").alias("n_test"))
    return score.join(fit, "expt").join(curves.select("expt", "drift", "half_rho", "complexity"), "expt")


def lowess(s: SparkSession, d: str) -> DataFrame:
    return rounded(S.lowess(traces(s, d).select("neuron", "t", "v"), "neuron", "t", "v"), "x", "smooth", places=8).withColumn("smooth", F.round("smooth", 3)).drop("weight")


def missed_responses(s: SparkSession, d: str) -> DataFrame:
    """Where the odd trials lie far above the even trials' mean."""
    sp = spikes(s, d)
    level = sp.groupBy("neuron").agg(F.avg("value").alias("m"))
    scaled = sp.join(level, "neuron").select("neuron", "trial", "frame", (F.col("value") / F.col("m")).alias("value"))
    return R.missed(scaled.filter("trial IN (1, 3)"), prediction(scaled), 1.1, 1.3).select("neuron", "trial", "frame", F.round("value", 5).alias("value"), F.round("pred", 5).alias("pred"))


QUERIES = {"tuning_curves": tuning_curves, "simple_model": simple_model, "lowess": lowess, "missed_responses": missed_responses, "model_fit": model_fit, "sigmoid_fit": sigmoid_fit, "gaussian_fit": gaussian_fit, "fine_search": fine_search, "kmeans_threshold": kmeans_threshold}
_TR = TRACES_SQL
SQL = {
    "lowess": f"""WITH r AS ({_TR}), s AS (SELECT neuron, min(t) AS lo, max(t) AS hi FROM r GROUP BY neuron HAVING max(t) > min(t)),
        g AS (SELECT *, lo + (hi - lo) * point / 100 AS x FROM s, (SELECT CAST(unnest(range(101)) AS INTEGER) AS point)),
        w AS (SELECT g.neuron, point, x, d, v, (1 - abs(d) ** 3) ** 3 AS w FROM (SELECT g.*, r.v, ((r.t - g.lo) / (g.hi - g.lo) - point / 100.0::DOUBLE) * 3 AS d FROM g JOIN r USING (neuron)) g WHERE abs(d) < 1),
        m AS (SELECT neuron, point, any_value(x) AS x, sum(w) AS m0, sum(w * d) AS m1, sum(w * d * d) AS m2, sum(w * v) AS m3, sum(w * d * v) AS m4 FROM w WHERE w > 0 GROUP BY neuron, point)
        SELECT neuron, point, round(x, 8) AS x, round(CASE WHEN m0 * m2 - m1 * m1 > 1e-9 * m0 * m0 THEN (m2 * m3 - m1 * m4) / (m0 * m2 - m1 * m1) ELSE m3 / m0 END, 3) AS smooth FROM m""",
    "missed_responses": f"WITH s AS ({SPIKES}), z AS (SELECT neuron, trial, frame, value / avg(value) OVER (PARTITION BY neuron) AS value FROM s), p AS (SELECT neuron, frame, avg(value) AS pred FROM z WHERE trial IN (0, 2) GROUP BY ALL) SELECT neuron, trial, frame, round(value, 5) AS value, round(pred, 5) AS pred FROM z JOIN p USING (neuron, frame) WHERE trial IN (1, 3) AND pred < 1.1 AND value >= 1.3",
}
