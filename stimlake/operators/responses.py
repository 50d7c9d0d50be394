"""Normalising trial responses, and measures over repeated trials.

Responses are one row for each ``neuron, trial, frame`` with its ``value``. Statistics of a group are
aggregated (with map-side partials) and joined back, never windowed over, so that a hot neuron does not end in
one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-9


def with_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Rows with aggregates of their group."""
    return df.join(df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()]), list(keys))


def zscore(df: DataFrame, keys: Sequence[str], value: str = "value", *, eps: float = 1e-5, shift: bool = True, keep_stats: bool = False) -> DataFrame:
    """``z``: the value less its group's mean (unless shift is False), over its population deviation plus eps."""
    s = with_stats(df, keys, z_mean=F.avg(value), z_sd=F.stddev_pop(value))
    z = (F.col(value) - (F.col("z_mean") if shift else F.lit(0.0))) / (F.col("z_sd") + eps)
    s = s.withColumn("z", z)
    return s if keep_stats else s.drop("z_mean", "z_sd")


def undo_zscore(df: DataFrame, *, eps: float = 1e-5) -> DataFrame:
    """``value`` from ``z``, ``z_mean`` and ``z_sd``."""
    return df.withColumn("value", F.col("z") * (F.col("z_sd") + eps) + F.col("z_mean"))


def standardize(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """``scaled``: the group's span mapped to 0..1; a constant group gives 0."""
    s = with_stats(df, keys, lo=F.min(value), hi=F.max(value))
    return s.withColumn("scaled", F.when(F.col("hi") > F.col("lo"), (F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))).drop("lo", "hi")


def rescale(df: DataFrame, keys: Sequence[str], a: float, value: str = "value") -> DataFrame:
    """``scaled``: the group's span mapped to -a..a; a constant group gives 0."""
    s = with_stats(df, keys, lo=F.min(value), hi=F.max(value))
    return s.withColumn("scaled", F.when(F.col("hi") > F.col("lo"), 2 * a * (F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) - a).otherwise(F.lit(0.0))).drop("lo", "hi")


def block_zscore(df: DataFrame, keys: Sequence[str], order: str, window: int, value: str = "value") -> DataFrame:
    """z-score inside non-overlapping windows of ``window`` frames."""
    return zscore(df.withColumn("block", F.floor(F.col(order) / window)), [*keys, "block"], value)


def trial_shift(df: DataFrame) -> DataFrame:
    """z-score of each trial of each neuron, moved so that its least value is 0: ``shifted``."""
    z = zscore(df, ["neuron", "trial"])
    return with_stats(z, ["neuron", "trial"], least=F.min("z")).withColumn("shifted", F.col("z") - F.col("least")).drop("least")


def correlation(x: str, y: str, eps: float = EPS) -> Column:
    """Pearson correlation with eps added to each population deviation, so constant series give 0."""
    return F.covar_pop(x, y) / ((F.stddev_pop(x) + eps) * (F.stddev_pop(y) + eps))


def _trials(df: DataFrame, **sets: tuple[int, ...]) -> DataFrame:
    """Mean over sets of trials at each neuron and frame; only frames that every set has."""
    wide = df.groupBy("neuron", "frame").agg(*[F.avg(F.when(F.col("trial").isin(*s), F.col("value"))).alias(n) for n, s in sets.items()])
    return wide.dropna(subset=list(sets))


def repeatability_pairs(df: DataFrame) -> DataFrame:
    """Mean of the correlations between the trials 0, 1 and 2."""
    w = _trials(df, a=(0,), b=(1,), c=(2,))
    return w.groupBy("neuron").agg(((correlation("a", "b") + correlation("a", "c") + correlation("b", "c")) / 3).alias("repeatability"))


def leave_one_out(df: DataFrame) -> DataFrame:
    """``others``: the mean of the other trials at the same neuron and frame; null where there is none."""
    s = with_stats(df, ["neuron", "frame"], total=F.sum("value"), n=F.count("value"))
    return s.withColumn("others", F.when(F.col("n") > 1, (F.col("total") - F.col("value")) / (F.col("n") - 1))).drop("total", "n")


def repeatability_loo(df: DataFrame) -> DataFrame:
    """Mean over trials of the correlation of a trial with the mean of the others."""
    r = leave_one_out(df).filter("others IS NOT NULL").groupBy("neuron", "trial").agg(correlation("value", "others").alias("r"))
    return r.groupBy("neuron").agg(F.avg("r").alias("repeatability"))


#: Which trials form the two halves, by the number of trials.
HALVES = {2: ((0,), (1,)), 3: ((0, 2), (1,)), 4: ((0, 2), (1, 3)), 5: ((0, 2, 4), (1, 3))}


def repeatability_split(df: DataFrame, n_trials: int) -> DataFrame:
    """Correlation of the means of two halves of the trials; 0 for a number of trials without halves."""
    if n_trials not in HALVES:
        return df.select("neuron").distinct().withColumn("repeatability", F.lit(0.0))
    a, b = HALVES[n_trials]
    return _trials(df, a=a, b=b).groupBy("neuron").agg(correlation("a", "b").alias("repeatability"))


def trial_mean(df: DataFrame) -> DataFrame:
    return df.groupBy("neuron", "frame").agg(F.avg("value").alias("value"))


def skewness(df: DataFrame) -> DataFrame:
    """Population skewness of each neuron's mean response; null for a constant one."""
    return trial_mean(df).groupBy("neuron").agg(F.skewness("value").alias("skewness"))


def quality(df: DataFrame, n_trials: int, least_repeatability: float = 0.2, most_skewness: float = 20.0) -> DataFrame:
    """Neurons that repeat well enough and are not too skewed."""
    both = repeatability_split(df, n_trials).join(skewness(df), "neuron")
    return both.filter((F.col("repeatability") >= least_repeatability) & (F.col("skewness") <= most_skewness))


def signal_variance(df: DataFrame, a: tuple[int, ...], b: tuple[int, ...]) -> DataFrame:
    """Share of the variance that two halves of trials have in common, and its ratio to the rest."""
    w = _trials(df, a=a, b=b).groupBy("neuron").agg(F.covar_pop("a", "b").alias("c"), ((F.var_pop("a") + F.var_pop("b")) / 2).alias("v"))
    f = F.try_divide("c", "v")
    return w.select("neuron", f.alias("fraction"), F.try_divide(f, 1 - f).alias("ratio"))


def signal_to_noise(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean over population deviation, 0 where it is 0."""
    return df.groupBy(*keys).agg(F.coalesce(F.try_divide(F.avg("value"), F.stddev_pop("value")), F.lit(0.0)).alias("snr"))


def prediction_metrics(df: DataFrame, prediction: DataFrame) -> DataFrame:
    """How well a prediction (neuron, frame, pred) explains trials.

    ``feve`` = 1 - (mse - s2) / (var - s2) with s the mean over frames of the variance over trials, ``ev`` the
    explained variance of the trial mean, ``cc`` its correlation with the prediction.
    """
    f = df.groupBy("neuron", "frame").agg(F.avg("value").alias("m"), F.var_pop("value").alias("within"), F.count("*").alias("k"), F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("ss"))
    g = f.join(prediction, ["neuron", "frame"]).withColumn("err", F.col("pred") - F.col("m")).groupBy("neuron").agg(
        F.avg(F.col("err") ** 2).alias("mse"), F.avg("within").alias("sig"), F.sum("k").alias("k"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.var_pop("err").alias("verr"), F.var_pop("m").alias("vm"), F.covar_pop("m", "pred").alias("cov"), F.stddev_pop("m").alias("sm"), F.stddev_pop("pred").alias("sp"),
    )
    var = F.col("ss") / F.col("k") - (F.col("s") / F.col("k")) ** 2
    s2 = F.col("sig") ** 2
    return g.select("neuron", (1 - F.try_divide(F.col("mse") - s2, var - s2)).alias("feve"), (1 - F.try_divide("verr", "vm")).alias("ev"), F.try_divide(F.col("cov"), F.col("sm") * F.col("sp")).alias("cc"))


def residual(df: DataFrame, trials: tuple[int, ...] = (0, 2, 4)) -> DataFrame:
    """``residual``: the value less the mean of some trials at the same neuron and frame."""
    s = with_stats(df, ["neuron", "frame"], base=F.avg(F.when(F.col("trial").isin(*trials), F.col("value"))))
    return s.withColumn("residual", F.col("value") - F.col("base")).drop("base")


def bin_trials(df: DataFrame, n: int) -> DataFrame:
    """Mean of each n consecutive trials; trials of an incomplete last bin are dropped."""
    g = df.groupBy("neuron", F.floor(F.col("trial") / n).alias("bin"), "frame").agg(F.avg("value").alias("value"), F.count("*").alias("k"))
    return g.filter(F.col("k") == n).drop("k")


def missed(df: DataFrame, prediction: DataFrame, most_predicted: float, least_response: float) -> DataFrame:
    """Frames in which a neuron responds although little was predicted."""
    return df.join(prediction, ["neuron", "frame"]).filter((F.col("pred") < most_predicted) & (F.col("value") >= least_response))

