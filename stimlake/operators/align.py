"""Alignment of recordings: edges of signals, trials, samples around events.

Signals are tables of one row a sample; ``key`` names the recording, ``t`` the time, ``id`` the sample. All
operations go by cells of ``width`` seconds (see series), so a long recording is many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stimlake.operators.series import asof, following, numbered, previous

WIDTH = 300.0


def edges(signal: DataFrame, threshold: float, *, kind: str = "both", side: str = "before", key: str = "expt", width: float = WIDTH) -> DataFrame:
    """Samples at which a signal crosses a threshold.

    signal: key, ``t``, ``id``, ``v``. kind: 'both', 'rising' or 'falling'. side: the sample 'before' the
    crossing or the one 'after' it. A sample counts as high if v > threshold; null and NaN v are no samples.
    Result: key, ``id``, ``t``, ``high`` (the state after the crossing).
    """
    s = signal.filter(F.col("v").isNotNull() & ~F.isnan("v")).withColumn("high", F.col("v") > threshold)
    want = {"both": F.lit(True), "rising": F.col("high"), "falling": ~F.col("high")}[kind]
    s = previous(s, [key], ["t", "id"], ["high", "t", "id"], width).filter(F.col("prev_high").isNotNull() & (F.col("prev_high") != F.col("high")) & want)
    return s.select(key, "prev_id", "prev_t", "high").toDF(key, "id", "t", "high") if side == "before" else s.select(key, "id", "t", "high")


def median_filtered(signal: DataFrame, *, key: str = "expt", width: float = WIDTH) -> DataFrame:
    """The signal with each v replaced by the median of it and its two neighbours; beyond the ends lies 0."""
    s = signal.filter(F.col("v").isNotNull() & ~F.isnan("v")).select(key, "id", "t", "v")
    s = following(previous(s, [key], ["t", "id"], ["v"], width), [key], ["t", "id"], ["v"], width)
    three = F.array_sort(F.array(F.coalesce("prev_v", F.lit(0.0)), "v", F.coalesce("next_v", F.lit(0.0))))
    return s.select(key, "id", "t", F.get(three, 1).alias("v"))


def level_middle(signal: DataFrame, *, key: str = "expt") -> DataFrame:
    """key and ``threshold``: the middle between the mean of the values above a signal's mean and of those below.

    One round of two means, enough for a signal of two levels (two_means goes on until nothing changes)."""
    ok = signal.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    both = ok.join(ok.groupBy(key).agg(F.avg("v").alias("m")), key)
    high, low = F.avg(F.when(F.col("v") > F.col("m"), F.col("v"))), F.avg(F.when(F.col("v") <= F.col("m"), F.col("v")))
    return both.groupBy(key).agg(((F.coalesce(high, low) + low) / 2).alias("threshold"))


def photodiode_flips(signal: DataFrame, thresholds: DataFrame, *, key: str = "expt", width: float = WIDTH) -> DataFrame:
    """Samples at which a signal, freed of single outliers, has crossed its recording's threshold: key, id, t, high.

    thresholds: key and ``threshold``, one row a key; recordings without one have no flips.
    """
    s = median_filtered(signal, key=key, width=width).join(thresholds, key).withColumn("v", F.col("v") - F.col("threshold"))
    return edges(s, 0.0, side="after", key=key, width=width)


def align_to_flips(events: DataFrame, flips: DataFrame, edge: str, *, key: str = "expt", width: float = WIDTH) -> DataFrame:
    """Events with the flip that belongs to them, ``flip_t``: the first at or 'after', or the last at or 'before'.

    events: key, ``t`` and any other columns. Null where a recording has no such flip.
    """
    if edge not in ("after", "before"):
        raise ValueError(f"edge is 'after' or 'before', not {edge!r}")
    return asof(events, flips.select(key, "t", F.col("t").alias("flip_t")), [key], "t", ["flip_t"], width, forward=edge == "after")


def counter_rises(counter: DataFrame, *, key: str = "expt", width: float = WIDTH) -> DataFrame:
    """Samples at which a counter has risen: the frame times. The first sample is none."""
    s = counter.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    return previous(s, [key], ["t", "id"], ["v"], width).filter("v > prev_v").select(key, "id", "t", "v")


def demultiplex(ticks: DataFrame, planes: DataFrame, *, key: str = "expt", width: float = WIDTH) -> DataFrame:
    """Give every frame its plane: frames of one recording belong to its planes in turn.

    ticks: key, ``t``, ``id``; planes: key and ``n_planes``. Result: key, id, t, ``plane``, ``scan``.
    """
    n = numbered(ticks, [key], ["t", "id"], width).join(planes.filter("n_planes > 0").dropDuplicates([key]), key)
    return n.select(key, "id", "t", F.pmod("nth", "n_planes").cast("int").alias("plane"), F.floor(F.col("nth") / F.col("n_planes")).alias("scan"))


def trial_windows(flips: DataFrame, per_trial: int, *, key: str = "expt", width: float = WIDTH) -> DataFrame:
    """Cut the flips of each recording into trials of ``per_trial`` flips.

    Trial k is [flip(per_trial k), flip(per_trial (k+1))). Where the upper flip is missing the trial ends at the
    last flip and is kept only if it is not empty. Result: key, ``trial``, ``t_start``, ``t_end``, ``complete``.
    """
    n = numbered(flips, [key], ["t", "id"], width)
    last = n.groupBy(key).agg(F.max("nth").alias("n_last"), F.max("t").alias("t_last"))
    starts = n.filter(F.pmod("nth", F.lit(per_trial)) == 0).select(key, F.floor(F.col("nth") / per_trial).alias("trial"), F.col("t").alias("t_start"))
    ends = starts.select(key, (F.col("trial") - 1).alias("trial"), F.col("t_start").alias("t_end"))
    w = starts.join(ends, [key, "trial"], "left").join(last, key)
    w = w.select(key, "trial", "t_start", F.coalesce("t_end", "t_last").alias("t_end"), F.col("t_end").isNotNull().alias("complete"))
    return w.filter("complete OR t_end > t_start")


def in_windows(samples: DataFrame, windows: DataFrame, *, key: str = "expt", width: float = WIDTH) -> DataFrame:
    """Samples that lie in one of the disjoint windows [t_start, t_end), with the window's ``trial``.

    An as-of join on the windows' starts and a check of the end: linear, where a range join would pair.
    """
    starts = windows.select(key, F.col("t_start").alias("t"), "t_start", "t_end", "trial")
    return asof(samples, starts, [key], "t", ["t_start", "t_end", "trial"], width).filter("t < t_end").drop("t_start", "t_end")


def interpolate_at(samples: DataFrame, events: DataFrame, *, kind: str = "linear", shift: float = 0.0, outside: float | None = 0.0, key: str = "expt", width: float = WIDTH) -> DataFrame:
    """Value of a series at each event, of the samples that bracket it.

    samples: key, t, id, v; events: key, t, id. kind: 'linear' between them, the 'previous', the 'next', or the
    'nearest' of them (of two equally near ones the earlier). Beyond the samples the value is ``outside`` (null if
    None). Result: key, id, t (of the event), ``value``.
    """
    s = samples.filter(F.col("v").isNotNull() & ~F.isnan("v")).select(key, "t", F.col("t").alias("ts"), "v")
    e = events.select(key, "id", (F.col("t") + shift).alias("t"))
    back = asof(e, s, [key], "t", ["ts", "v"], width).withColumnsRenamed({"ts": "t0", "v": "v0"})
    both = asof(back, s, [key], "t", ["ts", "v"], width, forward=True).withColumnsRenamed({"ts": "t1", "v": "v1"})
    got = {
        "linear": F.when(F.col("t1") == F.col("t0"), F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))),
        "previous": F.col("v0"),
        "next": F.col("v1"),
        "nearest": F.when(F.col("t") - F.col("t0") <= F.col("t1") - F.col("t"), F.col("v0")).otherwise(F.col("v1")),
    }
    if kind not in got:
        raise ValueError(f"kind is one of {sorted(got)}, not {kind!r}")
    value = F.when(F.col("t0").isNotNull() & F.col("t1").isNotNull(), got[kind])
    return both.select(key, "id", (F.col("t") - shift).alias("t"), (F.coalesce(value, F.lit(outside)) if outside is not None else value).alias("value"))


def event_windows(samples: DataFrame, events: DataFrame, length: int, max_gap: float, *, key: str = "expt", width: float = WIDTH) -> DataFrame:
    """Mean of the ``length`` samples strictly after each event.

    Events of which the first sample is later than ``max_gap`` seconds, or that have too few samples left, are
    skipped. Result: key, id, ``t_first``, ``mean``. Samples with null or NaN v are no samples.
    """
    s = numbered(samples.filter(F.col("v").isNotNull() & ~F.isnan("v")), [key], ["t", "id"], width).select(key, "t", F.col("t").alias("t_first"), "nth", "v")
    firsts = asof(events.select(key, "id", "t"), s, [key], "t", ["t_first", "nth"], width, forward=True, strict=True).filter(F.col("t_first") - F.col("t") <= max_gap)
    wanted = firsts.withColumn("nth", F.explode(F.sequence(F.col("nth"), F.col("nth") + length - 1)))
    got = wanted.join(s.select(key, "nth", "v"), [key, "nth"]).groupBy(key, "id", "t_first").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    return got.filter(F.col("n") == length).select(key, "id", "t_first", "mean")


def largest_gap(ticks: DataFrame, *, key: str = "expt", width: float = WIDTH) -> DataFrame:
    """The largest pause of each recording: key, ``t_before``, ``gap``; of equal pauses the first."""
    n = following(ticks, [key], ["t", "id"], ["t"], width).withColumn("gap", F.col("next_t") - F.col("t")).filter("gap IS NOT NULL")
    return n.groupBy(key).agg(F.max_by("t", F.struct("gap", -F.col("t"))).alias("t_before"), F.max("gap").alias("gap"))


def drop_crash(ticks: DataFrame, crashes: DataFrame, *, key: str = "expt", width: float = WIDTH) -> DataFrame:
    """Drop the ticks between a crash and the largest pause.

    crashes: key and ``t_crash``; recordings without one keep all ticks.
    """
    pause = largest_gap(ticks, key=key, width=width).select(key, "t_before")
    span = crashes.dropDuplicates([key]).join(pause, key)
    kept = ticks.join(span, key, "left")
    return kept.filter(F.col("t_crash").isNull() | (F.col("t") < F.col("t_crash")) | (F.col("t") > F.col("t_before"))).drop("t_crash", "t_before")
