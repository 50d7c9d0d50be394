"""Queries of the alignment family over timeline, frame_times and sync_flips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stimlake.operators import align
from stimlake.operators.series import asof
from stimlake.tables import cut, maybe_broadcast, table, usable

ECHO_THRESHOLD, FLIPS_PER_TRIAL = 1.0, 64


def channel(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Samples of one channel, each row once."""
    rows = table(spark, sf_dir, "timeline").filter(F.lower(F.trim("channel")) == name).filter(usable("t"))
    return rows.select("expt", F.col("row_id").alias("id"), "t", "v").dropDuplicates(["id"])


def possible(spark: SparkSession, sf_dir: str, rows: DataFrame, name: str | None = None) -> DataFrame:
    """Readings that their channel's hardware can produce: those of one channel, or of the column ``c``."""
    span = table(spark, sf_dir, "channels").select(F.lower(F.trim("channel")).alias("c"), "v_min", "v_max").dropDuplicates(["c"])
    both = (rows if name is None else rows.withColumn("c", F.lit(name))).join(maybe_broadcast(span), "c")
    both = both.filter((F.col("v_min").isNull() | (F.col("v") >= F.col("v_min"))) & (F.col("v_max").isNull() | (F.col("v") <= F.col("v_max"))))
    return both.drop("v_min", "v_max", *([] if name is None else ["c"]))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable readings of the traces that the hardware can produce, each once."""
    rows = table(spark, sf_dir, "trace").filter(usable("t") & usable("v"))
    return possible(spark, sf_dir, rows, "cell_trace").dropDuplicates(["row_id"])


#: SQL for the span of a channel, or of the column c.
def span_sql(v: str, channel: str) -> str:
    return f"EXISTS (SELECT 1 FROM channels h WHERE lower(trim(h.channel)) = {channel} AND {v} BETWEEN h.v_min AND h.v_max)"


TRACES_SQL = f"SELECT DISTINCT row_id, neuron, t, v FROM trace WHERE t IS NOT NULL AND NOT isnan(t) AND v IS NOT NULL AND NOT isnan(v) AND {span_sql('v', chr(39) + 'cell_trace' + chr(39))}"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "frame_times").filter(usable("t")).select("expt", F.col("tick_id").alias("id"), "t").dropDuplicates(["id"])


def flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sync_flips").filter(usable("t")).filter("expt IS NOT NULL").select(F.col("expt").cast("long"), F.col("flip_id").alias("id"), "t").dropDuplicates(["id"])


def _echo(kind: str, side: str):
    return lambda s, d: align.edges(channel(s, d, "syncecho"), ECHO_THRESHOLD, kind=kind, side=side)


def frame_rises(s: SparkSession, d: str) -> DataFrame:
    return align.counter_rises(channel(s, d, "neuralframes"))


def trial_windows(s: SparkSession, d: str) -> DataFrame:
    return align.trial_windows(flips(s, d), FLIPS_PER_TRIAL)


def trial_samples(s: SparkSession, d: str) -> DataFrame:
    """Encoder movement of each trial."""
    moved = possible(s, d, channel(s, d, "rotary_encoder").filter(usable("v")), "rotary_encoder")
    return align.in_windows(moved, trial_windows(s, d)).groupBy("expt", "trial").agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("moved"))


def asof_backward(s: SparkSession, d: str) -> DataFrame:
    return asof(flips(s, d), ticks(s, d).select("expt", "t", F.col("t").alias("tick_t")), ["expt"], "t", ["tick_t"], align.WIDTH)


def asof_forward(s: SparkSession, d: str) -> DataFrame:
    return asof(flips(s, d), ticks(s, d).select("expt", "t", F.col("t").alias("tick_t")), ["expt"], "t", ["tick_t"], align.WIDTH, forward=True)


def asof_strict(s: SparkSession, d: str) -> DataFrame:
    return asof(flips(s, d), ticks(s, d).select("expt", "t", F.col("t").alias("tick_t")), ["expt"], "t", ["tick_t"], align.WIDTH, forward=True, strict=True)


def flips_between(s: SparkSession, d: str) -> DataFrame:
    """Edges of the echo channel in each trial."""
    e = align.edges(channel(s, d, "syncecho"), ECHO_THRESHOLD)
    return align.in_windows(e, trial_windows(s, d)).groupBy("expt", "trial").agg(F.count("*").alias("n_edges"), F.min("t").alias("t_first"), F.max("t").alias("t_last"))


def interp_at_events(s: SparkSession, d: str) -> DataFrame:
    got = align.interpolate_at(_distinct_times(channel(s, d, "piezo")), flips(s, d))
    return got.select("expt", "id", "t", F.round("value", 6).alias("value"))


def interp_nearest(s: SparkSession, d: str) -> DataFrame:
    return align.interpolate_at(_distinct_times(channel(s, d, "piezo")), flips(s, d), kind="nearest", outside=None)


def _photodiode(s: SparkSession, d: str) -> DataFrame:
    return possible(s, d, channel(s, d, "photodiode"), "photodiode")


def photodiode_flips(s: SparkSession, d: str) -> DataFrame:
    """Flips of the photodiode, freed of single outliers, across the middle between its levels."""
    signal = _photodiode(s, d)
    return align.photodiode_flips(signal, align.level_middle(align.median_filtered(signal)))


def stimulus_times(s: SparkSession, d: str) -> DataFrame:
    """Onset and offset of each trial by the photodiode: the first flip from its start and the last up to its end."""
    f = cut(photodiode_flips(s, d), "flips")
    w = trial_windows(s, d)
    on = align.align_to_flips(w.select("expt", "trial", F.col("t_start").alias("t"), "t_end"), f, "after")
    off = align.align_to_flips(on.select("expt", "trial", F.col("t_end").alias("t"), F.col("flip_t").alias("onset")), f, "before")
    return off.select("expt", "trial", "onset", F.col("flip_t").alias("offset"))


def _distinct_times(rows: DataFrame) -> DataFrame:
    return rows.filter(usable("v")).groupBy("expt", "t").agg(F.min("id").alias("id"), F.min_by("v", "id").alias("v"))


def event_windows(s: SparkSession, d: str) -> DataFrame:
    got = align.event_windows(channel(s, d, "rotary_encoder"), flips(s, d), 3, 0.1)
    return got.select("expt", "id", "t_first", F.round("mean", 6).alias("mean"))


def plane_demux(s: SparkSession, d: str) -> DataFrame:
    return align.demultiplex(ticks(s, d), table(s, d, "recordings").select("expt", "n_planes"))


def crash_gap_drop(s: SparkSession, d: str) -> DataFrame:
    """Ticks left when those between a recording's 100th second and its largest pause are dropped."""
    t = ticks(s, d)
    crash = t.groupBy("expt").agg((F.min("t") + 100).alias("t_crash"))
    return align.drop_crash(t, crash).groupBy("expt").agg(F.count("*").alias("n"), F.round(F.sum("t"), 3).alias("sum_t"))


def channel_matrix(s: SparkSession, d: str, whole: bool = True) -> DataFrame:
    """Selected channels side by side, one row for each sample time; unless ``whole``, of possible readings only."""
    names = ["photodiode", "piezo", "rotary_encoder"]
    rows = table(s, d, "timeline").filter(usable("t") & usable("v")).withColumn("c", F.lower(F.trim("channel")))
    rows = rows if whole else possible(s, d, rows)
    return rows.groupBy("expt", "t").agg(*[F.max(F.when(F.col("c") == n, F.col("v"))).alias(n) for n in names])


def input_names(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "timeline").groupBy("expt", F.lower(F.trim("channel")).alias("channel")).agg(F.count_distinct("row_id").alias("n_samples"))


_CH = "SELECT DISTINCT expt, row_id AS id, t, v FROM timeline WHERE lower(trim(channel)) = '{}' AND t IS NOT NULL AND NOT isnan(t)"
_OK = "v IS NOT NULL AND NOT isnan(v)"
_FLIPS = "SELECT DISTINCT CAST(expt AS BIGINT) AS expt, flip_id AS id, t FROM sync_flips WHERE t IS NOT NULL AND NOT isnan(t) AND expt IS NOT NULL"
_TICKS = "SELECT DISTINCT expt, tick_id AS id, t FROM frame_times WHERE t IS NOT NULL AND NOT isnan(t)"
_EDGE = f"""SELECT *, lag(high) OVER w AS was, lag(id) OVER w AS id0, lag(t) OVER w AS t0 FROM (SELECT *, v > {ECHO_THRESHOLD} AS high FROM ({_CH.format("syncecho")}) WHERE {_OK})
WINDOW w AS (PARTITION BY expt ORDER BY t, id)"""
_TRIALS = f"""SELECT expt, trial, t_start, coalesce(t_end, t_last) AS t_end, t_end IS NOT NULL AS complete FROM (
  SELECT expt, CAST(n // {FLIPS_PER_TRIAL} AS BIGINT) AS trial, t AS t_start, lead(t, {FLIPS_PER_TRIAL}) OVER w AS t_end, last_value(t) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS t_last, n
  FROM (SELECT *, row_number() OVER (PARTITION BY expt ORDER BY t, id) - 1 AS n FROM ({_FLIPS})) WINDOW w AS (PARTITION BY expt ORDER BY t, id))
WHERE n % {FLIPS_PER_TRIAL} = 0 AND (t_end IS NOT NULL OR t_last > t_start)"""
_ASOF = f"SELECT f.expt, f.id, f.t, k.t AS tick_t FROM ({_FLIPS}) f ASOF LEFT JOIN ({_TICKS}) k ON f.expt = k.expt AND "
_PIEZO = f"SELECT expt, t, arg_min(v, id) AS v FROM ({_CH.format('piezo')}) WHERE {_OK} GROUP BY expt, t"

_DIODE = f"SELECT expt, id, t, v FROM ({_CH.format('photodiode')}) WHERE {_OK} AND {span_sql('v', chr(39) + 'photodiode' + chr(39))}"
_FLIPPED = f"""m AS (SELECT expt, id, t, list_sort([coalesce(lag(v) OVER w, 0), v, coalesce(lead(v) OVER w, 0)])[2] AS v FROM ({_DIODE}) WINDOW w AS (PARTITION BY expt ORDER BY t, id)),
  a AS (SELECT *, avg(v) OVER (PARTITION BY expt) AS mean FROM m), h AS (SELECT expt, (coalesce(avg(v) FILTER (v > mean), avg(v) FILTER (v <= mean)) + avg(v) FILTER (v <= mean)) / 2 AS threshold FROM a GROUP BY expt),
  f AS (SELECT expt, id, t, high FROM (SELECT expt, id, t, v > threshold AS high, lag(v > threshold) OVER (PARTITION BY expt ORDER BY t, id) AS was FROM m JOIN h USING (expt)) WHERE was <> high)"""

QUERIES = {
    "interp_nearest": interp_nearest,
    "photodiode_flips": photodiode_flips,
    "stimulus_times": stimulus_times,
    "sync_flips_before": _echo("both", "before"),
    "sync_flips_after": _echo("both", "after"),
    "sync_flips_falling": _echo("falling", "before"),
    "frame_rises": frame_rises,
    "trial_windows": trial_windows,
    "trial_samples": trial_samples,
    "asof_backward": asof_backward,
    "asof_forward": asof_forward,
    "asof_strict": asof_strict,
    "flips_between": flips_between,
    "interp_at_events": interp_at_events,
    "event_windows": event_windows,
    "plane_demux": plane_demux,
    "crash_gap_drop": crash_gap_drop,
    "channel_matrix": channel_matrix,
    "input_names": input_names,
}
SQL = {
    "interp_nearest": f"""SELECT a.expt, a.id, a.t, CASE WHEN t0 IS NULL OR b.t IS NULL THEN NULL WHEN a.t - t0 <= b.t - a.t THEN v0 ELSE b.v END AS value
        FROM (SELECT f.expt, f.id, f.t, p.t AS t0, p.v AS v0 FROM ({_FLIPS}) f ASOF LEFT JOIN ({_PIEZO}) p ON f.expt = p.expt AND f.t >= p.t) a ASOF LEFT JOIN ({_PIEZO}) b ON a.expt = b.expt AND a.t <= b.t""",
    "photodiode_flips": f"WITH {_FLIPPED} SELECT expt, id, t, high FROM f",
    "stimulus_times": f"WITH {_FLIPPED}, o AS (SELECT w.expt, trial, t_end, f.t AS onset FROM ({_TRIALS}) w ASOF LEFT JOIN f ON w.expt = f.expt AND w.t_start <= f.t) SELECT o.expt, trial, onset, f.t AS \"offset\" FROM o ASOF LEFT JOIN f ON o.expt = f.expt AND o.t_end >= f.t",
    "sync_flips_before": f"SELECT expt, id0 AS id, t0 AS t, high FROM ({_EDGE}) WHERE was <> high",
    "sync_flips_after": f"SELECT expt, id, t, high FROM ({_EDGE}) WHERE was <> high",
    "sync_flips_falling": f"SELECT expt, id0 AS id, t0 AS t, high FROM ({_EDGE}) WHERE was AND NOT high",
    "frame_rises": f"SELECT expt, id, t, v FROM (SELECT *, lag(v) OVER (PARTITION BY expt ORDER BY t, id) AS was FROM ({_CH.format('neuralframes')}) WHERE {_OK}) WHERE v > was",
    "trial_windows": _TRIALS,
    "trial_samples": f"SELECT s.expt, trial, count(*) AS n, round(sum(v), 6) AS moved FROM ({_CH.format('rotary_encoder')}) s JOIN ({_TRIALS}) w ON s.expt = w.expt AND s.t >= t_start AND s.t < t_end WHERE {_OK} AND {span_sql('s.v', chr(39) + 'rotary_encoder' + chr(39))} GROUP BY s.expt, trial",
    "asof_backward": _ASOF + "f.t >= k.t",
    "asof_forward": _ASOF + "f.t <= k.t",
    "asof_strict": _ASOF + "f.t < k.t",
    "flips_between": f"SELECT e.expt, trial, count(*) AS n_edges, min(e.t) AS t_first, max(e.t) AS t_last FROM (SELECT expt, t0 AS t FROM ({_EDGE}) WHERE was <> high) e JOIN ({_TRIALS}) w ON e.expt = w.expt AND e.t >= t_start AND e.t < t_end GROUP BY e.expt, trial",
    "interp_at_events": f"""SELECT a.expt, a.id, a.t, round(CASE WHEN t0 IS NULL OR b.t IS NULL THEN 0.0 WHEN b.t = t0 THEN v0 ELSE v0 + (b.v - v0) * (a.t - t0) / (b.t - t0) END, 6) AS value
        FROM (SELECT f.expt, f.id, f.t, p.t AS t0, p.v AS v0 FROM ({_FLIPS}) f ASOF LEFT JOIN ({_PIEZO}) p ON f.expt = p.expt AND f.t >= p.t) a ASOF LEFT JOIN ({_PIEZO}) b ON a.expt = b.expt AND a.t <= b.t""",
    "event_windows": f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY expt ORDER BY t, id) AS n FROM ({_CH.format("rotary_encoder")}) WHERE {_OK}), o AS (SELECT expt, t, min(n) AS n FROM s GROUP BY expt, t),
        e AS (SELECT f.expt, f.id, f.t, o.t AS t_first, o.n FROM ({_FLIPS}) f ASOF JOIN o ON f.expt = o.expt AND f.t < o.t)
        SELECT e.expt, e.id, t_first, round(avg(s.v), 6) AS mean FROM e JOIN s ON s.expt = e.expt AND s.n BETWEEN e.n AND e.n + 2 WHERE t_first - e.t <= 0.1 GROUP BY e.expt, e.id, t_first HAVING count(*) = 3""",
    "plane_demux": f"SELECT expt, id, t, CAST(n % n_planes AS INTEGER) AS plane, CAST(n // n_planes AS BIGINT) AS scan FROM (SELECT *, row_number() OVER (PARTITION BY expt ORDER BY t, id) - 1 AS n FROM ({_TICKS})) JOIN (SELECT DISTINCT expt, n_planes FROM recordings) USING (expt)",
    "crash_gap_drop": f"""WITH k AS ({_TICKS}), g AS (SELECT expt, t, lead(t) OVER (PARTITION BY expt ORDER BY t, id) - t AS gap FROM k), p AS (SELECT expt, t AS tb FROM (SELECT *, row_number() OVER (PARTITION BY expt ORDER BY gap DESC, t) AS r FROM g WHERE gap IS NOT NULL) WHERE r = 1),
        c AS (SELECT expt, min(t) + 100 AS tc FROM k GROUP BY expt) SELECT k.expt, count(*) AS n, round(sum(k.t), 3) AS sum_t FROM k LEFT JOIN (SELECT * FROM c JOIN p USING (expt)) x USING (expt) WHERE tc IS NULL OR k.t < tc OR k.t > tb GROUP BY k.expt""",
    "channel_matrix": "SELECT expt, t, " + ", ".join(f"max(CASE WHEN lower(trim(channel)) = '{n}' THEN v END) AS {n}" for n in ("photodiode", "piezo", "rotary_encoder")) + f" FROM timeline WHERE t IS NOT NULL AND NOT isnan(t) AND {_OK} GROUP BY expt, t",
    "input_names": "SELECT expt, lower(trim(channel)) AS channel, count(DISTINCT row_id) AS n_samples FROM timeline GROUP BY ALL",
}
