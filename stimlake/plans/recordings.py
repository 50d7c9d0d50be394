"""Queries over the recordings' tables: problems 1 and 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stimlake.operators.implausible import Profile, flag_readings
from stimlake.operators.regrid import regrid
from stimlake.tables import maybe_broadcast, table

#: What each channel is like; known from the recording hardware, not from a table.
PROFILES = {
    "neuralframes": Profile("counter", may_freeze=False, spike_at=3.0),
    "photodiode": Profile("levels", may_freeze=True, spike_at=5.5),
    "syncecho": Profile("levels", may_freeze=False, spike_at=5.5),
    "rotary_encoder": Profile("rest", may_freeze=False, spike_at=8.0),
    "piezo": Profile("signal", may_freeze=True, spike_at=8.0),
    "cell_trace": Profile("signal", may_freeze=True, spike_at=8.0),
}
#: channels has one row for each kind of hardware input; more than this is not such a table.
MAX_CHANNELS = 10_000


def channel_limits(spark: SparkSession, sf_dir: str) -> dict[str, tuple[float, float]]:
    """Span of each channel, by its name in lower case without outer blanks."""
    rows = table(spark, sf_dir, "channels").select(F.lower(F.trim("channel")).alias("c"), "v_min", "v_max").limit(MAX_CHANNELS + 1).collect()
    if len(rows) > MAX_CHANNELS:
        raise ValueError("channels is too large for a table of hardware inputs")
    inf = float("inf")
    return {r.c: (-inf if r.v_min is None else r.v_min, inf if r.v_max is None else r.v_max) for r in rows if r.c}


def implausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of all readings of timeline and trace."""
    timeline = table(spark, sf_dir, "timeline").select(F.col("expt").alias("src"), F.lower(F.trim("channel")).alias("channel"), "row_id", "t", "v")
    trace = table(spark, sf_dir, "trace").select(F.col("neuron").alias("src"), F.lit("cell_trace").alias("channel"), "row_id", "t", "v")
    flags = flag_readings(timeline.unionByName(trace), channel_limits(spark, sf_dir), PROFILES)
    return flags.select(F.when(F.col("channel") == "cell_trace", "trace").otherwise("timeline").alias("tbl"), "src", "channel", "row_id", "t", "v", "flag", "p_spike", "p_stuck")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible(spark, sf_dir).select("tbl", "row_id")


def p1_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags by source: how many readings of each kind are implausible."""
    return implausible(spark, sf_dir).groupBy("tbl", "src", "channel", "flag").agg(F.count("*").alias("n"), F.min("t").alias("t_first"), F.max("t").alias("t_last"))


def p1_out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the flags that hard bounds decide alone."""
    return implausible(spark, sf_dir).filter(F.col("flag") == "out_of_range").select("tbl", "row_id")


def scan_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scan slot of every neuron with a trace."""
    periods = table(spark, sf_dir, "recordings").select("expt", F.col("scan_period").alias("width")).dropDuplicates(["expt"])
    periods = maybe_broadcast(periods)
    neurons = table(spark, sf_dir, "neurons").filter("n_scans IS NOT NULL").join(periods, "expt").select(F.col("neuron").alias("src"), "t0", "width", F.col("n_scans").alias("n_slots"))
    trace = table(spark, sf_dir, "trace").join(periods, "expt").select(F.col("neuron").alias("src"), "row_id", "t", "v", "width")
    return regrid(trace, neurons)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_grid(spark, sf_dir).filter("missing").select(F.col("src").alias("neuron"), "slot")


def p4_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regular series itself."""
    return scan_grid(spark, sf_dir).select(F.col("src").alias("neuron"), "slot", F.round("t", 6).alias("t"), F.round("value", 3).alias("value"), F.round("support", 6).alias("support"), "n_readings", "missing")


#: Problem 4's missing slots by plain SQL: every slot, less those with a usable reading.
P4_FOUND_SQL = """
WITH p AS (SELECT DISTINCT expt, scan_period FROM recordings),
n AS (SELECT DISTINCT neuron, t0, n_scans, scan_period AS w FROM neurons JOIN p USING (expt) WHERE n_scans > 0 AND t0 IS NOT NULL),
s AS (SELECT neuron, t0, w, unnest(range(n_scans)) AS slot FROM n),
r AS (SELECT DISTINCT t.neuron, t.t, CAST(floor((t.t - n.t0) / n.w) AS BIGINT) AS k, n.t0, n.w FROM trace t JOIN n USING (neuron)
      WHERE t.t IS NOT NULL AND t.v IS NOT NULL AND NOT isnan(t.t) AND NOT isnan(t.v)),
h AS (SELECT DISTINCT neuron, CASE WHEN t < t0 + k * w THEN k - 1 WHEN t >= t0 + (k + 1) * w THEN k + 1 ELSE k END AS slot FROM r)
SELECT s.neuron, CAST(s.slot AS BIGINT) AS slot FROM s LEFT JOIN h ON s.neuron = h.neuron AND s.slot = h.slot WHERE h.slot IS NULL
"""

P4_GRID_SQL = """
WITH p AS (SELECT DISTINCT expt, scan_period FROM recordings),
n AS (SELECT DISTINCT neuron, t0, n_scans, scan_period AS w FROM neurons JOIN p USING (expt) WHERE n_scans > 0 AND t0 IS NOT NULL),
r AS (SELECT DISTINCT t.neuron, t.row_id, t.t, t.v, n.t0, n.w, n.n_scans, CAST(floor((t.t - n.t0) / n.w) AS BIGINT) AS k FROM trace t JOIN n USING (neuron) WHERE t.t IS NOT NULL AND t.v IS NOT NULL AND NOT isnan(t.t) AND NOT isnan(t.v)),
f AS (SELECT *, CASE WHEN t < t0 + k * w THEN k - 1 WHEN t >= t0 + (k + 1) * w THEN k + 1 ELSE k END AS own FROM r),
e AS (SELECT neuron, slot, (t - (t0 + slot * w + w / 2)) / (2 * w) AS u, v, own = slot AS inside FROM (SELECT *, unnest(range(own - 3, own + 4)) AS slot FROM f) WHERE slot BETWEEN 0 AND n_scans - 1),
g AS (SELECT neuron, slot, sum(q) AS s0, sum(q * u) AS s1, sum(q * u * u) AS s2, sum(q * v) AS m0, sum(q * u * v) AS m1, sum(q * q) AS ww, count(*) FILTER (inside) AS k FROM (SELECT *, CASE WHEN abs(u) < 1 THEN (1 - abs(u) ** 3) ** 3 ELSE 0 END AS q FROM e) GROUP BY ALL)
SELECT s.neuron, CAST(s.slot AS BIGINT) AS slot, round(t0 + s.slot * w + w / 2, 6) AS t, round(CASE WHEN s0 * s0 / nullif(ww, 0) >= 1.5 THEN CASE WHEN s0 * s2 - s1 * s1 > 1e-6 * s0 * s0 THEN (s2 * m0 - s1 * m1) / (s0 * s2 - s1 * s1) ELSE m0 / s0 END END, 3) AS value,
  round(coalesce(s0 * s0 / nullif(ww, 0), 0), 6) AS support, CAST(coalesce(k, 0) AS INTEGER) AS n_readings, coalesce(k, 0) = 0 AS missing
FROM (SELECT *, unnest(range(n_scans)) AS slot FROM n) s LEFT JOIN g ON s.neuron = g.neuron AND s.slot = g.slot
"""

P1_OUT_SQL = """
SELECT DISTINCT 'timeline' AS tbl, row_id FROM timeline r JOIN channels c ON lower(trim(r.channel)) = lower(trim(c.channel)) WHERE t IS NOT NULL AND NOT isnan(t) AND v IS NOT NULL AND NOT isnan(v) AND expt IS NOT NULL AND NOT (v BETWEEN v_min AND v_max)
UNION ALL SELECT DISTINCT 'trace', row_id FROM trace JOIN channels c ON lower(trim(c.channel)) = 'cell_trace' WHERE t IS NOT NULL AND NOT isnan(t) AND v IS NOT NULL AND NOT isnan(v) AND neuron IS NOT NULL AND NOT (v BETWEEN v_min AND v_max)
"""

QUERIES = {"p1_found": p1_found, "p1_flags": p1_flags, "p1_out_of_range": p1_out_of_range, "p4_found": p4_found, "p4_grid": p4_grid}
SQL = {"p1_out_of_range": P1_OUT_SQL, "p4_found": P4_FOUND_SQL, "p4_grid": P4_GRID_SQL}
