"""Irregular readings onto a regular grid: compact-kernel weighted local polynomial regression.

Every source has a grid of slots of equal length. The value of a slot is a local straight-line fit,
evaluated at the middle of the slot, over the readings within ``reach`` slot lengths of it, weighted by the
tricube kernel. Each slot carries its effective support and is marked as missing where no reading lies in it
and as void where the support is too small for a value.

How it is spread: readings and grids meet in hash buckets of (source, stretch of time). A stretch is
``block_slots`` slots long; readings near its ends are also sent to the next stretch. So one shuffle suffices,
no join precedes it, and a source that holds much of the table is spread over its stretches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stimlake.tables import bucket, parts, usable

SCHEMA = "src long, slot long, t double, value double, support double, n_readings int, missing boolean"


def _group(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of lengths n: which range each element is of, and its place in it."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def fit_slots(slot_start: np.ndarray, width: np.ndarray, t: np.ndarray, v: np.ndarray, at: np.ndarray, reach: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Local linear value and effective support of each slot.

    at[i] is the slot in which reading i lies (possibly outside 0..n-1 of this block, then it only lends
    weight); slots that follow each other in the arrays must belong to one source where at refers to them.
    """
    n = len(slot_start)
    sums = np.zeros((6, n))
    span = int(np.ceil(reach + 0.5))
    mid = slot_start + width / 2
    for k in range(-span, span + 1):
        j = at + k
        ok = (j >= 0) & (j < n)
        j, x, y = j[ok], t[ok], v[ok]
        u = (x - mid[j]) / (reach * width[j])
        a = np.abs(u)
        w = np.where(a < 1, (1 - np.minimum(a, 1) ** 3) ** 3, 0.0)
        for i, q in enumerate((w, w * u, w * u * u, w * y, w * u * y, w * w)):
            sums[i] += np.bincount(j, q, n)
    s0, s1, s2, m0, m1, ww = sums
    with np.errstate(all="ignore"):
        support = np.where(ww > 0, s0 * s0 / ww, 0.0)
        det = s0 * s2 - s1 * s1
        line = (s2 * m0 - s1 * m1) / det
        value = np.where(det > 1e-6 * s0 * s0, line, m0 / s0)
    return np.where(support >= least, value, np.nan), support


def regrid(readings: DataFrame, grids: DataFrame, *, reach: float = 2.0, least_support: float = 1.5, block_slots: int = 4096, rows_per_task: int = 150_000) -> DataFrame:
    """Put the readings of each source on its grid of slots.

    readings: ``src, row_id`` BIGINT, ``t, v`` DOUBLE and ``width`` DOUBLE, the slot length of the source.
    grids: ``src`` BIGINT, ``t0, width`` DOUBLE and ``n_slots`` INT; slot k is [t0 + k width, t0 + (k+1) width).

    Result, one row for each slot of each grid: ``src, slot``, ``t`` (the slot's middle), ``value`` (null where
    the support is less than ``least_support``), ``support`` (effective number of readings in the fit),
    ``n_readings`` (in the slot itself) and ``missing`` (none in it).

    Readings whose src, t or v is null or NaN take no part; a repeated row_id counts once; readings of sources
    without a grid, and before or after it, only lend weight. Grids with a null or non-positive field have no
    slots, repeated grids of a source count once. Empty tables give an empty result.
    """
    r = readings.select(F.col("src").cast("long"), F.col("row_id").cast("long"), F.col("t").cast("double"), F.col("v").cast("double"), F.col("width").cast("double"))
    r = r.filter(usable("t") & usable("v") & F.col("src").isNotNull() & (F.abs("t") < 1e15) & (F.col("width") > 0))
    g = grids.select(F.col("src").cast("long"), F.col("t0").cast("double"), F.col("width").cast("double"), F.col("n_slots").cast("long"))
    g = g.filter(usable("t0") & F.col("src").isNotNull() & (F.col("width") > 0) & (F.col("n_slots") > 0) & (F.abs("t0") < 1e15))
    n = parts(r.count(), rows_per_task)
    stretch, halo = F.col("width") * block_slots, F.col("width") * (reach + 2)
    block = lambda x: F.floor(x / stretch)
    near = F.array_distinct(F.array(block(F.col("t")), block(F.col("t") - halo), block(F.col("t") + halo)))
    r = r.withColumn("block", F.explode(near)).drop("width")
    end = F.col("t0") + F.col("width") * F.col("n_slots")
    g = g.withColumn("block", F.explode(F.sequence(block(F.col("t0")), block(end))))

    def run(rows: pd.DataFrame, slots: pd.DataFrame) -> pd.DataFrame:
        slots = slots.drop_duplicates(["src", "block"]).sort_values(["src", "block"], kind="stable")
        src, blk, t0, width, total = (slots[c].to_numpy() for c in ("src", "block", "t0", "width", "n_slots"))
        if not len(src):
            return pd.DataFrame({c: [] for c in ("src", "slot", "t", "value", "support", "n_readings", "missing")})
        # the slots whose middle lies in the block; neighbours in time of one source have neighbouring blocks
        middle = lambda k: np.floor((t0 + (k + 0.5) * width) / (width * block_slots))
        first = np.clip(np.ceil((blk * (width * block_slots) - t0) / width - 0.5).astype(np.int64), 0, total)
        first = np.where((first > 0) & (middle(first - 1) >= blk), first - 1, np.where(middle(first) < blk, first + 1, first))
        last = np.clip(np.ceil(((blk + 1) * (width * block_slots) - t0) / width - 0.5).astype(np.int64), 0, total)
        last = np.where((last > 0) & (middle(last - 1) > blk), last - 1, np.where((middle(last) <= blk), last + 1, last))
        last = np.minimum(last, total)
        first = np.minimum(first, last)
        pad = int(np.ceil(reach + 0.5)) + 1  # keeps weights from crossing into another source
        size = last - first + 2 * pad
        which, place = _group(first - pad, size)
        offset = np.cumsum(size) - size
        start = t0[which] + place * width[which]
        rows = rows.drop_duplicates(["src", "block", "row_id"])
        key = pd.MultiIndex.from_arrays([src, blk])
        of = key.get_indexer(pd.MultiIndex.from_arrays([rows["src"], rows["block"]]))
        t, v = rows["t"].to_numpy()[of >= 0], rows["v"].to_numpy()[of >= 0]
        of = of[of >= 0]
        k = np.floor((t - t0[of]) / width[of]).astype(np.int64)
        k = np.where(t < t0[of] + k * width[of], k - 1, k)
        k = np.where(t >= t0[of] + (k + 1) * width[of], k + 1, k)
        local = k - (first[of] - pad)
        ok = (local >= 0) & (local < size[of])
        at, t, v = (local + offset[of])[ok], t[ok], v[ok]
        count = np.bincount(at, minlength=len(which))
        value, support = fit_slots(start, width[which], t, v, at, reach, least_support)
        keep = (place >= first[which]) & (place < last[which])
        return pd.DataFrame({"src": src[which], "slot": place, "t": start + width[which] / 2, "value": value, "support": support, "n_readings": count.astype(np.int32), "missing": count == 0})[keep]

    # as many partitions as buckets: the tasks stay this size whatever spark.sql.shuffle.partitions says
    r, g = (x.withColumn("bucket", bucket(n, "src", "block")).repartition(n, "bucket") for x in (r, g))
    done = r.groupBy("bucket").cogroup(g.groupBy("bucket")).applyInPandas(run, SCHEMA)
    return done.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
