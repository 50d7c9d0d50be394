"""Implausible readings: a hidden Markov model per source with hard bounds.

Each source (a channel of a recording, a neuron's trace, ...) is a time-ordered series of readings that is
explained by four hidden states: normal, spike, stuck, out of range. Forward-backward probabilities of the
states, together with hard bounds (the span the hardware can produce, the longest spike, the shortest
frozen stretch), assign the flags.

A short excursion is measured by the scatter of the source: the usual step between its successive readings, over
the whole source or around the reading, whichever is greater. So a source that grows noisy is not called
implausible, nor is one that stirs after a long rest.

How it is spread: a first pass counts the readings of each source. Those above ``max_rows`` are cut into blocks of
equal time that a second pass counts, together with the sizes of their steps in narrow bins; whole blocks make
chunks of about ``chunk_rows`` readings, with at least ``halo`` readings of their neighbours on both sides. A block
that is too full is cut finer by a pass of its own. The last pass shuffles all readings once, into buckets of whole
sources and chunks; inside a bucket the model runs over all of them at once as NumPy arrays. What a source is judged
by is the same at every size, so no task ever sorts or holds a whole hot source.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stimlake.tables import bucket, cut, maybe_broadcast, parts, usable

NORMAL, SPIKE, STUCK, OUT = range(4)
FLAGS = np.array(["normal", "spike", "stuck", "out_of_range"], dtype=object)


@dataclass(frozen=True)
class Profile:
    """What is known of a kind of source.

    ``shape``: 'signal' (continuous), 'counter' (never falls), 'levels' (dwells on a few levels), 'rest'
    (zero for long, else bursts). ``may_freeze``: whether a frozen stretch is implausible. ``spike_at``:
    multiples of the source's scatter from which a short excursion is a spike rather than ordinary.
    """

    shape: str = "signal"
    may_freeze: bool = True
    spike_at: float = 8.0


@dataclass(frozen=True)
class Params:
    """Parameters of the model; the defaults are the production ones."""

    longest_spike: int = 3
    shortest_stuck: int = 12
    p_spike: float = 0.005
    p_spike_end: float = 0.6
    p_stuck: float = 1e-4
    p_stuck_end: float = 0.05
    max_rows: int = 65_536
    chunk_rows: int = 32_768
    halo: int = 128
    around: int = 64
    rows_per_task: int = 60_000


def _shift(x: np.ndarray, sid: np.ndarray, k: int) -> np.ndarray:
    """x moved by k places within each series, NaN where there is none."""
    out = np.full(len(x), np.nan)
    if k > 0:
        out[k:] = np.where(sid[k:] == sid[:-k], x[:-k], np.nan)
    elif k < 0:
        out[:k] = np.where(sid[:k] == sid[-k:], x[-k:], np.nan)
    return out


def _median3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    b = np.where(np.isnan(b), a, b)
    c = np.where(np.isnan(c), a, c)
    return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))


def excursions(v: np.ndarray, sid: np.ndarray, longest: int) -> np.ndarray:
    """For each reading, by how much it and at most ``longest - 1`` companions leave both of their surroundings."""
    before, after = _shift(v, sid, 1), _shift(v, sid, -1)
    left = _median3(before, _shift(v, sid, 2), _shift(v, sid, 3))
    right = _median3(after, _shift(v, sid, -2), _shift(v, sid, -3))
    lo_l, hi_l = np.fmin(left, before), np.fmax(left, before)
    lo_r, hi_r = np.fmin(right, after), np.fmax(right, after)
    best = np.zeros(len(v))
    for w in range(1, longest + 1):
        if len(v) < w:
            break
        n = len(v) - w + 1
        inside = np.lib.stride_tricks.sliding_window_view(v, w)
        with np.errstate(invalid="ignore"):
            up = inside.min(1) - np.fmax(hi_l[:n], hi_r[w - 1 :])
            down = np.fmin(lo_l[:n], lo_r[w - 1 :]) - inside.max(1)
            got = np.fmax(up, down)
        got = np.where((sid[:n] == sid[w - 1 :]) & ~np.isnan(got), got, 0.0)
        for k in range(w):
            np.maximum(best[k : k + n], got, out=best[k : k + n])
    return best


def away_from_levels(v: np.ndarray, reach: int = 100, k: int = 6, rows: int = 4096) -> np.ndarray:
    """Distance of each reading to the k-th nearest value among the readings around it."""
    n = len(v)
    if n <= k:
        return np.zeros(n)
    reach = min(reach, (n - 1) // 2 or 1)
    span = min(2 * reach + 1, n)
    windows = np.lib.stride_tricks.sliding_window_view(v, span)
    start = np.clip(np.arange(n) - reach, 0, n - span)
    out = np.empty(n)
    for a in range(0, n, rows):
        d = np.abs(windows[start[a : a + rows]] - v[a : a + rows, None])
        out[a : a + rows] = np.partition(d, k, axis=1)[:, k]
    return out


def forward_backward(e: np.ndarray, first: np.ndarray, move: np.ndarray, start: np.ndarray, length: int = 256) -> np.ndarray:
    """State probabilities of many series laid end to end.

    e: (n, s) emission likelihoods; first: where a series begins; move: (s, s); start: (s,). The rows are
    folded into segments of ``length``; segment products give the messages at the borders, then all segments
    advance together, so the result is that of one pass over each series.
    """
    n, s = e.shape
    if not n:
        return np.zeros((0, s))
    b = -(-n // length)
    pad = b * length - n
    e = np.vstack([e, np.ones((pad, s))]).reshape(b, length, s)
    new = np.concatenate([first, np.ones(pad, bool)]).reshape(b, length)
    step = np.where(new[..., None, None], np.broadcast_to(start, (s, s)), move) * e[:, :, None, :]
    whole = np.broadcast_to(np.eye(s), (b, s, s)).copy()
    for i in range(length):
        whole = whole @ step[:, i]
        whole /= whole.sum((1, 2), keepdims=True) + 1e-300
    ahead, behind = np.empty((b, s)), np.empty((b, s))
    x, y = np.full(s, 1 / s), np.ones(s)
    for i in range(b):
        ahead[i] = x
        x = x @ whole[i]
        x = x / (x.sum() + 1e-300)
    for i in range(b - 1, -1, -1):
        behind[i] = y
        y = whole[i] @ y
        y = y / (y.sum() + 1e-300)
    alpha, beta = np.empty((b, length, s)), np.empty((b, length, s))
    for i in range(length):
        ahead = np.einsum("bi,bij->bj", ahead, step[:, i])
        ahead /= ahead.sum(1, keepdims=True) + 1e-300
        alpha[:, i] = ahead
    for i in range(length - 1, -1, -1):
        beta[:, i] = behind
        behind = np.einsum("bij,bj->bi", step[:, i], behind)
        behind /= behind.sum(1, keepdims=True) + 1e-300
    post = (alpha * beta).reshape(-1, s)[:n]
    return post / (post.sum(1, keepdims=True) + 1e-300)


#: Bins of the size of steps for each doubling of it.
FINE = 512


def _moved(s: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps between successive readings, whether they are of one series, and whether they are any."""
    step = np.abs(np.diff(x))
    inner = s[1:] == s[:-1]
    return step, inner, inner & (step > 1e-9 * np.maximum(1.0, np.abs(x[1:])))


def step_bins(step: np.ndarray, sid: np.ndarray) -> pd.DataFrame:
    """Steps of each series counted in narrow bins: sid, bin, n, total, least."""
    by = pd.DataFrame({"sid": sid, "bin": np.floor(np.log2(step) * FINE).astype(np.int64), "step": step}).groupby(["sid", "bin"])["step"]
    return by.agg(["size", "sum", "min"]).reset_index().set_axis(["sid", "bin", "n", "total", "least"], axis=1)


def usual_steps(bins: pd.DataFrame, series: int) -> np.ndarray:
    """For each series its grain (the least step, 0 without any), and the median and lower quartile of those steps
    that are clearly greater, between neighbours as np.quantile has them (NaN without any)."""
    out = np.full((series, 3), np.nan)
    bins = bins.sort_values(["sid", "bin"])
    sid, n, size = bins["sid"].to_numpy(), bins["n"].to_numpy(), (bins["total"] / bins["n"]).to_numpy()
    out[:, 0] = 0.0
    least = bins.groupby("sid")["least"].min()
    out[least.index, 0] = least
    coarse = size > 2.5 * out[sid, 0]
    sid, n, size = sid[coarse], n[coarse], size[coarse]
    if len(n):
        ends = np.cumsum(n)
        here, first = np.unique(sid, return_index=True)
        before = np.r_[0, ends][first]
        all_ = np.diff(np.r_[before, ends[-1]])
        for column, q in ((1, 0.5), (2, 0.25)):
            at = q * (all_ - 1)
            low, high = (size[np.searchsorted(ends, before + f(at), side="right")] for f in (np.floor, np.ceil))
            out[here, column] = low + (at - np.floor(at)) * (high - low)
    return out


#: Scatter of normal readings by the median of their steps.
BY_STEP = 1.4826 / np.sqrt(2)


def scatter_around(step: np.ndarray, counts: np.ndarray, s: np.ndarray, at: np.ndarray, reach: int, rows: int = 4096) -> np.ndarray:
    """Scatter of the series by the steps that count among the ``reach`` before and after each place; 0 if few do."""
    out = np.zeros(len(at))
    for a in range(0, len(at), rows):
        i = at[a : a + rows, None] + np.arange(-reach, reach)
        ok = (i >= 0) & (i < len(step))
        i = np.clip(i, 0, max(len(step) - 1, 0))
        ok &= counts[i] & (s[i] == s[at[a : a + rows], None]) & (s[i + 1] == s[at[a : a + rows], None])
        near = np.sort(np.where(ok, step[i], np.inf), axis=1)
        n = ok.sum(1)
        middle = near[np.arange(len(n)), np.minimum(n // 2, near.shape[1] - 1)]
        out[a : a + rows] = np.where(n >= 16, middle * BY_STEP, 0.0)
    return out


def judge(sid: np.ndarray, v: np.ndarray, lo: np.ndarray, hi: np.ndarray, shape: np.ndarray, freeze: np.ndarray, spike_at: np.ndarray, p: Params, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Flags and state probabilities of readings sorted by series and time.

    sid numbers the series 0..S-1; lo, hi, shape, freeze and spike_at have one entry for each series. known: for
    each series its grain and the median and lower quartile of its coarse steps, NaN to take them from the readings.
    """
    n, series = len(v), len(lo)
    out = (v < lo[sid]) | (v > hi[sid])
    keep = np.flatnonzero(~out)
    s, x = sid[keep], v[keep]
    step, inner, moved = _moved(s, x)
    known = np.full((series, 3), np.nan) if known is None else known
    fresh = np.isnan(known[:, 0])
    own = moved & fresh[s[1:]] & np.isfinite(step)
    known = np.where(fresh[:, None], usual_steps(step_bins(step[own], s[1:][own]), series), known)
    grain = known[:, 0]
    scatter = np.fmax(np.nan_to_num(known[:, 1] * BY_STEP, nan=0.0), grain)
    scatter[scatter == 0] = 1.0
    z = excursions(x, s, p.longest_spike)
    for k in np.flatnonzero(shape == "levels"):
        at = slice(*np.searchsorted(s, [k, k + 1]))
        if not np.isnan(known[k, 2]):
            scatter[k] = max(known[k, 2] / 0.45, grain[k])
        z[at] = away_from_levels(x[at])
    scatter[shape == "counter"] = 1.0
    z = z / scatter[s]
    # where a reading stands out by the whole source's scatter, that around it counts too
    out_there = np.flatnonzero((z > spike_at[s] / 2) & np.isin(shape, ["signal", "rest"])[s])
    coarse = moved & (step > 2.5 * grain[s[1:]])
    z[out_there] /= np.maximum(1.0, scatter_around(step, coarse, s, out_there, p.around) / scatter[s[out_there]])

    flat = np.zeros(len(x), bool)
    near = inner & (step <= 2.5 * grain[s[1:]] + 1e-9 * np.maximum(1.0, np.abs(x[1:])))
    flat[1:] |= near
    flat[:-1] |= near

    top = 200.0
    # odds of spike against normal are even at z = spike_at for a single reading
    rate = (-np.log(p.p_spike * p.p_spike_end) + np.log(top)) / spike_at
    like = np.empty((n, 4))
    r = rate[s]
    zz = np.minimum(z, top)
    f = freeze[s]
    like[:, OUT] = 1e-12
    like[keep, NORMAL] = np.exp(-np.minimum(r * zz, 600)) * np.where(f & flat, 0.05, 1.0)
    like[keep, SPIKE] = 1 / top * np.where(f & flat, 0.3, 1.0)
    like[keep, STUCK] = np.exp(-np.minimum(r * zz, 600)) * np.where(f & flat, 1.0, 1e-9)  # two equal spikes are no frozen stretch
    like[out] = [1e-12, 1e-12, 1e-12, 1.0]
    like /= like.max(1, keepdims=True)
    a, b, c, d = p.p_spike, p.p_stuck, p.p_spike_end, p.p_stuck_end
    o = 1e-3
    move = np.array([[1 - a - b - o, a, b, o], [c, 1 - c - b - o, b, o], [d, a * d, 1 - d - a * d - o, o], [0.7, a, b, 1 - 0.7 - a - b]])
    first = np.r_[True, sid[1:] != sid[:-1]] if n else np.zeros(0, bool)
    post = forward_backward(like, first, move, np.array([1 - a - b - o, a, b, o]))

    flag = np.zeros(n, np.int8)
    flag[out] = OUT
    # stretches that do not move by more than the grain
    starts = np.flatnonzero(np.r_[True, ~near]) if len(x) else np.zeros(0, int)
    length = np.diff(np.r_[starts, len(x)])
    stuck_p = np.add.reduceat(post[keep, STUCK], starts) / length if len(x) else np.zeros(0)
    frozen = np.repeat((length >= p.shortest_stuck) & (stuck_p > 0.5), length) & f
    flag[keep[frozen]] = STUCK
    spike = ~frozen & (post[keep, SPIKE] > 0.5) & (z > 0)
    flag[keep[spike]] = SPIKE
    return flag, post


def flag_readings(readings: DataFrame, limits: dict[str, tuple[float, float]], profiles: dict[str, Profile], params: Params = Params()) -> DataFrame:
    """Flag implausible readings of many sources.

    readings: ``src`` BIGINT and ``channel`` STRING (together the source), ``row_id`` BIGINT, ``t`` and ``v``
    DOUBLE; other columns are ignored. limits: for a channel the span its hardware can produce; profiles: for
    a channel what it is like (a plain signal if absent).

    Result: ``src, channel, row_id, t, v, flag, p_spike, p_stuck`` with one row for each implausible reading;
    flag is 'spike', 'stuck' or 'out_of_range'.

    Rows whose source, id, t or v is null or whose t or v is NaN take no part; infinite v are out of range
    where the channel has limits. A repeated row_id of a source counts once. Readings at the same time are
    ordered by row_id. An empty table gives an empty result.
    """
    p = params
    rows = readings.select(F.col("src").cast("long"), "channel", F.col("row_id").cast("long"), F.col("t").cast("double"), F.col("v").cast("double"))
    rows = rows.filter(usable("t") & usable("v") & F.col("src").isNotNull() & F.col("channel").isNotNull() & F.col("row_id").isNotNull())
    source = ["src", "channel"]
    per = cut(rows.groupBy(*source).agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last")), "sources")
    total, hot = per.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > p.max_rows, 1))).first()
    home = F.array(F.struct(F.lit(0).cast("long").alias("chunk"), F.lit(True).alias("core")))
    if hot:
        chunks, usuals, levels = _chunks(rows, per.filter(F.col("n") > p.max_rows), limits, p)
        whole = _placed(rows, levels, "left").join(maybe_broadcast(chunks), [*source, "block"], "left").join(maybe_broadcast(usuals), source, "left")
        whole = whole.select(*source, "row_id", "t", "v", "grain", "middle", "quarter", F.inline(F.coalesce("homes", home)))
    else:
        none = [F.lit(None).cast("double").alias(k) for k in ("grain", "middle", "quarter")]
        whole = rows.select(*source, "row_id", "t", "v", *none, F.inline(home))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, channel = np.unique(pdf["channel"].to_numpy(dtype=object), return_inverse=True)
        src, chunk, t, rid = (pdf[c].to_numpy() for c in ("src", "chunk", "t", "row_id"))
        order = np.lexsort((rid, t, chunk, src, channel))
        src, chunk, channel, t, rid = (x[order] for x in (src, chunk, channel, t, rid))
        v, core = pdf["v"].to_numpy()[order], pdf["core"].to_numpy()[order]
        new = np.r_[True, (src[1:] != src[:-1]) | (chunk[1:] != chunk[:-1]) | (channel[1:] != channel[:-1])]
        once = new | np.r_[True, rid[1:] != rid[:-1]]
        src, channel, t, rid, v, core, new = (x[once] for x in (src, channel, t, rid, v, core, new))
        sid = np.cumsum(new) - 1
        kind = [profiles.get(names[c], Profile()) for c in channel[new]]
        known = pdf[["grain", "middle", "quarter"]].to_numpy(float)[order][once][new]
        span = np.array([limits.get(names[c], (-np.inf, np.inf)) for c in channel[new]], float)
        flag, post = judge(sid, v, span[:, 0], span[:, 1], np.array([k.shape for k in kind]), np.array([k.may_freeze for k in kind]), np.array([k.spike_at for k in kind]), p, known)
        hit = (flag > 0) & core
        return pd.DataFrame({"src": src[hit], "channel": names[channel[hit]], "row_id": rid[hit], "t": t[hit], "v": v[hit], "flag": FLAGS[flag[hit]], "p_spike": post[hit, SPIKE], "p_stuck": post[hit, STUCK]})

    n = parts(total, p.rows_per_task)
    # as many partitions as buckets: the tasks stay this size whatever spark.sql.shuffle.partitions says
    whole = whole.withColumn("bucket", bucket(n, "channel", "src", "chunk")).repartition(n, "bucket")
    return whole.groupBy("bucket").applyInPandas(run, "src long, channel string, row_id long, t double, v double, flag string, p_spike double, p_stuck double")


def _placed(rows: DataFrame, levels: list[DataFrame], how: str) -> DataFrame:
    """Readings with the block of time they lie in, its numbers at each level of fineness; null for readings of
    sources that are not cut."""
    placed = rows.withColumn("block", F.lit(None).cast("string"))
    for level, spans in enumerate(levels):
        keys = ["src", "channel"] if not level else ["src", "channel", "block"]
        placed = placed.join(maybe_broadcast(spans.withColumn("fine", F.lit(True))), keys, how if not level else "left")
        number = F.floor((F.col("t") - F.col("first")) / F.col("width")).cast("string")
        block = F.when(F.col("fine"), F.concat_ws("/", "block", number)).otherwise(F.col("block"))
        placed = placed.withColumn("block", block).drop("first", "width", "fine")
    return placed


def _chunks(rows: DataFrame, big: DataFrame, limits: dict[str, tuple[float, float]], p: Params) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """How the big sources are cut: the chunks each block belongs to (src, channel, block, homes), the sources' usual
    steps (src, channel, grain, middle, quarter), and the spans of the blocks at each level."""
    source, key = ["src", "channel"], ["src", "channel", "block"]
    width = lambda n: F.greatest((F.col("last") - F.col("first")) / F.ceil(n / p.chunk_rows * 8), F.lit(1e-9))
    levels = [big.select(*source, "first", width(F.col("n")).alias("width"))]
    n_big = big.agg(F.sum("n")).first()[0]

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        """Readings and span of each block, and of each source in it the steps inside the blocks."""
        pdf = pdf.drop_duplicates([*source, "row_id"]).sort_values([*key, "t", "row_id"], kind="stable")
        by = pdf.groupby(key, sort=False)
        blocks = by["t"].agg(["size", "min", "max"]).reset_index().set_axis([*key, "n", "first", "last"], axis=1)
        span = {c: limits.get(c, (-np.inf, np.inf)) for c in pdf["channel"].unique()}
        lo, hi = (pdf["channel"].map(lambda c, e=e: span[c][e]).to_numpy(float) for e in (0, 1))
        fits = (pdf["v"].to_numpy() >= lo) & (pdf["v"].to_numpy() <= hi)
        sid, series = by.ngroup().to_numpy(), pdf.groupby(source, sort=False).ngroup().to_numpy()
        step, _, moved = _moved(sid[fits], pdf["v"].to_numpy()[fits])
        moved &= np.isfinite(step)
        bins = step_bins(step[moved], series[fits][1:][moved])
        names = pdf.drop_duplicates(source)[source].reset_index(drop=True)
        both = pd.concat([blocks, names.loc[bins["sid"]].reset_index(drop=True).join(bins.drop(columns="sid"))], ignore_index=True)
        return both.assign(block=both["block"].astype(object).where(both["block"].notna(), None), bin=both["bin"].astype("Int64"))[[*key, "n", "first", "last", "bin", "total", "least"]]

    def counted(some: DataFrame) -> DataFrame:
        some = some.withColumn("g", bucket(parts(n_big, p.rows_per_task), *key)).repartition(parts(n_big, p.rows_per_task), "g")
        return cut(some.groupBy("g").applyInPandas(count, "src long, channel string, block string, n long, first double, last double, bin long, total double, least double"), "blocks")

    found = counted(_placed(rows, levels, "inner"))
    bins = found.filter("bin IS NOT NULL").groupBy(*source, "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"))

    def usual(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *usual_steps(pdf.assign(sid=0), 1)[0])], columns=["src", "channel", "grain", "middle", "quarter"])

    # a source's sizes of steps are a bounded number of bins; one without any step has grain 0
    usuals = cut(big.select(*source).join(bins.groupBy(*source).applyInPandas(usual, "src long, channel string, grain double, middle double, quarter double"), source, "left").fillna(0.0, ["grain"]), "usual")
    blocks = found.filter("bin IS NULL").select(*key, "n", "first", "last")
    while True:
        # blocks that are too full are cut finer, unless all their readings have one time
        full = (F.col("n") > 2 * p.chunk_rows) & (F.col("last") > F.col("first")) & (F.size(F.split("block", "/")) == len(levels))
        finer = cut(blocks.filter(full).select(*key, "first", width(F.col("n")).alias("width")), "finer")
        if not finer.limit(1).count():
            break
        some = _placed(rows, levels, "inner").join(maybe_broadcast(finer.select(*key)), key, "left_semi")
        levels.append(finer)
        fresh = counted(_placed(some.drop("block"), levels, "inner")).filter("bin IS NULL").select(*key, "n", "first", "last")
        blocks = blocks.filter(~full).unionByName(fresh)
    order = Window.partitionBy(*source).orderBy("first", "block")  # a row for each block of thousands of readings
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = cut(blocks.withColumn("chunk", F.floor(F.col("before") / p.chunk_rows)), "chunks")
    starts = blocks.groupBy(*source, "chunk").agg(F.min("before").alias("start"))
    turn = Window.partitionBy(*source).orderBy("chunk")
    starts = starts.select(*source, "chunk", "start", F.lag("chunk").over(turn).alias("prior"), F.lead("chunk").over(turn).alias("next"), F.lead("start").over(turn).alias("end"))
    near = blocks.join(starts, [*source, "chunk"])
    entry = lambda c, core: F.struct(F.col(c).alias("chunk"), F.lit(core).alias("core"))
    homes = F.array_compact(F.array(entry("chunk", True), F.when(F.col("before") - F.col("start") < p.halo, F.when(F.col("prior").isNotNull(), entry("prior", False))), F.when(F.col("end") - F.col("before") - F.col("n") < p.halo, F.when(F.col("next").isNotNull(), entry("next", False)))))
    return cut(near.select(*key, homes.alias("homes")), "homes"), usuals, levels
