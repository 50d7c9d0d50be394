"""Gabor filter banks, their projection on movies, and what is made of the coefficients.

Filters are numbered x, y, o (orientation), s (size), f (frequency) and phase; pixels y-major, p = y nx + x. A
filter is its kernel (one for each o, s, f and phase) moved to its place and clipped to the canvas. So a projection
needs the kernels only, however many places there are: the coefficients of all places are one correlation of the
frame with the kernel. Coefficients are one row for each frame, f and s, in the order of (phase, x, y, o).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Frequency as a linear function of the size, where it is tied to it.
TIED_SLOPE, TIED_OFFSET = -0.016, 0.148
DEVIATIONS = 3.0
#: Cells of all kernels (not filters) that may go to every task; the default bank has about 120 000.
MAX_KERNEL_CELLS = 4_000_000
#: Numbers that a task works on at a time.
CELLS = 4_000_000
ORDER = ["f", "s", "phase", "o"]


def parameters(spark: SparkSession, n_theta: int, sigmas: list[float], phases: list[float], frequencies: list[float] | None = None) -> DataFrame:
    """The parameters of every kernel: o, s, f, phase, theta, sigma, frequency, offset. Without frequencies they
    are tied to the sizes."""
    return _axes(spark.range(1).select(), n_theta, sigmas, phases, frequencies)


def filters(spark: SparkSession, nx: int, ny: int, n_theta: int, sigmas: list[float], phases: list[float], frequencies: list[float] | None = None) -> DataFrame:
    """The parameters of every filter: those of its kernel and its place x, y."""
    grid = spark.range(nx * ny).select(F.floor(F.col("id") / ny).cast("int").alias("x"), F.pmod("id", F.lit(ny)).cast("int").alias("y"))
    return _axes(grid, n_theta, sigmas, phases, frequencies)


def _axes(grid: DataFrame, n_theta: int, sigmas: list[float], phases: list[float], frequencies: list[float] | None) -> DataFrame:
    axes = {"o": ("theta", [i * math.pi / n_theta for i in range(n_theta)]), "s": ("sigma", sigmas), "phase": ("offset", phases)}
    if frequencies:
        axes["f"] = ("frequency", frequencies)
    for name, (value, values) in axes.items():
        grid = grid.select("*", F.posexplode(F.array(*[F.lit(float(v)) for v in values])).alias(name, value))
    if not frequencies:
        grid = grid.withColumn("f", F.lit(0)).withColumn("frequency", TIED_SLOPE * F.col("sigma") + TIED_OFFSET)
    return grid


def half(w: Column) -> Column:
    """The nearest 16-bit float of each value."""

    @F.pandas_udf("double")
    def to_half(x: pd.Series) -> pd.Series:
        return x.astype(np.float16).astype(float)

    return to_half(w)


def kernels(params: DataFrame, sixteen_bit: bool = False) -> DataFrame:
    """The cells of each kernel: params' columns, ``r`` (along x) and ``c`` (along y) from its middle, ``w``.

    The real part of a two-dimensional Gabor function with circular envelope, 1/(2 pi sigma^2) high, out to three
    deviations along its axes. The kernel's rows lie along x, its columns along y. sixteen_bit rounds the weights to
    the nearest 16-bit floats, as banks stored in that type have them.
    """
    size = F.ceil(F.greatest(DEVIATIONS * F.col("sigma") * F.greatest(F.abs(F.cos("theta")), F.abs(F.sin("theta"))), F.lit(1.0))).cast("int")
    b = params.withColumn("h", size).withColumn("r", F.explode(F.sequence(-F.col("h"), F.col("h")))).withColumn("c", F.explode(F.sequence(-F.col("h"), F.col("h"))))
    across = F.col("c") * F.cos("theta") + F.col("r") * F.sin("theta")
    along = -F.col("c") * F.sin("theta") + F.col("r") * F.cos("theta")
    s2 = F.col("sigma") * F.col("sigma")
    w = F.exp(-0.5 * (across * across + along * along) / s2) / (2 * math.pi * s2) * F.cos(2 * math.pi * F.col("frequency") * across + F.col("offset"))
    return b.select(*params.columns, "r", "c", (half(w) if sixteen_bit else w).alias("w"))


def bank(params: DataFrame, nx: int, ny: int) -> DataFrame:
    """The pixels of each filter with their weights, clipped to the canvas: params' columns (with x and y), ``pixel``, ``w``."""
    px, py = F.col("x") + F.col("r"), F.col("y") + F.col("c")
    return kernels(params).filter((px >= 0) & (px < nx) & (py >= 0) & (py < ny)).select(*params.columns, (py * nx + px).cast("int").alias("pixel"), "w")


def sign_frames(frames: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Pixels as -1 and +1."""
    return frames.withColumn("pixels", F.transform("pixels", lambda p: F.when(p > threshold, F.lit(1)).otherwise(F.lit(-1)).cast("tinyint")))


def _padded(n: int) -> int:
    """The least length from n on that has no prime factors but 2, 3 and 5."""
    while True:
        rest = n
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return n
        n += 1


def project(frames: DataFrame, kernel_rows: DataFrame, nx: int, ny: int) -> DataFrame:
    """Coefficient of each filter on each frame: ``frame, f, s, coef`` with coef in the order of (phase, x, y, o).

    Every task gets the kernels (their cells follow from the configuration, not from the data or the canvas, and
    their number is checked); frames stay where they are. A frame, 0 beyond its edges, is correlated with a kernel
    in the frequency domain. Frames of another length than nx ny or null have no coefficients; NaN pixels count as 0.
    """
    cells = kernel_rows.select(*ORDER, "r", "c", "w").limit(MAX_KERNEL_CELLS + 1).toPandas()  # bounded, checked below
    if len(cells) > MAX_KERNEL_CELLS:
        raise ValueError(f"the kernels have more than the {MAX_KERNEL_CELLS} cells that go to every task; project some of the sizes at a time")
    groups = [(int(f), int(s), own) for (f, s), own in cells.groupby(["f", "s"])]

    def spectra():
        """Of each f and s: the transformed kernels in the order of (phase, o), and the padded height and width."""
        for f, s, own in groups:
            reach = int(np.abs(own[["r", "c"]].to_numpy()).max())
            high, wide = _padded(ny + reach), _padded(nx + reach)
            k, of = np.unique(own[["phase", "o"]].to_numpy(), axis=0, return_inverse=True)
            a = np.zeros((len(k), high, wide))
            inside = (np.abs(own["c"]) < ny) & (np.abs(own["r"]) < nx)  # what lies further off meets no pixel
            own, of = own[inside], of.ravel()[inside]
            a[of, own["c"].to_numpy() % high, own["r"].to_numpy() % wide] = own["w"]
            yield f, s, len(np.unique(k[:, 0])), np.conj(np.fft.rfft2(a)), high, wide

    def run(batches):
        ready = list(spectra())
        for pdf in batches:
            v = np.nan_to_num(np.array(pdf["pixels"].tolist(), np.float64)).reshape(-1, ny, nx)
            for f, s, phases, k, high, wide in ready:
                per = max(1, CELLS // (len(k) * high * wide))
                for a in range(0, len(v), per):
                    seen = np.fft.rfft2(v[a : a + per], (high, wide))
                    c = np.fft.irfft2(seen[:, None] * k, (high, wide))[:, :, :ny, :nx].reshape(len(seen), phases, -1, ny, nx)
                    yield pd.DataFrame({"frame": pdf["frame"].iloc[a : a + per], "f": np.int32(f), "s": np.int32(s), "coef": list(c.transpose(0, 1, 4, 3, 2).reshape(len(c), -1))})

    return frames.filter(F.size("pixels") == nx * ny).select(F.col("frame").cast("long"), "pixels").mapInPandas(run, "frame long, f int, s int, coef array<double>")


def long_coefficients(coefs: DataFrame, nx: int, ny: int, n_theta: int) -> DataFrame:
    """One row for each frame and filter: frame, phase, f, s, x, y, o, coef."""
    e = coefs.select("frame", "f", "s", F.posexplode("coef").alias("i", "coef"))
    return e.select("frame", F.floor(F.col("i") / (nx * ny * n_theta)).cast("int").alias("phase"), "f", "s", F.pmod(F.floor(F.col("i") / (ny * n_theta)), F.lit(nx)).cast("int").alias("x"), F.pmod(F.floor(F.col("i") / n_theta), F.lit(ny)).cast("int").alias("y"), F.pmod(F.col("i"), F.lit(n_theta)).cast("int").alias("o"), "coef")


def _both_phases(f) -> Column:
    """f of the coefficients of phases 0 and 1, element by element."""
    n = F.size("coef") / 2
    return F.zip_with(F.slice("coef", 1, n.cast("int")), F.slice("coef", (n + 1).cast("int"), n.cast("int")), f)


def power(coefs: DataFrame) -> DataFrame:
    """``frame, f, s, power``: re^2 + im^2 of the filters in the order of (x, y, o), phases 0 and 1 being the two parts."""
    return coefs.select("frame", "f", "s", _both_phases(lambda r, i: r * r + i * i).alias("power"))


def normalised_magnitude(coefs: DataFrame) -> DataFrame:
    """``frame, f, s, magnitude``: (|re| + |im|) over 1 plus their sum over the frame, in the order of (x, y, o)."""
    both = coefs.select("frame", "f", "s", _both_phases(lambda r, i: F.abs(r) + F.abs(i)).alias("m"))
    # a frame has one row for each f and s
    total = both.withColumn("t", F.aggregate("m", F.lit(0.0), lambda a, b: a + b)).withColumn("t", 1 + F.sum("t").over(Window.partitionBy("frame")))
    return total.select("frame", "f", "s", F.transform("m", lambda x: x / F.col("t")).alias("magnitude"))


def drift(first: float, last: float, steps: int) -> list[float]:
    """Phases of a filter that drifts from one phase to another in so many frames."""
    return [first + (last - first) * i / max(steps - 1, 1) for i in range(steps)]


def drifting_response(coefs: DataFrame, steps: int) -> DataFrame:
    """Response to a direction of movement: ``frame, f, s, response`` in the order of (x, y, o).

    coefs: coefficients of ``steps`` phases, those of a drift. The response at a frame adds up the first phase's
    coefficient there, the second's on the next frame, and so on; frames that lack a following one have none.
    """
    n = (F.size("coef") / steps).cast("int")
    step = lambda t: F.struct((F.col("frame") - t).alias("at"), F.slice("coef", t * n + 1, n).alias("c"))
    e = coefs.dropDuplicates(["frame", "f", "s"]).select("f", "s", F.inline(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), step)))
    g = e.groupBy(F.col("at").alias("frame"), "f", "s").agg(F.collect_list("c").alias("parts")).filter(F.size("parts") == steps)
    total = F.aggregate("parts", F.array_repeat(F.lit(0.0), F.size(F.col("parts")[0])), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return g.select("frame", "f", "s", total.alias("response"))


def coarse(coefs: DataFrame, shape: tuple[int, int], n_theta: int, to: tuple[int, int]) -> DataFrame:
    """Coefficients and power on a coarser grid of places: ``frame, f, s, re, im, power`` in the order of (x, y, o).

    Power is taken at full resolution and then resized like the two parts (see resize_frames), so that it does not
    cancel out between places. shape and ``to`` are (nx, ny).
    """
    across, along = _resample(shape[0], to[0]), _resample(shape[1], to[1])

    def run(batches):
        for pdf in batches:
            for a in range(0, len(pdf), per := max(1, CELLS // (2 * shape[0] * shape[1] * n_theta))):
                part = pdf.iloc[a : a + per]
                c = np.array(part["coef"].tolist(), np.float64).reshape(len(part), 2, *shape, n_theta)
                c = np.concatenate([c, (c * c).sum(1, keepdims=True)], axis=1)
                c = np.einsum("mx,bkxyo,ny->bkmno", across, c, along, optimize=True).reshape(len(part), 3, -1)
                yield pd.DataFrame({"frame": part["frame"], "f": part["f"], "s": part["s"], "re": list(c[:, 0]), "im": list(c[:, 1]), "power": list(c[:, 2])})

    return coefs.filter(F.size("coef") == 2 * shape[0] * shape[1] * n_theta).select("frame", "f", "s", "coef").mapInPandas(run, "frame long, f int, s int, re array<double>, im array<double>, power array<double>")


def frame_vectors(rows: DataFrame, value: str) -> DataFrame:
    """One vector for each frame, ``frame, vec``: its arrays one after the other, by f and s."""
    lists = F.array_sort(F.collect_list(F.struct("f", "s", F.col(value).alias("v"))))
    return rows.groupBy("frame").agg(F.flatten(F.transform(lists, lambda e: e["v"])).alias("vec"))


def field_image(rf: DataFrame, bank_rows: DataFrame, keys: list[str]) -> DataFrame:
    """A receptive field in pixels: the sum of the filters' weights times the field's value at each filter.

    rf: neuron, keys and ``r``. Result: neuron, ``pixel``, ``value``.
    """
    return rf.join(bank_rows, keys).groupBy("neuron", "pixel").agg(F.sum(F.col("r") * F.col("w")).alias("value"))


def block_mean(frames: DataFrame, nx: int, ny: int, by: int) -> DataFrame:
    """Frames of nx by ny pixels made coarser: the mean of squares of ``by`` pixels, those cut off dropped."""
    e = frames.select("frame", F.posexplode("pixels").alias("p", "v"))
    x, y = F.floor(F.pmod("p", F.lit(nx)) / by), F.floor(F.floor(F.col("p") / nx) / by)
    e = e.withColumn("cx", x.cast("int")).withColumn("cy", y.cast("int")).filter((F.col("cx") < nx // by) & (F.col("cy") < ny // by))
    return e.groupBy("frame", "cx", "cy").agg(F.avg("v").alias("v"))


def resize_frames(frames: DataFrame, shape: tuple[int, int], to: tuple[int, int], *, crop: tuple[int, int, int, int] | None = None, binarise: float | None = 0.5, threshold: float | None = None) -> DataFrame:
    """Threshold, crop, resize without aliasing, and binarise frames (``frame, pixels``, row-major rows x columns).

    The frame is smoothed by a Gaussian of (scale - 1) / 2 along each shrinking axis and sampled linearly at the
    centres of the new pixels. crop is (row0, row1, column0, column1) in pixels.
    """
    r0, r1, c0, c1 = crop or (0, shape[0], 0, shape[1])
    rows, cols = _resample(r1 - r0, to[0]), _resample(c1 - c0, to[1])

    def run(batches):
        for pdf in batches:
            v = np.array(pdf["pixels"].tolist(), np.float64).reshape(-1, *shape)[:, r0:r1, c0:c1]
            if threshold is not None:
                v = (v > threshold).astype(float)
            v = rows @ v @ cols.T
            if binarise is not None:
                v = (np.round(v, 9) >= binarise).astype(float)
            yield pd.DataFrame({"frame": pdf["frame"], "pixels": list(v.reshape(len(v), -1))})

    return frames.filter(F.size("pixels") == shape[0] * shape[1]).select("frame", "pixels").mapInPandas(run, "frame long, pixels array<double>")


def _resample(n: int, m: int) -> np.ndarray:
    """The matrix that smooths and samples one axis of n pixels at m places."""
    scale = n / m
    sigma = max(0.0, (scale - 1) / 2)
    smooth = np.eye(n)
    if sigma > 0:
        reach = int(4 * sigma + 0.5)
        k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
        k /= k.sum()
        smooth = np.zeros((n, n))
        for i in range(n):
            for d, w in zip(range(-reach, reach + 1), k):
                j = (i + d) % max(2 * n - 2, 1)  # mirrored at the middle of the last pixel
                smooth[i, j if j < n else 2 * n - 2 - j] += w
    at = np.clip((np.arange(m) + 0.5) * scale - 0.5, 0, n - 1)
    lo = np.minimum(at.astype(int), max(n - 2, 0))
    pick = np.zeros((m, n))
    pick[np.arange(m), lo] += 1 - (at - lo)
    pick[np.arange(m), np.minimum(lo + 1, n - 1)] += at - lo
    return pick @ smooth
