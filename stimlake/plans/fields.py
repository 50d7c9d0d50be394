"""Queries of filter banks, projections and receptive fields: the embeddings are the movie, 8 by 8 pixels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stimlake import config
from stimlake.operators import correlate as C
from stimlake.operators import gabor as G
from stimlake.operators.models import two_branches
from stimlake.tables import cut, maybe_broadcast, table

NX = NY = 8
RUN = config.settings({"N_thetas": "4", "Sigmas": "[1, 1.5]"}, {"NX": "8", "NY": "8", "Sigmas": "[1, 1.5]", "Analysis Coverage": "[-135, 45, 34, -34]"})
THETAS, SIGMAS, PHASES, COVERAGE = RUN.bank.orientations, list(RUN.bank.sizes), config.offsets(RUN.bank), RUN.run.analysed
N_FEATURES, N_LABELS = NX * NY * THETAS * len(SIGMAS), 10
#: The recorded fields: 6 by 2 places over the same coverage, 8 orientations, one size.
FIELD_RUN = config.settings(None, {"NX": "6", "NY": "2", "Sigmas": "[1]", "Analysis Coverage": "[-135, 45, 34, -34]"}).run


def frames(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").filter("vec_id IS NOT NULL").select(F.col("vec_id").alias("frame"), F.col("embedding").alias("pixels"))


def coefficients(s: SparkSession, d: str) -> DataFrame:
    return G.project(G.sign_frames(frames(s, d)), G.kernels(G.parameters(s, THETAS, SIGMAS, PHASES)), NX, NY)


def responses(s: SparkSession, d: str) -> DataFrame:
    """One neuron for each label: 1 in the frames that have it."""
    return table(s, d, "embeddings").select(F.col("vec_id").alias("frame"), F.transform(F.sequence(F.lit(0), F.lit(N_LABELS - 1)), lambda k: (k == F.col("label")).cast("double")).alias("resp"))


def wavelet_projection(s: SparkSession, d: str) -> DataFrame:
    return G.long_coefficients(coefficients(s, d), NX, NY, THETAS).drop("f").withColumn("coef", F.round("coef", 5))


def _power(s: SparkSession, d: str) -> DataFrame:
    return G.frame_vectors(G.power(coefficients(s, d)), "power")


def _by_feature(rows: DataFrame, value: str) -> DataFrame:
    """One row for each frame and feature, features being numbered by s, x, y, o."""
    e = rows.select("frame", "s", F.posexplode(value).alias("i", value))
    return e.select("frame", (F.col("s") * (NX * NY * THETAS) + F.col("i")).alias("feature"), value)


def wavelet_power(s: SparkSession, d: str) -> DataFrame:
    return _by_feature(G.power(coefficients(s, d)), "power").groupBy("feature").agg(F.round(F.avg("power"), 5).alias("mean_power"), F.round(F.max("power"), 5).alias("max_power"))


def normalised_magnitude(s: SparkSession, d: str) -> DataFrame:
    return _by_feature(G.normalised_magnitude(coefficients(s, d)), "magnitude").withColumn("magnitude", F.round("magnitude", 6))


def coarse_power(s: SparkSession, d: str) -> DataFrame:
    """Coefficients and power of every frame on 4 by 4 places: power is taken first, then made coarser."""
    e = G.coarse(coefficients(s, d), (NX, NY), THETAS, (4, 4)).select("frame", "s", F.posexplode(F.arrays_zip("re", "im", "power")).alias("i", "z"))
    return e.select("frame", "s", F.floor(F.col("i") / 16).cast("int").alias("x"), F.pmod(F.floor(F.col("i") / 4), F.lit(4)).cast("int").alias("y"), F.pmod("i", F.lit(4)).cast("int").alias("o"), *[F.round(f"z.{c}", 5).alias(c) for c in ("re", "im", "power")])


def _field(s: SparkSession, d: str) -> DataFrame:
    r = C.cross_correlation(_power(s, d), responses(s, d), n_features=N_FEATURES, n_neurons=N_LABELS)
    return r.withColumn("r", C.corrected(F.col("r")))


def rf_cross_corr(s: SparkSession, d: str) -> DataFrame:
    return _field(s, d).withColumn("r", F.round("r", 5))


def rf_self_corr(s: SparkSession, d: str) -> DataFrame:
    """Fields of the features themselves, where r of 1 occurs: pixel against pixel of the movie."""
    f = frames(s, d).select("frame", F.transform("pixels", lambda p: p.cast("double")).alias("vec"))
    r = C.cross_correlation(f, f.withColumnRenamed("vec", "resp"), n_features=NX * NY, n_neurons=NX * NY, feature_block=16, neuron_block=16)
    return r.withColumn("r", F.round(C.corrected(F.round("r", 9)), 5))


def _axis_order(field: DataFrame) -> DataFrame:
    """Features renumbered from s, x, y, o to the C-order of x, y, o, s."""
    per, i = NX * NY * THETAS, F.col("feature")
    return field.withColumn("feature", F.pmod(i, F.lit(per)) * len(SIGMAS) + F.floor(i / per))


def rf_peak(s: SparkSession, d: str) -> DataFrame:
    """Peaks of the response fields."""
    f = _axis_order(_field(s, d).withColumn("r", F.round("r", 7)))
    p = C.to_degrees(C.peaks(f, NY, THETAS, len(SIGMAS)), NX, NY, COVERAGE, config.analysed_sizes(RUN.run), THETAS)
    return p.select("neuron", "x", "y", "o", "s", F.round("peak", 5).alias("peak"), *[F.round(c, 6).alias(c) for c in ("azimuth", "elevation", "orientation", "size")])


def preferred_series(s: SparkSession, d: str) -> DataFrame:
    """The course of the power of each neuron's preferred feature over the movie."""
    best = _field(s, d).groupBy("neuron").agg(F.max_by("feature", F.struct(F.round(F.abs("r"), 7), -F.col("feature"))).alias("feature"))
    return C.preferred_series(_power(s, d), best).withColumn("value", F.round("value", 5))


def branch_choice(s: SparkSession, d: str) -> DataFrame:
    """For each neuron whether its strongest feature, the second one or both together say more of its response, fitted on
    every other frame and judged on the rest."""
    power = cut(_power(s, d), "power")
    field = C.cross_correlation(power, responses(s, d), n_features=N_FEATURES, n_neurons=N_LABELS)
    top = cut(C.strongest(field.withColumn("r", F.round(C.corrected(F.col("r")), 7)), 2).select("neuron", "feature", "place"), "top")
    one, two = (C.preferred_series(power, top.filter(F.col("place") == k).select("neuron", "feature")).withColumnRenamed("value", n) for k, n in ((1, "first"), (2, "second")))
    y = responses(s, d).select("frame", F.posexplode("resp").alias("neuron", "y"))
    rows = one.join(two, ["neuron", "frame"]).join(y, ["neuron", "frame"])
    got = two_branches(rows, "neuron", "y", "first", "second", F.pmod("frame", F.lit(2)) == 0)
    return got.select("neuron", "best", "double", "n_test", *[F.round(c, 6).alias(c) for c in ("cc_first", "cc_second", "w_first", "w_second", "cc_both")])


def direction_response(s: SparkSession, d: str) -> DataFrame:
    """Responses to filters that drift by an eighth of a cycle in three frames."""
    k = G.kernels(G.parameters(s, THETAS, SIGMAS[:1], G.drift(0.0, math.pi / 4, 3)))
    e = G.drifting_response(G.project(G.sign_frames(frames(s, d)), k, NX, NY), 3).select("frame", F.posexplode("response").alias("feature", "response"))
    return e.withColumn("response", F.round("response", 5))


def rf_table_peaks(s: SparkSession, d: str) -> DataFrame:
    """Peaks of the recorded fields of all neurons, in degrees."""
    rows = table(s, d, "rf").filter("rfs IS NOT NULL")
    p = C.to_degrees(C.array_peak(rows, "rfs", 2, 8, 1).dropDuplicates(["neuron"]), 6, 2, COVERAGE, config.analysed_sizes(FIELD_RUN))
    return p.select("neuron", "x", "y", "o", "s", F.round("peak", 6).alias("peak"), *[F.round(c, 6).alias(c) for c in ("azimuth", "elevation", "orientation", "size")])


def gabor_bank(s: SparkSession, d: str) -> DataFrame:
    """Every filter by its pixels and energy, and its response to the movie's mean frame."""
    mean = frames(s, d).select(F.posexplode("pixels").alias("pixel", "v")).groupBy("pixel").agg(F.avg("v").alias("mean"))
    bank = G.bank(G.filters(s, NX, NY, THETAS, SIGMAS, PHASES), NX, NY)
    e = bank.join(maybe_broadcast(mean), "pixel").groupBy("x", "y", "o", "s", "phase")
    return e.agg(F.count("*").alias("pixels"), F.round(F.sum(F.col("w") * F.col("w")), 8).alias("energy"), F.round(F.sum(F.col("w") * F.col("mean")), 6).alias("response"))


def field_images(s: SparkSession, d: str) -> DataFrame:
    """Recorded fields drawn in pixels with the bank's even filters: their energy by neuron."""
    rows = table(s, d, "rf").filter("rfs IS NOT NULL").dropDuplicates(["neuron"]).select("neuron", F.posexplode("rfs").alias("i", "r")).withColumn("r", F.coalesce(F.when(~F.isnan("r"), F.col("r").cast("double")), F.lit(0.0)))
    rows = rows.select("neuron", "r", *C.unravel(F.col("i"), 2, 8, 1))
    even = G.bank(G.filters(s, 6, 2, 8, [1.0], [0.0]), 6, 2)
    img = G.field_image(rows, maybe_broadcast(even), ["x", "y", "o", "s"])
    return img.groupBy("neuron").agg(F.round(F.sum(F.col("value") ** 2), 5).alias("energy"), F.round(F.max(F.abs("value")), 6).alias("top"))


def coarse_frames(s: SparkSession, d: str) -> DataFrame:
    return G.block_mean(frames(s, d), NX, NY, 2).withColumn("v", F.round("v", 6))


def frame_downsample(s: SparkSession, d: str) -> DataFrame:
    """Frames thresholded, cropped by a pixel on each side, resized to 3 by 3 and binarised."""
    r = G.resize_frames(frames(s, d), (NY, NX), (3, 3), crop=(1, 7, 1, 7), threshold=0.0)
    return r.select("frame", F.transform("pixels", lambda p: p.cast("int")).alias("pixels")).select("frame", F.array_join(F.transform("pixels", lambda p: p.cast("string")), "").alias("pixels"))


_AXES = "(SELECT CAST(unnest(range(8)) AS INTEGER) AS x), (SELECT CAST(unnest(range(8)) AS INTEGER) AS y), (SELECT o, o * pi() / 4 AS theta FROM (SELECT CAST(unnest(range(4)) AS INTEGER) AS o)), (VALUES (0, 1.0::DOUBLE), (1, 1.5::DOUBLE)) g(s, sigma), (VALUES (0, 0.0::DOUBLE), (1, pi() / 2)) q(phase, off)"


_DRIFT = _AXES.replace("(0, 1.0::DOUBLE), (1, 1.5::DOUBLE)", "(0, 1.0::DOUBLE)").replace("(1, pi() / 2)", "(1, pi() / 8), (2, pi() / 4)")


def _bank_sql(axes: str, nx: int, ny: int) -> str:
    return f"""(SELECT *, exp(-0.5 * (a * a + b * b) / (sigma * sigma)) / (2 * pi() * sigma * sigma) * cos(2 * pi() * (-0.016 * sigma + 0.148) * a + off) AS w FROM (
      SELECT x, y, o, s, phase, sigma, off, CAST((y + c) * {nx} + x + r AS INTEGER) AS pixel, c * cos(theta) + r * sin(theta) AS a, -c * sin(theta) + r * cos(theta) AS b FROM (
        SELECT *, unnest(range(-h, h + 1)) AS c FROM (SELECT *, unnest(range(-h, h + 1)) AS r FROM (SELECT *, CAST(ceil(greatest(3 * sigma * greatest(abs(cos(theta)), abs(sin(theta))), 1.0)) AS INTEGER) AS h FROM {axes})))
      WHERE x + r BETWEEN 0 AND {nx - 1} AND y + c BETWEEN 0 AND {ny - 1}))"""


_BANK = _bank_sql(_AXES, 8, 8)
_PIX = "(SELECT frame, CAST(i - 1 AS INTEGER) AS pixel, CASE WHEN pixels[i] > 0 THEN 1 ELSE -1 END AS v FROM (SELECT vec_id AS frame, embedding AS pixels, unnest(range(1, 65)) AS i FROM embeddings))"
_COEF = f"(SELECT frame, phase, s, x, y, o, sum(w * v) AS coef FROM {_PIX} JOIN {_BANK} USING (pixel) GROUP BY ALL)"
_FEAT = "s * 256 + x * 32 + y * 4 + o"
_POW = f"(SELECT frame, {_FEAT} AS feature, sum(coef * coef) AS p FROM {_COEF} GROUP BY ALL)"
_PEARSON = "coalesce(covar_samp({0}, {1}) / nullif(stddev_samp({0}) * stddev_samp({1}), 0), 0)"
_RF = f"(SELECT neuron, feature, CASE WHEN r >= 0.99 THEN r - 1 ELSE r END AS r FROM (SELECT neuron, feature, {_PEARSON.format('p', 'y')} AS r FROM {_POW} JOIN (SELECT vec_id AS frame, n AS neuron, CAST(label = n AS INTEGER) AS y FROM embeddings, (SELECT unnest(range(10)) AS n)) USING (frame) GROUP BY ALL))"
_DEG = "round(x * 180.0 / {nx} + 45.0, 6) AS azimuth, round(abs(y - {ny}) * 68.0 / {ny} + 34.0, 6) AS elevation, round(CASE WHEN a < 0 THEN a + 180 ELSE a END, 6) AS orientation, {size} AS size"

QUERIES = {
    "gabor_bank": gabor_bank,
    "wavelet_projection": wavelet_projection,
    "wavelet_power": wavelet_power,
    "normalised_magnitude": normalised_magnitude,
    "rf_cross_corr": rf_cross_corr,
    "rf_self_corr": rf_self_corr,
    "rf_peak": rf_peak,
    "rf_table_peaks": rf_table_peaks,
    "field_images": field_images,
    "branch_choice": branch_choice,
    "direction_response": direction_response,
    "coarse_power": coarse_power,
    "preferred_series": preferred_series,
    "coarse_frames": coarse_frames,
    "frame_downsample": frame_downsample,
}
#: Weights that smooth by a Gaussian of half a pixel (mirrored at the middle of the last pixel) and sample at half as many places.
_HALVE = """(SELECT m, k, sum(w) AS w FROM (SELECT m, w, CASE WHEN j < 0 THEN -j WHEN j > {n} - 1 THEN 2 * {n} - 2 - j ELSE j END AS k FROM (
  SELECT m, 2 * m + h + d AS j, 0.5 * exp(-2.0 * d * d) / sum(exp(-2.0 * d * d)) OVER (PARTITION BY m, h) AS w FROM (SELECT unnest(range({n} // 2)) AS m), (SELECT unnest([0, 1]) AS h), (SELECT unnest(range(-2, 3)) AS d))) GROUP BY m, k)"""
_V = "(SELECT DISTINCT ON (neuron) neuron, rfs FROM rf WHERE rfs IS NOT NULL)"
_E = f"(SELECT neuron, i - 1 AS i, CASE WHEN rfs[i] IS NULL OR isnan(rfs[i]) THEN 0 ELSE CAST(rfs[i] AS DOUBLE) END AS r FROM (SELECT neuron, rfs, unnest(range(1, 97)) AS i FROM {_V}))"
_AX6 = "(SELECT CAST(unnest(range(6)) AS INTEGER) AS x), (SELECT CAST(unnest(range(2)) AS INTEGER) AS y), (SELECT o, o * pi() / 8 AS theta FROM (SELECT CAST(unnest(range(8)) AS INTEGER) AS o)), (VALUES (0, 1.0::DOUBLE)) g(s, sigma), (VALUES (0, 0.0::DOUBLE)) q(phase, off)"
SQL = {
    "gabor_bank": f"SELECT x, y, o, s, phase, count(*) AS pixels, round(sum(w * w), 8) AS energy, round(sum(w * mean), 6) AS response FROM {_BANK} JOIN (SELECT CAST(i - 1 AS INTEGER) AS pixel, avg(CAST(embedding[i] AS DOUBLE)) AS mean FROM (SELECT embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY i) USING (pixel) GROUP BY ALL",
    "wavelet_projection": f"SELECT frame, phase, s, x, y, o, round(coef, 5) AS coef FROM {_COEF}",
    "wavelet_power": f"SELECT CAST(feature AS INTEGER) AS feature, round(avg(p), 5) AS mean_power, round(max(p), 5) AS max_power FROM {_POW} GROUP BY feature",
    "normalised_magnitude": f"SELECT frame, CAST(feature AS INTEGER) AS feature, round(m / (1 + sum(m) OVER (PARTITION BY frame)), 6) AS magnitude FROM (SELECT frame, {_FEAT} AS feature, sum(abs(coef)) AS m FROM {_COEF} GROUP BY ALL)",
    "rf_cross_corr": f"SELECT neuron, CAST(feature AS BIGINT) AS feature, round(r, 5) AS r FROM {_RF}",
    "rf_self_corr": f"WITH p AS (SELECT frame, CAST(i - 1 AS BIGINT) AS k, CAST(pixels[i] AS DOUBLE) AS v FROM (SELECT vec_id AS frame, embedding AS pixels, unnest(range(1, 65)) AS i FROM embeddings)) SELECT neuron, feature, round(CASE WHEN r >= 0.99 THEN r - 1 ELSE r END, 5) AS r FROM (SELECT b.k AS neuron, a.k AS feature, round({_PEARSON.format('a.v', 'b.v')}, 9) AS r FROM p a JOIN p b USING (frame) GROUP BY ALL)",
    "rf_peak": f"""WITH f AS (SELECT neuron, CAST(feature % 256 // 32 AS INTEGER) AS x, CAST(feature % 32 // 4 AS INTEGER) AS y, CAST(feature % 4 AS INTEGER) AS o, CAST(feature // 256 AS INTEGER) AS s, round(r, 7) AS r FROM {_RF}),
        k AS (SELECT *, row_number() OVER (PARTITION BY neuron ORDER BY abs(r) DESC, x, y, o, s) AS n FROM f)
        SELECT neuron, x, y, o, s, round(abs(r), 5) AS peak, {_DEG.format(nx=8, ny=8, size="trunc(2 * (180.0 / 8) * (CASE s WHEN 0 THEN 1.0 ELSE 1.5 END) * 100)::DOUBLE / 100")} FROM (SELECT *, degrees(atan((68.0 / 8) / (180.0 / 8) * tan(radians(o * 45.0)))) AS a FROM k WHERE n = 1)""",
    "rf_table_peaks": f"""SELECT neuron, x, y, o, 0 AS s, round(r, 6) AS peak, {_DEG.format(nx=6, ny=2, size="trunc(2 * (180.0 / 6) * 100)::DOUBLE / 100")} FROM (SELECT *, degrees(atan((68.0 / 2) / (180.0 / 6) * tan(radians(o * 22.5)))) AS a FROM (
        SELECT neuron, CAST(i // 16 AS INTEGER) AS x, CAST(i % 16 // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS o, abs(r) AS r, row_number() OVER (PARTITION BY neuron ORDER BY abs(r) DESC, i) AS n FROM {_E}) WHERE n = 1)""",
    "field_images": f"SELECT neuron, round(sum(v * v), 5) AS energy, round(max(abs(v)), 6) AS top FROM (SELECT neuron, pixel, sum(r * w) AS v FROM (SELECT neuron, r, CAST(i // 16 AS INTEGER) AS x, CAST(i % 16 // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS o FROM {_E}) JOIN {_bank_sql(_AX6, 6, 2)} USING (x, y, o) GROUP BY ALL) GROUP BY neuron",
    "coarse_power": f"""WITH h AS {_HALVE.format(n=8)}, c AS (SELECT frame, s, x, y, o, sum(coef) FILTER (phase = 0) AS re, sum(coef) FILTER (phase = 1) AS im, sum(coef * coef) AS p FROM {_COEF} GROUP BY ALL)
        SELECT frame, s, CAST(a.m AS INTEGER) AS x, CAST(b.m AS INTEGER) AS y, o, round(sum(a.w * b.w * re), 5) AS re, round(sum(a.w * b.w * im), 5) AS im, round(sum(a.w * b.w * p), 5) AS power FROM c JOIN h a ON a.k = c.x JOIN h b ON b.k = c.y GROUP BY frame, s, a.m, b.m, o""",
    "branch_choice": f"""WITH p AS MATERIALIZED (SELECT * FROM {_POW}), k AS (SELECT neuron, feature, row_number() OVER (PARTITION BY neuron ORDER BY abs(round(r, 7)) DESC, feature) AS n FROM {_RF}),
        a AS (SELECT a.neuron, x.frame, x.p AS a, z.p AS b, CAST(e.label = a.neuron AS DOUBLE) AS y, x.frame % 2 = 0 AS t FROM k a JOIN k b ON a.neuron = b.neuron AND a.n = 1 AND b.n = 2 JOIN p x ON x.feature = a.feature JOIN p z ON z.feature = b.feature AND z.frame = x.frame JOIN embeddings e ON e.vec_id = x.frame),
        c AS (SELECT neuron, covar_pop(a, a) FILTER (t) AS taa, covar_pop(b, b) FILTER (t) AS tbb, covar_pop(a, b) FILTER (t) AS tab, covar_pop(a, y) FILTER (t) AS tay, covar_pop(b, y) FILTER (t) AS tby,
          covar_pop(a, a) FILTER (NOT t) AS haa, covar_pop(b, b) FILTER (NOT t) AS hbb, covar_pop(a, b) FILTER (NOT t) AS hab, covar_pop(a, y) FILTER (NOT t) AS hay, covar_pop(b, y) FILTER (NOT t) AS hby, covar_pop(y, y) FILTER (NOT t) AS hyy, count(*) FILTER (NOT t) AS n_test FROM a GROUP BY neuron),
        w AS (SELECT *, (tay * tbb - tby * tab) / (taa * tbb - tab * tab) AS w1, (tby * taa - tay * tab) / (taa * tbb - tab * tab) AS w2, hay / sqrt(haa * hyy) AS c1, hby / sqrt(hbb * hyy) AS c2 FROM c),
        b AS (SELECT *, (w1 * hay + w2 * hby) / sqrt((w1 * w1 * haa + 2 * w1 * w2 * hab + w2 * w2 * hbb) * hyy) AS c12 FROM w)
        SELECT neuron, CASE WHEN c1 >= c2 THEN 1 ELSE 2 END AS best, c12 > greatest(c1, c2) AS double, n_test, round(c1, 6) AS cc_first, round(c2, 6) AS cc_second, round(w1, 6) AS w_first, round(w2, 6) AS w_second, round(c12, 6) AS cc_both FROM b""",
    "direction_response": f"""WITH c AS (SELECT frame - phase AS frame, x, y, o, sum(w * v) AS coef FROM {_PIX} JOIN {_bank_sql(_DRIFT, 8, 8)} USING (pixel) GROUP BY frame, phase, x, y, o)
        SELECT frame, CAST(x * 32 + y * 4 + o AS INTEGER) AS feature, round(sum(coef), 5) AS response FROM c GROUP BY frame, x, y, o HAVING count(*) = 3""",
    "preferred_series": f"WITH k AS (SELECT neuron, arg_max(feature, (round(abs(r), 7), -feature)) AS feature FROM {_RF} GROUP BY neuron) SELECT neuron, frame, round(p, 5) AS value FROM k JOIN {_POW} USING (feature)",
    "frame_downsample": f"""WITH h AS {_HALVE.format(n=6)}, v AS (SELECT vec_id AS frame, i % 8 - 1 AS x, i // 8 - 1 AS y, CAST(embedding[i + 1] > 0 AS INTEGER) AS v FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings) WHERE i % 8 BETWEEN 1 AND 6 AND i // 8 BETWEEN 1 AND 6),
        z AS (SELECT frame, a.m AS my, b.m AS mx, CAST(round(sum(a.w * b.w * v), 9) >= 0.5 AS INTEGER) AS v FROM v JOIN h a ON a.k = v.y JOIN h b ON b.k = v.x GROUP BY ALL) SELECT frame, string_agg(v, '' ORDER BY my, mx) AS pixels FROM z GROUP BY frame""",
    "coarse_frames": "SELECT frame, CAST(p % 8 // 2 AS INTEGER) AS cx, CAST(p // 16 AS INTEGER) AS cy, round(avg(v), 6) AS v FROM (SELECT vec_id AS frame, i - 1 AS p, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)) GROUP BY ALL",
}
