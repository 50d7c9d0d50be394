"""Similarity clusters of located vectors by grid density.

Features are quantised: the position into squares as wide as two clusters, the direction of the vector into the
sides of projections. Two grids are laid, shifted by half a square, so that one of them holds what the other cuts
apart. A square is split by direction only as far as it is too full to be compared whole: into groups of at most
about ``ROOM`` points for a task, inside a task into leaves of at most ``LEAF`` points. So the number of splits
follows from the counted occupancy of each square, and where there are splits there are as many different ones
(``tables``) as keep the chance that a smallest cluster is cut apart in all of them under ``MISS``. In a leaf
the density around each point is counted exactly; concordant neighbourhoods are the dense cells. All adjacent dense
cells (near in place and direction) are joined, and minimum labels are propagated along the joins to convergence. A
part that is wider than a cluster may be, because cells between two clusters tie them together, is parted again: each
of its cells goes with the densest one in its reach. The sums of a label's cells are its cluster, whose members are
then checked exactly: a point belongs to the most similar cluster it fits, by cosine and by distance from the
centre, and the clusters' means follow their members. Clusters are reported by size and by the members nearest to
their densest cell.

How it is spread: points go to their squares and groups once for each grid and table; all that follows from
them is computed there. Groups that points or cells meet their surroundings in are salted by their counted size, so a
crowded place is many tasks. Joins of cells leave such a group as a forest, never as pairs. Vectors travel as one byte
an element (cosines are exact to about ``ROUGH``); points that near the bound are decided on their own vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stimlake.llm.knn import unit_rows
from stimlake.tables import bucket, cut, maybe_broadcast, parts

#: Members that one task compares with prototypes at a time.
GROUP_ROWS = 40_000
#: Points of a square that one task searches for dense places, and those compared pairwise at a time.
ROOM, LEAF = 32_768, 1024
#: Accepted chance that no table keeps two members of a smallest cluster together.
MISS = 0.005
#: Cells of a square that one task compares with their surroundings at a time.
GROUP_CELLS = 4096
#: Stands for no cell.
NONE = np.iinfo(np.int64).min
#: Greatest error of a cosine of packed vectors.
ROUGH = 0.006


def pack(u: np.ndarray) -> list[bytes]:
    """Unit vectors as one byte an element."""
    top = np.abs(u).max(1, keepdims=True, initial=1e-12)
    return [x.tobytes() for x in np.round(u / np.maximum(top, 1e-12) * 127).astype(np.int8)]


def unpack(b: pd.Series, dim: int) -> np.ndarray:
    """Unit vectors from their bytes."""
    x = np.frombuffer(b"".join(b), np.int8).reshape(-1, dim).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _vectors(x: pd.Series, dim: int) -> np.ndarray:
    return np.array(x.tolist(), dtype=np.float32).reshape(-1, dim)


SUMS = "{key} long, n long, y double, x double, least long, s array<float>"


def _sum_rows(key: np.ndarray, n: np.ndarray, y: np.ndarray, x: np.ndarray, least: pd.Series, v: np.ndarray, name: str) -> pd.DataFrame:
    """Sums of weights, positions and vectors of each key."""
    k, at = np.unique(key, return_inverse=True)
    per = np.bincount(at, minlength=len(k))
    order = np.argsort(at, kind="stable")
    sums = np.add.reduceat(v[order], np.cumsum(per) - per, axis=0) if len(k) else v
    return pd.DataFrame({name: k, "n": np.bincount(at, n, len(k)).astype(np.int64), "y": np.bincount(at, y, len(k)), "x": np.bincount(at, x, len(k)), "least": least.groupby(at).min().to_numpy(), "s": list(sums)})


def _partial_sums(df: DataFrame, key: str, dim: int) -> DataFrame:
    """Sums of the vectors and positions of each key, one row for each key and input batch."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield _sum_rows(pdf[key].to_numpy(), np.ones(len(pdf)), pdf["y"].to_numpy(), pdf["x"].to_numpy(), pdf["id"], unpack(pdf["b"], dim), key)

    return df.select(key, "id", "y", "x", "b").mapInPandas(run, SUMS.format(key=key))


MEANS = "{key} long, n long, cy double, cx double, least long, length double, m array<float>"


def _to_means(sums: pd.DataFrame, key: str, dim: int) -> pd.DataFrame:
    s, n = _vectors(sums["s"], dim).astype(np.float64), sums["n"].to_numpy()
    return pd.DataFrame({key: sums[key], "n": n, "cy": sums["y"] / n, "cx": sums["x"] / n, "least": sums["least"], "length": np.linalg.norm(s, axis=1) / n, "m": list(_unit(s).astype(np.float32))})


def _means(sums: DataFrame, key: str, dim: int, rows: int) -> DataFrame:
    """Means of each key from partial sums: size, centre, unit mean direction and its length."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _to_means(_sum_rows(pdf[key].to_numpy(), pdf["n"].to_numpy(), pdf["y"].to_numpy(), pdf["x"].to_numpy(), pdf["least"], _vectors(pdf["s"], dim), key), key, dim)

    return sums.select(key, "n", "y", "x", "least", "s").groupBy(bucket(parts(rows, 20_000, 4), key).alias("g")).applyInPandas(run, MEANS.format(key=key))


def tables(splits: int, least_cosine: float, least_size: int) -> int:
    """How many different splits into ``2 ** splits`` parts keep the chance of missing a smallest cluster under MISS.

    A member is on the same side as the mean direction with probability 1 - angle / pi.
    """
    q = (1 - math.acos(max(-1.0, min(1.0, least_cosine))) / math.pi) ** splits
    missed = (1 - q) ** least_size + least_size * q * (1 - q) ** (least_size - 1)
    return 1 if missed <= MISS else math.ceil(math.log(MISS) / math.log(missed))


def _distinct(n: np.ndarray, yx: np.ndarray, m: np.ndarray, radius: float, least_cosine: float) -> np.ndarray:
    """The densest of each neighbourhood of dense places, densest first."""
    left, kept = np.argsort(-n, kind="stable"), []
    while len(left):
        i = left[0]
        kept.append(i)
        near = (m[left] @ m[i] >= least_cosine) & (((yx[left] - yx[i]) ** 2).sum(1) <= radius**2)
        near[0] = True
        left = left[~near]
    return np.array(kept, int)


def _leaf(u: np.ndarray, yx: np.ndarray, radius: float, least_cosine: float, bound: float) -> tuple[np.ndarray, ...]:
    """Dense places among a few points: sizes, centres, unit mean directions and their lengths.

    Each point's neighbourhood is moved twice to the mean of what is near it; ``bound`` is the least mean cosine
    between the members of a concordant one.
    """

    def near(m: np.ndarray, at: np.ndarray, cosine: float, reach: float) -> np.ndarray:
        far = (at[:, :1] - yx[:, 0]) ** 2
        far += (at[:, 1:] - yx[:, 1]) ** 2
        return (m @ u.T >= cosine) & (far <= reach**2)

    full = np.hstack([u, yx])
    d = u.shape[1]
    ok = near(u, yx, bound - 0.03, radius)
    ok = ok[ok.sum(1) > 1]
    for cosine in (least_cosine - 0.05, least_cosine):
        s = ok.astype(np.float32) @ full
        n = ok.sum(1)
        ok = near(_unit(s[:, :d]), s[:, d:] / np.maximum(n, 1)[:, None], cosine, radius)
        ok = ok[ok.sum(1) > 1]
    s, n = ok.astype(np.float32) @ full, ok.sum(1)
    length = np.linalg.norm(s[:, :d], axis=1) / np.maximum(n, 1)
    good = (n > 1) & ((n * length**2 - 1) / np.maximum(n - 1, 1) >= bound)
    n, s, length = n[good], s[good], length[good]
    m, at = _unit(s[:, :d]), s[:, d:] / np.maximum(n, 1)[:, None]
    k = _distinct(n, at, m, radius, least_cosine)
    return n[k], at[k], m[k], length[k]


def _leaves(u: np.ndarray, rng: np.random.Generator, splits: int):
    """Rows of the parts that halving at medians of random projections gives."""
    todo = [(np.arange(len(u)), splits)]
    while todo:
        rows, k = todo.pop()
        if not k:
            yield rows
            continue
        side = np.argsort(u[rows] @ rng.standard_normal(u.shape[1]).astype(np.float32), kind="stable")
        todo += [(rows[side[: len(rows) // 2]], k - 1), (rows[side[len(rows) // 2 :]], k - 1)]


def dense_places(u: np.ndarray, y: np.ndarray, x: np.ndarray, radius: float, least_cosine: float, least_size: int, seed: int) -> tuple[np.ndarray, ...]:
    """Dense places of the points of a square: sizes, centres, unit mean directions and their lengths."""
    # members at the bound of the cosine to their mean have this mean cosine to each other
    bound = (least_size * least_cosine**2 - 1) / (least_size - 1)
    origin = np.array([y.min(), x.min()]) if len(u) else np.zeros(2)
    yx = (np.column_stack([y, x]) - origin).astype(np.float32)
    splits = max(0, math.ceil(math.log2(max(len(u), 1) / LEAF)))
    rng, got = np.random.default_rng(seed), []
    # a median may lie nearer to a cluster than a fixed plane does: one table more
    for _ in range(tables(splits, least_cosine, least_size) + (splits > 0)):
        got += [_leaf(u[rows], yx[rows], radius, least_cosine, bound) for rows in _leaves(u, rng, splits)]
    n, at, m, length = (np.concatenate(z) for z in zip(*got))
    k = _distinct(n, at, m, radius, least_cosine) if len(got) > 1 else np.arange(len(n))
    return n[k], at[k] + origin, m[k], length[k]


def _tied(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots of the parts of a graph after edges between a and b have been added."""
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[root]
        if np.array_equal(new, root):
            return root
        root = new


def _label_means(seeds: DataFrame, labels: DataFrame, dim: int, n: int) -> DataFrame:
    """Means of the cells of each label, each cell with its weight."""

    def sums(batches):
        for pdf in batches:
            w = pdf["n"].to_numpy(float)
            yield pd.DataFrame({"label": pdf["label"], "n": pdf["n"], "y": pdf["cy"] * w, "x": pdf["cx"] * w, "least": pdf["label"], "s": list(_vectors(pdf["m"], dim) * (w * pdf["length"].to_numpy())[:, None].astype(np.float32))})

    summed = seeds.join(labels, seeds.cell == labels.node).select("label", "n", "cy", "cx", "length", "m").mapInPandas(sums, SUMS.format(key="label"))
    return _means(summed, "label", dim, max(n // 50, 1))


def propagate(edges: DataFrame) -> DataFrame:
    """Minimum labels of the connected parts of an undirected graph.

    edges: ``a, b`` BIGINT, an edge of a node to itself for a lone node. Result: ``node, label``. Labels are
    propagated along the edges until none changes; every round is written to the shared folder.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a IS NOT NULL AND b IS NOT NULL").distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("other"))
        # the label of one's label is a shortcut over long chains
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = labels.join(heard, "node", "left").join(jump, "label", "left").select("node", F.least("label", "other", "far").alias("label"), F.col("label").alias("was"))
        step = cut(step, "labels")
        labels = step.select("node", "label")
        if not step.filter("label <> was").limit(1).count():
            return labels


def located_clusters(places: DataFrame, vectors: DataFrame, *, dim: int, radius: float = 100.0, least_cosine: float = 0.85, least_size: int = 8, seed: int = 11) -> DataFrame:
    """Clusters of points that lie near each other and whose vectors point the same way.

    places: ``id`` BIGINT, ``y, x`` DOUBLE; vectors: ``id`` and ``vec`` ARRAY of ``dim`` numbers. A cluster has
    at least ``least_size`` points; all lie within ``radius`` of its centre and have a cosine of at least
    ``least_cosine`` to its mean direction.

    Result, one row for each member: ``id, cluster`` (the smallest id in it), ``size, cosine`` (to the mean
    direction), ``distance`` (from the centre), ``to_top`` (cosine to the densest cell). Points in no cluster have no
    row.

    Points whose id, y or x is null or NaN, or whose vec is null, of another length or all zero, belong to none;
    NaN elements count as 0. Of repeated ids one row counts. Empty tables give an empty result.
    """
    at = places.select(F.col("id").cast("long"), F.col("y").cast("double"), F.col("x").cast("double")).filter("id IS NOT NULL AND abs(y) < 1e12 AND abs(x) < 1e12").dropDuplicates(["id"])
    v = vectors.select(F.col("id").cast("long"), F.col("vec").cast("array<float>")).filter((F.size("vec") == dim) & F.exists("vec", lambda e: (e != 0) & ~F.isnan(e)))

    def to_bytes(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "b": pack(unit_rows(pdf["vec"], dim))})

    packed = v.mapInPandas(to_bytes, "id long, b binary").dropDuplicates(["id"])
    return _cluster_packed(at.join(packed, "id"), v, dim, radius, least_cosine, least_size, seed)


def _cluster_packed(packed: DataFrame, vectors: DataFrame, dim: int, radius: float, least_cosine: float, least_size: int, seed: int) -> DataFrame:
    wide = 4 * radius
    base = cut(packed, "points")
    n = base.count()
    place = lambda c, w: F.floor(F.col(c) / w)
    shifted = lambda c: F.floor(F.col(c) / wide + F.col("g") / 2)
    placed = base.withColumn("g", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("gy", shifted("y")).withColumn("gx", shifted("x"))
    splits = F.ceil(F.log2(F.col("count") / ROOM)).cast("int")
    full = cut(placed.groupBy("g", "gy", "gx").count().filter(F.col("count") > ROOM).select("g", "gy", "gx", splits.alias("splits")), "full")
    deepest = full.agg(F.max("splits")).first()[0] or 0
    code = F.lit(0)
    if deepest:
        copies = [tables(k, least_cosine, least_size) for k in range(deepest + 1)]
        planes = np.random.default_rng(seed).standard_normal((max(copies), dim, deepest)).astype(np.float32)
        some = base.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, n // 4096))) == 0).select("b").limit(8192).toPandas()  # bounded: where the planes pass
        middle = np.median(np.einsum("nd,tdk->ntk", unpack(some["b"], dim), planes), axis=0) if len(some) else np.zeros((max(copies), deepest))
        rest = [c for c in placed.columns if c != "b"]

        def sides(batches):
            for pdf in batches:
                u, t, k = unpack(pdf["b"], dim), pdf["table"].to_numpy(), pdf["splits"].to_numpy()
                code = np.zeros(len(pdf), np.int64)
                for i in np.unique(t[k > 0]):
                    at = (t == i) & (k > 0)
                    code[at] = ((u[at] @ planes[i] > middle[i]) @ (1 << np.arange(deepest, dtype=np.int64))) & ((1 << k[at].astype(np.int64)) - 1)
                yield pdf[[*rest, "b", "table"]].assign(code=code)

        placed = placed.join(maybe_broadcast(full), ["g", "gy", "gx"], "left").withColumn("splits", F.coalesce("splits", F.lit(0)))
        placed = placed.withColumn("table", F.explode(F.sequence(F.lit(0), F.element_at(F.array(*map(F.lit, copies)), F.col("splits") + 1) - 1)))
        placed = placed.select(*rest, "b", "table", "splits").mapInPandas(sides, "id long, y double, x double, g int, gy long, gx long, b binary, table int, code long")
        code = F.struct("table", "code")
    groups = placed.select(F.xxhash64("g", "gy", "gx", code).alias("key"), "y", "x", "b").repartition(parts(2 * n, 20_000, 8), "key")

    def seek(pdf: pd.DataFrame) -> pd.DataFrame:
        key = int(pdf["key"].iloc[0])
        pdf = pdf.sort_values(["y", "x", "b"])
        size, at, m, length = dense_places(unpack(pdf["b"], dim), pdf["y"].to_numpy(), pdf["x"].to_numpy(), radius, least_cosine, least_size, seed)
        with np.errstate(over="ignore"):
            cell = np.int64(key) + np.arange(len(size), dtype=np.int64)
        return pd.DataFrame({"cell": cell, "n": size.astype(np.int64), "cy": at[:, 0], "cx": at[:, 1], "length": length.astype(float), "m": pd.Series(list(m.astype(np.float32)), dtype=object)})

    seeds = cut(groups.groupBy("key").applyInPandas(seek, "cell long, n long, cy double, cx double, length double, m array<float>"), "dense")

    def around(df: DataFrame, cy: Column, cx: Column, w: float) -> DataFrame:
        """Each row in its own square of width w and the eight around it."""
        near = F.explode(F.array([F.struct((F.floor(cy / w) + a).alias("gy"), (F.floor(cx / w) + b).alias("gx")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
        return df.select("*", near.alias("sq")).select(*df.columns, "sq.gy", "sq.gx")

    def salted(own: DataFrame, near: DataFrame, room: int) -> tuple[DataFrame, DataFrame]:
        """Rows of a square by a salt that keeps about ``room`` together, and those around it with every salt."""
        crowded = own.groupBy("gy", "gx").count().filter(F.col("count") > room).select("gy", "gx", F.ceil(F.col("count") / room).cast("int").alias("salts"))
        crowded = maybe_broadcast(cut(crowded, "crowded"))
        salts = F.coalesce(F.col("salts"), F.lit(1))
        key = "id" if "id" in own.columns else "cell"
        own = own.join(crowded, ["gy", "gx"], "left").withColumn("salt", F.pmod(F.xxhash64(key), salts).cast("int")).drop("salts")
        near = near.join(crowded, ["gy", "gx"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        return own, near.toDF(*near.columns)  # columns of its own: both sides may come from one table

    keys = ["gy", "gx", "salt"]
    cells = seeds.select("cell", "n", "cy", "cx", "m")
    own, near = salted(cells.withColumns({"gy": place("cy", radius), "gx": place("cx", radius)}), around(cells, F.col("cy"), F.col("cx"), radius), GROUP_CELLS)

    def join_cells(mine: dict[str, np.ndarray], near: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Each cell with the least cell it is tied to here by any adjacent cells, and with the densest one in reach."""
        fall = np.lexsort((near["cell"], -near["n"]))
        cell, m, cy, cx = (near[c][fall] for c in ("cell", "m", "cy", "cx"))
        rank = np.argsort(cell)
        at = rank[np.searchsorted(cell[rank], mine["cell"])]
        root, densest = np.arange(len(cell)), np.empty(len(at), np.int64)
        for i in range(0, len(at), 512):
            own = slice(i, i + 512)
            ok = mine["m"][own] @ m.T >= least_cosine
            ok &= (mine["cy"][own, None] - cy) ** 2 + (mine["cx"][own, None] - cx) ** 2 <= radius**2
            ok[np.arange(len(ok)), at[own]] = True
            densest[own] = cell[ok.argmax(1)]
            row, col = np.nonzero(ok)
            root = _tied(root, at[own][row], col)
        least = cell.copy()
        np.minimum.at(least, root, cell)
        least = least[root]
        # one edge for each cell that is tied to another: a forest, whatever the number of adjacent pairs
        tied = np.flatnonzero(least != cell)
        return {"a": np.r_[mine["cell"], cell[tied]], "b": np.r_[mine["cell"], least[tied]], "densest": np.r_[densest, np.full(len(tied), NONE)]}

    group = bucket(parts(n, 20_000, 8), *keys).alias("bucket")

    def arrays(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        made = {c: pdf[c].to_numpy() for c in pdf.columns if c not in ("b", "m", "top")}
        made |= {c: _vectors(pdf[c], dim) for c in ("m", "top") if c in pdf.columns}
        return made | ({"b": pdf["b"].to_numpy(), "u": unpack(pdf["b"], dim)} if "b" in pdf.columns else {})

    def by_square(f, columns: list[str]):
        """f on the two sides of each square and salt of a bucket."""

        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            x, y = arrays(a), arrays(b)
            there = b.groupby(keys).indices if len(b) else {}
            got = [f({c: v[i] for c, v in x.items()}, {c: v[there[k]] for c, v in y.items()}) for k, i in (a.groupby(keys).indices if len(a) else {}).items() if k in there]
            return pd.DataFrame({c: np.concatenate([g[c] for g in got]) if got else [] for c in columns})

        return run

    joined = cut(own.groupBy(group).cogroup(near.groupBy(group)).applyInPandas(by_square(join_cells, ["a", "b", "densest"]), "a long, b long, densest long"), "joins")
    labels = propagate(joined.select("a", "b"))
    # parts too wide to be one cluster: every cell goes with the densest in its reach
    wide_label = cells.join(labels, cells.cell == labels.node).join(_label_means(seeds, labels, dim, n).select("label", F.col("cy").alias("ly"), F.col("cx").alias("lx"), F.col("m").alias("lm")), "label")
    off = (F.hypot(F.col("cy") - F.col("ly"), F.col("cx") - F.col("lx")) > radius) | (F.aggregate(F.zip_with("m", "lm", lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda t, x: t + x) < least_cosine)
    too_wide = cut(wide_label.filter(off).select("label").distinct(), "wide")
    if too_wide.limit(1).count():
        parted = labels.join(too_wide, "label").join(joined.filter(F.col("densest") != NONE), F.col("node") == F.col("a")).select("a", F.col("densest").alias("b"))
        labels = labels.join(too_wide, "label", "left_anti").select("node", "label").unionByName(propagate(parted))

    labels = cut(labels, "labels")
    prototypes = cut(_label_means(seeds, labels, dim, n).select("label", "cy", "cx", "m"), "prototypes")
    top = Window.partitionBy("label").orderBy(F.col("n").desc(), "cell")
    tops = seeds.join(labels, seeds.cell == labels.node).withColumn("k", F.row_number().over(top)).filter("k = 1").select("label", F.col("m").alias("top"))

    def assign(means: DataFrame, strict: bool = True) -> DataFrame:
        """Each point with the most similar of the clusters it fits by cosine and distance; unless ``strict``, one that
        fits none goes with the most similar in a wider reach."""
        reach, least = (radius, least_cosine - ROUGH) if strict else (1.5 * radius, 2 * least_cosine - 1)
        mine = base.select("id", "y", "x", "b", place("y", reach).alias("gy"), place("x", reach).alias("gx"))
        mine, about = salted(mine, around(means.select("label", "cy", "cx", "m", "top"), F.col("cy"), F.col("cx"), reach), GROUP_ROWS)

        def fit(pts: dict[str, np.ndarray], protos: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            order = np.argsort(protos["label"], kind="stable")
            label, m, top, cy, cx = (protos[c][order] for c in ("label", "m", "top", "cy", "cx"))
            u, n_pts = pts["u"], len(pts["u"])
            best, cos, far, ok = np.zeros(n_pts, np.int64), np.zeros(n_pts), np.zeros(n_pts), np.zeros(n_pts, bool)
            for i in range(0, n_pts, 4096):
                r = slice(i, i + 4096)
                c, d = u[r] @ m.T, np.hypot(pts["y"][r, None] - cy, pts["x"][r, None] - cx)
                # those that fit come before all others
                rank = np.where((c >= least_cosine - ROUGH) & (d <= radius), c + 2, np.where((c >= least) & (d <= reach), c, -4))
                best[r] = rank.argmax(1)
                rank, cos[r], far[r] = (np.take_along_axis(z, best[r][:, None], 1)[:, 0] for z in (rank, c, d))
                ok[r] = rank > -4
            best = best[ok]
            return {"id": pts["id"][ok], "label": label[best], "y": pts["y"][ok], "x": pts["x"][ok], "b": pts["b"][ok], "cosine": cos[ok], "distance": far[ok], "to_top": (u[ok] * top[best]).sum(1)}

        return mine.groupBy(group).cogroup(about.groupBy(group)).applyInPandas(by_square(fit, ["id", "label", "y", "x", "b", "cosine", "distance", "to_top"]), "id long, label long, y double, x double, b binary, cosine double, distance double, to_top double")

    def refit(rows: DataFrame, least: int) -> DataFrame:
        means = _means(_partial_sums(rows, "label", dim), "label", dim, max(n // 50, 1)).filter(F.col("n") >= least)
        return cut(means.join(tops, "label"), "means")

    # all points are offered to every mean around them after each refit; a cluster goes only when it is too small
    # with all that could be its members
    first = refit(assign(prototypes.join(tops, "label"), strict=False), least_size // 2)
    second = refit(assign(first), least_size)
    final = cut(assign(second).select("id", "label", "cosine", "distance", "to_top"), "members")
    # near the bound the vectors themselves decide
    unsure = cut(final.filter(F.abs(F.col("cosine") - least_cosine) <= ROUGH), "unsure")
    exact = vectors.join(maybe_broadcast(unsure), "id").dropDuplicates(["id"]).join(second.select("label", "m"), "label")
    clean = F.transform("vec", lambda e: F.coalesce(F.nanvl(e.cast("double"), F.lit(0.0)), F.lit(0.0)))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    exact = exact.withColumn("vec", clean).withColumn("cosine", dot("vec", "m") / F.sqrt(dot("vec", "vec"))).select(*final.columns)
    sure = final.filter(F.col("cosine") > least_cosine + ROUGH).unionByName(exact.filter(F.col("cosine") >= least_cosine))
    sure = cut(sure, "sure")
    named = sure.groupBy("label").agg(F.min("id").alias("cluster"), F.count("*").alias("size")).filter(F.col("size") >= least_size)
    return sure.join(named, "label").select("id", "cluster", "size", "cosine", "distance", "to_top")


def describe(members: DataFrame, typical: int = 3) -> DataFrame:
    """Each cluster by its size and its most typical members, those nearest to its densest cell.

    members: the result of located_clusters. Result: ``cluster, size, mean_cosine, typical`` (ids, most typical
    first, equal ones by id).
    """
    place = F.row_number().over(Window.partitionBy("cluster", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy(F.col("to_top").desc(), "id"))
    # of each of 64 parts of a cluster only the best can be among the best of the whole
    best = members.withColumn("place", place).filter(F.col("place") <= typical).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct((-F.col("to_top")).alias("c"), "id"))).alias("best"))
    size = members.groupBy("cluster").agg(F.first("size").alias("size"), F.avg("cosine").alias("mean_cosine"))
    return size.join(best, "cluster").select("cluster", "size", "mean_cosine", F.transform(F.slice("best", 1, typical), lambda b: b["id"]).alias("typical"))
