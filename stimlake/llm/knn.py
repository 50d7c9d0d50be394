"""Most similar vectors by a permutation index.

Each vector is represented by the ordered list of its nearest pivots and posted once, in the part of the index
that belongs to its nearest pivot. A part holds the inverted files of its vectors: for every pivot the vectors in
whose list it stands, and at which place. A query goes to the parts of its own nearest pivots only; there the
postings of its pivots are gathered, candidates are ranked by the footrule distance between the pivot orders, and
the best ones are reranked by their exact cosine. The best of all parts are the result.

How it is spread: the number of pivots grows with the square root of the number of vectors, so parts and the work
of a query grow with that root, and no part of the index meets all queries. The nearest pivots themselves are found
through runs of near pivots, at a cost that grows with the fourth root. One pass counts what each part will
hold; parts above ``block_rows`` vectors are salted, neighbouring small ones share a task, and a task that too
many queries visit is split by query. The second pass shuffles every vector once and each query to the few tasks
that hold its parts. Only the k best of each query and task are shuffled further. Copies of a vector are thinned
out before the shuffle: of equal vectors only the k + 1 least ids can be among any k best.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stimlake.tables import maybe_broadcast

#: Most pivots; their table (6 MB at 96 elements) goes to every task.
MAX_PIVOTS = 16_384
#: Runs of near pivots in which the nearest pivots of a vector are looked for; twice as many for a query.
RUNS = 8
#: Queries (one number each) up to which their table is broadcast; more are joined by shuffle.
MAX_ASKED = 2_000_000
#: Scores of queries and candidates that a task holds at a time.
CELLS = 2_000_000


def unit_rows(values: pd.Series, dim: int) -> np.ndarray:
    """Vectors as rows of length 1; NaN and null elements count as 0, rows of another length or of zeros stay 0."""
    out = np.zeros((len(values), dim), np.float32)
    fits = np.flatnonzero([x is not None and len(x) == dim for x in values])
    if len(fits):
        out[fits] = np.stack([np.asarray(x, np.float32) for x in values.to_numpy()[fits]])
    return to_unit(out)


def to_unit(out: np.ndarray) -> np.ndarray:
    out = np.where(np.isfinite(out), out, np.float32(0))
    big = np.abs(out).max(1, keepdims=True, initial=0)
    out /= np.where(big > 0, big, 1)
    norm = np.linalg.norm(out.astype(np.float64), axis=1)
    return (out / np.where(norm > 0, norm, 1)[:, None]).astype(np.float32)


class Pivots:
    """Pivots in runs of near ones, of about the root of their number each.

    The nearest pivots of a vector are looked for in the runs whose means are nearest to it, so its cost grows with
    the root of the number of pivots.
    """

    def __init__(self, pivots: np.ndarray):
        self.all = line_up(pivots)
        self.run = max(1, math.ceil(math.sqrt(len(self.all))))
        self.middles = np.stack([self.all[i : i + self.run].mean(0) for i in range(0, len(self.all), self.run)]) if len(self.all) else self.all

    def __len__(self) -> int:
        return len(self.all)

    def nearest(self, x: np.ndarray, length: int, runs: int | None) -> np.ndarray:
        """The ``length`` nearest pivots of each row, nearest first, out of the ``runs`` nearest runs (None: of all)."""
        if runs is not None:
            runs = max(runs, math.ceil(length / self.run) + 1)
        if runs is None or runs >= len(self.middles):
            at, s = None, x @ self.all.T
        else:
            near = np.argpartition(-(x @ self.middles.T), runs - 1, axis=1)[:, :runs]
            s = np.full((len(x), runs, self.run), -4, np.float32)
            order = np.argsort(near, axis=None, kind="stable")
            ends = np.searchsorted(near.ravel()[order], np.arange(len(self.middles) + 1))
            for k in np.flatnonzero(np.diff(ends)):
                row, place = np.divmod(order[ends[k] : ends[k + 1]], runs)
                own = self.all[k * self.run : (k + 1) * self.run]
                s[row, place, : len(own)] = x[row] @ own.T
            at = (near[:, :, None] * self.run + np.arange(self.run)).reshape(len(x), runs * self.run)
            s = s.reshape(len(x), runs * self.run)
        top = np.argpartition(-s, length - 1, axis=1)[:, :length] if length < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(x), 1))
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
        return top if at is None else np.take_along_axis(at, top, 1)


def line_up(pivots: np.ndarray) -> np.ndarray:
    """The pivots in an order in which near ones stand near each other: halved again and again across their widest direction."""
    done, todo = [], [np.arange(len(pivots))]
    while todo:
        rows = todo.pop()
        if len(rows) <= 2:
            done.append(rows)
            continue
        c = pivots[rows] - pivots[rows].mean(0)
        way = c[np.argmax((c * c).sum(1))]
        for _ in range(6):
            way = c.T @ (c @ way)
            way /= np.linalg.norm(way) or 1
        rows = rows[np.argsort(c @ way, kind="stable")]
        todo += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]
    return pivots[np.concatenate(done)]


def groups_of(rows: np.ndarray) -> np.ndarray:
    """Number of the group of equal rows that each row of integers belongs to."""
    flat = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
    return np.unique(flat, return_inverse=True)[1].ravel()


def thin_copies(x: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Rows to post: each id once, and of vectors that agree to about 0.000001 the ``keep`` least ids."""
    if not len(ids):
        return np.zeros(0, int)
    of = groups_of(np.round(x * (1 << 20)).astype(np.int32))
    order = np.lexsort((ids, of))
    o, i = of[order], ids[order]
    once = np.r_[True, (o[1:] != o[:-1]) | (i[1:] != i[:-1])]
    order, o = order[once], o[once]
    first = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
    return np.sort(order[np.arange(len(o)) - np.repeat(first, np.diff(np.r_[first, len(o)])) < keep])


def copies(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ordered so that copies follow each other, and where each group of them begins and how many it has.

    Vectors are copies if their elements agree to about 0.0002, so that those of another gain do in spite of rounding.
    """
    of = groups_of(np.round(x * 4096).astype(np.int16))
    n = np.bincount(of)
    return np.argsort(of, kind="stable"), np.cumsum(n) - n, n


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


def search_part(x: np.ndarray, perm: np.ndarray, ids: np.ndarray, q: np.ndarray, q_perm: np.ndarray, n_pivots: int, candidates: int | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top k of a part of the index for each query: query row, vector row, cosine; equal cosines by rising id."""
    rows, begin, count = copies(x)
    lists, first = perm[rows[begin]], x[rows[begin]]
    n, length = lists.shape
    longest = max(length, q_perm.shape[1])
    flat = lists.ravel()
    order = np.argsort(flat, kind="stable")  # the postings of all pivots, one after the other
    ends = np.searchsorted(flat[order], np.arange(n_pivots + 1))
    doc, place = order // length, order % length
    got = []
    for a in range(0, len(q), max(1, CELLS // max(n, 1))):
        asked = q_perm[a : a + max(1, CELLS // max(n, 1))]
        lo, hits = ends[asked].ravel(), (ends[asked + 1] - ends[asked]).ravel()
        at = ranges(lo, hits)
        rank = np.repeat(np.tile(np.arange(asked.shape[1]), len(asked)), hits)
        who = np.repeat(np.arange(len(asked)), (ends[asked + 1] - ends[asked]).sum(1))
        # footrule: what a common pivot saves against one that the other list lacks, which counts as past the end
        saved = 2 * (longest - np.maximum(rank, place[at]))
        score = np.bincount(who * n + doc[at], saved, len(asked) * n).reshape(len(asked), n)
        fit = score > 0
        if candidates is not None and n > candidates:
            # with all that are tied with the last
            fit &= score >= np.partition(score, n - candidates, axis=1)[:, n - candidates, None]
        # rerank: the k best candidates, and what is tied with the last of them but for rounding
        cos = np.where(fit, q[a : a + len(asked)] @ first.T, np.float32(-9))
        last = np.partition(cos, n - k, axis=1)[:, n - k, None] if n > k else np.float32(-9)
        i, j = np.nonzero(fit & (cos >= last - 1e-6))
        m = count[j]
        some, mine = rows[ranges(begin[j], m)], a + np.repeat(i, m)
        got.append((mine, some, np.einsum("ij,ij->i", x[some], q[mine], dtype=np.float64)))
    if not got:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    i, j, cos = (np.concatenate(z) for z in zip(*got))
    fall = np.lexsort((-cos, i))
    i, j, cos = i[fall], j[fall], cos[fall]
    # copies that differ by rounding only have the cosine of the first of them
    level = np.cumsum(np.r_[True, (i[1:] != i[:-1]) | (cos[:-1] - cos[1:] > 3e-7)]) - 1
    cos = np.maximum.reduceat(cos, np.flatnonzero(np.r_[True, level[1:] != level[:-1]]))[level] if len(cos) else cos
    best = np.lexsort((ids[j], level))
    i, j, cos = i[best], j[best], cos[best]
    begin = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
    top = np.arange(len(i)) - np.repeat(begin, np.diff(np.r_[begin, len(i)])) < k
    return i[top], j[top], cos[top]


@dataclass(frozen=True)
class Layout:
    """Which tasks hold which parts of the index."""

    #: first block of each pivot's part, one more at the end
    first: np.ndarray
    #: task group of each block
    group: np.ndarray
    #: first task of each group, one more at the end
    task: np.ndarray

    @classmethod
    def of(cls, vectors: np.ndarray, visits: np.ndarray, block_rows: int, query_rows: int) -> Layout:
        salts = np.maximum(1, -(-vectors // block_rows))
        first = np.r_[0, np.cumsum(salts)]
        size = np.repeat(vectors / salts, salts)
        group = ((np.cumsum(size) - size) // block_rows).astype(np.int64)
        group = np.unique(group, return_inverse=True)[1].ravel()
        asked = np.bincount(group, np.repeat(visits, salts))
        return cls(first, group, np.r_[0, np.cumsum(np.maximum(1, np.ceil(asked / query_rows))).astype(np.int64)])

    @property
    def tasks(self) -> int:
        return int(self.task[-1])

    def homes(self, part: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and tasks of vectors: one block each, in all tasks that its group is split into."""
        salts = self.first[part + 1] - self.first[part]
        g = self.group[self.first[part] + (pd.util.hash_array(ids) % salts.astype(np.uint64)).astype(np.int64)]
        n = self.task[g + 1] - self.task[g]
        return np.repeat(np.arange(len(ids)), n), ranges(self.task[g], n)

    def visited(self, visited: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and tasks of queries: one task of each group that holds a block of a part they visit."""
        start = self.first[visited].ravel()
        n = self.first[visited + 1].ravel() - start
        row = np.repeat(np.repeat(np.arange(len(ids)), visited.shape[1]), n)
        pairs = np.unique(np.column_stack([row, self.group[ranges(start, n)]]), axis=0)
        row, g = pairs[:, 0], pairs[:, 1]
        split = (self.task[g + 1] - self.task[g]).astype(np.uint64)
        return row, self.task[g] + ((pd.util.hash_array(ids)[row] >> np.uint64(17)) % split).astype(np.int64)


def most_similar(vectors: DataFrame, queries: DataFrame, *, dim: int, k: int = 5, pivots_per_root: float = 1.6, length: int | None = 16, visits: int | None = 32, candidates: int | None = 64, block_rows: int = 16_384, query_rows: int = 65_536) -> DataFrame:
    """The k vectors with the greatest cosine for each query.

    vectors: ``id`` BIGINT and ``vec`` ARRAY; queries: ``id`` of vectors. Other columns are ignored.
    There are ``pivots_per_root`` times the root of the number of vectors pivots (at most MAX_PIVOTS), vectors drawn
    by the hash of their id; every vector is indexed, by the ``length`` nearest of them. ``visits`` is the number of
    parts that a query goes to, ``candidates`` how many are reranked for each query and part: more of them raise
    recall, which tests measure against brute force. With None for all three the search is exact: every part is
    visited and every vector in it is reranked.

    Result: ``id, other, cosine, place`` with place 1..k by falling cosine, equal cosines (to six decimals) by
    rising id. A query has fewer rows only if fewer vectors share a pivot with it.

    Null and NaN elements count as 0; null vectors, vectors of another length than ``dim`` and all-zero ones
    take no part, nor do null ids. Of repeated ids one row counts. Empty tables give an empty result.
    """
    v = vectors.select(F.col("id").cast("long"), F.col("vec").cast("array<float>"))
    q = queries.select(F.col("id").cast("long")).filter(F.col("id").isNotNull()).distinct()
    n = vectors.count()
    want = min(MAX_PIVOTS, max(16, math.ceil(pivots_per_root * math.sqrt(n))))
    # a threshold on the hash leaves about twice the pivots, so that no task sends more than its share of them
    few = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < math.ceil((1 << 40) * min(1.0, 2 * want / max(n, 1)))
    usable = F.col("id").isNotNull() & (F.size("vec") == dim) & F.exists("vec", lambda e: (e != 0) & ~F.isnan(e))
    sample = v.filter(few).filter(usable).dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(want).select("vec").toPandas()  # bounded: the pivots
    base = unit_rows(sample["vec"], dim)
    base = Pivots(base[np.unique(np.round(base * 4096), axis=0, return_index=True)[1]])  # copies are one pivot
    runs, q_runs = (None, None) if visits is None else (RUNS, 2 * RUNS)
    length = max(1, min(length or len(base), len(base)))
    reach = max(1, min(visits or len(base), len(base)))
    longest = max(length, reach)
    asked = v.filter("id IS NOT NULL AND vec IS NOT NULL").join(maybe_broadcast(q.withColumn("asked", F.lit(True)), MAX_ASKED), "id", "left")

    def rows_of(pdf: pd.DataFrame):
        """Usable rows of a batch: raw and unit vectors, ids, which are queries, and which are posted."""
        vec = pdf["vec"].to_numpy()
        fits = np.fromiter((len(x) == dim for x in vec), bool, len(vec))
        raw = np.stack([np.asarray(x, np.float32) for x in vec[fits]]) if fits.any() else np.zeros((0, dim), np.float32)
        x = to_unit(raw)
        ids, is_query = pdf["id"].to_numpy()[fits], pdf["asked"].notna().to_numpy()[fits]
        some = x.any(1)
        raw, x, ids, is_query = raw[some], x[some], ids[some], is_query[some]
        once = np.zeros(len(ids), bool)
        once[np.unique(ids, return_index=True)[1]] = True
        return raw, x, ids, np.flatnonzero(is_query & once), thin_copies(x, ids, k + 1)

    def count(batches):
        held, asking = np.zeros(len(base), np.int64), np.zeros(len(base), np.int64)
        for pdf in batches:
            _, x, _, who, posted = rows_of(pdf)
            if len(x):
                held += np.bincount(base.nearest(x[posted], 1, runs)[:, 0], minlength=len(base))
                asking += np.bincount(base.nearest(x[who], reach, q_runs).ravel(), minlength=len(base))
        some = np.flatnonzero(held + asking)
        yield pd.DataFrame({"part": some, "held": held[some], "asking": asking[some]})

    held, asking = np.zeros(max(1, len(base)), np.int64), np.zeros(max(1, len(base)), np.int64)
    if len(base):
        counted = asked.mapInPandas(count, "part int, held long, asking long").groupBy("part").agg(F.sum("held").alias("held"), F.sum("asking").alias("asking")).toPandas()  # bounded: a row for each pivot
        held[counted["part"]], asking[counted["part"]] = counted["held"], counted["asking"]
    plan = Layout.of(held, asking, block_rows, query_rows)

    def post(batches):
        for pdf in batches:
            raw, x, ids, who, posted = rows_of(pdf)
            if not len(x) or not len(base):
                continue
            perm, q_perm = base.nearest(x, length, runs).astype(np.int16), base.nearest(x[who], longest, q_runs).astype(np.int16)
            home, task = plan.homes(perm[posted, 0].astype(np.int64), ids[posted])
            home = posted[home]
            go, to = plan.visited(q_perm[:, :reach].astype(np.int64), ids[who])
            row = np.r_[home, who[go]]
            is_query = np.r_[np.zeros(len(home), bool), np.ones(len(go), bool)]
            lists = [perm[i].tobytes() for i in home] + [q_perm[i].tobytes() for i in go]
            yield pd.DataFrame({"task": np.r_[task, to].astype(np.int32), "asking": is_query, "id": ids[row], "vec": [raw[i].tobytes() for i in row], "pivots": lists})

    def search(batches):
        rows = [pdf for pdf in batches if len(pdf)]
        if not rows:
            return
        rows = pd.concat(rows, ignore_index=True)
        is_query = rows["asking"].to_numpy()
        side = lambda own, wide: (to_unit(np.frombuffer(b"".join(rows["vec"][own]), np.float32).reshape(-1, dim)), np.frombuffer(b"".join(rows["pivots"][own]), np.int16).reshape(-1, wide).astype(np.int64), rows["id"].to_numpy()[own])
        x, perm, ids = side(~is_query, length)
        q, q_perm, q_ids = side(is_query, longest)
        once = np.unique(ids, return_index=True)[1]
        x, perm, ids = x[once], perm[once], ids[once]
        order = np.argsort(perm[:, 0], kind="stable")
        x, perm, ids = x[order], perm[order], ids[order]
        ends = np.searchsorted(perm[:, 0], np.arange(len(base) + 1))
        came = q_perm[:, :reach]
        by_part = np.argsort(came.ravel(), kind="stable")
        starts = np.searchsorted(came.ravel()[by_part], np.arange(len(base) + 1))
        for part in np.flatnonzero((np.diff(ends) > 0) & (np.diff(starts) > 0)):
            here, mine = slice(ends[part], ends[part + 1]), by_part[starts[part] : starts[part + 1]] // reach
            i, j, cos = search_part(x[here], perm[here], ids[here], q[mine], q_perm[mine], len(base), candidates, k + 1)
            i, j = q_ids[mine[i]], ids[here][j]
            ok = i != j
            yield pd.DataFrame({"id": i[ok], "other": j[ok], "cosine": cos[ok]})

    # the task of each row is known: tasks stay this size whatever spark.sql.shuffle.partitions says
    posted = asked.mapInPandas(post, "task int, asking boolean, id long, vec binary, pivots binary").repartitionById(plan.tasks, "task")
    near = posted.mapInPandas(search, "id long, other long, cosine double").repartition("id").groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.round("cosine", 6).desc(), "other"))
    return near.withColumn("place", place).filter(F.col("place") <= k)
