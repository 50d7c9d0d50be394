"""Filling containers of a fixed number of tokens with texts: mixture-controlled packing.

The texts of each source form a queue in the order of their hash, so that long and short ones are spread evenly; its
first ``FRONT`` texts can be served. Deficit round-robin over the queues fills one window after the other: each window
credits every source with its target share of the capacity, and the source with the greatest deficit gives the longest
text that ``CREDIT`` times the deficit covers. Long texts gather at the front until their source has saved up for them, and the others
make up for it. When no deficit covers a text, the source with the greatest one runs into debt, by as little as
possible. The last gap of a window is closed by the one or two texts of any sources whose lengths fill it best, found
among all lengths there are; of equally good ones those of the greatest deficits. What a source got too much or too
little is carried to the next window.

How it is spread: texts are counted in tokens once, map-only. Their lengths (not the texts) are split by hash
into shards of about ``shard_items``, packed side by side. A shard stops when its windows no longer fill up
and carries its rest (at most ``carry`` texts) and its deficits on; ``fan_in`` shards are packed on together
until one is left. No text is dropped, and only texts longer than a container are split.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stimlake.tables import bucket, cut, parts

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this tokenizer splits a text before merging bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Sources that take turns; their names and deficits are in every task. Memory of a task grows with its texts only.
MAX_SOURCES = 10_000
#: How many times its deficit a text may be long: a source is then as often too far ahead as behind.
CREDIT = 1.5
#: Texts of each source that can be served at a time, and equally good pairs that are weighed for a gap.
FRONT, PAIRS = 5, 24


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a rank file; read once in each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, tokens`` of each document; a null text has no tokens, a null source is ''."""

    def run(batches):
        encode = encoding(path).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": [len(encode(t)) if t else 0 for t in pdf["text"]]})

    d = documents.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("source"), F.col("text").cast("string"))
    return d.mapInPandas(run, "doc_id long, source string, tokens long")


class Shelf:
    """Texts by source, in order, and by length; what has been taken by one way is skipped by the other."""

    def __init__(self, lengths: np.ndarray, source: np.ndarray, n_sources: int, capacity: int):
        self.lengths, self.source = lengths.tolist(), source.tolist()
        self.taken = np.zeros(len(lengths), bool)
        self.counts = np.bincount(lengths, minlength=capacity + 1)
        self.queues = [np.flatnonzero(source == s)[::-1].tolist() for s in range(n_sources)]
        self.front: list[list[int]] = [[] for _ in range(n_sources)]
        order = np.argsort(lengths, kind="stable")
        self.of_length: dict[int, list[int]] = {}
        for n, own in zip(*_split(lengths[order], order)):
            self.of_length[int(n)] = own.tolist()
        for s in range(n_sources):
            self.refill(s)

    def refill(self, s: int) -> None:
        front, queue = self.front[s], self.queues[s]
        while len(front) < FRONT and queue:
            i = queue.pop()
            if not self.taken[i]:
                front.append(i)

    def covered(self, s: int, most: float) -> int:
        """The longest of a source's first texts that is not longer than ``most``, -1 if there is none."""
        return max((i for i in self.front[s] if self.lengths[i] <= most), key=self.lengths.__getitem__, default=-1)

    def over(self, s: int, least: float, most: int) -> int:
        """The shortest of a source's first texts that is longer than ``least`` and not longer than ``most``, or -1."""
        return min((i for i in self.front[s] if least < self.lengths[i] <= most), key=self.lengths.__getitem__, default=-1)

    def take(self, i: int) -> int:
        self.taken[i] = True
        n, s = self.lengths[i], self.source[i]
        self.counts[n] -= 1
        if i in self.front[s]:
            self.front[s].remove(i)
            self.refill(s)
        return n

    def of(self, n: int, deficit: np.ndarray, but: int = -1) -> int:
        """A text of this length, of the last few of them the one whose source has the greatest deficit."""
        own = self.of_length[n]
        while self.taken[own[-1]]:
            own.pop()
        k, best = len(own), -1
        for _ in range(8):
            k -= 1
            while k >= 0 and (self.taken[own[k]] or own[k] == but):
                k -= 1
            if k < 0:
                break
            if best < 0 or deficit[self.source[own[k]]] > deficit[self.source[best]]:
                best = own[k]
        return best

    def closing(self, room: int, deficit: np.ndarray) -> list[int]:
        """The one or two texts that fill the room best; of equally good ones those of the greatest deficits."""
        there = np.flatnonzero(self.counts[1 : room + 1]) + 1
        if not len(there):
            return []
        at = np.searchsorted(there, room - there, side="right") - 1
        at -= (at >= 0) & (there[np.maximum(at, 0)] == there) & (self.counts[there] == 1)  # a text is no pair with itself
        both = np.where(at >= 0, there + there[np.maximum(at, 0)], there)
        if there[-1] == room or both.max() == there[-1]:
            return [self.of(int(there[-1]), deficit)]
        best = np.flatnonzero((both == both.max()) & (at >= 0))
        best = best[np.linspace(0, len(best) - 1, min(len(best), PAIRS)).astype(int)]
        pairs, gains = [], []
        for i in best:
            a = self.of(int(there[i]), deficit)
            b = self.of(int(there[at[i]]), deficit, a)
            pairs.append([a, b])
            left = {}
            for k in (a, b):
                left[self.source[k]] = left.get(self.source[k], deficit[self.source[k]]) - self.lengths[k]
            gains.append(sum(abs(deficit[k]) - abs(v) for k, v in left.items()))
        return pairs[int(np.argmax(gains))]


def _split(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    k, first = np.unique(keys, return_index=True)
    return k, np.split(values, first[1:]) if len(k) else []


def pack(lengths: np.ndarray, source: np.ndarray, shares: np.ndarray, deficit: np.ndarray, capacity: int, carry: int, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of each text (-1: carried on) and the deficits after the last window.

    Texts are served in the order given. Windows are emitted as long as they lack at most ``slack`` tokens, or more
    than ``carry`` texts are left.
    """
    window = np.full(len(lengths), -1, np.int64)
    window[lengths == 0] = 0  # texts without tokens need no room
    real = np.flatnonzero(lengths > 0)
    shelf = Shelf(lengths[real], source[real], len(shares), capacity)
    deficit = deficit.astype(float).copy()
    left, w = len(real), 0
    while left:
        before, taken, room = deficit.copy(), [], capacity
        deficit += shares * capacity
        while room:
            some = []
            order = np.argsort(-deficit, kind="stable")
            for s in order:
                if deficit[s] < 1:
                    break
                if (i := shelf.covered(s, min(room, CREDIT * deficit[s]))) >= 0:
                    some = [i]
                    break
            else:
                order = order[:0]
            if not some and len(order):
                i = shelf.over(order[0], deficit[order[0]], room)
                some = [i] if i >= 0 else []
            rest = room - shelf.lengths[some[0]] if some else -1
            if rest < 0 or (rest and not shelf.counts[1 : rest + 1].any()):
                some = shelf.closing(room, deficit)  # no text of the front fits, or it would leave a gap
            if not some:
                break
            for i in some:
                n = shelf.take(i)
                taken.append(i)
                deficit[shelf.source[i]] -= n
                room -= n
        if room > slack and left <= carry:
            return window, before  # the texts of this window are carried on with the rest
        window[real[taken]] = w
        left -= len(taken)
        # sources that have run out keep no claim, and no claim exceeds four windows
        deficit = np.where([bool(f) for f in shelf.front], np.clip(deficit, -4 * capacity, 4 * capacity), 0.0)
        w += 1
    return window, deficit


def pack_texts(sizes: DataFrame, *, capacity: int = 8192, shares: dict[str, float] | None = None, shard_items: int = 50_000, carry: int = 1_000, fan_in: int = 32, slack: int = 0) -> DataFrame:
    """Put texts into containers.

    sizes: ``doc_id`` BIGINT, ``source`` STRING, ``tokens`` BIGINT. shares: the target proportion of each source's
    tokens; by default those of the table itself, so that all sources last to the end.

    Result, one row for each piece: ``container, doc_id, part, first_token, tokens, source``. A text that exceeds
    the capacity is split into full containers and a rest; every other text is one piece. The tokens of a
    container never exceed the capacity.

    Rows with a null id or a negative or null size are an error of the caller and are left out. Texts without
    tokens get a container but no room. Repeated ids are packed each. An empty table gives an empty result.
    """
    s = sizes.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("source"), F.col("tokens").cast("long")).filter("doc_id IS NOT NULL AND tokens >= 0")
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("tokens") / capacity), F.lit(1)) - 1)
    p = s.select("doc_id", "source", F.explode(pieces).alias("part"), F.col("tokens").alias("all")).withColumn("first_token", F.col("part") * capacity)
    p = p.select("doc_id", "source", "part", "first_token", F.least(F.lit(capacity), F.col("all") - F.col("first_token")).cast("int").alias("tokens"))
    totals = p.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError("more sources than deficit round-robin can serve; group them first")
    index = {r.source: i for i, r in enumerate(totals)}
    given = shares if shares is not None else {r.source: r.tokens for r in totals}
    weight = np.array([max(float(given.get(r.source, 0)), 0.0) for r in totals])
    weight = weight / weight.sum() if weight.sum() > 0 else np.full(len(totals), 1 / max(len(totals), 1))
    n_shards = parts(sum(r.n for r in totals), shard_items)
    schema = "level int, shard int, window long, turn long, doc_id long, part long, first_token long, tokens int, source string, deficits array<double>"

    def packer(level: int, last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            claims = [x for x in pdf["deficits"] if x is not None]
            pdf = pdf[pdf["doc_id"].notna()].sort_values(["turn", "doc_id", "part"], kind="stable").reset_index(drop=True)
            start = np.sum([np.asarray(c, float) for c in claims], axis=0) if claims else np.zeros(len(weight))
            src = pdf["source"].map(index).to_numpy(np.int64)
            window, deficit = pack(pdf["tokens"].to_numpy(np.int64), src, weight, start, capacity, 0 if last else carry, slack)
            out = pdf.assign(level=level, window=window, deficits=None)
            end = {"level": level, "shard": shard_of(pdf, level), "window": -1, "deficits": list(deficit)}
            return pd.concat([out, pd.DataFrame([end])], ignore_index=True)[[c.split()[0] for c in schema.split(", ")]]

        def shard_of(pdf, level):
            return pdf["shard"].iloc[0] if len(pdf) else 0

        return run

    todo = p.withColumn("turn", F.xxhash64("part", "doc_id")).withColumn("shard", bucket(n_shards, "doc_id", "part")).withColumn("deficits", F.lit(None).cast("array<double>"))
    level, done = 0, None
    while True:
        last = n_shards == 1
        packed = cut(todo.select("shard", "turn", "doc_id", "part", "first_token", "tokens", "source", "deficits").groupBy("shard").applyInPandas(packer(level, last), schema), "packed")
        full = packed.filter("window >= 0")
        done = full if done is None else done.unionByName(full)
        if last:
            break
        n_shards = parts(n_shards, fan_in)
        todo = packed.filter("window < 0").withColumn("shard", F.floor(F.col("shard") / fan_in).cast("int"))
        level += 1
    container = F.concat_ws("-", F.col("level"), F.col("shard"), F.col("window"))
    return done.select(container.alias("container"), "doc_id", "part", "first_token", "tokens", "source")


def mixtures(packed: DataFrame, capacity: int = 8192) -> DataFrame:
    """How full each container is and how near to the target its mixture of sources.

    packed: the result of pack_texts with the target shares of the whole. Result: ``container, tokens, unused, pieces,
    sources, off`` (half the sum of the differences between its shares and the target's) and ``run_off``: by how many
    tokens the source that is furthest off has got too many or too few so far in its shard.
    """
    by = packed.groupBy("container", "source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    target = by.groupBy("source").agg(F.sum("t").alias("all"))
    total = F.sum("all").over(Window.partitionBy())  # a row for each source
    target = target.select("source", F.coalesce(F.try_divide("all", total), F.lit(0.0)).alias("share"))
    # the shares travel as one row, an array of at most MAX_SOURCES
    every = target.groupBy(F.lit(0).alias("one")).agg(F.array_sort(F.collect_list(F.struct("source", "share"))).alias("targets"))
    whole = by.groupBy("container").agg(F.lit(0).alias("one"), F.sum("t").alias("tokens"), F.sum("n").alias("pieces"), F.count("*").alias("sources"), F.map_from_entries(F.collect_list(F.struct("source", "t"))).alias("got"))
    e = whole.join(F.broadcast(every), "one")
    e = e.select("container", "tokens", "pieces", "sources", F.inline(F.transform("targets", lambda z: F.struct(z["source"].alias("source"), z["share"].alias("share"), F.coalesce(F.try_element_at("got", z["source"]), F.lit(0)).alias("t")))))
    place = F.split("container", "-")
    w = Window.partitionBy(place[0], place[1], "source").orderBy(place[2].cast("long")).rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("run", F.sum(F.col("t") - F.col("share") * F.col("tokens")).over(w))
    off = F.sum(F.abs(F.coalesce(F.try_divide("t", "tokens"), F.col("share")) - F.col("share"))) / 2
    return e.groupBy("container").agg(F.first("tokens").alias("tokens"), (F.lit(capacity) - F.first("tokens")).alias("unused"), F.first("pieces").alias("pieces"), F.first("sources").alias("sources"), F.round(off, 6).alias("off"), F.round(F.max(F.abs("run")), 3).alias("run_off"))
