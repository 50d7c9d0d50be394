"""Evaluation texts in training texts, by a distributed positional inverted index.

The index is made of shards, each the inverted file of some documents: for a term the documents and word
positions at which it stands. Only terms of the test items are posted, as no other can take part in a match.
It is written to the shared folder; its document frequencies say how rare each test term is in the whole
corpus. Every stretch of ``window`` words of an item is then looked for from its rarest term: the term's
postings are intersected with those of the neighbouring words, shifted by their offset, until the match ends
on both sides.

How it is spread: building a shard and intersecting in it are map-only; the corpus is never shuffled, and no
list of a frequent term is ever gathered in one place, as each shard has its own part of it. The test items
go to every task; their number of characters is checked against ``MAX_TEST_CHARS``, and a larger set is refused
(it may be given in parts, but then wording that items of different parts share counts).
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stimlake.tables import cut

MAX_TEST_CHARS = 50_000_000
SHARD_CHARS = 4_000_000
#: Postings of anchors that are followed at a time.
SLICE = 500_000
WORD = re.compile(r"\w+")
ESCAPE = re.compile(r"\\+(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|[nrtvfab0])")


def words(text: str | None) -> list[str]:
    """Words of a text: runs of letters, digits and underscores in lower case, escape sequences undone."""
    if not text:
        return []
    if "\\" in text:
        text = ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else " ", text)
    return WORD.findall(text.lower())


class TestSet:
    """Items as arrays: the term ids of all items one after the other, and which windows are an item's own."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.window = window
        self.vocabulary: dict[str, int] = {}
        seqs = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(t)]) for i, t in items]
        self.item = np.array([i for i, s in seqs for _ in s], np.int64)
        self.terms = np.array([w for _, s in seqs for w in s], np.int64)
        owner: dict[tuple, int] = {}
        at = 0
        starts = []
        for i, s in seqs:
            for j in range(len(s) - window + 1):
                k = tuple(s[j : j + window])
                owner[k] = i if owner.get(k, i) == i else -1
                starts.append((at + j, k))
            at += len(s)
        self.own = np.zeros(len(self.terms), bool)  # whether the window that starts here stands in one item only
        for g, k in starts:
            self.own[g] = owner[k] != -1
        self.own_before = np.r_[0, np.cumsum(self.own)]
        self.common = np.zeros(len(self.terms), bool)  # whether the word is part of wording that stands in several items
        for g, k in starts:
            if owner[k] == -1:
                self.common[g : g + window] = True

    def anchors(self, frequency: np.ndarray) -> np.ndarray:
        """For each window that is an item's own, the position of its rarest term."""
        g = np.flatnonzero(self.own)
        if not len(g):
            return g
        inside = g[:, None] + np.arange(self.window)
        return np.unique(inside[np.arange(len(g)), frequency[self.terms[inside]].argmin(1)])


def build_index(documents: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """Positional inverted files of the documents for the terms of a vocabulary.

    documents: ``doc_id`` BIGINT and ``text`` STRING; rows without an id or text have no postings. Result, one
    row for each shard: ``docs`` (its documents), ``lengths`` (their words), ``terms`` in rising order, ``df``
    (in how many of its documents each stands), ``ends`` (where its postings end), ``doc`` and ``pos`` (place
    in docs and word position of each posting).
    """

    def run(batches):
        get = vocabulary.get
        docs, lengths, tids, tdoc, tpos, chars = [], [], [], [], [], 0

        def shard():
            t, d, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (tids, tdoc, tpos))
            order = np.argsort(t, kind="stable")  # documents and positions are in rising order already
            t, d, p = t[order], d[order], p[order]
            terms, first = np.unique(t, return_index=True)
            ends = np.r_[first[1:], len(t)]
            fresh = np.r_[True, (t[1:] != t[:-1]) | (d[1:] != d[:-1])] if len(t) else np.zeros(0, bool)
            df = np.add.reduceat(fresh, first) if len(t) else np.zeros(0, int)
            return pd.DataFrame({"docs": [np.array(docs, np.int64)], "lengths": [np.array(lengths, np.int32)], "terms": [terms.astype(np.int32)], "df": [df.astype(np.int32)], "ends": [ends.astype(np.int32)], "doc": [d.astype(np.int32)], "pos": [p.astype(np.int32)]})

        for pdf in batches:
            for i, text in zip(pdf["doc_id"], pdf["text"]):
                w = words(text)
                ids = np.array([get(x, -1) for x in w], np.int64)
                at = np.flatnonzero(ids >= 0)
                tids.append(ids[at])
                tpos.append(at)
                tdoc.append(np.full(len(at), len(docs), np.int64))
                docs.append(i)
                lengths.append(len(w))
                chars += len(text)
                if chars > SHARD_CHARS:
                    yield shard()
                    docs, lengths, tids, tdoc, tpos, chars = [], [], [], [], [], 0
        if docs:
            yield shard()

    d = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    return d.mapInPandas(run, "docs array<long>, lengths array<int>, terms array<int>, df array<int>, ends array<int>, doc array<int>, pos array<int>")


def intersect(shard: dict[str, np.ndarray], test: TestSet, anchors: np.ndarray, slop: int, near_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Matches of the test set in one shard: place of the document, item, words in a row, words near.

    slop 0 gives exact phrases only; else a match of at least ``near_terms`` words, each within ``slop``
    positions of where it stands in the item, is a proximity match.
    """
    none = np.zeros(0, np.int64)
    if not len(shard["terms"]) or not len(anchors):
        return none, none, none, none
    # one line of positions for all documents, with gaps that no phrase or proximity can cross
    gap = test.window + slop + 1
    base = np.cumsum(np.r_[0, shard["lengths"][:-1].astype(np.int64) + gap]) + gap
    line = int(base[-1] + shard["lengths"][-1] + gap)
    count = np.diff(np.r_[0, shard["ends"]])
    at = base[shard["doc"]] + shard["pos"]
    keys = np.repeat(shard["terms"].astype(np.int64), count) * line + at  # sorted

    def stands(term: np.ndarray, where: np.ndarray) -> np.ndarray:
        k = term * line + where
        i = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        return keys[i] == k

    # candidates: postings of the anchors' terms against the anchors' positions in the items
    which = np.searchsorted(shard["terms"], test.terms[anchors])
    ok = (which < len(shard["terms"])) & (shard["terms"][np.minimum(which, len(shard["terms"]) - 1)] == test.terms[anchors])
    anchors, which = anchors[ok], which[ok]
    total = len(test.terms)

    def grow(anchors: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, ...]:
        """Matches that some of the anchors lead to."""
        n = count[which]
        g = np.repeat(anchors, n)
        p = (np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)) + np.repeat((shard["ends"] - count)[which], n)
        pos = at[p]
        reach = {}
        for sign in (-1, 1):
            far = np.zeros(len(g), np.int64)
            alive = np.arange(len(g))
            step = 1
            while len(alive):
                h = g[alive] + sign * step
                fits = (h >= 0) & (h < total)
                alive, h = alive[fits], h[fits]
                fits = test.item[h] == test.item[g[alive]]
                alive, h = alive[fits], h[fits]
                alive = alive[stands(test.terms[h], pos[alive] + sign * step)]
                far[alive] = step
                step += 1
            reach[sign] = far
        left, right = g - reach[-1], g + reach[1]
        last = np.maximum(right - test.window + 2, left)  # past the last start of a whole window
        hit = (test.own_before[np.minimum(last, total)] - test.own_before[left]) > 0
        run = right - left + 1
        near = np.zeros(len(g), np.int64)
        if slop:
            for o in range(-test.window + 1, test.window):
                h = np.clip(g + o, 0, total - 1)
                same = (test.item[h] == test.item[g]) & (h == g + o)
                k = test.terms[h] * line + pos + o
                near += same & ~test.common[h] & (np.searchsorted(keys, k - slop) < np.searchsorted(keys, k + slop + 1))
            hit |= near >= near_terms
        return shard["doc"][p[hit]].astype(np.int64), test.item[g[hit]], run[hit], near[hit]

    # an anchor's term may stand in a shard very often: some anchors at a time
    cuts = np.flatnonzero(np.diff((np.cumsum(count[which]) - count[which]) // SLICE)) + 1
    found = [grow(a, w) for a, w in zip(np.split(anchors, cuts), np.split(which, cuts))]
    return tuple(np.concatenate(x) for x in zip(*found))


def find_leaks(documents: DataFrame, items: DataFrame, *, window: int = 12, slop: int = 0, near_terms: int = 12) -> DataFrame:
    """Documents that contain passages of test items.

    documents: ``doc_id`` BIGINT, ``text`` STRING; items: ``item_id`` BIGINT, ``text`` STRING. A document
    contains a passage if at least ``window`` consecutive words of the item stand in it in a row (case,
    punctuation, layout, escape sequences and comment marks aside) and at least one such window stands in no
    other item. With ``slop`` > 0 proximity matches are reported too: ``near_terms`` of the words around a
    rare term of the item, each within ``slop`` words of its place, wording that stands in several items apart.

    Result, one row for each document and item: ``doc_id, item_id, words`` (most words in a row) and ``near``
    (most words near each other; 0 if slop is 0).

    Rows with a null id or null or empty text have no matches; items shorter than the window have none;
    several documents with the same text, or rows with the same id, are matched each and reported by id.
    Empty tables give an empty result.
    """
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > MAX_TEST_CHARS:
        raise ValueError(f"the test items have {size} characters, more than the {MAX_TEST_CHARS} that go to every task")
    rows = items.select(F.col("item_id").cast("long"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct().collect()  # bounded above
    test = TestSet([(r.item_id, r.text) for r in sorted(rows, key=lambda r: r.item_id)], window)
    index = cut(build_index(documents, test.vocabulary), "postings")
    seen = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df").alias("df")).collect()  # bounded by the vocabulary
    frequency = np.zeros(len(test.vocabulary) + 1, np.int64)
    for r in seen:
        frequency[r.terms] = r.df
    anchors = test.anchors(frequency)

    def run(batches):
        for pdf in batches:
            for shard in pdf.to_dict("records"):
                doc, item, run_, near = intersect({k: np.asarray(v) for k, v in shard.items()}, test, anchors, slop, near_terms)
                yield pd.DataFrame({"doc_id": np.asarray(shard["docs"])[doc], "item_id": item, "words": run_, "near": near}).groupby(["doc_id", "item_id"], as_index=False).max()

    found = index.mapInPandas(run, "doc_id long, item_id long, words long, near long")
    return found.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"), F.max("near").alias("near"))
