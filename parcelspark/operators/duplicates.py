"""Duplicate addresses: exact, by edit distance, and by matching-block ratio; all pairs, or the best match of each listing.

Both fuzzy measures bound how many characters two addresses must have in common: a ratio r = 2 M / (n + m) needs M >= r (n + m) / 2,
an edit distance d <= (1 - r) max(n, m) needs max(n, m) - d. Distinct addresses are dealt into tiles, and in a tile an address meets the stored ones whose lengths allow it:
first by the counts of their characters, then by their longest common subsequence, each for many pairs at once. Both are bounds at every threshold; what passes is verified.
Distinct addresses are compared once and have numbers, so what is written and shuffled for a pair is two numbers and a score; the listings of each address come last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import normalize_address
from ..sources.scratch import kept, spread

# Fixed value: the ratio from which two addresses count as one.
THRESHOLD = 0.85
#: Characters counted each on its own; all others count as one.
COUNTED = "abcdefghijklmnopqrstuvwxyz0123456789 "
#: Stored addresses that a task holds at a time, about; pairs whose order is looked at together; and the longest pattern whose order is looked at.
TILE, MET, WORD = 16_384, 16_384, 64
#: Pairs compared together.
TOGETHER = 4_096
#: Listings (two numbers each) that may be broadcast.
FEW_LISTINGS = 1_000_000
#: Candidates of a listing are dealt into so many groups, so that one listing is never one task.
SALTS = 8


def _normalized(df: DataFrame, key: str) -> DataFrame:
    out = df.select(F.col(key), "address", normalize_address(F.col("address")).alias("norm"))
    return out.where("norm <> ''").withColumn("n", F.length("norm"))


def exact(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Pairs ``new_id, existing_id`` with the same normalised address."""
    return _normalized(new, "new_id").select("new_id", "norm").join(_normalized(stored, "id").select(F.col("id").alias("existing_id"), "norm"), "norm").drop("norm")


def _listed(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The distinct normalised addresses with numbers (``text, k<text>``), and each row's number (``key, k<text>``). An address is normalised once however often it comes; runs jobs that write both."""
    raw = kept(_normalized(df.select(F.lit(0).alias("k"), "address").distinct(), "k").select("address", "norm"), f"addresses-{text}")
    distinct = kept(raw.select(F.col("norm").alias(text)).distinct().withColumn(f"k{text}", F.monotonically_increasing_id()), f"distinct-{text}")
    numbers = raw.join(distinct, raw["norm"] == distinct[text]).select("address", f"k{text}")
    return distinct, kept(df.select(key, "address").join(numbers, "address").select(key, f"k{text}"), f"numbers-{text}")


Least = Callable[[Column, Column], Column]
#: The scores of pairs of texts, some number below the threshold where that is not reached.
Score = Callable[[list[str], list[str], float], np.ndarray]


def _classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The classes of all characters in a row, where each text starts, and how often each text has each class."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    own = np.full(256, len(COUNTED), np.uint8)
    own[[ord(c) for c in COUNTED]] = range(len(COUNTED))
    flat = np.where(flat < 256, own[np.minimum(flat, 255)], np.uint8(len(COUNTED)))
    sizes = np.array([len(t) for t in texts], np.int64)
    width = len(COUNTED) + 1
    counts = np.bincount(np.repeat(np.arange(len(texts)) * width, sizes) + flat, minlength=len(texts) * width).reshape(-1, width)
    return flat, np.cumsum(sizes) - sizes, counts


class _Tile:
    """Stored addresses in order of their lengths."""

    def __init__(self, rows: pa.StructArray, score: Score | None, threshold: float):
        self.score, self.threshold = score, threshold
        texts = rows.field("b").to_pylist()
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        self.texts = texts = [texts[i] for i in order]
        self.rows, self.sizes = rows.take(pa.array(order)), np.array([len(t) for t in texts], np.int64)
        flat, starts, counts = _classes(texts)
        self.most = int(counts.max(initial=0))
        kind = np.uint8 if self.sizes[-1] < 1 << 8 else np.uint16 if self.sizes[-1] < 1 << 16 else np.uint32
        self.counts = np.ascontiguousarray(counts.T.astype(kind))
        # the characters of shorter ones, a row for each place; beyond the end a class that nothing has
        short = self.sizes[: np.searchsorted(self.sizes, 2 * WORD, "right")]
        places = np.arange(2 * WORD)[:, None]
        self.codes = np.where(places < short, flat[np.minimum(starts[: len(short)] + places, len(flat) - 1)], np.uint8(len(COUNTED) + 1))

    def meet(self, rows: pa.StructArray, needs: list[np.ndarray], low: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Each of some rows with the addresses that share as many characters as it ``needs`` (for lengths from ``low``), first whatever their order, then in order."""
        texts = rows.field("a").to_pylist()
        flat, starts, counts = _classes(texts)
        masks = np.zeros((len(texts), len(COUNTED) + 2), np.uint64)
        found, n = [], 0
        for i, text in enumerate(texts):
            first, last = np.searchsorted(self.sizes, [low[i], low[i] + len(needs[i])])
            if first == last:
                continue
            common = np.zeros(last - first, self.counts.dtype)
            for k in np.flatnonzero(counts[i]):
                common += np.minimum(self.counts[k, first:last], self.counts.dtype.type(min(counts[i, k], self.most)))
            hit = np.flatnonzero(common >= needs[i][self.sizes[first:last] - low[i]])
            if not len(hit):
                continue
            if len(text) <= WORD:
                np.bitwise_or.at(masks[i], flat[starts[i]: starts[i] + len(text)], np.uint64(1) << np.arange(len(text), dtype=np.uint64))
            found.append((np.full(len(hit), i), first + hit, common[hit].astype(np.int64)))
            if (n := n + len(hit)) >= MET:
                yield from self._in_order(rows, texts, needs, low, masks, found)
                found, n = [], 0
        if found:
            yield from self._in_order(rows, texts, needs, low, masks, found)

    def _in_order(self, rows, texts, needs, low, masks, found) -> Iterator[pa.RecordBatch]:
        i, j, common = (np.concatenate(c) for c in zip(*found))
        for at in range(0, len(i), MET):
            a, b, n = i[at: at + MET], j[at: at + MET], common[at: at + MET].copy()
            sizes = np.array([len(t) for t in texts], np.int64)[a]
            fit = np.flatnonzero((sizes <= WORD) & (b < self.codes.shape[1]))
            if len(fit):
                # bits of a's places, cleared where the longest common subsequence grows
                free, row = np.full(len(fit), ~np.uint64(0)), masks[a[fit]].ravel()
                base = np.arange(len(fit)) * masks.shape[1]
                for codes in self.codes[: self.sizes[b[fit]].max()]:
                    taken = free & row[base + codes[b[fit]]]
                    free = (free + taken) | (free - taken)
                own = np.uint64(2) ** (sizes[fit] - 1).astype(np.uint64)
                n[fit] = np.bitwise_count(~free & (own | (own - np.uint64(1))))
            need = np.fromiter((needs[x][y] for x, y in zip(a.tolist(), (self.sizes[b] - low[a]).tolist())), np.int64, len(a))
            hit = n >= need
            a, b, n = a[hit], b[hit], n[hit]
            names, made = ["na", "nb", "common"], [sizes[hit].astype(np.int32), self.sizes[b].astype(np.int32), n.astype(np.int32)]
            if self.score:
                score = [self.score([texts[x] for x in a[k: k + TOGETHER]], [self.texts[y] for y in b[k: k + TOGETHER]], self.threshold) for k in range(0, len(a), TOGETHER)]
                score = np.concatenate([np.zeros(0), *score])
                hit = score >= self.threshold
                a, b, names, made = a[hit], b[hit], ["score"], [score[hit]]
            if len(a):
                x, y = rows.take(pa.array(a)), self.rows.take(pa.array(b))
                yield pa.RecordBatch.from_arrays([*x.flatten(), *y.flatten(), *map(pa.array, made)], names=[*[f.name for f in x.type], *[f.name for f in y.type], *names])


def _meet(score: Score | None, threshold: float):
    """Of rows sorted by tile and kind, the stored addresses (kind 0) are held and the fresh ones (kind 1) stream past them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, tile = None, [], None
        for batch in batches:
            tiles, kind = batch.column("tile").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(tiles) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(kind)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if of != (of := tiles[start]):
                    held, tile = [], None
                rows = batch.slice(start, end - start)
                if kind[start] == 0:
                    held.append(rows.column("held"))
                    continue
                if held:
                    tile, held = _Tile(pa.concat_arrays(held), score, threshold), []
                if tile is not None:
                    yield from tile.meet(rows.column("fresh"), [n.values.to_numpy() for n in rows.column("need")], rows.column("low").to_numpy())
    return run


def candidates(fresh: DataFrame, held: DataFrame, least: Least, band: float, score: Score | None = None, threshold: float = 0.0) -> DataFrame:
    """Pairs ``a, b, na, nb, common`` of distinct addresses that share at least ``least(na, nb)`` characters; the shorter has at least ``band`` of the longer's length.

    ``fresh`` has a column a, ``held`` a column b; further columns stay. ``common`` is the greatest number that can match: the length of the longest common subsequence, or the shared counts where the
    first has more than ``WORD`` characters. With a ``score`` (of lists of both texts) only the pairs that reach the threshold come back, with ``score`` in place of lengths and number.
    Held addresses are dealt into parts of about ``TILE``, fresh ones into shares where the parts are fewer than the cores. A job counts the held ones.
    """
    cores = 4 * held.sparkSession.sparkContext.defaultParallelism
    parts = held.count() // TILE + 1
    shares = -(-cores // parts)
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    na = F.length("a")
    low, high = F.ceil(na * band - 1e-9).cast("int"), F.floor(na / band + 1e-9).cast("int")
    asked = fresh.where("a <> ''").select(F.struct(*fresh.columns).alias("fresh"), dealt("a", shares).alias("share"), low.alias("low"), F.transform(F.sequence(low, high), lambda nb: least(na, nb).cast("int")).alias("need"))
    stored = held.where("b <> ''").select(F.struct(*held.columns).alias("held"), dealt("b", parts).alias("part"))
    tile = (F.col("part") * shares + F.col("share")).alias("tile")
    asked = asked.withColumn("part", every(parts)).select(tile, F.lit(1).alias("kind"), "low", "need", "fresh")
    stored = stored.withColumn("share", every(shares)).select(tile, F.lit(0).alias("kind"), "held")
    tiles = stored.unionByName(asked, allowMissingColumns=True).repartitionById(parts * shares, "tile").sortWithinPartitions("tile", "kind")
    made = [T.StructField("score", T.DoubleType())] if score else [T.StructField(c, T.IntegerType()) for c in ("na", "nb", "common")]
    return tiles.mapInArrow(_meet(score, threshold), T.StructType([*fresh.schema.fields, *held.schema.fields, *made]))


def _joined(pairs: DataFrame, new: DataFrame, stored: DataFrame) -> DataFrame:
    """The listings of each pair of addresses. Pairs meet the stored listings by number on all cores; the new ones are broadcast if they are few."""
    pairs = kept(pairs.select("ka", "kb", "score"), "address-pairs")
    both = spread(pairs, "kb").join(spread(stored, "kb"), "kb")
    return both.join(F.broadcast(new) if new.count() <= FEW_LISTINGS else new, "ka").select("new_id", F.col("id").alias("existing_id"), "score")


def _distinct(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col("norm").alias(name)).distinct()


def by_levenshtein(new: DataFrame, stored: DataFrame, threshold: float = THRESHOLD, digits: int | None = None) -> DataFrame:
    """Pairs with 1 - distance / longer length of at least the threshold: ``new_id, existing_id, score``, the score rounded to ``digits`` if given."""
    (fresh, new), (held, stored) = _listed(new, "new_id", "a"), _listed(stored, "id", "b")
    pairs = candidates(fresh, held, lambda na, nb: F.ceil(threshold * F.greatest(na, nb) - 1e-9), threshold, likeness, threshold)
    return _joined(_rounded(pairs, digits), new, stored)


def _rounded(pairs: DataFrame, digits: int | None) -> DataFrame:
    """Before the pairs of addresses become many more pairs of listings."""
    return pairs if digits is None else pairs.withColumn("score", F.round("score", digits))


def _codes(texts: list[str]) -> np.ndarray:
    """Code points, a column for each text; what is beyond its end is 0."""
    width = max(map(len, texts))
    codes = np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width)
    return np.ascontiguousarray(codes.T.astype(np.uint8 if codes.max() < 256 else np.uint32))


def _longest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per column the longest common run of x and y: its length and its starts in both, the first in x and then the first in y. 0 in x and 1 in y match nothing."""
    n = x.shape[1]
    size, at, to = np.zeros(n, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)
    run, last = np.zeros((len(y) + 1, n), np.uint8), np.zeros((len(y) + 1, n), np.uint8)
    for i in range(len(x)):
        np.add(last[:-1], 1, out=run[1:])
        run[1:] *= y == x[i]
        most = run.max(axis=0)
        more = np.flatnonzero(most > size)
        if len(more):
            end = run[:, more].argmax(axis=0)
            size[more] = most[more]
            at[more], to[more] = i + 1 - most[more].astype(np.int64), end - most[more].astype(np.int64)
        run, last = last, run
    return size.astype(np.int64), at, to


def ratios(a: list[str], b: list[str], threshold: float = 0.0) -> np.ndarray:
    """The matching-block ratio of each pair as ``difflib`` has it, many pairs at once; some number below the threshold where that is not reached.

    A round finds the longest run of every open pair of stretches; what lies to its left and to its right is open in the next. Texts from 200 characters on, where
    ``difflib`` passes over frequent characters, and those with control characters that mark ends here are left to it.
    """
    from difflib import SequenceMatcher

    out, total = np.zeros(len(a)), np.array([len(x) + len(y) for x, y in zip(a, b)], float)
    plain = np.array([0 < len(x) < 200 and 0 < len(y) < 200 and not ("\0" in x or "\0" in y or "\1" in x or "\1" in y) for x, y in zip(a, b)], bool)
    for i in np.flatnonzero(~plain):
        out[i] = SequenceMatcher(None, a[i], b[i]).ratio()
    own = np.flatnonzero(plain)
    if not len(own):
        return out
    x, y = _codes([a[i] for i in own]), _codes([b[i] for i in own])
    na, nb = (np.array([len(t[i]) for i in own]) for t in (a, b))
    matched, total = np.zeros(len(own), np.int64), total[own]
    pair, alo, ahi, blo, bhi = np.arange(len(own)), np.zeros_like(na), na, np.zeros_like(nb), nb
    while len(pair):
        rows = lambda codes, low, high, none: np.where((k := np.arange((high - low).max())[:, None]) < high - low, codes[np.minimum(low + k, len(codes) - 1), pair], codes.dtype.type(none))
        size, i, j = _longest(rows(x, alo, ahi, 0), rows(y, blo, bhi, 1))
        matched += np.bincount(pair, size, len(own)).astype(np.int64)
        i, j, hit = i + alo, j + blo, size > 0
        parts = [np.concatenate(v) for v in ((pair[hit],) * 2, (alo[hit], (i + size)[hit]), (i[hit], ahi[hit]), (blo[hit], (j + size)[hit]), (j[hit], bhi[hit]))]
        open_ = (parts[2] > parts[1]) & (parts[4] > parts[3])
        pair, alo, ahi, blo, bhi = (v[open_] for v in parts)
        most = matched + np.bincount(pair, np.minimum(ahi - alo, bhi - blo), len(own))
        open_ = (2.0 * most / total >= threshold)[pair]
        pair, alo, ahi, blo, bhi = (v[open_] for v in (pair, alo, ahi, blo, bhi))
    out[own] = 2.0 * matched / total
    return out


def likeness(a: list[str], b: list[str], threshold: float = 0.0) -> np.ndarray:
    """1 - edit distance / longer length of each pair, many pairs at once: a bit for each place of the shorter text, and a step for each character of the longer one. Pairs of texts of more than ``WORD`` characters go one by one."""
    x, y = zip(*[(p, q) if len(p) <= len(q) else (q, p) for p, q in zip(a, b)]) if a else ((), ())
    n, m = np.array([len(t) for t in x], np.int64), np.array([len(t) for t in y], np.int64)
    distance = m.copy()
    own = np.flatnonzero((n > 0) & (n <= WORD))
    for i in np.flatnonzero(n > WORD):
        distance[i] = _distance(x[i], y[i])
    if len(own):
        q, p = _codes([y[i] for i in own]), _codes([x[i] for i in own])
        if q.dtype == np.uint8:
            classes = np.flatnonzero(np.bincount(q.ravel(), minlength=256))
            q_of = np.searchsorted(classes, np.arange(256))[q]
        else:
            classes, q_of = np.unique(q, return_inverse=True)
        at = np.searchsorted(classes, p)
        known = (at < len(classes)) & (classes[np.minimum(at, len(classes) - 1)] == p)
        every, one = np.arange(len(own)), np.uint64(1)
        masks = np.zeros((len(own), len(classes)), np.uint64)
        for k in range(len(p)):
            rows = np.flatnonzero(known[k] & (k < n[own]))
            masks[rows, at[k, rows]] |= one << np.uint64(k)
        masks, base, q_of = masks.ravel(), every * len(classes), q_of.reshape(q.shape)
        up, down = np.full(len(own), ~np.uint64(0)), np.zeros(len(own), np.uint64)
        last, found = (n[own] - 1).astype(np.uint64), n[own].copy()
        for k in range(len(q)):
            equal = masks[base + q_of[k]]
            flat = (((equal & up) + up) ^ up) | equal | down
            more, less = down | ~(flat | up), flat & up
            found += (((more >> last) & one).astype(np.int64) - ((less >> last) & one).astype(np.int64)) * (k < m[own])
            more = (more << one) | one
            up, down = (less << one) | ~(flat | more), more & flat
        distance[own] = found
    return 1 - distance / np.maximum(m, 1)


def _distance(x: str, y: str) -> int:
    """The edit distance of two long texts, a row at a time."""
    q = np.frombuffer(y.encode("utf-32-le", "surrogatepass"), np.uint32)
    places = np.arange(len(q) + 1)
    row = places
    for i, c in enumerate(x, 1):
        row = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (q != ord(c)))])
        row = np.minimum.accumulate(row - places) + places
    return int(row[-1])


def _ratio_bounds(threshold: float) -> tuple[Least, float]:
    return lambda na, nb: F.ceil(threshold / 2 * (na + nb) - 1e-9), threshold / (2 - threshold)


def _may_match(new: DataFrame, stored: DataFrame, threshold: float) -> DataFrame:
    """Candidates for the ratio, with ``bound``, the greatest ratio that each can have; long ones, whose order was not looked at, are thinned by a native distance, which the ratio bounds."""
    pairs = candidates(new, stored, *_ratio_bounds(threshold))
    total = F.col("na") + F.col("nb")
    near = F.when(F.col("na") > WORD, F.levenshtein("a", "b") <= (1 - threshold) * total + 1e-9).otherwise(True)
    return pairs.where(near).withColumn("bound", 2.0 * F.col("common") / total)


def by_ratio(new: DataFrame, stored: DataFrame, threshold: float = THRESHOLD, digits: int | None = None) -> DataFrame:
    """All pairs whose matching-block ratio (new address first: the ratio depends on the order) reaches the threshold: ``new_id, existing_id, score``, the score rounded to ``digits`` if given."""
    (fresh, new), (held, stored) = _listed(new, "new_id", "a"), _listed(stored, "id", "b")
    return _joined(_rounded(candidates(fresh, held, *_ratio_bounds(threshold), ratios, threshold), digits), new, stored)


#: Candidates of a listing that are compared before its best match is looked at again, at most; the first is compared alone.
STEP = 64


def _rising(threshold: float):
    """Best match per group of candidates that come in falling order of their bounds: what cannot pass the best so far is not compared. The groups of a batch are compared together, up to ``STEP`` candidates of each at a time."""
    names = ["a", "score", "first_id", "tried"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # the group that goes on in the next batch: key, best score, its id, number compared
        for rows in batches:
            if not len(rows):
                continue
            a, b, first, bound = rows["a"].tolist(), rows["b"].tolist(), rows["first_id"].to_numpy(), rows["bound"].to_numpy()
            keys = list(zip(a, rows["salt"]))
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])]
            ends = np.array([*starts[1:], len(keys)])
            at, n = np.array(starts), len(starts)
            score, best, tried = np.full(n, -1.0), np.zeros(n, np.int64), np.zeros(n, np.int64)
            out = []
            if last and last[0] == keys[0]:
                score[0], best[0], tried[0] = last[1:]
            elif last:
                out.append((last[0][0], *last[1:]))
            open_, step = np.arange(n), 1
            while len(open_):
                take = at[open_][:, None] + np.arange(step)
                group = np.broadcast_to(open_[:, None], take.shape)
                take, group = take[take < ends[open_][:, None]], group[take < ends[open_][:, None]]
                may = (bound[take] >= threshold) & ((bound[take] > score[group]) | (bound[take] == score[group]) & (first[take] < best[group]))
                # bounds fall, so a group whose next candidate lies below its best or the threshold is done
                at[open_] += step
                step = min(2 * step, STEP)
                ahead = np.minimum(at[open_], len(bound) - 1)
                take, group = take[may], group[may]
                if len(take):
                    found = np.concatenate([ratios([a[i] for i in take[k: k + TOGETHER]], [b[i] for i in take[k: k + TOGETHER]], threshold) for k in range(0, len(take), TOGETHER)])
                    tried += np.bincount(group, minlength=n)
                    order = np.lexsort((first[take], -found, group))
                    order = order[np.unique(group[order], return_index=True)[1]]
                    g, f, c = group[order], found[order], first[take][order]
                    better = (f >= threshold) & ((f > score[g]) | (f == score[g]) & (c < best[g]))
                    score[g[better]], best[g[better]] = f[better], c[better]
                open_ = open_[(at[open_] < ends[open_]) & (bound[ahead] >= np.maximum(threshold, score[open_]))]
            out += [(keys[i][0], score[k], best[k], tried[k]) for k, i in enumerate(starts[:-1])]
            last = (keys[-1], score[-1], best[-1], tried[-1])
            yield made(out)
        if last:
            yield made([(last[0][0], *last[1:])])

    def made(out: list) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=names).astype({"score": "float64", "tried": "int64"})
        none = frame["score"] < 0
        return frame.assign(score=frame["score"].mask(none), first_id=frame["first_id"].astype("Int64").mask(none))
    return run


def best_of(fresh: DataFrame, held: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``a, score, first_id, tried``: up to ``SALTS`` rows for each distinct address a, with the best match of a share of its candidates (null: none) and how many were compared.

    ``held`` has b and ``first_id``, a whole number; equal scores go to the smallest. Each share is a sorted run that streams through a task with one best match in memory.
    """
    pairs = _may_match(fresh, held, threshold).withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS))).select("a", "salt", "b", "first_id", "bound")
    return pairs.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("bound").desc(), "first_id").mapInPandas(_rising(threshold), "a string, score double, first_id bigint, tried bigint")


def best(new: DataFrame, stored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The best match by ratio of each listing that has one: ``new_id, existing_id, score``, equal scores to the smallest existing id.

    Equal addresses cannot be bettered, so they are joined first; only the rest looks for close ones, and stops looking where no candidate's bound passes what it has.
    """
    new, stored = _normalized(new, "new_id"), _normalized(stored, "id")
    fresh = kept(_distinct(new, "a"), "fresh")
    held = kept(stored.groupBy(F.col("norm").alias("b")).agg(F.min("id").cast("bigint").alias("first_id")), "held")
    same = fresh.join(held, F.col("a") == F.col("b")).select("a", F.lit(1.0).alias("score"), "first_id")
    close = best_of(fresh.join(held, F.col("a") == F.col("b"), "left_anti"), held, threshold).where("score is not null").drop("tried")
    found = same.unionByName(close).groupBy("a").agg(F.min(F.struct((-F.col("score")).alias("lost"), "first_id")).alias("m"))
    return new.join(found, new["norm"] == found["a"]).select("new_id", F.col("m.first_id").alias("existing_id"), (-F.col("m.lost")).alias("score"))


def without_duplicates(new: DataFrame, pairs: DataFrame, within_batch: bool = False) -> DataFrame:
    """New rows to save: those without a duplicate among the stored ones; with ``within_batch``, also one per normalised address."""
    rest = new.join(pairs.select("new_id").distinct(), "new_id", "left_anti")
    if not within_batch:
        return rest
    first = rest.withColumn("norm", normalize_address(F.col("address"))).where("norm <> ''").groupBy("norm").agg(F.min("new_id").alias("new_id"))
    return rest.join(first.select("new_id"), "new_id", "left_semi").unionByName(rest.where(F.coalesce(normalize_address(F.col("address")), F.lit("")) == ""))


def report(new: DataFrame, stored: DataFrame, pairs: DataFrame) -> DataFrame:
    """The best match of each duplicate, with both addresses cut to 50 characters."""
    best = pairs.groupBy("new_id").agg(F.max(F.struct("score", F.negative("existing_id").alias("k"))).alias("best"))
    best = best.select("new_id", F.negative("best.k").alias("existing_id"), F.round(100 * F.col("best.score"), 1).alias("score_pct"))
    return best.join(new.select("new_id", F.substring("address", 1, 50).alias("new_address")), "new_id") \
        .join(stored.select(F.col("id").alias("existing_id"), F.substring("address", 1, 50).alias("existing_address")), "existing_id")
