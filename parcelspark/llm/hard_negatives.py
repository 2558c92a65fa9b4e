"""Hard negatives by rotated one-bit codes: popcounts give an estimate, a residual bound makes it an interval, survivors are scored exactly.

A candidate is coded by its difference x from the mean of its label in its block, which is small where labels are clusters. Differences are turned by one random
rotation, and x keeps the signs of its turned components as a code; the code is a unit vector u,
and with it are stored the alignment a = x.u and the length of the rest, r = sqrt(x.x - a a). For an anchor q the
score is q.mean + x.q, where x.q = a (u.q) + rest.q, and by Cauchy and Schwarz |rest.q| <= r sqrt(q.q - (u.q)^2), since the rest is at right angles to u. u.q comes
from popcounts of the code with bit planes of the turned anchor, rounded to ``PLANES`` bits; what rounding left is a known
vector, whose length bounds the error of u.q. So every pair has an interval that holds its score for certain. Candidates whose interval cannot reach the
list are dropped, the others are scored in whole numbers: nothing is lost to the codes.

Two searches over the tiles of ``vectors``: first each anchor's positives, then, with their scores as ceilings and floors, the negatives of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import vectors
from .common import written

#: Bits to which a component of a turned anchor is rounded.
PLANES = 6
POSITIVES = "anchor_id bigint, positive_id bigint, score bigint"
NEGATIVES = "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint"


@cache
def rotation(width: int, seed: int = 20) -> np.ndarray:
    """The same random rotation in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    size = -(-bits.shape[-1] // 64) * 8
    out = np.zeros((*bits.shape[:-1], size), np.uint8)
    some = np.packbits(bits, axis=-1)
    out[..., : some.shape[-1]] = some
    return out.view(np.uint64)


class Codes:
    """The candidates of a block: codes, alignments and lengths of the rests."""

    def __init__(self, rows: pa.Table):
        self.ids = rows.column("id").to_numpy()
        label = rows.column("label").combine_chunks()
        self.label = label.to_numpy(zero_copy_only=False)
        self.whole = vectors.matrix(rows.column("vec"))
        self.real = self.whole.astype(np.float64)
        self.width = self.whole.shape[1]
        labels, self.group = np.unique(self.label, return_inverse=True)
        self.mean = np.stack([np.bincount(self.group, self.real[:, d], len(labels)) for d in range(self.width)], axis=1) / np.bincount(self.group, minlength=len(labels))[:, None]
        away = self.real - self.mean[self.group]
        turned = away @ rotation(self.width).T
        self.code = packed(turned > 0)
        signs = np.where(turned > 0, 1.0, -1.0)
        self.ones = (turned > 0).sum(axis=1)
        self.align = (turned * signs).sum(axis=1) / np.sqrt(self.width)
        square = (away**2).sum(axis=1)
        self.length = np.linalg.norm(self.real, axis=1) + np.sqrt(square)
        self.rest = np.sqrt(np.maximum(0.0, square - self.align**2))

    def interval(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that each candidate can have."""
        turned = rotation(self.width) @ query
        low, high = turned.min(), turned.max()
        step = (high - low) / ((1 << PLANES) - 1) or 1.0
        steps = np.rint((turned - low) / step).astype(np.int64)
        away = np.linalg.norm(turned - (low + step * steps))
        planes = packed(((steps >> np.arange(PLANES)[:, None]) & 1).astype(bool))
        shared = sum((np.bitwise_count(self.code & planes[j]).sum(axis=1, dtype=np.int64) << j) for j in range(PLANES))
        along = (low * (2 * self.ones - self.width) + step * (2 * shared - steps.sum())) / np.sqrt(self.width)
        size = np.linalg.norm(query)
        beside = self.rest * np.sqrt(np.maximum(0.0, size**2 - np.maximum(0.0, np.abs(along) - away) ** 2))
        slack = 1e-9 * (1.0 + size * self.length)
        middle = (self.mean @ query)[self.group]
        return middle + self.align * np.maximum(along - away, -size) - beside - slack, middle + self.align * np.minimum(along + away, size) + beside + slack

    def scores(self, rows: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
        """Whole-number scores; doubles hold them where ``exact``."""
        return np.rint(self.real[rows] @ query).astype(np.int64) if exact else self.whole[rows] @ query


def _best(rows: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids[rows], -score))[:k]


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def positives_of(tile: Codes, query: np.ndarray, own: int, label: int, k: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the best ``k`` candidates of the anchor's label but itself."""
    rows = np.flatnonzero((tile.label == label) & (tile.ids != own))
    low, high = tile.interval(query)
    rows = rows[high[rows] >= _kth(low[rows], k)]
    score = tile.scores(rows, query, exact)
    best = _best(rows, score, tile.ids, k)
    return tile.ids[rows][best], score[best]


def negatives_of(tile: Codes, query: np.ndarray, own: int, label: int, positive: np.ndarray, k: int, least: int, most: int, exact: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each positive score p the ids and scores of the best ``k`` candidates of other labels with least * p <= 100 * score <= most * p."""
    other = np.flatnonzero((tile.label != label) & (tile.ids != own))
    low, high = tile.interval(query)
    low, high = low[other], high[other]
    may = np.zeros((len(positive), len(other)), bool)
    for j, p in enumerate(positive.tolist()):
        floor, ceiling = least * p / 100, most * p / 100
        sure = (low >= floor) & (high <= ceiling)
        may[j] = (high >= max(floor, _kth(low[sure], k))) & (low <= ceiling)
    rows = np.flatnonzero(may.any(axis=0))
    score = tile.scores(other[rows], query, exact)
    out = []
    for j, p in enumerate(positive.tolist()):
        fit = np.flatnonzero(may[j, rows] & (100 * score >= least * p) & (100 * score <= most * p))
        best = fit[_best(other[rows[fit]], score[fit], tile.ids, k)]
        out.append((tile.ids[other[rows[best]]], score[best]))
    return out


def _positives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, asked in vectors.tiles(batches, Codes):
            queries, ids, labels = vectors.matrix(asked.column("vec"), tile.width), asked.column("id").to_numpy(), asked.column("label").to_numpy()
            exact = vectors.fits_double(tile.whole, queries)
            found = [positives_of(tile, q, own, label, k, exact) for q, own, label in zip(queries, ids, labels)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(f[0]) for f in found])), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))],
                                             names=["anchor_id", "positive_id", "score"])
    return run


def _negatives(k: int, least: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, asked in vectors.tiles(batches, Codes):
            queries, ids, labels = vectors.matrix(asked.column("vec"), tile.width), asked.column("id").to_numpy(), asked.column("label").to_numpy()
            extra = asked.column("extra")
            cuts, pairs = extra.offsets.to_numpy(), extra.flatten()
            cuts = cuts - cuts[0]
            of, value = pairs.field("id").to_numpy(), pairs.field("score").to_numpy()
            exact = vectors.fits_double(tile.whole, queries)
            rows: list[tuple] = []
            for i, q in enumerate(queries):
                part = slice(cuts[i], cuts[i + 1])
                for p, s, (found, score) in zip(of[part], value[part], negatives_of(tile, q, ids[i], labels[i], value[part], k, least, most, exact)):
                    rows.append((np.full(len(found), ids[i]), np.full(len(found), p), found, np.full(len(found), s), score))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])
    return run


def mine(rows: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, id_column: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor (rows where ``anchors`` holds) and each of its first ``positives`` other rows of the same label,
    the first ``negatives`` rows of other labels with least * p <= 100 * score <= most * p, p being the positive's score. Scores are inner products of floor(scale * x); higher ones come first, ties by smaller id.

    Ids and labels are whole numbers. Rows with a null id or label, a null vector, or a null or non-finite component take no part. Rows that repeat an id are candidates each, though never of
    their own id, while an anchor id is asked once, by its least vector. A shorter vector counts as ending in zeros; 100 times a score must fit a long. An anchor without positives, or
    without negatives in the range (as where p < 0), has no rows; empty tables have none; further columns are ignored. Runs jobs: two counts, and the positives are written to the shared folder.
    """
    rows = rows.withColumns({"__anchor": anchors, "__label": label}).where(F.col("__label").isNotNull())
    held = vectors.whole_numbers(rows, id_column, vector, scale, F.col("__label"))
    asked = vectors.one_per_id(vectors.whole_numbers(rows.where("__anchor"), id_column, vector, scale, F.col("__label")))
    order = W.partitionBy("anchor_id").orderBy(F.col("score").desc(), "positive_id")
    near = vectors.answered(held, asked, _positives(positives), POSITIVES).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives)
    # at most `positives` structs each; rows that repeat an id are one positive
    near = near.groupBy("anchor_id").agg(F.collect_set(F.struct(F.col("positive_id").alias("id"), "score")).alias("extra"))
    known = written(asked.join(near.withColumnRenamed("anchor_id", "id"), "id"), "anchors")
    found = vectors.answered(held, known, _negatives(negatives, least, most), NEGATIVES)
    order = W.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.col("negative_score").desc(), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
