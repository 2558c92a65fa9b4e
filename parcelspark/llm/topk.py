"""Exact top-k by inner product with no random access to scores: sorted lists are read from their ends, bounds decide when to stop.

A tile (see ``vectors``) keeps one list of its candidates per component, sorted by the component. A query reads, slice by
slice, each list from the end where its own component's sign makes the contribution largest. A candidate's score lies
between what has been read of it plus the least that the rest of each list can add, and the same plus the value last read of each list
it has not appeared in. Candidates whose upper bound is below the k-th best lower bound cannot qualify, seen or not;
reading stops as soon as few are left, and their scores are then worked out in whole numbers. Bounds are in single precision and parts of the largest component, widened by more than it can lose. Every block gives
its best k, and a window over the blocks the best of all.

Defined results: see ``search``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import vectors

FOUND = "query_id bigint, vec_id bigint, score bigint"
#: Lists are read in so many slices at most.
SLICES = 10
#: Queries that read together have so many pairs with candidates at most.
TOGETHER = 1 << 19


class Lists:
    """The candidates of a block, and one sorted list per component: its values, and every candidate's place in it."""

    def __init__(self, rows: pa.Table):
        self.ids = rows.column("id").to_numpy()
        self.whole = vectors.matrix(rows.column("vec"))
        n, self.width = self.whole.shape
        order = np.argsort(self.whole, axis=0, kind="stable")
        unit = float(np.abs(self.whole.astype(np.float64)).max()) or 1.0
        self.real = (self.whole / unit).astype(np.float32)
        self.value = np.take_along_axis(self.real, order, axis=0)
        self.place = np.empty((n, self.width), np.int32)
        np.put_along_axis(self.place, order, np.arange(n, dtype=np.int32)[:, None], axis=0)


def top(tile: Lists, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each query the ids and scores of the best ``k`` candidates but its own, best first, ties to smaller ids; and how many entries of each list were read.

    Queries read together: a list is read from its high end by those that weigh it above 0 and from its low end by those below, so a slice of both ends is one matrix product.
    """
    n = len(tile.ids)
    out: list = [None] * len(queries)
    open_, depth, enough, step = np.arange(len(queries)), 0, max(8 * k, n // 16), max(1, -(-n // SLICES))
    scaled = queries / np.maximum(1.0, np.abs(queries.astype(np.float64)).max(axis=1, keepdims=True))
    weight = np.concatenate([np.maximum(scaled, 0), np.minimum(scaled, 0)], axis=1).astype(np.float32)
    far = np.concatenate([tile.value[0], tile.value[-1]]) * weight  # the other end of each list: the least that what is unread can add
    most = np.maximum(np.abs(tile.value[0]), np.abs(tile.value[-1]))
    slack = (np.abs(scaled) @ most * (8 * tile.width + 8) * 2.0**-24)[:, None]  # more than single precision loses
    known = np.zeros((len(queries), n), np.float32)
    mine = tile.ids == own[:, None]
    while len(open_):
        end = min(n, depth + step)
        high, low = tile.place >= n - end, tile.place < end
        slice_ = np.concatenate([tile.real * (high & (tile.place < n - depth)), tile.real * (low & (tile.place >= depth))], axis=1)
        known += weight[open_] @ slice_.T
        depth = end
        unread = np.concatenate([~high, ~low], axis=1).astype(np.float32)
        last = np.concatenate([tile.value[n - end], tile.value[end - 1]]) * weight[open_]
        lower = known + far[open_] @ unread.T - slack[open_]
        lower[mine[open_]] = -np.inf
        kth = np.partition(lower, n - k, axis=1)[:, n - k, None] if n >= k else np.full((len(open_), 1), -np.inf)
        may = (known + last @ unread.T + slack[open_] >= kth) & ~mine[open_]
        done = (may.sum(axis=1) <= enough) | (depth >= n)
        for i in np.flatnonzero(done):
            rows = np.flatnonzero(may[i])
            score = tile.whole[rows] @ queries[open_[i]]
            best = np.lexsort((tile.ids[rows], -score))[:k]
            out[open_[i]] = (tile.ids[rows][best], score[best], depth)
        open_, known = open_[~done], known[~done]
    return out


def _answer(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, asked in vectors.tiles(batches, Lists):
            queries, ids = vectors.matrix(asked.column("vec"), tile.width), asked.column("id").to_numpy()
            together = max(1, TOGETHER // len(tile.ids))
            for low in range(0, len(ids), together):
                part = slice(low, low + together)
                found = top(tile, queries[part], ids[part], k)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[part], [len(f[0]) for f in found])), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))],
                                                 names=["query_id", "vec_id", "score"])
    return run


def search(rows: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the ``k`` candidates (all, if fewer) with the highest inner product of floor(scale * x), ties to smaller ids.

    Ids are whole numbers. Rows with a null id, a null vector, or a null or non-finite component take no part, on either side. Candidates are all rows with an id other than
    the query's; rows that repeat an id are candidates each, while a query id is asked once, by its least vector. A vector shorter than another counts as ending in zeros; scores must fit a long.
    Empty tables give no rows; further columns are ignored. Runs a job that counts the candidates.
    """
    held, asked = vectors.whole_numbers(rows, id_column, vector, scale), vectors.one_per_id(vectors.whole_numbers(queries, id_column, vector, scale))
    found = vectors.answered(held, asked, _answer(k), FOUND)
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
