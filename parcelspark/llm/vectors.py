"""Whole-number vectors, dealt into tiles of candidates past which the queries are streamed.

A search holds a stated set of queries against all candidates. Candidates are dealt by hash into blocks of bounded size;
queries are copied to each block. A task sorts its block's candidates in front of the queries, builds one tile from the former
and answers the latter batch by batch, so its memory is bounded by the block, however many queries there are, and a lost
task repeats one block. What a block finds is reduced to the best few of each query before it is shuffled again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most candidates of a block: at 64 components some 250 MB of arrays at a time.
BLOCK = 131_072
#: Blocks are not made smaller than this for the sake of more tasks.
LEAST_BLOCK = 2_048
#: What a query may bring along.
EXTRA = "array<struct<id:bigint,score:bigint>>"


def whole_numbers(df: DataFrame, id_column: str, vector: str, scale: float = 256.0, label: Column | None = None) -> DataFrame:
    """``id``, ``vec`` (floor(scale * x) of each component, x as a double) and ``label``; rows without an id, with a null vector, or with a null or non-finite component are left out."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    label = F.lit(None).cast("bigint") if label is None else label.cast("bigint")
    known = df.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull() & finite)
    return known.select(F.col(id_column).cast("bigint").alias("id"), F.transform(x, lambda v: F.floor(v * scale)).alias("vec"), label.alias("label"))


def one_per_id(rows: DataFrame) -> DataFrame:
    """Of rows with the same id the least, so that a query is asked once."""
    names = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.min(F.struct(*names)).alias("row")).select("id", *[F.col("row")[c].alias(c) for c in names])


def answered(candidates: DataFrame, queries: DataFrame, answer: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``answer`` yields for each block. Both tables have ``id``, ``vec``, ``label``; queries may have ``extra``. Runs a job that counts the candidates."""
    n = candidates.count()
    parallel = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-n // BLOCK), min(-(-n // LEAST_BLOCK), parallel), 1)
    held = candidates.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "vec", "label", F.lit(None).cast(EXTRA).alias("extra"))
    extra = F.col("extra") if "extra" in queries.columns else F.lit(None).cast(EXTRA)
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "vec", "label", extra.alias("extra"))
    return held.unionByName(asked).repartitionById(blocks, "block").sortWithinPartitions("block", "kind").mapInArrow(answer, schema)


def matrix(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of whole numbers; a shorter vector counts as ending in zeros, and with ``width`` what is beyond it is left out."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    most = int(sizes.max(initial=1)) or 1
    if (sizes == most).all():
        out = flat.reshape(len(sizes), most)
    else:
        out = np.zeros((len(sizes), most), np.int64)
        out[np.arange(most) < sizes[:, None]] = flat
    if width is None or width == most:
        return out
    return out[:, :width] if width < most else np.pad(out, ((0, 0), (0, width - most)))


def tiles(batches: Iterator[pa.RecordBatch], build: Callable[[pa.Table], object]) -> Iterator[tuple[object, pa.RecordBatch]]:
    """(tile, query rows) in order of the stream: each block's candidates come first and become one tile. Blocks without candidates answer nothing."""
    parts: list[pa.RecordBatch] = []
    tile, of = None, None
    for batch in batches:
        block, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(block)]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            rows = batch.slice(low, high - low)
            if of != block[low]:
                parts, tile, of = [], None, block[low]
            if kind[low] == 0:
                parts.append(rows)
                continue
            if parts:
                tile, parts = build(pa.Table.from_batches(parts)), []
            if tile is not None:
                yield tile, rows


def fits_double(a: np.ndarray, b: np.ndarray) -> bool:
    """Inner products of rows of ``a`` and ``b`` are exact in doubles."""
    return float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[-1] < 2.0**53
